"""The archive as an object: open, check, tidy, rebuild, deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, surfaces
from .plans.recipe import Recipe, apply, propose
from .sources import sinks


class Engine:
    """``Engine(spark, path)`` works on a project: a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def tables(self) -> dict[str, DataFrame]:
        return sinks.open_project(self.spark, self.path)

    def create(self, sheets: dict[str, DataFrame], recipe: Recipe | None = None) -> Recipe:
        recipe = recipe or propose(sheets)
        sinks.save_project(apply(recipe, sheets), self.path)
        return recipe

    def check(self) -> DataFrame:
        """(livello, codice, unita): cycles, relations to unknown units, units without relations."""
        t = self.tables
        rel, us = t["relazioni"], t["us"].select(F.col("unita").alias("nodo")).distinct()
        ends = rel.select(F.explode(F.array("a", "b")).alias("nodo")).distinct()
        direct = rel.where(F.col("rel").isin("copre", "taglia", "riempie", "si appoggia a"))
        return (
            graph.strong_components(direct).select(F.lit("errore").alias("livello"), F.lit("ciclo").alias("codice"), F.col("nodo").alias("unita"))
            .unionByName(ends.join(us, "nodo", "left_anti").select(F.lit("avviso").alias("livello"), F.lit("sconosciuta").alias("codice"), F.col("nodo").alias("unita")))
            .unionByName(us.join(ends, "nodo", "left_anti").select(F.lit("info").alias("livello"), F.lit("isolata").alias("codice"), F.col("nodo").alias("unita")))
        )

    def summary(self) -> DataFrame:
        rows = [df.agg(F.lit(n).alias("tabella"), F.count(F.lit(1)).alias("righe")) for n, df in self.tables.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def rebuild(self, plans: DataFrame, levels: DataFrame) -> DataFrame:
        return surfaces.reconstruct(plans, levels)
