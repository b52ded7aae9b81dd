"""Edits, refreshes and histories: append-only logs, and only what changed done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .relational import changed


def latest_edits(log: DataFrame) -> DataFrame:
    """(unita, campo, valore): the last entry of each field; ``log``: (seq, unita, campo, valore)."""
    return log.groupBy("unita", "campo").agg(F.max_by("valore", "seq").alias("valore"))


def edited(df: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A table with the edits of its log applied."""
    last = latest_edits(log)
    wide = last.groupBy(F.col("unita").alias("__k")).agg(*(F.max(F.when(F.col("campo") == c, F.struct("valore"))).alias(f"__{c}") for c in columns))
    j = df.join(wide, F.col(key) == F.col("__k"), "left")
    return j.select(*(F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.valore")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def relations_after(rel: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(a, rel, b) with relations added and removed; refused (as it was) if it would close a cycle."""
    new = rel.select("a", "rel", "b").unionByName(added.select("a", "rel", "b")).distinct().join(removed.select("a", "rel", "b"), ["a", "rel", "b"], "left_anti")
    return new if graph.levels(new)[1].isEmpty() else rel.select("a", "rel", "b")


def inverse_values(raw: DataFrame) -> DataFrame:
    """(canonico, grezzo): the raw spelling most used for each canonical value; ties by spelling. ``raw``: (grezzo, canonico)."""
    c = raw.where("grezzo is not null and canonico is not null").groupBy("canonico", "grezzo").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("canonico").agg(F.min_by("grezzo", F.struct(-F.col("n"), "grezzo")).alias("grezzo"))


def unit_factor(pairs: DataFrame) -> DataFrame:
    """The factor of 1, 10, 100 and 1000 nearest to the median ratio of raw and projected values."""
    m = pairs.where("proj is not null and proj <> 0 and raw is not null").agg(F.median(F.abs(F.col("raw") / F.col("proj"))).alias("m"))
    near = F.array_min(F.transform(F.array(*(F.lit(float(f)) for f in (1, 10, 100, 1000))), lambda f: F.struct(F.abs(F.log10("m") - F.log10(f)).alias("d"), f.alias("f"))))
    return m.select(near["f"].cast("int").alias("fattore"))


def to_rebuild(before: DataFrame, after: DataFrame, edges: DataFrame, key: str = "unita", mark: str = "impronta") -> DataFrame:
    """(nodo): units that changed, and all above them."""
    seeds = changed(before, after, key, mark).select(F.col(key).alias("nodo"))
    return graph.reach(edges, seeds)


def partial(previous: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """Rebuilt rows in place of the earlier ones of the same key; all others stay."""
    return previous.join(rebuilt.select(key), key, "left_anti").unionByName(rebuilt)
