"""What typed relation phrases mean: exact wordings first, then misspellings, then wordings among other words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import RELATIONS, WORDINGS, plain

#: Most wordings; they become one literal of the plan. A longer list is refused, as no list of relations is.
MAX_WORDINGS = 5_000
#: A wording found among other words has at least so many letters.
LEAST_CONTAINED = 5


def key(c: Column) -> Column:
    """Letters and apostrophes of a phrase, lower case, without diacritics, single spaces; a sign alone stays."""
    t = plain(c)
    return F.when(t.isin("=", "==", "≡", ">", "<"), t).otherwise(F.trim(F.regexp_replace(F.replace(t, F.lit("’"), F.lit("'")), r"[^\p{L}']+", " ")))


def allowed(n: Column) -> Column:
    """Edits that a wording of n letters may have."""
    return F.when(n < 4, 0).when(n <= 6, 1).when(n <= 10, 2).otherwise(3)


def built_in(spark) -> DataFrame:
    """The wordings of ``WORDINGS`` as (termine, canonico)."""
    return spark.createDataFrame([(w, r) for r, ways in WORDINGS.items() for w in ways], "termine string, canonico string")


def meanings(phrases: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """(column, canonico, modo) of the distinct phrases; ``terms``: (termine, canonico).

    ``modo``: 'esatto' (equal but for case, diacritics, signs and digits), 'vicino' (fewest edits, at most
    ``allowed``, if all wordings that near mean the same), 'contenuto' (the longest wording of five letters or
    more among the words; ties by alphabet), or null with canonico null: not understood. Null phrases have no
    row. Each distinct phrase is compared once, in the engine.
    """
    known = terms.where("termine is not null and canonico is not null").select(key(F.col("termine")).alias("k"), "canonico").where("k <> ''").groupBy("k").agg(F.min("canonico").alias("c")).orderBy("k").limit(MAX_WORDINGS + 1).collect()
    if len(known) > MAX_WORDINGS:
        raise ValueError(f"more than {MAX_WORDINGS} wordings")
    p = phrases.where(F.col(column).isNotNull()).select(column).distinct().withColumn("__k", key(F.col(column)))
    none = F.lit(None).cast("string")
    if not known:
        return p.select(column, none.alias("canonico"), none.alias("modo"))
    k = F.col("__k")
    words = F.array(*(F.struct(F.lit(r["k"]).alias("k"), F.lit(r["c"]).alias("c")) for r in known))
    near = F.filter(F.transform(words, lambda t: F.struct(F.levenshtein(k, t["k"]).alias("d"), t["c"].alias("c"), allowed(F.length(t["k"])).alias("m"))), lambda t: t["d"] <= t["m"])
    p = p.withColumn("__e", F.get(F.transform(F.filter(words, lambda t: t["k"] == k), lambda t: t["c"]), 0)).withColumn("__n", F.when(F.col("__e").isNull(), near))
    closest = F.array_distinct(F.transform(F.filter("__n", lambda t: t["d"] == F.array_min(F.transform("__n", lambda x: x["d"]))), lambda t: t["c"]))
    inside = F.filter(words, lambda t: (F.length(t["k"]) >= LEAST_CONTAINED) & F.concat(F.lit(" "), k, F.lit(" ")).contains(F.concat(F.lit(" "), t["k"], F.lit(" "))))
    longest = F.get(F.transform(F.array_sort(F.transform(inside, lambda t: F.struct((-F.length(t["k"])).alias("l"), t["k"].alias("k"), t["c"].alias("c")))), lambda t: t["c"]), 0)
    p = p.withColumn("__u", F.when(F.size(closest) == 1, F.get(closest, 0))).withColumn("__i", F.when(F.col("__e").isNull() & F.col("__u").isNull(), longest))
    mode = F.when(F.col("__e").isNotNull(), "esatto").when(F.col("__u").isNotNull(), "vicino").when(F.col("__i").isNotNull(), "contenuto")
    return p.select(column, F.coalesce("__e", "__u", "__i").alias("canonico"), mode.alias("modo"))


def direction(canonico: Column) -> Column:
    """(rel, inversa) of one of the ten relations; nulls for any other name."""
    name = F.create_map([F.lit(x) for k, (v, _) in RELATIONS.items() for x in (k, v)])
    swap = F.create_map([F.lit(x) for k, (_, v) in RELATIONS.items() for x in (k, v)])
    return F.struct(F.try_element_at(name, canonico).alias("rel"), F.try_element_at(swap, canonico).alias("inversa"))
