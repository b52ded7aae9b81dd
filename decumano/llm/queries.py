"""Queries of the problems tagged llm, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical as canonical_values
from . import encoding, leakage, mixing

#: table, column, part of the reference list
FREE_FIELDS = [
    ("relations", "relation", "relation"),
    ("us_poligoni", "definizione", "definizione"),
    ("us_poligoni", "tipo", "tipo"),
    ("usm", "definizione", "definizione"),
    ("quote_rilevate", "tipo", "tipo_quota"),
]


# 6. Canonical values


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for t, c, lista in FREE_FIELDS:
        one = table(spark, d, t).select(F.lit(t).alias("tabella"), F.lit(c).alias("campo"), "riga", F.lit(lista).alias("lista"), F.col(c).alias("valore"))
        rows = one if rows is None else rows.unionByName(one)
    voci = table(spark, d, "voci")
    terms = table(spark, d, "voci_termini").join(voci.select("voce", "campo"), "voce").select("campo", "voce", "termine")
    terms = terms.unionByName(voci.select("campo", "voce", F.col("canonico").alias("termine")))
    return canonical_values.canonical(rows, voci.select(F.col("campo").alias("lista"), "canonico"), terms)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows by field and entry, 0 for those that none fits."""
    return p6_found(spark, d).groupBy("tabella", "campo", "voce").agg(F.count(F.lit(1)).alias("righe"))


# 7. Leaked test items


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "test_items"), doc="doc_id", item="item_id", text="text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each test item that leaked: in how many documents, and its longest leaked run of words."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documenti"), F.max("parole").alias("parole_max"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with leaked spans removed, and documents that are mostly leaked dropped."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return leakage.remove_leaks(docs, table(spark, d, "test_items"), item="item_id", text="text")


_NORM = "replace(lower(strip_accents(nfc_normalize({0}))), 'ß', 'ss')"
_WINDOWS = r"""
SELECT {key}, array_to_string(w[i:i + 11], ' ') AS g
FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i
      FROM (SELECT {key}, regexp_extract_all({norm}, '[\pL\pN]+') AS w FROM {table} WHERE text IS NOT NULL))"""
P7_SQL = (
    "WITH d AS (" + _WINDOWS.format(key="doc_id", norm=_NORM.format("text"), table="documents") + "),\n"
    "t AS (" + _WINDOWS.format(key="item_id", norm=_NORM.format("text"), table="test_items") + ")\n"
    "SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (g)"
)

#: Longest run: consecutive places in document and item on one diagonal, each of twelve words.
P7_ITEMS_SQL = (
    "WITH d AS (" + _WINDOWS.format(key="doc_id", norm=_NORM.format("text"), table="documents").replace("AS g", "AS g, i") + "),\n"
    "t AS (" + _WINDOWS.format(key="item_id", norm=_NORM.format("text"), table="test_items").replace("AS g", "AS g, i") + "),\n"
    "m AS (SELECT doc_id, item_id, d.i AS i, d.i - t.i AS diagonale FROM d JOIN t USING (g)),\n"
    "r AS (SELECT doc_id, item_id, diagonale, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonale ORDER BY i) AS isola FROM m),\n"
    "l AS (SELECT doc_id, item_id, count(*) + 11 AS parole FROM r GROUP BY doc_id, item_id, diagonale, isola)\n"
    "SELECT item_id, count(DISTINCT doc_id) AS documenti, max(parole) AS parole_max FROM l GROUP BY item_id"
)


# 8. Source mix


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), doc="doc_id", source="source", text="text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


# 9. Wrong encoding


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"), doc="doc_id", text="text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("doc_id", "esito")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("doc_id", "esito", F.concat_ws(", ", "coppie").alias("coppie"), "testo")


QUERIES = {
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p7_clean": p7_clean,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
SQL = {
    "p7_found": P7_SQL,
    "p7_items": P7_ITEMS_SQL,
}
