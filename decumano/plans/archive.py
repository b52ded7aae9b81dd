"""Queries of the general problems over the archive tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import badrows, hierarchy, multivalue, orphans, spatial
from ..session import table

LIST_FIELDS = ["si_lega_a", "si_appoggia_a", "coperta_da"]
CONTEXT_COLUMNS = ["context_number", "context_type", "fill_of", "interpretation", "context_depth", "brief_description"]


# 1. Several values in one field


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.split_values(table(spark, d, "usm"), "riga", LIST_FIELDS)


_LABEL = r'''"(?:[^"]|"")*"|''[^'']*''|“[^”]*”|«[^»]*»|(?:(?i:usm?\.?\s*))?[0-9]+[A-Za-z]?'''
P1_SQL = f"""
WITH f AS (
  SELECT riga, campo, t FROM (
    SELECT riga, 'si_lega_a' AS campo, si_lega_a AS t FROM usm
    UNION ALL SELECT riga, 'si_appoggia_a', si_appoggia_a FROM usm
    UNION ALL SELECT riga, 'coperta_da', coperta_da FROM usm)
  WHERE t IS NOT NULL),
v AS (SELECT riga, campo, regexp_extract_all(t, '{_LABEL}') AS l FROM f),
e AS (SELECT riga, campo, unnest(l) AS m, unnest(range(1, len(l) + 1)) AS posizione FROM v)
SELECT riga, campo, CAST(posizione AS BIGINT) AS posizione,
  CASE WHEN m[1] = '"' THEN trim(replace(m[2:-2], '""', '"'))
       WHEN m[1] IN ('''', '“', '«') THEN trim(m[2:-2]) ELSE trim(m) END AS valore
FROM e"""


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """How often each unit number is named, by field: the split values joined to what they mean."""
    v = p1_found(spark, d).withColumn("unita", F.try_to_number(F.regexp_extract("valore", r"(\d{1,9})", 1), F.lit("999999999")).cast("bigint"))
    return v.where("unita is not null").groupBy("campo", "unita").agg(F.count(F.lit(1)).alias("volte"), F.countDistinct("riga").alias("schede"))


P1_FREQ_SQL = f"""
SELECT campo, unita, count(*) AS volte, count(DISTINCT riga) AS schede FROM (
  SELECT riga, campo, TRY_CAST(regexp_extract(valore, '([0-9]{{1,9}})', 1) AS BIGINT) AS unita FROM ({P1_SQL}))
WHERE unita IS NOT NULL GROUP BY campo, unita"""


# 2. Near points and regions

#: Metres; points of whole millimetres less than this apart lie close together.
NEAR = 0.0505


def p2(spark: SparkSession, d: str, cases: tuple[str, ...]) -> DataFrame:
    q = table(spark, d, "quote_rilevate").withColumn("senza", F.col("us").isNull())
    return spatial.near_and_within(q, table(spark, d, "us_poligoni"), NEAR, key="riga", space="sito", ident="id", x="x", y="y", free="senza", unit="us", rings="anelli", cases=cases)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2(spark, d, ("vicino", "dentro"))


P2_SQL = """
WITH q AS (SELECT riga, id, sito, us, x, y FROM quote_rilevate WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0) AND sito IS NOT NULL),
g AS (SELECT *, CAST(floor(x / 0.051) AS BIGINT) AS gx, CAST(floor(y / 0.051) AS BIGINT) AS gy FROM q),
o AS (SELECT i, j FROM range(-1, 2) AS t(i), range(-1, 2) AS u(j)),
h AS (SELECT g.*, gx + i AS hx, gy + j AS hy FROM g, o),
r AS (SELECT us, sito, rid, unnest(ring) AS p, unnest(list_concat(ring[2:], ring[1:1])) AS n
      FROM (SELECT us, sito, riga AS rid, unnest(anelli) AS ring FROM us_poligoni WHERE anelli IS NOT NULL)),
b AS (SELECT rid, min(p.x) AS x0, max(p.x) AS x1, min(p.y) AS y0, max(p.y) AS y1 FROM r GROUP BY rid),
k AS (SELECT q.riga, q.x, q.y, u.riga AS rid, u.us FROM q JOIN us_poligoni u ON q.sito = u.sito JOIN b ON b.rid = u.riga
      WHERE q.us IS NULL AND q.x BETWEEN x0 AND x1 AND q.y BETWEEN y0 AND y1),
c AS (SELECT k.riga, k.us, k.rid, count(*) AS n FROM k JOIN r ON r.rid = k.rid
      WHERE (r.p.y > k.y) <> (r.n.y > k.y) AND k.x < (r.n.x - r.p.x) * (k.y - r.p.y) / (r.n.y - r.p.y) + r.p.x
      GROUP BY ALL)
SELECT 'vicino' AS caso, a.riga AS a, b.riga AS b FROM h a JOIN g b ON a.sito = b.sito AND a.hx = b.gx AND a.hy = b.gy
WHERE a.riga < b.riga AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 0.0505 * 0.0505
UNION ALL
SELECT DISTINCT 'dentro', riga, us FROM c WHERE n % 2 = 1"""


# 3. Missing references


def _units(spark: SparkSession, d: str) -> DataFrame:
    us = table(spark, d, "us_poligoni").select(F.col("us").alias("num"), "inserito", "eliminato")
    usm = table(spark, d, "usm").select(F.col("usm").alias("num"), "inserito", "eliminato")
    return us.unionByName(usm)


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """All references, one row each, with the unit that holds them (relations: the other end of the row)."""
    r = table(spark, d, "relations")
    both = F.explode(
        F.array(
            F.struct(F.lit("context").alias("campo"), F.col("context").alias("ref"), F.lit(None).cast("bigint").alias("unita")),
            F.struct(F.lit("related_context").alias("campo"), F.col("related_context").alias("ref"), F.when(F.col("principale"), F.col("context")).alias("unita")),
        )
    ).alias("x")
    rel = r.select("riga", "registrato", both.alias("x")).select(F.lit("relations").alias("tabella"), "x.campo", "riga", "x.ref", "x.unita", "registrato")
    f = table(spark, d, "finds").select(F.lit("finds").alias("tabella"), F.lit("context").alias("campo"), "riga", F.col("context").alias("ref"), F.lit(None).cast("bigint").alias("unita"), "registrato")
    return rel.unionByName(f)


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_cascade(_refs(spark, d), _units(spark, d), _links(spark, d).select("figlio", "genitore"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans: level 0 of the whole cascade, which runs down the links until no unit is new."""
    return _cascade(spark, d).where("livello = 0").select("tabella", "campo", "riga", "motivo", "periodo")


P3_SQL = """
WITH u AS (
  SELECT num, min(inserito) AS ins, CASE WHEN count(eliminato) = count(*) THEN max(eliminato) END AS eli
  FROM (SELECT us AS num, inserito, eliminato FROM us_poligoni UNION ALL SELECT usm, inserito, eliminato FROM usm)
  WHERE num IS NOT NULL GROUP BY num),
r AS (
  SELECT 'relations' AS tabella, 'context' AS campo, riga, context AS ref, registrato FROM relations
  UNION ALL SELECT 'relations', 'related_context', riga, related_context, registrato FROM relations
  UNION ALL SELECT 'finds', 'context', riga, context, registrato FROM finds),
m AS (
  SELECT tabella, campo, riga, strftime(registrato AT TIME ZONE 'UTC', '%Y-%m') AS periodo,
    CASE WHEN u.num IS NULL THEN 'mancante' WHEN ins > registrato THEN 'tardiva' WHEN eli <= registrato THEN 'eliminata' END AS motivo
  FROM r LEFT JOIN u ON r.ref = u.num WHERE ref IS NOT NULL)
SELECT tabella, campo, riga, motivo, periodo FROM m WHERE motivo IS NOT NULL"""


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans by table and month: units that hang from an orphan, and what names them."""
    return orphans.orphan_report(_cascade(spark, d))


P3_REPORT_SQL = """
WITH RECURSIVE u AS (
  SELECT num, min(inserito) AS ins, CASE WHEN count(eliminato) = count(*) THEN max(eliminato) END AS eli
  FROM (SELECT us AS num, inserito, eliminato FROM us_poligoni UNION ALL SELECT usm, inserito, eliminato FROM usm)
  WHERE num IS NOT NULL GROUP BY num),
r AS (
  SELECT 'relations' AS tabella, 'context' AS campo, riga, context AS ref, registrato, NULL::BIGINT AS unita FROM relations
  UNION ALL SELECT 'relations', 'related_context', riga, related_context, registrato, CASE WHEN principale THEN context END FROM relations
  UNION ALL SELECT 'finds', 'context', riga, context, registrato, NULL FROM finds),
m AS (
  SELECT r.*, strftime(registrato AT TIME ZONE 'UTC', '%Y-%m') AS periodo,
    CASE WHEN u.num IS NULL THEN 'mancante' WHEN ins > registrato THEN 'tardiva' WHEN eli <= registrato THEN 'eliminata' END AS motivo
  FROM r LEFT JOIN u ON r.ref = u.num WHERE ref IS NOT NULL),
l AS (
  SELECT DISTINCT figlio, genitore FROM (
    SELECT a AS figlio, b AS genitore FROM grafo UNION ALL SELECT context, related_context FROM relations WHERE principale)
  WHERE figlio <> genitore),
t(num, round) AS (
  SELECT DISTINCT unita, 0 FROM m WHERE motivo IS NOT NULL AND unita IS NOT NULL
  UNION
  SELECT l.figlio, t.round + 1 FROM t JOIN l ON l.genitore = t.num WHERE t.round < 400),
f AS (SELECT num, min(round) AS round FROM t GROUP BY num),
c AS (
  SELECT tabella, campo, periodo, motivo, 0 AS livello FROM m WHERE motivo IS NOT NULL
  UNION ALL
  SELECT tabella, campo, periodo, 'ereditata', f.round + 1 FROM m JOIN f ON m.ref = f.num WHERE motivo IS NULL)
SELECT tabella, campo, periodo, motivo, count(*) AS righe, CAST(max(livello) AS BIGINT) AS livello_max
FROM c GROUP BY tabella, campo, periodo, motivo"""


# 4. Hierarchies


def _links(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "grafo").select(F.col("a").alias("figlio"), F.col("b").alias("genitore"))
    r = table(spark, d, "relations").where("principale").select(F.col("context").alias("figlio"), F.col("related_context").alias("genitore"))
    return g.unionByName(r)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return hierarchy.hierarchy(links, links.select(F.col("figlio").alias("nodo")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).withColumnRenamed("nodo", "us")


_TREE_SQL = """
WITH RECURSIVE l AS (
  SELECT a AS figlio, b AS genitore FROM grafo UNION ALL SELECT context, related_context FROM relations WHERE principale),
p AS (SELECT figlio, min(genitore) AS genitore FROM l WHERE figlio <> genitore GROUP BY figlio),
n AS (SELECT figlio AS us FROM l WHERE figlio IS NOT NULL UNION SELECT genitore FROM l WHERE genitore IS NOT NULL),
t(us, radice, profondita, percorso) AS (
  SELECT us, us, 0::BIGINT, us::VARCHAR FROM n WHERE us NOT IN (SELECT figlio FROM p)
  UNION ALL
  SELECT p.figlio, t.radice, t.profondita + 1, t.percorso || '/' || p.figlio FROM t JOIN p ON p.genitore = t.us),
w AS (SELECT p.figlio, p.genitore FROM p WHERE p.figlio NOT IN (SELECT us FROM t)),
k(us, su) AS (
  SELECT figlio, genitore FROM w UNION SELECT k.us, w.genitore FROM k JOIN w ON w.figlio = k.su),
c AS (SELECT us FROM k WHERE us = su)"""
P4_SQL = (
    _TREE_SQL
    + """
SELECT us, radice, profondita, percorso FROM t
UNION ALL
SELECT figlio, -1, -1, CASE WHEN figlio IN (SELECT us FROM c) THEN 'ciclo' ELSE 'verso ciclo' END FROM w"""
)


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_counts(_tree(spark, d)).withColumnRenamed("antenato", "us")


P4_DESC_SQL = (
    _TREE_SQL
    + """,
e AS (SELECT us, profondita, unnest(string_split(percorso, '/')) AS a, unnest(range(0, profondita + 1)) AS i FROM t WHERE profondita > 0)
SELECT CAST(a AS BIGINT) AS us, count(*) AS discendenti, max(profondita - i) AS altezza FROM e WHERE i < profondita GROUP BY a"""
)


# 5. Unparsable rows


def _records(spark: SparkSession, d: str) -> DataFrame:
    return badrows.parse_records(table(spark, d, "contextdata_righe"), "riga", "sep", "testo", CONTEXT_COLUMNS, "Context Number")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.split_records(_records(spark, d), "riga")[1]


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    good = badrows.split_records(_records(spark, d), "riga")[0]
    return good.withColumn("context_number", F.regexp_replace(F.trim("context_number"), r"\.0$", "").cast("bigint"))


_P5 = f"""
WITH r AS (SELECT riga, testo, CASE WHEN sep = '|' THEN '[|]' WHEN sep = chr(9) THEN '\\t' ELSE sep END AS s FROM contextdata_righe),
h AS (SELECT * FROM r WHERE NOT regexp_matches(testo, '^\\s*"?\\s*Context Number\\s*"?\\s*(' || s || '|$)')),
b AS (SELECT *, replace(replace(s, '[', ''), ']', '') AS q FROM h),
w AS (
  SELECT riga, testo, s,
    regexp_full_match(testo, '("([^"]|"")*"|[^"' || q || ']*)(' || s || '("([^"]|"")*"|[^"' || q || ']*))*', 's') AS bene,
    regexp_full_match(testo, '("([^"]|"")*"|[^"' || q || ']*)(' || s || '("([^"]|"")*"|[^"' || q || ']*)){{5}}', 's') AS sei,
    trim(regexp_replace(regexp_extract(testo, '^("([^"]|"")*"|[^"' || q || ']*)', 1, 's'), '^"|"$', '', 'g')) AS primo
  FROM b),
m AS (
  SELECT riga, testo, s, primo,
    CASE WHEN NOT bene THEN 'virgolette' WHEN NOT sei THEN 'colonne'
         WHEN NOT regexp_full_match(primo, '[0-9]{{1,9}}([.]0)?') OR regexp_full_match(primo, '0+([.]0)?') THEN 'valore' END AS motivo
  FROM w)"""
P5_SQL = _P5 + "\nSELECT riga, motivo FROM m WHERE motivo IS NOT NULL"


def _loaded(sep: str, regex_sep: str) -> str:
    """The six fields of the good records of one separator."""
    own = "\\t" if sep == "\t" else sep
    field = f'("(?:[^"]|"")*"|[^"{own}]*)'
    pattern = "^" + regex_sep.join([field] * 6) + "$"
    cell = lambda c: f"CASE WHEN f.{c} LIKE '\"%' THEN replace(f.{c}[2:-2], '\"\"', '\"') ELSE f.{c} END"
    names = CONTEXT_COLUMNS
    first = f"CAST(regexp_replace(trim({cell(names[0])}), '[.]0$', '') AS BIGINT) AS context_number"
    return f"""SELECT riga, {first}, {", ".join(f"{cell(c)} AS {c}" for c in names[1:])}
FROM (SELECT riga, regexp_extract(testo, '{pattern}', {names!r}, 's') AS f FROM m WHERE motivo IS NULL AND s = '{regex_sep}')"""


P5_LOADED_SQL = _P5 + "\n" + "\nUNION ALL\n".join(_loaded(x, y) for x, y in ((",", ","), (";", ";"), ("|", "[|]"), ("\t", "\\t")))


QUERIES = {
    "p1_found": p1_found,
    "p1_frequencies": p1_frequencies,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_descendants": p4_descendants,
    "p5_found": p5_found,
    "p5_loaded": p5_loaded,
}
SQL = {
    "p1_found": P1_SQL,
    "p1_frequencies": P1_FREQ_SQL,
    "p2_found": P2_SQL,
    "p3_found": P3_SQL,
    "p3_report": P3_REPORT_SQL,
    "p4_found": P4_SQL,
    "p4_descendants": P4_DESC_SQL,
    "p5_found": P5_SQL,
    "p5_loaded": P5_LOADED_SQL,
}
