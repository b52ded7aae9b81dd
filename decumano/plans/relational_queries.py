"""Queries of the relational operators over the archive tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import relational as R
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def units(spark: SparkSession, d: str) -> DataFrame:
    """US and USM as one table, one row a unit: the one entered first in the file."""
    us = table(spark, d, "us_poligoni").select(F.col("us").alias("unita"), "riga", "sito", F.lit("US").alias("genere"), "categoria", "definizione", "fase", "periodo")
    usm = table(spark, d, "usm").select(F.col("usm").alias("unita"), "riga", "sito", F.lit("USM").alias("genere"), "categoria", "definizione", "fase", "periodo")
    return R.first_rows(us.where("unita is not null"), "unita", "riga").unionByName(R.first_rows(usm.where("unita is not null"), "unita", "riga"))


UNITS = """units AS (
  SELECT unita, min(riga) AS riga, arg_min_null(sito, riga) AS sito, genere, arg_min_null(categoria, riga) AS categoria,
    arg_min_null(definizione, riga) AS definizione, arg_min_null(fase, riga) AS fase, arg_min_null(periodo, riga) AS periodo
  FROM (SELECT us AS unita, riga, sito, 'US' AS genere, categoria, definizione, fase, periodo FROM us_poligoni
        UNION ALL SELECT usm, riga, sito, 'USM', categoria, definizione, fase, periodo FROM usm)
  WHERE unita IS NOT NULL GROUP BY unita, genere)"""


def levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels with a usable height: (riga, unita, sito, tipo, x, y, z)."""
    q = table(spark, d, "quote_rilevate").withColumn("z", S.without_sentinels(F.col("z")))
    return q.where("z is not null").select("riga", F.col("us").alias("unita"), "sito", "tipo", "x", "y", "z")


_Z = "z IS NOT NULL AND NOT isnan(z) AND abs(z + 9999) >= 1e-6 AND abs(z + 999) >= 1e-6 AND abs(z + 99.99) >= 1e-6 AND abs(z - 999999) >= 1e-6"
LEVELS = f"levels AS (SELECT riga, us AS unita, sito, tipo, x, y, z FROM quote_rilevate WHERE {_Z})"


# Projection


@query("SELECT context AS us, material AS materiale, object_count AS nr, riga FROM finds")
def c01_alias_rename(spark, d):
    f = table(spark, d, "finds").select("riga", "context", "material", "object_count")
    return R.rename_aliases(f, {"us": ["context", "unit"], "materiale": ["material", "class"], "nr": ["object_count", "count"]})


@query("SELECT riga, coalesce(periodo, categoria) AS Periodo FROM us_poligoni")
def c03_merge_columns(spark, d):
    u = table(spark, d, "us_poligoni").select("riga", F.col("periodo").alias("Periodo"), F.col("categoria").alias("periodo "))
    return R.merge_same_columns(u)


_TYPED = ["us", "tipo", "fase", "area_m2", "ordine", "munsell", "scavata"]


@query(
    "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS colonna, nullif(trim({c}::VARCHAR, ' '), '') AS v FROM us_poligoni" for c in _TYPED) + """),
n AS (SELECT colonna, v, TRY_CAST(v AS DOUBLE) AS f FROM x),
g AS (SELECT colonna, count(v) AS pieni, count(f) AS numerici, count(CASE WHEN f = floor(f) THEN 1 END) AS interi, count(DISTINCT v) AS distinti FROM n GROUP BY colonna)
SELECT *, CASE WHEN pieni = 0 THEN 'vuota' WHEN interi = pieni THEN 'intero' WHEN numerici = pieni THEN 'numero' ELSE 'testo' END AS tipo FROM g"""
)
def c04_column_types(spark, d):
    return R.column_types(table(spark, d, "us_poligoni"), _TYPED)


@query("SELECT riga, TRY_CAST(nullif(regexp_extract(si_lega_a, '([0-9]{1,18})', 1), '') AS BIGINT) AS unita FROM usm WHERE si_lega_a IS NOT NULL")
def c05_unit_numbers(spark, d):
    return table(spark, d, "usm").where("si_lega_a is not null").select("riga", S.unit_number(F.col("si_lega_a")).alias("unita"))


@query("SELECT riga, lunghezza_m AS v FROM usm")
def c06_decimal_comma(spark, d):
    t = table(spark, d, "usm").select("riga", F.replace(F.col("lunghezza_m").cast("string"), F.lit("."), F.lit(",")).alias("t"))
    return t.select("riga", S.number(F.col("t")).alias("v"))


_W = _Z.replace("z", "larghezza_m").replace("isnan", "isnan")


@query(f"""
WITH v AS (SELECT riga, sito, CASE WHEN {_W} THEN larghezza_m END AS v FROM usm),
s AS (SELECT sito, avg(CASE WHEN v IS NOT NULL THEN (v > 5)::INT END) > 0.5 AS cm FROM v GROUP BY sito)
SELECT riga, round(CASE WHEN cm THEN v / 100 ELSE v END, 6) AS larghezza_m FROM v LEFT JOIN s ON v.sito = s.sito""")
def c07_measures(spark, d):
    return R.measures_to_metres(table(spark, d, "usm").select("riga", "sito", "larghezza_m"), "larghezza_m", by=["sito"]).select("riga", F.round("larghezza_m", 6).alias("larghezza_m"))


@query(f"WITH {LEVELS} SELECT sito, CAST(floor(min(x)) AS BIGINT) AS x0, CAST(floor(min(y)) AS BIGINT) AS y0, CAST(floor(min(z - 0.5)) AS BIGINT) AS z0 FROM levels GROUP BY sito")
def c08_local_frames(spark, d):
    return R.local_frame(levels(spark, d), ["sito"])


@query("""
SELECT '{' || array_to_string(list_filter(['"riga":' || riga, '"context":' || context, '"material":' || to_json(material)::VARCHAR, '"object_name":' || to_json(object_name)::VARCHAR,
  '"object_count":' || object_count, '"weight":' || round(weight, 3), '"registrato":"' || strftime(registrato AT TIME ZONE 'UTC', '%d/%m/%Y') || '"'], lambda x: x IS NOT NULL), ',') || '}' AS json FROM finds""")
def c09_json_rows(spark, d):
    return R.json_rows(table(spark, d, "finds"))


@query("""
SELECT riga, anello, vertice, p.x AS x, p.y AS y FROM (
  SELECT riga, anello, unnest(r) AS p, unnest(range(1, len(r) + 1)) AS vertice FROM (
    SELECT riga, unnest(anelli) AS r, unnest(range(1, len(anelli) + 1)) AS anello FROM us_poligoni WHERE anelli IS NOT NULL))""")
def c10_vertices(spark, d):
    return R.vertices(table(spark, d, "us_poligoni"), "riga", "anelli")


def _classes(spark, d):
    us = table(spark, d, "us_poligoni").where("us is not null").groupBy(F.col("us").alias("unita")).agg(F.max(F.when(F.lower("tipo") == "negativa", "negativa")).alias("classe"))
    return us.unionByName(table(spark, d, "usm").where("usm is not null").select(F.col("usm").alias("unita"), F.lit("muraria").alias("classe")).distinct())


@query(f"""
WITH {LEVELS}, k AS (
  SELECT us AS unita, max(CASE WHEN lower(tipo) = 'negativa' THEN 'negativa' END) AS classe FROM us_poligoni WHERE us IS NOT NULL GROUP BY us
  UNION ALL SELECT DISTINCT usm, 'muraria' FROM usm WHERE usm IS NOT NULL)
SELECT l.riga, CASE WHEN classe = 'negativa' AND tipo = 'vertice' THEN 'orlo' WHEN classe = 'negativa' AND tipo IN ('sup', 'inf') THEN 'taglio'
  WHEN classe = 'muraria' AND tipo = 'sup' THEN 'rasatura' WHEN classe = 'muraria' AND tipo = 'inf' THEN 'fondazione' ELSE tipo END AS tipo
FROM levels l LEFT JOIN k ON l.unita = k.unita""")
def c11_level_kinds(spark, d):
    return R.level_kinds(levels(spark, d).select("riga", "unita", "tipo"), _classes(spark, d)).select("riga", "tipo")


@query("""
WITH c AS (SELECT categoria AS c, dense_rank() OVER (ORDER BY categoria) AS r FROM (SELECT DISTINCT categoria FROM usm WHERE categoria IS NOT NULL)),
d AS (SELECT greatest(3, length(max(usm)::VARCHAR)) AS d FROM usm)
SELECT riga, CAST(r * pow(10, d) AS BIGINT) AS base, CAST(r * pow(10, d) AS BIGINT) + usm AS codice FROM usm JOIN c ON usm.categoria = c.c, d""")
def c12_class_ranges(spark, d):
    return R.class_ranges(table(spark, d, "usm").select("riga", "categoria", "usm"), "categoria", "usm").select("riga", "base", "codice")


@query("SELECT riga, regexp_extract_all(lower(object_name), '[a-z]+') AS parole FROM finds WHERE object_name IS NOT NULL")
def c13_name_tokens(spark, d):
    return table(spark, d, "finds").where("object_name is not null").select("riga", F.regexp_extract_all(S.plain(F.col("object_name")), F.lit("([a-z]+)"), 1).alias("parole"))


_PALETTE = ("#7f3b08", "#b35806", "#e08214", "#fdb863", "#b2abd2")


@query(f"""
WITH {UNITS}
SELECT unita, CASE WHEN genere = 'USM' THEN '#8c8c8c' WHEN fase BETWEEN 1 AND 5 THEN ({list(_PALETTE)!r})[fase]
  WHEN fase IS NOT NULL THEN 'hsl(' || (((CAST(floor(fase * 137.508) AS BIGINT) % 360) + 360) % 360) || ',45%,55%)' ELSE '#cccccc' END AS colore FROM units""")
def c14_colours(spark, d):
    return units(spark, d).select("unita", S.unit_colour(F.lit(None).cast("string"), F.col("genere") == "USM", F.col("fase"), _PALETTE).alias("colore"))


# Filters


@query("SELECT riga, fase FROM us_poligoni WHERE fase IN (1, 3)")
def d01_keep_values(spark, d):
    u = table(spark, d, "us_poligoni").select("riga", "fase").withColumn("f", F.col("fase").cast("double"))
    return R.keep_values(u, "F", ["1", "3"]).select("riga", "fase")


@query("SELECT riga, fase FROM us_poligoni WHERE fase IS NULL OR fase NOT IN (1, 3)")
def d01_exclude_values(spark, d):
    return R.keep_values(table(spark, d, "us_poligoni").select("riga", "fase"), "fase", ["1", "3"], exclude=True)


@query(f"SELECT sito, count(*) AS righe, count(CASE WHEN {_Z} THEN 1 END) AS buone FROM quote_rilevate GROUP BY sito")
def d02_sentinels(spark, d):
    q = table(spark, d, "quote_rilevate")
    return q.groupBy("sito").agg(F.count(F.lit(1)).alias("righe"), F.count(S.without_sentinels(F.col("z"))).alias("buone"))


@query(f"WITH {UNITS} SELECT riga, context AS a, related_context AS b FROM relations WHERE context <> related_context AND context IN (SELECT unita FROM units) AND related_context IN (SELECT unita FROM units)")
def d03_clean_relations(spark, d):
    r = table(spark, d, "relations").select("riga", F.col("context").alias("a"), F.col("related_context").alias("b"))
    return R.clean_relations(r, units(spark, d)).select("riga", "a", "b")


@query(f"""
WITH {LEVELS}, r AS (SELECT sito, unnest(anelli) AS ring FROM us_poligoni WHERE anelli IS NOT NULL), v AS (SELECT sito, unnest(ring) AS p FROM r),
e AS (SELECT sito, min(p.x) AS a, min(p.y) AS b, max(p.x) AS c, max(p.y) AS d FROM v GROUP BY sito)
SELECT l.riga FROM levels l LEFT JOIN e ON l.sito = e.sito WHERE a IS NULL OR (l.x BETWEEN a - 20 AND c + 20 AND l.y BETWEEN b - 20 AND d + 20)""")
def d04_crop(spark, d):
    v = R.vertices(table(spark, d, "us_poligoni").where("anelli is not null").select(F.struct("riga", "sito").alias("k"), "anelli"), "k", "anelli")
    plans = v.groupBy("k.sito").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return R.crop(levels(spark, d), plans, ["sito"]).select("riga")


@query(f"WITH {UNITS} SELECT unita FROM units WHERE unita IN (SELECT us FROM us_poligoni WHERE anelli IS NOT NULL)")
def d05_with_plan(spark, d):
    p = table(spark, d, "us_poligoni").where("anelli is not null").select(F.col("us").alias("unita"))
    return units(spark, d).join(p, "unita", "left_semi").select("unita")


@query(f"WITH {UNITS} SELECT unita FROM units WHERE unita NOT IN (SELECT us FROM us_poligoni WHERE anelli IS NOT NULL AND us IS NOT NULL)")
def d05_without_plan(spark, d):
    p = table(spark, d, "us_poligoni").where("anelli is not null").select(F.col("us").alias("unita"))
    return units(spark, d).join(p, "unita", "left_anti").select("unita")


# Joins


@query(f"""
WITH {UNITS}, f AS (SELECT fase::VARCHAR AS k, arg_min_null(periodo, riga) AS titolo FROM us_poligoni WHERE fase IS NOT NULL GROUP BY fase)
SELECT x.riga, u.fase, f.titolo FROM finds x LEFT JOIN units u ON x.context = u.unita LEFT JOIN f ON u.fase::VARCHAR = f.k""")
def e01_lookup_chain(spark, d):
    u = units(spark, d).withColumn("unita", F.col("unita").cast("double"))
    us = table(spark, d, "us_poligoni")
    return R.lookup_chain(table(spark, d, "finds").select("riga", "context"), [(u, "unita", "context", {"fase": "fase"}, "riga"), (us, "fase", "fase", {"periodo": "titolo"}, "riga")]).select("riga", "fase", "titolo")


@query("""
WITH l AS (SELECT us, arg_min(nullif(trim(periodo, ' '), ''), riga) FILTER (nullif(trim(periodo, ' '), '') IS NOT NULL) AS p FROM us_poligoni GROUP BY us)
SELECT u.riga, coalesce(nullif(trim(u.periodo), ''), l.p) AS periodo FROM us_poligoni u LEFT JOIN l ON u.us = l.us""")
def e02_enrich(spark, d):
    u = table(spark, d, "us_poligoni").select("riga", "us", "periodo")
    return R.enrich(u, u, "us", ["periodo"], "riga").select("riga", "periodo")


@query("SELECT DISTINCT usm AS unita FROM usm WHERE usm IS NOT NULL AND usm NOT IN (SELECT us FROM us_poligoni WHERE us IS NOT NULL)")
def e03_masonry_only(spark, d):
    return table(spark, d, "usm").select(F.col("usm").alias("unita")).where("unita is not null").distinct().join(table(spark, d, "us_poligoni").select(F.col("us").alias("unita")), "unita", "left_anti")


@query(f"WITH {UNITS} SELECT riga FROM finds WHERE context IN (SELECT unita FROM units)")
def e04_linked_finds(spark, d):
    return table(spark, d, "finds").join(units(spark, d).select(F.col("unita").alias("context")), "context", "left_semi").select("riga")


def _fills(spark, d):
    return table(spark, d, "relations").where("context is not null and related_context is not null").select("riga", F.col("context").alias("a"), F.col("relation").alias("rel"), F.col("related_context").alias("b"))


@query("""
WITH p AS (SELECT DISTINCT us FROM us_poligoni WHERE anelli IS NOT NULL AND us IS NOT NULL)
SELECT context AS unita, arg_min(related_context, riga) AS da FROM relations
WHERE relation = 'riempie' AND context NOT IN (SELECT us FROM p) AND related_context IN (SELECT us FROM p) GROUP BY context""")
def e05_inherited_plans(spark, d):
    p = table(spark, d, "us_poligoni").where("anelli is not null").select(F.col("us").alias("unita"))
    return R.inherited_plans(_fills(spark, d), p)


@query(f"""
WITH p AS (SELECT DISTINCT us AS unita FROM us_poligoni WHERE us IS NOT NULL AND anelli IS NOT NULL), r AS (SELECT DISTINCT context AS unita FROM finds WHERE context IS NOT NULL)
SELECT coalesce(p.unita, r.unita) AS unita, r.unita IS NOT NULL AS scheda, p.unita IS NOT NULL AS pianta FROM r FULL JOIN p ON r.unita = p.unita""")
def e06_complete(spark, d):
    p = table(spark, d, "us_poligoni").where("anelli is not null and us is not null").select(F.col("us").alias("unita"))
    return R.complete(table(spark, d, "finds").select(F.col("context").alias("unita")), p, "unita")


@query("""
WITH c AS (SELECT DISTINCT lower(trim(material, ' ')) AS m, material AS canonico FROM finds WHERE material = upper(material[1:1]) || lower(material[2:])),
d AS (SELECT m, min(canonico) AS canonico FROM c GROUP BY m)
SELECT riga, d.canonico FROM finds LEFT JOIN d ON lower(trim(material, ' ')) = d.m""")
def e11_normalised_names(spark, d):
    f = table(spark, d, "finds").select("riga", "material")
    tidy = F.concat(F.upper(F.substring("material", 1, 1)), F.lower(F.expr("substring(material, 2)")))
    c = f.where(F.col("material") == tidy).groupBy(F.lower(F.trim("material")).alias("m")).agg(F.min("material").alias("canonico"))
    return f.join(c, F.lower(F.trim("material")) == F.col("m"), "left").select("riga", "canonico")


@query("""
WITH q AS (SELECT riga, id, sito FROM quote_rilevate WHERE id IS NOT NULL),
t AS (SELECT id, sito, min(riga) AS r FROM q GROUP BY id, sito), s AS (SELECT id, min(riga) AS r FROM q GROUP BY id)
SELECT a.riga, CASE WHEN t.r IS NOT NULL THEN 0 WHEN s.r IS NOT NULL THEN 1 END AS tier, coalesce(t.r, s.r) AS primo
FROM (SELECT riga, id, sito FROM q) a LEFT JOIN t ON a.id = t.id AND a.sito = t.sito LEFT JOIN s ON a.id = s.id""")
def e13_tiered_match(spark, d):
    q = table(spark, d, "quote_rilevate").where("id is not null").select("riga", "id", "sito")
    right = q.groupBy(F.col("id").alias("rid"), F.col("sito").alias("rs")).agg(F.min("riga").alias("primo"))
    any_ = right.groupBy("rid").agg(F.min("primo").alias("primo"), F.lit(None).cast("string").alias("rs"))
    tiers = q.join(right, (q.id == right.rid) & (q.sito == right.rs)).select("riga", F.lit(0).alias("tier"), "primo").unionByName(q.join(any_, q.id == any_.rid).select("riga", F.lit(1).alias("tier"), "primo"))
    return tiers.groupBy("riga").agg(F.min_by(F.struct("tier", "primo"), F.struct("tier", "primo")).alias("s")).select("riga", "s.*")


@query("""
WITH e AS (SELECT us, min(CAST(rilevato AS DATE)) AS g FROM quote_rilevate WHERE us IS NOT NULL AND rilevato IS NOT NULL GROUP BY us),
c AS (SELECT q.us, q.riga, (month(q.rilevato) = month(e.g) AND day(q.rilevato) = day(e.g)) AS stesso, q.rilevato FROM quote_rilevate q JOIN e ON q.us = e.us WHERE q.rilevato IS NOT NULL)
SELECT us, riga FROM c QUALIFY row_number() OVER (PARTITION BY us ORDER BY stesso DESC, rilevato, riga) = 1""")
def e15_same_day_first(spark, d):
    q = table(spark, d, "quote_rilevate").where("us is not null and rilevato is not null").select("us", "riga", "rilevato")
    e = q.groupBy(F.col("us").alias("u")).agg(F.min(F.to_date("rilevato")).alias("g"))
    same = (F.month("rilevato") == F.month("g")) & (F.dayofmonth("rilevato") == F.dayofmonth("g"))
    return q.join(e, q.us == e.u).groupBy("us").agg(F.min_by("riga", F.struct((~same).alias("a"), "rilevato", "riga")).alias("riga"))


@query("""
WITH m AS (SELECT context AS unita, md5(string_agg(coalesce(object_count::VARCHAR, ''), '|' ORDER BY riga)) AS f FROM finds WHERE context IS NOT NULL GROUP BY context),
n AS (SELECT context AS unita, md5(string_agg(coalesce(object_count::VARCHAR, ''), '|' ORDER BY riga)) AS f FROM finds WHERE context IS NOT NULL AND material <> 'Pottery' GROUP BY context)
SELECT coalesce(m.unita, n.unita) AS unita, CASE WHEN m.unita IS NULL THEN 'nuova' WHEN n.unita IS NULL THEN 'tolta' ELSE 'cambiata' END AS stato
FROM n FULL JOIN m ON m.unita = n.unita WHERE m.f IS DISTINCT FROM n.f""")
def e16_changed(spark, d):
    f = table(spark, d, "finds").where("context is not null")
    mark = lambda x: R.fingerprints(x, "context", [F.col("riga"), F.col("object_count")])
    return R.changed(mark(f), mark(f.where("material <> 'Pottery'")), "context", "impronta").withColumnRenamed("context", "unita")


_GLOBS = {"*a sacco": "fondazioni", "muro *": "muri", "strato di *": "strati", "*fossa*": "fosse"}


@query("WITH g(k, p) AS (VALUES ('fondazioni', '%a sacco'), ('muri', 'muro %'), ('strati', 'strato di %'), ('fosse', '%fossa%')) SELECT riga, k AS strato FROM us_poligoni JOIN g ON definizione LIKE p")
def e17_glob_match(spark, d):
    u = table(spark, d, "us_poligoni").select("riga", "definizione")
    # A handful of patterns, known on the driver: one expression, not a join.
    hits = F.array_compact(F.array(*(F.when(F.col("definizione").rlike(R.glob_regex(p)), F.lit(k)) for p, k in _GLOBS.items())))
    return u.select("riga", F.explode(hits).alias("strato"))


# Aggregates


@query("SELECT fase, count(*) AS unita, round(sum(area_m2), 2) AS area FROM us_poligoni GROUP BY fase")
def f01_phase_rollup(spark, d):
    u = table(spark, d, "us_poligoni").withColumn("area_m2", F.col("area_m2").cast("decimal(18,4)"))
    return R.phase_rollup(u, "fase", "area_m2").withColumn("area", F.col("area").cast("double"))


@query(f"WITH {LEVELS} SELECT unita, max(z) AS z_max, min(z) AS z_min, round(avg(CASE WHEN tipo = 'rasatura' THEN z END) + 1e-9, 4) AS cresta, count(*) AS quote FROM levels GROUP BY unita")
def f04_level_extrema(spark, d):
    return R.level_extrema(levels(spark, d)).withColumn("cresta", F.round(F.col("cresta") + 1e-9, 4))


@query("SELECT lower(trim(definizione, ' ')) AS gruppo, median(area_m2) AS mediana, count(*) AS n FROM us_poligoni WHERE definizione IS NOT NULL AND area_m2 IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def f06_typical_medians(spark, d):
    return R.typical_medians(table(spark, d, "us_poligoni"), F.lower(F.trim("definizione")), "area_m2")


@query("WITH c AS (SELECT munsell AS valore, count(*) AS n FROM us_poligoni WHERE munsell IS NOT NULL GROUP BY 1) SELECT valore, n, (SELECT count(*) FROM c) AS distinti FROM c ORDER BY n DESC, valore LIMIT 60")
def f07_top_values(spark, d):
    return R.top_values(table(spark, d, "us_poligoni"), "munsell")


@query("SELECT material AS materiale, count(*) AS reperti, count(DISTINCT context) AS unita FROM finds GROUP BY material")
def f09_summary(spark, d):
    return table(spark, d, "finds").groupBy(F.col("material").alias("materiale")).agg(F.count(F.lit(1)).alias("reperti"), F.countDistinct("context").alias("unita"))


_MATERIALS = ("Pottery", "Bone", "Glass", "Iron", "Flint")


@query("SELECT context AS unita, " + ", ".join(f"arg_min(object_count, riga) FILTER (material = '{m}' AND object_count IS NOT NULL) AS {m.lower()}" for m in _MATERIALS) + f" FROM finds WHERE material IN {_MATERIALS} AND object_count IS NOT NULL GROUP BY context")
def f10_pivot(spark, d):
    f = table(spark, d, "finds").where("object_count is not null")
    p = R.pivot_fields(f, "context", "material", "object_count", "riga", _MATERIALS)
    return p.select(F.col("context").alias("unita"), *(F.col(m).alias(m.lower()) for m in _MATERIALS))


@query("SELECT riga, misura, valore FROM (UNPIVOT (SELECT riga, lunghezza_m, larghezza_m FROM usm) ON lunghezza_m, larghezza_m INTO NAME misura VALUE valore) WHERE valore <> 0")
def f11_melt(spark, d):
    return R.melt(table(spark, d, "usm").select("riga", "lunghezza_m", "larghezza_m"), ["riga"], ["lunghezza_m", "larghezza_m"], "misura", "valore")


@query(f"WITH {LEVELS} SELECT sito, CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy, max(z) AS z, count(*) AS n FROM levels WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3")
def f12_highest_in_cell(spark, d):
    p = levels(spark, d).where("x is not null and y is not null")
    return p.groupBy("sito", F.floor(F.col("x") / 0.5).alias("cx"), F.floor(F.col("y") / 0.5).alias("cy")).agg(F.max("z").alias("z"), F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT sito, periodo, count(*) AS n FROM us_poligoni WHERE periodo IS NOT NULL GROUP BY 1, 2) SELECT sito, periodo, n, n >= 0.7 * sum(n) OVER (PARTITION BY sito) AS maggioranza FROM c QUALIFY row_number() OVER (PARTITION BY sito ORDER BY n DESC, periodo) = 1")
def f14_dominant_value(spark, d):
    """the most frequent value of a group, and whether it is the majority (70 %)."""
    c = table(spark, d, "us_poligoni").where("periodo is not null").groupBy("sito", "periodo").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("sito").agg(F.min_by(F.struct("periodo", "n"), F.struct(-F.col("n"), "periodo")).alias("s"), F.sum("n").alias("t"))
    return g.select("sito", "s.periodo", "s.n", (F.col("s.n") >= F.col("t") * 0.7).alias("maggioranza"))


@query("""
WITH l AS (SELECT context, riga::VARCHAR || '|' || coalesce(material, '') AS line FROM finds WHERE context IS NOT NULL),
p AS (SELECT context, md5(line)[1:3] AS part, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY 1, 2)
SELECT context AS unita, sha256(string_agg(h, chr(10) ORDER BY part)) AS impronta FROM p GROUP BY context""")
def f17_fingerprints(spark, d):
    return R.fingerprints(table(spark, d, "finds").where("context is not null"), "context", [F.col("riga"), F.col("material")]).withColumnRenamed("context", "unita")


@query(f"WITH {LEVELS}, g AS (SELECT unita, tipo, z FROM levels WHERE unita IS NOT NULL) SELECT unita, round(median(CASE WHEN tipo = 'sup' THEN z END) - median(CASE WHEN tipo = 'inf' THEN z END), 4) AS salto, count(*) AS n FROM g GROUP BY unita HAVING count(*) >= 10")
def f20_median_lowering(spark, d):
    g = levels(spark, d).where("unita is not null").groupBy("unita").agg(F.round(F.median(F.when(F.col("tipo") == "sup", F.col("z"))) - F.median(F.when(F.col("tipo") == "inf", F.col("z"))), 4).alias("salto"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 10")


@query(f"WITH {LEVELS} SELECT unita, round(quantile_cont(z, 0.05), 6) AS p05, round(quantile_cont(z, 0.95), 6) AS p95 FROM levels WHERE unita IS NOT NULL GROUP BY unita HAVING count(*) >= 5")
def f22_percentiles(spark, d):
    g = levels(spark, d).where("unita is not null").groupBy("unita").agg(F.expr("round(percentile(z, 0.05), 6)").alias("p05"), F.expr("round(percentile(z, 0.95), 6)").alias("p95"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 5").drop("n")


@query(f"WITH {LEVELS} SELECT unita, list_sort(list(DISTINCT tipo)) AS tipi, count(*) AS n, bool_or(tipo IN ('sup', 'taglio', 'rasatura')) AS misurata FROM levels WHERE tipo IS NOT NULL AND unita IS NOT NULL GROUP BY unita")
def f24_level_kind_sets(spark, d):
    """levels and kinds of levels a unit has."""
    g = levels(spark, d).where("tipo is not null and unita is not null").groupBy("unita").agg(F.array_sort(F.collect_set("tipo")).alias("tipi"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("misurata", F.arrays_overlap("tipi", F.array(F.lit("sup"), F.lit("taglio"), F.lit("rasatura"))))


@query("""
WITH x AS (SELECT si_lega_a AS t FROM usm), l AS (SELECT unnest(regexp_extract_all(t, '(?:[Uu][Ss][Mm]?[. ]*)?[0-9]+[A-Za-z]?')) AS s FROM x),
n AS (SELECT CAST(regexp_extract(s, '([0-9]{1,18})', 1) AS BIGINT) AS numero, s FROM l)
SELECT numero, count(DISTINCT s) AS forme FROM n GROUP BY numero HAVING count(DISTINCT s) > 1""")
def f25_ambiguous_ids(spark, d):
    s = table(spark, d, "usm").select(F.explode(F.regexp_extract_all("si_lega_a", F.lit("((?:[Uu][Ss][Mm]?[. ]*)?[0-9]+[A-Za-z]?)"), 1)).alias("s"))
    return s.groupBy(S.unit_number(F.col("s")).alias("numero")).agg(F.countDistinct("s").alias("forme")).where("forme > 1")


@query("""
WITH x AS (SELECT archivio AS campo, str_split(testo, sep)[2] AS v FROM contextdata_righe)
SELECT campo, round(avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT), 4) AS quota FROM (SELECT campo, v FROM x UNION ALL SELECT 'conteggi', object_count::VARCHAR FROM finds UNION ALL SELECT 'misto', CASE WHEN riga % 2 = 0 THEN material ELSE riga::VARCHAR END FROM finds)
WHERE v IS NOT NULL GROUP BY campo HAVING avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT) > 0.2 AND avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT) < 0.8""")
def f26_mixed_fields(spark, d):
    c = table(spark, d, "contextdata_righe").select(F.col("archivio").alias("campo"), F.expr("try_element_at(split(testo, concat('\\\\Q', sep, '\\\\E')), 2)").alias("v"))
    f = table(spark, d, "finds")
    both = c.unionByName(f.select(F.lit("conteggi").alias("campo"), F.col("object_count").cast("string").alias("v"))).unionByName(f.select(F.lit("misto").alias("campo"), F.when(F.col("riga") % 2 == 0, F.col("material")).otherwise(F.col("riga").cast("string")).alias("v")))
    return R.mixed_fields(both, "campo", "v")


@query(f"""
WITH {UNITS}, f AS (SELECT context AS u, count(*) AS n, CAST(sum(object_count) AS BIGINT) AS pezzi FROM finds GROUP BY 1), q AS (SELECT us AS u, count(*) AS n FROM quote_rilevate GROUP BY 1),
r AS (SELECT context AS u, count(*) AS n FROM relations GROUP BY 1),
s AS (SELECT unita::VARCHAR AS unita, coalesce(f.n, 0) AS reperti, coalesce(pezzi, 0) AS pezzi, coalesce(q.n, 0) AS quote, coalesce(r.n, 0) AS rapporti
      FROM units LEFT JOIN f ON f.u = unita LEFT JOIN q ON q.u = unita LEFT JOIN r ON r.u = unita)
SELECT * FROM s UNION ALL SELECT 'TOTALE', sum(reperti)::BIGINT, sum(pezzi)::BIGINT, sum(quote)::BIGINT, sum(rapporti)::BIGINT FROM s""")
def f27_unit_summary(spark, d):
    """Per unit: finds, pieces, levels and relations, with a total row."""
    f = table(spark, d, "finds").groupBy(F.col("context").alias("u1")).agg(F.count(F.lit(1)).alias("reperti"), F.sum("object_count").alias("pezzi"))
    q = table(spark, d, "quote_rilevate").groupBy(F.col("us").alias("u2")).agg(F.count(F.lit(1)).alias("quote"))
    r = table(spark, d, "relations").groupBy(F.col("context").alias("u3")).agg(F.count(F.lit(1)).alias("rapporti"))
    s = units(spark, d).select("unita").join(f, F.col("unita") == F.col("u1"), "left").join(q, F.col("unita") == F.col("u2"), "left").join(r, F.col("unita") == F.col("u3"), "left")
    return R.with_total(s.na.fill(0), "unita", ["reperti", "pezzi", "quote", "rapporti"])


@query(f"WITH {LEVELS} SELECT unita, max(CASE WHEN tipo = 'sup' THEN z END) AS sup_max, min(CASE WHEN tipo = 'inf' THEN z END) AS inf_min, round(avg(CASE WHEN tipo = 'orlo' THEN z END) + 1e-9, 4) AS orlo_medio FROM levels WHERE unita IS NOT NULL GROUP BY unita")
def f28_conditional_extrema(spark, d):
    k = lambda t: F.when(F.col("tipo") == t, F.col("z"))
    return levels(spark, d).where("unita is not null").groupBy("unita").agg(F.max(k("sup")).alias("sup_max"), F.min(k("inf")).alias("inf_min"), F.round(F.avg(k("orlo")) + 1e-9, 4).alias("orlo_medio"))


# Ordered steps


@query("""
WITH k AS (SELECT periodo, fase, min(year(inserito)) AS da, max(year(eliminato)) AS a FROM us_poligoni GROUP BY 1, 2)
SELECT periodo, fase, da, a, row_number() OVER (ORDER BY coalesce(da, a) IS NULL, coalesce(da, a), periodo NULLS FIRST, fase NULLS FIRST) AS fase_n FROM k""")
def g01_phase_numbers(spark, d):
    u = table(spark, d, "us_poligoni").select("periodo", "fase", F.year("inserito").cast("bigint").alias("s"), F.year("eliminato").cast("bigint").alias("e"))
    return R.number_phases(u, "periodo", "fase", "s", "e")


def _fill_rows(spark, d):
    """Units of a site and phase as fills of one cut, their thickness from the area column (a stand-in measure)."""
    return table(spark, d, "us_poligoni").where("sito is not null and fase is not null").select(F.concat_ws("/", "sito", F.col("fase").cast("string")).alias("taglio"), "ordine", F.col("riga").alias("unita"), F.when(S.without_sentinels(F.col("area_m2")).between(0, 500), F.round(F.col("area_m2") / 100, 2)).alias("spessore"))


_FILLS = "f AS (SELECT sito || '/' || fase AS taglio, ordine, riga AS unita, CASE WHEN area_m2 BETWEEN 0 AND 500 THEN round(area_m2 / 100, 2) END AS spessore FROM us_poligoni WHERE sito IS NOT NULL AND fase IS NOT NULL)"


@query(f"WITH {_FILLS} SELECT unita, round(50 - least(coalesce(sum(spessore) OVER (PARTITION BY taglio ORDER BY ordine NULLS FIRST, unita ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1.97), 4) AS tetto FROM f")
def g02_tops_in_cut(spark, d):
    return R.tops_in_cut(_fill_rows(spark, d), F.lit(50.0), F.lit(2.0)).select("unita", F.round("tetto", 4).alias("tetto"))


@query(f"""
WITH {_FILLS}, s AS (SELECT *, sum(spessore) OVER w AS k, count(*) FILTER (spessore IS NULL) OVER w AS m FROM f WINDOW w AS (PARTITION BY taglio)),
t AS (SELECT *, coalesce(spessore, greatest((2.0 - coalesce(k, 0)) / m, 0.05)) AS t FROM s)
SELECT unita, round(CASE WHEN sum(t) OVER (PARTITION BY taglio) > 2.1 THEN t * 2.0 / sum(t) OVER (PARTITION BY taglio) ELSE t END, 4) AS spessore_stimato FROM t""")
def g03_shared_thickness(spark, d):
    return R.shared_thickness(_fill_rows(spark, d), F.lit(2.0)).select("unita", F.round("spessore_stimato", 4).alias("spessore_stimato"))


@query("""
WITH q AS (SELECT us, CAST(rilevato AS DATE) AS g FROM quote_rilevate WHERE rilevato IS NOT NULL), k AS (SELECT g, dense_rank() OVER (ORDER BY g) - 1 AS k FROM (SELECT DISTINCT g FROM q)),
p AS (SELECT us, min(g) AS a, max(g) AS b FROM q WHERE us IS NOT NULL GROUP BY us)
SELECT us, a::VARCHAR AS primo, b::VARCHAR AS ultimo, x.k AS k_primo, y.k AS k_ultimo FROM p JOIN k x ON p.a = x.g JOIN k y ON p.b = y.g""")
def g05_survey_days(spark, d):
    """G05 and K21."""
    return R.survey_days(table(spark, d, "quote_rilevate"), "us", "rilevato")


@query("SELECT us, riga FROM us_poligoni WHERE us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY us ORDER BY area_m2 DESC NULLS LAST, riga) = 1")
def g06_best_candidate(spark, d):
    return table(spark, d, "us_poligoni").where("us is not null").groupBy("us").agg(F.min_by("riga", F.struct(F.col("area_m2").isNull(), -F.col("area_m2"), "riga")).alias("riga"))


@query(f"WITH {LEVELS} SELECT l.unita, arg_min(l.z, {{'t': q.rilevato, 'r': q.riga}}) AS z_prima, arg_max(l.z, {{'t': q.rilevato, 'r': q.riga}}) AS z_ultima FROM levels l JOIN quote_rilevate q ON l.riga = q.riga WHERE q.rilevato IS NOT NULL AND l.unita IS NOT NULL GROUP BY l.unita")
def g08_first_last_level(spark, d):
    q = table(spark, d, "quote_rilevate").withColumn("z", S.without_sentinels(F.col("z"))).where("z is not null and us is not null and rilevato is not null")
    return q.groupBy(F.col("us").alias("unita")).agg(F.min_by("z", F.struct("rilevato", "riga")).alias("z_prima"), F.max_by("z", F.struct("rilevato", "riga")).alias("z_ultima"))


@query("""
WITH b AS (SELECT riga, coalesce(nullif(trim(ambiente, ' '), ''), 'Vano ' || row_number() OVER (PARTITION BY nullif(trim(ambiente, ' '), '') IS NOT NULL ORDER BY riga)) AS b FROM us_poligoni),
k AS (SELECT riga, b, row_number() OVER (PARTITION BY b ORDER BY riga) AS k FROM b)
SELECT riga, CASE WHEN k = 1 THEN b ELSE b || ' (' || k || ')' END AS etichetta FROM k""")
def g09_unique_labels(spark, d):
    return R.unique_labels(table(spark, d, "us_poligoni").select("riga", "ambiente"), "ambiente", "riga", "Vano").select("riga", "etichetta")


@query("WITH c AS (SELECT us, year(rilevato) AS anno, count(*) AS n FROM quote_rilevate WHERE us IS NOT NULL AND rilevato IS NOT NULL GROUP BY 1, 2) SELECT us, CAST(anno AS INT) AS anno FROM c QUALIFY row_number() OVER (PARTITION BY us ORDER BY n DESC, anno) = 1")
def g10_modal_year(spark, d):
    return R.imputed_year(table(spark, d, "quote_rilevate"), "us", "rilevato")


@query("""
WITH v AS (SELECT riga, anello, vertice, p.x AS x, p.y AS y FROM (SELECT riga, anello, unnest(r) AS p, unnest(range(1, len(r) + 1)) AS vertice FROM (SELECT riga, unnest(anelli) AS r, unnest(range(1, len(anelli) + 1)) AS anello FROM us_poligoni WHERE anelli IS NOT NULL))),
s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS s FROM v WINDOW w AS (PARTITION BY riga, anello ORDER BY vertice))
SELECT riga, anello, vertice, round(sum(s) OVER (PARTITION BY riga, anello ORDER BY vertice ROWS UNBOUNDED PRECEDING), 4) AS arco FROM s""")
def g11_arc_length(spark, d):
    v = R.vertices(table(spark, d, "us_poligoni"), "riga", "anelli")
    return R.arc_length(v, ["riga", "anello"], "vertice", "x", "y").select("riga", "anello", "vertice", F.round("arco", 4).alias("arco"))


# Sort, limit, sets


@query("SELECT riga, area_m2 FROM us_poligoni WHERE area_m2 IS NOT NULL ORDER BY area_m2 DESC, riga LIMIT 60")
def h02_top_k(spark, d):
    return table(spark, d, "us_poligoni").where("area_m2 is not null").select("riga", "area_m2").orderBy(F.desc("area_m2"), "riga").limit(60)


@query("WITH n AS (SELECT riga, row_number() OVER (PARTITION BY sito ORDER BY riga) - 1 AS i, count(*) OVER (PARTITION BY sito) AS c FROM us_poligoni) SELECT riga FROM n WHERE i % greatest(1, c // 3) = 0")
def h03_every_nth(spark, d):
    w = Window.partitionBy("sito")
    n = table(spark, d, "us_poligoni").select("riga", (F.row_number().over(w.orderBy("riga")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("c"))
    return n.where("i % greatest(1, c div 3) = 0").select("riga")


@query("SELECT us AS unita, sito FROM us_poligoni UNION ALL SELECT usm, sito FROM usm")
def i01_append(spark, d):
    a = table(spark, d, "us_poligoni").select(F.col("us").alias("unita"), "sito")
    return a.unionByName(table(spark, d, "usm").select(F.col("usm").alias("unita"), "sito"))


@query("SELECT DISTINCT context AS a, relation AS rel, related_context AS b FROM relations")
def i02_distinct_relations(spark, d):
    return table(spark, d, "relations").select(F.col("context").alias("a"), F.col("relation").alias("rel"), F.col("related_context").alias("b")).distinct()


@query(f"""
WITH {UNITS}, e AS (SELECT context AS u FROM relations WHERE context IS NOT NULL UNION SELECT related_context FROM relations WHERE related_context IS NOT NULL)
SELECT u AS unita, 'sconosciuta' AS caso FROM e WHERE u NOT IN (SELECT unita FROM units)
UNION ALL SELECT unita, 'isolata' FROM units WHERE unita NOT IN (SELECT u FROM e)""")
def i03_unit_differences(spark, d):
    """Units that only relations know, and units without relations."""
    r = table(spark, d, "relations")
    e = r.select(F.explode(F.array("context", "related_context")).alias("unita")).where("unita is not null").distinct()
    u = units(spark, d).select("unita")
    return e.join(u, "unita", "left_anti").withColumn("caso", F.lit("sconosciuta")).unionByName(u.join(e, "unita", "left_anti").withColumn("caso", F.lit("isolata")))


@query(f"WITH {UNITS}, c AS (SELECT DISTINCT context AS u FROM finds WHERE context IS NOT NULL) SELECT 'finds' AS tabella, round(count(unita) / count(*), 4) AS quota FROM c LEFT JOIN (SELECT DISTINCT unita FROM units) ON u = unita")
def i04_set_overlap(spark, d):
    c = table(spark, d, "finds").where("context is not null").select(F.col("context").alias("u")).distinct()
    u = units(spark, d).select("unita").distinct()
    return c.join(u, F.col("u") == F.col("unita"), "left").agg(F.lit("finds").alias("tabella"), F.round(F.count("unita") / F.count(F.lit(1)), 4).alias("quota"))


@query("WITH x AS (SELECT context AS unita, 0 AS fonte, riga FROM finds UNION ALL SELECT us, 1, riga FROM quote_rilevate) SELECT unita, fonte, riga FROM x WHERE unita IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unita ORDER BY fonte, riga) = 1")
def i05_first_writer(spark, d):
    x = table(spark, d, "finds").select(F.col("context").alias("unita"), F.lit(0).alias("fonte"), "riga").unionByName(table(spark, d, "quote_rilevate").select(F.col("us").alias("unita"), F.lit(1).alias("fonte"), "riga"))
    return x.where("unita is not null").groupBy("unita").agg(F.min(F.struct("fonte", "riga")).alias("s")).select("unita", "s.*")
