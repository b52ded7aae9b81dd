"""Queries of surfaces, volumes, vocabulary, recipes, raw sheets and state over the archive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import geometry, graph, relational, sheets, state, surfaces, vocabulary
from ..operators.spatial import located
from ..session import table
from . import recipe
from .geometry_queries import plans
from .graph_queries import MEANING, NORMAL, normal, typed, wordings
from .relational_queries import LEVELS, UNITS, levels, units

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _model(spark, d, columns):
    p = relational.first_rows(table(spark, d, "us_poligoni").where("anelli is not null and us is not null").select("us", "riga", "tipo", "anelli"), "us", "riga")
    p = p.select(F.col("us").alias("unita"), F.when(F.lower(F.trim("tipo")) == "negativa", "negativa").otherwise("deposito").alias("classe"), "anelli")
    return surfaces.reconstruct(p, located(levels(spark, d), "sito", "x", "y"), columns=columns)


@query()
def n05_unit_volumes(spark, d):
    """Surfaces by kriging, triangulated plans, tops and bottoms, volumes of all units with plan and levels."""
    m = _model(spark, d, surfaces.MEASURED)
    return m.select("unita", "classe", "strategia", "punti", F.round("area", 2).alias("area"), F.round("volume", 3).alias("volume"))


@query()
def f02_volumes_by_strategy(spark, d):
    """the same volumes from the faces in the engine, by strategy."""
    v = geometry.prism_volumes(_model(spark, d, surfaces.PACKED), "strategia")
    return v.groupBy("strategia").agg(F.count(F.lit(1)).alias("unita"), F.round(F.sum("area"), 1).alias("area"), F.round(F.sum("volume"), 1).alias("volume"))


@query(f"""
WITH {LEVELS}, f AS (SELECT us, arg_min(lower(trim(tipo, ' ')), riga) AS tipo FROM us_poligoni WHERE us IS NOT NULL GROUP BY us),
q AS (SELECT unita, count(*) AS n, bool_or(tipo IN ('sup', 'taglio', 'rasatura', 'orlo')) AS m FROM levels WHERE unita IS NOT NULL GROUP BY unita),
a AS (SELECT us, max(area_m2) AS a FROM us_poligoni WHERE area_m2 > 0 AND area_m2 < 500 GROUP BY us)
SELECT f.us AS unita, CASE WHEN q.m THEN 'misurata' WHEN f.tipo = 'negativa' AND a.a IS NOT NULL THEN 'profondita' WHEN a.a IS NOT NULL THEN 'impilata' WHEN q.n > 0 THEN 'schematica' ELSE 'nessuna' END AS strategia
FROM f LEFT JOIN q ON q.unita = f.us LEFT JOIN a ON a.us = f.us""")
def n07_strategies(spark, d):
    u = table(spark, d, "us_poligoni").where("us is not null")
    f = u.groupBy("us").agg(F.min_by(F.lower(F.trim("tipo")), F.when(F.col("tipo").isNotNull(), F.col("riga"))).alias("tipo"))
    q = levels(spark, d).where("unita is not null").groupBy("unita").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("tipo").isin("sup", "taglio", "rasatura", "orlo")).alias("m"))
    a = u.where("area_m2 > 0 and area_m2 < 500").groupBy(F.col("us").alias("ua")).agg(F.max("area_m2").alias("a"))
    j = f.join(q, F.col("us") == F.col("unita"), "left").drop("unita").join(a, F.col("us") == F.col("ua"), "left")
    s = F.when(F.col("m"), "misurata").when((F.col("tipo") == "negativa") & F.col("a").isNotNull(), "profondita").when(F.col("a").isNotNull(), "impilata").when(F.col("n") > 0, "schematica").otherwise("nessuna")
    return j.select(F.col("us").alias("unita"), s.alias("strategia"))


@query(f"""
WITH {UNITS}, {NORMAL}, {LEVELS}, e AS (SELECT a AS u FROM edges UNION SELECT b FROM edges UNION SELECT a FROM pairs UNION SELECT b FROM pairs)
SELECT 'avviso' AS livello, 'sconosciuta' AS codice, count(*) AS unita FROM e WHERE u NOT IN (SELECT unita FROM units)
UNION ALL SELECT 'info', 'isolata', count(*) FROM units WHERE unita NOT IN (SELECT u FROM e)
UNION ALL SELECT 'avviso', 'senza pianta', count(*) FROM units WHERE genere = 'US' AND unita NOT IN (SELECT us FROM us_poligoni WHERE anelli IS NOT NULL AND us IS NOT NULL)
UNION ALL SELECT 'avviso', 'senza quote', count(*) FROM units WHERE unita NOT IN (SELECT unita FROM levels WHERE unita IS NOT NULL)
UNION ALL SELECT 'errore', 'contraddizione', count(*) FROM pairs WHERE (a, b) IN (SELECT least(a, b), greatest(a, b) FROM edges)""")
def n16_readiness(spark, d):
    """How many units stand in the way of a model, by reason."""
    edges, pairs = normal(spark, d)
    us = units(spark, d)
    ends = edges.select(F.explode(F.array("a", "b")).alias("unita")).unionByName(pairs.select(F.explode(F.array("a", "b")).alias("unita"))).distinct()
    planned = table(spark, d, "us_poligoni").where("anelli is not null").select(F.col("us").alias("unita"))
    row = lambda lv, code, df: df.agg(F.lit(lv).alias("livello"), F.lit(code).alias("codice"), F.count(F.lit(1)).alias("unita"))
    return (
        row("avviso", "sconosciuta", ends.join(us, "unita", "left_anti"))
        .unionByName(row("info", "isolata", us.join(ends, "unita", "left_anti")))
        .unionByName(row("avviso", "senza pianta", us.where("genere = 'US'").join(planned, "unita", "left_anti")))
        .unionByName(row("avviso", "senza quote", us.join(levels(spark, d).select("unita"), "unita", "left_anti")))
        .unionByName(row("errore", "contraddizione", graph.contradictions(edges, pairs)))
    )


# Vocabulary and recipes


@query()
def k12_concepts_of_columns(spark, d):
    """The concept of each column name of the archive tables."""
    names = [c for t in ("us_poligoni", "usm", "quote_rilevate", "relations", "finds") for c in table(spark, d, t).columns]
    df = spark.createDataFrame([(n.replace("_", " "),) for n in names], "nome string")
    return vocabulary.recognise_names(df, "nome")


@query()
def m09_proposed_recipe(spark, d):
    """The recipe proposed for the archive, one row an entry."""
    r = recipe.propose({t: table(spark, d, t).drop("anelli") for t in ("us_poligoni", "finds")})
    rows = [("records", "", r.records), ("unit", "", r.unit), *(("column", k, v) for k, v in sorted(r.columns.items())), *(("linked", k, v) for k, v in sorted(r.linked.items()))]
    return spark.createDataFrame(rows, "parte string, nome string, valore string")


_REL = recipe.Recipe(records="us_poligoni", unit="us", columns={"definizione": "definizione", "fase": "fase"}, relations={"sheet": "relations", "a": "context", "rel": "relation", "b": "related_context"}, linked={"finds": "context"})


@query("SELECT us AS unita, nullif(trim(definizione, ' '), '') AS definizione, nullif(trim(fase::VARCHAR), '') AS fase FROM us_poligoni WHERE us IS NOT NULL")
def m12_applied_units(spark, d):
    s = {t: table(spark, d, t) for t in ("us_poligoni", "relations", "finds")}
    return recipe.apply(_REL, s)["us"]


@query(f"WITH {NORMAL} SELECT DISTINCT a, rel, b FROM t WHERE a IN (SELECT us FROM us_poligoni) AND b IN (SELECT us FROM us_poligoni)")
def m04_applied_relations(spark, d):
    s = {t: table(spark, d, t) for t in ("us_poligoni", "relations", "finds")}
    return recipe.apply(_REL, s, wordings(spark, d))["relazioni"].select("a", "rel", "b")


@query("SELECT riga, context AS unita FROM finds WHERE context IN (SELECT us FROM us_poligoni)")
def m05_applied_finds(spark, d):
    s = {t: table(spark, d, t) for t in ("us_poligoni", "relations", "finds")}
    return recipe.apply(_REL, s)["finds"].select("riga", "unita")


# Raw sheets


def _cells(spark, d):
    """The records of each archive as cells of a sheet."""
    q = table(spark, d, "contextdata_righe")
    from pyspark.sql.window import Window

    q = q.withColumn("r", F.row_number().over(Window.partitionBy("archivio").orderBy("riga")))
    f = F.posexplode(F.expr("split(regexp_replace(testo, '[\\\\x22\\n]', ''), concat('\\\\Q', sep, '\\\\E'))"))
    return q.select(F.col("archivio").alias("foglio"), F.col("r").alias("riga"), f.alias("c", "valore")).select("foglio", "riga", (F.col("c") + 1).alias("colonna"), "valore")


@query("""
WITH q AS (SELECT archivio AS foglio, row_number() OVER (PARTITION BY archivio ORDER BY riga) AS riga, str_split(regexp_replace(testo, '["\n]', '', 'g'), sep) AS v FROM contextdata_righe),
c AS (SELECT foglio, riga, unnest(v) AS v, unnest(range(1, len(v) + 1)) AS colonna FROM q)
SELECT foglio, riga, CAST(colonna AS INT) AS colonna, trim(v, ' ') AS valore FROM c WHERE trim(v, ' ') <> ''""")
def l01_cells(spark, d):
    return sheets.grid(_cells(spark, d)).select("foglio", F.col("riga").cast("bigint").alias("riga"), "colonna", "valore")


@query()
def l08_tidy_records(spark, d):
    """Headers found, rows that are no records dropped, cells under their column names."""
    return sheets.records(_cells(spark, d))


@query()
def l08_report(spark, d):
    return sheets.report(_cells(spark, d))


# State


_LOG = "log AS (SELECT riga AS seq, context AS unita, material AS campo, object_name AS valore FROM finds WHERE context IS NOT NULL AND material IS NOT NULL)"


@query(f"WITH {_LOG} SELECT unita, campo, valore FROM log QUALIFY row_number() OVER (PARTITION BY unita, campo ORDER BY seq DESC) = 1")
def o01_latest_edits(spark, d):
    log = table(spark, d, "finds").where("context is not null and material is not null").select(F.col("riga").alias("seq"), F.col("context").alias("unita"), F.col("material").alias("campo"), F.col("object_name").alias("valore"))
    return state.latest_edits(log)


@query(f"WITH {NORMAL}, c AS (SELECT rel AS canonico, relation AS grezzo, count(*) AS n FROM t JOIN relations r ON t.riga = r.riga GROUP BY 1, 2) SELECT canonico, grezzo FROM c QUALIFY row_number() OVER (PARTITION BY canonico ORDER BY n DESC, grezzo) = 1")
def o04_inverse_values(spark, d):
    t = graph.resolve(typed(spark, d).where("a is not null and b is not null and a <> b"), wordings(spark, d)).select(F.col("phrase").alias("grezzo"), F.col("r.rel").alias("canonico"))
    return state.inverse_values(t)


@query("SELECT 100 AS fattore")
def o04_unit_factor(spark, d):
    u = table(spark, d, "usm").where("lunghezza_m between 0.01 and 1000")
    return state.unit_factor(u.select((F.col("lunghezza_m") * 100).alias("raw"), F.col("lunghezza_m").alias("proj")))


@query("SELECT us AS unita, max(area_m2) AS area FROM us_poligoni WHERE us IS NOT NULL AND us % 5 <> 0 GROUP BY us UNION ALL SELECT us, -1.0 FROM us_poligoni WHERE us IS NOT NULL AND us % 5 = 0 GROUP BY us")
def o05_partial_rebuild(spark, d):
    u = table(spark, d, "us_poligoni").where("us is not null").groupBy(F.col("us").alias("unita")).agg(F.max("area_m2").alias("area"))
    return state.partial(u, u.where("unita % 5 = 0").select("unita", F.lit(-1.0).alias("area")), "unita")


@query("SELECT 'us_poligoni' AS tabella, count(*) AS righe FROM us_poligoni UNION ALL SELECT 'usm', count(*) FROM usm UNION ALL SELECT 'quote_rilevate', count(*) FROM quote_rilevate UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'finds', count(*) FROM finds")
def o06_project_summary(spark, d):
    out = None
    for t in ("us_poligoni", "usm", "quote_rilevate", "relations", "finds"):
        r = table(spark, d, t).agg(F.lit(t).alias("tabella"), F.count(F.lit(1)).alias("righe"))
        out = r if out is None else out.unionByName(r)
    return out


# Outputs


@query()
def b04_phase_plans(spark, d):
    """Drawings of all plans, one a phase and site."""
    from ..sources import sinks

    p = plans(spark, d).join(table(spark, d, "us_poligoni").select("riga", F.concat_ws("/", "sito", F.col("fase").cast("string")).alias("fase")), "riga")
    return sinks.svg_lines(p.select(F.col("riga").alias("unita"), "fase", F.lit(None).cast("string").alias("colore"), "anelli"))


@query()
def b06_payload(spark, d):
    from ..sources import sinks

    return sinks.payload(plans(spark, d).select(F.col("riga").alias("unita"), "anelli"))

