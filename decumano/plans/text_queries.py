"""Queries of the text and identifier functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import relational as R
from ..session import table
from .graph_queries import MEANING, typed, wordings

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {MEANING} SELECT riga, rel, inversa FROM relations LEFT JOIN ph USING (relation) LEFT JOIN dir USING (canonico) WHERE relation IS NOT NULL")
def k01_relation_phrases(spark, d):
    return G.resolve(typed(spark, d).where("phrase is not null"), wordings(spark, d)).select("riga", "r.rel", "r.inversa")


@query(f"WITH {MEANING} SELECT relation AS frase, count(*) AS righe FROM relations WHERE relation IS NOT NULL AND relation NOT IN (SELECT relation FROM ph) GROUP BY relation")
def k01_not_understood(spark, d):
    return G.unmatched(typed(spark, d), wordings(spark, d)).withColumnRenamed("phrase", "frase")


#: Texts in five languages, with signs, conjunctions and ranges; {a} and {b} are units. What each says: (relation, ends swapped, unit).
_TEXTS = [
    ("Copre {a}, {b}; tagliato da {a}-{a3}.", [("copre", False, "a"), ("copre", False, "b"), *(("taglia", True, f"a + {k}") for k in range(4))]),
    ("Cut by {a} and {b}. Same as {a}; fills {b} (see 2nd page)", [("taglia", True, "a"), ("taglia", True, "b"), ("uguale a", False, "a"), ("riempie", False, "b"), ("riempie", False, "2")]),
    ("recouvre {a} et {b} ; entaillé par {b}, s'appuie contre US {a}b", [("copre", False, "a"), ("copre", False, "b"), ("taglia", True, "b"), ("si appoggia a", False, "a")]),
    ("Schneidet {a}/{b}; verfüllt von {b}, liegt unter {a}", [("taglia", False, "a"), ("taglia", False, "b"), ("riempie", True, "b"), ("copre", True, "a")]),
    ("CUBRE {a} y {b} - cortado por {a}, se le apoya {b}", [("copre", False, "a"), ("copre", False, "b"), ("taglia", True, "a"), ("si appoggia a", True, "b")]),
    ("> {a}, < {b} = {a}; ricopre nulla {b}", [("copre", False, "a"), ("copre", True, "b"), ("uguale a", False, "a"), ("uguale a", False, "b")]),
]


@query("\nUNION ALL ".join(
    f"SELECT riga, '{rel}' AS rel, {str(inv).lower()} AS inversa, CAST({u.replace('a', 'context').replace('b', 'related_context') if u in 'ab' else u.replace('a', 'context')} AS BIGINT) AS unita FROM relations WHERE riga % {len(_TEXTS)} = {i} AND context IS NOT NULL AND related_context IS NOT NULL"
    for i, (_, says) in enumerate(_TEXTS) for rel, inv, u in says
))
def k02_relations_in_text(spark, d):
    t = typed(spark, d).where("a is not null and b is not null")
    parts = {"a": F.col("a").cast("string"), "b": F.col("b").cast("string"), "a3": (F.col("a") + 3).cast("string")}
    text = None
    for i, (template, _) in enumerate(_TEXTS):
        one = F.lit(template)
        for k, c in parts.items():
            one = F.replace(one, F.lit("{" + k + "}"), c)
        text = F.when(F.col("riga") % len(_TEXTS) == i, one) if text is None else text.when(F.col("riga") % len(_TEXTS) == i, one)
    return t.select("riga", F.explode(S.relations_in_text(text)).alias("r")).select("riga", "r.*")


@query("SELECT riga, 'copre' AS rel, false AS inversa, context AS unita FROM relations WHERE context IS NOT NULL UNION ALL SELECT riga, 'riempie', true, related_context FROM relations WHERE context IS NOT NULL AND related_context IS NOT NULL")
def k03_relation_lists(spark, d):
    t = typed(spark, d).where("a is not null").select("riga", F.concat(F.lit("[['Copre', '"), "a", F.lit("'], ['Riempito da', '"), F.coalesce(F.col("b").cast("string"), F.lit("")), F.lit("']]")).alias("t"))
    return t.select("riga", F.explode(S.relation_lists(F.col("t"))).alias("r")).select("riga", "r.*")


_CELL = "nullif(trim(str_split(testo, sep)[1], ' '), '')"


@query(f"""
SELECT riga, trim(regexp_extract(t, '^([^0-9]*)[0-9]', 1), ' ') AS prefisso, TRY_CAST(nullif(regexp_extract(t, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS numero,
  trim(regexp_extract(t, '[0-9]([^0-9]*)$', 1), ' ') AS suffisso, len(regexp_extract_all(t, '[0-9]+')) <> 1 AS ambiguo
FROM (SELECT riga, {_CELL} AS t FROM contextdata_righe) WHERE t IS NOT NULL AND NOT contains(t, chr(10))""")
def k04_identifier_parts(spark, d):
    return _cells(spark, d).select("riga", S.identifier_parts(F.col("t")).alias("p")).select("riga", "p.*")


def _cells(spark, d):
    c = table(spark, d, "contextdata_righe").select("riga", S.blank_to_null(F.expr("split(testo, concat('\\\\Q', sep, '\\\\E'))[0]")).alias("t"))
    return c.where("t is not null and not contains(t, '\n')")


@query(f"""
WITH c AS (SELECT riga, upper(regexp_replace(t, '^([Uu][Ss][Mm]?|[Ss][Uu]|[Cc][Tt][Xx])[ .-]*', '')) AS t FROM (SELECT riga, {_CELL} AS t FROM contextdata_righe) WHERE t IS NOT NULL AND NOT contains(t, chr(10)))
SELECT riga, regexp_extract(t, '^([A-Z]+)', 1) AS classe, CAST(regexp_extract(t, '([0-9]+)$', 1) AS BIGINT) AS numero FROM c WHERE regexp_full_match(t, '[A-Z]{{1,4}}[ .-]?[0-9]{{1,6}}')""")
def k05_class_codes(spark, d):
    return _cells(spark, d).select("riga", S.class_code(F.col("t")).alias("c")).select("riga", "c.*").where("classe is not null")


@query("WITH n AS (SELECT id, count(*) AS n, count(DISTINCT sito) AS s FROM quote_rilevate WHERE id IS NOT NULL GROUP BY id) SELECT riga, sito || '-' || q.id AS codice, n.n > 1 AND n.n = n.s AS composto FROM quote_rilevate q JOIN n ON q.id = n.id WHERE sito IS NOT NULL")
def k06_composite_ids(spark, d):
    """A number that repeats but is unique within its site needs the site in its id."""
    q = table(spark, d, "quote_rilevate").where("id is not null")
    n = q.groupBy(F.col("id").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sito").alias("s"))
    return q.join(n, q.id == n.i).where("sito is not null").select("riga", F.concat_ws("-", "sito", "id").alias("codice"), ((F.col("n") > 1) & (F.col("n") == F.col("s"))).alias("composto"))


@query("SELECT riga, round(lunghezza_m, 4) AS metri FROM usm WHERE lunghezza_m IS NOT NULL AND lunghezza_m BETWEEN 0 AND 9000")
def k07_measures(spark, d):
    """Lengths written as cm, mm or m with comma, read back."""
    u = table(spark, d, "usm").where("lunghezza_m between 0 and 9000")
    v = F.col("lunghezza_m").cast("decimal(12,4)")
    text = F.when(F.col("riga") % 3 == 0, F.concat((v * 100).cast("decimal(14,2)").cast("string"), F.lit("cm"))).when(F.col("riga") % 3 == 1, F.concat(F.replace(v.cast("string"), F.lit("."), F.lit(",")), F.lit(" m"))).otherwise(F.concat((v * 1000).cast("decimal(14,1)").cast("string"), F.lit(" mm.")))
    return u.select("riga", F.round(S.measure(text), 4).alias("metri"))


@query("SELECT riga, list_sort(list_distinct([strftime(rilevato, '%Y-%m-%d'), strftime(registrato, '%Y-%m-%d')])) AS date FROM (SELECT riga, rilevato AT TIME ZONE 'UTC' AS rilevato, registrato AT TIME ZONE 'UTC' AS registrato FROM quote_rilevate) WHERE rilevato IS NOT NULL AND registrato IS NOT NULL")
def k09_dates_in_cells(spark, d):
    q = table(spark, d, "quote_rilevate").where("rilevato is not null and registrato is not null")
    t = F.concat(F.date_format("registrato", "y-M-d"), F.lit("; "), F.date_format("rilevato", "y-MM-dd"), F.lit(", 2024-13-40 e "), F.date_format("rilevato", "y-M-dd"))
    return q.select("riga", S.dates_in(t).alias("date"))


@query("SELECT riga, strftime(rilevato AT TIME ZONE 'UTC', '%Y-%m-%d') AS data FROM quote_rilevate WHERE rilevato IS NOT NULL")
def k10_dates_of_files(spark, d):
    q = table(spark, d, "quote_rilevate").where("rilevato is not null")
    return q.select("riga", S.ddmm_date(F.concat(F.lit("DEM_12_"), F.date_format("rilevato", "ddMM"), F.lit("_b.tif")), F.year("rilevato")).alias("data"))


_MASKED = "text"
for _rx in (r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}", r"1:[0-9]+", r"[0-9]+\s*(?i:dpi|px|ppi)", r"(?i:img|dsc|dscn|foto|photo)[_ -]*[0-9]+", r"(?i:tav|tavola|sheet|fig)[._ -]*[0-9]+"):
    _MASKED = f"regexp_replace({_MASKED}, '{_rx}', '#', 'g')"


@query(f"SELECT doc_id, CAST(length({_MASKED}) - length(replace({_MASKED}, '#', '')) - (length(text) - length(replace(text, '#', ''))) AS BIGINT) AS coperti FROM documents WHERE text IS NOT NULL")
def k17_masked_counts(spark, d):
    """How many dates, scales, resolutions and counters of each document are masked."""
    signs = lambda c: F.length(c) - F.length(F.replace(c, F.lit("#"), F.lit("")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", (signs(S.mask_noise(F.col("text"))) - signs(F.col("text"))).cast("bigint").alias("coperti"))


@query(rf"SELECT doc_id, regexp_extract_all({_MASKED}, '\b([0-9]{{4,7}})\b', 1) AS numeri FROM documents")
def k17_masked_texts(spark, d):
    """Bare numbers that are left once dates, scales and counters are masked."""
    t = S.mask_noise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.regexp_extract_all(t, F.lit(r"\b([0-9]{4,7})\b"), 1).alias("numeri"))


@query("SELECT riga, CASE WHEN definizione LIKE '%muro%' THEN 'muro' WHEN definizione LIKE '%strato%' OR definizione LIKE '%livello%' THEN 'strato' WHEN definizione LIKE '%fossa%' OR definizione LIKE '%buca%' THEN 'taglio' ELSE 'altro' END AS ruolo FROM us_poligoni")
def k15_roles_by_words(spark, d):
    """The first rule whose words occur gives the role."""
    c = F.coalesce(F.col("definizione"), F.lit(""))
    role = F.when(c.contains("muro"), "muro").when(c.rlike("strato|livello"), "strato").when(c.rlike("fossa|buca"), "taglio").otherwise("altro")
    return table(spark, d, "us_poligoni").select("riga", role.alias("ruolo"))


@query("WITH b AS (SELECT sito, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM quote_rilevate WHERE x > 0 AND y > 0 GROUP BY sito HAVING max(x) > min(x) AND max(y) > min(y)) SELECT sito, round(greatest(0, least(x1, (x0 + x1) / 2) - greatest(x0, x0 - 1)) * greatest(0, least(y1, y1 + 1) - greatest(y0, y0)) / ((x1 - x0) * (y1 - y0)), 4) AS quota FROM b")
def k19_overlap_of_boxes(spark, d):
    b = table(spark, d, "quote_rilevate").where("x > 0 and y > 0").groupBy("sito").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).where("x1 > x0 and y1 > y0")
    c = F.col
    return b.select("sito", F.round(S.overlap_share((c("x0") - 1, c("y0"), (c("x0") + c("x1")) / 2, c("y1") + 1), (c("x0"), c("y0"), c("x1"), c("y1"))), 4).alias("quota"))


# Case study: from a register to the canonical layout


@query("SELECT context AS unita, riga FROM finds WHERE context IS NOT NULL QUALIFY row_number() OVER (PARTITION BY context ORDER BY riga) = 1")
def r01_first_row(spark, d):
    return R.first_rows(table(spark, d, "finds").where("context is not null").select(F.col("context").alias("unita"), "riga").withColumn("o", F.col("riga")), "unita", "o").select("unita", "riga")


@query("""
WITH u AS (SELECT us, max(area_m2) AS area, arg_min(definizione, riga) FILTER (definizione IS NOT NULL) AS definizione, count(*) AS parti FROM us_poligoni WHERE us IS NOT NULL AND area_m2 > 0.01 GROUP BY us) SELECT * FROM u""")
def r03_context_union(spark, d):
    u = table(spark, d, "us_poligoni").where("us is not null and area_m2 > 0.01")
    return u.groupBy("us").agg(F.max("area_m2").alias("area"), F.min_by("definizione", F.when(F.col("definizione").isNotNull(), F.col("riga"))).alias("definizione"), F.count(F.lit(1)).alias("parti"))


@query("""
WITH n AS (SELECT DISTINCT us FROM us_poligoni WHERE lower(trim(tipo, ' ')) = 'negativa'), f AS (SELECT context AS us, related_context AS cut FROM relations WHERE relation = 'riempie' AND context <> related_context),
x AS (SELECT DISTINCT f.us FROM f WHERE cut IN (SELECT us FROM n) AND us NOT IN (SELECT us FROM n WHERE us IS NOT NULL))
SELECT u.us, CASE WHEN u.us IN (SELECT us FROM n) THEN 'taglio' WHEN u.us IN (SELECT us FROM x) THEN 'riempimento' ELSE 'deposito' END AS classe FROM (SELECT DISTINCT us FROM us_poligoni WHERE us IS NOT NULL) u""")
def r04_cut_deposit_fill(spark, d):
    u = table(spark, d, "us_poligoni").where("us is not null")
    cuts = u.where(F.lower(F.trim("tipo")) == "negativa").select("us").distinct()
    fills = table(spark, d, "relations").where("relation = 'riempie' and context <> related_context").select(F.col("context").alias("us"), F.col("related_context").alias("c"))
    fills = fills.join(cuts.withColumnRenamed("us", "c"), "c", "left_semi").join(cuts, "us", "left_anti").select("us").distinct()
    return u.select("us").distinct().join(cuts.withColumn("t", F.lit(1)), "us", "left").join(fills.withColumn("r", F.lit(1)), "us", "left").select("us", F.when(F.col("t") == 1, "taglio").when(F.col("r") == 1, "riempimento").otherwise("deposito").alias("classe"))


@query("""
WITH q AS (SELECT us, max(z) - min(z) AS p FROM quote_rilevate WHERE z BETWEEN -90 AND 9000 GROUP BY us), u AS (SELECT us, area_m2, riga FROM us_poligoni)
SELECT u.riga, CASE WHEN q.p > 0 AND q.p < 5 THEN q.p WHEN area_m2 > 0 AND area_m2 < 500 THEN round(area_m2 / 100, 4) END AS valore,
  CASE WHEN q.p > 0 AND q.p < 5 THEN 'quote' WHEN area_m2 > 0 AND area_m2 < 500 THEN 'area' END AS fonte FROM u LEFT JOIN q ON u.us = q.us""")
def r05_value_with_source(spark, d):
    """The first usable value of several sources, with the source it came from."""
    q = table(spark, d, "quote_rilevate").where("z between -90 and 9000").groupBy(F.col("us").alias("u")).agg((F.max("z") - F.min("z")).alias("p"))
    j = table(spark, d, "us_poligoni").select("riga", "us", "area_m2").join(q, F.col("us") == F.col("u"), "left")
    pick = F.coalesce(F.when((F.col("p") > 0) & (F.col("p") < 5), F.struct(F.col("p").alias("valore"), F.lit("quote").alias("fonte"))), F.when((F.col("area_m2") > 0) & (F.col("area_m2") < 500), F.struct(F.round(F.col("area_m2") / 100, 4).alias("valore"), F.lit("area").alias("fonte"))))
    return j.select("riga", pick.alias("s")).select("riga", "s.valore", "s.fonte")


@query("SELECT DISTINCT a, rel, b FROM (SELECT context AS a, 'riempie' AS rel, related_context AS b FROM relations WHERE relation IN ('riempie', 'fills') UNION ALL SELECT a, t, b FROM grafo WHERE t = 'riempie') WHERE a <> b")
def r06_derived_relations(spark, d):
    r = table(spark, d, "relations").where("relation in ('riempie', 'fills')").select(F.col("context").alias("a"), F.lit("riempie").alias("rel"), F.col("related_context").alias("b"))
    return r.unionByName(table(spark, d, "grafo").where("t = 'riempie'").select("a", F.col("t").alias("rel"), "b")).where("a <> b").distinct()


@query("WITH p AS (SELECT DISTINCT fase FROM us_poligoni WHERE fase < 999 AND fase > 0), k AS (SELECT fase, dense_rank() OVER (ORDER BY fase) AS k FROM p) SELECT u.riga, coalesce(k.k, 0) AS fase_n FROM us_poligoni u LEFT JOIN k ON u.fase = k.fase")
def r07_landscape_phases(spark, d):
    from pyspark.sql.window import Window

    u = table(spark, d, "us_poligoni")
    k = u.where("fase < 999 and fase > 0").select(F.col("fase").alias("f")).distinct().withColumn("k", F.dense_rank().over(Window.orderBy("f")).cast("bigint"))
    return u.join(F.broadcast(k), u.fase == k.f, "left").select("riga", F.coalesce("k", F.lit(0)).alias("fase_n"))


@query("""
SELECT context AS unita, material AS materiale, object_name AS oggetto, CAST(nullif(sum(object_count), 0) AS BIGINT) AS pezzi,
  round(nullif(sum(CASE WHEN weight < 99999 THEN weight END), 0), 2) AS peso, array_to_string(list_sort(list(DISTINCT riga))[1:12], ', ') AS righe
FROM finds GROUP BY context, material, object_name""")
def r09_finds_summary(spark, d):
    f = table(spark, d, "finds").withColumn("w", F.when(F.col("weight") < 99999, F.col("weight")))
    g = f.groupBy("context", "material", "object_name").agg(F.sum("object_count").alias("n"), F.sum("w").alias("w"), F.array_sort(F.collect_set("riga")).alias("r"))
    return g.select(F.col("context").alias("unita"), F.col("material").alias("materiale"), F.col("object_name").alias("oggetto"), F.nullif(F.col("n"), F.lit(0)).alias("pezzi"), F.round(F.nullif(F.col("w"), F.lit(0.0)), 2).alias("peso"), F.array_join(F.slice("r", 1, 12).cast("array<string>"), ", ").alias("righe"))


@query("SELECT q.riga, q.id AS campione, q.us AS unita, q.z AS quota FROM quote_rilevate q WHERE q.us IN (SELECT us FROM us_poligoni)")
def r10_samples(spark, d):
    q = table(spark, d, "quote_rilevate").join(table(spark, d, "us_poligoni").select("us"), "us", "left_semi")
    return q.select("riga", F.col("id").alias("campione"), F.col("us").alias("unita"), F.col("z").alias("quota"))


@query("""
WITH a AS (SELECT d.doc_id, d.sito, s.unita FROM documents d LEFT JOIN (SELECT sito AS s, min(us) AS unita FROM us_poligoni GROUP BY sito) s ON d.sito = s.s)
SELECT 'testo' AS genere, doc_id::VARCHAR AS id, unita FROM a UNION ALL SELECT 'quota', id, us FROM quote_rilevate""")
def r11_documentation(spark, d):
    s = table(spark, d, "us_poligoni").groupBy(F.col("sito").alias("s")).agg(F.min("us").alias("unita"))
    a = table(spark, d, "documents").join(s, F.col("sito") == F.col("s"), "left").select(F.lit("testo").alias("genere"), F.col("doc_id").cast("string").alias("id"), "unita")
    return a.unionByName(table(spark, d, "quote_rilevate").select(F.lit("quota").alias("genere"), "id", F.col("us").alias("unita")))


@query("SELECT median(CASE WHEN larghezza_m > 0 AND larghezza_m < 1.5 THEN larghezza_m END) AS mediana FROM usm")
def r12_filtered_median(spark, d):
    return table(spark, d, "usm").agg(F.median(F.when((F.col("larghezza_m") > 0) & (F.col("larghezza_m") < 1.5), F.col("larghezza_m"))).alias("mediana"))
