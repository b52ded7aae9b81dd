"""Queries of the graph operators, over the archive's relations, contemporary units and cycles contracted where an operator needs it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def typed(spark, d):
    return table(spark, d, "relations").select("riga", F.col("context").alias("a"), F.col("relation").alias("phrase"), F.col("related_context").alias("b"))


def wordings(spark, d):
    """The wordings of the archive's reference list: (termine, canonico)."""
    v = table(spark, d, "voci").where("campo = 'relation'")
    t = table(spark, d, "voci_termini").join(v, "voce").select("termine", "canonico")
    return t.unionByName(v.select(F.col("canonico").alias("termine"), "canonico")).distinct()


def _key(c):
    return f"trim(regexp_replace(replace(regexp_replace(translate(lower({c}), 'àáâãäåèéêëìíîïòóôõöùúûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '\\s+', ' ', 'g'), '’', chr(39)), '[^\\pL' || chr(39) || ']+', ' ', 'g'), ' ')"


#: ph(relation, canonico): what each phrase means, from voci and voci_termini; then the ten relations and their direction.
MEANING = f"""wt AS MATERIALIZED (SELECT k, min(canonico) AS c FROM (
    SELECT {_key('termine')} AS k, canonico FROM voci_termini JOIN voci USING (voce) WHERE campo = 'relation'
    UNION ALL SELECT {_key('canonico')}, canonico FROM voci WHERE campo = 'relation') WHERE k <> '' GROUP BY k),
kp AS MATERIALIZED (SELECT DISTINCT relation, {_key('relation')} AS k FROM relations WHERE relation IS NOT NULL),
kx AS (SELECT relation, c FROM kp JOIN wt USING (k)),
kd AS (SELECT relation, c, levenshtein(kp.k, wt.k) AS d, CASE WHEN length(wt.k) < 4 THEN 0 WHEN length(wt.k) <= 6 THEN 1 WHEN length(wt.k) <= 10 THEN 2 ELSE 3 END AS m FROM kp, wt WHERE relation NOT IN (SELECT relation FROM kx)),
kn AS (SELECT relation, min(c) AS c FROM (SELECT relation, c FROM kd WHERE d <= m QUALIFY d = min(d) OVER (PARTITION BY relation)) GROUP BY relation HAVING count(DISTINCT c) = 1),
ki AS (SELECT relation, arg_min(c, (-length(wt.k), wt.k)) AS c FROM kp, wt WHERE length(wt.k) >= 5 AND contains(' ' || kp.k || ' ', ' ' || wt.k || ' ')
  AND relation NOT IN (SELECT relation FROM kx) AND relation NOT IN (SELECT relation FROM kn) GROUP BY relation),
ph AS MATERIALIZED (SELECT relation, c AS canonico, 'esatto' AS modo FROM kx UNION ALL SELECT relation, c, 'vicino' FROM kn UNION ALL SELECT relation, c, 'contenuto' FROM ki),
dir(canonico, rel, inversa) AS (VALUES ('copre', 'copre', false), ('coperto da', 'copre', true), ('taglia', 'taglia', false), ('tagliato da', 'taglia', true), ('riempie', 'riempie', false),
  ('riempito da', 'riempie', true), ('si appoggia a', 'si appoggia a', false), ('gli si appoggia', 'si appoggia a', true), ('si lega a', 'si lega a', false), ('uguale a', 'uguale a', false))"""
NORMAL = f"""{MEANING},
t AS (SELECT r.riga, rel, CASE WHEN inversa THEN related_context ELSE context END AS a, CASE WHEN inversa THEN context ELSE related_context END AS b
  FROM relations r JOIN ph USING (relation) JOIN dir USING (canonico) WHERE context <> related_context),
edges AS MATERIALIZED (SELECT a, b, arg_max(rel, riga) AS rel FROM t WHERE rel IN ('copre', 'taglia', 'riempie', 'si appoggia a') GROUP BY a, b),
pairs AS MATERIALIZED (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM t WHERE rel IN ('si lega a', 'uguale a'))"""


def normal(spark, d):
    return G.normalise(typed(spark, d), wordings(spark, d))


@query(f"WITH {NORMAL} SELECT a, rel, b FROM edges")
def j01_normalised_edges(spark, d):
    return normal(spark, d)[0]


@query(f"""
WITH RECURSIVE {NORMAL}, n AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
w(nodo, x) AS (SELECT a, a FROM n UNION SELECT w.nodo, n.b FROM w JOIN n ON w.x = n.a)
SELECT nodo, min(x) AS gruppo FROM w GROUP BY nodo""")
def j02_contemporary_groups(spark, d):
    return G.components(normal(spark, d)[1])


_GROUPS = "n AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), w(nodo, x) AS (SELECT a, a FROM n UNION SELECT w.nodo, n.b FROM w JOIN n ON w.x = n.a), g AS (SELECT nodo, min(x) AS gruppo FROM w GROUP BY nodo)"


@query(f"WITH RECURSIVE {NORMAL}, {_GROUPS}, c AS (SELECT coalesce(x.gruppo, e.a) AS a, coalesce(y.gruppo, e.b) AS b FROM edges e LEFT JOIN g x ON e.a = x.nodo LEFT JOIN g y ON e.b = y.nodo) SELECT DISTINCT a, b FROM c WHERE a <> b")
def j03_contracted_edges(spark, d):
    e, p = normal(spark, d)
    return G.contract(e, G.components(p))


@query(f"""
WITH RECURSIVE g AS (SELECT a, b FROM grafo WHERE a <> b UNION SELECT context, related_context FROM relations WHERE principale AND context <> related_context),
w(nodo, x) AS (SELECT a, b FROM g WHERE a IN (SELECT b FROM g) UNION SELECT w.nodo, g.b FROM w JOIN g ON w.x = g.a)
SELECT DISTINCT nodo FROM w WHERE nodo = x""")
def j04_nodes_on_cycles(spark, d):
    g = table(spark, d, "grafo").select("a", "b").unionByName(table(spark, d, "relations").where("principale").select(F.col("context").alias("a"), F.col("related_context").alias("b")))
    return G.strong_components(g.where("a <> b")).select("nodo")


@query(f"WITH {NORMAL} SELECT a, b FROM pairs WHERE (a, b) IN (SELECT least(a, b), greatest(a, b) FROM edges)")
def j05_contradictions(spark, d):
    return G.contradictions(*normal(spark, d))


#: r: all ways in the contracted graph; k: nodes on cycles by the least member; e: the graph without cycles; gg: what each unit became.
CONDENSED = f"""{NORMAL}, {_GROUPS},
c AS MATERIALIZED (SELECT DISTINCT coalesce(x.gruppo, e.a) AS a, coalesce(y.gruppo, e.b) AS b FROM edges e LEFT JOIN g x ON e.a = x.nodo LEFT JOIN g y ON e.b = y.nodo WHERE coalesce(x.gruppo, e.a) <> coalesce(y.gruppo, e.b)),
r(a, b) AS (SELECT a, b FROM c UNION SELECT r.a, c.b FROM r JOIN c ON r.b = c.a),
k AS MATERIALIZED (SELECT x.a AS nodo, least(min(x.b), x.a) AS gruppo FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
e AS MATERIALIZED (SELECT DISTINCT coalesce(x.gruppo, c.a) AS a, coalesce(y.gruppo, c.b) AS b FROM c LEFT JOIN k x ON c.a = x.nodo LEFT JOIN k y ON c.b = y.nodo WHERE coalesce(x.gruppo, c.a) <> coalesce(y.gruppo, c.b)),
gg AS MATERIALIZED (SELECT g.nodo, coalesce(k.gruppo, g.gruppo) AS gruppo FROM g LEFT JOIN k ON g.gruppo = k.nodo UNION ALL SELECT nodo, gruppo FROM k WHERE nodo NOT IN (SELECT nodo FROM g))"""


def condensed(spark, d):
    """(edges, groups) of the archive: contemporary units contracted, then cycles."""
    e, p = normal(spark, d)
    e, g = G.condense(e, p)
    return G.cut(e), G.cut(g)


def grouped(df, groups, column="nodo"):
    """``df`` with the units of ``column`` replaced by what they became."""
    g = groups.select(F.col("nodo").alias("__n"), F.col("gruppo").alias("__g"))
    return df.join(g, F.col(column) == F.col("__n"), "left").withColumn(column, F.coalesce("__g", column)).drop("__n", "__g")


@query(f"WITH RECURSIVE {CONDENSED}, l(nodo, livello) AS (SELECT DISTINCT b, 0 FROM e WHERE b NOT IN (SELECT a FROM e) UNION SELECT e.a, l.livello + 1 FROM l JOIN e ON e.b = l.nodo) SELECT nodo, CAST(max(livello) AS BIGINT) AS livello FROM l GROUP BY nodo")
def j07_levels_from_bottom(spark, d):
    """The levels are also the order of execution."""
    return G.levels(condensed(spark, d)[0])[0]


@query(f"WITH RECURSIVE {CONDENSED}, l(nodo, livello) AS (SELECT DISTINCT a, 0 FROM e WHERE a NOT IN (SELECT b FROM e) UNION SELECT e.b, l.livello + 1 FROM l JOIN e ON e.a = l.nodo) SELECT nodo, CAST(max(livello) AS BIGINT) AS livello FROM l GROUP BY nodo")
def j08_depth_from_top(spark, d):
    return G.levels(G.reverse(condensed(spark, d)[0]))[0]


_CLOSURE = "w2(a, b) AS (SELECT a, b FROM e UNION SELECT w2.a, e.b FROM w2 JOIN e ON w2.b = e.a)"


@query(f"WITH RECURSIVE {CONDENSED}, {_CLOSURE} SELECT DISTINCT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN w2 ON w2.a = x.b WHERE x.a = e.a AND x.b <> e.b AND w2.b = e.b)")
def j09_transitive_reduction(spark, d):
    return G.transitive_reduction(condensed(spark, d)[0])


@query(f"""WITH RECURSIVE {CONDENSED}, n2 AS (SELECT DISTINCT coalesce(x.gruppo, f.a) AS a, coalesce(y.gruppo, f.b) AS b FROM grafo f LEFT JOIN gg x ON f.a = x.nodo LEFT JOIN gg y ON f.b = y.nodo),
u2 AS (SELECT a, b FROM e UNION SELECT a, b FROM n2 WHERE a <> b AND a IN (SELECT a FROM e UNION SELECT b FROM e) AND b IN (SELECT a FROM e UNION SELECT b FROM e)),
w3(a, b) AS (SELECT a, b FROM u2 UNION SELECT w3.a, u2.b FROM w3 JOIN u2 ON w3.b = u2.a)
SELECT a, b FROM e UNION SELECT a, b FROM u2 WHERE NOT EXISTS (SELECT 1 FROM w3 WHERE a = b)""")
def j11_inferred_edges(spark, d):
    """The links of grafo as inferred edges: taken if they bring no cycle."""
    e, g = condensed(spark, d)
    new = grouped(grouped(table(spark, d, "grafo").select("a", "b"), g, "a"), g, "b")
    return G.accept_inferred(e, new, e.select(F.explode(F.array("a", "b")).alias("nodo")).distinct())


@query(f"WITH RECURSIVE {CONDENSED} SELECT a, b FROM e")
def j12_condensed_sequence(spark, d):
    """The archive's sequence with contemporary units and cycles contracted: no cycle is left."""
    return condensed(spark, d)[0]


@query()
def j12_condensed(spark, d):
    """The archive's links (grafo and the principal rows) with contemporary units and cycles contracted: no cycle is left."""
    g = table(spark, d, "grafo").select("a", "b").unionByName(table(spark, d, "relations").where("principale").select(F.col("context").alias("a"), F.col("related_context").alias("b")))
    return G.condense(g.where("a <> b").distinct(), G.normalise(typed(spark, d))[1])[0]


@query(f"""
WITH RECURSIVE {NORMAL}, m AS (SELECT DISTINCT usm AS nodo FROM usm WHERE usm IS NOT NULL),
n AS (SELECT a, b FROM pairs WHERE a IN (SELECT nodo FROM m) AND b IN (SELECT nodo FROM m) UNION SELECT b, a FROM pairs WHERE a IN (SELECT nodo FROM m) AND b IN (SELECT nodo FROM m)),
w(nodo, x) AS (SELECT a, a FROM n UNION SELECT w.nodo, n.b FROM w JOIN n ON w.x = n.a), g AS (SELECT nodo, min(x) AS gruppo FROM w GROUP BY nodo),
mg AS (SELECT m.nodo, coalesce(g.gruppo, m.nodo) AS gruppo FROM m LEFT JOIN g ON m.nodo = g.nodo),
c AS MATERIALIZED (SELECT DISTINCT coalesce(x.gruppo, e.a) AS a, coalesce(y.gruppo, e.b) AS b FROM edges e LEFT JOIN g x ON e.a = x.nodo LEFT JOIN g y ON e.b = y.nodo WHERE coalesce(x.gruppo, e.a) <> coalesce(y.gruppo, e.b)),
r(a, b) AS (SELECT a, b FROM c UNION SELECT r.a, c.b FROM r JOIN c ON r.b = c.a),
v AS MATERIALIZED (SELECT a, b FROM r WHERE a IN (SELECT gruppo FROM mg) AND b IN (SELECT gruppo FROM mg)),
k AS MATERIALIZED (SELECT x.a AS nodo, least(min(x.b), x.a) AS k FROM v x JOIN v y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
h AS (SELECT DISTINCT coalesce(k.k, mg.gruppo) AS k FROM mg LEFT JOIN k ON mg.gruppo = k.nodo),
vv AS MATERIALIZED (SELECT DISTINCT coalesce(x.k, v.a) AS a, coalesce(y.k, v.b) AS b FROM v LEFT JOIN k x ON v.a = x.nodo LEFT JOIN k y ON v.b = y.nodo WHERE coalesce(x.k, v.a) <> coalesce(y.k, v.b)),
l(k, fase) AS (SELECT k, 0 FROM h WHERE k NOT IN (SELECT a FROM vv) UNION SELECT vv.a, l.fase + 1 FROM l JOIN vv ON vv.b = l.k)
SELECT mg.nodo, mg.gruppo, CAST(f.fase AS BIGINT) AS fase FROM mg LEFT JOIN k ON mg.gruppo = k.nodo JOIN (SELECT k, max(fase) AS fase FROM l GROUP BY k) f ON f.k = coalesce(k.k, mg.gruppo)""")
def j13_wall_phases(spark, d):
    """Phases of the masonry units, by the relations of all units."""
    return G.wall_phases(*normal(spark, d), table(spark, d, "usm").where("usm is not null").select(F.col("usm").alias("nodo")))


_DAY = "date_diff('day', DATE '1970-01-01', CAST(rilevato AT TIME ZONE 'UTC' AS DATE))"


@query(f"""
WITH RECURSIVE {CONDENSED}, {_CLOSURE}, s AS (SELECT DISTINCT coalesce(gg.gruppo, q.us) AS nodo, CAST({_DAY} AS BIGINT) AS giorno FROM quote_rilevate q LEFT JOIN gg ON q.us = gg.nodo WHERE us IS NOT NULL AND rilevato IS NOT NULL),
o AS (SELECT nodo, min(giorno) AS primo, max(giorno) AS ultimo, count(DISTINCT giorno) AS n FROM s GROUP BY nodo),
u AS (SELECT a AS nodo FROM e UNION SELECT b FROM e UNION SELECT nodo FROM o),
m AS (SELECT w2.a AS nodo, min(o.primo) AS sotto FROM w2 JOIN o ON w2.b = o.nodo GROUP BY w2.a),
mu AS (SELECT DISTINCT coalesce(gg.gruppo, usm) AS nodo FROM usm LEFT JOIN gg ON usm = gg.nodo WHERE usm IS NOT NULL)
SELECT u.nodo, CASE WHEN n >= 2 THEN ultimo WHEN sotto IS NOT NULL THEN greatest(sotto, coalesce(ultimo, 0)) END AS giorno, coalesce(n, 0) < 2 AS stimato
FROM u LEFT JOIN o ON u.nodo = o.nodo LEFT JOIN m ON u.nodo = m.nodo WHERE u.nodo NOT IN (SELECT nodo FROM mu)""")
def j14_chronology(spark, d):
    """The day by which each unit (or what it was contracted to) was removed, from all dated levels."""
    e, g = condensed(spark, d)
    days = table(spark, d, "quote_rilevate").where("us is not null and rilevato is not null").select(F.col("us").alias("nodo"), F.datediff(F.to_date("rilevato"), F.lit("1970-01-01")).cast("bigint").alias("giorno")).distinct()
    walls = grouped(table(spark, d, "usm").where("usm is not null").select(F.col("usm").alias("nodo")), g).distinct()
    return G.chronology(e, grouped(days, g), walls)


@query(f"""
WITH RECURSIVE {CONDENSED}, x2(nodo) AS (SELECT coalesce(gg.gruppo, us) FROM us_poligoni LEFT JOIN gg ON us = gg.nodo WHERE us IS NOT NULL AND eliminato IS NOT NULL UNION SELECT e.a FROM x2 JOIN e ON e.b = x2.nodo)
SELECT nodo FROM x2""")
def j15_affected_units(spark, d):
    """What a change of the deleted units touches: they and all above them."""
    e, g = condensed(spark, d)
    gone = table(spark, d, "us_poligoni").where("us is not null and eliminato is not null").select(F.col("us").alias("nodo"))
    return G.reach(e, grouped(gone, g))


@query(f"""
WITH RECURSIVE {CONDENSED}, z AS (SELECT us, max(z) - min(z) AS t FROM quote_rilevate WHERE us IS NOT NULL AND z BETWEEN -90 AND 9000 GROUP BY us),
s AS (SELECT coalesce(gg.gruppo, us) AS nodo, max(CASE WHEN t > 0 AND t < 5 THEN round(t, 3) ELSE 0.1 END) AS t FROM z LEFT JOIN gg ON us = gg.nodo GROUP BY 1),
al AS (SELECT a AS nodo FROM e UNION SELECT b FROM e UNION SELECT nodo FROM s),
q(nodo, quota) AS (SELECT nodo, 0.0::DOUBLE FROM al WHERE nodo NOT IN (SELECT b FROM e) UNION SELECT e.b, round(q.quota + coalesce(s.t, 0), 6) FROM q LEFT JOIN s ON q.nodo = s.nodo JOIN e ON e.a = q.nodo)
SELECT nodo, round(max(quota), 3) AS quota FROM q GROUP BY nodo""")
def j17_layer_depths(spark, d):
    """Depth below the surface, the thickness of a unit being the range of its heights (10 cm where that says nothing)."""
    e, g = condensed(spark, d)
    z = table(spark, d, "quote_rilevate").where("us is not null and z between -90 and 9000").groupBy(F.col("us").alias("nodo")).agg((F.max("z") - F.min("z")).alias("t"))
    t = grouped(z, g).groupBy("nodo").agg(F.max(F.when((F.col("t") > 0) & (F.col("t") < 5), F.round("t", 3)).otherwise(0.1)).alias("spessore"))
    return G.layer_depths(e, t).select("nodo", F.round("quota", 3).alias("quota"))


@query(f"WITH RECURSIVE {NORMAL}, {_GROUPS}, c AS (SELECT gruppo, count(*) AS membri FROM g GROUP BY gruppo) SELECT gruppo, membri, row_number() OVER (ORDER BY membri DESC, gruppo) AS posto FROM c")
def j10_component_order(spark, d):
    return G.component_sizes(G.components(normal(spark, d)[1]))


@query(f"WITH {NORMAL}, u AS (SELECT min(a) AS u FROM edges) SELECT a, rel, b FROM edges, u WHERE a = u OR b = u")
def j18_relations_of_a_unit(spark, d):
    e, _ = normal(spark, d)
    u = e.agg(F.min("a")).first()[0]
    return e.where((F.col("a") == u) | (F.col("b") == u)).select("a", "rel", "b")
