"""Queries of the spatial operators, with SQL in plain arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import geometry as G
from ..operators import relational as R
from ..operators import spatial
from ..session import table
from .archive import P2_SQL, p2
from .relational_queries import LEVELS, levels

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VERT = "v AS (SELECT riga, us, sito, anello, vertice, p.x AS x, p.y AS y, n FROM (SELECT riga, us, sito, anello, unnest(r) AS p, unnest(range(1, len(r) + 1)) AS vertice, len(r) AS n FROM (SELECT riga, us, sito, unnest(anelli) AS r, unnest(range(1, len(anelli) + 1)) AS anello FROM us_poligoni WHERE anelli IS NOT NULL)))"
EDGES = VERT + ", e AS (SELECT a.riga, a.us, a.sito, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM v a JOIN v b ON a.riga = b.riga AND a.anello = b.anello AND b.vertice = a.vertice % a.n + 1)"


def plans(spark, d):
    return table(spark, d, "us_poligoni").where("anelli is not null").select("riga", "us", "sito", "anelli")


@query(f"SELECT a AS riga, min(b) AS us FROM ({P2_SQL}) WHERE caso = 'dentro' GROUP BY a HAVING count(*) = 1")
def e07_unit_of_level(spark, d):
    """Levels without unit get the one unit whose plan contains them, if it is the only one."""
    hit = p2(spark, d, ("dentro",))
    return hit.groupBy(F.col("a").alias("riga")).agg(F.min("b").alias("us"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query(f"SELECT b AS us, min(a) AS primo, count(*) AS quote FROM ({P2_SQL}) WHERE caso = 'dentro' GROUP BY b")
def e08_first_label(spark, d):
    hit = p2(spark, d, ("dentro",))
    return hit.groupBy(F.col("b").alias("us")).agg(F.min("a").alias("primo"), F.count(F.lit(1)).alias("quote"))


@query(f"WITH {EDGES} SELECT riga, round(abs(sum(ax * yb - bx * ay)) / 2, 3) AS area, round(sum(sqrt(pow(bx - ax, 2) + pow(yb - ay, 2))), 3) AS perimetro FROM (SELECT e.riga, ax - floor(x0) AS ax, ay - floor(y0) AS ay, bx - floor(x0) AS bx, yb - floor(y0) AS yb FROM e JOIN (SELECT riga, min(x) AS x0, min(y) AS y0 FROM v GROUP BY riga) o ON e.riga = o.riga) GROUP BY riga")
def f03_plan_areas(spark, d):
    b = G.bounds(plans(spark, d), "anelli").select("riga", F.floor("x0").alias("x0"), F.floor("y0").alias("y0"), F.explode(G.edges(F.col("anelli"))).alias("k"))
    c = lambda n: F.col(f"k.{n}") - F.col("x0" if n.endswith("x") else "y0")
    g = b.groupBy("riga").agg(F.sum(c("ax") * c("by") - c("bx") * c("ay")).alias("s"), F.sum(F.sqrt(F.pow(c("bx") - c("ax"), 2) + F.pow(c("by") - c("ay"), 2))).alias("p"))
    return g.select("riga", F.round(F.abs("s") / 2, 3).alias("area"), F.round("p", 3).alias("perimetro"))


@query(f"""
WITH {LEVELS}, {VERT}, c AS (SELECT riga AS id, sito, avg(x) AS x, avg(y) AS y FROM v GROUP BY riga, sito),
p AS (SELECT riga, sito, x, y, z FROM levels WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0)),
k AS (SELECT c.id, p.riga, p.z, sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)) AS d FROM c JOIN p ON c.sito = p.sito QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)), p.riga) <= 12)
SELECT id, round(sum(z / (d * d + 4)) / sum(1 / (d * d + 4)), 3) AS z, round(min(d), 4) AS d_min, count(*) AS n FROM k GROUP BY id""")
def e18_heights_by_distance(spark, d):
    """Height at the middle of each plan, from the 12 nearest levels of its site, however far, or all it has."""
    v = plans(spark, d).select(F.col("riga").alias("id"), F.col("sito").alias("space"), F.explode(F.flatten("anelli")).alias("p"))
    t = v.groupBy("id", "space").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    p = spatial.located(levels(spark, d), "sito", "x", "y").withColumnRenamed("sito", "space")
    return G.idw(G.nearest_of_all(t, p, 12, 2.0)).select("id", F.round("z", 3).alias("z"), F.round("d_min", 4).alias("d_min"), "n")


@query(f"""
WITH {LEVELS}, p AS (SELECT riga, sito, x, y, z, CAST(floor(x / 15) AS BIGINT) AS gx, CAST(floor(y / 15) AS BIGINT) AS gy FROM levels WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0)),
o AS (SELECT i, j FROM range(-1, 2) AS t(i), range(-1, 2) AS u(j)), t AS (SELECT p.riga, p.sito, p.x, p.y, p.z, gx + i AS gx, gy + j AS gy FROM p, o),
n AS (SELECT t.riga, t.z, q.z AS nz, row_number() OVER (PARTITION BY t.riga ORDER BY (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y), q.riga) AS k
  FROM t JOIN p q ON t.sito = q.sito AND t.gx = q.gx AND t.gy = q.gy WHERE t.riga <> q.riga AND (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) <= 225),
k AS (SELECT riga, z, nz, median(nz) OVER (PARTITION BY riga) AS m FROM n WHERE k <= 12)
SELECT riga, count(*) AS vicini, round(any_value(m), 4) AS mediana FROM k GROUP BY riga HAVING count(*) >= 4 AND any_value(z) < any_value(m) - greatest(0.10, median(abs(nz - m)) * 3 * 1.4826)""")
def d06_low_outliers(spark, d):
    """Levels lower than the 12 nearest within 15 m allow."""
    st = spatial.local_statistics(levels(spark, d), 15.0, 12, key="riga", space="sito", x="x", y="y", z="z")
    return spatial.low_outliers(st).select(F.col("a").alias("riga"), "vicini", F.round("mediana", 4).alias("mediana"))


@query(f"WITH {VERT}, s AS (SELECT riga, anello, vertice, x, y, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS s FROM v WINDOW w AS (PARTITION BY riga, anello ORDER BY vertice)), g AS (SELECT riga, anello, sum(s) AS l, sqrt(pow(arg_min(x, vertice) - arg_max(x, vertice), 2) + pow(arg_min(y, vertice) - arg_max(y, vertice), 2)) AS c FROM s GROUP BY riga, anello) SELECT riga, anello, round(c, 4) AS corda, c >= l * 0.97 AS dritta FROM g")
def d09_straight_lines(spark, d):
    v = R.vertices(plans(spark, d), "riga", "anelli")
    return G.straight_lines(v, ["riga", "anello"], "vertice", "x", "y").select("riga", "anello", F.round("corda", 4).alias("corda"), "dritta")


@query("SELECT sito, count(*) AS piante, round(median(area_m2), 3) AS mediana, count(*) >= 3 AND median(area_m2) < 1 AS pietra_per_pietra FROM us_poligoni WHERE anelli IS NOT NULL AND area_m2 > 0 GROUP BY sito")
def d10_stone_by_stone(spark, d):
    g = table(spark, d, "us_poligoni").where("anelli is not null and area_m2 > 0").groupBy("sito").agg(F.count(F.lit(1)).alias("piante"), F.median("area_m2").alias("m"))
    return g.select("sito", "piante", F.round("m", 3).alias("mediana"), ((F.col("piante") >= 3) & (F.col("m") < 1)).alias("pietra_per_pietra"))


@query(f"WITH {LEVELS}, {VERT}, b AS (SELECT sito, min(x) - 5 AS x0, min(y) - 5 AS y0, max(x) + 5 AS x1, max(y) + 5 AS y1 FROM v GROUP BY sito), m AS (SELECT sito, unita, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM levels WHERE unita IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2) SELECT m.sito, unita FROM m JOIN b ON m.sito = b.sito WHERE m.c < x0 OR m.a > x1 OR m.d < y0 OR m.b > y1")
def d08_outside_extent(spark, d):
    """Units whose levels lie wholly outside the plans of their site by more than 5 m."""
    b = G.bounds(plans(spark, d), "anelli").groupBy(F.col("sito").alias("s")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    m = levels(spark, d).where("unita is not null and x is not null and y is not null").groupBy("sito", "unita").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    return m.join(b, m.sito == b.s).where("c < x0 - 5 or a > x1 + 5 or d < y0 - 5 or b > y1 + 5").select("sito", "unita")


@query(f"WITH {VERT}, b AS (SELECT riga, sito, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY riga, sito), m AS (SELECT sito, avg(y0 + y1) / 2 AS y FROM b GROUP BY sito) SELECT b.riga FROM b JOIN m ON b.sito = m.sito WHERE y0 <= y AND y1 >= y")
def e19_plans_on_a_trace(spark, d):
    """Plans whose box meets the east-west line through the middle of their site."""
    b = G.bounds(plans(spark, d), "anelli").select("riga", "sito", "y0", "y1")
    m = b.groupBy(F.col("sito").alias("s")).agg((F.avg(F.col("y0") + F.col("y1")) / 2).alias("y"))
    return b.join(m, b.sito == m.s).where("y0 <= y and y1 >= y").select("riga")


@query(f"""
WITH {EDGES}, b AS (SELECT riga, min(y) AS y0, max(y) AS y1 FROM v GROUP BY riga)
SELECT e.riga, round(ax + ((y0 + y1) / 2 - ay) / (yb - ay) * (bx - ax) + 1e-6, 4) AS x FROM e JOIN b ON e.riga = b.riga WHERE (ay > (y0 + y1) / 2) <> (yb > (y0 + y1) / 2)""")
def n13_section_cuts(spark, d):
    """Where the east-west line through the middle of each plan cuts its outline."""
    b = G.bounds(plans(spark, d), "anelli")
    return G.section_cut(b, "riga", "anelli", (F.col("y0") + F.col("y1")) / 2).select("riga", F.round(F.col("x") + 1e-6, 4).alias("x"))


@query(f"""
WITH {VERT}, s AS (SELECT riga, anello, vertice, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY riga, anello ORDER BY vertice)),
l AS (SELECT *, coalesce(sqrt(pow(nx - x, 2) + pow(ny - y, 2)), 0) AS l FROM s), a AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY riga, anello ORDER BY vertice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l),
k AS (SELECT *, unnest(range(CAST(ceil(a / 0.2) AS BIGINT), CAST(ceil((a + l) / 0.2) AS BIGINT))) AS k FROM a WHERE l > 0)
SELECT riga, anello, count(*) AS punti, round(sum(x + (k * 0.2 - a) / l * (nx - x)) / count(*), 2) AS x_medio FROM k GROUP BY riga, anello""")
def n14_densified_outlines(spark, d):
    v = R.vertices(plans(spark, d), "riga", "anelli")
    p = G.densify(v, ["riga", "anello"], "vertice", "x", "y", 0.2)
    return p.groupBy("riga", "anello").agg(F.count(F.lit(1)).alias("punti"), F.round(F.sum("x") / F.count(F.lit(1)), 2).alias("x_medio"))


@query(f"""
WITH {LEVELS}, {EDGES}, f AS (SELECT us, min(riga) AS riga FROM us_poligoni WHERE anelli IS NOT NULL AND us IS NOT NULL GROUP BY us),
j AS (SELECT l.riga, l.x, l.y, ax, ay, bx, yb, pow(bx - ax, 2) + pow(yb - ay, 2) AS l2 FROM levels l JOIN f ON l.unita = f.us JOIN e ON e.riga = f.riga WHERE l.x IS NOT NULL AND l.y IS NOT NULL),
t AS (SELECT *, CASE WHEN l2 > 0 THEN greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / l2)) ELSE 0 END AS t FROM j),
g AS (SELECT riga, min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (yb - ay), 2))) AS dist,
  sum(CASE WHEN (ay > y) <> (yb > y) AND x < (bx - ax) * (y - ay) / (yb - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS dentro FROM t GROUP BY riga)
SELECT riga, round(dist, 3) AS distanza FROM g WHERE NOT dentro AND dist > 0.3""")
def n15_far_levels(spark, d):
    p = R.first_rows(plans(spark, d).where("us is not null").select("us", "riga", "anelli"), "us", "riga").select(F.col("us").alias("unita"), "anelli")
    return G.far_levels(levels(spark, d).select("riga", "unita", "x", "y"), p).select("riga", F.round("distanza", 3).alias("distanza"))


@query("SELECT riga, round(t * t * (3 - 2 * t), 9) AS y FROM (SELECT riga, greatest(0, least(1, area_m2 / 20)) AS t FROM us_poligoni WHERE area_m2 IS NOT NULL AND NOT isnan(area_m2))")
def k18_smoothstep(spark, d):
    """Plan areas, faded between 0 and 20 square metres."""
    u = table(spark, d, "us_poligoni").where("area_m2 is not null and not isnan(area_m2)")
    return u.select("riga", F.round(S.smoothstep(F.col("area_m2") / 20), 9).alias("y"))
