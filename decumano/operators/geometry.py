"""Plan geometry in column expressions: edges, areas, distances, sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .skew import skew_left_join

#: Bits of a vertex number in a packed face.
BITS = 21


def edges(rings: Column) -> Column:
    """All edges of a plan as (ax, ay, bx, by), each ring closed."""
    def of(ring: Column) -> Column:
        nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.zip_with(ring, nxt, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))

    return F.flatten(F.transform(rings, of))


def signed_area(e: Column) -> Column:
    return F.aggregate(e, F.lit(0.0), lambda s, k: s + (k["ax"] * k["by"] - k["bx"] * k["ay"]) / 2)


def ring_area(rings: Column) -> Column:
    """Sum of the absolute areas of the rings, the first of each plan less the others is not assumed."""
    return F.aggregate(F.transform(rings, lambda r: F.abs(signed_area(edges(F.array(r))))), F.lit(0.0), lambda s, a: s + a)


def contains(e: Column, x: Column, y: Column) -> Column:
    """Even-odd test in one expression."""
    cross = F.filter(e, lambda k: ((k["ay"] > y) != (k["by"] > y)) & (x < (k["bx"] - k["ax"]) * (y - k["ay"]) / F.when(k["by"] == k["ay"], F.lit(1.0)).otherwise(k["by"] - k["ay"]) + k["ax"]))
    return F.size(cross) % 2 == 1


def edge_distance(e: Column, x: Column, y: Column) -> Column:
    """Least distance of a point to the edges."""
    def one(k: Column) -> Column:
        dx, dy = k["bx"] - k["ax"], k["by"] - k["ay"]
        l2 = dx * dx + dy * dy
        t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - k["ax"]) * dx + (y - k["ay"]) * dy) / F.when(l2 > 0, l2).otherwise(F.lit(1.0))))).otherwise(F.lit(0.0))
        return F.sqrt(F.pow(x - k["ax"] - t * dx, 2) + F.pow(y - k["ay"] - t * dy, 2))

    return F.array_min(F.transform(e, one))


def bounds(df: DataFrame, rings: str) -> DataFrame:
    flat = F.flatten(rings)
    return df.select("*", F.array_min(F.transform(flat, lambda p: p["x"])).alias("x0"), F.array_min(F.transform(flat, lambda p: p["y"])).alias("y0"), F.array_max(F.transform(flat, lambda p: p["x"])).alias("x1"), F.array_max(F.transform(flat, lambda p: p["y"])).alias("y1"))


def far_levels(levels: DataFrame, plans: DataFrame, most: float = 0.30) -> DataFrame:
    """(riga, distanza) of levels farther than ``most`` from the plan of their own unit, 0 inside.

    ``levels``: (riga, unita, x, y); ``plans``: (unita, anelli), one row a unit. Units that hold a large
    share of the levels are joined without a shuffle.
    """
    p = plans.select(F.col("unita").alias("__u"), edges(F.col("anelli")).alias("e")).where(F.size("e") > 0)
    j = skew_left_join(levels.where("unita is not null and x is not null and y is not null"), p, "unita", "__u").where("__u is not null")
    x, y = F.col("x"), F.col("y")
    d = F.when(contains(F.col("e"), x, y), F.lit(0.0)).otherwise(edge_distance(F.col("e"), x, y))
    return j.select("riga", d.alias("distanza")).where(F.col("distanza") > most)


def nearest(targets: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """(id, riga, z, d, posto): the k nearest points of each target within ``radius`` in its space.

    ``targets``: (id, space, x, y); ``points``: (riga, space, x, y, z). Grid cells of the radius are joined by
    equality, so only the nine cells around a target are read. Ties go to the smaller riga.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    t = targets.select("id", F.col("space").alias("s"), F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("cx"), cell("y").alias("cy"), around.alias("o")).select("id", "s", "tx", "ty", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    p = points.select("riga", "space", "x", "y", "z", cell("x").alias("px"), cell("y").alias("py"))
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    j = t.join(p, (F.col("s") == F.col("space")) & (F.col("cx") == F.col("px")) & (F.col("cy") == F.col("py"))).withColumn("d", d).where(F.col("d") <= radius)
    return j.withColumn("posto", F.row_number().over(Window.partitionBy("id").orderBy("d", "riga"))).where(F.col("posto") <= k).select("id", "riga", "z", "d", "posto")


def nearest_of_all(targets: DataFrame, points: DataFrame, k: int, radius: float, grow: float = 4.0) -> DataFrame:
    """As ``nearest``, with no limit of distance: the k nearest points of the whole space, or all it has.

    The first ring is ``radius``; targets that have neither k points nor all of their space go on with a
    ring ``grow`` times wider, so the rounds grow with the log of the farthest distance. Points and targets
    with a coordinate that is null, NaN or infinite are left out, as no ring reaches them.
    """
    finite = lambda df: df.where(" and ".join(f"{c} is not null and abs({c}) < double('Infinity')" for c in ("x", "y")))
    p = cut(finite(points).where("space is not null").select("riga", "space", "x", "y", "z"))
    need = p.groupBy(F.col("space").alias("__s")).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("__need"))
    t = finite(targets)
    open_ = cut(t.join(need, t.space == need["__s"]).select("id", "space", "x", "y", "__need"))
    parts = []
    while not parts or not open_.isEmpty():
        near = cut(nearest(open_, p, k, radius))
        done = near.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).join(open_.select(F.col("id").alias("__id"), "__need"), "__id").where("__n >= __need").select("__id")
        parts.append(near.join(done, F.col("id") == F.col("__id"), "left_semi"))
        open_ = cut(open_.join(done, F.col("id") == F.col("__id"), "left_anti"))
        radius *= grow
    return reduce(DataFrame.unionByName, parts)


def idw(near: DataFrame, smooth: float = 2.0) -> DataFrame:
    """Inverse-distance estimate of each target: weights 1 / (d^2 + s^2), with the nearest distance."""
    w = 1 / (F.col("d") * F.col("d") + smooth * smooth)
    return near.groupBy("id").agg((F.sum(F.col("z") * w) / F.sum(w)).alias("z"), F.min("d").alias("d_min"), F.count(F.lit(1)).alias("n"))


def section_cut(df: DataFrame, key: str, rings: str, y0: Column) -> DataFrame:
    """(key, x) where the line y = y0 crosses the edges of a plan, sorted pairs are the cut spans."""
    e = df.select(F.col(key), y0.alias("__y"), F.explode(edges(F.col(rings))).alias("k")).where((F.col("k.ay") > F.col("__y")) != (F.col("k.by") > F.col("__y")))
    return e.select(key, (F.col("k.ax") + (F.col("__y") - F.col("k.ay")) / (F.col("k.by") - F.col("k.ay")) * (F.col("k.bx") - F.col("k.ax"))).alias("x"))


def densify(df: DataFrame, keys: list[str], pos: str, x: str, y: str, step: float) -> DataFrame:
    """Points every ``step`` along lines: (keys, arco, x, y), from 0 up to the length."""
    w = Window.partitionBy(*keys).orderBy(pos)
    seg = df.withColumn("__nx", F.lead(x).over(w)).withColumn("__ny", F.lead(y).over(w))
    seg = seg.withColumn("__l", F.coalesce(F.sqrt(F.pow(F.col("__nx") - F.col(x), 2) + F.pow(F.col("__ny") - F.col(y), 2)), F.lit(0.0)))
    seg = seg.withColumn("__a", F.coalesce(F.sum("__l").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where("__l > 0")
    k0, k1 = F.ceil(F.col("__a") / step), F.ceil((F.col("__a") + F.col("__l")) / step) - 1
    pts = seg.where(k1 >= k0).withColumn("__k", F.explode(F.sequence(k0, k1)))
    t = (F.col("__k") * step - F.col("__a")) / F.col("__l")
    return pts.select(*keys, (F.col("__k") * step).alias("arco"), (F.col(x) + t * (F.col("__nx") - F.col(x))).alias("x"), (F.col(y) + t * (F.col("__ny") - F.col(y))).alias("y"))


def prism_volumes(mesh: DataFrame, *kept: str) -> DataFrame:
    """Per unit: plan area and volume between top and bottom of a mesh; ``kept``: further columns of the unit.

    ``mesh``: (unita, vertici array<(x, y, alto, basso)>, facce array<array<int>>), vertex numbers from 0; or packed
    (unita, xs, ys, spessori, terne), each face one number of three vertex numbers, BITS each.
    """
    if "terne" in mesh.columns:
        t = mesh.select("unita", *kept, "xs", "ys", "spessori", F.explode("terne").alias("f"))
        t = t.select("unita", *kept, "xs", "ys", "spessori", *(F.shiftright("f", k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias(p) for k, p in enumerate("abc")))
        t = t.select("unita", *kept, *(F.get(f"{c}s", F.col(p)).alias(f"{c}{p}") for c in "xy" for p in "abc"), sum((F.get("spessori", F.col(p)) for p in "abc"), F.lit(0.0)).alias("t"))
        area = F.abs((F.col("xb") - F.col("xa")) * (F.col("yc") - F.col("ya")) - (F.col("xc") - F.col("xa")) * (F.col("yb") - F.col("ya"))) / 2
        t = t.select("unita", *kept, area.alias("area"), "t")
        return t.groupBy("unita", *kept).agg(F.sum("area").alias("area"), (F.sum(F.col("area") * F.col("t")) / 3).alias("volume"))
    v = lambda i: F.element_at("vertici", F.col("f").getItem(i) + 1)
    t = mesh.select("unita", *kept, "vertici", F.explode("facce").alias("f")).select("unita", *kept, v(0).alias("a"), v(1).alias("b"), v(2).alias("c"))
    area = F.abs((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("c.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))) / 2
    thick = sum((F.col(f"{p}.alto") - F.col(f"{p}.basso") for p in "abc"), F.lit(0.0)) / 3
    return t.groupBy("unita", *kept).agg(F.sum(area).alias("area"), F.sum(area * thick).alias("volume"))


def boundary_edges(mesh: DataFrame) -> DataFrame:
    """(unita, a, b): edges that only one face has."""
    f = mesh.select("unita", F.explode("facce").alias("f"))
    e = f.select("unita", F.explode(F.array(*(F.struct(F.least(F.col("f")[i], F.col("f")[j]).alias("a"), F.greatest(F.col("f")[i], F.col("f")[j]).alias("b")) for i, j in ((0, 1), (1, 2), (0, 2))))).alias("e"))
    return e.groupBy("unita", "e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def straight_lines(df: DataFrame, key: list[str], pos: str, x: str, y: str) -> DataFrame:
    """(key, corda, lunghezza, dritta): a line is straight if its chord is at least 0.97 of its length."""
    w = Window.partitionBy(*key).orderBy(pos)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    g = df.withColumn("__s", step).groupBy(*key).agg(F.sum("__s").alias("lunghezza"), F.min_by(F.struct(x, y), pos).alias("p"), F.max_by(F.struct(x, y), pos).alias("q"))
    chord = F.sqrt(F.pow(F.col(f"p.{x}") - F.col(f"q.{x}"), 2) + F.pow(F.col(f"p.{y}") - F.col(f"q.{y}"), 2))
    return g.select(*key, chord.alias("corda"), "lunghezza", (chord >= F.col("lunghezza") * 0.97).alias("dritta"))
