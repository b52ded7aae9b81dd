"""Parent-child links of unknown depth to roots, depths, paths and descendants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Levels that one frontier join passes: 2 ** STRIDE_POWER.
STRIDE_POWER = 5


def hierarchy(links: DataFrame, nodes: DataFrame, stride_power: int = STRIDE_POWER) -> DataFrame:
    """Root, depth and path of each node: (nodo, radice, profondita, percorso).

    ``links``: (figlio, genitore); ``nodes``: (nodo), at least the ends of the links (missing ends
    are added). Repeated links count once, links of a node to itself and links with a null end are
    none. A node without a link is a root of depth 0. Should a node have several different parents,
    the smallest one counts. Nodes on a cycle get (-1, -1, 'ciclo'), nodes whose way up ends in one
    (-1, -1, 'verso ciclo'). Empty links: every node is a root; empty nodes and links: no row.

    Level-wise frontier joins from the roots, 2 ** stride_power levels at a time: each node first
    learns, by doubling, its ancestor that many levels up and the numbers between (a node nearer to
    its root than that is reached at once). Then each round joins the nodes not yet reached to those
    reached in the round before, on that ancestor, and appends the numbers to its path. Rounds are
    the depth over the stride; each reads only what is not reached. Nodes left when a frontier is
    empty lead to a cycle; those that are still an image after ever more steps up are on it. Links
    are keyed by the child, so a parent with very many children is a hot key only on the probing
    side, which adaptive execution splits.
    """
    clean = links.where("figlio is not null and genitore is not null and figlio <> genitore")
    parent = clean.groupBy("figlio").agg(F.min("genitore").alias("genitore"))
    every = (
        nodes.select("nodo")
        .unionByName(links.select(F.explode(F.array("figlio", "genitore")).alias("nodo")))
        .where("nodo is not null")
        .distinct()
    )
    # anc: the ancestor `hops` levels up (the node itself at 0); tail: the numbers below it, from above.
    # open: anc has a parent of its own.
    start = (
        every.join(parent, every.nodo == parent.figlio, "left")
        .select(
            "nodo",
            F.coalesce("genitore", "nodo").alias("anc"),
            F.when(F.col("genitore").isNull(), 0).otherwise(1).alias("hops"),
            F.when(F.col("genitore").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.col("nodo").cast("string"))).alias("tail"),
        )
    )
    seg = cut(start)
    for _ in range(stride_power):
        up = seg.where("hops > 0").select(F.col("nodo").alias("__k"), F.col("anc").alias("__a"), F.col("hops").alias("__h"), F.col("tail").alias("__t"))
        seg = cut(
            seg.join(up, seg.anc == up["__k"], "left").select(
                "nodo",
                F.coalesce("__a", "anc").alias("anc"),
                (F.col("hops") + F.coalesce("__h", F.lit(0))).alias("hops"),
                F.concat(F.coalesce("__t", F.lit("")), "tail").alias("tail"),
            )
        )
    stride = 2**stride_power
    roots = seg.where("hops = 0").select(F.col("nodo").alias("root"))
    short = seg.where(F.col("hops") < stride)
    full = seg.where(F.col("hops") == stride)
    at_root = full.join(roots, full.anc == roots.root, "left_semi")
    frontier = cut(
        short.unionByName(at_root).select("nodo", F.col("anc").alias("radice"), F.col("hops").cast("bigint").alias("profondita"), F.concat(F.col("anc").cast("string"), "tail").alias("percorso"))
    )
    rest = cut(full.join(roots, full.anc == roots.root, "left_anti"))
    done, since = [frontier], [frontier]
    while True:
        f = frontier.select(F.col("nodo").alias("__k"), "radice", "profondita", "percorso")
        # A node reached before has its ancestor in an earlier frontier, so it can't come again.
        frontier = cut(
            rest.join(f, rest.anc == f["__k"]).select("nodo", "radice", (F.col("profondita") + F.lit(stride)).alias("profondita"), F.concat("percorso", "tail").alias("percorso"))
        )
        if frontier.isEmpty():
            break
        done.append(frontier)
        since.append(frontier)
        if len(since) == 4:
            rest, since = cut(rest.join(_nodes(since), "nodo", "left_anti")), []
    left = rest.select("nodo", "anc")
    bad = _cycles(cut(left.join(_nodes(since), "nodo", "left_anti") if since else left))
    return reduce(DataFrame.unionByName, [*done, bad])


def _nodes(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("nodo") for p in parts])


def _cycles(left: DataFrame) -> DataFrame:
    """Nodes on or towards cycles; ``left``: (nodo, anc), anc some steps up, always within ``left``."""
    jump, n = left, None
    while True:
        image = cut(jump.select(F.col("anc").alias("img")).distinct())
        now = image.count()
        if now == n or now == 0:
            break
        n = now
        j2 = jump.select(F.col("nodo").alias("__k"), F.col("anc").alias("__a"))
        jump = cut(jump.join(j2, jump.anc == j2["__k"]).select("nodo", F.col("__a").alias("anc")))
    on = image.withColumn("on", F.lit(True))
    return left.join(on, left.nodo == on.img, "left").select(
        "nodo",
        F.lit(-1).cast("bigint").alias("radice"),
        F.lit(-1).cast("bigint").alias("profondita"),
        F.when(F.col("on"), F.lit("ciclo")).otherwise(F.lit("verso ciclo")).alias("percorso"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """Ancestor pairs (antenato, discendente, distanza) of a ``hierarchy`` result, without cycles."""
    p = paths.where("profondita > 0").select("nodo", F.split("percorso", "/").alias("way"))
    return p.select("nodo", F.posexplode("way"), F.size("way").alias("n")).where("pos < n - 1").select(
        F.col("col").cast("bigint").alias("antenato"), F.col("nodo").alias("discendente"), (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distanza")
    )


def descendant_counts(paths: DataFrame) -> DataFrame:
    """Number of descendants of each node that has any; pairs are counted before they are shuffled."""
    return descendants(paths).groupBy("antenato").agg(F.count(F.lit(1)).alias("discendenti"), F.max("distanza").alias("altezza"))
