"""The sequence graph: an edge a -> b says that a is later than b. All steps are joins of whole levels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import CONTEMPORARY, DIRECT, relation_of
from ..session import cut, row_numbers
from .phrases import direction, meanings
from .skew import skew_left_join


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resolve(rel: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``rel`` (riga, a, phrase, b) with r: (rel, inversa), nulls where the phrase is not understood.

    With ``terms`` (termine, canonico) each distinct phrase is looked up by ``phrases.meanings`` and joined
    back, phrases that make up much of the rows without a shuffle; else only the built-in wordings count.
    """
    if terms is None:
        return rel.withColumn("r", relation_of(F.col("phrase")))
    found = cut(meanings(rel.select("phrase"), "phrase", terms).where("canonico is not null").select(F.col("phrase").alias("__p"), direction(F.col("canonico")).alias("r")))
    return skew_left_join(rel, found, "phrase", "__p").drop("__p")


def unmatched(rel: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase, righe): phrases that mean no relation, with their rows."""
    found = meanings(rel.select("phrase"), "phrase", terms).where("canonico is null").select("phrase")
    return rel.groupBy("phrase").agg(F.count(F.lit(1)).alias("righe")).join(found, "phrase")


def normalise(rel: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, pairs) of typed relations (riga, a, phrase, b); ``terms``: see ``resolve``.

    Inverse forms are swapped. Edges (a, rel, b): one a pair of ends, of several types the last by riga.
    Pairs (a, b), a < b: contemporary units. Phrases not understood (``unmatched`` reports them), null ends
    and self-relations fall away.
    """
    r = resolve(rel, terms).where("r.rel is not null and a is not null and b is not null and a <> b")
    swap = F.col("r.inversa")
    ends = r.select("riga", F.col("r.rel").alias("rel"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    edges = ends.where(F.col("rel").isin(*DIRECT)).groupBy("a", "b").agg(F.max_by("rel", "riga").alias("rel"))
    pairs = ends.where(F.col("rel").isin(*CONTEMPORARY)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return edges.select("a", "rel", "b"), pairs


def components(pairs: DataFrame) -> DataFrame:
    """(nodo, gruppo): connected components by the least member, in a number of rounds that grows with the log of their size.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each node links its larger, then its
    smaller neighbours to the least one. Neighbourhoods are only aggregated, never collected.
    """
    e = cut(pairs.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("nodo")).distinct()
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum("b"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(e, nodes.nodo == e.a, "left").groupBy("nodo").agg(F.coalesce(F.min("b"), F.col("nodo")).alias("gruppo"))


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups, without those inside one, each once."""
    ga, gb = groups.select(F.col("nodo").alias("__a"), F.col("gruppo").alias("__ga")), groups.select(F.col("nodo").alias("__b"), F.col("gruppo").alias("__gb"))
    j = edges.join(ga, F.col("a") == F.col("__a"), "left").join(gb, F.col("b") == F.col("__b"), "left")
    return j.select(F.coalesce("__ga", "a").alias("a"), F.coalesce("__gb", "b").alias("b")).where("a <> b").distinct()


def sweep(edges: DataFrame, nodes: DataFrame, send: Column | None = None, combine=F.max) -> tuple[DataFrame, DataFrame]:
    """(settled, residue) of a sweep up the edges (a, b), from the nodes without one to those above them.

    ``nodes``: (nodo, ...) with any columns of their own; ends of edges that are not among them are added with
    nulls. A node is settled once all nodes below it are; settled rows hold livello (the longest way down) and
    ``preso``, the ``combine`` of what the nodes right below sent: ``send``, an expression over their columns,
    ``preso`` among them. Residue (nodo): nodes on or above a cycle. A round a level, one checkpoint each; only
    nodes that still wait are carried on.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    out = e.groupBy(F.col("a").alias("__n")).agg(F.count(F.lit(1)).alias("__left"))
    every = nodes.where("nodo is not null").select("nodo").unionByName(e.select(F.explode(F.array("a", "b")).alias("nodo"))).distinct()
    send = F.lit(None).cast("double") if send is None else send
    own = nodes.where("nodo is not null").withColumnRenamed("nodo", "__o")
    wait = every.join(own, F.col("nodo") == F.col("__o"), "left").drop("__o").join(out, F.col("nodo") == F.col("__n"), "left").drop("__n").withColumn("__left", F.coalesce("__left", F.lit(0)))
    kind = wait.withColumn("preso", F.lit(None).cast("double")).select(send.alias("s")).schema["s"].dataType
    wait = cut(wait.withColumn("preso", F.lit(None).cast(kind)))
    cols = [c for c in wait.columns if c not in ("__left", "preso")]
    parts, n = [], 0
    while True:
        ready = wait.where("__left = 0")
        if ready.isEmpty():
            break
        parts.append(ready.select(*cols, "preso", F.lit(n).cast("bigint").alias("livello")))
        got = ready.select(F.col("nodo").alias("b"), send.alias("__s")).join(e, "b").groupBy(F.col("a").alias("__n")).agg(F.count(F.lit(1)).alias("__k"), combine("__s").alias("__s"))
        both = F.array_max if combine is F.max else F.array_min
        wait = cut(
            wait.where("__left > 0").join(got, F.col("nodo") == F.col("__n"), "left")
            .select(*cols, (F.col("__left") - F.coalesce("__k", F.lit(0))).alias("__left"), both(F.array("preso", "__s")).alias("preso"))
        )
        n += 1
        if n % 32 == 0:
            parts = [cut(_union(parts))]
    empty = wait.limit(0).select(*cols, "preso", F.lit(0).cast("bigint").alias("livello"))
    return (_union(parts) if parts else empty), wait.select("nodo")


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels, residue): longest way down of each node, (nodo, livello), and the edges from nodes on or above a cycle.

    Without cycles there are none left. Rounds: the depth.
    """
    n = edges.select(F.col("a").alias("nodo")).limit(0) if nodes is None else nodes.select("nodo").distinct()
    done, left = sweep(edges, n)
    rest = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct().join(left.select(F.col("nodo").alias("a")), "a", "left_semi").select("a", "b")
    return done.select("nodo", "livello"), rest


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges on or between cycles: peeled from both ends, two levels at each end a round, until none falls away."""
    rest = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    n = rest.count()
    while n:
        for _ in range(2):
            heads, tails = rest.select("a").distinct(), rest.select("b").distinct()
            rest = rest.join(heads.withColumnRenamed("a", "b"), "b", "left_semi").join(tails.withColumnRenamed("b", "a"), "a", "left_semi").select("a", "b")
        rest = cut(rest)
        now = rest.count()
        if now == n:
            break
        n = now
    return rest


def reach(edges: DataFrame, seeds: DataFrame, up: bool = True) -> DataFrame:
    """(nodo): the seeds and all nodes above (or below) them, by frontier joins; each node enters once."""
    e = cut((edges if up else reverse(edges)).select("a", "b").where("a is not null and b is not null").distinct())
    frontier = cut(seeds.select("nodo").where("nodo is not null").distinct())
    parts = [frontier]
    while True:
        nxt = e.join(frontier.select(F.col("nodo").alias("b")), "b", "left_semi").select(F.col("a").alias("nodo")).distinct()
        frontier = cut(nxt.join(_union(parts), "nodo", "left_anti"))
        if frontier.isEmpty():
            return _union(parts)
        parts.append(frontier)
        if len(parts) > 16:
            parts = [cut(_union(parts))]


def closure(edges: DataFrame, from_nodes: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) with a way from a to b; semi-naive: only new pairs are extended.

    Its size is that of the answer; ``from_nodes`` (nodo) restricts the upper ends.
    """
    e = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    new = e if from_nodes is None else cut(e.join(from_nodes.select(F.col("nodo").alias("a")), "a", "left_semi"))
    parts = [new]
    step = e.select(F.col("a").alias("__m"), F.col("b").alias("__b"))
    while True:
        nxt = new.join(step, F.col("b") == F.col("__m")).select("a", F.col("__b").alias("b")).distinct()
        new = cut(nxt.join(_union(parts), ["a", "b"], "left_anti"))
        if new.isEmpty():
            return _union(parts)
        parts.append(new)
        if len(parts) > 8:
            parts = [cut(_union(parts))]


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without another way from a to b; for graphs without cycles.

    An edge is asked for by each other child c of a that lies above b: is there a way from c to b? The ways are
    followed edge by edge, but only through nodes above b by their levels, and an answered question is dropped;
    no closure is made.
    """
    e = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    lev = cut(levels(e)[0])
    step = cut(e.join(lev.select(F.col("nodo").alias("b"), F.col("livello").alias("lb")), "b").select("a", "b", "lb"))
    sib = step.select("a", F.col("b").alias("c"), F.col("lb").alias("lc")).join(step, "a").where("lc > lb").select("a", "b", "c", "lb")
    asks = cut(sib.select("c", "b", "lb").distinct().withColumn("x", F.col("c")))
    nxt = step.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("lb").alias("ly"))
    yes = []
    while not asks.isEmpty():
        on = cut(asks.join(nxt, "x").where("ly > lb or y = b").select("c", "b", "lb", F.col("y").alias("x")).distinct())
        yes.append(cut(on.where("x = b").select("c", "b").distinct()))
        if len(yes) > 16:
            yes = [cut(_union(yes))]
        asks = cut(on.where("x <> b").join(yes[-1], ["c", "b"], "left_anti"))
    if not yes:
        return e
    longer = sib.join(_union(yes), ["c", "b"], "left_semi").select("a", "b").distinct()
    return e.join(longer, ["a", "b"], "left_anti")


def contradictions(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contemporary pairs that are also sequenced directly."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(e, ["a", "b"], "left_semi")


#: Edges of a weakly connected part that one task searches; larger parts are coloured.
MOST_SEARCHED = 1_000_000


def _trimmed(edges: DataFrame, peels: int = 4) -> DataFrame:
    """Edges less some of those that are on no cycle: a few peels from both ends, one checkpoint."""
    rest = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    for _ in range(peels // 2):
        rest = rest.join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
    return cut(rest)


def strong_components(edges: DataFrame, most: int = MOST_SEARCHED) -> DataFrame:
    """(nodo, gruppo) for nodes on cycles: strong components of two or more nodes, by their least member.

    After a few peels each weakly connected part with at most ``most`` edges is searched depth first by one
    task (Tarjan), parts side by side; larger parts are coloured by joins (``by_colour``). No closure is made.
    """
    core = _trimmed(edges)
    parts = components(core)
    e = cut(core.join(parts, F.col("a") == F.col("nodo")).select("gruppo", "a", "b"))
    size = e.groupBy(F.col("gruppo").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    big = cut(size.where(F.col("__n") > most).select("__g"))
    schema = T.StructType([T.StructField("nodo", edges.schema["a"].dataType), T.StructField("gruppo", edges.schema["a"].dataType)])

    def run(t: pa.Table) -> pa.Table:
        out = _tarjan(t.column("a").to_numpy(), t.column("b").to_numpy())
        return pa.table({n: pa.array(c, t.schema.field("a").type) for n, c in zip(("nodo", "gruppo"), out, strict=True)})

    if big.isEmpty():
        return e.groupBy("gruppo").applyInArrow(run, schema)
    small = e.join(big, e.gruppo == big["__g"], "left_anti").groupBy("gruppo").applyInArrow(run, schema)
    return small.unionByName(by_colour(e.join(big, e.gruppo == big["__g"], "left_semi").select("a", "b")))


strong_components_by_search = strong_components


def by_colour(edges: DataFrame) -> DataFrame:
    """(nodo, gruppo) of the strong components of two or more nodes, by forward-backward colouring.

    Each round every node takes the least number that reaches it (its colour); the nodes of a colour that lead
    back to its least node, within the colour, are that node's component and leave the graph, which is then
    trimmed to its cyclic core again. Joins only; rounds grow with the length of the ways.
    """
    core, out = cyclic_core(edges), []
    while not core.isEmpty():
        colour = cut(core.select(F.explode(F.array("a", "b")).alias("nodo")).distinct().withColumn("c", F.col("nodo")))
        while True:
            down = core.join(colour.withColumnRenamed("nodo", "a"), "a").groupBy(F.col("b").alias("__b")).agg(F.min("c").alias("__c"))
            new = cut(colour.join(down, F.col("nodo") == F.col("__b"), "left").select("nodo", F.least("c", F.coalesce("__c", "c")).alias("c"), (F.col("__c") < F.col("c")).alias("moved")))
            colour = new.select("nodo", "c")
            if new.where("moved").isEmpty():
                break
        own = cut(core.join(colour.select(F.col("nodo").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("nodo").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        frontier = cut(colour.where("nodo = c"))
        found = frontier
        while not frontier.isEmpty():
            back = own.join(frontier.select(F.col("nodo").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("nodo"), "c").distinct()
            frontier = cut(back.join(found, ["nodo", "c"], "left_anti"))
            found = cut(found.unionByName(frontier))
        out.append(cut(found.join(found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "c").select("nodo", F.col("c").alias("gruppo"))))
        gone = found.select("nodo")
        core = cyclic_core(core.join(gone.withColumnRenamed("nodo", "a"), "a", "left_anti").join(gone.withColumnRenamed("nodo", "b"), "b", "left_anti").select("a", "b"))
    return _union(out) if out else edges.select(F.col("a").alias("nodo"), F.col("a").alias("gruppo")).limit(0)


def _tarjan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least member of their component) of the nodes in strong components of two or more."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, tail, head = len(nodes), code[: len(a)], code[len(a) :]
    nxt = head[np.argsort(tail, kind="stable")].tolist()
    start = np.searchsorted(np.sort(tail), np.arange(n + 1)).tolist()
    at, order, low, comp = start[:-1], [-1] * n, [0] * n, [-1] * n
    seen, open_ = 0, []
    for root in range(n):
        if order[root] >= 0:
            continue
        way = [root]
        while way:
            v = way[-1]
            if order[v] < 0:
                order[v] = low[v] = seen
                seen += 1
                open_.append(v)
            if at[v] < start[v + 1]:
                w = nxt[at[v]]
                at[v] += 1
                if order[w] < 0:
                    way.append(w)
                elif comp[w] < 0:
                    low[v] = min(low[v], order[w])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == order[v]:
                k = len(open_) - 1
                while open_[k] != v:
                    k -= 1
                least = min(open_[k:])
                for w in open_[k:]:
                    comp[w] = least
                del open_[k:]
    c = np.array(comp, np.int64)
    many = np.bincount(c, minlength=n)[c] > 1
    return nodes[many], nodes[c[many]]


def condense(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, groups) without cycles: contemporary units contracted first, then each cycle to its least member."""
    first = components(pairs)
    e = cut(contract(edges, first))
    cyc = cut(strong_components(e))
    groups = (
        first.join(cyc.select(F.col("nodo").alias("__n"), F.col("gruppo").alias("__g")), F.col("gruppo") == F.col("__n"), "left")
        .select("nodo", F.coalesce("__g", "gruppo").alias("gruppo"))
        .unionByName(cyc.join(first.select("nodo"), "nodo", "left_anti"))
    )
    return contract(e, cyc), groups


def accept_inferred(edges: DataFrame, inferred: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the inferred ones that are new, between known nodes, if all together bring no cycle; else as they were."""
    known = nodes.select("nodo")
    new = (
        inferred.select("a", "b").where("a <> b").distinct()
        .join(known.withColumnRenamed("nodo", "a"), "a", "left_semi").join(known.withColumnRenamed("nodo", "b"), "b", "left_semi")
        .join(edges.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    )
    both = cut(edges.select("a", "b").unionByName(new))
    return both if strong_components(both).isEmpty() else edges.select("a", "b")


def wall_phases(edges: DataFrame, pairs: DataFrame, walls: DataFrame) -> DataFrame:
    """(nodo, gruppo, fase): walls grouped by bonding; a group is later if any way through any units leads to another.

    The phase is the greatest number of other wall groups on a way down, cycles counting as one: a sweep that
    adds one at each group of walls, so no pairs of walls are made. Groups on a common cycle share a phase.
    """
    w = walls.select("nodo").distinct()
    bonds = pairs.join(w.withColumnRenamed("nodo", "a"), "a", "left_semi").join(w.withColumnRenamed("nodo", "b"), "b", "left_semi")
    groups = cut(components(bonds))
    g = w.join(groups, "nodo", "left").select("nodo", F.coalesce("gruppo", "nodo").alias("gruppo"))
    e = cut(contract(edges, groups))
    cyc = cut(strong_components(e))
    of = cut(g.join(cyc.select(F.col("nodo").alias("__n"), F.col("gruppo").alias("__g")), F.col("gruppo") == F.col("__n"), "left").select("nodo", "gruppo", F.coalesce("__g", "gruppo").alias("k")))
    heads = of.select(F.col("k").alias("nodo")).distinct().withColumn("muro", F.lit(1))
    done, _ = sweep(contract(e, cyc), heads, (F.coalesce("preso", F.lit(0)) + F.coalesce("muro", F.lit(0))).cast("bigint"))
    return of.join(done.select(F.col("nodo").alias("k"), "preso"), "k", "left").select("nodo", "gruppo", F.coalesce("preso", F.lit(0)).cast("bigint").alias("fase"))


def chronology(edges: DataFrame, surveys: DataFrame, walls: DataFrame) -> DataFrame:
    """(nodo, giorno, stimato): the survey day by which a unit was removed; ``edges`` without cycles.

    ``surveys``: (nodo, giorno), days as 0-based places. A unit with two or more own days went by its last;
    any other by the later of its own day and the earliest day of a unit below it (estimated), none if
    nothing below was surveyed. Walls stay. A sweep hands the earliest day up.
    """
    own = surveys.where("nodo is not null and giorno is not null").groupBy("nodo").agg(F.min("giorno").cast("bigint").alias("primo"), F.max("giorno").alias("ultimo"), F.countDistinct("giorno").alias("n"))
    done, _ = sweep(edges, own, F.least(F.col("preso").cast("bigint"), F.col("primo")), F.min)
    day = F.when(F.col("n") >= 2, F.col("ultimo")).when(F.col("preso").isNotNull(), F.greatest(F.col("preso"), F.coalesce("ultimo", F.lit(0))))
    return done.withColumn("giorno", day.cast("bigint")).join(walls.select("nodo"), "nodo", "left_anti").select("nodo", "giorno", (F.coalesce("n", F.lit(0)) < 2).alias("stimato"))


def layer_depths(edges: DataFrame, thickness: DataFrame) -> DataFrame:
    """(nodo, quota): depth of a free layer below the surface, the greatest depth + thickness of what covers it."""
    done, _ = sweep(reverse(edges), thickness.select("nodo", "spessore"), F.coalesce("preso", F.lit(0.0)) + F.coalesce("spessore", F.lit(0.0)))
    return done.select("nodo", F.coalesce("preso", F.lit(0.0)).alias("quota"))


def component_sizes(groups: DataFrame) -> DataFrame:
    """(gruppo, membri, posto): components by falling size, then least member."""
    return row_numbers(groups.groupBy("gruppo").agg(F.count(F.lit(1)).alias("membri")), "posto", F.desc("membri"), F.col("gruppo"))
