"""Points near other points, and points in regions, by a sampled quadtree and R-trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points aimed at in one partition group. The groups, and the sample that lays them out (it decides the layout only,
#: never a result), grow with the points: sixteen sampled points a group, at least SAMPLE and at most so many as the
#: driver and each task can hold, which is reached at 2.6 thousand million points.
GROUP_ROWS, MAX_GROUPS = 40_000, 65_536
SAMPLE, MAX_SAMPLE = 60_000, 16 * 65_536
#: Most blocks into which the probes of one indivisible cell are split.
MAX_BLOCKS = 4096
FANOUT = 16
CHUNK = 200_000


@dataclass
class Forest:
    """A quadtree for each space that holds many sampled points; all other spaces share ``buckets`` groups.

    Nodes are arrays: centre, first child (four in a row) or -1, and for leaves their number and blocks.
    A point goes down by comparison with the centres only, so the outer cells have no outer border.
    """

    roots: dict[str, int]
    cx: np.ndarray
    cy: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    blocks: np.ndarray
    buckets: int

    @staticmethod
    def build(space: np.ndarray, x: np.ndarray, y: np.ndarray, total: int, radius: float) -> Forest:
        groups = max(1, min(MAX_GROUPS, math.ceil(total / GROUP_ROWS)))
        cap = max(8, len(x) // groups)
        each = total / max(1, len(x))
        roots: dict[str, int] = {}
        cx, cy, child, leaf, blocks = [], [], [], [], []
        leaves = 0

        def node() -> int:
            for a, v in ((cx, 0.0), (cy, 0.0), (child, -1), (leaf, -1), (blocks, 1)):
                a.append(v)
            return len(cx) - 1

        order = np.argsort(space, kind="stable")
        names, first = np.unique(space[order], return_index=True)
        light = 0
        for name, part in zip(names, np.split(order, first[1:])):
            if len(part) <= cap:
                light += len(part)
                continue
            roots[str(name)] = root = node()
            px, py = x[part], y[part]
            mx, my = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
            half = max(px.max() - px.min(), py.max() - py.min(), radius) / 2
            todo = [(root, part, mx, my, half)]
            while todo:
                at, ids, mx, my, half = todo.pop()
                if len(ids) <= cap or half < 2 * radius:
                    leaf[at] = leaves
                    blocks[at] = int(min(MAX_BLOCKS, max(1, len(ids) // (4 * cap))))
                    leaves += 1
                    continue
                cx[at], cy[at] = mx, my
                child[at] = kids = node()
                for _ in range(3):
                    node()
                q = (x[ids] >= mx) + 2 * (y[ids] >= my)
                for k in range(4):
                    h = half / 2
                    todo.append((kids + k, ids[q == k], mx + (h if k & 1 else -h), my + (h if k & 2 else -h), h))
        b = max(1, min(MAX_GROUPS, math.ceil(light * each / GROUP_ROWS)))
        return Forest(roots, np.array(cx), np.array(cy), np.array(child, np.int64), np.array(leaf, np.int64), np.array(blocks, np.int64), b)

    def groups(self, space: pa.Array, bucket: np.ndarray, salt: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, hx: np.ndarray, hy: np.ndarray) -> pa.Array:
        """For each box the codes 2 * group + home of all groups it touches; home: the group of (hx, hy) that probes."""
        coded = space.dictionary_encode() if not pa.types.is_dictionary(space.type) else space
        root_of = np.array([self.roots.get(s, -1) for s in coded.dictionary.to_pylist()] or [-1], np.int64)
        root = root_of[np.asarray(coded.indices.fill_null(0))] if len(coded) else np.zeros(0, np.int64)
        rows = np.flatnonzero(root < 0)
        out_row, out_code = [rows], [2 * (bucket[rows] % self.buckets) + 1]
        row = np.flatnonzero(root >= 0)
        at, home = root[row], np.ones(len(row), bool)
        while len(row):
            end = self.child[at] < 0
            r, n, h = row[end], at[end], home[end]
            k = self.blocks[n]
            rr = np.repeat(r, k)
            block = np.arange(len(rr)) - np.repeat(np.cumsum(k) - k, k)
            mine = np.repeat(h, k) & (salt[rr] % np.repeat(k, k) == block)
            out_row.append(rr)
            out_code.append(2 * (self.buckets + np.repeat(self.leaf[n], k) * MAX_BLOCKS + block) + mine)
            row, at, home = row[~end], at[~end], home[~end]
            if not len(row):
                break
            mx, my = self.cx[at], self.cy[at]
            new = []
            for q in range(4):
                ok = (x1[row] >= mx if q & 1 else x0[row] < mx) & (y1[row] >= my if q & 2 else y0[row] < my)
                own = ((hx[row] >= mx) == bool(q & 1)) & ((hy[row] >= my) == bool(q & 2))
                new.append((row[ok], (self.child[at] + q)[ok], (home & own)[ok]))
            row, at, home = (np.concatenate(z) for z in zip(*new))
        r, c = np.concatenate(out_row), np.concatenate(out_code)
        by = np.argsort(r, kind="stable")
        offsets = np.zeros(len(x0) + 1, np.int32)
        np.cumsum(np.bincount(r, minlength=len(x0)), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(c[by], pa.int64()))


class RTree:
    """Boxes in (space, x, y), packed by sort-tile-recursion; ``probe`` finds the boxes that touch given ones."""

    def __init__(self, space: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray):
        n = len(space)
        order = np.lexsort((x0, space))
        slices = max(1, math.ceil(math.sqrt(n / FANOUT)))
        slice_no = np.arange(n) // (slices * FANOUT)
        self.order = order[np.lexsort((y0[order], space[order], slice_no))]
        o = self.order
        self.levels = [(space[o], space[o], x0[o], y0[o], x1[o], y1[o])]
        while len(self.levels[-1][0]) > FANOUT:
            s0, s1, a0, b0, a1, b1 = self.levels[-1]
            at = np.arange(0, len(s0), FANOUT)
            self.levels.append((np.minimum.reduceat(s0, at), np.maximum.reduceat(s1, at), np.minimum.reduceat(a0, at), np.minimum.reduceat(b0, at), np.maximum.reduceat(a1, at), np.maximum.reduceat(b1, at)))

    def probe(self, space: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray):
        """Pairs (query, box) as two arrays, a chunk of queries at a time."""
        step = max(1, CHUNK // FANOUT)
        for lo in range(0, len(space), step):
            hi = min(lo + step, len(space))
            top = len(self.levels[-1][0])
            q = np.repeat(np.arange(lo, hi), top)
            node = np.tile(np.arange(top), hi - lo)
            for level in range(len(self.levels) - 1, -1, -1):
                s0, s1, a0, b0, a1, b1 = self.levels[level]
                ok = (s0[node] <= space[q]) & (s1[node] >= space[q])
                q, node = q[ok], node[ok]
                ok = (a0[node] <= x1[q]) & (a1[node] >= x0[q]) & (b0[node] <= y1[q]) & (b1[node] >= y0[q])
                q, node = q[ok], node[ok]
                if level:
                    below = len(self.levels[level - 1][0])
                    q = np.repeat(q, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    ok = node < below
                    q, node = q[ok], node[ok]
            yield q, self.order[node]


def inside(px: np.ndarray, py: np.ndarray, poly: np.ndarray, edges: tuple[np.ndarray, ...], start: np.ndarray) -> np.ndarray:
    """Even-odd test of point i against polygon ``poly[i]``; edges of polygon j: start[j] to start[j + 1]."""
    ax, ay, bx, by = edges
    out = np.zeros(len(px), bool)
    count = start[poly + 1] - start[poly]
    ends = np.cumsum(count)
    lo = 0
    while lo < len(px):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 8 * CHUNK)))
        k = count[lo:hi]
        pair = np.repeat(np.arange(hi - lo), k)
        e = np.arange(len(pair)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[poly[lo:hi]], k)
        x, y = px[lo:hi][pair], py[lo:hi][pair]
        span = (ay[e] > y) != (by[e] > y)
        pair, e, x, y = pair[span], e[span], x[span], y[span]
        hit = x < (bx[e] - ax[e]) * (y - ay[e]) / (by[e] - ay[e]) + ax[e]
        out[lo:hi] = np.bincount(pair[hit], minlength=hi - lo) % 2 == 1
        lo = hi
    return out


def _edges(xs: pa.Array, ys: pa.Array, sizes: pa.Array) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """All edges of all polygons, rings closed, and where each polygon's begin."""
    x, y, k = (np.asarray(c.flatten()) for c in (xs, ys, sizes))
    of = np.asarray(xs.value_lengths())
    start = np.concatenate([[0], np.cumsum(of)])
    nxt = np.arange(1, len(x) + 1)
    k = k[k > 0]
    last = np.cumsum(k) - 1
    nxt[last] = last - k + 1
    return (x, y, x[nxt], y[nxt]), start


def _near(t: pa.Table, radius: float) -> tuple[np.ndarray, np.ndarray]:
    x, y, riga, home = (t.column(c).to_numpy() for c in ("x", "y", "a", "home"))
    space, ident = (np.asarray(_codes(t.column(c))) for c in ("space", "ident"))
    tree = RTree(space, x, y, x, y)
    probe = np.flatnonzero(home)
    # Wider by a hair, so that rounding in the box can't lose a pair that the exact test keeps.
    r = radius * (1 + 1e-6) + 1e-9
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, n in tree.probe(space[probe], x[probe] - r, y[probe] - r, x[probe] + r, y[probe] + r):
        q = probe[q]
        ok = (riga[q] < riga[n]) & (ident[q] != ident[n]) & (ident[q] >= 0) & (ident[n] >= 0)
        q, n = q[ok], n[ok]
        ok = (x[q] - x[n]) ** 2 + (y[q] - y[n]) ** 2 < radius**2
        a.append(riga[q[ok]])
        b.append(riga[n[ok]])
    return np.concatenate(a), np.concatenate(b)


def _within(t: pa.Table, g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.filter(pc.and_(t.column("home"), t.column("free")))
    if not len(t) or not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = _codes(pa.chunked_array([*t.column("space").chunks, *g.column("space").chunks]))
    ps, gs = spaces[: len(t)], spaces[len(t) :]
    x, y, riga = (t.column(c).to_numpy() for c in ("x", "y", "a"))
    unit = g.column("unit").to_numpy()
    edges, start = _edges(*(g.column(c).combine_chunks() for c in ("xs", "ys", "sizes")))
    tree = RTree(gs, *(g.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, n in tree.probe(ps, x, y, x, y):
        ok = inside(x[q], y[q], n, edges, start)
        a.append(riga[q[ok]])
        b.append(unit[n[ok]])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pairs[0], pairs[1]


def _codes(c: pa.ChunkedArray) -> np.ndarray:
    d = pc.dictionary_encode(c).combine_chunks()
    d = d if isinstance(d, pa.DictionaryArray) else d.chunk(0)
    return np.asarray(d.indices.fill_null(-1)).astype(np.int64)


def located(points: DataFrame, space: str, x: str, y: str) -> DataFrame:
    """Rows with a location: x and y neither null nor NaN nor both 0, and a space."""
    c = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & ~((F.col(x) == 0) & (F.col(y) == 0))
    return points.where(c & F.col(space).isNotNull())


def layout(points: DataFrame, space: str, x: str, y: str, radius: float) -> Forest:
    """The quadtree forest for located ``points``, from a sample that grows with the groups (at most 2 * MAX_SAMPLE rows)."""
    narrow = points.select(F.col(space).cast("string").alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    total = narrow.count()
    want = min(MAX_SAMPLE, max(SAMPLE, 16 * math.ceil(total / GROUP_ROWS)))
    some = narrow.sample(fraction=min(1.0, want / max(1, total)), seed=7).limit(2 * want).toArrow()
    return Forest.build(np.array(some.column("s").to_pylist(), object).astype(str), some.column("x").to_numpy(), some.column("y").to_numpy(), total, radius)


def _bucket() -> Column:
    return F.crc32(F.col("space").cast("binary"))


def in_groups(pts: DataFrame, forest: Forest, radius: float) -> DataFrame:
    """Points (a, space, x, y, ...) with ``grp`` and ``home``: a row for each group that the circle around them touches."""
    reach = radius * (1 + 1e-6) + 1e-9

    @F.arrow_udf("array<bigint>")
    def of_points(s: pa.Array, bucket: pa.Array, salt: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        vx, vy = np.asarray(px), np.asarray(py)
        return forest.groups(s, np.asarray(bucket), np.asarray(salt), vx - reach, vy - reach, vx + reach, vy + reach, vx, vy)

    salt = F.pmod(F.xxhash64("a"), F.lit(MAX_BLOCKS * 997))
    code = pts.withColumn("code", F.explode(of_points("space", _bucket(), salt, "x", "y")))
    return code.select(*pts.columns, F.expr("code % 2 = 1").alias("home"), F.expr("code div 2").alias("grp"))


def near_and_within(points: DataFrame, regions: DataFrame, radius: float, *, key: str, space: str, ident: str, x: str, y: str, free: str, unit: str, rings: str, cases: tuple[str, ...] = ("vicino", "dentro")) -> DataFrame:
    """Pairs of close points, and regions that contain points: (caso, a, b).

    'vicino': a < b are ``key`` of two points of one ``space`` with different ``ident``, less than
    ``radius`` apart. 'dentro': a is the ``key`` of a point for which the column ``free`` is true, b a
    ``unit`` of ``regions`` in the same space whose ``rings`` (array of rings of (x, y), even-odd,
    closed or not) contain it; once per (a, b), however often the region is entered.

    Points without space or location (null, NaN, both coordinates 0) never count; a null ident is
    different from none; regions without rings, unit or space contain nothing. Points on one spot and
    repeated rows pair like any others. Empty tables give no row. Keys are unique integers.

    A sample lays out a quadtree for each space with many points; small spaces share groups. Each
    point goes to the cell it lies in (its home) and to those its circle touches; a region to all it
    touches. Each group is searched with a bulk-loaded R-tree, then by exact distance or even-odd
    test. With ``cases`` only one of the two is sought; for 'dentro' alone only free points take part. A pair is reported only where its smaller key is at home, so none comes twice. Cells too
    small to divide but full are split into blocks: each block probes with a part of the points.
    """
    pts = located(points, space, x, y).select(
        F.col(key).alias("a"), F.col(space).cast("string").alias("space"), F.col(ident).cast("string").alias("ident"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(free), F.lit(False)).alias("free")
    )
    if "vicino" not in cases:
        pts = pts.where("free")
    forest = layout(pts, "space", "x", "y", radius)

    @F.arrow_udf("array<bigint>")
    def of_boxes(s: pa.Array, bucket: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        v = [np.asarray(c) for c in (x0, y0, x1, y1)]
        return forest.groups(s, np.asarray(bucket), np.zeros(len(v[0]), np.int64), *v, v[0], v[1])

    left = in_groups(pts, forest, radius)
    ring = F.transform(F.filter(rings, lambda r: r.isNotNull()), lambda r: F.filter(r, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull()))
    flat = (
        regions.where(F.col(rings).isNotNull() & F.col(unit).isNotNull() & F.col(space).isNotNull())
        .select(F.col(unit).alias("unit"), F.col(space).cast("string").alias("space"), ring.alias("r"))
        .select("unit", "space", F.transform(F.flatten("r"), lambda p: p["x"].cast("double")).alias("xs"), F.transform(F.flatten("r"), lambda p: p["y"].cast("double")).alias("ys"), F.transform("r", lambda q: F.size(q)).alias("sizes"))
        .where(F.size("xs") > 2)
        .select("*", F.array_min("xs").alias("x0"), F.array_min("ys").alias("y0"), F.array_max("xs").alias("x1"), F.array_max("ys").alias("y1"))
    )
    right = flat.withColumn("code", F.explode(of_boxes("space", _bucket(), "x0", "y0", "x1", "y1"))).withColumn("grp", F.expr("code div 2")).drop("code")

    def search(t: pa.Table, g: pa.Table) -> pa.Table:
        out = []
        for case in cases:
            a, b = _within(t, g) if case == "dentro" else _near(t, radius) if len(t) else ([], [])
            out.append(pa.table({"caso": pa.array([case] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}))
        return pa.concat_tables(out)

    return left.groupBy("grp").cogroup(right.groupBy("grp")).applyInArrow(search, "caso string, a bigint, b bigint")


def local_statistics(points: DataFrame, radius: float, k: int, *, key: str, space: str, x: str, y: str, z: str) -> DataFrame:
    """Of each located point with a z: how many others lie within ``radius``, at most the ``k`` nearest, and the median and MAD of their z.

    (a, z, vicini, mediana, mad); ties in distance go to the smaller key. Groups and R-tree as in
    ``near_and_within``; the search radius starts where about k points are expected over the fine cells
    that hold points (so stray coordinates don't stretch it) and doubles up to ``radius`` for the points
    that have not found k, so dense places are not searched whole.
    """
    pts = located(points.where(F.col(z).isNotNull()), space, x, y).select(F.col(key).alias("a"), F.col(space).cast("string").alias("space"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    forest = layout(pts, "space", "x", "y", radius)

    def run(t: pa.Table) -> pa.Table:
        a, px, py, pz, home = (t.column(c).to_numpy() for c in ("a", "x", "y", "z", "home"))
        s = _codes(t.column("space"))
        tree = RTree(s, px, py, px, py)
        probe = np.flatnonzero(home)
        count, med, mad = np.zeros(len(probe), np.int64), np.full(len(probe), np.nan), np.full(len(probe), np.nan)
        side = radius / 32
        area = len(np.unique(np.stack([s, np.floor(px / side), np.floor(py / side)]), axis=1).T) * side**2
        r = min(radius, math.sqrt((k + 1) * area / max(1, len(px)) / math.pi))
        open_ = np.arange(len(probe))
        while len(open_):
            again = []
            for lo in range(0, len(open_), 4000):
                part = open_[lo : lo + 4000]
                i = probe[part]
                pairs = [np.zeros((2, 0), np.int64), *(np.stack(p) for p in tree.probe(s[i], px[i] - r, py[i] - r, px[i] + r, py[i] + r))]
                q, n = np.concatenate(pairs, axis=1)
                d2 = (px[i[q]] - px[n]) ** 2 + (py[i[q]] - py[n]) ** 2
                ok = (d2 <= r * r) & (n != i[q]) & (a[n] != a[i[q]])
                q, n, d2 = q[ok], n[ok], d2[ok]
                o = np.lexsort((a[n], d2, q))
                q, n = q[o], n[o]
                got = np.bincount(q, minlength=len(part))
                rank = np.arange(len(q)) - np.repeat(np.cumsum(got) - got, got)
                keep = rank < k
                done = (got >= k) | (r >= radius)
                near = np.full((len(part), k), np.nan)
                near[q[keep], rank[keep]] = pz[n[keep]]
                some = np.flatnonzero(done & (got > 0))
                count[part[done]] = np.minimum(got, k)[done]
                if len(some):
                    m = np.nanmedian(near[some], axis=1)
                    med[part[some]] = m
                    mad[part[some]] = np.nanmedian(np.abs(near[some] - m[:, None]), axis=1)
                again.append(part[~done])
            open_ = np.concatenate(again)
            r = min(radius, r * 2)
        return pa.table({"a": pa.array(a[probe], pa.int64()), "z": pa.array(pz[probe]), "vicini": pa.array(count), "mediana": pa.array(med, from_pandas=True), "mad": pa.array(mad, from_pandas=True)})

    return in_groups(pts, forest, radius).groupBy("grp").applyInArrow(run, "a bigint, z double, vicini bigint, mediana double, mad double")


def low_outliers(stats: DataFrame, least: int = 4, floor: float = 0.10) -> DataFrame:
    """Points lower than their neighbours allow: z < median - max(floor, 3 x 1.4826 x MAD), with at least ``least`` neighbours."""
    return stats.where((F.col("vicini") >= least) & (F.col("z") < F.col("mediana") - F.greatest(F.lit(floor), F.col("mad") * 3 * 1.4826)))
