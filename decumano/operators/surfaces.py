"""Surfaces and volumes of units: kriging, triangulation, cuts, layers and walls, one unit a task."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import BITS
from .spatial import inside

#: Fixed values that results depend on, in metres: duplicates; points and extent that make a trend; limits of the
#: range, and the range of fewer than three points; nugget; least variance; targets at once.
DEDUPE, TREND_POINTS, TREND_SPREAD, RANGE, RANGE_DEFAULT, NUGGET, LEAST_VARIANCE, CHUNK = 0.02, 8, 1.0, (0.45, 3.0), 1.5, (0.003**2, 1e-3), 1e-4, 4000
LEAST_THICKNESS, DEFAULT_THICKNESS, DEFAULT_DEPTH, RIM_MARGIN = 0.004, 0.10, 0.20, 0.03
#: The step of a plan under 3 and 20 square metres and above, and the most steps around it; the wall of a
#: cut as a share of its median depth and of its half width, its most and least; the taper of a layer at its edge.
STEPS, MOST_STEPS = ((3.0, 0.06), (20.0, 0.10), (math.inf, 0.16)), 4000
WALL_DEPTH, WALL_WIDTH, WALL_MOST, WALL_LEAST = 0.6, 0.9, 1.1, 0.04
TAPER_LEAST, TAPER_WIDTH = 0.25, 0.3
#: Samples of one equation system. More are taken by tiles: each tile sees the samples within three ranges of it, where
#: the covariance has fallen to exp(-9).
MOST_SAMPLES = 1500
#: Points whose distances are first taken all at once.
FEW = 500
#: Levels of one unit that one task holds. Units with more (one may hold a tenth of all) are averaged on a grid first.
MOST_LEVELS = 50_000


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each point of ``a`` to each of ``b``."""
    return (a[:, 0, None] - b[:, 0]) ** 2 + (a[:, 1, None] - b[:, 1]) ** 2


def apart(xy: np.ndarray, least: float = DEDUPE) -> np.ndarray:
    """Which points stay if each one within ``least`` of an earlier one that stays is dropped."""
    if len(xy) <= FEW and (_squares(xy, xy) + np.eye(len(xy)) > least * least).all():
        return np.ones(len(xy), bool)
    cells: dict[tuple[int, int], list[int]] = {}
    keep = np.ones(len(xy), bool)
    for i, ((x, y), (cx, cy)) in enumerate(zip(xy.tolist(), np.floor(xy / least).astype(np.int64).tolist())):
        for j in (j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((cx + a, cy + b), ())):
            if (xy[j, 0] - x) ** 2 + (xy[j, 1] - y) ** 2 <= least * least:
                keep[i] = False
                break
        if keep[i]:
            cells.setdefault((cx, cy), []).append(i)
    return keep


def _nearest(a: np.ndarray) -> np.ndarray:
    """Distance of each point to its nearest other one."""
    out = np.empty(len(a))
    for k in range(0, len(a), 500):
        d2 = _squares(a[k : k + 500], a)
        d2[np.arange(len(d2)), np.arange(k, k + len(d2))] = np.inf
        out[k : k + 500] = np.sqrt(d2.min(1))
    return out


def _median(a: np.ndarray) -> float:
    a = np.sort(a)
    return float(a[(len(a) - 1) // 2] + a[len(a) // 2]) / 2


def krige(xy: np.ndarray, z: np.ndarray, to: np.ndarray, most: int = MOST_SAMPLES) -> np.ndarray:
    """Simple kriging around a plane (or the median): gaussian covariance with a nugget.

    Of samples within 2 cm the first stays. A plane is fitted to eight or more that spread over a metre both ways.
    With more than ``most`` samples each tile of the targets is solved with those near it.
    """
    ok = np.isfinite(z) & np.isfinite(xy).all(1)
    xy, z = xy[ok], z[ok]
    if not len(z):
        return np.full(len(to), np.nan)
    d2 = _squares(xy, xy) + np.diag(np.full(len(xy), np.inf)) if len(xy) <= FEW else None
    if d2 is None or (d2 <= DEDUPE * DEDUPE).any():
        keep = apart(xy)
        xy, z = xy[keep], z[keep]
        d2 = None
    o = xy.sum(0) / len(xy)
    a, t = xy - o, to - o
    base = tb = None
    coef = _median(z)
    if len(z) >= TREND_POINTS and (a.max(0) - a.min(0) > TREND_SPREAD).all():
        base, tb = np.hstack([np.ones((len(z), 1)), a]), np.hstack([np.ones((len(t), 1)), t])
        coef, *_ = np.linalg.lstsq(base, z, rcond=None)
    res = z - (coef if base is None else base @ coef)
    near = np.sqrt(d2.min(1)) if d2 is not None and len(z) >= 3 else _nearest(a) if len(z) >= 3 else None
    r = min(max(2 * _median(near), RANGE[0]), RANGE[1]) if len(z) >= 3 else RANGE_DEFAULT
    s2 = max(float(res.var()), LEAST_VARIANCE)
    out = np.full(len(t), coef) if base is None else tb @ coef
    for at, q, rest in _tiles(t, a, res, 3 * r, most):
        p = t[at]
        w = np.linalg.solve(s2 * np.exp(_squares(q, q) / -(r**2)) + (NUGGET[0] + NUGGET[1] * s2) * np.eye(len(q)), rest)
        # -(p - q)² / r² as one product of matrices, relative to the middle of the targets: exact where it counts.
        mid = p.sum(0) / len(p)
        g = (q - mid).T / r
        q4 = np.vstack([2 * g, np.full(len(q), -1.0), -(g * g).sum(0)])
        for k in range(0, len(p), CHUNK):
            c = (p[k : k + CHUNK] - mid) / r
            cov = np.hstack([c, (c * c).sum(1)[:, None], np.ones((len(c), 1))]) @ q4
            out[at[k : k + CHUNK]] += np.exp(cov, out=cov) @ (s2 * w)
    return out


#: Widths to which samples are filled up so that their systems are solved together; more samples go one by one.
WIDTHS = (4, 8, 16, 32, 64)


def fits(samples: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float] | None]:
    """``krige`` of many samples (x, y, z) up to its targets: (sample points, weights, plane, squared range) of each.

    The plane has its height at 0, 0 of the first sample point and its slopes. None: no sample is left, or more than
    the largest of WIDTHS; ``krige`` does those.
    """
    out: list = [None] * len(samples)
    some = [np.isfinite(s).all() for s in samples]
    left = [s if ok else s[np.isfinite(s).all(1)] for s, ok in zip(samples, some)]
    size = np.array([len(s) for s in left], np.int64)
    for least, w in zip((0, *WIDTHS), WIDTHS):
        which = np.flatnonzero((size > least) & (size <= w))
        if not len(which):
            continue
        for again in (True, False):
            n = np.array([len(left[i]) for i in which])
            there = np.arange(w) < n[:, None]
            p = np.zeros((len(which), w, 3))
            p[there] = np.concatenate([left[i] for i in which])
            home = p[:, 0, :2].copy()
            x, y, z = p[:, :, 0] - home[:, :1], p[:, :, 1] - home[:, 1:], p[:, :, 2]
            d2 = (x[:, :, None] - x[:, None]) ** 2 + (y[:, :, None] - y[:, None]) ** 2
            both = there[:, :, None] & there[:, None]
            apart2 = np.where(both, d2, np.inf)
            apart2[:, np.arange(w), np.arange(w)] = np.inf
            if not again or not len(twice := np.flatnonzero((apart2 <= DEDUPE * DEDUPE).any((1, 2)))):
                break
            for i in which[twice]:
                left[i] = left[i][apart(left[i][:, :2])]
        ends = ((n - 1) // 2)[:, None], (n // 2)[:, None]
        median = lambda v: sum(np.take_along_axis(s, e, 1)[:, 0] for s in (np.sort(np.where(there, v, np.inf), 1),) for e in ends) / 2
        plane = np.stack([median(z), np.zeros(len(n)), np.zeros(len(n))], 1)
        wide = lambda v: np.where(there, v, -np.inf).max(1) - np.where(there, v, np.inf).min(1) > TREND_SPREAD
        if w >= TREND_POINTS and len(at := np.flatnonzero((n >= TREND_POINTS) & wide(x) & wide(y))):
            ok, m = there[at], n[at, None]
            mx, my, mz = (np.where(ok, v[at], 0).sum(1) / m[:, 0] for v in (x, y, z))
            ax, ay, az = (np.where(ok, v[at] - mean[:, None], 0) for v, mean in ((x, mx), (y, my), (z, mz)))
            xx, xy, yy, xz, yz = ((a * b).sum(1) for a, b in ((ax, ax), (ax, ay), (ay, ay), (ax, az), (ay, az)))
            det = xx * yy - xy * xy
            thin = det < 1e-4 * xx * yy  # almost on one line: by singular values, as krige does
            sx, sy = ((a * b - c * xy) / np.where(thin, 1, det) for a, b, c in ((xz, yy, yz), (yz, xx, xz)))
            for k in np.flatnonzero(thin):
                own = slice(0, n[at[k]])
                (_, sx[k], sy[k]), *_ = np.linalg.lstsq(np.stack([np.ones(n[at[k]]), ax[k, own], ay[k, own]], 1), z[at[k], own], rcond=None)
            plane[at] = np.stack([mz - sx * mx - sy * my, sx, sy], 1)
        res = np.where(there, z - (plane[:, :1] + plane[:, 1:2] * x + plane[:, 2:] * y), 0)
        mean = res.sum(1) / n
        s2 = np.maximum((np.where(there, res - mean[:, None], 0) ** 2).sum(1) / n, LEAST_VARIANCE)
        near = np.sqrt(np.minimum(apart2.min(2), 1e300))
        r2 = np.where(n >= 3, np.clip(2 * median(near), *RANGE), RANGE_DEFAULT) ** 2
        cov = np.where(both, s2[:, None, None] * np.exp(d2 / -r2[:, None, None]), 0)
        cov[:, np.arange(w), np.arange(w)] += np.where(there, NUGGET[0] + NUGGET[1] * s2[:, None], 1)
        weights = s2[:, None] * np.linalg.solve(cov, res[:, :, None])[:, :, 0]
        for k, i in enumerate(which.tolist()):
            out[i] = left[i][:, :2], weights[k, : n[k]], plane[k], r2[k]
    return out


def around(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle of the points, rows x, y, x² + y², 1 relative to it): the targets as factor of products of matrices."""
    mid = v.sum(0) / len(v)
    q = np.ones((4, len(v)))
    np.subtract(v.T, mid[:, None], out=q[:2])
    np.einsum("ij,ij->j", q[:2], q[:2], out=q[2])
    return mid, q


def fitted(fit: tuple[np.ndarray, np.ndarray, np.ndarray, float], mid: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Heights of one of ``fits`` at the points of ``around``."""
    xy, weights, (z0, sx, sy), r2 = fit
    g, (hx, hy) = xy - mid, mid - xy[0]
    to = np.empty((len(g), 4))
    np.multiply(g, 2 / r2, out=to[:, :2])
    to[:, 2] = -1 / r2
    np.einsum("ij,ij->i", g, g / -r2, out=to[:, 3])
    cov = to @ q
    out = weights @ np.exp(cov, out=cov)
    out += np.array([sx, sy, 0.0, z0 + sx * hx + sy * hy]) @ q
    return out


def _tiles(t: np.ndarray, a: np.ndarray, res: np.ndarray, reach: float, most: int):
    """(targets, samples, residuals) of each tile: one if the samples are few, else squares cut in four until they are.

    A tile narrower than a sixth of ``reach`` is cut no further; its samples are averaged on a grid of ``most`` cells.
    """
    todo = [(np.arange(len(t)), np.arange(len(a)))] if len(t) else []
    while todo:
        at, near = todo.pop()
        if len(near) <= most:
            yield at, a[near], res[near]
            continue
        lo, hi = t[at].min(0), t[at].max(0)
        near = near[((a[near] >= lo - reach) & (a[near] <= hi + reach)).all(1)]
        if len(near) <= most or (hi - lo).max() < reach / 6:
            q, rest = a[near], res[near]
            if len(near) > most:
                side = max(float((np.ptp(q, axis=0)).max()), 1e-9) / math.sqrt(most)
                _, cell = np.unique(np.floor((q - q.min(0)) / side).astype(np.int64), axis=0, return_inverse=True)
                n = np.bincount(cell.ravel())
                q, rest = np.stack([np.bincount(cell.ravel(), q[:, k]) / n for k in (0, 1)], 1), np.bincount(cell.ravel(), rest) / n
            if len(q):
                yield at, q, rest
            continue
        q = (t[at] >= (lo + hi) / 2) @ np.array([1, 2])
        todo.extend((at[q == k], near) for k in range(4) if (q == k).any())


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles of points (Bowyer-Watson), counter-clockwise; duplicates must be gone.

    Points come from left to right, so a triangle whose circle lies left of the next point is final and is taken
    out; all other circles are tested at once. Slots of triangles that are gone are used again.
    """
    n = len(p)
    c, s = p.mean(0), max(np.ptp(p, axis=0).max(), 1e-6) * 20
    q = np.vstack([p, c + [-s, -s], c + [s, -s], c + [0, s]])
    size = 256
    tri, cx, cy, r2 = np.full((size, 3), -1, np.int64), np.zeros(size), np.zeros(size), np.full(size, -1.0)
    free, final = list(range(size - 1, 0, -1)), []
    tri[0] = (n, n + 1, n + 2)
    cx[0], cy[0], r2[0] = _circle(q, n, n + 1, n + 2)
    for step, i in enumerate(np.lexsort((p[:, 1], p[:, 0])).tolist()):
        if step % 32 == 0:
            live = np.flatnonzero(r2 >= 0)
            done = live[cx[live] + np.sqrt(r2[live]) < q[i, 0] - 1e-9]
            final.append(tri[done].copy())
            r2[done] = -1.0
            free.extend(done.tolist())
        bad = np.flatnonzero((cx - q[i, 0]) ** 2 + (cy - q[i, 1]) ** 2 < r2 * (1 + 1e-12))
        edges: dict[tuple[int, int], int] = {}
        for a, b, d in tri[bad].tolist():
            for e in ((a, b), (b, d), (d, a)):
                k = e if e[0] < e[1] else (e[1], e[0])
                edges[k] = edges.get(k, 0) + 1
        r2[bad] = -1.0
        free.extend(bad.tolist())
        for (a, b), times in edges.items():
            if times == 1 and abs(_cross(q, a, b, i)) > 1e-18:
                if not free:
                    free = list(range(2 * size - 1, size - 1, -1))
                    tri, cx, cy, r2 = np.vstack([tri, np.full((size, 3), -1, np.int64)]), np.append(cx, np.zeros(size)), np.append(cy, np.zeros(size)), np.append(r2, np.full(size, -1.0))
                    size *= 2
                k = free.pop()
                tri[k] = (a, b, i)
                cx[k], cy[k], r2[k] = _circle(q, a, b, i)
    out = np.vstack([*final, tri[r2 >= 0]])
    out = out[out.max(1) < n]
    a, b, d = q[out[:, 0]], q[out[:, 1]], q[out[:, 2]]
    flip = (b[:, 0] - a[:, 0]) * (d[:, 1] - a[:, 1]) - (d[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]) < 0
    out[flip] = out[flip][:, [0, 2, 1]]
    return out


def _cross(q: np.ndarray, a: int, b: int, c: int) -> float:
    return (q[b, 0] - q[a, 0]) * (q[c, 1] - q[a, 1]) - (q[c, 0] - q[a, 0]) * (q[b, 1] - q[a, 1])


def _circle(q: np.ndarray, a: int, b: int, c: int) -> tuple[float, float, float]:
    (ax, ay), (bx, by), (cx, cy) = q[a], q[b], q[c]
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-18:
        return 0.0, 0.0, math.inf
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x, y = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
    return x, y, (ax - x) ** 2 + (ay - y) ** 2


def boundary_step(area: float) -> float:
    return next(step for most, step in STEPS if area < most)


def _polygon(rings: list[np.ndarray]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    a = np.vstack(rings)
    b = np.vstack([np.roll(r, -1, 0) for r in rings])
    return (a[:, 0], a[:, 1], b[:, 0], b[:, 1]), np.array([0, len(a)])


def ring_depths(rings: list[np.ndarray]) -> list[int]:
    """How many of the other rings each ring lies in."""
    return [sum(bool(inside(r[:1, 0], r[:1, 1], np.zeros(1, int), *_polygon([o]))[0]) for j, o in enumerate(rings) if j != i) for i, r in enumerate(rings)]


def area_of(rings: list[np.ndarray]) -> float:
    """Even-odd area of rings that do not cross: outer rings less their holes."""
    out = 0.0
    for r, depth in zip(rings, ring_depths(rings) if len(rings) > 1 else [0]):
        q = r - r[0]  # map coordinates would lose their last digits in the products
        s = abs(float((q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1]).sum())) / 2
        out += s if depth % 2 == 0 else -s
    return out


def mesh(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a plan: outline made dense, a grid inside, triangles outside left out.

    The step goes by the area (``STEPS``), at most MOST_STEPS around the plan; the grid inside has at most about
    ten thousand points.
    """
    area = area_of(rings)
    step = max(boundary_step(area), sum(np.linalg.norm(r - np.roll(r, -1, 0), axis=1).sum() for r in rings) / MOST_STEPS, math.sqrt(area / 10_000))
    pts = []
    for r in rings:
        for p, q in zip(r, np.roll(r, -1, 0)):
            k = max(1, math.ceil(np.linalg.norm(q - p) / step))
            pts.append(p + (q - p) * (np.arange(k) / k)[:, None])
    edge = np.vstack(pts)
    lo, hi = edge.min(0), edge.max(0)
    gx, gy = np.meshgrid(np.arange(lo[0] + step / 2, hi[0], step), np.arange(lo[1] + step / 2, hi[1], step))
    g = np.stack([gx.ravel() + (np.arange(gx.size) // gx.shape[1] % 2 * step / 4 if gx.size else 0), gy.ravel()], 1)
    poly = _polygon(rings)
    if len(g):
        g = g[inside(g[:, 0], g[:, 1], np.zeros(len(g), int), *poly)]
    if len(g):
        far = np.concatenate([np.sqrt(((g[k : k + 500, None] - edge[None]) ** 2).sum(-1)).min(1) for k in range(0, len(g), 500)]) > step * 0.4
        g = g[far]
    v = np.unique(np.round(np.vstack([edge, g]) / 0.002).astype(np.int64), axis=0) * 0.002
    o = v.mean(0)
    f = delaunay(v - o)
    if len(f):
        m = v[f].mean(1)
        f = f[inside(m[:, 0], m[:, 1], np.zeros(len(m), int), *poly)]
    return v, f


#: Vertices lie on a grid of 2 mm. Plans with a wider step than WIDEST are triangulated one by one.
SNAP, WIDEST = 0.002, 0.5
#: Steps to the left of an edge at which its third point is searched first.
AHEAD = 0.35
#: Plans that are triangulated at once.
AT_ONCE = 24


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): all whole numbers from lo[i] to below hi[i], with i."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def meshes(plans: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``mesh`` of many plans at once: same vertices, Delaunay triangles of them inside the outline.

    The grid inside is regular, so its triangles whose circle holds no point of the outline are known beforehand.
    From the outline and from the rim of those, the triangle on the free side of each edge is searched among the
    points around it, for all edges of all plans together, until no edge is free. The points are whole numbers of
    2 mm, so circles compare exactly; points on one circle are told apart by a weight too small to matter else.
    Where triangles do not fill the outline to the last square (a side of it is no Delaunay edge), and where the
    step is very wide, the plan goes through ``mesh``.
    """
    out: list = [None] * len(plans)
    for k in range(0, len(plans), AT_ONCE):
        out[k : k + AT_ONCE] = _meshes(plans[k : k + AT_ONCE])
    return [mesh(p) if m is None else m for p, m in zip(plans, out)]


def _meshes(plans: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    nu = len(plans)
    rings = [r for p in plans for r in p]
    ring_unit = np.repeat(np.arange(nu), [len(p) for p in plans])
    odd_ring = np.array([d for p in plans for d in ([0] if len(p) == 1 else ring_depths(p))]) % 2 == 1
    n = np.array([len(r) for r in rings])
    last = np.cumsum(n) - 1
    p = np.vstack(rings)
    x, y = p[:, 0].copy(), p[:, 1].copy()
    ring = np.repeat(np.arange(len(rings)), n)
    unit = ring_unit[ring]
    nxt = np.arange(1, len(x) + 1)
    nxt[last] = last - n + 1
    dx, dy = x[nxt] - x, y[nxt] - y
    rx, ry = x - x[(last - n + 1)[ring]], y - y[(last - n + 1)[ring]]
    turn = np.bincount(ring, rx * ry[nxt] - rx[nxt] * ry)
    area = np.bincount(ring_unit, np.where(odd_ring, -1, 1) * np.abs(turn) / 2)
    length = np.sqrt(dx * dx + dy * dy)
    step = np.maximum(np.maximum([boundary_step(a) for a in area], np.bincount(unit, length) / MOST_STEPS), np.sqrt(np.maximum(area, 0) / 10_000))
    fit = step <= WIDEST
    if not fit.all():
        rest = iter(_meshes([p for p, ok in zip(plans, fit) if ok]) if fit.any() else ())
        return [next(rest) if ok else None for ok in fit]

    # The outline, made dense and snapped; coordinates relative to the plan's corner.
    first = np.cumsum(np.bincount(unit, minlength=nu)) - np.bincount(unit, minlength=nu)
    lox, hix, loy, hiy = (f.reduceat(c, first) for c in (x, y) for f in (np.minimum, np.maximum))
    ox, oy = np.round(lox / SNAP).astype(np.int64), np.round(loy / SNAP).astype(np.int64)
    k = np.maximum(np.ceil(length / step[unit]), 1).astype(np.int64)
    seg, i = _ranges(np.zeros_like(k), k)
    ex, ey, eu = x[seg] + dx[seg] * (i / k[seg]), y[seg] + dy[seg] * (i / k[seg]), unit[seg]
    ix, iy = np.round(ex / SNAP).astype(np.int64) - ox[eu], np.round(ey / SNAP).astype(np.int64) - oy[eu]
    key = (eu << 42) | (ix << 21) | iy
    order = np.argsort(key)
    fresh = np.diff(key[order], prepend=-1) > 0
    vert = np.empty(len(key), np.int64)
    vert[order] = np.cumsum(fresh) - 1
    eplace = order[fresh]
    ne = len(eplace)
    m = np.bincount(ring[seg], minlength=len(rings))
    after = np.arange(1, len(ex) + 1)
    after[np.cumsum(m) - 1] = np.cumsum(m) - m

    # The grid: cells of one plan lie row by row, with a margin of two.
    gx, gy = lox + step / 2, loy + step / 2
    sx, sy = (gx + step) - gx, (gy + step) - gy
    nx, ny = (np.maximum(np.ceil((h - g) / step), 0).astype(np.int64) for h, g in ((hix, gx), (hiy, gy)))
    wide = nx + 4
    cells = wide * (ny + 4)
    base = np.cumsum(cells) - cells
    total = int(cells.sum())
    shift = lambda u, r: (r % 2) * step[u] / 4
    cell = lambda u, r, c: base[u] + (r + 2) * wide[u] + c + 2
    at, r = _ranges(np.clip(np.floor((np.minimum(y, y[nxt]) - gy[unit]) / sy[unit]), 0, ny[unit]).astype(np.int64), np.clip(np.ceil((np.maximum(y, y[nxt]) - gy[unit]) / sy[unit]) + 1, 0, ny[unit]).astype(np.int64))
    u = unit[at]
    yr = gy[u] + r * sy[u]
    span = (y[at] > yr) != (y[nxt[at]] > yr)
    at, r, u, yr = at[span], r[span], u[span], yr[span]
    cross = dx[at] * (yr - y[at]) / dy[at] + x[at]
    left = np.clip(np.ceil((cross - shift(u, r) - gx[u]) / sx[u]), 0, nx[u]).astype(np.int64)
    row = cell(u, r, 0)
    alive = (np.cumsum(np.bincount(row, minlength=total + 1) - np.bincount(row + left, minlength=total + 1)) & 1).astype(bool)
    r = np.rint((ey - gy[eu]) / sy[eu]).astype(np.int64)
    c = np.rint((ex - gx[eu] - shift(eu, r)) / sx[eu]).astype(np.int64)
    near = ((gx[eu] + c * sx[eu] + shift(eu, r) - ex) ** 2 + (gy[eu] + r * sy[eu] - ey) ** 2 <= (0.4 * step[eu]) ** 2) & (r >= 0) & (c >= 0) & (r < ny[eu]) & (c < nx[eu])
    alive[cell(eu, r, c)[near]] = False
    q = np.flatnonzero(alive)
    qu = np.repeat(np.arange(nu), np.add.reduceat(alive[:total], base, dtype=np.int64))
    qr, qc = (q - base[qu]) // wide[qu] - 2, (q - base[qu]) % wide[qu] - 2
    number = np.full(total + 1, -1)
    number[q] = ne + np.arange(len(q))
    vx = np.concatenate([ix[eplace], np.round((gx[qu] + qc * sx[qu] + shift(qu, qr)) / SNAP).astype(np.int64) - ox[qu]])
    vy = np.concatenate([iy[eplace], np.round((gy[qu] + qr * sy[qu]) / SNAP).astype(np.int64) - oy[qu]])
    vu = np.concatenate([eu[eplace], qu])

    # Each grid point has two triangles to its upper right; those with a point of the outline near their circle are not sure.
    sure = np.zeros((2, total + 1), bool)
    up = q + wide[qu] + (qr & 1)
    sure[0, q], sure[1, q] = alive[q + 1] & alive[up], alive[up] & alive[up - 1]
    fy = (ey - gy[eu]) / sy[eu]
    for j in (-1, 0, 1):
        r = np.floor(fy).astype(np.int64) + j
        fx = (ex - gx[eu] - shift(eu, r)) / sx[eu]
        for kind, mx, my in ((0, 0.5, 0.40625), (1, np.where(r & 1, 0.25, -0.25), 0.59375)):
            c0 = np.ceil(fx - mx - 0.72).astype(np.int64)
            for c in (c0, c0 + 1):
                hit = ((fx - mx - c) ** 2 + (fy - my - r) ** 2 < 0.72**2) & (r >= 0) & (c >= 0) & (r < ny[eu]) & (c < nx[eu])
                sure[kind, cell(eu, r, c)[hit]] = False
    s0, s1 = sure[0, q], sure[1, q]
    a0, b0, c0 = q[s0], q[s0] + 1, up[s0]
    a1, b1, c1 = q[s1], up[s1], up[s1] - 1
    below = a0 + 1 - wide[qu[s0]] - (1 - (qr[s0] & 1))
    rim = [(b0[z], a0[z]) for z in (~sure[1, below],)] + [(c0[z], b0[z]) for z in (~sure[1, b0],)] + [(a0[z], c0[z]) for z in (~sure[1, a0],)]
    rim += [(b1[z], a1[z]) for z in (~sure[0, a1],)] + [(c1[z], b1[z]) for z in (~sure[0, c1],)] + [(a1[z], c1[z]) for z in (~sure[0, a1 - 1],)]
    tri = [number[np.stack([a0, b0, c0], 1)], number[np.stack([a1, b1, c1], 1)]]
    full = np.bincount(np.concatenate([a0, b0, c0, a1, b1, c1]), minlength=total + 1)[q] == 6

    # Points that other triangles can have, by cell.
    some = np.concatenate([np.arange(ne), ne + np.flatnonzero(~full)])
    wx, wy = ((v * SNAP + o[vu] * SNAP - g[vu]) / s[vu] for v, o, g, s in ((vx, ox, gx, sx), (vy, oy, gy, sy)))
    of = np.concatenate([cell(vu[:ne], np.clip(np.floor(wy[:ne]).astype(np.int64), -2, ny[vu[:ne]] + 1), np.clip(np.floor(wx[:ne]).astype(np.int64), -2, nx[vu[:ne]] + 1)), q[~full]])
    order = np.argsort(of, kind="stable")
    points = some[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=total))])
    fxv, fyv = vx.astype(float), vy.astype(float)
    weight = ((vx * 73856093 ^ vy * 19349663) % 65521) * (1e-6 / 65521)

    along = (turn > 0) != odd_ring
    s, t = vert, vert[after]
    flip = ~along[ring[seg]]
    s, t = np.where(flip, t, s), np.where(flip, s, t)
    s, t = s[s != t], t[s != t]
    # A grid point that snapping has brought onto a side of the outline, or a step over it, becomes a corner of it.
    u = vu[s]
    k, pt = _around(np.floor((wy[s] + wy[t]) / 2).astype(np.int64), np.floor((wx[s] + wx[t]) / 2).astype(np.int64), 1, u, nx, ny, wide, base, begin, points)
    ux, uy, px, py = (vx[t] - vx[s])[k], (vy[t] - vy[s])[k], vx[pt] - vx[s[k]], vy[pt] - vy[s[k]]
    side, d2, dot = ux * py - uy * px, ux * ux + uy * uy, ux * px + uy * py
    on = (pt >= ne) & (side <= 0) & (side * side <= 4 * d2) & (dot > 0) & (dot < d2)
    k, pt = k[on], pt[on]
    more = t[k]
    t[k] = pt
    s, t = np.concatenate([s, pt]), np.concatenate([t, more])
    want = np.zeros(nu, np.int64)
    np.add.at(want, vu[s], vx[s] * vy[t] - vx[t] * vy[s])
    A = np.concatenate([s, *(number[e[0]] for e in rim)])
    Bv = np.concatenate([t, *(number[e[1]] for e in rim)])
    nv = len(vx)
    bad = np.zeros(nu, bool)
    for _ in range(100):
        ok = ~bad[vu[A]]
        A, Bv = A[ok], Bv[ok]
        if not len(A):
            break
        third = _third(A, Bv, fxv, fyv, weight, vu, wx, wy, step, nx, ny, wide, base, begin, points)
        lost = third < 0
        bad[vu[A[lost]]] = True
        a, b, d = A[~lost], Bv[~lost], third[~lost]
        low = np.minimum(np.minimum(a, b), d)
        a, b, d = (np.where(low == a, i, np.where(low == b, j, k)) for i, j, k in ((a, b, d), (b, d, a), (d, a, b)))
        key = (a * nv + b) * nv + d
        one = np.argsort(key)
        one = one[np.diff(key[one], prepend=-1) > 0]
        a, b, d = a[one], b[one], d[one]
        tri.append(np.stack([a, b, d], 1))
        s, t = np.concatenate([a, b, d]), np.concatenate([b, d, a])
        have = s * nv + t
        free = ~_among(have, A * nv + Bv) & ~_among(t * nv + s, have)
        A, Bv = t[free], s[free]
    else:
        bad[vu[A]] = True

    f = np.vstack(tri)
    fu = vu[f[:, 0]]
    a, b, d = f.T
    twice = (vx[b] - vx[a]) * (vy[d] - vy[a]) - (vx[d] - vx[a]) * (vy[b] - vy[a])
    got = np.zeros(nu, np.int64)
    np.add.at(got, fu, twice)
    bad |= got != want
    by = np.argsort(vu.astype(np.int16), kind="stable")  # a radix sort
    place = np.empty(nv, np.int32)
    place[by] = np.arange(nv, dtype=np.int32)
    v = np.stack([(vx + ox[vu])[by] * SNAP, (vy + oy[vu])[by] * SNAP], 1)
    v0 = np.searchsorted(vu[by], np.arange(nu + 1))
    fo = np.argsort(fu.astype(np.int16), kind="stable")
    f0 = np.searchsorted(fu[fo], np.arange(nu + 1))
    f = place[f[fo]]
    return [None if bad[j] else (v[v0[j] : v0[j + 1]], f[f0[j] : f0[j + 1]] - np.int32(v0[j])) for j in range(nu)]


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


def _around(row, col, reach: int, u, nx, ny, wide, base, begin, points) -> tuple[np.ndarray, np.ndarray]:
    """(which, point): the points in the cells up to ``reach`` from each given one."""
    lo, hi = np.clip(col - reach, -2, nx[u] + 1), np.clip(col + reach, -2, nx[u] + 1)
    e, r = _ranges(np.clip(row - reach, -2, ny[u] + 1), np.clip(row + reach, -2, ny[u] + 1) + 1)
    start = base[u[e]] + (r + 2) * wide[u[e]] + 2
    k, at = _ranges(begin[start + lo[e]], begin[start + hi[e] + 1])
    return e[k], points[at]


def _third(A, B, x, y, weight, vu, wx, wy, step, nx, ny, wide, base, begin, points) -> np.ndarray:
    """The point left of each edge A, B whose circle with it holds none of the others there; -1 if none is left of it.

    Searched in the cells around a point just left of the middle, one to each side, then in two, in eight, in all
    around the middle, until the circle (left of the edge) lies within.
    """
    out = np.full(len(A), -1)
    todo = np.arange(len(A))
    for reach in (1, 2, 8, 1 << 20):
        a, b = A[todo], B[todo]
        u = vu[a]
        ex, ey = wx[b] - wx[a], wy[b] - wy[a]
        long = np.sqrt(ex * ex + ey * ey)
        mx, my = wx[a] + ex / 2, wy[a] + ey / 2
        aside = (AHEAD if reach == 1 else 0) / np.maximum(long, 1e-9)
        cx, cy = mx - aside * ey, my + aside * ex
        mr, mc = np.floor(cy).astype(np.int64), np.floor(cx).astype(np.int64)
        e, p = _around(mr, mc, reach, u, nx, ny, wide, base, begin, points)
        dx, dy = x[b] - x[a], y[b] - y[a]
        d2 = dx * dx + dy * dy
        px, py = x[p] - x[a][e], y[p] - y[a][e]
        side = dx[e] * py - dy[e] * px
        left = side > 0
        e, p, px, py, side = e[left], p[left], px[left], py[left], side[left]
        lift = 1 + (weight[b] - weight[a]) / d2
        t = (px * px + py * py + weight[p] - weight[a][e] - lift[e] * (dx[e] * px + dy[e] * py)) / (2 * side)
        best = np.full(len(todo), np.inf)
        start = np.flatnonzero(np.diff(e, prepend=-1))  # e is in order
        if len(start):
            best[e[start]] = np.minimum.reduceat(t, start)
        hit = t == best[e]
        got = np.full(len(todo), -1)
        got[e[hit][::-1]] = p[hit][::-1]
        if reach < 1 << 20:
            c = np.where(best < np.inf, np.maximum(best, 0), 1e9)
            done = np.maximum(np.abs(mx - c * ey - cx), np.abs(my + c * ex - cy)) + np.sqrt(0.25 + c * c) * long < reach - 0.1
        else:
            done = np.ones(len(todo), bool)
        out[todo[done]] = got[done]
        todo = todo[~done]
        if not len(todo):
            break
    return out


def prism(v: np.ndarray, f: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[float, float]:
    a, b, c = f.T
    x, y, thick = v[:, 0], v[:, 1], top - bottom
    s = np.abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2
    return float(s.sum()), float(s @ (thick[a] + thick[b] + thick[c])) / 3


def smooth(t: np.ndarray) -> np.ndarray:
    t = np.clip(t, 0, 1)
    return t * t * (3 - 2 * t)


def edge_distances(p: np.ndarray, rings: list[np.ndarray], placed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Distance of each point to the nearest side of the rings, by products of matrices (sides by points).

    ``placed``: ``around`` of the points where it is there already.
    """
    mid, q = placed or around(p)
    a = np.concatenate(rings) - mid
    b = np.concatenate([x for r in rings for x in (r[1:], r[:1])]) - mid
    (ax, ay), (dx, dy) = a.T, (b - a).T
    l2 = np.maximum(dx * dx + dy * dy, 1e-18)
    n = len(a)
    to = np.zeros((2 * n, 4))
    to[:n, 0], to[:n, 1], to[:n, 3] = dx / l2, dy / l2, -(dx * ax + dy * ay) / l2
    to[n:, 0], to[n:, 1], to[n:, 2], to[n:, 3] = -2 * ax, -2 * ay, 1, ax * ax + ay * ay
    out = np.empty(len(p))
    for k in range(0, len(p), 2000):
        both = to @ q[:, k : k + 2000]
        t0 = both[:n]
        t = np.maximum(t0, 0)
        np.minimum(t, 1, out=t)
        t0 *= -2
        t0 += t
        t0 *= t
        t0 *= l2[:, None]
        t0 += both[n:]
        t0.min(0, out=out[k : k + 2000])
    np.maximum(out, 0, out=out)
    return np.sqrt(out, out=out)


def strategy(kinds: set[str], n: int, depth: float | None, thickness: float | None) -> str:
    """How a unit is built: from its levels, from a depth or thickness on record, or schematically."""
    if n and kinds & {"sup", "taglio", "rasatura", "orlo"}:
        return "misurata"
    if depth is not None:
        return "profondita"
    return "impilata" if thickness is not None else "schematica" if n else "nessuna"


def samples(cls: str, kinds: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Levels that make the top of a unit, those that make its bottom, and whether the top has levels of its own."""
    up, down = SIDES.get(cls, SIDES[""])
    of = lambda names: xyz[np.logical_or.reduce([kinds == k for k in names])]
    top = of(up)
    return top if len(top) else xyz, of(down), len(top) > 0


#: Kinds of levels of the top and of the bottom, by class.
SIDES = {"negativa": (("orlo", "sup"), ("taglio", "inf")), "muraria": (("rasatura", "sup"), ("fondazione", "inf")), "": (("sup",), ("inf",))}


def build(cls: str, rings: list[np.ndarray], kinds: np.ndarray, xyz: np.ndarray, made: tuple[np.ndarray, np.ndarray] | None = None, sides: tuple | None = None, measured: bool = True) -> dict:
    """Mesh, top and bottom of one unit; ``cls``: 'negativa', 'muraria' or other; ``kinds`` and ``xyz`` of its levels.

    ``made``: vertices and triangles of the plan where they are there already (``meshes``); ``sides``: what ``samples``
    gives, and their two ``fits``. Without ``measured``, area and volume stay out.
    """
    v, f = made or mesh(rings)
    (up, down, own), fit = sides or (samples(cls, kinds, xyz), (None, None))
    placed = around(v)
    at = lambda q, fit: krige(q[:, :2], q[:, 2], v) if fit is None else fitted(fit, *placed)
    how = "misurata"
    top = at(up, fit[0])
    low = at(down, fit[1]) if len(down) else None
    if cls == "negativa":
        deep = low if low is not None else top - DEFAULT_DEPTH
        how = "misurata" if low is not None else "schematica"
        d = np.maximum(top - deep, LEAST_THICKNESS)
        dist = edge_distances(v, rings, placed)
        wall = max(min(WALL_DEPTH * _middle(d), WALL_WIDTH * float(dist.max()), WALL_MOST), WALL_LEAST)
        bottom = top - d * smooth(dist / wall)
    elif cls == "muraria":
        bottom = low if low is not None else top - DEFAULT_DEPTH
        how = "misurata" if own and low is not None else "schematica"
    else:
        thick = np.maximum(top - low, LEAST_THICKNESS) if low is not None else np.full(len(v), DEFAULT_THICKNESS)
        how = "misurata" if low is not None else "impilata"
        taper = edge_distances(v, rings, placed)
        taper *= (1 - TAPER_LEAST) / TAPER_WIDTH
        taper += TAPER_LEAST
        bottom = top - thick * np.minimum(taper, 1, out=taper)
    bottom = np.minimum(bottom, top - LEAST_THICKNESS * (cls != "negativa"))
    out = {"v": v, "f": f, "top": top, "bottom": bottom, "strategia": how}
    if measured:
        out["area"], out["volume"] = prism(v, f, top, bottom) if len(f) else (0.0, 0.0)
    return out


def _middle(d: np.ndarray) -> float:
    """The median; not a number if one of them is none."""
    lo, hi = (len(d) - 1) // 2, len(d) // 2
    q = np.partition(d, (lo, hi, len(d) - 1))
    return float(q[-1]) if q[-1] != q[-1] else float(q[lo] + q[hi]) / 2


def reconstruct(plans: DataFrame, levels: DataFrame, most_levels: int = MOST_LEVELS, meshed: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """(unita, classe, strategia, vertici, facce, area, volume) of units with a plan and levels.

    Without ``meshed`` the same surfaces are made, but vertici and facce stay behind: punti is the number of vertices.
    ``columns``: just those of COLUMNS instead.

    ``plans``: (unita, classe, anelli), one row a unit; ``levels``: (unita, tipo, x, y, z). All levels of a unit meet
    in its task, but for units with more than ``most_levels``: those are averaged, kind by kind, on a grid of the
    unit that leaves about that many cells over the middle 98 % of its extent (2 cm at least), so that a hot unit
    neither fills a task nor loses a level, and a stray one does not stretch the grid.
    """
    placed = levels.where("unita is not null and x is not null and y is not null and z is not null").select("unita", "tipo", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    many = placed.groupBy(F.col("unita").alias("__u")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most_levels).select("__u").collect()  # one of most_levels rows at most
    thin = placed
    if many:
        hot = F.col("unita").isin([r["__u"] for r in many])
        p = lambda c, q: F.percentile_approx(c, q, 1000)
        ext = placed.where(hot).groupBy(F.col("unita").alias("__u")).agg(F.greatest(p("x", 0.99) - p("x", 0.01), p("y", 0.99) - p("y", 0.01)).alias("__s"))
        side = F.greatest(F.lit(DEDUPE), F.col("__s") / math.sqrt(most_levels))
        cell = placed.where(hot).join(F.broadcast(ext), F.col("unita") == F.col("__u")).groupBy("unita", "tipo", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
        thin = placed.where(~hot).unionByName(cell.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")).select("unita", "tipo", "x", "y", "z"))

    # Few bytes but much work a unit: a fixed number of partitions, so that they are not joined into one.
    parts = max(plans.sparkSession.sparkContext.defaultParallelism * 4, int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = thin.repartition(parts, "unita").groupBy("unita").agg(F.collect_list(F.struct("tipo", "x", "y", "z")).alias("livelli"))
    both = plans.select("unita", "classe", "anelli").repartition(parts, "unita").join(known.hint("merge"), "unita")
    kept = list(columns or (MESHED if meshed else MEASURED))
    return both.mapInArrow(lambda batches: _built(batches, kept), ", ".join(f"{c} {COLUMNS[c]}" for c in kept))


#: Columns of ``reconstruct``. PACKED is the mesh in few flat numbers, which the engine takes up in half the time:
#: x, y and thickness of the vertices, and of each triangle one number that holds its three vertices (BITS each).
COLUMNS = {"unita": "bigint", "classe": "string", "strategia": "string", "punti": "int", "vertici": "array<struct<x: double, y: double, alto: double, basso: double>>", "facce": "array<array<int>>", "area": "double", "volume": "double"}
COLUMNS |= {"xs": "array<double>", "ys": "array<double>", "spessori": "array<double>", "terne": "array<bigint>"}
MESHED, MEASURED = ("unita", "classe", "strategia", "vertici", "facce", "area", "volume"), ("unita", "classe", "strategia", "punti", "area", "volume")
PACKED = ("unita", "strategia", "xs", "ys", "spessori", "terne")


def _built(batches: Iterable[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        plans = _rings(whole.column("anelli"))
        for k in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(k, AT_ONCE)
            lists = b.column("livelli")
            at, level = lists.offsets.to_numpy(), lists.values
            lo, hi = int(at[0]), int(at[-1])
            xyz = np.stack([level.field(c)[lo:hi].to_numpy() for c in "xyz"], 1)
            at = at - lo
            # Which duplicate is the first does not depend on the shuffle; null kinds come last.
            code = level.field("tipo")[lo:hi].dictionary_encode()
            names = np.array([*code.dictionary.to_pylist(), None], dtype=object)
            place = np.empty(len(names), np.int64)
            place[sorted(range(len(names) - 1), key=lambda i: names[i])] = np.arange(len(names) - 1)
            place[-1] = len(names)
            which = code.indices.fill_null(len(names) - 1).to_numpy()
            order = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0], place[which], np.repeat(np.arange(len(at) - 1), np.diff(at))))
            kind, xyz = names[which][order], xyz[order]
            todo = [(unit, cls, rings, slice(at[i], at[i + 1])) for i, (unit, cls, rings) in enumerate(zip(b.column("unita").to_pylist(), b.column("classe").to_pylist(), plans[k : k + AT_ONCE])) if rings]
            if not todo:
                continue
            sides = [samples(cls or "", kind[s], xyz[s]) for _, cls, _, s in todo]
            fit = fits([q for up, down, _ in sides for q in (up, down)])
            measured = "area" in kept or "volume" in kept
            made = [build(cls or "", rings, kind[s], xyz[s], m, (sides[i], fit[2 * i : 2 * i + 2]), measured) for i, ((_, cls, rings, s), m) in enumerate(zip(todo, meshes([t[2] for t in todo])))]
            ends = lambda key: pa.array(np.cumsum([0] + [len(m[key]) for m in made]), pa.int32())
            full = {"unita": pa.array([t[0] for t in todo], pa.int64()), "classe": pa.array([t[1] for t in todo], pa.string()), "strategia": pa.array([m["strategia"] for m in made], pa.string())}
            if measured:
                full |= {c: pa.array([m[c] for m in made], pa.float64()) for c in ("area", "volume")}
            if "punti" in kept:
                full["punti"] = pa.array([len(m["v"]) for m in made], pa.int32())
            if "vertici" in kept or "xs" in kept:
                v, f = np.vstack([m["v"] for m in made]), np.vstack([m["f"].reshape(-1, 3) for m in made])
                x, y, top, bottom = v[:, 0], v[:, 1], np.concatenate([m["top"] for m in made]), np.concatenate([m["bottom"] for m in made])
            if "vertici" in kept:
                full["vertici"] = pa.ListArray.from_arrays(ends("v"), pa.StructArray.from_arrays([pa.array(c) for c in (x, y, top, bottom)], ["x", "y", "alto", "basso"]))
                full["facce"] = pa.ListArray.from_arrays(ends("f"), pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * 3, pa.int32()), pa.array(f.ravel(), pa.int32())))
            if "xs" in kept:
                full |= {c: pa.ListArray.from_arrays(ends("v"), pa.array(a)) for c, a in (("xs", x), ("ys", y), ("spessori", top - bottom))}
                full["terne"] = pa.ListArray.from_arrays(ends("f"), pa.array(f @ np.array([1, 1 << BITS, 1 << 2 * BITS], np.int64)))
            yield pa.RecordBatch.from_arrays([full[c] for c in kept], kept)


def _rings(column: pa.ListArray) -> list[list[np.ndarray]]:
    """The rings of each row that have three points or more; what is null stays out."""
    inner = column.values
    points = inner.values
    if any(a.null_count for a in (column, inner, points, points.field("x"), points.field("y"))):
        have = lambda ring: [[v["x"], v["y"]] for v in ring if v and v["x"] is not None and v["y"] is not None]
        rows = [[np.array(have(ring), float) for ring in rings or [] if ring] for rings in column.to_pylist()]
    else:
        xy = np.stack([points.field("x").to_numpy(), points.field("y").to_numpy()], 1)
        at, end = column.offsets.to_pylist(), inner.offsets.to_numpy().tolist()
        rows = [[xy[end[j] : end[j + 1]] for j in range(at[i], at[i + 1])] for i in range(len(column))]
    return [[r for r in row if len(r) > 2] for row in rows]


def snap_bases(built: DataFrame, edges: DataFrame, cell: float = 0.25) -> DataFrame:
    """(unita, minimo, corretto): of each unit over others, the least gap between its bottom and their tops per grid cell.

    ``edges``: (a, b), a above b. Where the gap is negative the bottom is raised to the top below.
    """
    g = built.select("unita", F.explode("vertici").alias("v")).groupBy("unita", F.floor(F.col("v.x") / cell).alias("cx"), F.floor(F.col("v.y") / cell).alias("cy")).agg(F.max("v.alto").alias("alto"), F.min("v.basso").alias("basso"))
    up = g.select(F.col("unita").alias("a"), "cx", "cy", "basso")
    low = g.select(F.col("unita").alias("b"), "cx", "cy", "alto")
    j = up.join(edges, "a").join(low, ["b", "cx", "cy"])
    return j.groupBy(F.col("a").alias("unita")).agg(F.min(F.col("basso") - F.col("alto")).alias("minimo"), F.sum((F.col("basso") < F.col("alto")).cast("int")).alias("corretto"))


def lowering(first: Sequence[float], last: Sequence[float]) -> float | None:
    """Median difference of two height samples; none with fewer than ten shared ones."""
    d = [a - b for a, b in zip(first, last) if a == a and b == b]
    return float(np.median(d)) if len(d) >= 10 else None
