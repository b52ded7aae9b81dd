import random

import numpy as np
import pytest
from decumano.operators import spatial as P

PTS = "riga bigint, id string, sito string, us bigint, x double, y double, grp bigint, home boolean"
REG = "us bigint, sito string, anelli array<array<struct<x: double, y: double>>>, code string"


def run(points, regions, radius=0.05):
    from pyspark.sql import functions as F

    q = points.withColumn("free", F.col("us").isNull())
    out = P.near_and_within(q, regions, radius, key="riga", space="sito", ident="id", x="x", y="y", free="free", unit="us", rings="anelli")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(points, regions, radius):
    pts = [p for p in points if p[2] is not None and p[4] is not None and p[5] is not None and (p[4], p[5]) != (0, 0)]
    out = set()
    for i, p in enumerate(pts):
        for q in pts[i + 1 :]:
            if p[2] == q[2] and p[1] is not None and q[1] is not None and p[1] != q[1] and (p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2 < radius**2:
                out.add(("vicino", min(p[0], q[0]), max(p[0], q[0])))
        if p[3] is None:
            for us, sito, rings, _ in regions:
                if sito == p[2] and us is not None and rings:
                    odd = False
                    for ring in rings:
                        for k, (x1, y1) in enumerate(ring):
                            x2, y2 = ring[(k + 1) % len(ring)]
                            if (y1 > p[5]) != (y2 > p[5]) and p[4] < (x2 - x1) * (p[5] - y1) / (y2 - y1) + x1:
                                odd = not odd
                    if odd:
                        out.add(("dentro", p[0], us))
    return out


@pytest.mark.parametrize("group_rows", [40, 40_000])
def test_against_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(P, "GROUP_ROWS", group_rows)
    rnd = random.Random(4)
    pts = []
    for i in range(700):
        site = rnd.choice(["a", "a", "a", "a", "b", "c", None])
        x, y = (rnd.choice([5.0, rnd.uniform(0, 4)]), rnd.uniform(0, 2)) if i % 3 else (round(rnd.gauss(2, 0.1), 3), round(rnd.gauss(1, 0.1), 3))
        pts.append((i, rnd.choice([f"q{i}", f"q{i % 50}", None]), site, rnd.choice([None, 7]), rnd.choice([x, x, x, None]) if i % 9 == 0 else x, y, 1, True))
    pts += [(1000, "z", "a", None, 0.0, 0.0, 1, True), (1001, "y", "a", None, float("nan"), 1.0, 1, True)]
    pts += [(2000 + k, f"s{k}", "b", None, 3.0, 3.0, 1, True) for k in range(12)]
    square = [(0.5, 0.5), (3.5, 0.5), (3.5, 1.5), (0.5, 1.5)]
    hole = [(1.5, 0.8), (2.5, 0.8), (2.5, 1.2), (1.5, 1.2)]
    regs = [(1, "a", [square, hole], "c"), (1, "a", [square, hole], "c"), (2, "b", [square], "c"), (3, "a", None, "c"), (None, "a", [square], "c"), (4, "c", [[(0.0, 0.0), (9.0, 9.0)]], "c"), (5, "b", [[(2.9, 2.9), (3.1, 2.9), (3.1, 3.1)], [(2.9, 3.1), (2.95, 3.1), (2.95, 3.0)]], "c")]
    points = spark.createDataFrame(pts, PTS)
    regions = spark.createDataFrame([(u, s, None if r is None else [[{"x": x, "y": y} for x, y in ring] for ring in r], c) for u, s, r, c in regs], REG)
    valid = [p for p in pts if not (p[4] is not None and np.isnan(p[4]))]
    assert run(points, regions, 0.06) == brute(valid, regs, 0.06)


def test_hot_cell_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 5)
    pts = spark.createDataFrame([(i, f"q{i}", "a", 1, 1.0, 1.0, 1, True) for i in range(300)] + [(1000 + i, f"r{i}", "a", 1, i / 10, 7.0, 1, True) for i in range(300)], PTS)
    regions = spark.createDataFrame([], REG)
    assert len(run(pts, regions)) == 300 * 299 // 2


def test_empty(spark):
    assert run(spark.createDataFrame([], PTS), spark.createDataFrame([], REG)) == set()


def test_rtree_finds_what_a_scan_finds():
    rnd = np.random.default_rng(3)
    x, y, s = rnd.random(1000), rnd.random(1000), rnd.integers(0, 3, 1000)
    tree = P.RTree(s, x, y, x + 0.01, y + 0.01)
    got = {(int(a), int(b)) for q, n in tree.probe(s, x, y, x, y) for a, b in zip(q, n)}
    want = {(i, j) for i in range(1000) for j in np.flatnonzero((s == s[i]) & (x <= x[i]) & (x + 0.01 >= x[i]) & (y <= y[i]) & (y + 0.01 >= y[i])).tolist()}
    assert got == want


def test_one_case_alone_gives_its_rows(spark):
    rnd = random.Random(5)
    pts = spark.createDataFrame([(i, f"p{i}", "s", None if i % 3 else 1, rnd.random(), rnd.random(), None, None) for i in range(400)], PTS)
    reg = spark.createDataFrame([(7, "s", [[(0.1, 0.1), (0.9, 0.1), (0.9, 0.9)]], None)], REG)
    from pyspark.sql import functions as F

    q = pts.withColumn("free", F.col("us").isNull())
    ask = lambda *c: {tuple(r) for r in P.near_and_within(q, reg, 0.05, key="riga", space="sito", ident="id", x="x", y="y", free="free", unit="us", rings="anelli", cases=c).collect()}
    both = ask("vicino", "dentro")
    assert ask("dentro") == {r for r in both if r[0] == "dentro"} and ask("vicino") == {r for r in both if r[0] == "vicino"} and len(both) > 100
