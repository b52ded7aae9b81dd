"""Literal cases of the reference operators, and every query against its SQL on the smallest tables."""

import math
import os
import statistics

import duckdb
import numpy as np
import pytest
from conftest import rows
from decumano.engine import Engine
from decumano.functions import scalar as S
from decumano.operators import geometry, graph, relational, spatial, state, surfaces, vocabulary
from decumano.plans import recipe
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"


def edges(spark, data):
    return spark.createDataFrame(data, "a bigint, b bigint")


def typed(spark, data):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "riga bigint, a bigint, phrase string, b bigint")


def test_inverse_forms_and_overwriting(spark):
    e, p = graph.normalise(typed(spark, [(2, "coperto da", 1), (3, "Tagliato  da", 2), (1, "copre", 2), (1, "taglia", 2), (5, "si lega a", 4), (4, "uguale a", 5), (6, "boh", 7), (8, "copre", 8), (None, "copre", 1)]))
    assert rows(e) == [(1, "taglia", 2), (2, "taglia", 3)] and rows(p) == [(4, 5)]


def test_levels_cycles_and_reduction(spark):
    lev, rest = graph.levels(edges(spark, [(1, 2), (2, 3), (1, 3), (4, 3), (1, 2)]))
    assert dict(map(tuple, lev.collect())) == {3: 0, 2: 1, 1: 2, 4: 1} and rest.isEmpty()
    assert rows(graph.transitive_reduction(edges(spark, [(1, 2), (2, 3), (1, 3)]))) == [(1, 2), (2, 3)]
    bad = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (7, 8)])
    assert rows(graph.strong_components(bad)) == [(1, 1), (2, 1), (3, 1)]
    assert not graph.levels(bad)[1].isEmpty()
    assert rows(graph.by_colour(bad)) == [(1, 1), (2, 1), (3, 1)]
    # A cycle that only a contraction closes: 1 over 2, 3 over 4, 2 with 3, 4 with 1.
    e, g = graph.condense(edges(spark, [(1, 2), (3, 4), (9, 1)]), edges(spark, [(2, 3), (1, 4)]))
    assert rows(e) == [(9, 1)] and dict(map(tuple, g.collect())) == dict.fromkeys((1, 2, 3, 4), 1)
    e, g = graph.condense(bad, edges(spark, [(7, 8)]))
    assert graph.levels(e)[1].isEmpty() and dict(map(tuple, g.collect())) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_strong_components_both_ways_agree(spark):
    import random

    rnd = random.Random(4)
    e = edges(spark, sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)}))
    assert rows(graph.strong_components(e)) == rows(graph.strong_components(e, most=0))


def test_phrases_of_the_archive(spark):
    from decumano.operators import phrases

    p = spark.createDataFrame([(x,) for x in ("Copre", "coopre", "cubr ea", "überdeckt von", "- sopra a", "copre in parte", "verfullt durch", "vedi diario", "04", None, "")], "f string")
    got = {r.f: (r.canonico, r.modo) for r in phrases.meanings(p, "f", phrases.built_in(spark)).collect()}
    assert got == {"Copre": ("copre", "esatto"), "coopre": ("copre", "vicino"), "cubr ea": ("copre", "vicino"), "überdeckt von": ("coperto da", "esatto"), "- sopra a": ("copre", "esatto"), "copre in parte": ("copre", "contenuto"), "verfullt durch": ("riempito da", "esatto"), "vedi diario": (None, None), "04": (None, None), "": (None, None)}


def test_relations_in_four_encodings(spark):
    r = recipe.Recipe(records="s", unit="US", relations={"sheet": "r", "a": "a", "rel": "rel", "b": "b", "columns": {"coperto da": "Coperto da"}, "text": ["Note"], "parents": {"riempie": "Dentro"}})
    s = spark.createDataFrame([("US 1", "2, 3", "taglia 4 e 5", None), ("2", None, "[['Copre', '3', '1', 'x']]", "US 9"), ("3", None, None, None), ("4", None, None, None), ("5", None, None, None), ("9", None, None, None)], "US string, `Coperto da` string, Note string, Dentro string")
    t = spark.createDataFrame([("4", "uguale a", "5"), ("4", "cut by", "9"), ("4", "boh", "9")], "a string, rel string, b string")
    got = rows(recipe.apply(r, {"s": s, "r": t})["relazioni"].select("a", "rel", "b"))
    assert got == [(1, "taglia", 4), (1, "taglia", 5), (2, "copre", 1), (2, "copre", 3), (2, "riempie", 9), (3, "copre", 1), (4, "uguale a", 5), (9, "taglia", 4)]


def test_components_against_union_find(spark):
    import random

    rnd = random.Random(3)
    pairs = [(rnd.randint(1, 150), rnd.randint(1, 150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(500, k) for k in range(501, 560)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, graph.components(edges(spark, pairs)).collect()))
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert graph.components(edges(spark, [])).count() == 0


def test_inferred_edges_walls_and_chronology(spark):
    e = edges(spark, [(11, 10), (12, 10), (21, 20)])
    nodes = spark.createDataFrame([(k,) for k in (10, 11, 12, 20, 21, 99)], "nodo bigint")
    assert (12, 11) in rows(graph.accept_inferred(e, edges(spark, [(12, 11), (12, 500)]), nodes))
    assert rows(graph.accept_inferred(e, edges(spark, [(10, 11)]), nodes)) == rows(e)
    w = spark.createDataFrame([(k,) for k in (2001, 2002, 2003, 2004, 2005)], "nodo bigint")
    ph = {r.nodo: r.fase for r in graph.wall_phases(edges(spark, [(2003, 2001), (2004, 1001), (1001, 2002), (1002, 2005)]), edges(spark, [(2001, 2002)]), w).collect()}
    assert ph == {2001: 0, 2002: 0, 2003: 1, 2004: 1, 2005: 0}
    s = spark.createDataFrame([(3, 2), (2, 1), (2, 3), (9, 0)], "nodo bigint, giorno bigint")
    c = {r.nodo: (r.giorno, r.stimato) for r in graph.chronology(edges(spark, [(1, 2), (2, 3), (1, 9)]), s, spark.createDataFrame([(9,)], "nodo bigint")).collect()}
    assert c == {1: (0, True), 2: (3, False), 3: (None, True)}


@pytest.mark.parametrize(("text", "want"), [("0,45 m", 0.45), ("45cm", 0.45), ("1.234,5", 1234.5), ("1 234,5", 1234.5), ("1,234.5", 1234.5), ("12 mm.", 0.012), ("12.05.2024", None), ("n.d.", None), ("-3", -3.0), (None, None)])
def test_measures(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(S.measure(F.col("t"))).first()[0]
    assert got == (want if want is None else pytest.approx(want))


def test_identifiers_relations_and_dates(spark):
    ids = {"US 1005": ("US", 1005, "", False), "1005a": ("", 1005, "a", False), "A/1005": ("A/", 1005, "", False), "1005-1006": ("", 1006, "", True), "n.d.": ("", None, "", True), "US 15 bis": ("US", 15, "bis", False)}
    df = spark.createDataFrame([(k,) for k in ids], "t string")
    assert {r.t: tuple(r.p) for r in df.select("t", S.identifier_parts(F.col("t")).alias("p")).collect()} == ids
    text = {
        "copre 12, 13; taglia 4": [("copre", 12), ("copre", 13), ("taglia", 4)],
        "fills 1005": [("riempie", 1005)],
        "= 22": [("uguale a", 22)],
        "under 3/4/5": [("coperto da", 3), ("coperto da", 4), ("coperto da", 5)],
        "copre 1001-1004": [("copre", 1001), ("copre", 1002), ("copre", 1003), ("copre", 1004)],
        "taglia 1010-12": [("taglia", 1010), ("taglia", 1011), ("taglia", 1012)],
        "Cut by 7 and 8. Same as 9": [("tagliato da", 7), ("tagliato da", 8), ("uguale a", 9)],
        "couvre 3 et 4 ; coupé par 9": [("copre", 3), ("copre", 4), ("tagliato da", 9)],
        "schneidet 5, verfüllt von 6": [("taglia", 5), ("riempito da", 6)],
        "cubre 2 y 3, cortado por 7": [("copre", 2), ("copre", 3), ("tagliato da", 7)],
        "> 4, < 6": [("copre", 4), ("coperto da", 6)],
        "si appoggia a US 1005a": [("si appoggia a", 1005)],
        "[['Copre', '1002', '1', 'Sito'], ['Taglia', '1003', '1', 'Sito']]": [("copre", 1002), ("taglia", 1003)],
        "": [],
        "niente 5": [],
        "copre 1-500": [("copre", 1), ("copre", 500)],
        "ricopre 12": [],
    }
    df = spark.createDataFrame([(k,) for k in text], "t string")
    got = {r.t: [tuple(x) for x in r.r] for r in df.select("t", S.relations_in_text(F.col("t")).alias("r")).collect()}
    assert got == {k: [(*S.RELATIONS[r], n) for r, n in v] for k, v in text.items()}
    assert len(spark.range(1).select(S.relations_in_text(F.lit("copre 1-500"), None)).first()[0]) == 500
    n = spark.createDataFrame([("12345678",), ("US 123456789012",), ("1005.0",), ("x",)], "t string").select(S.unit_number(F.col("t"))).collect()
    assert [r[0] for r in n] == [12345678, 123456789012, 1005, None]
    assert spark.range(12345678, 12345679).select(S.unit_number(F.col("id"))).first()[0] == 12345678
    d = spark.createDataFrame([("2025-09-30, 2025-09-24;2025-9-24 2025-13-01",)], "t string").select(S.dates_in(F.col("t"))).first()[0]
    assert d == ["2025-09-24", "2025-09-30"]
    assert spark.range(1).select(S.ddmm_date(F.lit("DEM_3006_x"), F.lit(2024))).first()[0] == "2024-06-30"
    codes = spark.createDataFrame([("A1",), ("US.B12",), ("GR2",), ("12",)], "t string").select(S.class_code(F.col("t")).alias("c")).collect()
    assert [tuple(r.c) for r in codes] == [("A", 1), ("B", 12), ("GR", 2), (None, None)]


def test_relational_details(spark):
    assert relational.clean_names(["us", "", None, "US", "us"]) == ["us", "Colonna 2", "Colonna 3", "US (2)", "us (3)"]
    df = spark.createDataFrame([(1, None, "x")], "`Periodo` int, `b` string, `c` string").toDF("Periodo", "periodo ", "c")
    assert relational.merge_same_columns(df).columns == ["Periodo", "c"]
    assert relational.rename_aliases(spark.createDataFrame([(1, 2)], "context int, us int").toDF("context", "altro"), {"us": ["context"]}).columns == ["us", "altro"]
    f = spark.createDataFrame([("c", 1, "u1", None), ("c", 2, "u2", 0.2)], "taglio string, ordine int, unita string, spessore double")
    t = relational.shared_thickness(f, F.lit(1.0))
    assert [round(r.spessore_stimato, 6) for r in t.orderBy("unita").collect()] == [0.8, 0.2]
    a, b = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, m string"), spark.createDataFrame([("x", "2"), ("z", "1")], "k string, m string")
    assert rows(relational.changed(a, b, "k", "m")) == [("x", "cambiata"), ("y", "tolta"), ("z", "nuova")]


def test_kriging_mesh_and_volume():
    rnd = np.random.default_rng(1)
    xy = rnd.random((20, 2)) * 5
    plane = lambda p: 10 + 0.3 * p[:, 0] - 0.2 * p[:, 1]
    to = rnd.random((50, 2)) * 5
    assert np.abs(surfaces.krige(xy, plane(xy), to) - plane(to)).max() < 2e-3
    rect = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)
    hole = np.array([[1, 1], [2, 1], [2, 2], [1, 2]], float)
    v, f = surfaces.mesh([rect, hole])
    area, vol = surfaces.prism(v, f, np.full(len(v), 1.0), np.full(len(v), 0.5))
    assert area == pytest.approx(11, rel=0.01) and vol == pytest.approx(area * 0.5, abs=1e-6)
    assert surfaces.area_of([rect, hole]) == pytest.approx(11)
    assert surfaces.lowering([1.0] * 12, [0.5] * 12) == 0.5 and surfaces.lowering([1.0], [0.0]) is None
    e = {}
    for t in f:
        for k in range(3):
            key = tuple(sorted((int(t[k]), int(t[(k + 1) % 3]))))
            e[key] = e.get(key, 0) + 1
    assert max(e.values()) == 2


def test_kriging_rules():
    xy = np.array([[0.0, 0.0], [0.01, 0.0], [5.0, 5.0]])
    assert surfaces.apart(xy).tolist() == [True, False, True]
    # On one line no plane is fitted; far from all samples the median is left.
    line = np.array([[k * 0.5, 0.0] for k in range(9)])
    z = np.array([1.0, 1, 1, 1, 2, 9, 9, 9, 9])
    assert surfaces.krige(line, z, np.array([[500.0, 500.0]]))[0] == pytest.approx(2.0)
    rnd = np.random.default_rng(2)
    many = rnd.random((900, 2)) * 12
    f = lambda p: np.sin(p[:, 0]) + 0.1 * p[:, 1]
    to = rnd.random((60, 2)) * 12
    assert np.abs(surfaces.krige(many, f(many), to, most=300) - surfaces.krige(many, f(many), to)).max() < 0.05
    hull = rnd.random((300, 2))
    t = surfaces.delaunay(hull)
    for a, b, c in hull[t[:40]]:
        m = np.array([b - a, c - a]) * 2
        o = np.linalg.solve(m, [(b @ b) - (a @ a), (c @ c) - (a @ a)])
        assert (np.linalg.norm(hull - o, axis=1) > np.linalg.norm(a - o) - 1e-9).all()


def test_plans_triangulated_together_equal_one_by_one():
    rnd = np.random.default_rng(5)
    plans = []
    for k in range(60):
        a = np.sort(rnd.random(5 + k % 9)) * 2 * np.pi
        star = np.stack([np.cos(a), np.sin(a)], 1) * (0.4 + rnd.random(len(a)))[:, None] * (0.5 + k % 4) + np.array([1675979.493, 4721296.978]) * (k % 2)
        plans.append([np.round(star, 3)])
    sq = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    # A hole, two parts, a hole in clockwise order, one thin plan, a plan without area, and one as wide as a country.
    plans += [[sq(0, 0, 3), sq(1, 1, 1)], [sq(0, 0, 1), sq(2, 0, 1.3)], [sq(0, 0, 3), sq(1, 1, 1)[::-1]], [np.array([[0, 0], [4, 0.01], [4, 0.03], [0, 0.02]])], [np.array([[0, 0], [1, 1], [2, 2.0]])], [sq(0, 0, 700)]]
    quick = 0
    for rings, got, (v, f) in zip(plans, surfaces._meshes(plans), surfaces.meshes(plans)):
        w, g = surfaces.mesh(rings)
        assert sorted(map(tuple, np.round(v, 6).tolist())) == sorted(map(tuple, np.round(w, 6).tolist()))
        if got is None:
            assert np.array_equal(f, g)
            continue
        quick += 1
        around = sum(np.linalg.norm(r - np.roll(r, -1, 0), axis=1).sum() for r in rings)
        assert abs(surfaces.prism(v, f, np.ones(len(v)), np.zeros(len(v)))[0] - surfaces.area_of(rings)) <= 0.002 * around
        # Each inner edge has two triangles, and no corner of one lies in the circle of the other.
        at = {}
        for t in f.tolist():
            for i in range(3):
                at[t[i], t[(i + 1) % 3]] = t[(i + 2) % 3]
        assert len(at) == 3 * len(f)
        p = np.round((v - v[0]) / 0.002)
        for (a, b), c in at.items():
            if (b, a) in at:
                m = np.array([[*(p[i] - p[at[b, a]]), ((p[i] - p[at[b, a]]) ** 2).sum()] for i in (a, b, c)])
                assert np.linalg.det(m) <= 1e-6 * np.abs(m).max() ** 1.5
    assert quick >= len(plans) - 6  # the others, with sides that are no Delaunay edges, went through ``mesh``


def test_kriging_with_a_stray_sample_at_map_distance():
    rnd = np.random.default_rng(3)
    xy, to = rnd.random((7, 2)) * 3, rnd.random((40, 2)) * 3
    z = rnd.random(7)
    far = np.vstack([xy, [[1.6e6, 4.7e6]]])
    a = surfaces.krige(far, np.append(z, np.median(z)), to)
    q, r = far, min(max(2 * np.median(surfaces._nearest(far)), 0.45), 3.0)
    base, tb = np.hstack([np.ones((8, 1)), q - q.mean(0)]), np.hstack([np.ones((40, 1)), to - q.mean(0)])
    coef, *_ = np.linalg.lstsq(base, np.append(z, np.median(z)), rcond=None)
    res = np.append(z, np.median(z)) - base @ coef
    s2 = max(res.var(), 1e-4)
    cov = lambda x: s2 * np.exp(-((x[:, None] - q[None]) ** 2).sum(-1) / r**2)
    assert np.abs(a - tb @ coef - cov(to) @ np.linalg.solve(cov(q) + (0.003**2 + 1e-3 * s2) * np.eye(8), res)).max() < 1e-6


def test_numbers_without_the_mesh_are_those_of_the_mesh(spark):
    sq = lambda x: [[{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]]
    p = spark.createDataFrame([(k, "negativa" if k % 3 else "deposito", sq(float(k))) for k in range(70)] + [(99, "x", None)], "unita bigint, classe string, anelli array<array<struct<x: double, y: double>>>")
    lv = spark.range(420).selectExpr("id % 70 as unita", "case id % 4 when 0 then 'sup' when 1 then 'inf' when 2 then null else 'altro' end as tipo", "id % 70 + id % 11 * 0.2 as x", "id % 7 * 0.3 as y", "5 + id % 13 * 0.1 as z")
    a = surfaces.reconstruct(p, lv, meshed=False).drop("classe")
    b = surfaces.reconstruct(p, lv)
    assert rows(a) == rows(b.select("unita", "strategia", F.size("vertici").alias("punti"), "area", "volume")) and a.count() == 70
    by = geometry.prism_volumes(b, "strategia").groupBy("strategia").count()
    assert rows(by) == rows(b.groupBy("strategia").count())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_volumes_by_strategy_build_the_model_once(spark):
    plan = __spark_entry__.queries()["f02_volumes_by_strategy"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CoGroup" not in plan


def test_samples_fitted_together_give_what_kriging_gives():
    rnd = np.random.default_rng(8)
    home = np.array([1.6e6, 4.7e6])
    sets = [np.hstack([home + rnd.random((n, 2)) * 4, 5 + rnd.random((n, 1))]) for n in (1, 2, 3, 4, 5, 7, 8, 9, 17, 33, 64, 65, 0)]
    sets += [np.repeat(s, 3, 0) + [0.0, 0.0, 0.3] for s in sets[3:9]]  # doubles: the first stays
    line = np.arange(12.0)[:, None] * [0.3, 0.2] + home
    sets += [np.hstack([line, np.sin(line[:, :1])]), np.hstack([line + rnd.random((12, 2)) * 1e-2, rnd.random((12, 1))])]
    sets += [np.vstack([sets[5], [np.nan, 0.0, 1.0]]), np.array([[0.0, 0.0, np.inf]]), np.vstack([[home[0] + 9e5, home[1], 5.0], sets[8]])]
    to = home + rnd.random((50, 2)) * 4
    placed, got = surfaces.around(to), surfaces.fits(sets)
    assert [i for i, f in enumerate(got) if f is None] == [11, 12, len(sets) - 2]  # too many, none, none that is a number
    for s, f in zip(sets, got):
        if f is not None:
            assert surfaces.fitted(f, *placed) == pytest.approx(surfaces.krige(s[:, :2], s[:, 2], to), abs=1e-6, rel=1e-6)


def test_packed_meshes_have_the_volumes_of_the_nested(spark):
    sq = lambda x: [[{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.5, 2.0), (0.0, 2.0))]]
    p = spark.createDataFrame([(k, ("negativa", "", "muraria", None)[k % 4], [*sq(float(k)), None] if k == 5 else sq(float(k))) for k in range(40)], "unita bigint, classe string, anelli array<array<struct<x: double, y: double>>>")
    lv = spark.range(400).selectExpr("id % 40 as unita", "case id % 3 when 0 then 'sup' when 1 then 'inf' else null end as tipo", "id % 40 + id % 11 * 0.2 as x", "id % 7 * 0.3 as y", "5 + id % 13 * 0.1 as z")
    nested = {r.unita: r for r in surfaces.reconstruct(p, lv).collect()}
    packed = geometry.prism_volumes(surfaces.reconstruct(p, lv, columns=surfaces.PACKED), "strategia").collect()
    assert len(packed) == len(nested) == 40
    for r in packed:
        m = nested[r.unita]
        assert (r.strategia, m.classe) == (m.strategia, ("negativa", "", "muraria", None)[r.unita % 4])
        assert r.area == pytest.approx(m.area, rel=1e-9) and r.volume == pytest.approx(m.volume, rel=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_volumes_by_strategy_take_up_flat_meshes(spark):
    df = __spark_entry__.queries()["f02_volumes_by_strategy"](spark, SF)
    made = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x)
    assert "terne" in made and "vertici" not in made and "volume" not in made
    n = {(r.strategia, r.n): (r.area, r.volume) for r in __spark_entry__.queries()["n05_unit_volumes"](spark, SF).groupBy("strategia").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.sum("volume").alias("volume")).collect()}
    got = {(r.strategia, r.unita): (r.area, r.volume) for r in df.collect()}
    assert set(got) == set(n) and all(got[k] == pytest.approx(n[k], abs=0.06 + 0.005 * k[1]) for k in n)


def test_hot_unit_is_averaged_on_a_grid(spark):
    sq = [[{"x": a, "y": b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]]
    p = spark.createDataFrame([(1, "deposito", sq)], "unita bigint, classe string, anelli array<array<struct<x: double, y: double>>>")
    lv = spark.range(3000).selectExpr("1L as unita", "'sup' as tipo", "cast(id % 55 as double) * 0.037 as x", "cast(id div 55 as double) * 0.037 as y", "5.0D as z").unionByName(spark.sql("select 1L as unita, 'sup' as tipo, 900.0D as x, 1.0D as y, 5.0D as z"))
    one = surfaces.reconstruct(p, lv, most_levels=500).first()
    assert one.volume == pytest.approx(surfaces.reconstruct(p, lv).first().volume, rel=1e-6) and one.area == pytest.approx(4.0, rel=0.01)


def test_fingerprints_ignore_the_order_and_labels_number_blanks(spark):
    a = spark.range(3000).selectExpr("id % 3 as k", "id as v")
    assert rows(relational.fingerprints(a, "k", [F.col("v")])) == rows(relational.fingerprints(a.orderBy(F.desc("v")).repartition(7), "k", [F.col("v")]))
    d = spark.createDataFrame([(1, None), (2, "A"), (3, " "), (4, "A"), (5, "sezione 1")], "o int, n string")
    assert [r.etichetta for r in relational.unique_labels(d, "n", "o", "sezione").orderBy("o").collect()] == ["sezione 1", "A", "sezione 2", "A (2)", "sezione 1 (2)"]


def test_reconstruct_and_snap(spark):
    sq = lambda x: [[{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]]
    p = spark.createDataFrame([(1, "deposito", sq(0.0)), (2, "deposito", sq(0.0)), (3, "muraria", sq(9.0)), (4, "x", None)], "unita bigint, classe string, anelli array<array<struct<x: double, y: double>>>")
    lv = [(1, "sup", x, y, 5.0) for x in (0.1, 1.9) for y in (0.1, 1.9)] + [(1, "inf", 1.0, 1.0, 4.5)] + [(2, "sup", 1.0, 1.0, 4.7), (2, "inf", 1.0, 1.0, 4.2)] + [(3, "rasatura", 10.0, 1.0, 3.0), (3, "fondazione", 10.0, 1.0, 2.0), (9, "sup", 0.0, 0.0, 1.0), (1, "sup", None, 1.0, 1.0)]
    m = surfaces.reconstruct(p, spark.createDataFrame(lv, "unita bigint, tipo string, x double, y double, z double"))
    got = {r.unita: r for r in m.collect()}
    assert set(got) == {1, 2, 3} and got[3].volume == pytest.approx(4.0, rel=0.02) and got[1].strategia == "misurata"
    v = {r.unita: r.volume for r in geometry.prism_volumes(m).collect()}
    assert v[1] == pytest.approx(got[1].volume, rel=1e-9)
    s = surfaces.snap_bases(m, edges(spark, [(1, 2)])).first()
    assert s.unita == 1 and s.minimo < 0 and s.corretto > 0


def test_local_outliers(spark):
    pts = [(i, "a", (i % 10) * 0.1, (i // 10) * 0.1 + 0.001, 5.0 + (i % 3) * 0.01) for i in range(100)] + [(200, "a", 0.55, 0.55, 3.0), (300, "b", 1.0, 1.0, 0.0), (301, "a", None, 1.0, 2.0)]
    st = spatial.local_statistics(spark.createDataFrame(pts, "riga bigint, sito string, x double, y double, z double"), 0.5, 12, key="riga", space="sito", x="x", y="y", z="z")
    got = {r.a: r for r in st.collect()}
    assert len(got) == 102 and got[200].vicini == 12 and got[300].vicini == 0
    assert [r.a for r in spatial.low_outliers(st).collect()] == [200]


def test_archive_condensed_with_contemporary_units(spark, tmp_path):
    """1 over 2, 2 equal to 3, 3 over 1: the pair closes the cycle; 5 and 6 are bonded, so one unit."""
    spark.createDataFrame([(1, 2), (3, 1), (2, 4), (5, 7), (8, 6)], "a bigint, b bigint").write.parquet(str(tmp_path / "grafo.parquet"))
    rel = [(1, 2, "uguale a", 3, False), (2, 6, "si lega a", 5, False), (3, 4, "copre", 9, True)]
    spark.createDataFrame(rel, "riga bigint, context bigint, relation string, related_context bigint, principale boolean").write.parquet(str(tmp_path / "relations.parquet"))
    got = __spark_entry__.queries()["j12_condensed"](spark, str(tmp_path))
    assert rows(got) == [(1, 4), (4, 9), (5, 7), (8, 5)]


def test_strong_components_by_search_equal_closure(spark):
    e = edges(spark, [(i * 7 % 60, i * 11 % 53) for i in range(90)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (105, 100), (104, 106)])
    want = rows(graph.strong_components(e))
    assert want and rows(graph.strong_components_by_search(e)) == want


def _archive(spark, tmp_path, levels, squares):
    """Tables of levels (riga, us, sito, tipo, x, y, z) and of square plans (riga, us, sito, x, y)."""
    spark.createDataFrame(levels, "riga bigint, us bigint, sito string, tipo string, x double, y double, z double").write.parquet(str(tmp_path / "quote_rilevate.parquet"))
    plans = [(r, u, s, [[(x - 1, y - 1), (x + 1, y - 1), (x + 1, y + 1), (x - 1, y + 1)]]) for r, u, s, x, y in squares]
    spark.createDataFrame(plans, "riga bigint, us bigint, sito string, anelli array<array<struct<x:double,y:double>>>").write.parquet(str(tmp_path / "us_poligoni.parquet"))
    return str(tmp_path)


def test_outliers_of_sparse_levels_by_brute_force(spark, tmp_path):
    q = [(i, None, "a", "sup", i % 6 * 4.0 + 0.5, i // 6 * 4.0 + 0.3 + i * 0.01, 5.0 + i % 3 * 0.01 - (i == 14)) for i in range(36)] + [(99, None, "a", "sup", 1e6, 1e6, -5.0)]
    want = {}
    for r, *_, x, y, z in q:
        near = [n[6] for _, n in sorted((((n[4] - x) ** 2 + (n[5] - y) ** 2, n[0]), n) for n in q if n[0] != r) if math.dist((n[4], n[5]), (x, y)) <= 15][:12]
        if len(near) >= 4 and z < statistics.median(near) - max(0.1, 3 * 1.4826 * statistics.median(abs(v - statistics.median(near)) for v in near)):
            want[r] = len(near)
    got = __spark_entry__.queries()["d06_low_outliers"](spark, _archive(spark, tmp_path, q, []))
    assert want == {14: 12} and {r.riga: r.vicini for r in got.collect()} == want


def test_heights_from_far_levels_by_brute_force(spark, tmp_path):
    q = [(i, None, "a", "sup", i % 5 * 9.0 + 0.5, i // 5 * 9.0 + i * 0.01, 5.0 + i * 0.1) for i in range(20)] + [(50 + i, None, "b", "sup", 1.0 + i, 2.0, 3.0 + i) for i in range(3)] + [(60, None, "a", "sup", math.inf, 1.0, 9.0)]
    plans = [(1, 1, "a", 10.0, 10.0), (2, 2, "a", 5000.0, -3000.0), (3, 3, "b", 4.0, 4.0), (4, 4, "c", 0.0, 0.0)]
    want = {}
    for r, _, s, x, y in plans[:3]:
        near = sorted((math.dist((n[4], n[5]), (x, y)), n[0], n[6]) for n in q if n[2] == s and n[4] < math.inf)[:12]
        w = [1 / (n[0] ** 2 + 4) for n in near]
        want[r] = (round(sum(a * n[2] for a, n in zip(w, near, strict=True)) / sum(w), 3), round(near[0][0], 4), len(near))
    got = __spark_entry__.queries()["e18_heights_by_distance"](spark, _archive(spark, tmp_path, q, plans))
    assert {r.id: (r.z, r.d_min, r.n) for r in got.collect()} == want


def test_vocabulary_recipe_and_state(spark):
    v = vocabulary.Vocabulary()
    assert v.recognise("Context Number")[0][0] == "unita" and v.recognise("Interpretazion")[0][0] == "definizione" and v.recognise("zzz") == []
    assert v.teach("zzz", "fase").recognise("ZZZ") == [("fase", 1.0)]
    sheets = {
        "ContextData": spark.createDataFrame([("10", "Cut", None, "Ditch", "0,9"), ("11", "Fill", "10", "Silting", "999999"), ("12", "Fill", "12", "Silting", "0.3")], "`Context Number` string, `Context Type` string, `Fill of` string, `Interpretation` string, `Context Depth` string"),
        "Finds": spark.createDataFrame([("11", "Bone"), ("77", "Flint")], "Context string, Material string"),
    }
    r = recipe.propose(sheets)
    assert (r.records, r.unit, r.linked) == ("ContextData", "Context Number", {"Finds": "Context"}) and r.relations == {"columns": {"riempie": "Fill of"}}
    again = recipe.adapt(recipe.Recipe.from_json(r.to_json()), {k: s.columns for k, s in sheets.items()})
    out = recipe.apply(recipe.override(again, linked={"Finds": "Context"}), sheets)
    assert rows(out["relazioni"]) == [(11, "riempie", 10)] and out["Finds"].count() == 1
    assert {x.unita: x.profondita for x in out["us"].collect()} == {10: 0.9, 11: None, 12: 0.3}
    log = spark.createDataFrame([(1, 10, "nota", "a"), (2, 10, "nota", None), (3, 11, "nota", "c")], "seq int, unita bigint, campo string, valore string")
    df = spark.createDataFrame([(10, "x"), (11, "x"), (12, "x")], "unita bigint, nota string")
    assert {r_.unita: r_.nota for r_ in state.edited(df, log, "unita", ["nota"]).collect()} == {10: None, 11: "c", 12: "x"}
    rel = spark.createDataFrame([(1, "copre", 2)], "a bigint, rel string, b bigint")
    assert rows(state.relations_after(rel, spark.createDataFrame([(2, "copre", 1)], rel.schema), rel.limit(0))) == rows(rel)
    mark = lambda d: spark.createDataFrame(list(d.items()), "unita bigint, impronta string")
    assert rows(state.to_rebuild(mark({1: "a", 2: "b", 3: "c"}), mark({1: "a", 2: "x", 3: "c"}), edges(spark, [(1, 2), (2, 3)]))) == [(1,), (2,)]


def test_engine(spark, tmp_path):
    us = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "US string, Definizione string")
    rel = spark.createDataFrame([("1", "copre", "2"), ("2", "copre", "1")], "US string, Rapporto string, `US correlata` string")
    e = Engine(spark, str(tmp_path / "p"))
    e.create({"schede": us, "rapporti": rel})
    assert {(r.codice, r.unita) for r in e.check().collect()} == {("ciclo", 1), ("ciclo", 2), ("isolata", 3)}
    assert {r.tabella: r.righe for r in e.summary().collect()} == {"us": 3, "relazioni": 2}


def test_streamed_extrema_equal_batch(spark, tmp_path):
    from decumano.streaming import refresh

    df = spark.range(100).selectExpr("id % 7 as unita", "cast(id as double) as z")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = refresh.refresh(refresh.level_stream(spark, str(tmp_path / "in"), "unita bigint, z double", 1), str(tmp_path / "ck"), lambda b, i: seen.append(b.count()))
    q.awaitTermination(60)
    assert sum(seen) == 100 and len(seen) == 3
    out = refresh.unit_extrema(refresh.level_stream(spark, str(tmp_path / "in"), "unita bigint, z double")).writeStream.outputMode("complete").format("memory").queryName("estremi").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert rows(spark.table("estremi")) == rows(refresh.unit_extrema(df))


SLOW = {"n05_unit_volumes", "f02_volumes_by_strategy", "j04_nodes_on_cycles", "j12_condensed", "p3_report"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(k for k in __spark_entry__.oracle_sql() if k[0] in "cdefghikor" or k[:2] in ("p1", "p2", "p3", "p4", "p5")) - SLOW))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    rel = c.execute(__spark_entry__.oracle_sql()[name])
    cols = [x[0] for x in rel.description]
    norm = lambda r: tuple(None if v is None else round(v, 3) + 0.0 if isinstance(v, float) else v for v in r)
    want = sorted((norm(r) for r in rel.fetchall()), key=repr)
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((norm(tuple(r)) for r in df.select(*(f"`{x}`" for x in cols)).collect()), key=repr)
    assert got == want
