import random
from datetime import datetime, timezone

import pytest
from conftest import rows
from decumano.operators import badrows, hierarchy, orphans, skew


def ts(day):
    return None if day is None else datetime(2024, 1 + (day - 1) // 28, 1 + (day - 1) % 28, tzinfo=timezone.utc)


UNITS = "num bigint, inserito timestamp, eliminato timestamp"
REFS = "tabella string, campo string, riga bigint, ref bigint, registrato timestamp, unita bigint, num bigint, motivo string"


def refs(spark, data):
    return spark.createDataFrame([("t", "c", r, ref, ts(day), u, 99, None) for r, ref, day, u in data], REFS).drop("motivo")


def test_orphan_reasons(spark):
    units = spark.createDataFrame([(1, ts(1), None), (2, ts(10), None), (3, ts(1), ts(5)), (3, ts(1), ts(5)), (4, ts(1), ts(5)), (4, ts(20), None), (5, None, None), (None, ts(1), None)], UNITS)
    data = [(1, 1, 3, None), (2, 2, 3, None), (3, 2, 10, None), (4, 3, 5, None), (5, 3, 4, None), (6, 9, 3, None), (6, 9, 3, None), (7, None, 3, None), (8, 9, None, None), (9, 4, 6, None), (10, 5, 1, None), (11, 3, None, None)]
    got = rows(orphans.orphan_references(refs(spark, data), units).select("riga", "motivo", "periodo"))
    assert got == sorted([(2, "tardiva", "2024-01"), (4, "eliminata", "2024-01"), (6, "mancante", "2024-01"), (6, "mancante", "2024-01"), (8, "mancante", None)], key=repr)


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], UNITS)
    assert orphans.orphan_references(refs(spark, [(1, 5, 1, None)]), none).count() == 1
    assert orphans.orphan_references(refs(spark, [(1, 5, 1, None)]).limit(0), none).count() == 0


def test_cascade_reports_direct_and_inherited(spark):
    units = spark.createDataFrame([(k, ts(1), None) for k in range(1, 61)], UNITS)
    data = [(1, 999, 2, 1)] + [(k, k - 1, 2, k) for k in range(2, 61)] + [(100, 3, 2, None), (101, 50, 2, None)]
    r = refs(spark, data)
    links = spark.createDataFrame([(k, k - 1) for k in range(2, 61)] + [(5, 60), (7, 7), (None, 3)], "figlio bigint, genitore bigint")
    got = {(x.riga): (x.motivo, x.livello) for x in orphans.orphan_cascade(r, units, links).collect()}
    assert got[1] == ("mancante", 0) and got[2] == ("ereditata", 1) and got[60] == ("ereditata", 59) and got[100] == ("ereditata", 3) and got[101] == ("ereditata", 50)
    rep = orphans.orphan_report(orphans.orphan_cascade(r, units, links)).collect()
    assert sum(x.righe for x in rep) == 62
    assert rows(orphans.orphan_cascade(r, units, links, 0)) == rows(orphans.orphan_references(r, units).selectExpr("tabella", "campo", "riga", "motivo", "periodo", "0L as livello"))
    assert orphans.orphan_cascade(r, units, links, 3).where("livello > 0").count() == 4


def test_p3_found_comes_out_of_the_whole_cascade(spark, tmp_path, monkeypatch):
    from decumano.plans import archive

    lists = "array<array<struct<x: double, y: double>>>"
    tables = {
        "us_poligoni": spark.createDataFrame([(1, ts(1), None, None), (2, ts(1), None, None), (3, ts(1), None, None)], f"us bigint, inserito timestamp, eliminato timestamp, anelli {lists}"),
        "usm": spark.createDataFrame([(4, ts(1), ts(5))], "usm bigint, inserito timestamp, eliminato timestamp"),
        "relations": spark.createDataFrame([(1, 1, 999, True, ts(8)), (2, 2, 1, True, ts(8)), (3, 3, 2, True, ts(8)), (4, 3, 4, False, ts(8))], "riga bigint, context bigint, related_context bigint, principale boolean, registrato timestamp"),
        "finds": spark.createDataFrame([(1, 3, ts(8)), (2, None, ts(8))], "riga bigint, context bigint, registrato timestamp"),
        "grafo": spark.createDataFrame([(3, 1)], "a bigint, b bigint"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    seen, levels = [], orphans.inherited_levels
    monkeypatch.setattr(orphans, "inherited_levels", lambda *a: seen.append(levels(*a)) or seen[-1])
    got = rows(archive.p3_found(spark, str(tmp_path)))
    assert got == [("relations", "related_context", 1, "mancante", "2024-01"), ("relations", "related_context", 4, "eliminata", "2024-01")]
    assert [dict(map(tuple, s.collect())) for s in seen] == [{1: 0, 2: 1, 3: 1}]


def test_inherited_levels_against_breadth_first_search(spark):
    rnd = random.Random(11)
    for _ in range(3):
        n = 400
        pairs = {(k, rnd.randrange(max(1, k - 3), k)) for k in range(2, n)} | {(rnd.randrange(1, n), rnd.randrange(1, n)) for _ in range(25)} | {(5, 5)}
        seeds = [rnd.randrange(1, n) for _ in range(4)]
        below = {}
        for c, p in pairs:
            below.setdefault(p, []).append(c)
        want, todo = dict.fromkeys(seeds, 0), list(seeds)
        while todo:
            x = todo.pop(0)
            for c in below.get(x, ()):
                if c not in want:
                    want[c] = want[x] + 1
                    todo.append(c)
        got = orphans.inherited_levels(spark.createDataFrame([(x,) for x in seeds], "num bigint"), spark.createDataFrame(sorted(pairs) + [(None, 1), (1, None)], "figlio bigint, genitore bigint"))
        assert dict(map(tuple, got.collect())) == want


def test_hot_key_join_keeps_all_rows(spark):
    left = spark.range(60_000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 50 = 1 then null else id end as k")
    right = spark.range(0, 60_000, 2).selectExpr("id as rk", "id * 10 as v").unionByName(spark.sql("select 7L as rk, -1L as v"))
    assert skew.hot_keys(left, "k") == [7]
    got = skew.skew_left_join(left, right, "k", "rk")
    assert got.count() == 60_000 and got.where("v = -1").count() == 20_001  # and the row whose own number is 7
    assert got.where("v is not null").count() == left.join(right, left.k == right.rk).count()


def brute_tree(links, nodes):
    up = {}
    for a, b in sorted((a, b) for a, b in links if a is not None and b is not None and a != b):
        up.setdefault(a, b)
    out = {}
    for n in {x for x in [*nodes, *(e for ln in links for e in ln)] if x is not None}:
        way, x = [n], n
        while x in up and up[x] not in way:
            x = up[x]
            way.append(x)
        if x not in up:
            out[n] = (x, len(way) - 1, "/".join(map(str, reversed(way))))
        else:
            out[n] = (-1, -1, "ciclo" if up[x] == n else "verso ciclo")
    return out


@pytest.mark.parametrize("power", [0, 2, 5])
def test_hierarchy_against_brute_force(spark, power):
    rnd = random.Random(power)
    links = [(k, k - 1) for k in range(2, 80)] + [(k, rnd.randint(1, k - 1)) for k in range(100, 160)]
    links += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 203), (300, 301), (301, 300)] + [(400 + k, 400 + (k + 1) % 40) for k in range(40)] + [(500 + k, 499 + k if k else 400) for k in range(45)]
    links += [(5, 5), (None, 3), (3, None), (10, 9), (100, 100)] + [(600 + k, 1) for k in range(50)]
    nodes = [1, 700, 700, None, 2]
    df = spark.createDataFrame(links, "figlio bigint, genitore bigint")
    got = {r.nodo: (r.radice, r.profondita, r.percorso) for r in hierarchy.hierarchy(df, spark.createDataFrame([(n,) for n in nodes], "nodo bigint"), power).collect()}
    assert got == brute_tree(links, nodes)


def test_hierarchy_of_nothing_and_descendants(spark):
    e = spark.createDataFrame([], "figlio bigint, genitore bigint")
    assert hierarchy.hierarchy(e, spark.createDataFrame([], "nodo bigint")).count() == 0
    t = hierarchy.hierarchy(spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "figlio bigint, genitore bigint"), e.selectExpr("figlio as nodo"))
    assert rows(hierarchy.descendants(t)) == [(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)]
    assert rows(hierarchy.descendant_counts(t)) == [(1, 3, 2), (2, 2, 1)]


CASES = [
    ("1,a,b", None), (' 12.0 ,"x, y",', None), ('"7","q ""z""",c', None), ('8,"due\nrighe",c', None), ("9,riga\nsola,c", None), ("000000012,a,b", None),
    ("1,a", "colonne"), ("1,a,b,c", "colonne"), ("", "colonne"), (None, "colonne"),
    ('1,"a,b', "virgolette"), ('1,a"b,c', "virgolette"), ('1,"a"b,c', "virgolette"), ('1, "a",c', "virgolette"), ('"', "virgolette"), ('1,"a"', "colonne"),
    ("0,a,b", "valore"), ("0.0,a,b", "valore"), ("1234567890,a,b", "valore"), ("٣,a,b", "valore"), ("-1,a,b", "valore"), (",a,b", "valore"), ("1.5,a,b", "valore"), ("1.00,a,b", "valore"),
    ("Numero,b,c", "testata"), ('"Numero",b,c', "testata"), (" Numero ,b", "testata"),
]


def test_bad_rows(spark):
    df = spark.createDataFrame([(i, ",", t, "x") for i, (t, _) in enumerate(CASES)], "riga bigint, sep string, testo string, a string")
    out = badrows.parse_records(df, "riga", "sep", "testo", ["a", "b", "c"], "Numero")
    got = {r.riga: r.motivo for r in out.collect()}
    assert got == {i: m for i, (_, m) in enumerate(CASES) if m != "testata"}
    good, bad = badrows.split_records(out, "riga")
    assert {r.riga: (r.a, r.b, r.c) for r in good.collect()} == {0: ("1", "a", "b"), 1: (" 12.0 ", "x, y", ""), 2: ("7", 'q "z"', "c"), 3: ("8", "due\nrighe", "c"), 4: ("9", "riga\nsola", "c"), 5: ("000000012", "a", "b")}
    assert bad.columns == ["riga", "motivo"]


def test_bad_rows_separators_empty_and_long(spark):
    long = "z" * 2_000_000
    df = spark.createDataFrame([(1, "|", "1|a|b"), (1, "|", "1|a|b"), (2, "\t", "2\ta\tb"), (3, "||", '3||"x||y"||c'), (4, None, "4,a,b"), (5, ";", f"5;{long};c"), (6, ";", "6,a,b")], "riga bigint, sep string, testo string")
    out = badrows.parse_records(df, "riga", "sep", "testo", ["a", "b", "c"], "Numero")
    got = sorted((r.riga, r.motivo, r.b and len(r.b)) for r in out.collect())
    assert got == [(1, None, 1), (1, None, 1), (2, None, 1), (3, None, 4), (4, None, 1), (5, None, 2_000_000), (6, "colonne", None)]
    assert badrows.parse_records(df.limit(0), "riga", "sep", "testo", ["a"], "N").count() == 0
