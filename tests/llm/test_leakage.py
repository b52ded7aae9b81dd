import random
import unicodedata

from conftest import rows
from decumano.llm import leakage as L

ITEMS = [(1, "Ecco dodici parole della prova che nessuno deve mai vedere nel testo di prova"), (2, "alfa beta gamma delta epsilon zeta eta theta iota kappa lambda mi ni csi omicron pi"), (3, "troppo corta"), (4, None), (5, "zeta eta theta iota kappa lambda mi ni csi omicron pi rho sigma tau"), (5, "seconda stesura zeta")]


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        w = L.item_words(t or "")
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for i, x in items:
            v = L.item_words(x or "")
            if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def test_automaton_against_brute_force():
    rnd = random.Random(2)
    words = list("abcd")
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 25)))) for i in range(25)]
    docs = [(i, " ".join(rnd.choices([*words, "z"], k=rnd.randint(0, 60)))) for i in range(80)]
    auto = L.build(items)
    for least in (2, 4, 6):
        got = {(d, i) for d, t in docs for i in auto.leaks(L.item_words(t), least)}
        assert got == brute(docs, items, least)
    for _, t in docs:
        assert not list(auto.scan(L.item_words(auto.without_leaks(t, 9)), 30))


def test_longest_run_and_coverage():
    auto = L.build([(1, "a b c d e f"), (2, "c d e x")])
    assert auto.leaks("q a b c d e z c d e x".split(), 3) == {1: (5, 8), 2: (4, 7)}


def test_table(spark):
    up = ITEMS[0][1].upper().replace(" ", ",\n")
    nfd = unicodedata.normalize("NFD", "però ") + " ".join(ITEMS[1][1].split()[:12])
    docs = [(1, "Prima. " + up + " dopo"), (1, "Prima. " + up + " dopo"), (2, nfd), (3, " ".join(ITEMS[1][1].split()[:11])), (4, None), (5, ""), (6, "x " * 30_000 + ITEMS[4][1]), (7, "troppo corta")]
    d = spark.createDataFrame([(i, t, 9, "k") for i, t in docs], "doc_id bigint, text string, item_id int, parole string")
    it = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in L.find_leaks(d.drop("item_id"), it, doc="doc_id", item="item_id", text="text").collect())
    assert got == [(1, 1), (1, 1), (2, 2), (6, 5)]
    assert L.find_leaks(d.drop("item_id").limit(0), it, doc="doc_id", item="item_id", text="text").count() == 0


def test_remove(spark):
    d = spark.createDataFrame([(1, "Uno due tre quattro cinque sei sette otto nove dieci. " * 2 + ITEMS[0][1] + " Fine."), (2, ITEMS[1][1]), (3, None), (4, "intatto")], "doc_id bigint, text string")
    it = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r.doc_id: r.text for r in L.remove_leaks(d, it, item="item_id", text="text").collect()}
    assert got == {1: "Uno due tre quattro cinque sei sette otto nove dieci. " * 2 + " Fine.", 3: None, 4: "intatto"}


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_ITEM_WORDS", 40)
    d = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1])], "doc_id bigint, text string")
    it = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(d, it, doc="doc_id", item="item_id", text="text").collect()} == brute([(1, ITEMS[0][1]), (2, ITEMS[1][1])], ITEMS, 12)


def test_items_in_parts_give_the_same(spark):
    words = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(k, " ".join(words[k * 20 : k * 20 + 20])) for k in range(20)], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, " ".join(words[0:15] + ["x"] * 5)), (2, " ".join(words[0:15] + words[200:215] + ["y"] * 40)), (3, " ".join(words[0:14] + words[300:314] + ["z"] * 20)), (4, "\x00"), (5, None), (6, "")],
        "doc_id bigint, text string",
    )
    whole = L.remove_leaks(docs, items, item="item_id", text="text")
    parts = L.remove_leaks(docs, items, item="item_id", text="text", most=30)
    assert rows(whole) == rows(parts)
    assert {r.doc_id for r in whole.collect()} == {2, 4, 5, 6} and [r.text for r in whole.where("doc_id = 4").collect()] == ["\x00"]
    one = L.find_leaks(docs, items, doc="doc_id", item="item_id", text="text")
    assert rows(one) == rows(L.find_leaks(docs, items, doc="doc_id", item="item_id", text="text", most=30)) and one.count() == 5
