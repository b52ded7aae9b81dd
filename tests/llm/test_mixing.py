import random

import pytest
from decumano.llm import mixing as M


def test_plan_exact_when_possible():
    s = {x.source: x for x in M.plan([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], {"a": 1000, "b": 100, "c": 900})}
    assert s["b"].tokens == 200 and s["a"].tokens == pytest.approx(333, abs=1) and s["c"].tokens == pytest.approx(133, abs=1)


def test_plan_with_total_runs_out():
    s = {x.source: x.tokens for x in M.plan([("a", 0.5, 1), ("b", 0.5, 1), ("gone", 0.2, 3)], {"a": 1000, "b": 100}, total=600)}
    assert s == {"a": 500, "b": 100, "gone": 0}
    s = M.plan([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 1000, "b": 100}, total=5000)
    assert [x.tokens for x in s] == [1000, 100]
    assert [x.tokens for x in M.plan([("a", 1.0, 1)], {})] == [0] and M.plan([], {"a": 3}) == []


def test_schedule_deviates_by_less_than_a_block():
    rnd = random.Random(1)
    for _ in range(40):
        blocks = {f"s{i}": rnd.choice([0, 1, 2, 7, rnd.randint(1, 200)]) for i in range(rnd.randint(1, 8))}
        order = M.schedule(blocks)
        n = sum(blocks.values())
        assert len(order) == n and len(set(order)) == n
        seen = dict.fromkeys(blocks, 0)
        for slot, (s, k) in enumerate(order, 1):
            assert k == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] - slot * blocks[x] / n) < 1 for x in blocks)


def test_a_cycle_keeps_blocks_small_at_any_total():
    for total in (5_000, 3_000_000, 25_000_000_000_000):
        shares = M.plan([("a", 0.61, 10), ("b", 0.38, 10), ("c", 0.01, 10)], {"a": total, "b": total, "c": total}, total=total)
        blocks, cycles = M.cycle(shares)
        assert sum(blocks.values()) <= M.SLOTS + 3
        for s in shares:
            assert s.tokens / (blocks[s.source] * cycles) < 2 * M.BLOCK
        one = M.schedule(blocks)
        seen, n = dict.fromkeys(blocks, 0), len(one)
        for slot, (s, _) in enumerate(one * min(2, cycles), 1):
            seen[s] += 1
            assert all(abs(seen[x] - slot * blocks[x] / n) < 1 for x in blocks)


def test_mix_places_follow_the_schedule(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "repeat('parola ', 40 + cast(id % 60 as int)) as text", "case when id % 4 = 0 then 'b' else 'a' end as source")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    sel = M.mix(d, t, doc="doc_id", source="source", text="text")[0].toPandas().sort_values(["posto", "source"])
    done = {"a": 0, "b": 0}
    for _, r in sel.iterrows():
        done[r.source] += r.token
        assert abs(done["a"] - done["b"]) < 3 * M.BLOCK


def test_mix(spark):
    docs = [(i, "parola " * (i % 7 + 1), "a" if i % 3 else "b", "x") for i in range(600)] + [(700, None, "a", "x"), (701, "", "a", "x"), (702, "senza", None, "x"), (703, "altra", "z", "x"), (5, "doppia chiave", "a", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, token string")
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 3), ("vuota", 0.1, 2)], "source string, target_share double, max_repeats int")
    sel, rep = M.mix(d, t, doc="doc_id", source="source", text="text")
    r = {x.source: x for x in rep.collect()}
    assert r["vuota"].usati == 0 and r["vuota"].quota == 0 and r["b"].ripetizioni <= 3
    assert r["a"].quota == pytest.approx(0.3, abs=0.02) and sum(x.quota for x in r.values()) == pytest.approx(1)
    got = sel.toPandas()
    assert got.groupby(["doc_id", "source", "ripetizione"]).size().max() <= 2 and set(got.source) == {"a", "b"}
    assert {x.source: got[got.source == x.source].token.sum() for x in r.values() if x.usati} == {x.source: x.usati for x in r.values() if x.usati}
    sel0, rep0 = M.mix(d.limit(0), t, doc="doc_id", source="source", text="text")
    assert sel0.count() == 0 and {x.usati for x in rep0.collect()} == {0}


def test_token_counts_of_whole_texts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(M.TOKENIZER)
    tok.encode_special_tokens = True
    texts = ["", None, "uno due", "x" * 5000, "<|endoftext|>", "è così " * 3000]
    got = {r.i: r.token for r in M.token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
