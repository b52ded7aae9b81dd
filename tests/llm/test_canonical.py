import random
import string

import pytest
from decumano.llm import canonical as C

TERMS = [("definizione", 1, "strato di aratura"), ("definizione", 1, "ploughsoil"), ("definizione", 2, "strato di crollo"), ("definizione", 3, "buca di palo"), ("definizione", 4, "Schotterlage"), ("tipo", 5, "sup"), ("tipo", 6, "inf"), ("relation", 7, "überdeckt von"), ("relation", 8, "überdeckt"), ("relation", 9, "copre")]


@pytest.mark.parametrize(
    ("campo", "value", "voce"),
    [
        ("definizione", "STRATO  DI CROLLO", 2), ("definizione", "crollo, strato di", 2), ("definizione", "stratodi aratuar", 1), ("definizione", "strat0 d1 crollo", 2), ("definizione", "strato di arat.", 1),
        ("definizione", "forse buca di palo (?)", 3), ("definizione", "Schoterlage - da confermare", 4), ("definizione", "vedi scheda", 0), ("definizione", "", 0), ("definizione", "???", 0), ("definizione", "9", 0),
        ("tipo", "Sup", 5), ("tipo", "Ibf", 6), ("tipo", "test", 0), ("tipo", "sup.", 5),
        ("relation", "uberdeckt", 8), ("relation", "ÜBERDECKT VON", 7), ("relation", "uberdeckt vom", 7), ("relation", "Copre*", 9), ("relation", "campione prelevato", 0),
    ],
)
def test_values(campo, value, voce):
    ref = C.Reference([(v, t) for c, v, t in TERMS if c == campo])
    assert ref.match(value)[0] == voce


def test_edit_distance_against_plain_dynamic_programme():
    def plain(a, b):
        d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(5)
    strings = ["".join(rnd.choices("abcd", k=rnd.randint(0, 8))) for _ in range(120)]
    for a in strings[:40]:
        for b in strings:
            for most in (1, 3, 9):
                assert C.osa(a, b, most) == min(plain(a, b), most + 1)
    bags = C.Bags(strings)
    for a in strings[:30]:
        assert dict(bags.near(a, 2)) == {b: plain(a, b) for b in set(strings) if plain(a, b) <= 2}


def test_rows(spark):
    data = [("t", "c", 1, "definizione", "Strato di crollo"), ("t", "c", 1, "definizione", "Strato di crollo"), ("t", "c", 2, "definizione", "strato di crollo"), ("t", "c", 3, "definizione", None), ("t", "c", 4, "altra", "strato"), ("t", "c", 5, "tipo", "zzz"), ("t", "c", 6, "tipo", ""), ("t", "c", 7, None, "sup"), ("t", "c", 8, "definizione", "x " * 20000 + "strato di crollo")]
    rows = spark.createDataFrame(data, "tabella string, campo string, riga bigint, lista string, valore string").selectExpr("*", "1 as voce", "'k' as termine")
    entries = spark.createDataFrame([("definizione", "strato di crollo"), ("tipo", "sup")], "lista string, canonico string")
    ref = spark.createDataFrame(TERMS, "campo string, voce bigint, termine string")
    got = sorted((r.riga, r.voce) for r in C.canonical(rows, entries, ref).collect())
    assert got == [(1, 2), (1, 2), (4, 0), (5, 0), (6, 0), (8, 0)]
    assert C.canonical(rows.limit(0), entries, ref).count() == 0
    assert {r.voce for r in C.canonical(rows, entries.limit(0), ref.limit(0)).collect()} == {0}


def test_hot_value(spark):
    rows = spark.range(30_000).selectExpr("'t' as tabella", "'c' as campo", "id as riga", "'tipo' as lista", "case when id % 2 = 0 then 'Sup' else concat('v', id) end as valore")
    ref = spark.createDataFrame(TERMS, "campo string, voce bigint, termine string")
    out = C.canonical(rows, spark.createDataFrame([("tipo", "sup")], "lista string, canonico string"), ref)
    assert out.count() == 30_000 and out.where("voce = 5").count() >= 15_000


def test_random_typos_find_their_entry():
    rnd, hit = random.Random(7), 0
    ref = C.Reference([(v, t) for c, v, t in TERMS if c == "definizione"])
    for _ in range(300):
        c, v, t = rnd.choice([x for x in TERMS if x[0] == "definizione"])
        i = rnd.randrange(len(t))
        t = rnd.choice([t[:i] + t[i + 1 :], t[:i] + rnd.choice(string.ascii_lowercase) + t[i:], t[:i] + t[i : i + 2][::-1] + t[i + 2 :]])
        hit += ref.match(t)[0] == v
    assert hit >= 297
