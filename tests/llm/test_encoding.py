import random

import pytest
from decumano.llm import encoding as E

IT = ["La fossa è già stata pulita, però l'attività è ripresa più tardi.", "Non è chiaro se l'età sia medievale; perciò la città è incerta.", "Il côté méridional n'a pas été fouillé; déjà repéré à l'été.", "Die Fläche ist südlich überlagert, Maßstab später geprüft.", "La excavación continúa más allá del límite; está en la sección."]
ODD = ["Timbro «CHÂTEAU DE L'ÎLE» sul fondo.", "Randzeichen ‡ und † nach rechts.", "Stempel ÄÖÜ48 auf dem Boden.", "Marked Ø 39 mm, ½ of it.", "Inscription : Ð et Þ (lecture)."]


def corpus():
    rnd = random.Random(3)
    return [" ".join(rnd.choices(IT, k=4)) for _ in range(300)] + [f"{rnd.choice(IT)} {o}" for o in ODD for _ in range(12)]


@pytest.mark.parametrize("pair", [p for p in E.PAIRS if p[0] not in ("cp1252 as cp1250",)], ids=lambda p: p[0])
def test_undo_is_the_inverse(pair):
    for text in ("è", "à", "é", "ü", "ß", "ò"):
        assert E.undo(E.garble(text, pair[1]), pair[1]) == text


def test_find_and_restore(spark):
    docs = corpus()
    want, bad = {}, {}
    for k, (name, steps) in enumerate(E.PAIRS):
        if name == "cp1252 as cp1250":
            continue
        text = IT[k % 2] + "\n" + IT[(k + 1) % 2]
        bad[1000 + k] = E.garble(text, steps)
        want[1000 + k] = ("intero", text)
        bad[2000 + k] = text + "\n" + E.garble(text, steps)
        want[2000 + k] = ("intero", text + "\n" + text)
    bad[3000] = IT[0].replace("è", "�")
    bad[3001] = "solo ASCII"
    bad[3002] = None
    bad[3003] = ""
    bad[3004] = (IT[0] + " ") * 4000 + "\n" + E.garble(IT[1], E.PAIRS[0][1])
    want[3000] = ("perso", bad[3000])
    want[3004] = ("intero", (IT[0] + " ") * 4000 + "\n" + IT[1])
    rows = [(i, t) for i, t in enumerate(docs)] + list(bad.items())
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, esito string").drop("esito").selectExpr("*", "1 as testo")
    got = {r.doc_id: (r.esito, r.testo) for r in E.find_garbled(df, doc="doc_id", text="text").collect()}
    assert {k: v for k, v in got.items() if k < 1000} == {}, "clean texts with unusual letters stay clean"
    assert set(got) == set(want)
    right = sum(got[k] == v for k, v in want.items())
    assert right >= len(want) - 2, [(k, got[k], v) for k, v in want.items() if got[k] != v]


def test_empty(spark):
    assert E.find_garbled(spark.createDataFrame([], "doc_id bigint, text string"), doc="doc_id", text="text").count() == 0
