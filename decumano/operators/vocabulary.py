"""Concepts behind column names and values: a term table, scores, and terms that users teach."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Concept -> terms. Our own short list in five languages; users add to it with ``teach``.
TERMS: dict[str, tuple[str, ...]] = {
    "unita": ("us", "unita stratigrafica", "unit", "context", "context number", "su", "befund", "unite stratigraphique", "ue"),
    "tipo": ("tipo", "type", "context type", "art", "clase"),
    "definizione": ("definizione", "definition", "interpretation", "interpretazione", "deutung"),
    "fase": ("fase", "phase", "periodo fase"),
    "periodo": ("periodo", "period", "epoca", "periode", "zeitstellung"),
    "rapporto": ("rapporto", "relation", "relazione", "beziehung", "relacion"),
    "correlata": ("us correlata", "related context", "related", "zu befund"),
    "riempie": ("riempie", "fill of", "fills", "verfullt", "comble"),
    "copre": ("copre", "covers", "uberdeckt", "recouvre"),
    "coperto": ("coperto da", "covered by", "coperta da"),
    "materiale": ("materiale", "material", "classe materiale"),
    "numero": ("nr", "numero", "count", "object count", "anzahl", "quantita"),
    "peso": ("peso", "weight", "gewicht", "poids"),
    "profondita": ("profondita", "depth", "context depth", "tiefe", "profondeur"),
    "quota": ("quota", "elevation", "level", "hohe", "altitude", "z"),
    "sito": ("sito", "site", "sitecode", "area", "fundort"),
    "descrizione": ("descrizione", "description", "brief description", "beschreibung"),
    "foto": ("foto", "photo", "immagine", "image", "bild"),
}
EXACT, COMPACT, STRIPPED, SIMILAR_RATIO, SIMILAR_FACTOR, ACCEPT = 0.97, 0.95, 0.93, 0.85, 0.85, 0.30
#: Words that say nothing about the concept of a column (units and fillers).
NOISE = ("m", "cm", "mm", "g", "kg", "n", "no", "id", "cod", "codice", "tbl", "tab")


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", regex.sub(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\d)|(?<=\d)(?=\p{L})", " ", text)).casefold()
    return " ".join(regex.findall(r"[^\W_]+", "".join(c for c in t if not unicodedata.combining(c))))


def score(name: str, term: str) -> float:
    """How well a name fits a term: equal, run together, without noise words, contained, or similar by words."""
    n, t = fold(name), fold(term)
    if not n or not t:
        return 0.0
    if n == t:
        return EXACT
    if n.replace(" ", "") == t.replace(" ", ""):
        return COMPACT
    ws, wt = [w for w in n.split() if w not in NOISE], t.split()
    if ws and " ".join(ws) == t:
        return STRIPPED
    best = 0.0
    if len(t) > 2 and set(wt) <= set(ws):
        best = 0.6 + 0.3 * len(wt) / len(ws)
    elif set(ws) & set(wt):
        r = len(set(ws) & set(wt)) / max(len(set(ws)), len(set(wt)))
        best = 0.55 * r * r
    if len(n) > 3 and len(t) > 3 and n[:2] == t[:2] and min(len(n), len(t)) / max(len(n), len(t)) >= 0.74:
        ratio = SequenceMatcher(None, n, t).ratio()
        if ratio >= SIMILAR_RATIO:
            best = max(best, ratio * SIMILAR_FACTOR)
    return best


@dataclass
class Vocabulary:
    """Terms by concept; taught terms win over the built-in ones."""

    terms: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(TERMS))
    taught: dict[str, str] = field(default_factory=dict)

    def teach(self, name: str, concept: str) -> Vocabulary:
        return Vocabulary(self.terms, {**self.taught, fold(name): concept})

    def recognise(self, name: str, context: Sequence[str] = (), geometry: str | None = None) -> list[tuple[str, float]]:
        """(concept, score) of a name, best first; concepts of the table's other columns and a geometry raise it a little."""
        if (c := self.taught.get(fold(name))) is not None:
            return [(c, 1.0)]
        out = []
        for c, terms in self.terms.items():
            s = max(score(name, t) for t in terms)
            if s:
                s += 0.06 * (c in context) + (0.08 if geometry == "Point" and c == "quota" else 0.0)
            if s >= ACCEPT:
                out.append((c, min(s, 1.0)))
        return sorted(out, key=lambda x: (-x[1], x[0]))


def recognise_names(names: DataFrame, column: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(column, concetto, punteggio) of distinct names; each is scored once, whatever the number of rows."""
    v = vocabulary or Vocabulary()

    @F.arrow_udf("struct<concetto: string, punteggio: double>")
    def best(c: pa.Array) -> pa.Array:
        out = []
        for n in c.to_pylist():
            hit = v.recognise(n)[:1] if n else []
            out.append({"concetto": hit[0][0], "punteggio": hit[0][1]} if hit else {"concetto": None, "punteggio": None})
        return pa.array(out, pa.struct([("concetto", pa.string()), ("punteggio", pa.float64())]))

    return names.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__b", best(column)).select(column, "__b.concetto", "__b.punteggio")
