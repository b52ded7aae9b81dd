"""Freely typed values to the entries of a reference list."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE
from ..session import cut

#: Most terms of a reference list; it is held by every task. Beyond that the call is refused.
MAX_TERMS = 200_000
#: Remarks around a value that say nothing about which entry it is (whole words, after folding).
REMARKS = ("da confermare", "da verificare", "in parte", "parzialmente", "lato n", "lato s", "lato e", "lato o", "lato nord", "lato sud", "lato est", "lato ovest", "incerto", "incerta", "dubbio", "forse", "probabile", "prob", "cfr", "parz", "sic", "us", "usm")
#: Digits and signs typed for letters.
LEET = str.maketrans("01345789@$", "oieastbgas")
#: Least score of a match.
ACCEPT = 0.55

_WORD = regex.compile(r"[\p{L}\p{N}@$]+\.?")
_REMARK = regex.compile(r"\b(?:" + "|".join(sorted(map(regex.escape, REMARKS), key=len, reverse=True)) + r")\b")


def fold(text: str) -> str:
    """Without case, diacritics and Unicode form."""
    t = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Folded words without remarks; an abbreviation keeps its full stop; digits among letters become letters."""
    t = fold(text).replace("_", " ")
    bare = _REMARK.sub(" ", t)
    out = []
    for w in _WORD.findall(bare) or []:
        core = w.rstrip(".")
        if any(c.isalpha() for c in core) and any(not c.isalpha() for c in core):
            core = core.translate(LEET)
        if core:
            out.append(core + ("." if w.endswith(".") else ""))
    return out


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 if it is greater than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most and (not before or min(row) > most):
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def allowed(n: int) -> int:
    """Edits that a word of n letters may have."""
    return 0 if n < 3 else 1 if n <= 4 else 2 if n <= 7 else 3 if n <= 11 else n // 4 + 1


def _bag(s: str) -> np.ndarray:
    v = np.zeros(32, np.int16)
    for c in s:
        v[(ord(c) - 97) % 32] += 1
    return v


class Bags:
    """Finds the strings of a fixed list within an edit distance: letter counts first, then the distance itself."""

    def __init__(self, strings: Iterable[str]):
        self.strings = sorted(set(strings), key=lambda s: (len(s), s))
        self.bags = np.array([_bag(s) for s in self.strings]) if self.strings else np.zeros((0, 32), np.int16)
        self.sizes = np.array([len(s) for s in self.strings], np.int64)

    @staticmethod
    def widest(n: int) -> int:
        """The most edits to any string that a string of n letters may stand for."""
        most = allowed(n)
        while allowed(n + most + 1) > most:
            most += 1
        return most

    def near(self, s: str, most: int | None = None) -> list[tuple[str, int]]:
        """(string, distance) within ``most`` edits, by default as many as the longer of both may have."""
        widest = self.widest(len(s)) if most is None else most
        # Sorted by length: only those whose length is near enough are looked at.
        first, last = np.searchsorted(self.sizes, [len(s) - widest, len(s) + widest + 1])
        diff = self.bags[first:last] - _bag(s)
        low = np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1))
        out = []
        for k in np.flatnonzero(low <= widest):
            i = first + k
            t = self.strings[i]
            m = allowed(max(len(s), len(t))) if most is None else most
            if low[k] <= m and (d := osa(s, t, m)) <= m:
                out.append((t, d))
        return out


class Reference:
    """The entries of one field: terms with their words, word weights and joined spellings."""

    def __init__(self, terms: list[tuple[int, str]]):
        self.terms = [(e, w) for e, t in terms if (w := [x.rstrip(".") for x in words(t)])]
        df = Counter(x for _, w in self.terms for x in set(w))
        n = len(self.terms)
        self.idf = {x: math.log(1 + n / k) for x, k in df.items()}
        self.unknown = math.log(1 + n) if n else 1.0
        self.tokens = Bags(df)
        self.joined = Bags("".join(w) for _, w in self.terms)
        self.by_joined: dict[str, list[int]] = defaultdict(list)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, (_, w) in enumerate(self.terms):
            self.by_joined["".join(w)].append(i)
            for x in set(w):
                self.by_token[x].append(i)
        self.exact: dict[str, int] = {}
        for e, t in sorted(terms, reverse=True):
            self.exact[" ".join(words(t))] = e

    def repair(self, token: str) -> list[tuple[str, float]]:
        """Reference words that a typed word may stand for, with their likeness in (0, 1]."""
        core = token.rstrip(".")
        out = {t: 1 - d / max(len(core), len(t)) for t, d in self.tokens.near(core)}
        if token.endswith(".") and core:
            for t in self.tokens.strings:
                if t.startswith(core) and t != core:
                    out[t] = max(out.get(t, 0.0), 0.9)
        return sorted(out.items())

    def best(self, typed: list[str], repaired: list[list[tuple[str, float]]]) -> tuple[int, float]:
        """(entry, score) of the best complete term; entry 0 if none reaches ACCEPT.

        Score: the greater of soft TF-IDF over the repaired words and the likeness of the joined
        spellings (for words that ran together or apart); ties go to the closer joined spelling, then to
        the smaller entry.
        """
        if not typed:
            return 0, 0.0
        if (e := self.exact.get(" ".join(typed))) is not None:
            return e, 1.0
        whole = "".join(t.rstrip(".") for t in typed)
        close = {i: 1 - d / max(len(whole), len(j)) for j, d in self.joined.near(whole, max(1, int(0.38 * len(whole)))) for i in self.by_joined[j]} if whole else {}
        norm_v = math.sqrt(sum((max((self.idf[t] for t, s in r if s == max(x for _, x in r)), default=self.unknown)) ** 2 for r in repaired))
        soft: dict[int, float] = defaultdict(float)
        hit: dict[int, dict[str, float]] = defaultdict(dict)
        for r in repaired:
            for t, s in r:
                for i in self.by_token[t]:
                    hit[i][t] = max(hit[i].get(t, 0.0), s)
        for i, got in hit.items():
            w = self.terms[i][1]
            norm_t = math.sqrt(sum(self.idf[x] ** 2 for x in set(w)))
            soft[i] = sum(self.idf[t] ** 2 * s for t, s in got.items()) / (norm_t * norm_v)
        ranked = sorted(((-max(soft.get(i, 0.0), close.get(i, 0.0)), -close.get(i, 0.0), self.terms[i][0]) for i in {*soft, *close}))
        if not ranked:
            return 0, 0.0
        score, _, e = ranked[0]
        return (e if -score >= ACCEPT else 0), -score

    def match(self, value: str) -> tuple[int, float]:
        typed = words(value)
        return self.best(typed, [self.repair(t) for t in typed])


def _references(rows: list[tuple[str, int, str]]) -> dict[str, Reference]:
    by: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for campo, voce, termine in rows:
        by[campo].append((voce, termine))
    return {c: Reference(t) for c, t in by.items()}


def match_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """The entry that each distinct value means: (campo, valore, voce, punteggio); voce 0 if none fits.

    ``values``: (campo, valore), distinct; ``reference``: (campo, voce, termine), at most MAX_TERMS rows,
    which is checked. Each distinct word of the values is joined once to the reference words by edit
    distance; the repaired words then go back to their values, where soft TF-IDF, beside the likeness
    of the joined spellings, ranks the complete terms. Nulls have no match and no row; an empty text,
    or one of signs, digits and remarks only, is 0; equal scores go to the smaller entry.
    """
    rows = [(r[0], r[1], r[2]) for r in reference.where("campo is not null and voce is not null and termine is not null").select("campo", "voce", "termine").distinct().limit(MAX_TERMS + 1).collect()]
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the reference list has more than {MAX_TERMS} terms")
    vals = values.where("campo is not null and valore is not null").select("campo", "valore")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, v, p, t = [], [], [], []
            for campo, valore in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, w in enumerate(words(valore) or [""]):
                    c.append(campo)
                    v.append(valore)
                    p.append(k)
                    t.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(v, pa.string()), pa.array(p, pa.int32()), pa.array(t, pa.string())], names=["campo", "valore", "pos", "token"])

    likely = pa.list_(pa.struct([("t", pa.string()), ("s", pa.float64())]))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = _references(rows)
        for b in batches:
            out = [[{"t": t, "s": s} for t, s in refs[c].repair(w)] if c in refs and w else [] for c, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, likely)], names=["c2", "t2", "likely"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = _references(rows)
        for b in batches:
            e, s = [], []
            for campo, found in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                typed = [x for x in found if x["token"]]
                one = refs[campo].best([x["token"] for x in typed], [[(y["t"], y["s"]) for y in x["likely"] or []] for x in typed]) if campo in refs else (0, 0.0)
                e.append(one[0])
                s.append(one[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(e, pa.int64()), pa.array(s, pa.float64())], names=["campo", "valore", "voce", "punteggio"])

    spelled = cut(vals.mapInArrow(spell, "campo string, valore string, pos int, token string"))
    # A fixed number of partitions: few bytes, much work a row, which adaptive execution would join into one task.
    tasks = max(vals.sparkSession.sparkContext.defaultParallelism * 2, int(vals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    repaired = spelled.select("campo", "token").distinct().repartition(tasks, "campo", "token").mapInArrow(repair, "c2 string, t2 string, likely array<struct<t: string, s: double>>")
    back = spelled.join(repaired, (F.col("campo") == F.col("c2")) & (F.col("token") == F.col("t2")), "left")
    found = back.repartition(tasks, "campo", "valore").groupBy("campo", "valore").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "likely"))).alias("found"))
    return found.mapInArrow(rank, "campo string, valore string, voce bigint, punteggio double")


def canonical(rows: DataFrame, entries: DataFrame, reference: DataFrame) -> DataFrame:
    """The entry of each freely typed value: (tabella, campo, riga, voce), 0 if none fits.

    ``rows``: (tabella, campo, riga, lista, valore), ``lista`` naming the part of the reference list;
    ``entries``: (lista, canonico); ``reference``: (campo, voce, termine), campo being the lista. Null
    values, and values that are letter by letter a canonico of their list, have no row. Repeated rows
    keep a row each.

    Rows are first counted by value, combined before the shuffle; only distinct values are matched.
    Going back to the rows, values that hold a large share of them meet a broadcast of as few values.
    """
    rows = rows.select("tabella", "campo", "riga", "lista", "valore")
    fixed: dict[str, list[str]] = defaultdict(list)
    names = entries.select("lista", "canonico").where("lista is not null and canonico is not null").distinct().limit(MAX_TERMS + 1).collect()
    if len(names) > MAX_TERMS:
        raise ValueError(f"the reference list has more than {MAX_TERMS} entries")
    for r in names:
        fixed[r["lista"]].append(r["canonico"])
    known = F.lit(False)
    for lista, words_ in fixed.items():
        known = known | ((F.col("lista") == lista) & F.col("valore").isin(words_))
    free = rows.where(F.col("valore").isNotNull() & ~F.coalesce(known, F.lit(False)))
    counts = cut(free.groupBy("lista", "valore").agg(F.count(F.lit(1)).alias("n")))
    found = cut(match_values(counts.select(F.col("lista").alias("campo"), "valore"), reference).select(F.col("campo").alias("__l"), F.col("valore").alias("__v"), "voce"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [(r["lista"], r["valore"]) for r in counts.where(F.col("n") >= max(10_000, HOT_SHARE * total)).limit(int(1 / HOT_SHARE)).collect()]
    on = (F.col("lista") == F.col("__l")) & (F.col("valore") == F.col("__v"))
    out = ["tabella", "campo", "riga", "voce"]
    if not hot:
        return free.join(found, on).select(*out)
    is_hot, hot_found = F.lit(False), F.lit(False)
    for lista, valore in hot:
        is_hot = is_hot | ((F.col("lista") == lista) & (F.col("valore") == valore))
        hot_found = hot_found | ((F.col("__l") == lista) & (F.col("__v") == valore))
    cold = free.where(~is_hot).join(found.where(~hot_found), on)
    return cold.select(*out).unionByName(free.where(is_hot).join(F.broadcast(found.where(hot_found)), on).select(*out))
