"""Passages of held-out test items in a corpus, by a generalised suffix automaton of the items."""

from __future__ import annotations

import pickle
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Consecutive words of an item that make a leak.
LEAST_WORDS = 12
#: Words of the test items in one automaton, which a worker holds; more items are taken in parts.
MAX_ITEM_WORDS = 2_000_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def fold(text: str) -> str:
    """Without case, diacritics and Unicode form; ASCII takes the short way."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return "".join([c for c in t if not unicodedata.combining(c)])


def item_words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


class Automaton:
    """Suffix automaton over the words of all items; each item is fed from the root.

    ``next[s]`` maps a word number to a state, ``link`` and ``length`` are the usual ones. After
    ``finish`` the items of a state, those in which its strings occur, are a slice of one array: the items in
    the order of a walk through the tree of suffix links. So memory grows with the words of the items alone.
    """

    def __init__(self) -> None:
        self.word: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[int]] = [[]]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, item: int, text: list[str]) -> None:
        last = 0
        for t in text:
            w = self.word.setdefault(t, len(self.word))
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p < 0:
                    self.link[new] = 0
                else:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
                last = new
            self.ends[last].append(item)

    def finish(self) -> Automaton:
        """Lay the items out by the tree of suffix links: a suffix occurs wherever the strings below it do."""
        kids: list[list[int]] = [[] for _ in self.length]
        for s in range(1, len(self.length)):
            kids[self.link[s]].append(s)
        self.first, self.last = [0] * len(self.length), [0] * len(self.length)
        flat: list[int] = []
        todo = [(0, False)]
        while todo:
            s, left = todo.pop()
            if left:
                self.last[s] = len(flat)
                continue
            self.first[s] = len(flat)
            flat.extend(self.ends[s])
            todo.append((s, True))
            todo.extend((k, False) for k in kids[s])
        self.flat, self.ends = np.array(flat, np.int64), []
        return self

    def items(self, s: int) -> list[int]:
        return np.unique(self.flat[self.first[s] : self.last[s]]).tolist()

    def scan(self, text: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, longest match, state) at each place where at least ``least`` words up to it match."""
        nxt, link, length, number = self.next, self.link, self.length, self.word
        s, n = 0, 0
        for i, t in enumerate(text):
            w = number.get(t)
            if w is None:
                s = n = 0
                continue
            to = nxt[s].get(w)
            while to is None and s:
                s = link[s]
                n = length[s]
                to = nxt[s].get(w)
            if to is None:
                s = n = 0
                continue
            s, n = to, n + 1
            if n >= least:
                yield i, n, s

    def leaks(self, text: list[str], least: int) -> dict[int, tuple[int, int]]:
        """For each item with a match: the longest run of words, and the words covered by such runs."""
        longest: dict[int, int] = {}
        covered: dict[int, list[list[int]]] = {}
        for i, n, s in self.scan(text, least):
            # Shorter suffixes, down to ``least``, may occur in more items.
            while s > 0 and n >= least:
                for item in self.items(s):
                    if n > longest.get(item, 0):
                        longest[item] = n
                    spans = covered.setdefault(item, [])
                    if spans and spans[-1][1] >= i - n + 1:
                        spans[-1][0] = min(spans[-1][0], i - n + 1)
                        spans[-1][1] = i + 1
                    else:
                        spans.append([i - n + 1, i + 1])
                s = self.link[s]
                n = self.length[s]
        return {k: (v, sum(b - a for a, b in covered[k])) for k, v in longest.items()}

    def leaked(self, text: list[str], least: int) -> np.ndarray:
        """Which words stand in a run of at least ``least`` that matches any item."""
        cut = np.zeros(len(text), bool)
        for i, n, _ in self.scan(text, least):
            cut[i - n + 1 : i + 1] = True
        return cut

    def without_leaks(self, text: str, least: int) -> str:
        """The text less all spans of at least ``least`` words that match any item."""
        return without(text, self.leaked(item_words(text), least))


def without(text: str, cut: np.ndarray) -> str:
    """The text less the spans of words that are marked."""
    if cut.any():
        folded, at = _fold_with_places(text)
        spans = list(_WORD.finditer(folded))
        out, done, k = [], 0, 0
        while k < len(spans):
            if cut[k]:
                b = k
                while k + 1 < len(spans) and cut[k + 1]:
                    k += 1
                out.append(text[done : at[spans[b].start()]])
                done = at[spans[k].end() - 1] + 1
                while done < len(text) and unicodedata.combining(text[done]):
                    done += 1
            k += 1
        out.append(text[done:])
        return "".join(out)
    return text


def _fold_with_places(text: str) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters the place it came from."""
    out, at = [], []
    for i, c in enumerate(text):
        f = fold(c)
        out.append(f)
        at.extend([i] * len(f))
    return "".join(out), at


def build(rows: list[tuple[int, str]]) -> Automaton:
    a = Automaton()
    for item, text in rows:
        a.add(item, item_words(text))
    return a.finish()


def _items(items: DataFrame, key: str, text: str, most: int) -> list[list[tuple[int, str]]]:
    """The items, a held-out set and not the corpus, in parts of about ``most`` words each, so that one automaton stays small."""
    parts: list[list[tuple[int, str]]] = [[]]
    words = 0
    for r in items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).distinct().orderBy(key, text).toLocalIterator():
        n = len(r[1]) // 2 + 1
        if parts[-1] and words + n > most:
            parts.append([])
            words = 0
        parts[-1].append((r[0], r[1]))
        words += n
    return parts


class Shared:
    """Automata built once and broadcast; a Python worker keeps the one it used last for its next tasks."""

    kept: dict[str, Automaton] = {}

    def __init__(self, spark, parts: list[list[tuple[int, str]]]):
        self.all = [(uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(build(p), protocol=5))) for p in parts]

    def __iter__(self) -> Iterator[Automaton]:
        for key, b in self.all:
            if key not in Shared.kept:
                Shared.kept.clear()
                Shared.kept[key] = pickle.loads(b.value)
            yield Shared.kept[key]


def find_leaks(docs: DataFrame, items: DataFrame, *, doc: str, item: str, text: str, least: int = LEAST_WORDS, most: int = MAX_ITEM_WORDS) -> DataFrame:
    """Each document with the test items it leaks: (doc, item, parole, coperte).

    A document leaks an item if it holds at least ``least`` consecutive words of the item's text, words
    being runs of letters and digits without regard to case, diacritics and Unicode form. ``parole`` is
    the longest such run, ``coperte`` the words of the document in such runs. An item shorter than
    ``least`` words never leaks. Null and empty texts leak nothing; repeated documents and repeated
    item texts are each reported. Texts are streamed whole through the automaton in one pass, without
    a shuffle. The automaton is built once; items of more than ``most`` words in all are taken in parts,
    through which each batch of texts goes in turn, so the result is the same.
    """
    schema = T.StructType([docs.schema[doc], T.StructField(item, T.LongType()), T.StructField("parole", T.LongType()), T.StructField("coperte", T.LongType())])
    src = spread(docs.where(F.col(text).isNotNull()).select(doc, text))
    shared = Shared(docs.sparkSession, _items(items, item, text, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [item_words(t) for t in b.column(1).to_pylist()]
            rows = [(k, i, n, c) for auto in shared for k, w in enumerate(words) for i, (n, c) in auto.leaks(w, least).items()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3))], names=["d", "i", "n", "c"])

    return src.mapInArrow(run, schema)


def remove_leaks(docs: DataFrame, items: DataFrame, *, item: str, text: str, least: int = LEAST_WORDS, most_share: float = 0.5, most: int = MAX_ITEM_WORDS) -> DataFrame:
    """The corpus without leaked spans: ``text`` less every run of at least ``least`` leaked words.

    A document of which more than ``most_share`` of the words would go, of all items together, is dropped
    whole, which is the coverage limit of the method. Null texts stay null.
    """
    shared = Shared(docs.sparkSession, _items(items, item, text, most))

    @F.arrow_udf("struct<resto: string, tolto: boolean>")
    def clean(texts: pa.Array) -> pa.Array:
        whole = texts.to_pylist()
        words = [item_words(t) if t is not None else [] for t in whole]
        marks = [np.zeros(len(w), bool) for w in words]
        for auto in shared:
            for w, m in zip(words, marks):
                m |= auto.leaked(w, least)
        out = [{"resto": None if t is None else without(t, m), "tolto": bool(m.sum() > most_share * len(m))} for t, m in zip(whole, marks)]
        return pa.array(out, pa.struct([("resto", pa.string()), ("tolto", pa.bool_())]))

    name = "__" + "_".join(docs.columns)  # clashes with no column
    return docs.withColumn(name, clean(text)).where(~F.col(name)["tolto"]).withColumn(text, F.col(name)["resto"]).drop(name)
