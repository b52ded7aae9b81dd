"""Text read with another encoding than it was written in: found by a hidden Markov model, restored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

LOST = "�"
#: (name, written in, read as); several pairs are undone from the last to the first.
PAIRS: list[tuple[str, list[tuple[str, str]]]] = [
    ("utf-8 as cp1252", [("utf-8", "cp1252")]),
    ("utf-8 as latin-1", [("utf-8", "latin-1")]),
    ("utf-8 as cp1250", [("utf-8", "cp1250")]),
    ("utf-8 as mac-roman", [("utf-8", "mac-roman")]),
    ("utf-8 as cp437", [("utf-8", "cp437")]),
    ("utf-8 as cp850", [("utf-8", "cp850")]),
    ("utf-8 as cp1252, twice", [("utf-8", "cp1252"), ("utf-8", "cp1252")]),
    ("utf-8 as latin-1, twice", [("utf-8", "latin-1"), ("utf-8", "latin-1")]),
    ("cp1252 as mac-roman", [("cp1252", "mac-roman")]),
    ("cp1252 as cp850", [("cp1252", "cp850")]),
    ("cp1252 as cp437", [("cp1252", "cp437")]),
    ("cp1252 as cp1250", [("cp1252", "cp1250")]),
    ("mac-roman as cp1252", [("mac-roman", "cp1252")]),
    ("mac-roman as latin-1", [("mac-roman", "latin-1")]),
    ("cp850 as cp1252", [("cp850", "cp1252")]),
    ("cp850 as latin-1", [("cp850", "latin-1")]),
    ("cp437 as cp1252", [("cp437", "cp1252")]),
    ("cp437 as latin-1", [("cp437", "latin-1")]),
]
CLEAN, LOST_STATE = 0, len(PAIRS) + 1
#: Log probability of a change of state between two runs, within a line and over a line break.
SWITCH, SWITCH_LINE = -5.5, -4.0
#: Log probability of a run that a state can't have made.
NEVER = -60.0
#: In contexts of at least so many letters, one and this share of them are taken from each letter's count.
LEAST_CONTEXT, DISCOUNT = 20, 0.0003
ROUNDS = 3

_RUN = re.compile(r"[^\x00-\x7f]+")


def _tables() -> dict[str, tuple[list[str], dict[str, int]]]:
    """Both ways between bytes and characters; a byte that an encoding leaves open is the control of that number."""
    out = {}
    for name in {e for _, steps in PAIRS for pair in steps for e in pair} - {"utf-8"}:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        out[name] = (chars, {c: b for b, c in enumerate(chars)})
    return out


_TABLES = _tables()


def undo(run: str, steps: list[tuple[str, str]]) -> str | None:
    """The original of a garbled run, or None if the pair can't have made it."""
    for written, read in reversed(steps):
        to_byte = _TABLES[read][1]
        raw = [to_byte.get(c, -1) for c in run]
        if min(raw) < 0:
            return None
        if written == "utf-8":
            try:
                run = bytes(raw).decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            run = "".join(_TABLES[written][0][b] for b in raw)
        if not run or any(ord(c) < 0x80 for c in run):
            return None
    return None if any(0x80 <= ord(c) < 0xA0 for c in run) else run


def garble(text: str, steps: list[tuple[str, str]]) -> str:
    """The opposite of ``undo``, for tests: characters the encodings lack raise."""
    for written, read in steps:
        raw = text.encode("utf-8") if written == "utf-8" else bytes(_TABLES[written][1][c] for c in text)
        text = "".join(_TABLES[read][0][b] for b in raw)
    return text


def _kind(c: str) -> str:
    if c.isascii():
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else c if c in "\x02'\"" else "."
    return "\x01"


def _context(text: str, b: int, e: int) -> tuple[str, str, str, str]:
    """Two characters before and after a run; beyond the ends \\x02, and \\x01 for any further non-ASCII one."""
    p2, p1 = text[b - 2] if b > 1 else "\x02", text[b - 1] if b else "\x02"
    n1, n2 = text[e] if e < len(text) else "\x02", text[e + 1] if e + 1 < len(text) else "\x02"
    return (p2 if p2.isascii() else "\x01", p1, n1, n2 if n2.isascii() else "\x01")


def grams(run: str, ctx: tuple[str, str, str, str]) -> Iterator[tuple[str, str, str, str, str]]:
    """(p2, p1, letter, n1, n2) for each letter of a run."""
    p2, p1, n1, n2 = ctx
    for i, c in enumerate(run):
        a1 = run[i - 1] if i else p1
        a2 = (("\x01" if i > 1 else p1) if i else p2)
        b1 = run[i + 1] if i + 1 < len(run) else n1
        b2 = ("\x01" if i + 2 < len(run) else n1) if i + 1 < len(run) else n2
        yield a2 if a2.isascii() else "\x01", a1, c, b1, b2 if b2.isascii() else "\x01"


class Letters:
    """How likely a non-ASCII letter is where one stands: by two, one and the kind of neighbours, interpolated."""

    def __init__(self, counts: dict[str, int]):
        self.wide, self.near, self.kind, self.alone = Counter(), Counter(), Counter(), Counter()
        self.wide_n, self.near_n, self.kind_n, self.n = Counter(), Counter(), Counter(), 0
        for g, v in counts.items():
            how, g = g[0], g[1:]
            if how == "5":
                p2, p1, c, n1, n2 = g
                self.wide[g] += v
                self.wide_n[p2, p1, n1, n2] += v
            elif how == "3":
                p1, c, n1 = g
                self.near[g] += v
                self.near_n[p1, n1] += v
            elif how == "k":
                p1, c, n1 = g
                self.kind[g] += v
                self.kind_n[p1, n1] += v
            else:
                self.alone[g] += v
                self.n += v

    def log(self, g: tuple[str, str, str, str, str]) -> float:
        p2, p1, c, n1, n2 = g
        k1, k2 = _kind(p1), _kind(n1)
        p = (self.alone[c] + 0.05) / (self.n + 100.0)
        p = (self.kind[k1 + c + k2] + 5 * p) / (self.kind_n[k1, k2] + 5)
        p = (self._less(self.near[p1 + c + n1], n := self.near_n[p1, n1]) + 2 * p) / (n + 2)
        p = (self._less(self.wide["".join(g)], n := self.wide_n[p2, p1, n1, n2]) + 2 * p) / (n + 2)
        return math.log(p)

    @staticmethod
    def _less(count: int, total: int) -> float:
        """A count without the letter now looked at and without as many as garbled texts not yet found may give."""
        return count if total < LEAST_CONTEXT else max(0.0, count - 1 - DISCOUNT * total)

    def run(self, run: str, ctx: tuple[str, str, str, str]) -> float:
        return sum(self.log(g) for g in grams(run, ctx))


class Labeller:
    """Viterbi over the non-ASCII runs of a text; all states write ASCII alike, so only the runs tell."""

    def __init__(self, letters: Letters):
        self.letters = letters
        self.memo: dict[tuple, tuple[np.ndarray, float]] = {}

    def emission(self, run: str, ctx: tuple[str, str, str, str]) -> tuple[np.ndarray, float]:
        key = (run, ctx)
        got = self.memo.get(key)
        if got is None:
            e = np.full(len(PAIRS) + 2, NEVER)
            if LOST in run:
                e[LOST_STATE] = 0.0
            else:
                e[CLEAN] = max(NEVER, self.letters.run(run, ctx))
                for k, (_, steps) in enumerate(PAIRS, 1):
                    back = undo(run, steps)
                    if back is not None:
                        e[k] = max(NEVER, self.letters.run(back, ctx))
            got = e, max(0.0, float(e.max() - e[CLEAN]))
            if len(self.memo) < 300_000:
                self.memo[key] = got
        return got

    def label(self, text: str, found: list[tuple] | None = None) -> list[tuple[int, int, int]]:
        """(start, end, state) of each run; [] stands for a text that is clean throughout.

        ``found``: the ``runs_of`` the text, where they are known already.
        """
        runs = runs_of(text) if found is None else found
        if not runs:
            return []
        em = [self.emission(run, ctx) for _, _, run, ctx in runs]
        # No other path can make up for its first change of state: the clean path is the best one.
        if sum(g for _, g in em) < -SWITCH_LINE:
            return []
        score = em[0][0] + SWITCH_LINE
        score[CLEAN] = em[0][0][CLEAN]
        back = []
        for i in range(1, len(runs)):
            cost = SWITCH_LINE if "\n" in text[runs[i - 1][1] : runs[i][0]] else SWITCH
            best = int(score.argmax())
            stay = score >= score[best] + cost
            back.append(np.where(stay, np.arange(len(score)), best))
            score = np.where(stay, score, score[best] + cost) + em[i][0]
        at = int(score.argmax())
        states = [at]
        for b in reversed(back):
            at = int(b[at])
            states.append(at)
        states.reverse()
        return [(b, e, s) for (b, e, _, _), s in zip(runs, states)] if any(states) else []

    def restore(self, text: str, labels: list[tuple[int, int, int]]) -> str:
        """The text with the inverse of its state applied to each run; what is lost stays as it is."""
        out, done = [], 0
        for b, e, s in labels:
            if 0 < s < LOST_STATE and (back := undo(text[b:e], PAIRS[s - 1][1])) is not None:
                out.append(text[done:b])
                out.append(back)
                done = e
        out.append(text[done:])
        return "".join(out)


def runs_of(text: str) -> list[tuple[int, int, str, tuple[str, str, str, str]]]:
    """(start, end, run, context) of each run of non-ASCII characters."""
    return [(m.start(), m.end(), m.group(), _context(text, m.start(), m.end())) for m in _RUN.finditer(text)]


def _letters(runs: Counter) -> Counter:
    """Counts of the letter model from counts of runs with their contexts."""
    c: Counter = Counter()
    for (run, ctx), n in runs.items():
        if LOST in run:
            continue
        for p2, p1, x, n1, n2 in grams(run, ctx):
            c["5" + p2 + p1 + x + n1 + n2] += n
            c["3" + p1 + x + n1] += n
            c["k" + _kind(p1) + x + _kind(n1)] += n
            c["1" + x] += n
    return c


def _structural(run: str, memo: dict[str, bool]) -> bool:
    """A run that is well-formed UTF-8 read as something else: texts with one are left out of the first count."""
    got = memo.get(run)
    if got is None:
        got = len(run) > 1 and any(undo(run, steps) is not None for _, steps in PAIRS[:8])
        if len(memo) < 300_000:
            memo[run] = got
    return got


def learn(docs: DataFrame, text: str, rounds: int = ROUNDS) -> dict[str, int]:
    """Counts of the letter model over all texts, by hard expectation-maximisation.

    Round 0 counts texts without ill-read UTF-8. Each further round labels all texts by the present
    model and counts again, garbled spans as what they are restored to. All contexts are kept: there are as many
    as the languages have letters between two neighbours on either side, not as many as there are texts.
    """
    src = spread(docs.where(F.col(text).rlike("[^\\x00-\\x7F]")).select(text))
    counts: dict[str, int] | None = None
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: dict | None = counts) -> Iterator[pa.RecordBatch]:
            runs: Counter = Counter()
            memo: dict[str, bool] = {}
            who = Labeller(Letters(now)) if now is not None else None
            for b in batches:
                for t in b.column(0).to_pylist():
                    found = runs_of(t)
                    if who is None:
                        if any(_structural(r[2], memo) for r in found):
                            continue
                    elif labels := who.label(t, found):
                        found = runs_of(who.restore(t, labels))
                    runs.update((r[2], r[3]) for r in found)
            c = _letters(runs)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["gram", "n"])

        got = src.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        counts = {r["gram"]: r["n"] for r in got}
    return counts or {}


def find_garbled(docs: DataFrame, *, doc: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """Texts that were, whole or in part, read with a wrong encoding: (doc, esito, coppie, testo).

    ``esito`` is 'perso' if characters were replaced by U+FFFD, else 'intero'; ``coppie`` the encoding
    pairs of the spans found, in order; ``testo`` the restored text (where characters are lost, all that
    can be restored). Each run of non-ASCII characters is labelled by a hidden Markov model with one
    clean state, one for each encoding pair and one for lost characters; a garbled state gives a run the
    likelihood of its inverse under a letter model learned from all texts. ASCII is the same in all
    pairs, so texts of ASCII only, empty and null texts are never found. Unusual letters stay clean
    unless the inverse is so much likelier that it pays for the change of state. Repeated texts are
    reported each; the passes need no shuffle of texts.
    """
    counts = learn(docs, text, rounds)
    schema = T.StructType([docs.schema[doc], T.StructField("esito", T.StringType()), T.StructField("coppie", T.ArrayType(T.StringType())), T.StructField("testo", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Labeller(Letters(counts))
        for b in batches:
            keys, esito, pairs, texts = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                labels = who.label(t)
                if labels:
                    keys.append(i)
                    esito.append("perso" if LOST in t else "intero")
                    pairs.append([PAIRS[s - 1][0] if s < LOST_STATE else "lost" for s in dict.fromkeys(x[2] for x in labels) if s])
                    texts.append(who.restore(t, labels))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(esito, pa.string()), pa.array(pairs, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["d", "esito", "coppie", "testo"])

    return spread(docs.where(F.col(text).rlike("[^\\x00-\\x7F]")).select(doc, text)).mapInArrow(run, schema)
