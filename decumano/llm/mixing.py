"""Sources combined to target weights, interleaved block by block."""

from __future__ import annotations

import heapq
import math
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, spread

#: A vocabulary file of the ``tokenizers`` library; a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Tokens of a block, about; and the slots of a schedule, which is repeated for as long as the mixture is.
BLOCK, SLOTS = 1024, 20_000
#: Parts of a source whose sizes are added up first, so that no task sees a whole source.
PARTS = 1024


def token_counts(docs: DataFrame, text: str, tokenizer: str = TOKENIZER, name: str = "token") -> DataFrame:
    """Adds the number of tokens of the whole text; a null text has none (0)."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        tok = _tokenizer(tokenizer)
        out: list[int] = []
        rows = texts.to_pylist()
        for k in range(0, len(rows), 256):
            out.extend(len(e.ids) for e in tok.encode_batch_fast([t or "" for t in rows[k : k + 256]], add_special_tokens=False))
        return pa.array(out, pa.int64())

    return spread(docs).withColumn(name, count(text))


def _tokenizer(path: str, memo: dict = {}):  # noqa: B006 - one a worker
    if path not in memo:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        memo[path] = Tokenizer.from_file(path)
        memo[path].encode_special_tokens = True
    return memo[path]


@dataclass(frozen=True)
class Share:
    """What a source gives: ``tokens`` of its repeated stream of ``have`` tokens, at ``weight`` of the total."""

    source: str
    target: float
    repeats: int
    have: int
    tokens: int
    weight: float


def plan(targets: list[tuple[str, float, int]], have: dict[str, int], total: int | None = None) -> list[Share]:
    """Tokens by source, as near to the targets as the repeats allow.

    A source can give at most repeats x have tokens. Without ``total`` the largest total is taken at which
    every source that has text reaches its share (targets scaled to the sources that have any). With a
    greater ``total`` the sources that run out give all they can and the others share the rest in
    proportion, until all have run out.
    """
    most = {s: max(0, r) * have.get(s, 0) for s, _, r in targets}
    live = {s: w for s, w, _ in targets if most[s] > 0 and w > 0}
    give: dict[str, float] = {}
    if live:
        weight = sum(live.values())
        want = min(most[s] * weight / w for s, w in live.items()) if total is None else min(total, sum(most[s] for s in live))
        open_, left = dict(live), float(want)
        while open_:
            full = {s for s, w in open_.items() if left * w / sum(open_.values()) >= most[s] * (1 - 1e-12)}
            if not full:
                give |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
                break
            for s in full:
                give[s] = float(most[s])
            left -= sum(most[s] for s in full)
            open_ = {s: w for s, w in open_.items() if s not in full}
    all_ = sum(give.values())
    return [Share(s, w, r, have.get(s, 0), round(give.get(s, 0)), give.get(s, 0) / all_ if all_ else 0.0) for s, w, r in targets]


def schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The order of all blocks (source, number from 0), by Pfair scheduling on one processor.

    With weight w = its share of all blocks, block k of a source is released at floor(k / w) and due at
    ceil((k + 1) / w); in each slot the released block that is due first is taken. So in every prefix of
    n slots each source has less than one block more or less than n x w.
    """
    n = sum(blocks.values())
    waiting = [(0, s) for s in sorted(blocks) if blocks[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    done = dict.fromkeys(blocks, 0)
    out: list[tuple[str, int]] = []
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * n // blocks[s]), s))
        _, s = heapq.heappop(ready)
        out.append((s, done[s]))
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * n // blocks[s], s))
    return out


def cycle(shares: list[Share], block: int = BLOCK, slots: int = SLOTS) -> tuple[dict[str, int], int]:
    """(blocks of each source in one cycle, cycles): a schedule of at most about ``slots`` slots, repeated.

    Weights are periodic: with b of n slots a cycle, the schedule of one cycle repeated is the schedule of all
    blocks. A source is cut into exactly its blocks a cycle times the cycles, all of one size, about ``block``
    tokens whatever the total; so the deviation stays below one such block at any size.
    """
    used = sum(s.tokens for s in shares)
    n = max(1, min(slots, math.ceil(used / block)))
    blocks = {s.source: max(1, round(n * s.tokens / used)) for s in shares if s.tokens > 0}
    return blocks, max(1, math.ceil(used / (block * max(1, sum(blocks.values())))))


def _sizes(sized: DataFrame, targets: DataFrame, total: int | None) -> tuple[list[Share], DataFrame]:
    rows = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").orderBy("source").collect()]
    parts = cut(
        sized.where(F.col("token") > 0).groupBy("source", F.pmod(F.xxhash64("doc"), F.lit(PARTS)).alias("part")).agg(F.sum("token").alias("n"))
    )
    have = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    return plan([(s, float(w or 0), int(r or 0)) for s, w, r in rows], have, total), parts


def mix(docs: DataFrame, targets: DataFrame, *, doc: str, source: str, text: str, tokenizer: str = TOKENIZER, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of a mixture of sources by target weight.

    ``targets``: (source, target_share, max_repeats), the parameters, one row a source. Selection: (doc, source, ripetizione, token, blocco,
    posto), one row for each use of a document: ``ripetizione`` counts its uses from 1, ``blocco`` is the
    block of its source and ``posto`` the place of that block in the mixture. Report: (source,
    target_share, max_repeats, disponibili, usati, quota, ripetizioni): tokens at hand and used, actual
    share and most uses of one text; sources without text have 0.

    Sizes are tokens of whole texts. A source is a stream of its documents in the order of a hash, passed
    at most max_repeats times; a document is used if it begins before the source's tokens (``plan``) are
    reached, so a source exceeds them by less than one document. Documents of no listed source, without
    source or without text are not used; documents with one key are placed together, each used.
    Running sums are taken within PARTS parts of a source and over the parts, never over a whole source.
    """
    # Only texts of listed sources that may be used at all are tokenised.
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").select(F.col("source").alias("__s")).distinct()
    own = docs.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    if listed.limit(10_001).count() <= 10_000:
        listed = F.broadcast(listed)
    own = own.join(listed, F.col("source") == F.col("__s"), "left_semi")
    sized = cut(token_counts(own, "text", tokenizer).drop("text"))
    shares, parts = _sizes(sized, targets, total)
    blocks, cycles = cycle(shares)
    spark = docs.sparkSession
    slots = spark.createDataFrame([(s, k, n + 1) for n, (s, k) in enumerate(schedule(blocks))], "source string, nel_ciclo bigint, slot bigint")
    limits = spark.createDataFrame([(s.source, s.have, s.tokens, blocks.get(s.source, 0)) for s in shares], "source string, have bigint, want bigint, blocchi bigint")
    length = sum(blocks.values())
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.withColumn("base", F.coalesce(before, F.lit(0))).select("source", "part", "base")
    inner = F.sum("token").over(Window.partitionBy("source", "part").orderBy("h", "doc", "token", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        sized.where("token > 0")
        .withColumn("h", F.xxhash64("doc"))
        .withColumn("part", F.pmod("h", F.lit(PARTS)))
        .withColumn("row", F.monotonically_increasing_id())
        .join(F.broadcast(limits), "source")  # one row a source of the parameters
        .withColumn("inner", F.coalesce(inner, F.lit(0)))
        .join(base, ["source", "part"])
        .withColumn("start", F.col("base") + F.col("inner"))
    )
    uses = placed.where("start < want").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast((want - 1 - start) div have as int)"))))
    selection = (
        uses.withColumn("blocco", F.expr(f"cast((cast(epoch * have + start as decimal(38, 0)) * (blocchi * {cycles})) div want as bigint)"))
        .withColumn("nel_ciclo", F.expr("blocco % blocchi"))
        .join(F.broadcast(slots), ["source", "nel_ciclo"])
        .withColumn("posto", F.expr(f"(blocco div blocchi) * {length} + slot"))
        .select(F.col("doc").alias(doc), "source", (F.col("epoch") + 1).cast("bigint").alias("ripetizione"), F.col("token").cast("bigint").alias("token"), (F.col("blocco") + 1).alias("blocco"), "posto")
    )
    actual = selection.groupBy("source").agg(F.sum("token").alias("usati"), F.max("ripetizione").alias("ripetizioni"))
    report = (
        targets.where("source is not null").join(F.broadcast(limits.select("source", F.col("have").alias("disponibili"))), "source").join(actual, "source", "left")
        .select("source", "target_share", "max_repeats", "disponibili", F.coalesce("usati", F.lit(0)).alias("usati"), F.coalesce("ripetizioni", F.lit(0)).alias("ripetizioni"))
        .withColumn("quota", F.coalesce(F.try_divide("usati", F.sum("usati").over(Window.partitionBy())), F.lit(0.0)))
    )
    return selection, report
