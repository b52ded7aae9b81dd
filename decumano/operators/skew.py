"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.01


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = 10_000) -> list:
    """The keys that hold at least ``share`` of the rows and ``least`` rows: at most 1 / share of them.

    One aggregation, combined before its shuffle; the total comes from the same counts.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n")).limit(int(1 / share)).collect()
    if not top:
        return []
    total = counts.agg(F.sum("n")).first()[0]
    return [r[key] for r in top if r["n"] >= share * total]


def skew_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, share: float = HOT_SHARE) -> DataFrame:
    """Left outer equi-join; ``right`` has at most one row a key.

    Rows of hot keys meet a broadcast of at most 1 / share rows and are not shuffled; all other
    rows take the shuffled join, where no key holds more than that share. Nothing is dropped.
    """
    hot = hot_keys(left, left_key, share)
    on = F.col(left_key) == F.col(right_key)
    if not hot:
        return left.join(right, on, "left")
    is_hot = F.col(left_key).isin(hot)
    cold = left.where(~is_hot | F.col(left_key).isNull()).join(right.where(~F.col(right_key).isin(hot)), on, "left")
    warm = left.where(is_hot).join(F.broadcast(right.where(F.col(right_key).isin(hot))), on, "left")
    return cold.unionByName(warm)
