"""A folder of archive files as a stream: each batch of changed files updates the fingerprints and what hangs from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def level_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Parquet files of levels as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def unit_extrema(stream: DataFrame) -> DataFrame:
    """Running extrema of each unit, the state of a stream of levels (unita, z)."""
    return stream.where("unita is not null and z is not null").groupBy("unita").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count(F.lit(1)).alias("quote"))


def refresh(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``apply`` on each batch of what is there now, then stop; a batch done before is not done again."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
