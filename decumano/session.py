"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    The session's ``spark.checkpoint.dir`` is used wherever it is set. Only a
    session without it (tests, one machine) gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="decumano-ck-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    The written rows forget the size estimate of the plan they came from: a loop multiplies the estimates of
    its joins, which after some dozens of rounds are numbers of millions of digits that stall the planner.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    make = getattr(getattr(spark, "_jsparkSession", None), "internalCreateDataFrame", None)
    if make is None:
        return done
    return DataFrame(make(done._jdf.queryExecution().logical().rdd(), done._jdf.schema(), False), spark)


def row_numbers(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``name``: the place of each row, from 1, in the order of the columns ``order``; no task sorts all rows.

    Rows are partitioned by range and sorted within; only the row counts of the partitions reach the driver.
    """
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    s = cut(s.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("bigint"), 33)))
    before, at = [], 0
    for p, n in sorted(tuple(r) for r in s.groupBy("__p").agg(F.count(F.lit(1))).collect()):
        before += [F.lit(p), F.lit(at)]
        at += n
    start = F.element_at(F.create_map(*before), F.col("__p")) if before else F.lit(0)
    return s.withColumn(name, (start + F.col("__i") + 1).cast("bigint")).drop("__p", "__i")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps with much work a row.

    A scan that already has as many splits, as any large input has, is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
