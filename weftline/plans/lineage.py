"""Checkpoints in the session's shared folder, and row numbers without a one-task window."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and there is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="weftline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least_bytes: int = 4 << 20) -> DataFrame:
    """A table read from few small files, dealt over all cores before a costly kernel. Inputs of at least
    `least_bytes` a core by Spark's own estimate have enough splits of their own and are left alone, so a
    large table is never shuffled for this."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * least_bytes else df


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most `rows`, so that what a kernel holds as Python objects is bounded whatever the
    size of Spark's batches, which grow with a partition up to 10,000 rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """`df` with the sum of `value` over the rows before each one in a total order. Rows are range-partitioned; each
    partition sums up its own, and one sum a partition is added up in one place."""
    tagged = df.withColumns({f"_o{i}": c for i, c in enumerate(order)} | {"_v": value})
    keys = [f"_o{i}" for i in range(len(order))]
    tagged = checkpoint(tagged.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sums = tagged.groupBy("_part").agg(F.sum("_v").alias("_s"))
    offsets = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tagged.withColumn("_own", own).join(F.broadcast(offsets), F.col("_part") == F.col("_p"))  # a row a partition
    return ranked.withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_p", "_before", "_own", "_v", *keys)


def rank_rows(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with each row's place (from 0) in a total order. Rows are range-partitioned and sorted; only one
    count a partition is added up in one place."""
    tagged = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    tagged = checkpoint(tagged.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = tagged.join(F.broadcast(offsets), part == F.col("_part"))  # a row a partition
    return ranked.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_before", *keys)
