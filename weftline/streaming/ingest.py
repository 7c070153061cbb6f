"""Incremental ingest of pages: a landing folder, each page once, groups let through when complete."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.sources.sinks import commit_batch

PAGES = "page_id long, url string, html string"


def read_landing(spark: SparkSession, folder: str, schema: str = PAGES, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> None:
    """Takes in all that is there, in batches that are committed once each; keys seen before are left out.
    State and progress are in `checkpoint`, so a broken run goes on where it stopped."""
    fresh = stream.dropDuplicates(keys)
    query = fresh.writeStream.foreachBatch(lambda df, n: commit_batch(df, target, f"batch-{n:012d}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def gate_groups(stream: DataFrame, group: str, key: str, least: int = 2) -> DataFrame:
    """Members of a group, held back until `least` of them have come, then let through as they come. The
    state of a group is its held keys, fewer than `least`, or the mark that it is open."""

    def run(name: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, held = state.get if state.exists else (False, [])
        for part in parts:
            held = [*held, *part[key].tolist()]
            if is_open or len(held) >= least:
                yield pd.DataFrame({group: [name[0]] * len(held), key: held})
                is_open, held = True, []
        state.update((is_open, held))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"`{group}` {kinds[group]}, `{key}` {kinds[key]}"
    return stream.groupBy(group).applyInPandasWithState(run, out, f"is_open boolean, held array<{kinds[key]}>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window of event time, with a watermark for late ones."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end into a memory table; for tests and small results."""
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
