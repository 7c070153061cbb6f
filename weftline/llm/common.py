"""Helpers shared by the operators of this subpackage: checkpoints, Arrow buffers and vectorised word scanning."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

#: Bytes of text that the vectorised scanners hold at once; a longer single document is still taken whole.
BLOCK_BYTES = 1 << 20

_mixer = np.random.default_rng(20240607)
BYTE_MIX = _mixer.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    light_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def light_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's defaults, so that a worker holds few texts at once; other settings stay."""
    for key, default, own in (("maxBytesPerBatch", "67108864b", "8m"), ("maxRecordsPerBatch", "10000", "2000")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary one only where none is set and there is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="weftline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_tasks(df: DataFrame, rows: int, rows_a_task: int) -> DataFrame:
    """`df`, known to have about so many rows, in a partition for each `rows_a_task` of them, or as it is if it has fewer.
    Small tables of a loop would else be spread over all shuffle partitions, a file each in every shuffle and checkpoint."""
    return df.coalesce(max(1, -(-rows // rows_a_task)))


#: Plan steps that give the same rows in the same order and partitions each time they run.
_REPLAYED = {"Project", "Filter", "LogicalRelation", "Relation", "LogicalRDD"}


def replayable(df: DataFrame) -> DataFrame:
    """`df`, written out first unless it is a plain scan of files, so that two readings number its rows alike."""
    pending, steps = [df._jdf.queryExecution().optimizedPlan()], set()
    while pending:
        node = pending.pop()
        steps.add(node.nodeName().split(" ")[0])
        below = node.children()
        pending += [below.apply(k) for k in range(below.size())]
    return df if steps <= _REPLAYED else checkpoint(df)


def local_path(uri: str) -> str:
    return uri[len("file:"):].replace("//", "/", 1) if uri.startswith("file:") else uri


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets into them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most `most` bytes together; a longer document is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact sums of integer values between offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:], dtype=np.int64)
    return total[offsets[1:]] - total[offsets[:-1]]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses an offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_places = np.zeros(0, np.uint64)


def places(n: int) -> np.ndarray:
    """A mixed key for each place in a run."""
    global _places
    if len(_places) < n:
        _places = mix(mix(np.arange(max(n, 1024, 2 * len(_places)), dtype=np.uint64) * _BASE + _BASE))
    return _places[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), ascending and disjoint: sums of a mixed value for each byte at
    its place. No polynomial, whose high powers of two cancel on texts built for it (Thue-Morse)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = BYTE_MIX[data[within + np.repeat(starts, lengths)]] + places(int(lengths.max()))[within]
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(29)
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where the key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_copies(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][ranked[1:] == ranked[:-1]]] = True
    return out


def gather_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one after the other."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte runs as an Arrow string column, without a Python string each."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[gather_index(starts, lengths)]))).cast(pa.string())
