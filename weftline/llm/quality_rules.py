"""Quality rules: counting rules and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte 4-grams: a trusted target (the documents a label
marks good) and the raw corpus (all documents). A document's score is the mean, over its n-grams, of
log(p_target / p_raw); documents below `threshold` are rejected. The table of ratios is rounded to
integers, so a score never depends on the order of summation or on how the table is partitioned.

Defined cases: a null text is the empty text; a text under four bytes has no n-gram, scores 0 and is left
to the counting rules; repeated rows are judged alike, row by row; an empty table gives an empty result
and a table without trusted documents a ratio of 0 for every n-gram. Only `id_column` and `text_column`
are read, so other columns may bear any name. A very long text is measured whole, in a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, blocks, checkpoint, later_copies, mix, read, repeated, segment_sum, span_hashes, spans, text_buffers

SYMBOLS = b"#*$%&|<>"
UNIT = 1 << 16


@dataclass(frozen=True)
class RuleParams:
    buckets_log2: int = 14
    smoothing: float = 1.0
    threshold: float = -0.3
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Trusted ids broadcast at once. Both multinomials are fitted on every document; more ids than this go
    #: block by block, so no text is shuffled, however many labels there are.
    block_ids: int = 1 << 20
    seed: int = 7


_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True


def gram_buckets(data: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of the 4-gram that starts at each byte but the last three."""
    d = data.astype(np.uint32)
    gram = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - bits)


def _gram_mask(n: int, offsets: np.ndarray) -> np.ndarray:
    """False where a 4-gram would run over the end of its document."""
    mask = np.ones(max(n - 3, 0), bool)
    for back in (1, 2, 3):
        at = offsets[1:] - back
        mask[at[(at >= 0) & (at < len(mask))]] = False
    return mask


def count_grams(data: np.ndarray, offsets: np.ndarray, trusted: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << bits
    if len(data) < 4:
        return np.zeros(size, np.int64), np.zeros(size, np.int64)
    mask, grams = _gram_mask(len(data), offsets), gram_buckets(data, bits)
    of_trusted = np.repeat(trusted, np.diff(offsets))[: len(mask)] & mask
    return np.bincount(grams[mask], minlength=size), np.bincount(grams[of_trusted], minlength=size)


def measure(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, p: RuleParams) -> dict[str, np.ndarray]:
    """All columns of one block of documents."""
    n = len(offsets) - 1
    in_word = ~IS_SPACE[data]
    starts, ends = spans(in_word, offsets)
    word_doc = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(word_doc, minlength=n)
    words = span_hashes(data, starts, ends)
    salt = mix(word_doc.astype(np.uint64) + np.uint64(1))

    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= p.window:
        last = len(words) - p.window + 1
        rolled = np.zeros(last, np.uint64)
        for j in range(p.window):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : j + last])
        whole = word_doc[:last] == word_doc[p.window - 1 :]
        at = np.flatnonzero(whole)
        at = at[repeated(rolled[at] ^ salt[at])]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + p.window, -1)
    n_repeat = np.bincount(word_doc, weights=np.cumsum(covered)[:-1] > 0, minlength=n).astype(np.int64)

    line_starts, line_ends = spans(data != 10, offsets)
    words_before = np.concatenate(([0], np.cumsum(in_word, dtype=np.int64)))
    with_word = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = span_hashes(data, line_starts, line_ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))
    n_dup_lines = np.bincount(line_doc, weights=later_copies(lines), minlength=n).astype(np.int64)

    if len(data) >= 4:
        mask = _gram_mask(len(data), offsets)
        ratio = np.zeros(len(data), np.int64)
        ratio[: len(mask)] = np.where(mask, table[gram_buckets(data, p.buckets_log2)], 0)
        total = segment_sum(ratio, offsets)
    else:
        total = np.zeros(n, np.int64)
    n_grams = np.maximum(np.diff(offsets) - 3, 0)
    base_failed = (n_words < p.min_words) | (100 * n_repeat > p.max_repeat_percent * n_words)
    trusted_like = total >= round(p.threshold * UNIT) * n_grams
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": segment_sum(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": segment_sum(_is_symbol[data], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "llr": total / UNIT / np.maximum(n_grams, 1),
        "kept": ~base_failed & trusted_like,
    }


def measure_column(column: pa.Array, table: np.ndarray, p: RuleParams) -> dict[str, np.ndarray]:
    data, offsets = text_buffers(column)
    parts = [measure(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table, p) for lo, hi in blocks(offsets)]
    parts = parts or [measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), table, p)]
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, p: RuleParams = RuleParams(), id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Integer log ratios by bucket, from counts over every document.

    trusted_ids has the ids of the trusted target in its only column. They are broadcast in blocks of about
    `block_ids`, dealt by hash; the first scan counts every document, each further one only its own block's
    trusted documents. The driver gets one row per bucket and scan, whatever the input.
    """
    bits, size = p.buckets_log2, 1 << p.buckets_log2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in blocks(offsets):
                r, g = count_grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], trusted[lo:hi], bits)
                raw += r
                good += g
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    ids = checkpoint(trusted_ids.toDF("_trusted").where("_trusted is not null").distinct())
    n_blocks = max(1, -(-ids.count() // p.block_ids))
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    raw, good = np.zeros(size), np.zeros(size)
    for k in range(n_blocks):
        block = ids.where(F.pmod(F.xxhash64("_trusted", F.lit(p.seed)), F.lit(n_blocks)) == k)
        rows = texts.join(F.broadcast(block), F.col("_id") == F.col("_trusted"), "left" if k == 0 else "inner")
        counts = (
            rows.select("_text", F.col("_trusted").isNotNull().alias("_good"))
            .mapInArrow(count, "bucket int, raw long, good long")
            .groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
            .toPandas()
        )
        if k == 0:
            raw[counts.bucket] = counts.raw
        good[counts.bucket] += counts.good
    if not good.sum():
        return np.zeros(size, np.int64)
    a = p.smoothing
    ratio = np.log((good + a) / (good.sum() + a * size)) - np.log((raw + a) / (raw.sum() + a * size))
    return np.round(ratio * UNIT).astype(np.int64)


def quality_rules(docs: DataFrame, table: np.ndarray, p: RuleParams = RuleParams(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, the rules' counts, llr and kept. A narrow pass, without a shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_column(batch.column(1), table, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], [id_column, *found])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(judge, f"`{id_column}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")


def keep_good(docs: DataFrame, table: np.ndarray, p: RuleParams = RuleParams(), text_column: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure_column(batch.column(at), table, p)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of the trusted target: labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    table = fit_ratio(docs, trusted_labels(read(spark, sf_dir, "labels")))
    return quality_rules(docs, table)
