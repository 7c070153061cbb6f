"""Language-model scoring: the marginal probability of a text over the lattice of its subword segmentations.

Model: a text is its words and an end. A word's probability is the sum, over all its segmentations into
pieces of an existing unigram vocabulary, of the product of the pieces' probabilities, found by the forward
recursion in log space; a text's is the product of its words' and of the end's. The vocabulary's scores are
ranks of merges, so their ranks give the pieces' first probabilities (proportional to 1 / (rank + 3));
`rounds` rounds of expected counts over the whole table of training words then fit them, with the first ones as
`prior_weight` pseudo-pieces; a round is one narrow pass with a vector of piece counts a task. Words that only
held-out documents have teach nothing. The pieces are never changed. Base: an add-one word model with counts from all training documents.

Plan: one pass counts words (merged within a task, then summed by word); the table of words grows with the
corpus and is checkpointed. The most frequent words, `head_words` at most, are broadcast; a second pass sums
their terms document by document and deals only the other words, each once a document, to the table. So a
frequent word is never a hot key, and no document's words gather in one task. Which words are broadcast goes by their
number in all documents, since held-out documents have hot words too; it decides where a word's term is added, never
what the term is.

Defined cases: null and wordless texts have the end alone; a null id counts as held out; repeated rows are
counted and scored row by row; an empty table gives an empty result, and without training documents N and V
are 0; a very long text is scored whole, in a block of its own. Only the id and text columns are read, so others may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice
from .common import IS_SPACE, blocks, checkpoint, mix, read, span_hashes, span_strings, spans, text_buffers


@dataclass(frozen=True)
class LatticeParams:
    model_path: str = lattice.DEFAULT_MODEL
    head_words: int = 1 << 17
    head_length: int = 48
    #: The fit's words, the most frequent of the training texts; None for all, as in the query.
    calibration_words: int | None = None
    rounds: int = 3
    prior_weight: float = 2000.0
    merge_words: int = 1_500_000
    lattice_words: int = 1 << 16
    lattice_bytes: int = 8 << 20


#: The end of a text in the table of words; no word is empty.
END = ""
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 7 == 2, F.lit(True))


def word_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: rows [lo, hi), lower-cased bytes, words' starts, ends, documents and hashes."""
    data, offsets = text_buffers(column)
    for lo, hi in blocks(offsets):
        part, at = _LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends = spans(~IS_SPACE[part], at)
        yield lo, hi, part, starts, ends, np.searchsorted(at, starts, side="right") - 1, span_hashes(part, starts, ends)


def _merge(parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    keys = np.concatenate([x[0] for x in parts])
    words = pa.concat_arrays([x[1] for x in parts])
    keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    sums = [np.bincount(inverse, weights=np.concatenate([x[k] for x in parts]), minlength=len(keys)).astype(np.int64) for k in (2, 3)]
    return keys, words.take(pa.array(first)), *sums


def count_words(docs: DataFrame, p: LatticeParams, id_column: str, text_column: str) -> DataFrame:
    """(word, c, n): a word's occurrences in training documents and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, ends_all, ends_train = [], 0, 0, 0
        names = ["word", "c", "n"]
        for batch in batches:
            train = ~batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            ends_all += len(train)
            ends_train += int(train.sum())
            for lo, _, part, starts, ends, doc, keys in word_blocks(batch.column(1)):
                if not len(keys):
                    continue
                keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                in_train = np.bincount(inverse, weights=train[lo + doc], minlength=len(keys)).astype(np.int64)
                parts.append((keys, span_strings(part, starts[first], ends[first]), in_train, np.bincount(inverse, minlength=len(keys))))
                size += len(keys)
                if size > p.merge_words:
                    parts = [_merge(parts)]
                    size = len(parts[0][0])
                    if size > p.merge_words // 2:
                        yield pa.RecordBatch.from_arrays([parts[0][1], pa.array(parts[0][2]), pa.array(parts[0][3])], names)
                        parts, size = [], 0
        if parts:
            _, words, c, n = _merge(parts)
            for lo in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([words.slice(lo, 100_000), pa.array(c[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names)
        if ends_all:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends_train]), pa.array([ends_all])], names)

    rows = docs.select(held_out(id_column).alias("_held"), F.col(text_column).alias("_text"))
    counted = rows.mapInArrow(count, "word string, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def frequent_words(table: DataFrame, p: LatticeParams) -> DataFrame:
    """All words of at least some frequency, `head_words` of them at most, and END. The frequency is found
    from counts by eighths of octaves, some hundred numbers, so no task sends the driver a head of its own."""
    eighth = F.floor(F.log2(F.col("n").cast("double")) * 8)
    short = table.where((F.length("word") <= p.head_length) & (F.col("word") != END))
    sizes = sorted(((r["e"], r["k"]) for r in short.groupBy(eighth.alias("e")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for e, k in sizes:
        total += k
        if total > p.head_words:
            break
        least = e
    some = short.where(eighth >= F.lit(least)) if least is not None else short.limit(0)
    return some.unionByName(table.where(F.col("word") == END))


class PieceModel:
    """Log probabilities of the vocabulary's pieces; `end` has that of the end of a text."""

    def __init__(self, v: lattice.Vocabulary, p: LatticeParams):
        self.v = v
        order = np.argsort(-v.scores[v.normal], kind="stable")
        ranked = np.concatenate((v.normal[order], v.byte_ids))
        prior = np.zeros(len(v.pieces))
        prior[ranked] = 1 / (np.arange(len(ranked)) + 3.0)
        self.end_piece = v.special[0]
        prior[self.end_piece] = prior.sum() / 100
        self.prior, self.weight = prior / prior.sum(), p.prior_weight
        self._set(self.prior)

    def _set(self, probability: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            self.log_p = np.log(probability)

    def log_words(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log marginals of words (END among them), and the pieces' expected counts under the weights."""
        out, expected = np.zeros(len(words)), np.zeros(len(self.log_p))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            step = max(1, (1 << 17) // (n + 1))
            for lo in range(0, len(at), step):
                some = np.array(at[lo : lo + step])
                if n == 0:
                    out[some] = self.log_p[self.end_piece]
                    expected[self.end_piece] += weights[some].sum() if weights is not None else 0
                    continue
                out[some], more = lattice.log_marginals(self.v, self.log_p, [" " + words[k] for k in some], None if weights is None else weights[some])
                expected += more if more is not None else 0
        return out, expected

    def refit(self, expected: np.ndarray) -> None:
        expected = expected + self.weight * self.prior
        self._set(expected / expected.sum())

    def calibrate(self, words: list[str], counts: np.ndarray, rounds: int) -> None:
        for _ in range(rounds):
            self.refit(self.log_words(words, counts)[1])


def word_batches(batches: Iterator[pa.RecordBatch], p: LatticeParams) -> Iterator[pa.RecordBatch]:
    """Batches of a table of words, joined to `lattice_words` rows or `lattice_bytes` bytes. Words of one length are done
    together, so a pass over a few of them costs as much as one over thousands."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= p.lattice_words or size >= p.lattice_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def calibrate_on(table: DataFrame, model: PieceModel, rounds: int, p: LatticeParams = LatticeParams()) -> None:
    """Fits the model on all words of table (word, c). The driver gets one row a piece and round."""
    for _ in range(rounds):
        held = table.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            expected = np.zeros(len(held.value.log_p))
            for batch in word_batches(batches, p):
                expected += held.value.log_words(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))[1]
            at = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(expected[at])], ["piece", "n"])

        sums = table.mapInArrow(count, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        expected = np.zeros(len(model.log_p))
        expected[sums.piece] = sums.n
        held.unpersist()
        if expected.any():
            model.refit(expected)


def lm_scores(docs: DataFrame, p: LatticeParams = LatticeParams(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 each)."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    table = checkpoint(count_words(docs, p, id_column, text_column))
    totals = table.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n_train, n_kinds = totals["n"] or 0, totals["v"] or 0

    head = frequent_words(table, p).toPandas()
    model = PieceModel(lattice.load(p.model_path), p)
    trained = table.where("c > 0").select("word", "c")
    calibrate_on(trained if p.calibration_words is None else checkpoint(trained.orderBy(F.desc("c"), "word").limit(p.calibration_words)), model, p.rounds, p)
    held_model = spark.sparkContext.broadcast(model)
    log_head = model.log_words(head.word.tolist())[0] / np.log(10)
    raw = [w.encode() for w in head.word]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in raw], np.int64)
    is_word = starts < ends
    flat = np.frombuffer(b"".join(raw), np.uint8)
    keys = np.zeros(len(raw), np.uint64)
    keys[is_word] = span_hashes(flat, starts[is_word], ends[is_word])
    c, end_at = head.c.to_numpy(np.int64), np.flatnonzero(~is_word)
    end_terms = (np.log10(c[end_at[0]] + 1.0), log_head[end_at[0]], c[end_at[0]] > 0) if len(end_at) else (0.0, 0.0, False)
    order = np.argsort(keys[is_word], kind="stable")
    held_head = spark.sparkContext.broadcast((keys[is_word][order], np.log10(c[is_word][order] + 1.0), log_head[is_word][order], c[is_word][order] > 0, end_terms))

    def score_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, log_p, known, end = held_head.value
        names = ["uid", "word", "tf", "doc"]
        for batch in batches:
            for lo, hi, part, starts, ends, doc, hashes in word_blocks(batch.column(3)):
                n = hi - lo
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                found = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                of, hit = doc[found], at[found]
                info = pa.StructArray.from_arrays(
                    [
                        batch.column(1).slice(lo, n),
                        batch.column(2).slice(lo, n),
                        pa.array(np.bincount(doc, minlength=n) + 1),
                        pa.array(np.bincount(of, weights=known[hit], minlength=n).astype(np.int64) + int(end[2])),
                        pa.array(np.bincount(of, weights=base[hit], minlength=n) + end[0]),
                        pa.array(np.bincount(of, weights=log_p[hit], minlength=n) + end[1]),
                    ],
                    ["id", "held", "n_tokens", "n_known", "base", "log_p"],
                )
                uid = batch.column(0).slice(lo, n)
                none = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([uid, none, pa.array(np.zeros(n, np.int64)), info], names)
                left = np.flatnonzero(~found)
                if not len(left):
                    continue
                pair = mix(hashes[left] + mix(doc[left].astype(np.uint64) + np.uint64(1)))
                _, first, times = np.unique(pair, return_index=True, return_counts=True)
                at = left[first]
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(doc[at])), span_strings(part, starts[at], ends[at]), pa.array(times.astype(np.int64)), pa.nulls(len(at), info.type)], names)

    def word_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in word_batches(batches, p):
            found = held_model.value.log_words(batch.column(0).to_pylist())[0] / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["_word", "c", "log_p"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("id"), held_out(id_column).alias("held"), F.col(text_column).alias("text"))
    dealt = rows.mapInArrow(score_head, f"uid long, word string, tf long, doc struct<id: {kind}, held: boolean, n_tokens: long, n_known: long, base: double, log_p: double>")
    terms = table.select("word", "c").mapInArrow(word_terms, "_word string, c long, log_p double")
    # rows that bear a document's own sums meet no word; the salt keeps their null keys from meeting each other
    key = F.coalesce("word", F.concat(F.lit("\n"), F.col("uid").cast("string")))
    joined = dealt.withColumn("key", key).join(terms.hint("shuffle_merge"), F.col("key") == F.col("_word"), "left")
    tf = F.col("tf")
    per_doc = joined.groupBy("uid").agg(
        F.max("doc").alias("doc"),
        F.sum(F.when(F.col("c") > 0, tf).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.coalesce(tf * F.log10(F.col("c") + F.lit(1.0)), F.lit(0.0))).alias("base"),
        F.sum(F.coalesce(tf * F.col("log_p"), F.lit(0.0))).alias("log_p"),
    )
    return per_doc.select(
        F.col("doc.id").alias(id_column),
        F.col("doc.held").alias("held_out"),
        F.col("doc.n_tokens").alias("n_tokens"),
        (F.col("doc.n_known") + F.col("n_known")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("doc.base") + F.col("base") - F.col("doc.n_tokens") * F.lit(float(np.log10(n_train + n_kinds + 1)))).alias("base_score"),
        (F.col("doc.log_p") + F.col("log_p")).alias("score"),
    )


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
