"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of `passage_words` words. A passage becomes a feature vector (square roots
of the relative counts of hashed byte 3-grams, and shares of upper case, symbols, repeated words and so
on) and, by a learned layer, an embedding h. Gated attention gives the passage the weight
softmax(w . (tanh(V h) * sigmoid(U h))); the weighted sum of the embeddings is the document's
representation, from which a logistic unit gives the score. Only the documents' labels are learned from.

Fit: on at most `fit_documents` labelled rows of each label, those with the smallest hash of their id, in that order; a row
whose passages would bring its label's to more than half of `fit_passages` is passed over, and the next one that fits is
taken. Every passage of a fitted row is used. The two numbers bound what the driver holds. Scores use every passage of every document in one narrow pass.

Defined cases: a null or wordless text is one passage with all features zero; without labels of both
kinds, or texts short enough of both, a warning is given and every score is the share of label 1 (0.5 without any); repeated rows get equal scores; an empty
table gives an empty result; a very long text is one bag in a block of its own. Labels, ids and other columns are
never inputs of a score; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, blocks, checkpoint, mix, read, span_hashes, spans, text_buffers


@dataclass(frozen=True)
class MilParams:
    passage_words: int = 64
    buckets_log2: int = 8
    hidden: int = 24
    attention: int = 12
    fit_documents: int = 2500
    fit_passages: int = 80_000
    epochs: int = 30
    rate: float = 4e-3
    decay: float = 1e-4
    seed: int = 7
    threshold: float = 0.7


_STATS = 10
_UPPER, _LETTER, _SYMBOL, _DIGIT, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL[list(b"#*$%&|<>^~{}[]\\=_@")] = True
_DIGIT[48:58] = True
_LINE[10] = True


def features(data: np.ndarray, offsets: np.ndarray, p: MilParams) -> tuple[np.ndarray, np.ndarray]:
    """A row of features a passage and the number of passages of each document, one at least."""
    n, size = len(offsets) - 1, 1 << p.buckets_log2
    starts, ends = spans(~IS_SPACE[data], offsets)
    word_doc = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(word_doc, minlength=n)
    passages = np.maximum(-(-n_words // p.passage_words), 1)
    first = np.cumsum(passages) - passages
    nth = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[word_doc]
    of_word = first[word_doc] + nth // p.passage_words
    total = int(passages.sum())

    begin = np.repeat(offsets[:-1], passages)  # a document's first passage has also what stands before its first word
    head = np.flatnonzero((nth % p.passage_words == 0) & (nth > 0))
    begin[of_word[head]] = starts[head]
    length = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(total), length)

    out = np.zeros((total, size + _STATS), np.float32)
    if len(data) >= 3:
        d = data.astype(np.uint32)
        gram = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
        bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - p.buckets_log2)
        whole = of_byte[:-2] == of_byte[2:]
        counts = np.bincount(of_byte[:-2][whole] * size + bucket[whole], minlength=total * size).reshape(total, size)
        out[:, :size] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    n_bytes = np.maximum(length, 1)
    words = np.bincount(of_word, minlength=total)
    n_word = np.maximum(words, 1)
    share = lambda table: np.bincount(of_byte, weights=table[data], minlength=total)
    letters = np.maximum(share(_LETTER), 1)
    keys = span_hashes(data, starts, ends) ^ mix(of_word.astype(np.uint64) + np.uint64(1))
    distinct = np.unique(keys, return_index=True)[1]
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    stats = out[:, size:]
    stats[:, 0] = share(_UPPER) / letters
    stats[:, 1] = share(_SYMBOL) / n_bytes
    stats[:, 2] = share(_DIGIT) / n_bytes
    stats[:, 3] = share(IS_SPACE) / n_bytes
    stats[:, 4] = share(_LINE) / n_bytes
    stats[:, 5] = np.bincount(of_word, weights=ends - starts, minlength=total) / n_word / 16
    stats[:, 6] = np.bincount(of_word[distinct], minlength=total) / n_word
    stats[:, 7] = np.bincount(of_word, weights=again, minlength=total) / n_word
    stats[:, 8] = np.log1p(words)
    stats[:, 9] = share(np.arange(256) == 33) / n_bytes
    stats[words == 0] = 0
    return out, passages


def feature_blocks(column: pa.Array, p: MilParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for lo, hi in blocks(offsets):
        yield lo, *features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class MilModel:
    """Gated-attention network; `weights` are plain arrays, fitted by Adam on the weighted log loss."""

    def __init__(self, n_features: int, p: MilParams, prior: float = 0.5):
        r = np.random.default_rng(p.seed)
        init = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.params = p
        self.shift, self.scale = np.zeros(n_features, np.float32), np.ones(n_features, np.float32)
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        self.weights = {"W": init(n_features, p.hidden), "b": np.zeros(p.hidden), "V": init(p.hidden, p.attention), "U": init(p.hidden, p.attention), "w": init(p.attention, 1)[:, 0], "c": np.zeros(p.hidden), "d": np.array([np.log(prior / (1 - prior))])}

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.shift) / self.scale, -6, 6)

    def _forward(self, x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        q = self.weights
        starts = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        h = np.tanh(x @ q["W"] + q["b"])
        a, g = np.tanh(h @ q["V"]), _sigmoid(h @ q["U"])
        e = (a * g) @ q["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / _sums(e, starts)[bag]
        z = _sums(alpha[:, None] * h, starts)
        return {"starts": starts, "bag": bag, "h": h, "a": a, "g": g, "alpha": alpha, "z": z, "p": _sigmoid(z @ q["c"] + q["d"][0])}

    def score(self, x: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x), passages)["p"]

    def _gradients(self, x, passages, y, weight):
        q, f = self.weights, self._forward(x, passages)
        h, a, g, alpha, bag = f["h"], f["a"], f["g"], f["alpha"], f["bag"]
        dl = (f["p"] - y) * weight / len(y)
        dz = (dl[:, None] * q["c"])[bag]
        dalpha = (h * dz).sum(axis=1)
        de = alpha * (dalpha - _sums(alpha * dalpha, f["starts"])[bag])
        dag = de[:, None] * q["w"]
        da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
        dh = (alpha[:, None] * dz + da @ q["V"].T + dg @ q["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}

    def fit(self, x: np.ndarray, passages: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        p, r = self.params, np.random.default_rng(self.params.seed)
        self.shift, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = self._scaled(x)
        starts = np.cumsum(passages) - passages
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(p.epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(order), 64):
                some = order[lo : lo + 64]
                rows = np.concatenate([np.arange(starts[i], starts[i] + passages[i]) for i in some])
                step += 1
                for k, grad in self._gradients(x[rows], passages[some], y[some], weight[some]).items():
                    grad = grad + p.decay * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    self.weights[k] = self.weights[k] - p.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(True))


def _fitting(sizes: pd.DataFrame, most: int) -> list[tuple]:
    """(id, passages) in the order given, without the texts that would exceed `most` passages in all."""
    taken, total = [], 0
    for i, n in zip(sizes["_id"].tolist(), sizes["n"].tolist()):
        if total + n <= most:
            taken.append((i, n))
            total += n
    return taken


def fit_mil(docs: DataFrame, labels: DataFrame, p: MilParams = MilParams(), id_column: str = "doc_id", text_column: str = "text") -> MilModel:
    """labels: id_column and `label` (0 or 1), already without held-out rows. Conflicting labels of an id count as 0."""
    clean = labels.where("label in (0, 1)").groupBy(id_column).agg(F.min("label").alias("label")).where(F.col(id_column).isNotNull())
    shares = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    model = MilModel((1 << p.buckets_log2) + _STATS, p, (shares.get(1, 0) / sum(shares.values())) if shares else 0.5)
    if len(shares) < 2:
        warnings.warn("labels of one kind only: the classifier answers with their share", stacklevel=2)
        return model
    by_hash = [F.xxhash64(F.col(id_column), F.lit(p.seed)), F.col(id_column)]
    sample = [clean.where(F.col("label") == k).orderBy(*by_hash).limit(p.fit_documents) for k in (0, 1)]
    picked = F.broadcast(sample[0].union(sample[1]).select(F.col(id_column).alias("_picked"), "label"))  # 2 * fit_documents rows at most
    rows = docs.join(picked, F.col(id_column) == F.col("_picked")).select(F.col(id_column).alias("_id"), "label", F.col(text_column).alias("_text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x, passages in feature_blocks(batch.column(2), p):
                bags = [b.astype(np.float16).tobytes() for b in np.split(x, np.cumsum(passages)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, len(passages)), batch.column(0).slice(lo, len(passages)), pa.array(passages, pa.int64()), pa.array(bags, pa.binary())], ["label", "_id", "n", "x"])

    kind = docs.schema[id_column].dataType.simpleString()
    made = checkpoint(rows.mapInArrow(collect, f"label int, _id {kind}, n long, x binary").withColumn("h", F.xxhash64("_id", F.lit(p.seed))))
    sizes = made.groupBy("label", "_id", "h").agg(F.min("n").alias("n")).toPandas().sort_values(["h", "_id"])  # 2 * fit_documents rows
    taken = [_fitting(sizes[sizes.label == k], p.fit_passages // 2) for k in (0, 1)]
    if not all(map(len, taken)):
        warnings.warn("no labelled text of one label has few enough passages: the classifier answers with the labels' share", stacklevel=2)
        return model
    chosen = docs.sparkSession.createDataFrame([(i, int(n)) for rows in taken for i, n in rows], f"_id {kind}, n long")
    got = made.join(F.broadcast(chosen), ["_id", "n"]).groupBy("_id", "label").agg(F.min("x").alias("x")).toPandas().sort_values("_id")
    bags = [np.frombuffer(x, np.float16).reshape(-1, (1 << p.buckets_log2) + _STATS) for x in got.x]
    y = got.label.to_numpy(float)
    fitted = {k: max((y == k).sum(), 1) for k in (0, 1)}
    weight = np.where(y == 1, shares[1] / fitted[1], shares[0] / fitted[0])  # back to the labels' own shares
    model.fit(np.concatenate(bags).astype(np.float32), np.array([len(b) for b in bags]), y, weight / weight.mean())
    return model


def score_column(model: MilModel, column: pa.Array) -> np.ndarray:
    parts = [model.score(x, passages) for _, x, passages in feature_blocks(column, model.params)]
    return np.concatenate(parts) if parts else np.zeros(0)


def classify(docs: DataFrame, model: MilModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, score (0 to 1) and predicted (1 from the threshold on)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_column(held.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= held.value.params.threshold).astype(np.int32))], [id_column, "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")


def keep_predicted(docs: DataFrame, model: MilModel, text_column: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_column(held.value, batch.column(at)) >= held.value.params.threshold))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_mil(docs, training_labels(read(spark, sf_dir, "labels")))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
