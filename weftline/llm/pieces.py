"""SentencePiece encoding and decoding: the best segmentation as a max-plus scan.

The score of a segmentation is the sum of its pieces' scores; encoding is the best path through the
lattice, so a stretch of text is a matrix in the (max, +) semiring: entry [i, j] is the best score over
pieces that start in the stretch, from offset i (where a piece of the stretch before ends) to offset j
beyond its end. Texts up to `chunk` characters are one stretch, in a narrow pass. Longer ones are cut, at
any place, into chunk rows dealt over all tasks: each row gives its transfer matrix; matrices multiply
within segments of `segment` chunks, then by document (one row a segment), which fixes the boundary states
of segments, then of chunks; each chunk is then traced back by itself. Within a chunk, atoms (see lattice)
make its matrix the outer sum of a head, the atoms between, and a tail; a chunk without a cut takes the
full recursion from every state.

Scores are the vocabulary's own, added in double precision. `round_trip` says that the ids decode to the
very bytes of the stretch.

Defined cases: null and empty texts have no ids; spaces, control characters and the space mark itself come
back exactly; characters outside the vocabulary are spelt in bytes; repeated rows give rows each; where two
paths tie, atoms take the longer last piece and chunk borders the smaller state; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice
from .common import blocks, checkpoint, read, text_buffers


@dataclass(frozen=True)
class PieceParams:
    model_path: str = lattice.DEFAULT_MODEL
    chunk: int = 1 << 15
    segment: int = 256


#: One table of atoms a worker process and vocabulary, kept between tasks.
_tables: dict[str, lattice.HashedAtoms] = {}


def _table(v: lattice.Vocabulary, key: str) -> lattice.HashedAtoms:
    if key not in _tables:
        _tables.clear()
        _tables[key] = lattice.HashedAtoms(v)
    return _tables[key]


def prefixed(column: pa.Array) -> pa.Array:
    """Texts with the leading space of the encoding; empty ones stay empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    return pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))


def encode_whole(v: lattice.Vocabulary, table: lattice.HashedAtoms, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: its first row, flat ids, offsets, scores and whether each text comes back."""
    data, offsets = text_buffers(prefixed(column))
    for lo, hi in blocks(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        ids, edges, scores = table.encode(part, at)
        if not np.array_equal(lattice.decode_flat(v, ids)[0], part):  # two atoms of one hash
            ids, edges, scores = table.plain.encode([bytes(part[a:b]).decode() for a, b in zip(at[:-1], at[1:])])
        decoded, length = lattice.decode_flat(v, ids)
        ends = np.concatenate(([0], np.cumsum(length)))[edges]
        same = np.diff(ends) == np.diff(at)
        if same.all():
            wrong = np.concatenate(([0], np.cumsum(decoded != part)))
            same = wrong[at[1:]] == wrong[at[:-1]]
        yield lo, ids, edges, scores, same


def last_cut(v: lattice.Vocabulary, text: str, head: int, own: int) -> int:
    """The last place in [head, own] that no piece can span, where head is one: before a run of spaces, or
    after a character that stands alone."""
    at = text.rfind(" ", head, own)
    while at > head and text[at - 1] == " ":
        at -= 1
    return max([head, at, *(text.rfind(c, head, own) + 1 for c in v.alone_chars)])


class Chunk:
    """A chunk of `own` characters with what of the text a piece can reach beyond it."""

    def __init__(self, v: lattice.Vocabulary, table: lattice.HashedAtoms, text: str, own: int):
        self.v, self.table, self.text, self.own = v, table, text, own
        head = v.atom.match(text).end() if text else 0
        self.head = head if head < own else None  # the first cut within the chunk
        self.tail = last_cut(v, text, head, own) if head < own else 0

    def _encode_middle(self) -> tuple[np.ndarray, float]:
        middle = self.text[self.head : self.tail]
        data = np.frombuffer(middle.encode(), np.uint8)
        ids, _, scores = self.table.encode(data, np.array([0, len(data)]))
        if not np.array_equal(lattice.decode_flat(self.v, ids)[0], data):  # two atoms of one hash
            ids, _, scores = self.table.plain.encode([middle])
        return ids, float(scores[0])

    def matrix(self) -> np.ndarray:
        size, n = self.v.max_length, len(self.text)
        out = np.full((size, size), -np.inf)
        if self.head is None:
            sources = list(range(min(size, n + 1)))
            best, _, _ = lattice.paths(self.v, self.text, self.own, sources)
            reach = min(size, n - self.own + 1)
            out[: len(sources), :reach] = best[:, self.own : self.own + reach]
            return out
        sources = list(range(min(size, self.head + 1)))
        head = lattice.paths(self.v, self.text[: self.head], self.head, sources)[0][:, self.head]
        tail, own = self.text[self.tail :], self.own - self.tail
        best = lattice.paths(self.v, tail, own, [0])[0][0]
        reach = min(size, len(tail) - own + 1)
        out[: len(sources), :reach] = head[:, None] + self._encode_middle()[1] + best[own : own + reach]
        return out

    def trace(self, i: int, j: int) -> tuple[np.ndarray, float]:
        """Ids and score of the best path from entry state i to exit state j."""
        v, end = self.v, self.own + j
        if self.head is None:
            best, came, by = lattice.paths(v, self.text, self.own, [i])
            return np.array(lattice.trace(v, self.text, came[0], by[0], i, end), np.int64), float(best[0, end])
        best, came, by = lattice.paths(v, self.text[: self.head], self.head, [i])
        ids, score = lattice.trace(v, self.text, came[0], by[0], i, self.head), float(best[0, self.head])
        middle, more = self._encode_middle()
        tail = self.text[self.tail :]
        best, came, by = lattice.paths(v, tail, self.own - self.tail, [0])
        last = lattice.trace(v, tail, came[0], by[0], 0, end - self.tail)
        return np.concatenate((np.array(ids, np.int64), middle, np.array(last, np.int64))), score + more + float(best[0, end - self.tail])


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray], entry: int, end: int) -> list[tuple[int, int]]:
    """Entry and exit state of each stretch on the best path from state `entry` to state `end`."""
    forward = [np.where(np.arange(len(matrices[0])) == entry, 0.0, -np.inf)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    out, j = [], end
    for m, f in zip(reversed(matrices), reversed(forward[:-1])):
        i = int((f + m[:, j]).argmax())
        out.append((i, j))
        j = i
    return out[::-1]


_RESULT = "chunk_no long, n_chunks long, n_tokens long, score double, ids array<int>, round_trip boolean"


def _ids_array(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(flat[edges[0] : edges[-1]].astype(np.int32)))


def encode(docs: DataFrame, p: PieceParams = PieceParams(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document, or for each chunk of a long one: its id, chunk_no, n_chunks, n_tokens,
    score, ids, round_trip."""
    spark = docs.sparkSession
    v = lattice.load(p.model_path)
    if p.chunk < v.max_length:
        raise ValueError("a chunk holds the longest piece")
    held, key = spark.sparkContext.broadcast(v), p.model_path
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "chunk_no", "n_chunks", "n_tokens", "score", "ids", "round_trip"]
    schema = f"`{id_column}` {kind}, {_RESULT}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(held.value, key)
        for batch in batches:
            for lo, ids, edges, scores, same in encode_whole(held.value, table, batch.column(1)):
                n = len(scores)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, np.int64)), pa.array(np.diff(edges)), pa.array(scores), _ids_array(ids, edges), pa.array(same)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = held.value.max_length - 1
        for batch in batches:
            for uid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = " " + text.as_py()
                n = -(-len(text) // p.chunk)
                for lo in range(0, n, 64):
                    nos = range(lo, min(n, lo + 64))
                    parts = [text[k * p.chunk : (k + 1) * p.chunk + over] for k in nos]
                    own = [min(p.chunk, len(text) - k * p.chunk) for k in nos]
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(nos)), pa.repeat(doc, len(nos)), pa.array(nos, pa.int64()), pa.array([n] * len(nos), pa.int64()), pa.array(own, pa.int64()), pa.array(parts, pa.string())], ["uid", "_id", "no", "n", "own", "part"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(held.value, key)
        for batch in batches:
            uid, no, own, part = (batch.column(k) for k in range(4))
            found = [Chunk(held.value, table, t, o).matrix().tobytes() for o, t in zip(own.to_pylist(), part.to_pylist())]
            yield pa.RecordBatch.from_arrays([uid, no, pa.array([x // p.segment for x in no.to_pylist()], pa.int64()), pa.array(found, pa.binary())], ["uid", "no", "seg", "m"])

    size = v.max_length
    back = lambda column: [np.frombuffer(x).reshape(size, size) for x in column]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ms = back(pdf.sort_values("no").m)
        out = ms[0]
        for m in ms[1:]:
            out = max_plus(out, m)
        return pd.DataFrame({"uid": pdf.uid[:1], "seg": pdf.seg[:1], "m": [out.tobytes()]})

    def of_segments(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        states = boundary_states(back(pdf.m), 0, 0)
        return pd.DataFrame({"uid": pdf.uid, "seg": pdf.seg, "i": [x for x, _ in states], "j": [x for _, x in states]})

    def of_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        states = boundary_states(back(pdf.m), int(pdf.i.iloc[0]), int(pdf.j.iloc[0]))
        return pd.DataFrame({"uid": pdf.uid, "no": pdf.no, "i": [x for x, _ in states], "j": [x for _, x in states]})

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = held.value, _table(held.value, key)
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 16):  # a few chunks' ids at a time
                batch = whole_batch.slice(lo, 16)
                own, part, i, j = (batch.column(k).to_pylist() for k in range(3, 7))
                found = [Chunk(v, table, t, o).trace(a, b) for o, t, a, b in zip(own, part, i, j)]
                same = [lattice.decode_flat(v, x)[0].tobytes() == t[a : o + b].encode() for (x, _), o, t, a, b in zip(found, own, part, i, j)]
                lengths = np.array([len(x) for x, _ in found], np.int64)
                ids = _ids_array(np.concatenate([x for x, _ in found]), np.concatenate(([0], np.cumsum(lengths))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths), pa.array([y for _, y in found], pa.float64()), ids, pa.array(same, pa.bool_())], names)

    # chunks cost far more than their bytes tell, so their tasks must not be merged by size
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), text.alias("_text"))
    short = rows.where(F.length("_text") < p.chunk).mapInArrow(whole, schema)
    long = rows.where(F.length("_text") >= p.chunk).select(F.monotonically_increasing_id().alias("uid"), "_id", "_text")
    chunks = checkpoint(long.mapInArrow(cut, f"uid long, _id {kind}, no long, n long, own long, part string").repartition(n_tasks, "uid", "no"))
    found = checkpoint(chunks.select("uid", "no", "own", "part").mapInArrow(matrices, "uid long, no long, seg long, m binary"))
    segments = found.repartition(n_tasks, "uid", "seg").groupBy("uid", "seg").applyInPandas(product, "uid long, seg long, m binary")
    states = segments.groupBy("uid").applyInPandas(of_segments, "uid long, seg long, i long, j long")
    states = found.join(states, ["uid", "seg"]).groupBy("uid", "seg").applyInPandas(of_chunks, "uid long, no long, i long, j long")
    traced = chunks.join(states, ["uid", "no"]).select("_id", "no", "n", "own", "part", "i", "j").mapInArrow(backtrace, schema)
    return short.unionByName(traced)


def decode(encoded: DataFrame, p: PieceParams = PieceParams(), ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """`encoded` with the text of each row's ids; chunk_no 0 loses the leading space of the encoding. A
    document's text is its chunks' texts in order. Null ids give a null text."""
    held, at = encoded.sparkSession.sparkContext.broadcast(lattice.load(p.model_path)), encoded.columns
    ids_at, no_at = at.index(ids_column), at.index("chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids, no in zip(batch.column(ids_at).to_pylist(), batch.column(no_at).to_pylist()):
                text = None if ids is None else held.value.decode(ids)
                texts.append(text[1:] if text and not no and text[0] == " " else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*at, text_column])

    return encoded.mapInArrow(run, encoded.withColumn(text_column, F.lit("")).schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
