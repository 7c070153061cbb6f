"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of a document contains a benchmark item if some region of it is within the item's edit budget:
`error_rate` of the item's length, and never so much that the lemma's bound falls below one. Both sides
are compared as UTF-8 bytes with A-Z lower-cased and white space collapsed.

Filter: an item of m bytes within k edits of a region shares at least m - q + 1 - k * q q-grams with it,
and all of them lie on diagonals at most k apart. Diagonals are cut into bands of 2 (k + 1), each
overlapping the next by half, so one band holds them all. Bands that reach the bound are verified by an
alignment restricted to the band's diagonals, free at both ends of the document's text.

The benchmark is the small side by its nature. It is read block by block (`block_bytes` of item text at
most); each block's index is broadcast, and documents are scanned in one narrow pass a block.

Defined cases: null and empty texts contain nothing; null and empty items match nothing; items shorter
than q bytes are sought exactly; of overlapping finds of one item in one document the nearest, then the
first, stays; repeated rows and repeated items each give their own rows; empty tables give an empty
result. A very long text is searched whole in a block of its own; equal q-grams are counted in slices, so texts and
items that repeat themselves hold no more memory than others, but for a row a band. Only the id and text columns are
read, so others may have any name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_MIX, IS_SPACE, blocks, mix, read, text_buffers


@dataclass(frozen=True)
class LemmaParams:
    q: int = 10
    error_rate: float = 0.08
    block_bytes: int = 16 << 20
    #: Cells of alignment tables held at once.
    cells: int = 1 << 22
    #: Pairs of an equal q-gram in a document and in an item that are held at once.
    hits: int = 1 << 19


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[IS_SPACE] = 0x20
_FILTER_BITS = 22


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal bytes, their document offsets and the place that each came from."""
    space = IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1]
    keep[starts[starts < len(data)]] = True
    kept = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    return _LOWER[data[keep]], kept[offsets], np.flatnonzero(keep)


def gram_hashes(d: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each place on, put together from hashes of powers of two of bytes."""
    if len(d) < q:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    width, power, part, out, done = 1, base, BYTE_MIX[d], None, 0
    while True:
        if q & width:
            piece = part[done:]
            out = piece if out is None else out[: len(piece)] * np.uint64(power) + piece
            done += width
        if done == q:
            return mix(out[: len(d) - q + 1])
        part = part[:-width] * np.uint64(power) + part[width:]
        width, power = width * 2, power * power % 2**64


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of `keys` in rising order, and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys, counts = keys[:, order], counts[order]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return keys[:, starts], np.add.reduceat(counts, starts) if len(starts) else counts


class GramIndex:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], p: LemmaParams):
        self.params = p
        self.ids, self.texts, self.short = [], [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").strip().encode(), np.uint8)
            d, _, _ = normalise(raw, np.array([0, len(raw)]))
            if len(d) >= p.q:
                self.ids.append(item_id)
                self.texts.append(d)
            elif len(d):
                self.short.append((item_id, d.tobytes()))
        m = np.array([len(x) for x in self.texts], np.int64)
        self.length = m
        self.budget = np.minimum(np.floor(m * p.error_rate), (m - p.q) // p.q).astype(np.int64)
        self.bound = m - p.q + 1 - self.budget * p.q
        grams = [gram_hashes(x, p.q) for x in self.texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def candidates(self, d: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and bands whose shared q-grams reach the lemma's bound."""
        none = (np.zeros(0, np.int64),) * 3
        hashes = gram_hashes(d, self.params.q)
        if not len(hashes) or not len(self.grams):
            return none
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        which = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        found = self.grams[which] == hashes[at]
        at, which = at[found], which[found]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + self.params.q <= offsets[doc + 1]
        at, which, doc = at[inside], which[inside], doc[inside]
        times = self.times[which]
        before = np.concatenate(([0], np.cumsum(times)))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for lo in range(0, int(before[-1]), self.params.hits):  # pairs of a document's place and an item's, in slices
            nth = np.arange(lo, min(lo + self.params.hits, int(before[-1])))
            hit = np.searchsorted(before, nth, side="right") - 1
            entry = self.first[which[hit]] + nth - before[hit]
            item = self.item[entry]
            band = np.floor_divide(at[hit] - self.place[entry], self.budget[item] + 1)
            of = doc[hit]
            keys = np.stack((np.concatenate((of, of)), np.concatenate((item, item)), np.concatenate((band, band - 1))))
            held.append(_counted(keys, np.ones(keys.shape[1], np.int64)))
            size += len(held[-1][1])
            if size > self.params.hits:
                held = [_counted(np.concatenate([k for k, _ in held], axis=1), np.concatenate([c for _, c in held]))]
                size = 0
        if not held:
            return none
        keys, counts = _counted(np.concatenate([k for k, _ in held], axis=1), np.concatenate([c for _, c in held]))
        return tuple(keys[:, counts >= self.bound[keys[1]]])

    def verify(self, d: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least distance of the item within each band, and the region [start, end) of d that has it."""
        n = len(doc)
        best, start, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(self.length[item], kind="stable")
        lo = 0
        while lo < n:
            width = int(4 * (self.budget[item[order[lo:]]].max(initial=0) + 1))
            hi = min(n, lo + max(1, self.params.cells // (8 * width)))
            some = order[lo:hi]
            best[some], start[some], end[some] = self._align(d, offsets, doc[some], item[some], band[some])
            lo = hi
        return best, start, end

    def _align(self, d, offsets, doc, item, band):
        k, m = self.budget[item], self.length[item]
        low = band * (k + 1) - k  # the first diagonal; a path may leave the band's diagonals by k on either side
        width = int((4 * (k + 1)).max())
        over = np.arange(width)[None, :]
        n = len(doc)
        first, last = offsets[doc][:, None], offsets[doc + 1][:, None]
        place = low[:, None] + over
        far = np.int64(1 << 20)
        cost = np.where((place >= first) & (place <= last) & (over < (4 * (k + 1))[:, None]), 0, far)
        begin = place.copy()
        pattern = np.zeros((n, int(m.max())), np.uint8)
        for row, x in enumerate(item):
            pattern[row, : m[row]] = self.texts[x]
        best, start, end = np.full(n, far), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(pattern.shape[1]):
            place = low[:, None] + over + i
            inside = (place >= first) & (place < last)
            same = inside & (d[np.clip(place, 0, len(d) - 1)] == pattern[:, i : i + 1])
            step = cost + ~same
            above = np.full_like(cost, far)
            above[:, :-1] = cost[:, 1:] + 1
            from_above = np.zeros_like(begin)
            from_above[:, :-1] = begin[:, 1:]
            take = above < step
            step, came = np.where(take, above, step), np.where(take, from_above, begin)
            slack = step - over
            run = np.minimum.accumulate(slack, axis=1)
            source = np.maximum.accumulate(np.where(slack == run, over, 0), axis=1)
            cost, begin = run + over, np.take_along_axis(came, source, axis=1)
            done = m == i + 1
            if done.any():
                at = cost[done].argmin(axis=1)
                rows = np.flatnonzero(done)
                best[rows], start[rows], end[rows] = cost[rows, at], begin[rows, at], low[rows] + at + i + 1
        return best, np.maximum(start, offsets[doc]), np.minimum(end, offsets[doc + 1])

    def find(self, data: np.ndarray, offsets: np.ndarray, inside: bool = True) -> list[tuple[int, int, int, int, int]]:
        """(document, item id, start, end, distance) of one block; starts and ends count bytes of the text. Items of
        fewer than q bytes are found within a text, or with inside=False only where they are the whole text."""
        d, at, origin = normalise(data, offsets)
        origin = np.append(origin, len(data))
        doc, item, band = self.candidates(d, at)
        out = []
        if len(doc):
            best, start, end = self.verify(d, at, doc, item, band)
            ok = best <= self.budget[item]
            rows = sorted(zip(doc[ok].tolist(), item[ok].tolist(), best[ok].tolist(), start[ok].tolist(), end[ok].tolist()))
            kept: list[tuple[int, int, int, int, int]] = []
            taken, of = ([], []), None  # starts and ends of the finds that stay, in order; they never overlap
            for x in rows:
                if of != x[:2]:
                    taken, of = ([], []), x[:2]
                k = bisect.bisect_left(taken[0], x[4])
                if not k or taken[1][k - 1] <= x[3]:
                    taken[0].insert(k, x[3])
                    taken[1].insert(k, x[4])
                    kept.append(x)
            out = [(a, self.ids[b], int(origin[s] - offsets[a]), int(origin[max(e - 1, s)] + 1 - offsets[a]), c) for a, b, c, s, e in kept]
        if self.short:
            for a in range(len(offsets) - 1):
                text = d[at[a] : at[a + 1]].tobytes()
                for item_id, x in self.short:
                    s = text.find(x) if inside or text.strip(b" ") == x else -1
                    while s >= 0:
                        s += int(at[a])
                        out.append((a, item_id, int(origin[s] - offsets[a]), int(origin[s + len(x) - 1] + 1 - offsets[a]), 0))
                        s = text.find(x, s - int(at[a]) + len(x))
        return out


def find_column(index: GramIndex, column: pa.Array, inside: bool = True) -> list[tuple[int, int, int, int, int]]:
    """As GramIndex.find, over a whole column; starts and ends count code points."""
    data, offsets = text_buffers(column)
    out = []
    for lo, hi in blocks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        for doc, item, s, e, distance in index.find(part, at, inside):
            text = part[at[doc] : at[doc] + e]
            before = int(((text[:s] & 0xC0) != 0x80).sum())
            out.append((lo + doc, item, before, before + int(((text[s:] & 0xC0) != 0x80).sum()), distance))
    return out


def indexes(benchmark: DataFrame, p: LemmaParams = LemmaParams()) -> Iterator[GramIndex]:
    """One index a block of items; `benchmark` has the items' ids and texts."""
    held, size = [], 0
    for item_id, text in benchmark.toLocalIterator():
        held.append((item_id, text))
        size += len((text or "").encode())
        if size >= p.block_bytes:
            yield GramIndex(held, p)
            held, size = [], 0
    yield GramIndex(held, p)


def contamination(docs: DataFrame, benchmark: DataFrame, p: LemmaParams = LemmaParams(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each find: the document's id, item_id, match_start, match_end (code points), distance."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(id_column, text_column)

    def scan(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = broadcast.value
            for batch in batches:
                found = find_column(index, batch.column(1))
                columns = list(zip(*found)) or [()] * 5
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in columns[1:])], [id_column, "item_id", "match_start", "match_end", "distance"])

        return run

    out = None
    for index in indexes(benchmark, p):
        held = docs.sparkSession.sparkContext.broadcast(index)
        part = rows.mapInArrow(scan(held), f"`{id_column}` {kind}, item_id long, match_start long, match_end long, distance long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: LemmaParams = LemmaParams(), text_column: str = "text") -> DataFrame:
    """The documents without a find, with all their columns. Items shorter than q bytes (see `short_items`)
    count only where they are a whole text: a bare "yes" stands in many that have nothing to do with the benchmark."""
    at = docs.columns.index(text_column)

    def clean(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = broadcast.value
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[x[0] for x in find_column(index, batch.column(at), inside=False)]] = False
                yield batch.filter(pa.array(mask))

        return run

    for index in indexes(benchmark, p):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


def short_items(benchmark: DataFrame, p: LemmaParams = LemmaParams()) -> DataFrame:
    """The items that `drop_contaminated` seeks as whole texts only: (item_id, text), fewer than q bytes once normalised."""
    normal = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return benchmark.where(F.octet_length(normal).between(1, p.q - 1)).select("item_id", "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return contamination(read(spark, sf_dir, "documents"), benchmark)
