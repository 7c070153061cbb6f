"""Near-duplicate classes by exact Jaccard similarity of word shingles.

A document is the set of its `shingle`-word runs, A-Z lower-cased, as 64-bit hashes. Two documents link if the
Jaccard similarity of their sets is at least `percent` / 100; a class is a component of the links.

Candidates come first from SimHash fingerprints of the same `shingle`-word runs, linked at `radius` or fewer differing
bits by BK-trees (`simhash.links`). At a similarity of 0.8 fingerprints often lie further apart, so others come from
`bands` x `rows` minimum hashes. Two documents meet in a band if its `rows` minima agree; at a
similarity of 0.8 a pair meets in none of the 32 bands with a probability of (1 - 0.8 ** 4) ** 32 = 5e-8. A byte of
each of the 128 minima is the document's sketch; a pair that agrees in fewer than `least_agreed` of them is passed
over, which befalls a pair at 0.8 with a probability of 3e-8. Every other candidate is decided by its whole sets, so
nothing but those chances is lost and nothing is linked wrongly. Every pair within the radius lies in one component of
the fingerprint links, and is decided there. Equal sets are one node at once, so a group of exact
copies is one row.

A band of n near copies would give n * n / 2 pairs. So each of `rounds` rounds first compares the band's members
with one of them (another one each round); members of one component need no further comparison. Then the members of
bands that still have more than one component are dealt into blocks of about `block_members`: a large component's into
blocks of its own, which never meet each other, and those of small ones together. Two blocks of a band meet in one
row, where sketches are compared; what comes out is a spanning forest of the pairs that pass, not the pairs. Its
components are groups that hold every candidate pair, and each document is in one of them. The groups are dealt into
blocks again, now with whole sets, which are compared where two blocks meet; spanning links come out. So rows grow with
the documents, however many of them are alike; only the comparisons within a group grow with its square.

Whole sets are made in one scan whatever the input, for documents whose bit in a bitmap of the wanted ones is set; the
bitmap has 64 times as many bits as there are wanted documents, `bitmap_bits_log2` at most, and what it lets through
in error a join drops.

Defined cases: a null text is the empty text; texts without a word have equal, empty sets; a text with fewer
words than a shingle has one shingle, its whole word sequence; a very long text is one set like any other, made in a
block of its own; repeated rows keep one result each; a null id never becomes a component's id unless the component
has no other; an empty table gives an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import IS_SPACE, blocks, checkpoint, few_tasks, mix, replayable, span_hashes, spans, text_buffers
from .simhash import SimHashParams, components


@dataclass(frozen=True)
class NearDedupParams:
    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    rounds: int = 1
    least_agreed: int = 76
    block_members: int = 512
    members_a_task: int = 4096
    bitmap_bits_log2: int = 27
    seed: int = 42
    radius: int = 3

    @property
    def simhash(self) -> SimHashParams:
        return SimHashParams(shingle=self.shingle, radius=self.radius)


#: Shingles of an average set; blocks of longer sets have fewer members.
_SET_SIZE = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, p: NearDedupParams) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document in rising order, one document after the other, and their offsets."""
    n, k = len(offsets) - 1, p.shingle
    data = _LOWER[data]
    starts, ends = spans(~IS_SPACE[data], offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = span_hashes(data, starts, ends)
    n_words = np.bincount(doc, minlength=n)
    last = max(len(words) - k + 1, 0)
    rolled = np.zeros(last, np.uint64)
    for j in range(k):
        rolled = mix(rolled * _STEP + words[j : j + last])
    whole = doc[:last] == doc[k - 1 :][:last]
    values, of = rolled[whole], doc[:last][whole]
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    few = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        there = n_words[short] > j
        few[there] = mix(few[there] * _STEP + words[first[short[there]] + j])
    few = mix(few + n_words[short].astype(np.uint64))  # not the start of a longer run
    values, of = np.concatenate((values, few)), np.concatenate((of, short))
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=n))))


def _segments(f, values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """The ufunc's reduction of each segment, `empty` for one without a value."""
    out = np.full(len(offsets) - 1, empty, np.uint64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = f.reduceat(values, offsets[:-1][some])
    return out


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = _segments(np.add, mix(mix(values) * _STEP), offsets, 0)
    other = _segments(np.bitwise_xor, mix(mix(values + _STEP)), offsets, 0)
    return mix(mix(total + np.diff(offsets).astype(np.uint64)) * _STEP ^ other)


def band_keys(values: np.ndarray, offsets: np.ndarray, p: NearDedupParams) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, a row a document and a column a band; and sketches, a byte a minimum."""
    factors = np.random.default_rng(p.seed).integers(1, 2**63, (p.bands, p.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    spread, n = mix(values), len(offsets) - 1
    out, sketch = np.zeros((n, p.bands), np.uint64), np.zeros((n, p.bands * p.rows), np.uint8)
    for b in range(p.bands):
        key = np.full(n, b + 1, np.uint64)
        for r, factor in enumerate(factors[b]):
            low = _segments(np.minimum, spread * factor, offsets, 0)
            key = mix(key * _STEP + low)
            sketch[:, b * p.rows + r] = mix(low) >> np.uint64(56)
        out[:, b] = key
    return out, sketch


def _sets(column: pa.Array, p: NearDedupParams) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for lo, hi in blocks(offsets):
        yield lo, hi, *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p)


def _lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def signatures(rows: DataFrame, p: NearDedupParams) -> DataFrame:
    """rows (uid, id, text) to uid, id, key (of the set), n (its size), bands, sketch (16 longs) and fp (the SimHash); a
    narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, offsets in _sets(batch.column(2), p):
                bands, sketch = band_keys(values, offsets, p)
                fps = simhash.signed([simhash.fingerprint(x.as_py(), p.simhash) for x in batch.column(2).slice(lo, hi - lo)])
                own = [batch.column(k).slice(lo, hi - lo) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(set_keys(values, offsets).view(np.int64)), pa.array(np.diff(offsets)), _lists(bands.view(np.int64)), _lists(sketch.view(np.int64)), pa.array(fps)], ["uid", "id", "key", "n", "bands", "sketch", "fp"])

    return rows.mapInArrow(run, f"uid long, id {rows.schema['id'].dataType.simpleString()}, key long, n long, bands array<long>, sketch array<long>, fp long")


def sets_of(rows: DataFrame, wanted: DataFrame, p: NearDedupParams) -> DataFrame:
    """(key, shingles) of the documents named by `wanted` (uid, key); one scan of rows (uid, text)."""
    bits = min(max(int(64 * wanted.count() + 1).bit_length(), 6), p.bitmap_bits_log2)
    size = 1 << bits
    at = F.pmod(F.xxhash64("uid", F.lit(p.seed)), F.lit(size))
    words = wanted.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(uid, %d), 64) as int))" % p.seed)).alias("m")).toPandas()
    bitmap = np.zeros(size // 64, np.int64)  # 16 MB at most
    bitmap[words.w] = words.m
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            maybe = held.value.view(np.uint64)[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
            batch = batch.filter(pa.array(maybe.astype(bool)))
            for lo, hi, values, offsets in _sets(batch.column(1), p) if batch.num_rows else ():
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], ["uid", "shingles"])

    made = rows.select("uid", "text", at.alias("_at")).mapInArrow(run, "uid long, shingles array<long>")
    return checkpoint(made.join(wanted, "uid").select("key", "shingles"))


def similar(pairs: DataFrame, sets: DataFrame, p: NearDedupParams) -> DataFrame:
    """The pairs (a, b) whose sets have the least similarity, checked on the whole sets row by row."""
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    common = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("a_set") + F.size("b_set")).alias("sizes"))
    return joined.where(100 * F.col("common") >= p.percent * (F.col("sizes") - F.col("common"))).select("a", "b")


def _agreed(x, y):
    """In how many bytes two sketches of longs agree."""

    def unlike(d):
        for k in (4, 2, 1):  # a byte's lowest bit becomes the union of its bits
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    return 8 * F.size(x) - F.aggregate(F.zip_with(x, y, lambda a, b: unlike(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)


def _spanning(near: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
    """Keys joined to the first key of their component under `near` (a matrix, x by y): two rows, linear in the keys."""
    keys = x if same else np.concatenate((x, y))
    label = np.arange(len(keys))
    while True:
        lx, ly = (label, label) if same else (label[: len(x)], label[len(x) :])
        nx = np.minimum(lx, np.where(near, ly, len(keys)).min(axis=1, initial=len(keys)))
        ny = np.minimum(ly, np.where(near, nx[:, None], len(keys)).min(axis=0, initial=len(keys)))
        new = np.minimum(nx, ny) if same else np.concatenate((nx, ny))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return np.stack((keys[moved], keys[label[moved]]))


def _common(xv: np.ndarray, xo: np.ndarray, yv: np.ndarray, yo: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Sizes of the sets' intersections where `near`. Few pairs are merged one by one; many are products of indicator
    matrices over the values that both sides have, a slice of values at a time."""
    out = np.zeros(near.shape, np.int64)
    i, j = np.nonzero(near)
    if len(i) <= 64:
        for a, b in zip(i.tolist(), j.tolist()):
            out[a, b] = len(np.intersect1d(xv[xo[a] : xo[a + 1]], yv[yo[b] : yo[b + 1]], assume_unique=True))
        return out
    shared = np.intersect1d(xv, yv)
    sides = []
    for v, o in ((xv, xo), (yv, yo)):
        at = np.minimum(np.searchsorted(shared, v), max(len(shared) - 1, 0))
        known = shared[at] == v if len(shared) else np.zeros(len(v), bool)
        of = np.repeat(np.arange(len(o) - 1), np.diff(o))
        order = np.argsort(at[known], kind="stable")
        sides.append((at[known][order], of[known][order], len(o) - 1))
    for lo in range(0, len(shared), 4096):
        slices = []
        for at, of, n in sides:
            first, last = np.searchsorted(at, (lo, lo + 4096))
            m = np.zeros((n, 4096), np.float32)
            m[of[first:last], at[first:last] - lo] = 1
            slices.append(m)
        out += (slices[0] @ slices[1].T).astype(np.int64)
    return out


def _met_in_blocks(p: NearDedupParams, exact: bool):
    """Spanning links of the pairs of members of two blocks, of different roots, that pass by size and sketch, and with
    `exact` by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            same = batch.column(0).to_numpy(zero_copy_only=False)
            sides = []
            for side in (batch.column(1), batch.column(2)):
                flat = side.flatten()
                sets = flat.field(4) if exact else None
                whole = (sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()) if exact else (None, None)
                sides.append((side.offsets.to_numpy() - side.offsets[0].as_py(), *(flat.field(k).to_numpy() for k in range(3)), flat.field(3).flatten().to_numpy().view(np.uint8).reshape(len(flat), -1), *whole))
            out = []
            for row in range(batch.num_rows):
                (x0, x1), (y0, y1) = ((o[row], o[row + 1]) for o, *_ in sides)
                (_, xk, xn, xr, xsk, xv, xo), (_, yk, yn, yr, ysk, yv, yo) = sides
                xk, xn, xr, xsk, yk, yn, yr, ysk = xk[x0:x1], xn[x0:x1], xr[x0:x1], xsk[x0:x1], yk[y0:y1], yn[y0:y1], yr[y0:y1], ysk[y0:y1]
                near = (xr[:, None] != yr) & (100 * np.minimum(xn[:, None], yn) >= p.percent * np.maximum(xn[:, None], yn))
                step = max(1, (1 << 22) // max(ysk.size, 1))
                for lo in range(0, len(xk), step):
                    if near[lo : lo + step].any():
                        near[lo : lo + step] &= (xsk[lo : lo + step, None, :] == ysk).sum(axis=2) >= p.least_agreed
                if exact and near.any():
                    if same[row]:
                        near = np.triu(near)
                    common = _common(xv[xo[x0] : xo[x1]], xo[x0 : x1 + 1] - xo[x0], yv[yo[y0] : yo[y1]], yo[y0 : y1 + 1] - yo[y0], near)
                    near &= 100 * common >= p.percent * (xn[:, None] + yn - common)
                if near.any():
                    out.append(_spanning(near | near.T if same[row] else near, xk, yk, bool(same[row])))
            if out:
                pairs = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def block_links(rows: DataFrame, p: NearDedupParams, exact: bool = False) -> DataFrame:
    """Links (a, b) that span the passing pairs of each group with more than one root. rows: band (the group), key, n,
    root, sketch, and with `exact` shingles."""
    size = F.greatest(F.count("*"), F.ceil(F.sum("n") / _SET_SIZE)) if exact else F.count("*")
    by_root = rows.groupBy("band", "root").agg(size.alias("c"))
    mixed = by_root.groupBy("band").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("c") < p.block_members, F.col("c"))).alias("few")).where("roots > 1").select("band", "few")
    dealt = by_root.join(mixed, "band")
    own = F.col("c") >= p.block_members
    parts = F.ceil(F.when(own, F.col("c")).otherwise(F.col("few")) / p.block_members)
    dealt = checkpoint(dealt.select("band", "root", F.when(own, F.col("root")).alias("pure"), parts.alias("parts")))
    salt = F.when(F.col("pure").isNotNull(), F.xxhash64("key", F.lit(p.seed))).otherwise(F.xxhash64("root", "key", F.lit(p.seed)))
    member = F.struct("key", "n", "root", "sketch", *(["shingles"] if exact else []))
    blocks = rows.join(dealt, ["band", "root"]).groupBy("band", "pure", F.pmod(salt, "parts").alias("part")).agg(F.collect_list(member).alias("xs"))
    blocks = checkpoint(blocks.withColumn("block", F.xxhash64("band", "pure", F.col("pure").isNull(), "part")))
    x, y = (blocks.select("band", F.col("block").alias(k), F.col("pure").alias(f"{k}_pure")) for k in "xy")
    met = x.join(y, "band").where((F.col("x") < F.col("y")) & ~F.coalesce(F.col("x_pure") == F.col("y_pure"), F.lit(False)))
    left, right = (blocks.select("band", F.col("block").alias(k), F.col("xs").alias(f"{k}s")) for k in "xy")
    both = met.select("band", "x", "y").join(left, ["band", "x"]).join(right, ["band", "y"]).select(F.lit(False).alias("same"), "xs", "ys")
    alone = blocks.where("pure is null").select(F.lit(True).alias("same"), "xs", F.col("xs").alias("ys"))
    return alone.unionByName(both).mapInArrow(_met_in_blocks(p, exact), "a long, b long")


def fingerprint_links(groups: DataFrame, p: NearDedupParams) -> DataFrame:
    """Links (a, b) of keys that span the components of fingerprints within the radius, found by BK-trees. groups: key, fp."""
    by_fp = checkpoint(groups.groupBy("fp").agg(F.min("key").alias("low")))
    side = lambda e: by_fp.select(F.col("fp").alias(e), F.col("low").alias(f"{e}_key"))
    near = simhash.links(by_fp.select("fp"), p.simhash).join(side("a"), "a").join(side("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    same = groups.join(by_fp, "fp").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    return checkpoint(near.unionByName(same))


def links(groups: DataFrame, rows: DataFrame, p: NearDedupParams) -> DataFrame:
    """(node, root) of the nodes with a link. groups: key, uid, n, bands, sketch, fp, a row a key; rows: uid, text."""
    members = groups.where("n > 0").select("key", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    met = checkpoint(members.join(sizes, "band"))
    close = fingerprint_links(groups.where("n > 0").select("key", "fp"), p)
    linked = close.select(F.col("a").alias("key")).union(close.select("b"))
    kept = checkpoint(groups.join(met.select("key").union(linked).distinct(), "key", "left_semi").drop("fp"))
    n = kept.count()
    few = lambda df: few_tasks(df, n, p.members_a_task)
    kept = few(kept)
    sets = few(sets_of(rows, kept.select("uid", "key"), p))
    roots = None
    for k in range(p.rounds + 1):
        known = kept.withColumn("root", F.col("key")) if roots is None else kept.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
        if k < p.rounds:
            chosen = F.min(F.struct(F.xxhash64("key", F.lit(p.seed + k)).alias("h"), "key")).alias("c")
            centre = met.groupBy("band").agg(chosen).select("band", F.col("c.key").alias("c"))
            pairs = few(met.join(centre, "band").where("key <> c").select(F.least("key", "c").alias("a"), F.greatest("key", "c").alias("b")).union(close.select(F.least("a", "b"), F.greatest("a", "b"))).distinct())
            side = lambda e: known.select(F.col("key").alias(e), F.struct("n", "root", "sketch").alias(f"_{e}"))
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("_a.root <> _b.root")
            sized = 100 * F.least("_a.n", "_b.n") >= p.percent * F.greatest("_a.n", "_b.n")  # else no overlap reaches the least similarity
            pairs = pairs.where(sized & (_agreed(F.col("_a.sketch"), F.col("_b.sketch")) >= p.least_agreed)).select("a", "b")
            more = checkpoint(few(similar(checkpoint(few(pairs)), sets, p)))
        else:
            alike = checkpoint(block_links(met.join(known, "key").select("band", "key", "n", "root", "sketch"), p))
            groups_of = components(alike.unionByName(close)).select(F.col("node").alias("key"), F.col("root").alias("band"))
            groups_of = groups_of.unionByName(groups_of.select(F.col("band").alias("key"), "band")).distinct()
            more = checkpoint(block_links(few(known.select("key", "n", "root", "sketch").join(groups_of, "key").join(sets, "key")), p, exact=True))
        known_links = more if roots is None else more.unionByName(roots.toDF("a", "b"))
        roots = components(known_links)
    return roots


def near_duplicates(docs: DataFrame, p: NearDedupParams = NearDedupParams(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id_column and component_id, the smallest id of its class."""
    rows = replayable(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))).select(F.monotonically_increasing_id().alias("uid"), "id", "text")
    found = checkpoint(signatures(rows, p))
    first = F.first(F.struct("uid", "n", "bands", "sketch", "fp")).alias("one")
    groups = checkpoint(found.groupBy("key").agg(F.min("id").alias("low_id"), first).select("key", "low_id", "one.*"))
    roots = links(groups, rows.select("uid", "text"), p)
    classes = groups.select("key", "low_id").join(roots, F.col("key") == F.col("node"), "left").select("key", "low_id", F.coalesce("root", "key").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low_id").alias("component_id"))
    of_key = classes.join(lowest, "root").select("key", "component_id")
    return found.select(F.col("id").alias(id_column), "key").join(of_key, "key").select(id_column, "component_id")
