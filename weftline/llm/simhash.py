"""SimHash near-duplicate classes through BK-trees over shards of fingerprints.

Fingerprint: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the document's word
shingles. Two fingerprints link if they differ in at most `radius` bits.

Shards: by the pigeonhole principle two fingerprints within radius 3 agree in one of four 16-bit blocks, so each
distinct fingerprint goes to 4 shards, and every link lies in at least one. A shard of over `tree_size` fingerprints
is split: since the other 48 bits again hold at most three differences, its members go on to 4 shards each, by the
four 12-bit blocks of those. Which shards are so large is a table of 4 * 65,536 rows at most, which is broadcast. A
shard's fingerprints form BK-trees (children keyed by their distance to the parent); every fingerprint of the shard
is searched in them, following only edges within the radius. A tree is shipped to the one task that holds the
fingerprints routed to it, since a tree of all fingerprints, or a copy of every tree on every executor, would grow
with the corpus. A split shard that is still over `tree_size` becomes a forest.

A task emits a spanning forest of a shard's links, so a group of n copies gives at most n - 1 rows a
shard. Components come from alternating large-star and small-star steps; nothing but one count a round
reaches the driver.

Defined cases: a null text is the empty text; a text without a word has fingerprint zero and links like
any other; a text with fewer words than a shingle has one shingle, its whole word sequence; repeated rows
keep one result each; a null id never becomes a component's id unless the component has no other; an
empty table gives an empty result; a very long text is hashed whole, a slice of shingles at a time. Only the id and
text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, checkpoint, few_tasks, read


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 3
    seed: int = 42
    radius: int = 3
    tree_size: int = 1 << 15


_HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, p: SimHashParams = SimHashParams()) -> int:
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() maps A-Z alone
    words = WORD_BYTES.findall(data)
    if not words:
        return 0
    joined, k, seed, digest = b" ".join(words), p.shingle, p.seed, xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _HASHES_AT_ONCE):
        hi = min(n, lo + _HASHES_AT_ONCE)
        found = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist())), ">u8", hi - lo)
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, p: SimHashParams = SimHashParams(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column and `fp`, the 64 bits as a signed long; a narrow pass."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = signed([fingerprint(x.as_py(), p) for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(hash_texts, f"`{id_column}` {kind}, fp long")


class BKTree:
    """A BK-tree over distinct fingerprints, searched for many queries at a time."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.first = np.full(n, -1, np.int64)  # first child
        self.next = np.full(n, -1, np.int64)  # next sibling
        self.edge = np.zeros(n, np.int64)  # distance to the parent
        pending = [(0, np.arange(1, n))] if n else []
        while pending:  # all of a node's descendants are dealt to its children by their distance to it
            node, rest = pending.pop()
            if not len(rest):
                continue
            distance = np.bitwise_count(values[rest] ^ values[node]).astype(np.int64)
            order = np.argsort(distance, kind="stable")
            rest, distance = rest[order], distance[order]
            cuts = np.flatnonzero(np.diff(distance)) + 1
            for group, at in zip(np.split(rest, cuts), np.concatenate(([0], cuts))):
                child = group[0]
                self.edge[child], self.next[child] = distance[at], self.first[node]
                self.first[node] = child
                pending.append((child, group[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of positions within the radius, step by step down the tree."""
        if not len(self.values):
            return
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            child, of, at = self.first[node], query, distance
            following = []
            while (some := child >= 0).any():
                child, of, at = child[some], of[some], at[some]
                ok = np.abs(self.edge[child] - at) <= radius
                following.append((of[ok], child[ok]))
                child = self.next[child]
            query, node = (np.concatenate(x) for x in zip(*following)) if following else (np.zeros(0, np.int64),) * 2


class Forest:
    """The BK-trees of one shard, fed block by block; union-find over the links seen."""

    def __init__(self, radius: int, tree_size: int):
        self.radius, self.tree_size = radius, tree_size
        self.trees: list[BKTree] = []
        self.offsets: list[int] = []
        self.parent = np.zeros(0, np.int64)

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return int(x)

    def add(self, values: np.ndarray) -> None:
        base = len(self.parent)
        self.parent = np.concatenate((self.parent, np.arange(base, base + len(values))))
        self.trees.append(BKTree(values))
        self.offsets.append(base)
        for lo in range(0, len(values), 1024):
            for tree, offset in zip(self.trees, self.offsets):
                for query, node in tree.search(values[lo : lo + 1024], self.radius):
                    a, b = query + lo + base, node + offset
                    some = self.parent[a] != self.parent[b]
                    for x, y in zip(a[some].tolist(), b[some].tolist()):
                        x, y = self._root(x), self._root(y)
                        if x != y:
                            self.parent[max(x, y)] = min(x, y)

    def links(self) -> Iterator[np.ndarray]:
        """Two columns: a fingerprint's value and that of its root, where they differ."""
        values = np.concatenate([t.values for t in self.trees]) if self.trees else np.zeros(0, np.uint64)
        roots = np.fromiter((self._root(x) for x in range(len(values))), np.int64, len(values))
        at = np.flatnonzero(roots != np.arange(len(values)))
        yield np.stack((values[at], values[roots[at]]))


def shard_rows(distinct: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """Each fingerprint once for each of its 4 shards, or of the 4 parts of a shard that is too large."""
    fp = F.col("fp")
    first, parts = [], []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << 16 * i) - 1))
        rest = F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i).bitwiseOR(low) if i < 3 else low
        first.append(-1 - F.shiftleft(block, 2) - i)
        inner = [F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF)) for j in range(4)]
        parts.append(F.array(*[F.shiftleft(block, 16).bitwiseOR(F.shiftleft(x, 4)).bitwiseOR(F.lit(4 * i + j)) for j, x in enumerate(inner)]))
    dealt = distinct.select("fp", F.posexplode(F.array(*first)).alias("i", "shard"))
    large = dealt.groupBy("shard").agg(F.count("*").alias("c")).where(F.col("c") > p.tree_size).select(F.col("shard").alias("_large"))
    marked = dealt.join(F.broadcast(large), F.col("shard") == F.col("_large"), "left")  # 4 * 65,536 rows at most
    keys = F.when(F.col("_large").isNull(), F.array("shard")).otherwise(F.element_at(F.array(*parts), F.col("i") + 1))
    return marked.select("fp", F.explode(keys).alias("shard"))


def _spanning(p: SimHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"]
        shard, held, forest, out, n_out = None, [], None, [], 0

        def close():
            nonlocal held, forest
            count = sum(map(len, held))
            if forest is None and count > 1:
                forest = Forest(p.radius, p.tree_size)
            if forest is not None:
                if count:
                    forest.add(np.concatenate(held))
                out.extend(x for x in forest.links() if x.shape[1])
            held, forest = [], None

        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if shard is not None and keys[lo] != shard:
                    close()
                shard = keys[lo]
                held.append(values[lo:hi])
                while sum(map(len, held)) > p.tree_size:
                    rest = np.concatenate(held)
                    forest = forest or Forest(p.radius, p.tree_size)
                    forest.add(rest[: p.tree_size])
                    held = [rest[p.tree_size :]]
            if sum(x.shape[1] for x in out) > 10_000:
                both = np.concatenate(out, axis=1).view(np.int64)
                out = []
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names)
        close()
        if out:
            both = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names)

    return run


def links(distinct: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """Spanning links (a, b) over distinct fingerprints `fp`."""
    if p.radius > 3:
        raise ValueError("four blocks find every link up to radius 3")
    dealt = shard_rows(distinct, p).repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp")
    return dealt.mapInArrow(_spanning(p), "a long, b long").distinct()


def components(edges: DataFrame, rows_a_task: int = 1 << 17) -> DataFrame:
    """(node, root) of every node with an edge; root is the component's smallest node.

    Alternating large-star and small-star steps, checkpointed; they end when every node with a smaller neighbour has
    no other neighbour, for then each component is a star around its smallest node. Edges that are stars already need
    no step; rounds grow with the logarithm of the longest chain, and no step has more rows than twice the edges.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    stars = checkpoint(edges.where("a <> b").select(big.alias("a"), small.alias("b")).distinct())
    n = 2 * stars.count()
    few = lambda df: few_tasks(df, n, rows_a_task)
    while True:
        stars = few(stars)
        both = stars.union(stars.select("b", "a")).toDF("n", "m")
        least = checkpoint(few(both.groupBy("n").agg(F.min("m").alias("low"), F.count("*").alias("c"))))
        if not least.where("low < n and c > 1").limit(1).count():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        low = least.select("n", F.least("n", "low").alias("low"))
        large = few(both.where("m > n").join(low, "n")).select(F.col("m").alias("a"), F.col("low").alias("b"))
        down = few(large.groupBy("a").agg(F.min("b").alias("low")))
        small_star = few(large.join(down, "a")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(down.select("a", F.col("low").alias("b")))
        stars = checkpoint(few(small_star.distinct()))


def near_duplicates(docs: DataFrame, p: SimHashParams = SimHashParams(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id_column, fingerprint (16 hex digits), component_id, the smallest id reachable."""
    found = checkpoint(fingerprints(docs, p, id_column, text_column))
    groups = found.groupBy("fp").agg(F.min(id_column).alias("low_id"))
    roots = components(links(groups.select("fp"), p))
    classes = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low_id").alias("component_id"))
    of_fp = checkpoint(classes.join(lowest, "root").select("fp", "component_id"))
    return found.join(of_fp, "fp").select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
