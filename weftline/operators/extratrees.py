"""Extremely randomised trees (Geurts, Ernst and Wehenkel, 2006), grown level by level from distributed counts.

At a node every feature gets one threshold, drawn evenly between the feature's smallest and largest value there; of these
splits the one with the largest Gini gain is taken. Draws are hashes of (seed, tree, node, feature), so a forest depends on neither
partitions nor order. There is no bootstrap: a tree sees all rows.

A level costs two narrow passes over the rows: one for the ranges of the features by open node and one for the counts of
both labels left of the thresholds. A task adds up its own rows in arrays and gives a row a (tree, node, feature); the sums
that reach the driver are `trees` x open nodes x features, as is the forest. A row finds its nodes by going down the trees again.

A node is a leaf if it is pure, has under two times `min_leaf` rows, is `max_depth` deep, or no feature varies or splits off
`min_leaf` rows. Defined cases: rows with a null label, a null or missing feature list or one of another length teach nothing
and score null; null and NaN features are 0; without a row every score is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import checkpoint


@dataclass(frozen=True)
class ForestParams:
    trees: int = 16
    max_depth: int = 8
    min_leaf: int = 1
    seed: int = 1


_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def draw(seed: int, tree: int, node: int, feature: int) -> float:
    """A number in [0, 1) that only these four decide."""
    h = seed & _MASK
    for part in (tree, node, feature):
        h = ((h ^ part) * _MIX + 0xD1B54A32D192ED03) & _MASK
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & _MASK
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & _MASK
        h ^= h >> 31
    return (h >> 11) / (1 << 53)


@dataclass
class Tree:
    """Nodes by number (children of n are 2n + 1 and 2n + 2): splits (feature, threshold; left if below) and leaves (the
    share of label 1)."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The node that each row has reached: a leaf, or one that is still open."""
        at = np.zeros(len(x), np.int64)
        moving = np.ones(len(x), bool)
        while moving.any():
            moved = np.zeros(len(x), bool)
            for node in np.unique(at[moving]).tolist():
                split = self.splits.get(node)
                if split is not None:
                    here = at == node
                    at[here] = 2 * node + 2 - (x[here, split[0]] < split[1])
                    moved |= here
            moving = moved
        return at


def _matrix(column: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the rows that have n of them, and which rows those are."""
    size = column.value_lengths().fill_null(-1).to_numpy()
    ok = np.flatnonzero(size == n)
    flat = column.take(pa.array(ok)).flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return np.nan_to_num(flat.reshape(len(ok), n), nan=0.0), ok


def gini_gain(left: tuple[int, int], whole: tuple[int, int]) -> float:
    """Gain of a split; counts are (rows, rows of label 1)."""

    def impurity(n: int, ones: int) -> float:
        return 2 * (ones / n) * (1 - ones / n) if n else 0.0

    (n, ones), (m, more) = left, whole
    return impurity(m, more) - n / m * impurity(n, ones) - (m - n) / m * impurity(m - n, more - ones)


def _ranges(forest: list[Tree], open_: list[dict[int, int]], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = [np.full((len(o), n), np.inf) for o in open_]
        hi = [np.full((len(o), n), -np.inf) for o in open_]
        count = [np.zeros((len(o), 2), np.int64) for o in open_]
        for batch in batches:
            x, rows = _matrix(batch.column(0), n)
            y = batch.column(1).to_numpy()[rows]
            for t, tree in enumerate(forest):
                for node, ones, part in _by_node(tree.nodes_of(x), y, open_[t], x):
                    lo[t][node], hi[t][node] = np.minimum(lo[t][node], part.min(axis=0)), np.maximum(hi[t][node], part.max(axis=0))
                    count[t][node] += (len(part), ones)
        for t, o in enumerate(open_):
            for node, k in o.items():
                if count[t][k, 0]:
                    yield pa.RecordBatch.from_arrays([pa.array([t] * n), pa.array([node] * n), pa.array(range(n)), pa.array(lo[t][k]), pa.array(hi[t][k]), pa.array([int(count[t][k, 0])] * n), pa.array([int(count[t][k, 1])] * n)], ["tree", "node", "feature", "lo", "hi", "n", "ones"])

    return run


def _by_node(at: np.ndarray, y: np.ndarray, open_: dict[int, int], x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for node in np.unique(at).tolist():
        if node in open_:
            here = at == node
            yield open_[node], int(y[here].sum()), x[here]


def _below(forest: list[Tree], open_: list[dict[int, int]], limits: list[np.ndarray], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros((len(o), n, 2), np.int64) for o in open_]
        for batch in batches:
            x, rows = _matrix(batch.column(0), n)
            y = batch.column(1).to_numpy()[rows]
            for t, tree in enumerate(forest):
                at = tree.nodes_of(x)
                for node in np.unique(at).tolist():
                    if node in open_[t]:
                        k, here = open_[t][node], at == node
                        left = x[here] < limits[t][k]
                        count[t][k, :, 0] += left.sum(axis=0)
                        count[t][k, :, 1] += left[y[here] == 1].sum(axis=0)
        for t, o in enumerate(open_):
            for node, k in o.items():
                yield pa.RecordBatch.from_arrays([pa.array([t] * n), pa.array([node] * n), pa.array(range(n)), pa.array(count[t][k, :, 0]), pa.array(count[t][k, :, 1])], ["tree", "node", "feature", "n", "ones"])

    return run


def fit(rows: DataFrame, p: ForestParams = ForestParams(), features: str = "features", label: str = "label") -> list[Tree]:
    """A forest for rows (features array<double>, label 0 or 1)."""
    clean = checkpoint(rows.select(features, F.col(label).cast("long").alias("_y")).where(F.col("_y").isin(0, 1) & F.col(features).isNotNull()))
    width = clean.groupBy(F.size(features).alias("n")).count().orderBy(F.desc("count"), "n").first()
    forest = [Tree() for _ in range(p.trees)]
    if width is None:
        return forest
    n = width["n"]
    open_ = [{0: 0} for _ in forest]
    depth = 0
    while any(open_):
        ranges = clean.mapInArrow(_ranges(forest, open_, n), "tree long, node long, feature long, lo double, hi double, n long, ones long")
        table = ranges.groupBy("tree", "node", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
        limits = [np.zeros((len(o), n)) for o in open_]
        sizes: dict[tuple[int, int], tuple[int, int]] = {}
        varies: set[tuple[int, int, int]] = set()
        for r in table:
            sizes[r["tree"], r["node"]] = (r["n"], r["ones"])
            if r["hi"] > r["lo"]:
                varies.add((r["tree"], r["node"], r["feature"]))
            limits[r["tree"]][open_[r["tree"]][r["node"]], r["feature"]] = r["lo"] + draw(p.seed, r["tree"], r["node"], r["feature"]) * (r["hi"] - r["lo"])
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        growing = [{node: k for node, k in o.items() if depth < p.max_depth and (s := sizes.get((t, node))) and 0 < s[1] < s[0] and s[0] >= 2 * p.min_leaf} for t, o in enumerate(open_)]
        if any(growing):
            asked = [{node: k for k, node in enumerate(o)} for o in growing]
            held = [limits[t][[open_[t][node] for node in o]] for t, o in enumerate(asked)]
            below = clean.mapInArrow(_below(forest, asked, held, n), "tree long, node long, feature long, n long, ones long")
            for r in below.groupBy("tree", "node", "feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():
                counts.setdefault((r["tree"], r["node"]), [(0, 0)] * n)[r["feature"]] = (r["n"], r["ones"])
        following: list[dict[int, int]] = [{} for _ in forest]
        for t, o in enumerate(open_):
            for node in o:
                whole = sizes[t, node]
                fits = [(gini_gain(left, whole), -f) for f, left in enumerate(counts.get((t, node), ())) if (t, node, f) in varies and min(left[0], whole[0] - left[0]) >= p.min_leaf]
                if fits:
                    feature = -max(fits)[1]
                    forest[t].splits[node] = (feature, float(limits[t][open_[t][node], feature]))
                    for child in (2 * node + 1, 2 * node + 2):
                        following[t][child] = len(following[t])
                else:
                    forest[t].leaves[node] = whole[1] / whole[0]
        open_, depth = following, depth + 1
    return forest


def score(rows: DataFrame, forest: list[Tree], width: int, features: str = "features", name: str = "score") -> DataFrame:
    """rows with the mean share of label 1 over the trees' leaves; a narrow pass."""
    held = rows.sparkSession.sparkContext.broadcast(forest)
    at = rows.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _matrix(batch.column(at), width)
            out = np.full(batch.num_rows, np.nan)
            if held.value and held.value[0].leaves and len(ok):
                out[ok] = np.mean([[tree.leaves[k] for k in tree.nodes_of(x).tolist()] for tree in held.value], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=np.isnan(out))], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")
