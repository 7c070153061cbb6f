import numpy as np
import pytest

from weftline.operators import extratrees as et
from weftline.plans import queries_more


def plain(x, y, p):
    """The same forest, grown a node at a time in memory, with the same draws."""
    forest = []
    for t in range(p.trees):
        tree = et.Tree()
        stack = [(0, np.arange(len(x)), 0)]
        while stack:
            node, rows, depth = stack.pop()
            n, ones = len(rows), int(y[rows].sum())
            best = None
            if depth < p.max_depth and 0 < ones < n and n >= 2 * p.min_leaf:
                for f in range(x.shape[1]):
                    lo, hi = x[rows, f].min(), x[rows, f].max()
                    limit = lo + et.draw(p.seed, t, node, f) * (hi - lo)
                    left = rows[x[rows, f] < limit]
                    if hi > lo and min(len(left), n - len(left)) >= p.min_leaf:
                        a, b = y[left].mean(), y[np.setdiff1d(rows, left)].mean()
                        whole = ones / n
                        gain = 2 * whole * (1 - whole) - len(left) / n * 2 * a * (1 - a) - (n - len(left)) / n * 2 * b * (1 - b)
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, f, limit, left)
            if best is None:
                tree.leaves[node] = ones / n
            else:
                tree.splits[node] = (best[1], float(best[2]))
                stack += [(2 * node + 1, best[3], depth + 1), (2 * node + 2, np.setdiff1d(rows, best[3]), depth + 1)]
        forest.append(tree)
    return forest


@pytest.mark.parametrize("p", [et.ForestParams(trees=3, max_depth=4), et.ForestParams(trees=2, max_depth=3, min_leaf=20, seed=9)])
def test_same_splits_as_plain(spark, p):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 5)), 2)
    x[:, 4] = 1.0  # never varies
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=300) / 3) > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)] + [(None, 1), ([1.0], 0), (x[0].tolist(), None)], "features array<double>, label int").repartition(4)
    got, want = et.fit(df, p), plain(x, y, p)
    for a, b in zip(got, want, strict=True):
        assert a.splits == b.splits and a.leaves == b.leaves
    scored = et.score(df, got, 5).collect()
    mean = {tuple(f): np.mean([t.leaves[int(t.nodes_of(np.array([f]))[0])] for t in want]) for f in x.tolist()}
    for row in scored:
        assert row.score is None if row.features is None or len(row.features) != 5 else abs(row.score - mean[tuple(row.features)]) < 1e-12


def test_learns_and_empty(spark):
    r = np.random.default_rng(3)
    x = r.uniform(size=(600, 3))
    y = (x[:, 1] > 0.5).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "features array<double>, label int")
    forest = et.fit(df, et.ForestParams(trees=8, max_depth=6))
    right = sum((row.score > 0.5) == row.label for row in et.score(df, forest, 3).collect())
    assert right > 570
    none = et.fit(df.limit(0), et.ForestParams(trees=2))
    assert all(row.score is None for row in et.score(df.limit(3), none, 3).collect())


def test_query(spark):
    row = queries_more.block_forest(spark, "/root/testdata/sf0.01").collect()
    assert len(row) == 3 and all(0 <= r.f1 <= 1 for r in row) and max(r.f1 for r in row) > 0.6


def test_ratios_and_clusters_equal_plain(spark):
    from weftline.operators import blocks

    rows = [(1, j, "x" * n, [0, *range(10, 10 + d)]) for j, (n, d) in enumerate([(5, 1), (50, 2), (500, 2), (400, 1), (3, 4), (2, 4), (300, 1)])] + [(2, 0, "abc", [0])]
    found = spark.createDataFrame(rows, "page_id long, j int, text string, path array<int>")
    got = {(r.page_id, r.j): (r.ratio, r.smooth, r.slope) for r in blocks.smoothed_ratios(found).collect()}
    for page in (1, 2):
        mine = [r for r in rows if r[0] == page]

        def far(a, b):
            k = sum(x == y for x, y in zip(a, b))
            return len(a) + len(b) - 2 * k

        ratio = [np.log(1 + len(r[2]) / max(far(r[3], mine[k - 1][3]) if k else len(r[3]), 1)) for k, r in enumerate(mine)]
        smooth = []
        for k in range(len(ratio)):
            near = [(ratio[k + i], np.exp(-i * i / 2)) for i in range(-2, 3) if 0 <= k + i < len(ratio)]
            smooth.append(sum(a * w for a, w in near) / sum(w for _, w in near))
        for k in range(len(ratio)):
            ahead = smooth[k + 1 : k + 4]
            want = (ratio[k], smooth[k], abs(np.mean(ahead) - smooth[k]) if ahead else 0.0)
            assert np.allclose(got[page, k], want)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in [(0, 0), (0.1, 0), (5, 1), (5.2, 1.1), (9, 9), (9.5, 9)]], "a double, b double")
    centres = blocks.kmeans(points, ["a", "b"], [[0.0, 0.0], [4.0, 0.0], [8.0, 8.0]])
    assert np.allclose(centres, [[0, 0], [5.1, 1.05], [9.25, 9]])
