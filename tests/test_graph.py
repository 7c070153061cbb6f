import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, markup, nn, sampling

STAR = "<div>" + "<p>x</p>" * 50 + "</div>"
CHAIN = "<div>" * 30 + "x"


def test_star_is_capped():
    links = graph.adjacency(markup.parse(STAR))
    p = graph.GraphParams(max_neighbours=5)
    order, edges = graph.expand(links, 0, p, np.random.default_rng(1))
    assert len(order) == 6 and order[0] == 0 and len(edges) == 10
    order, edges = graph.expand(links, 1, p, np.random.default_rng(1))
    assert order[:2] == [1, 0] and len(order) == 6 and all((b, a) in {(x, y) for x, y, _ in edges} for a, b, _ in edges)


def test_depth_and_nodes_are_capped():
    links = graph.adjacency(markup.parse(CHAIN))
    assert len(graph.expand(links, 0, graph.GraphParams(max_depth=4), np.random.default_rng(0))[0]) == 5
    links = graph.adjacency(markup.parse(STAR))
    assert len(graph.expand(links, 0, graph.GraphParams(max_nodes=7), np.random.default_rng(0))[0]) == 7


def test_every_start_is_covered():
    root = markup.parse(STAR)
    found = list(graph.page_subgraphs(root, 1, graph.GraphParams(max_neighbours=5, max_subgraphs=100)))
    assert {x for _, listed, _, _ in found for x in listed} == set(range(1, 51))
    assert found == list(graph.page_subgraphs(markup.parse(STAR), 1, graph.GraphParams(max_neighbours=5, max_subgraphs=100)))
    assert len(list(graph.page_subgraphs(root, 1, graph.GraphParams(max_neighbours=5)))) == 11


def test_tensor():
    links = graph.adjacency(markup.parse("<div><p></p><b></b></div>"))
    p = graph.GraphParams(max_nodes=4, max_neighbours=2)
    t = graph.tensor(*graph.expand(links, 0, p, np.random.default_rng(0)), p)
    assert t.shape == (4, 3, 2) and t[0, 1].tolist() == [1, 2] and t[1, 0].tolist() == [0, -1] and t[3].max() == -1 and t[2, 2, 0] == 2


def test_spectral_positions():
    pairs = [(0, 1), (1, 2), (1, 3)]
    x = graph.spectral_positions(4, pairs, 2)
    lap = graph.normalised_laplacian(4, pairs)
    for v in x.T:
        value = v @ lap @ v
        assert np.abs(lap @ v - value * v).max() < 1e-9
    assert graph.spectral_positions(1, [], 3).tolist() == [[0, 0, 0]]
    assert graph.spectral_positions(3, [(0, 1), (1, 2)], 5)[:, 2:].max() == 0


def test_spectral_positions_of_large_pages():
    r = np.random.default_rng(1)
    pairs = [(i, int(r.integers(max(0, i - 40), i))) for i in range(1, 1700)]
    x = graph.spectral_positions(1700, pairs, 8)
    lap = graph.normalised_laplacian(1700, pairs)
    values = np.linalg.eigvalsh(lap)[1:9]
    assert np.abs(x.T @ lap @ x - np.diag(values)).max() < 1e-8 and np.abs(x.T @ x - np.eye(8)).max() < 1e-8
    assert np.abs(x - graph.spectral_positions(1700, pairs, 8, most=1700)).max() < 1e-5


def test_lexrank():
    s = [["a", "p"], ["a", "b", "c"], ["x"], ["b", "q"], ["c", "r"]]
    score = graph.lexrank(s, 0.05)
    assert score.argmax() == 1 and score.sum() == pytest.approx(5) and graph.lexrank([]).size == 0


def test_summary_ranks_a_long_text_whole(spark):
    r = np.random.default_rng(2)
    some = [" ".join(r.choice([f"w{i}" for i in range(60)], 8)) + "." for _ in range(900)]
    text = " ".join(x.capitalize() for x in some)
    from weftline.functions.text import sentences
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut = df.select(sentences(F.col("text")).alias("s")).first().s
    words = [s.lower().split() for s in cut]
    number = {w: i for i, w in enumerate(sorted({w for s in words for w in s}))}
    tf = np.zeros((len(words), len(number)))
    for i, s in enumerate(words):
        for w in s:
            tf[i, number[w]] += 1
    v = tf * (np.log((1 + len(words)) / (1 + (tf > 0).sum(axis=0))) + 1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    walk = ((v @ v.T > 0.1) | np.eye(len(v), dtype=bool)).astype(float)
    walk /= walk.sum(axis=1, keepdims=True)
    share = np.full(len(v), 1 / len(v))
    for _ in range(60):
        share = share @ walk
    assert len(cut) > 800
    assert np.allclose(graph.lexrank(words), share * len(v))
    assert graph.summarise(df).first().summary == " ".join(cut[i] for i in sorted(np.argsort(-share, kind="stable")[:3]))


def test_layers():
    r = np.random.default_rng(0)
    x, w = r.normal(size=(3, 2)), [r.normal(size=(2, 2)), r.normal(size=(2, 2))]
    edges = [np.array([[1, 0], [2, 0]]), np.array([[0, 1], [0, 2]])]
    mean = nn.gcn(x, edges, w)
    assert np.allclose(mean[0], np.maximum((x[1] + x[2]) @ w[1] / 2, 0)) and np.allclose(mean[1], np.maximum(x[0] @ w[0], 0))
    assert np.allclose(nn.gcn(x, edges, w, "sum")[0], np.maximum((x[1] + x[2]) @ w[1], 0))
    assert np.allclose(nn.gcn(x, edges, w, "max", act=lambda v: v)[0], np.maximum(x[1] @ w[1], x[2] @ w[1]))
    same = nn.gat(x, edges, w, [np.zeros(4)] * 2, act=lambda v: v)
    assert np.allclose(same[0], (x[1] + x[2]) @ w[1] / 2)
    assert np.allclose(nn.gat(x, edges, w, [np.zeros(4)] * 2, how="sum", act=lambda v: v)[0], (x[1] + x[2]) @ w[1])
    assert nn.sage(x, edges, r.normal(size=(4, 5))).shape == (3, 5)
    assert nn.gated(x, edges, w, w, w[0]).shape == (3, 2)
    alone = nn.gcn(np.ones((2, 2)), [np.zeros((0, 2), int)] * 2, w)
    assert np.allclose(alone, 1)
    block = nn.residual_block(x, lambda v: nn.gcn(v, edges, w), w[0])
    assert block.shape == (3, 2) and (block >= 0).all()
    h, c = nn.lstm(x, np.zeros((3, 2)), np.zeros((3, 2)), r.normal(size=(2, 8)), r.normal(size=(2, 8)), np.zeros(8))
    assert h.shape == c.shape == (3, 2)
    cell = lambda a, s: nn.gru(a, s, np.ones((2, 6)), np.ones((2, 6)), np.zeros(6))
    assert nn.recurrent(x, [lambda v: v, lambda v: v * 2], cell).shape == (3, 2)
    nodes, top = nn.transformer(x, np.ones((2, 4)), np.zeros(4), [{"qkv": r.normal(size=(4, 12)), "out": np.eye(4), "up": np.ones((4, 8)), "down": np.ones((8, 4))}], 2)
    assert nodes.shape == (3, 4) and top.shape == (4,)
    assert nn.readout(-np.ones((3, 2)), np.array([True, False, True]), "max").tolist() == [0, 0]
    assert nn.readout(-np.ones((3, 2)), np.array([True, False, True]), "mean").tolist() == [-1, -1]
    assert nn.link_score(np.array([[1.0, 0], [0, 0]]), np.array([0, 0]), np.array([0, 1])).tolist() == [1, 0]
    assert np.allclose(nn.node_classes(x, np.array([0]), np.zeros((2, 3)), np.zeros(3)), 1 / 3)
    assert nn.node_binary(x, np.array([0, 1]), np.zeros(2), 0.0, both=True).tolist() == [[0.5, 0.5]] * 2


def test_layer_in_spark_equals_sql(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [0.5, -1.0]), (1, 2, [3.0, 0.0]), (2, 0, [1.0, 1.0])], "page_id long, node_id int, x array<double>")
    edges = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 0, 1, 1), (1, 0, 2, 1)], "page_id long, src int, dst int, type_id int")
    weights = [[[1.0, 0.5], [-1.0, 2.0]], [[0.5, 0.0], [0.25, 1.0]]]
    a = nn.run_per_page(nodes, edges, lambda x, e: nn.gcn(x, e, [np.array(w) for w in weights])).collect()
    b = nn.gcn_mean_sql(nodes, edges, weights).collect()
    get = lambda rows: {(r.page_id, r.node_id): [round(v, 9) for v in r.y] for r in rows}
    assert get(a) == get(b) and get(a)[2, 0] == [1.0, 1.0]


def test_augmentation(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(200)], "k long, x array<double>")
    flipped = df.select(graph.flip_signs(F.col("x"), F.col("k")).alias("y")).collect()
    assert {abs(r.y[1]) for r in flipped} == {2.0} and 60 < sum(r.y[1] < 0 for r in flipped) < 140
    zero = df.select(graph.mask_features(F.col("x"), F.col("k"), 0.85).alias("y")).collect()
    assert 150 < sum(sum(r.y) == 0 for r in zero) < 190
    drawn = df.select(graph.pick_nodes(F.col("x"), F.col("k"), 5).alias("y")).collect()
    assert all(len(r.y) == 5 and set(r.y) <= {1.0, 2.0, 3.0} for r in drawn)
    assert df.select(graph.slice_features(F.col("x"), 1, 2).alias("y")).first().y == [2.0, 3.0]


def test_results_do_not_depend_on_partitions(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    p = graph.GraphParams(max_nodes=20, max_neighbours=4)
    one, many = ({tuple(map(str, r)) for r in graph.subgraphs(pages.repartition(n), p).collect()} for n in (1, 7))
    assert one == many


def test_rank_and_splits(spark):
    df = spark.range(1000).withColumn("label", F.col("id") % 3)
    folds = sampling.kfold(df, "id", "label", 7).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {142, 143}
    split = sampling.stratified_split(df, "id", "label", 0.1, 3).groupBy("label", "split").count().collect()
    assert {r["count"] for r in split if r.split == "valid"} == {33}
    assert sampling.concatenate([None, None]) is None


def test_group_hash_and_visual(spark):
    import hashlib

    got = graph.group_hash(spark.createDataFrame([("a",), (None,)], "grp string")).collect()
    assert got[0].group_hash == int.from_bytes(hashlib.shake_256(b"a").digest(8), "little", signed=True) and got[1].group_hash is None
    row = spark.createDataFrame([({"class": " x  y ", "id": "ab"},)], "attrs map<string,string>")
    words, own = graph.visual_words(F.col("attrs"))
    _, strict = graph.visual_words(F.col("attrs"), True)
    assert tuple(row.select(words, own, strict).first()) == ("x y", "ab", "a b")


def test_layers_hold_few_pages_at_once(spark):
    import pyarrow as pa

    from weftline.operators import nn
    from weftline.plans.lineage import few_rows

    batch = pa.RecordBatch.from_arrays([pa.array(range(150))], ["x"])
    assert [b.num_rows for b in few_rows(iter([batch, batch.slice(0, 0)]))] == [64, 64, 22]
    n_pages = 200
    nodes = spark.createDataFrame([(p, i, [float(p), float(i)]) for p in range(n_pages) for i in range(p % 3 + 1)], "page_id long, node_id int, x array<double>")
    links = [(p, a, b, k) for p in range(n_pages) for a, b, k in ((0, 1, 0), (1, 0, 1), (2, 0, 0), (0, 9, 1))]
    edges = spark.createDataFrame(links, "page_id long, src int, dst int, type_id int")
    got = {(r.page_id, r.node_id): r.y for r in nn.run_per_page(nodes.coalesce(1), edges, lambda x, e: np.array([[len(x), *(len(q) for q in e)]] * len(x), float)).collect()}
    n_edges = {1: [0, 0], 2: [1, 1], 3: [2, 1]}
    assert got == {(p, i): [n, *n_edges[n]] for p in range(n_pages) for n in [p % 3 + 1] for i in range(n)}


def test_summaries_keep_the_digits_of_their_sentences(spark):
    docs = spark.createDataFrame([(1, "0 zero one. 1 one two. 2 two"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.summary for r in graph.summarise(docs).collect()} == {1: "0 zero one. 1 one two. 2 two", 2: ""}
