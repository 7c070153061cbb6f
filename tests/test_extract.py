import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import blocks, dom, extract, scoring

ARTICLE = " ".join(f"Sentence number {i} of the main text has several plain words, and a comma." for i in range(12))
PAGE = f"<html><body><ul><li><a href=/a>Home page link</a></li><li><a href=/b>Other link</a></li></ul><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><p><a href=/c>foot link</a></p></body></html>"


def test_cetd_keeps_the_dense_block():
    got = extract.cetd(PAGE)
    assert ARTICLE in got and "Home" not in got and "foot" not in got


def test_counts_of_density():
    d = extract.Density(extract.body_of("<body><p>abc <a>de<b>f</b></a></p><i></i></body>"))
    tags = [e.tag for e in d.elements]
    assert tags == ["body", "p", "a", "b", "i"]
    assert d.chars == [len("abc de f")] * 2 + [4, 1, 0]
    assert d.tags == [4, 2, 1, 0, 0]
    assert d.link_chars == [4, 4, 4, 1, 0]
    assert d.link_tags == [2, 2, 1, 0, 0]


@pytest.mark.parametrize("name", sorted(extract.EXTRACTORS))
@pytest.mark.parametrize("html", [None, "", "<html></html>", "<body><a>x</a></body>", "plain", "<body><div display=none>x</div></body>"])
def test_odd_pages(name, html):
    assert extract.EXTRACTORS[name](html) is None or isinstance(extract.EXTRACTORS[name](html), str)


def test_other_extractors():
    assert ARTICLE in extract.readability(PAGE) and "Home" not in extract.readability(PAGE)
    assert extract.readability("<body><p>short</p></body>") is None
    assert ARTICLE in extract.cetd_variant(PAGE)
    assert ARTICLE in extract.filing("junk " + PAGE + " tail") and "tail" not in extract.filing(PAGE + " tail")
    assert extract.tidy("a  b\t c\n\n \nd") == "a b  c\nd" or extract.tidy("a  b\t c\n\n \nd").startswith("a b")


def test_extract_table(spark):
    rows = extract.extract(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"), "cetd").collect()
    assert ARTICLE in rows[0].text and rows[1].text == "" and rows[0].error is None


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    for n in (1, 2, 5):
        u, e = r.normal(size=(n, 2)), r.normal(size=(n - 1, 4))
        best = max((sum(u[i, (k >> i) & 1] for i in range(n)) + sum(e[i, 2 * ((k >> i) & 1) + ((k >> i + 1) & 1)] for i in range(n - 1)), k) for k in range(2**n))[1]
        assert blocks.viterbi(u, e) == [(best >> i) & 1 for i in range(n)]


def test_labelled_blocks(spark):
    from weftline.operators import dom

    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    found = blocks.blocks(dom.dom_table(pages, "nodes"), dom.dom_table(pages, "texts")).cache()
    assert found.count() == 5
    assert blocks.edge_features(found).count() == 4
    labels = found.selectExpr("page_id", "j", "case when size(words) > 20 then 1 else 0 end as label")
    assert blocks.labelled_text(found, labels).first().text == f"{ARTICLE}\n{ARTICLE}"
    assert blocks.label_string(labels).first().labels == "0,0,1,1,0"
    f = blocks.block_features(found).orderBy("j").first().f
    assert f[0] == 3 and f[7] == 1.0


def test_alignment():
    a, b = "the quick brown fox".split(), "the slow brown fox jumps".split()
    assert scoring.matching_blocks(a, b) == [(0, 0, 1), (2, 2, 2)]
    assert scoring.opcode_confusion(a, b) == (3, 1, 2)
    assert scoring.opcode_confusion([], b) == (0, 0, 5) and scoring.opcode_confusion(a, []) == (0, 4, 0)


def test_node_labels(spark):
    from weftline.operators import dom

    pages = spark.createDataFrame([(1, "<html><p>one two three four</p> <i>noise</i><b></b></html>"), (2, "<p>none</p>")], "page_id long, html string")
    gold = spark.createDataFrame([(1, "one two three four"), (2, "something else")], "page_id long, text string")
    got = scoring.label_nodes(dom.dom_table(pages, "nodes"), dom.dom_table(pages, "tokens"), gold).collect()
    assert {(r.page_id, r.node_id): r.label for r in got} == {(1, 0): "other", (1, 1): "content", (1, 2): "non_content", (1, 3): "other"}


def test_scores_of_empty_sides(spark):
    df = spark.createDataFrame([(1, "", ""), (2, None, "a b"), (3, "a a b", "a")], "k long, p string, g string")
    got = {r.k: r for r in scoring.alignment_scores(df, "k", "p", "g").collect()}
    assert (got[1].precision, got[1].recall) == (1.0, 1.0) and (got[2].precision, got[2].recall) == (1.0, 0.0)
    counts = {r.k: (r.tp, r.fp, r.fn) for r in scoring.multiset_confusion(df, "k", "p", "g").collect()}
    assert counts == {1: (0, 0, 0), 2: (0, 0, 2), 3: (1, 2, 0)}
    assert scoring.micro(scoring.multiset_confusion(df.where("k = 1"), "k", "p", "g")).first().f1 == 0.0


def test_pages_labelled_in_one_pass(spark, small):
    odd = [(1, "<p>a b c<b>d</b>e f</p><p></p>top", "a b cde f"), (2, "<p>x</p>", ""), (3, None, "a"), (4, "<p>x y</p>", None), (5, "a b<i>c</i> d e f", "a bc d e f"), (None, "<p>a</p>", "a")]
    pages = spark.createDataFrame(odd, "page_id long, html string, gold string")
    whole = spark.read.parquet(f"{small}/pages.parquet").select((F.col("page_id") + 10).alias("page_id"), "html")
    pages = pages.unionByName(whole.withColumn("gold", F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")))
    want = scoring.label_nodes(dom.dom_table(pages, "nodes"), dom.dom_table(pages, "tokens"), pages.select("page_id", F.col("gold").alias("text")))
    got = scoring.label_pages(pages)
    rows = lambda df: sorted(tuple(r) for r in df.select("page_id", "node_id", "n_words", "n_aligned", "label").collect())
    assert rows(got) == rows(want) and {r.page_id for r in got.collect()} >= {1, 5}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # words are not shuffled or joined


def test_density_holds_no_copies_of_what_is_below():
    deep = "<body>" + "<p>some words of a paragraph that is never closed" * 400
    density = extract.Density(extract.body_of(deep), variant=True)
    assert isinstance(density.content, str) and len(density.content) == density.chars[0] < 30_000
    text = "a <b>bc</b> <i></i> d"
    density = extract.Density(extract.body_of(text))
    assert [density.content[lo:hi] for lo, hi in density.span] == ["a bc d", "bc", ""] and density.chars == [6, 2, 0]


def test_multiset_counts_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "a a b c", "a b b d"), (None, "x", "x"), (2, " ", "　y ")], "k long, p string, g string")
    found = scoring.multiset_confusion(df, "k", "p", "g")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (r.tp, r.fp, r.fn) for r in found.collect()} == {1: (2, 2, 2), None: (1, 0, 0), 2: (0, 0, 1)}


def test_near_nodes_by_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dom, "_NEAR", 7)
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 2), (1, 4, 3), (2, 0, None), (3, 5, 4), (None, 0, None), (None, 1, 0)]
    nodes = spark.createDataFrame(rows, "page_id long, node_id int, parent_id int")
    found = dom.within_hops(nodes, 2)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    links = {1: {0: [1, 2], 1: [0], 2: [0, 3], 3: [2, 4], 4: [3]}, 2: {0: []}, 3: {5: [4], 4: [5]}}
    want = set()
    for page, node, _ in rows:
        level, seen = {node}, {node}
        for k in range(3):
            want |= {(page, node, x, k) for x in level}
            level = {y for x in level for y in links.get(page, {}).get(x, [])} - seen
            seen |= level
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_decoding_without_a_frame_a_page(spark):
    rows = [(p, j, [0.0, float((p * 7 + j * 5) % 4)], [0.5, -0.5, -0.5, 0.5] if j < 4 else None) for p in range(80) for j in range(5)]
    found = blocks.decode(spark.createDataFrame(rows, "page_id long, j int, unary array<double>, edge array<double>"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(found.collect()):
        got.setdefault(r.page_id, []).append(r.label)
    assert got == {p: blocks.viterbi(np.array([r[2] for r in rows if r[0] == p]), [r[3] for r in rows if r[0] == p][:-1]) for p in range(80)}


def test_columns_come_along_with_extracted_texts(spark):
    pages = spark.createDataFrame([(i, f"<p>page {i}</p>", f"gold {i}") for i in range(130)], "page_id long, html string, gold string")
    found = extract.extract(pages, "body", keep=("gold",)).collect()
    assert len(found) == 130 and all(r.text == f"page {r.page_id}" and r.gold == f"gold {r.page_id}" for r in found)
