import collections

import pytest
from pyspark.sql import functions as F

from weftline.functions import css
from weftline.operators import dom, features, markup, models
from weftline.plans import cli
from weftline.sources import sinks

PAGE = """<html><head><style>/* c */ p { color: red; font-size: 10px } .big, #one { font-size: 30px; } p.big { font-weight: bold } a:hover { color: blue } @media x</style></head>
<body><p>x</p><p class="big wide" style="color: green">y <b>z</b></p><div id=one>w</div></body></html>"""


def test_inline_css():
    got = {e.tag + e.attrs.get("class", "")[:3]: e.attrs.get("style") for e in markup.elements(features.inline_css(PAGE)) if e.tag in ("p", "div", "b")}
    assert got["p"] == "color: red; font-size: 10px"
    assert got["pbig"] == "color: red; font-size: 10px; font-size: 30px; font-weight: bold; color: green"
    assert got["div"] == "font-size: 30px" and got["b"] is None


@pytest.mark.parametrize("html", [None, "", "<style>p{", "<style>}{</style><p>"])
def test_inline_css_odd(html):
    features.inline_css(html)


def test_vector_layout(spark):
    p = features.FeatureParams(text_dim=8, class_dim=4, positions=3, eigenvectors=2, with_boxes=True)
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = {r.node_id: r.features for r in features.node_features(pages, p).collect()}
    n = features.lengths(p)
    at = sinks.feature_offsets(n)
    nodes = dom.dom_table(pages, "nodes").collect()
    assert len(rows) == len(nodes) and {len(v) for v in rows.values()} == {sum(n.values())}
    part = lambda k, name: rows[k][at[name]["idx"] : at[name]["idx"] + at[name]["len"]]
    bold = next(x for x in nodes if x.tag == "b")
    assert part(bold.node_id, "font_weight") == [0, 1, 0] and part(bold.node_id, "text.length") == [1.0]
    assert part(0, "num_child") == [2.0] and part(0, "tag_type")[p.tags.index("html")] == 1.0
    big = next(x for x in nodes if x.attrs.get("class"))
    assert sum(v * v for v in part(big.node_id, "class_attr")) == pytest.approx(1) and part(big.node_id, "tag_child_pos") == [0, 1, 0]


def test_computed_fonts(spark):
    row = spark.createDataFrame([({"font-style": "italic", "font-weight": "700"},), (None,)], "properties map<string,string>")
    got = [tuple(r) for r in row.select(*features.computed_font(F.col("properties"))).collect()]
    assert got == [("medium", "700", "italic"), ("medium", "normal", "normal")]
    assert css.FONT_SIZES[0] == "medium"


def test_udtf(spark):
    dom.register_udtf(spark)
    got = spark.sql("select n.* from (select '<p>a<b></b></p>' as html) t, lateral dom_nodes(t.html) n").collect()
    assert [tuple(r) for r in got] == [(0, None, 0, "p"), (1, 0, 1, "b")]


def test_cli(spark, small, tmp_path):
    cli.main(["url_parts", small, "--out", f"{tmp_path}/o"])
    assert spark.read.parquet(f"{tmp_path}/o").count() == 50
    assert cli.parse(["url_parts", small]).show == 20


def test_hash_vector_is_the_embedding_of_a_row(spark):
    from pyspark.sql import functions as F

    from weftline.functions.text import tokens
    from weftline.operators import graph

    texts = ["a b a c", "", None, "one", " ".join(f"w{i % 37}" for i in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = {r.k: r.vec for r in graph.hash_embeddings(df, ["k"], tokens(F.col("t")), 16).collect()}
    got = df.select("k", graph.hash_vector(tokens(F.col("t")), 16).alias("vec"))
    assert {r.k: r.vec for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_features_are_made_once_for_all_folds(spark):
    """ranking samples its input, which made the features of every row a second time."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(key, label):
        made.add(1)
        return f"w{label} " * 3 + f"x{key % 5}"

    df = spark.range(90).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("label"))
    rows = models.counts_of(df, ["key", "label"], F.split(body("key", "label"), " "), 64)
    judged = models.cross_validate(rows, "key", "label").collect()
    assert made.value == 90
    assert sorted(r.key for r in judged) == list(range(90)) and all(r.prediction == r.label for r in judged)
    assert sorted(collections.Counter((r.fold, r.label) for r in judged).values()) == [10] * 9
