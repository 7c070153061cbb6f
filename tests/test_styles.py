import pytest
from pyspark.sql import functions as F

from weftline.functions import css, text, urls, vectors


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


def test_style_map(spark):
    got = one(spark, css.style_map(F.lit("Color: red; font-size:12px;color:blue; bad; url: a:b")))
    assert got == {"color": "blue", "font-size": "12px", "url": "a:b"}
    assert one(spark, css.style_map(F.lit(None).cast("string"))) == {}


@pytest.mark.parametrize(
    "tag, attrs, style, want",
    [
        ("p", {}, "font: italic bold 12px/30px Georgia", ("12px", "bold", "italic")),
        ("b", {}, "", ("inherit", "bold", "inherit")),
        ("em", {}, "", ("inherit", "inherit", "italic")),
        ("font", {"size": "+2"}, "", ("larger", "inherit", "inherit")),
        ("font", {"size": "3"}, "", ("medium", "inherit", "inherit")),
        ("b", {}, "font-size: 2em", ("2em", "", "")),
    ],
)
def test_simple_font(spark, tag, attrs, style, want):
    row = spark.createDataFrame([(tag, attrs, style)], "tag string, attrs map<string,string>, style string")
    got = row.select(*[c.alias(f"c{i}") for i, c in enumerate(css.simple_font(F.col("tag"), F.col("attrs"), css.style_map(F.col("style"))))]).first()
    assert tuple(got) == want


def test_one_hots(spark):
    assert one(spark, css.font_weight(F.lit("700"))) == [0, 1, 0] and one(spark, css.font_style(F.lit("initial"))) == [1, 0, 0, 0]
    assert one(spark, css.font_weight(F.lit(None).cast("string"))) == [0, 0, 1]
    assert one(spark, css.size_features(F.lit("50%")))["class"] == [1, 0, 0, 0]


def test_gold_blocks(spark):
    got = one(spark, text.clean_gold_blocks(F.lit("URL: http://x\n<h> Title\n<l>* item\n----------\n  <p>body")))
    assert got.split("\n") == ["Title", "item", "body"] or got.replace("\n", " ").split() == ["Title", "item", "body"]


def test_join_strings(spark):
    assert one(spark, text.join_strings(F.array(F.lit(" a "), F.lit("b"), F.lit("c ")), F.array(F.lit(True), F.lit(False), F.lit(True)))) == "\nab\nc"


def test_decode(spark):
    for raw, want in ((b"caf\xc3\xa9", "café"), (b"caf\xe9 \x93q\x94", "café “q”"), (b"\x81\xe9", "\x81é")):
        row = spark.createDataFrame([(bytearray(raw),)], "b binary")
        assert row.select(text.decode_text(F.col("b")).alias("x")).first().x == want


def test_tokens_split_every_space(spark):
    s = "a b c　d\x1ce  f"
    assert one(spark, text.tokens(F.lit(s))) == s.split()


def test_hosts(spark):
    row = spark.createDataFrame([("http://u@www.News.bbc.co.uk:80/a/b?x#y",), ("https://example.org",)], "url string")
    sub, domain, tld = urls.split_host(urls.host(F.col("url")))
    got = [tuple(r) for r in row.select(sub, domain, tld, urls.path(F.col("url"))).collect()]
    assert got == [("www.news", "bbc", "co.uk", "/a/b"), ("", "example", "org", "")]


def test_group_and_range(spark):
    name = urls.group_name(F.lit("www"), F.lit("a"), F.lit("org"), F.lit("x/main-crawl-2012-05/indexes/cdx-00001.gz"))
    assert one(spark, name) == "www.a.org_2012_cdx-00001"
    assert one(spark, urls.byte_range(F.lit("10"), F.lit("5"))) == "10-14"
    assert one(spark, urls.archive_format(F.lit("2012"))) == "ARC" and one(spark, urls.archive_format(F.lit("2013"))) == "WARC"
    assert one(spark, urls.is_long(F.lit("many"))) is False


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, b)) == 0.0 and one(spark, vectors.l2_normalise(a)) == [0.6, 0.8]
    assert one(spark, vectors.truncated_cosine(a, F.transform(a, lambda x: -x))) == 0.0
    assert [one(spark, vectors.is_power_of_two(F.lit(n))) for n in (0, 1, 6, 8)] == [False, True, False, True]
    assert one(spark, vectors.glu(a, b)) == [1.5, 2.0]
