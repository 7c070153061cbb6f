import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import dom, markup, serialise
from weftline.plans import queries_more

ODD = [
    "", "plain", "<p>a<b>b<i>c</b>d</i>e", "<ul><li>x<li>y</ul><br><br/>z<hr>", "<pre> \n </pre><div> \n </div>", "a<!-- c -->b<!-- d --> e", "a<script>x<y</script>b<style>p>a{}</style>c",
    "<a href='x\"y&amp;z' title=\"a'b\" hidden>t &lt;b&gt; &amp;amp; &eacute;</a>", "<div><p>one<div>two</p>three</div>four", "</p>stray<td>cell", "<template><p>in</p>t</template>", "<title>a & b</title><textarea> x </textarea>",
    "<meta charset=x><p>m<noscript>n</noscript>o", "é ß 漢字 &nbsp;|", "<svg viewBox='0 0 1 1'><path d='M0'/></svg>",
]


def tables(spark, pages):
    out = {}
    for want in ("nodes", "texts", "tokens", "layout"):
        out[want] = sorted(map(repr, dom.dom_table(pages, want).collect()))
    return out


def test_same_tables_again(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(10_000 + i, h) for i, h in enumerate(ODD)], "page_id long, html string")
    pages = pages.unionByName(odd)
    again = serialise.serialise(serialise.layout(pages))
    assert again.count() == pages.count() - 1  # a page without an element or text has no row
    assert tables(spark, again) == tables(spark, pages)


def one(html):
    """The same as the operator does, by recursion."""
    rows = dom._layout_rows(0, markup.parse(html))

    def write(lo, hi):
        out = []
        while lo <= hi:
            _, pos, last, _, _, _, tag, owner, attrs, text, apart = rows[lo]
            esc = lambda s, q: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;" if q else '"')
            if tag is None:
                out.append(("<!---->" if apart else "") + (text if owner in serialise._PLAIN else esc(text, False)))
            else:
                out.append(f"<{tag}" + "".join(f' {k}="{esc(v, True)}"' for k, v in attrs) + ">" + write(pos + 1, last) + ("" if tag in markup.VOID else f"</{tag}>"))
            lo = last + 1
        return "".join(out)

    return write(0, len(rows) - 1)


def test_equals_recursion(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)), "page_id long, html string")
    got = {r.page_id: r.html for r in serialise.serialise(serialise.layout(pages)).collect()}
    assert got == {i: one(h) for i, h in enumerate(ODD) if h}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<br>", "<!-- x -->", "text", " ", "\n", "a &amp; b", "<li>", "</ul>", "<ul>", "<script>s<b</script>", "<style>a>b</style>", "&lt;", "<pre>", "</pre>"]), max_size=25))
def test_round_trip(parts):
    html = "".join(parts)
    shape = lambda h: [r[1:] for r in dom._layout_rows(0, markup.parse(h))]
    assert shape(one(html)) == shape(html)


def test_labelled_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").limit(20)
    nodes = dom.dom_table(pages, "nodes").select("page_id", "node_id", F.when(F.col("tag") == "p", "content").otherwise("non_content").alias("label"))
    got = {r.page_id: r.html for r in serialise.labelled_pages(pages, nodes).collect()}
    plain = {r.page_id: r.html for r in serialise.serialise(serialise.layout(pages)).collect()}
    texts = {r.page_id: r.n for r in dom.dom_table(pages, "layout").where("tag is null and text rlike '\\\\S'").groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    for page, html in got.items():
        assert len(re.findall('<span data-label="[01]">', html)) == texts[page]
        assert re.sub('<span data-label="[01]">([^<]*)</span>', r"\1", html) == plain[page]
        assert all(re.match('<p><span data-label="1">', html[m.start() :]) for m in re.finditer("<p>[^<]*<span", html))


@pytest.mark.parametrize("name", ["labelled_html", "inlined_html", "cascaded_styles", "page_languages"])
def test_queries_without_sql_run(spark, small, name):
    assert getattr(queries_more, name)(spark, small).count() > 0
