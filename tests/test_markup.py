from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators import dom, markup

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><meta charset=x></head>
<body><!-- c --><p>one<b>two<br>three<p id=x id=y>four &amp; five</body></html>"""


def tags(root):
    return [(e.number, e.tag, e.parent.number) for e in markup.elements(root)]


def test_unclosed_void_and_dropped():
    assert tags(markup.parse(PAGE)) == [(0, "html", -1), (1, "head", 0), (2, "title", 1), (3, "body", 0), (4, "p", 3), (5, "b", 4), (6, "br", 5), (7, "p", 5)]


def test_last_attribute_and_entity():
    root = markup.parse(PAGE)
    last = markup.elements(root)[-1]
    assert last.attrs == {"id": "y"} and last.strings() == ["four & five"]


def test_closed_references():
    """parse reads references as HTML does; parse_closed decodes those alone that a semicolon closes."""
    html = "<p title='a&lt;b'>x&amp<b>&copy; &copy &notit; &#65; &#65 &amp;lt; & a&b</b><i>&quot"
    texts = lambda root: [t.text for t, _ in markup.texts(root)]
    assert texts(markup.parse(html)) == ["x&", "© © ¬it; A A &lt; & a&b", '"']
    closed = markup.parse_closed(html)
    assert texts(closed) == ["x&amp", "© &copy &notit; A &#65 &lt; & a&b", "&quot"]
    assert markup.elements(closed)[0].attrs == {"title": "a<b"} and tags(closed) == tags(markup.parse(html))
    assert tags(markup.parse_closed(None)) == []


def test_stray_end_tag_and_comment_split():
    root = markup.parse("<div>a</span>b<!-- x -->c</div>")
    assert [t.text for t, _ in markup.texts(root)] == ["ab", "c"]


def test_words_across_tags_and_blocks():
    root = markup.parse("<html><p>foo<b>bar</b> baz<br>x<p>y<span style='display:block'>z</span>")
    assert markup.words(root) == [("foobar", [1, 2]), ("baz", [1]), ("x", [1]), ("y", [4]), ("z", [5])]


def test_nothing():
    assert tags(markup.parse(None)) == tags(markup.parse("")) == []
    assert markup.words(markup.parse("text only")) == [("text", [-1]), ("only", [-1])]


def test_deep_page_does_not_recurse():
    assert len(markup.elements(markup.parse("<div>" * 5000 + "x"))) == 5000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<br>", "a ", "b", "<!--x-->", "<li>", "</ul>", "<ul>"]), max_size=30))
def test_numbers_are_preorder(parts):
    root = markup.parse("".join(parts))
    found = markup.elements(root)
    assert [e.number for e in found] == list(range(len(found)))
    for e in found:
        assert e.parent.number < e.number <= e.last
        assert e.last == max([e.number, *(c.last for c in e.elements())])


def test_tables_agree(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    nodes = dom.dom_table(pages, "nodes").cache()
    assert nodes.count() == 8
    a = {tuple(r) for r in dom.edges_of(nodes).collect()}
    b = {tuple(r) for r in dom.dom_table(pages, "edges").collect()}
    assert a == b and len(a) == 14
    sums = dom.subtree_sums(nodes, nodes.selectExpr("page_id", "node_id", "1 as one"), ["one"]).collect()
    ends = {r.node_id: r.subtree_end - r.node_id + 1 for r in nodes.collect()}
    assert {r.node_id: r.one for r in sums} == ends


def test_hidden_and_hops(spark):
    pages = spark.createDataFrame([(1, "<div><p display=none><b>x</b></p><i>y</i></div>")], "page_id long, html string")
    nodes = dom.dom_table(pages, "nodes").cache()
    assert sorted(r.tag for r in dom.without_hidden(nodes).collect()) == ["div", "i"]
    far = {(r.node_id, r.near_id): r.distance for r in dom.within_hops(nodes, 3).collect()}
    assert far[2, 3] == 3 and far[0, 2] == 2 and far[1, 1] == 0 and len(far) == 16


def test_strict_position(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a</li><li><b></b></li><li>c</li></ul>")], "page_id long, html string")
    got = {r.node_id: r.first_idx for r in dom.first_equal_sibling(dom.dom_table(pages, "nodes")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
