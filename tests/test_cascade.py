import random

from weftline.operators import cascade, markup


def descend(e):
    return [x for x in e.walk() if isinstance(x, markup.Element)]


def brute(selector, root):
    """Elements that a selector fits, from the left: all that fit the first compound, then those reached from them."""
    every = descend(root)
    found = [e for e in every if selector.compounds[0].fits(e)]
    for comb, compound in zip(selector.combinators, selector.compounds[1:]):
        reached = set()
        for e in found:
            around = e.parent.elements()
            at = next(k for k, x in enumerate(around) if x is e)
            near = {" ": descend(e), ">": e.elements(), "+": around[at + 1 : at + 2], "~": around[at + 1 :]}[comb]
            reached |= {x.number for x in near if compound.fits(x)}
        found = [e for e in every if e.number in reached]
    return {e.number for e in found}


def test_matches_equal_brute_force():
    rng = random.Random(3)
    tags, marks = ["div", "p", "ul", "li", "a"], ["", ".x", ".y", "#i", "[href]", "[href^='h']", '[lang|="en"]', "[t~=b]", "[href$=z]", "[href*=q]", ":first-child", ":last-child", ".x.y"]

    def page(depth):
        attrs = "".join(rng.choice(["", " class='x'", " class='x y'", " id=i", " href='hqz'", " lang='en-GB'", " t='a b'", " href=''"]) for _ in range(1))
        tag = rng.choice(tags)
        return f"<{tag}{attrs}>" + "".join(page(depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"

    n = 0
    for _ in range(60):
        root = markup.parse("".join(page(4) for _ in range(3)))
        for _ in range(25):
            text = rng.choice([" ", " > ", "+", " ~ ", ">"]).join((rng.choice([*tags, "*", ""]) + rng.choice(marks)) or "*" for _ in range(rng.randrange(1, 4)))
            selector = cascade.parse_selector(text)
            assert selector is not None, text
            want = brute(selector, root)
            assert {e.number for e in descend(root) if selector.fits(e)} == want, text
            sheet = cascade.Sheet(f"{text} {{ color: red }}")
            assert {e.number for e in descend(root) if sheet.matches(e)} == want, text
            n += len(want)
    assert n > 1000


def test_selectors_that_are_passed_over():
    for text in ("a:hover", "p::before", "", ">p", "a >", "a:not(.b)", "[x", "a,b"):
        assert cascade.parse_selector(text) is None or text == "a >", text
    assert cascade.parse_selector("DIV > P.a").compounds[1] == cascade.Compound("p", (), ("a",), (), ())


def test_sheet_skips_at_rules_and_comments():
    sheet = cascade.Sheet("@import 'x'; /* p{a:b} */ @media print { p { color: red } } p, a:hover, b { color: blue; } i {} broken { x: y")
    assert [(s.compounds[0].tag, b) for s, b in sheet.rules] == [("p", "color: blue"), ("b", "color: blue"), ("broken", "x: y")]


def test_commas_within_attributes():
    sheet = cascade.Sheet("a[t='x,y'], b , [q] { c: d }")
    assert [(s.compounds[0].tag, s.compounds[0].attributes) for s, _ in sheet.rules] == [("a", (("t", "=", "x,y"),)), ("b", ()), ("", (("q", "", ""),))]


def test_cascade_order_and_inheritance():
    css = "p { color: red; margin: 1px; font-size: 2em } .c { color: blue } #i { color: green } p { color: black } div p { color: gray !important } b { color: inherit; margin: inherit; font-size: initial }"
    root = markup.parse("<div style='text-align: right; padding: 3px'><p class=c id=i style='color: white; margin: 2px'>x<b>y</b></p></div><p class=c>z</p><p style='color: tan'>w</p>")
    got = cascade.computed_styles(root, cascade.Sheet(css))
    assert got[0] == {"text-align": "right", "padding": "3px"}
    assert got[1] == {"text-align": "right", "color": "gray", "margin": "2px", "font-size": "2em"}
    assert got[2] == {"text-align": "right", "color": "gray", "margin": "2px"}
    assert got[3]["color"] == "blue" and got[4]["color"] == "tan"


def test_declarations():
    assert cascade.declarations("a: b; ;c; D: url(x;y) ! important; e: 'q;r'") == [("a", "b", False), ("d", "url(x;y)", True), ("e", "'q;r'", False)]


def test_inline_css_with_combinators():
    root = cascade.inline_css("<style>ul > li { a: 1 } li li { b: 2 } p { c: 3 !important }</style><ul><li>x<ol><li>y</li></ol></li></ul><p style='c: 4'>")
    styles = {(e.tag, e.number): e.attrs.get("style") for e in markup.elements(root)}
    assert styles[("li", 2)] == "a: 1" and styles[("li", 4)] == "b: 2" and styles[("p", 5)] == "c: 3 !important; c: 4; c: 3 !important"
