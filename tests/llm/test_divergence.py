import re
from collections import Counter, defaultdict

import pytest
from oracle import check
from pyspark.sql import functions as F

from weftline.llm import divergence as d

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(docs, p):
    """The contract, every kept term for every group."""
    with_term, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate(LOWER))
        with_term[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in with_term:
        kept = [t for t, n in with_term[lang].items() if n >= p.min_docs]
        sources = sorted(s for g, s in counts if g == lang)
        v = len(kept)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + p.scale * (count[t] + p.prior) // (n + p.prior * v) for t in kept}

        of = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(of[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, p.top)):
                for k, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_equals_sql(spark, small):
    check(spark, small, d.op11_source_divergence, d.ORACLE)


def made(n=240):
    words = ["a" * (k % 3 + 1) + chr(97 + k % 26) + ("ß" if k % 5 == 0 else "") + chr(0x4E00 + k) for k in range(120)] + [f"tie{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    docs = [(" ".join(words[(k * 7 + j * j) % len(words)] for j in range(k % 40)) + " Common-Word,COMMON", "xyz"[k % 3], f"s{k % 7}" if k % 2 else "hot") for k in range(n)]
    docs += [(None, "x", "s1"), ("", None, None), ("tie tie", "", "only"), ("123 !?", "q", "w"), ("long " * 60_000, "z", "S9"), (" ".join(words), "x", "ß"), (" ".join(words), "x", "é")]
    return docs + docs[:20]


@pytest.mark.parametrize("p", [d.DivergenceParams(min_docs=2, top=5, bits=3, settled=1, held_terms=50, block_cells=64), d.DivergenceParams(min_docs=1, top=50), d.DivergenceParams(min_docs=1000)])
def test_equals_plain(spark, p):
    docs = made()
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("term", F.lit(1)).repartition(5)
    assert result(d.divergence(df, p)) == plain(docs, p)


def test_ties_by_bytes_at_every_depth(spark):
    items = ["", "a", "aa", "aaa", "aaaa", "aab", "ab", "b", "é", "ß", "z", "aaaaz"]
    rows = [("g", x, 7) for x in items] + [("g", f"big{k}", 100 + k) for k in range(3)] + [("h", "one", 0)]
    df = spark.createDataFrame(rows, "k string, item string, value long")
    for top in (1, 3, 4, 7, 12, 15):
        p = d.DivergenceParams(top=top, bits=4, settled=1)
        got = [(r["item"], r["rank"]) for r in d.top_by_radix(df.where("k = 'g'"), ["k"], "value", "item", p, 8).collect()]
        want = sorted((r for r in rows if r[0] == "g"), key=lambda r: (-r[2], r[1].encode()))[:top]
        assert sorted(got, key=lambda x: x[1]) == [(r[1], k + 1) for k, r in enumerate(want)]


def test_empty_table(spark):
    assert d.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
