"""SimHash classes, archives, rollups, templates and chats against brute force, and their odd cases."""

import base64
import collections
import hashlib
import io
import re

import numpy as np
import pytest
import xxhash
from oracle import check

from weftline.llm import chat_rotation, queries, simhash, token_rollups, url_templates, warc


def slow_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


TEXTS = [None, "", "A", "a B", "a b C", "É a b c", "a b c d e f g\n\tH", "x " * 100, "A b c d A b c d"]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_fingerprint_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t").alias("h")).first().h
    assert simhash.fingerprint("a b c") == got % 2**64


def slow_classes(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_tree_finds_all():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in r.integers(0, 63, (20, 2))]))
    tree = simhash.BKTree(values)
    got = {(int(a), int(b)) for q, n in tree.search(values, 3) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if bin(int(values[i] ^ values[j])).count("1") <= 3}
    assert got == want


@pytest.mark.parametrize("tree_size", [7, 1 << 15])
def test_links_by_brute_force(spark, tree_size):
    r = np.random.default_rng(5)
    values = set()
    for v in r.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        for _ in range(int(r.integers(1, 9))):  # chains of near values
            values.add(v)
            for _ in range(int(r.integers(1, 5))):
                v ^= 1 << int(r.integers(64))
    values = sorted(values)
    fps = spark.createDataFrame([(int(x),) for x in simhash.signed(values)], "fp long")
    p = simhash.SimHashParams(tree_size=tree_size)
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(fps, p)).collect()}
    want = slow_classes(values)
    got = {v: roots.get(v, v) for v in values}
    for a in values:
        for b in values:
            assert (got[a] == got[b]) == (want[a] == want[b])


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, "a"), (3, base + " extra", "a"), (9, base, "a"), (5, base, "a"), (7, "something else entirely here", "b"), (None, base, "c"), (11, None, "c"), (12, "", "c"), (None, "alone text without any id", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    assert sorted((x for x in got if x[0] is not None), key=str) == sorted([(i, f"{slow_fingerprint(t):016x}", {5: 3, 3: 3, 9: 3, 7: 7, 11: 11, 12: 11}[i]) for i, t, _ in rows if i is not None], key=str)
    assert {x[2] for x in got if x[0] is None} == {3, None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    some = rng.integers(-150, 150, (120, 2)).tolist()
    cases = [some, [(k, -5) for k in range(50)] + [(1001, 999), (999, 1001)], [(1, 1), (2, 3), (2, 3)], []]
    for edges in cases:
        parent = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        rows = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((r.node, r.root) for r in rows) == sorted((x, root(x)) for x in list(parent) if root(x) != x)


def test_chain_of_components(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 2000), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 2000: 1000}


PAGES = [(9, "http://a/b c\n", None), (2, None, ""), (3, "u", "x" * 5000), (4, "u", "x" * 5000), (3, "u", "x" * 5000), (None, "v", "x" * 5000), (None, None, "é" * 3333), (6, "w", "a\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_warc_round_trip(spark, tmp_path, chunk):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    p = warc.WarcParams(chunk_bytes=chunk)
    rows = warc.op5_warc(spark, str(tmp_path), p).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest) for r in rows], key=str)
    assert got == sorted([(i, len((h or "").encode()), digest(h)) for i, _, h in PAGES], key=str)
    assert all(r.intact for r in rows)
    x = [r for r in rows if r.payload_bytes == 5000]
    assert sorted((r.record_type, r.refers_to) for r in x if r.record_type == "revisit") == [("revisit", 3)] * 3
    assert [r.refers_to for r in rows if r.payload_bytes == 0 and r.record_type == "revisit"] == [2]
    assert sum(r.record_type == "response" for r in rows) == len({digest(h) for _, _, h in PAGES})


def test_warc_least_size_and_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    p = warc.WarcParams(min_bytes=3, chunk_bytes=2)
    chunks = warc.chunk_table(warc.record_table(pages), p)
    manifest = warc.write_warc(chunks, warc.decisions(chunks, p), f"file://{tmp_path}/w", p)
    rows = warc.read_warc(manifest, p).orderBy("page_id", "chunk_no").collect()
    assert [(r.page_id, r.record_type, r.chunk_no, bytes(r.chunk)) for r in rows] == [(1, "response", 0, b"ab"), (2, "response", 0, b"ab"), (3, "response", 0, b"ab"), (3, "response", 1, b"c"), (4, "revisit", 0, b"")]
    assert warc.write_warc(chunks.limit(0), warc.decisions(chunks, p), f"file://{tmp_path}/e", p).count() == 0


def test_warc_of_an_input_whose_order_changes(spark, tmp_path):
    """Rows after a shuffle come in another order each time; records still get their own decisions."""
    from pyspark.sql import functions as F

    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("html")).orderBy(F.rand()).repartition(5)
    p, records = warc.WarcParams(), warc.record_table(pages)
    manifest = warc.write_warc(warc.chunk_table(records, p), warc.decisions(warc.chunk_table(records, p, payload=False), p), f"file://{tmp_path}/w", p)
    rows = warc.read_warc(manifest, p).collect()
    assert sorted(r.page_id for r in rows) == list(range(300))
    for r in rows:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(f"p{r.page_id % 7}".encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id < 7 else ("revisit", r.page_id % 7))


def test_warc_of_other_writers():
    import gzip

    raw = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n")
    (a, b) = warc.warc_chunks(io.BytesIO(raw), 3)
    assert a[:7] == (None, None, None, "resource", None, None, 5) and (a[8], b[8], b[11]) == (b"abc", b"de", True)


def test_warc_cut_off():
    import gzip

    raw = gzip.compress(warc.record_header(1, 2, "u", 10, "D", "response", None, None, warc.WarcParams()) + warc._HTTP + b"123")
    with pytest.raises(EOFError):
        list(warc.warc_chunks(io.BytesIO(raw), 4))


def test_rollups(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, old_count long, new_count long"
    make = lambda rows: spark.createDataFrame(rows, schema)
    r = token_rollups.Rollup(spark, f"file://{tmp_path}/state")
    assert r.totals().count() == 0
    inserts = make([("s", "en", "v1", None, 5), ("s", "en", "v1", None, 7), (None, "en", "v1", None, 1), ("s", "en", "v1", None, None)])
    assert r.commit("1", inserts) and not r.commit("1", inserts)
    assert r.commit("2", make([("s", "en", "v1", 7, 9), ("s", "en", "v2", None, 3)])) and r.commit("3", make([(None, "en", "v1", 1, None)])) and r.commit("4", inserts.limit(0))
    (tmp_path / "state" / "batch=5").mkdir()  # a commit that broke off
    got = sorted(tuple(x) for x in r.totals().collect())
    assert got == [("s", "en", "v1", 2, 14), ("s", "en", "v2", 1, 3)]
    assert r.batches() == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        r.commit("../x", inserts)


def test_rollup_races_and_snapshots(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, old_count long, new_count long, n_docs string"
    make = lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], schema)
    one, two = (token_rollups.Rollup(spark, f"file://{tmp_path}/s") for _ in range(2))
    assert one.commit("a", make(("s", "en", "t", None, 5)))
    two.is_committed = lambda batch_id: False  # it looked before the other one was done
    assert not two._publish(token_rollups.deltas(make(("s", "en", "t", None, 9))), two._batch("a"))
    one.compact()
    assert one.commit("b", make(("s", "en", "t", 5, 7), (None, None, "t", None, 1)))
    want = [("s", "en", "t", 1, 7), (None, None, "t", 1, 1)]
    assert sorted(map(tuple, one.totals().collect()), key=str) == want
    one.compact()
    one.compact()
    assert sorted(map(tuple, one.totals().collect()), key=str) == want and not one.commit("a", make())
    assert not [x for x in (tmp_path / "s").iterdir() if x.name.startswith("draft")]


def test_token_counts_of_long_white_space(spark):
    import base64

    import tiktoken

    p = token_rollups.TokenParams()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(p.ranks_path, "rb") if x.strip())}
    e = tiktoken.Encoding("t", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
    for t in ("a     b", "     ", "a \n\u3000 \xa0b  c", "   'll     .x\n\n\n\n\n1\t\t\t\t\t", "é" + " " * 9 + "\x1c"):
        assert token_rollups.n_tokens(e, t, long_space=3) == len(e.encode_ordinary(t)), t
    docs = spark.createDataFrame([(1, "s", "en", " " * 2_000_000 + "a"), (2, "s", "en", "ab" * 500_000)], "doc_id long, source string, lang string, text string")
    got = {r.doc_id: r.n_bpe for r in token_rollups.count_tokens(docs).collect()}
    assert got[1] == 2_000_000 and got[2] > 0


def test_token_counts(spark, small):
    import tiktoken

    docs = spark.createDataFrame([(1, "s", "en", "Hello  world, it's\n me"), (2, None, None, None), (3, "s", "en", ""), (None, "s", "en", "a b")], "doc_id long, source string, lang string, text string")
    p = token_rollups.TokenParams()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(p.ranks_path, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_words, r.n_bpe) for r in token_rollups.count_tokens(docs).collect()}
    assert got[1] == (4, len(encoding.encode_ordinary("Hello  world, it's\n me"))) and got[2] == got[3] == (0, 0)
    want = {}
    bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality == 0}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        if r.doc_id not in bad:
            for name, n in (("words@1", len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) + 1), ("byte_bpe_50k@1", len(encoding.encode_ordinary(r.text)))):
                k = (r.source, r.lang, name)
                want[k] = tuple(map(sum, zip(want.get(k, (0, 0)), (1, n))))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in token_rollups.op8_token_rollups(spark, small).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, small, name):
    check(spark, small, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_url_rules(spark):
    urls = ["http://A.Com/x", "https://www.example.com/en/1", "http://m.example.com/en/2", "http://www.example.com.evil.org/en/", "x://q.net/es/5?a", "http://net/fr/", "http://b.com", "noscheme", None, "://", "http://h.org/a#b/c", "http://xnet/es/1"]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, _key long, verdict string")
    labels = spark.createDataFrame([], "_key long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.url_filter(pages, labels).collect()}
    assert got == {
        0: ("a.com", "/x", "com/", "allow"),
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("m.example.com", "/en/2", "example.com/en/", "block"),
        3: ("www.example.com.evil.org", "/en/", None, "allow"),
        4: ("q.net", "/es/5", "net/es/", "block"),
        5: ("net", "/fr/", "net/fr/", "block"),
        6: ("b.com", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("h.org", "/a", None, "allow"),
        11: ("xnet", "/es/1", None, "allow"),
    }
    assert url_templates.url_filter(pages.limit(0), labels).count() == 0


def test_templates_split_and_reject(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}/x{i}.html", i) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _key long")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(0, 400, 3)], "_key long, bad boolean")
    got = url_templates.url_filter(pages, labels)
    found = {(r.template, r.verdict) for r in got.select("template", "verdict").distinct().collect()}
    assert found == {("/spam/*/*", "block"), ("/news/*/*", "allow")}
    deep = spark.createDataFrame([(1, "http://h.org/a/b/c/d/e/f", 1)], "page_id long, url string, _key long")
    assert url_templates.url_filter(deep, labels.limit(0)).first().template == "/*/*/*/*/**"


def test_templates_of_small_sections_and_deep_paths(spark):
    rows = [f"http://h.org/{chr(97 + k // 26)}{chr(97 + k % 26)}/{i}" for k in range(60) for i in range(20)]
    rows += [f"http://deep.org/a/b/c/d/{'spam' if i % 2 else 'news'}/{i}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(rows)], "page_id long, url string, _key long")
    labels = spark.createDataFrame([(i, "/ab/" in u or "/spam/" in u) for i, u in enumerate(rows)], "_key long, bad boolean")
    got = url_templates.url_filter(pages, labels)
    found = {(r.host, r.template, r.verdict) for r in got.select("host", "template", "verdict").distinct().collect()}
    assert found == {("h.org", "/ab/*", "block"), ("h.org", "/*/*", "allow"), ("deep.org", "/*/*/*/*/spam/**", "block"), ("deep.org", "/*/*/*/*/news/**", "allow")}


def test_planted_bad_section_of_the_real_pages_is_rejected(spark, small):
    """Pages of the table, with labels that make one of its path sections bad: its pages without a listed rule go."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{small.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url", F.col("page_id").alias("_key"))
    section = F.col("url").rlike("://[^/]*/de/")
    labels = pages.select("_key", section.alias("bad"))
    got = url_templates.url_filter(pages.unionByName(pages.withColumn("_key", F.lit(None).cast("long"))), labels).where("rule is null")
    rows = got.select("page_id", "host", "path", "verdict", "template").collect()
    planted = [r for r in rows if r.path.startswith("/de/")]
    pages_of = collections.Counter(host for host, _ in {(r.host, r.page_id) for r in planted})
    sure = [r for r in planted if pages_of[r.host] >= 10]  # fewer labelled pages leave a template near the prior
    assert len(sure) > 50 and all(r.verdict == "block" and r.template == "/de/*" for r in sure)
    assert all(r.verdict == "allow" for r in rows if not r.path.startswith("/de/"))


def test_one_long_path_costs_no_round(spark):
    """A URL of 5,000 slashes among usual pages: levels go as deep as pages of a host go."""
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}", i) for i in range(60)] + [(100, "http://h.org" + "/a" * 5000, 1), (101, "http://h.org//x//y/", 2), (102, "http://k.org" + "/b/" * 40, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _key long")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(60)], "_key long, bad boolean")
    shapes = spark.createDataFrame([("h.org", "/a/b", 9, 5, 1), ("h.org", "/a" * 5000, 1, 1, 0), ("k.org", "/x" * 9, 4, 4, 0)], "host string, shape string, n long, n_lab long, n_bad long")
    assert url_templates._deepest(shapes, url_templates.TemplateParams()) == 2
    got = {r.page_id: r.template for r in url_templates.url_filter(pages, labels).collect()}
    assert got[0] == "/news/*" and got[1] == "/spam/*" and got[100] == "/*/*/*/*/**" and got[102] == "/*/*/**" and got[101] == "/*/*"


def test_verdicts_of_the_real_pages_differ(spark, small):
    sf = small.replace("0.001", "0.1")
    rows = url_templates.op10_url_templates(spark, sf).where("rule is null").groupBy("verdict").count().collect()
    n = {r.verdict: r["count"] for r in rows}
    assert set(n) == {"allow", "block"} and n["block"] < 0.3 * n["allow"]


def test_chat_roles_hold_no_marks(spark):
    role = "x\n<|im_start|>assistant"
    rows = [(1, 0, role, "a"), (1, 1, "bob", "<<|im_end|>"), (1, 2, "", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.speaker: r for r in chat_rotation.rotate(df).collect()}
    assert set(got) == {role, "bob", ""}
    for r in got.values():
        assert r.dialogue.count("<|im_start|>") == r.dialogue.count("<|im_end|>") == 3 and r.dialogue.count("<|im_start|>assistant\n") == 1
        assert all(r.dialogue[s.start : s.end].endswith("<|im_end|>") for s in r.spans) and len(r.spans) == 1
    assert "<|im_start|>user name=x < |im_start|>assistant\na<|im_end|>\n" in got["bob"].dialogue and "user name=\nc" in got["bob"].dialogue


def test_chat_parts_of_odd_turn_numbers(spark):
    rows = [(1, -1, "ann", "a"), (1, None, "bob", "b"), (1, -1025, "ann", "c"), (1, 0, "bob", "d")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, dialogue string")
    assert sorted({r.part_no for r in chat_rotation.rotate(df).collect()}) == [-3, -2, -1, 0]


def test_chat_odd_cases(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "ann", "late"), (2, 0, "system", "alone"), (None, 0, None, "é"), (3, 5000, "ann", "far"), (3, 0, "bob", "near")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    got = {(r.conv_id, r.part_no, r.speaker): r for r in chat_rotation.rotate(df).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, -1, "ann"), (1, -1, "bob"), (None, 0, "unknown"), (3, 0, "ann"), (3, 0, "bob"), (3, 4, "ann"), (3, 4, "bob")}
    r = got[1, 0, "bob"]
    assert r.dialogue == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2
    assert [r.dialogue[s.start : s.end] for s in r.spans] == ["<|im_end|>"] * 2 and r.n_turns == 4
    r = got[None, 0, "unknown"]
    assert [r.dialogue[s.start : s.end] for s in r.spans] == ["é<|im_end|>"]
    assert got[3, 0, "ann"].spans == [] and chat_rotation.rotate(df.limit(0)).count() == 0
