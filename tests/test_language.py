import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import language, scoring, suffixes
from weftline.plans import queries_more

DATA = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    """Documents of at least 100 characters whose language was not learned from."""
    rows = queries_more.language_scores(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.length("text").alias("size")), "doc_id")
    held = rows.where("held_out and size >= 100")
    n, right = held.count(), held.where("guessed = lang").count()
    assert n > 150 and right / n > 0.95


def test_profile_equals_plain(spark):
    rows = [("Hello there, hello", "en"), ("guten Tag, guten Abend", "de"), ("漢字漢字", "zh"), (None, "en"), ("ab", "de"), ("no language", None), ("guten Tag", "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    p = language.LanguageParams(keep=4, held_grams=3)
    got = language.fit_profile(df, p)
    counts = {}
    for text, lang in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for k in range(len(t) - 2):
            if lang:
                counts.setdefault(lang, {}).setdefault(t[k : k + 3], 0)
                counts[lang][t[k : k + 3]] += 1
    kept = sorted({g for c in counts.values() for g in sorted(c, key=lambda g: (-c[g], g))[:4]})
    assert got.languages == ["de", "en", "zh"]
    assert got.grams.tolist() == [int(language.trigrams(g)[0]) for g in kept]
    for k, lang in enumerate(got.languages):
        total = sum(counts[lang].get(g, 0) for g in kept)
        want = [int(np.floor(np.log((counts[lang].get(g, 0) + 1) / (total + len(kept))) * 1000)) for g in kept]
        assert got.weights[:, k].tolist() == want
    found = {r.k: r.guessed for r in language.guess(spark.createDataFrame([(1, "gute"), (2, "zz"), (3, None), (4, "漢字漢"), (5, "§§§§")], "k long, text string"), got, "k").collect()}
    assert found == {1: "de", 2: None, 3: None, 4: "zh", 5: None}
    kept_rows = language.in_languages(df.withColumn("id", F.monotonically_increasing_id()), got, ["de"], "id", F.col("text"))
    assert kept_rows.count() == 2


def test_no_language(spark):
    got = language.fit_profile(spark.createDataFrame([("abcd", None)], "text string, lang string"))
    assert got.languages == [] and language.guess(spark.createDataFrame([(1, "abcd")], "k long, text string"), got, "k").first().guessed is None


def test_too_many_languages(spark):
    df = spark.createDataFrame([(f"text {k}", str(k)) for k in range(30)], "text string, lang string")
    with pytest.raises(ValueError):
        language.fit_profile(df, language.LanguageParams(most_cells=100))


def plain_suffix(host, rules):
    labels = host.split(".")
    fits = []
    for r in rules:
        parts = r.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(a in ("*", b) for a, b in zip(parts[::-1], labels[::-1])):
            fits.append((r.startswith("!"), len(parts)))
    exception, n = max(fits, default=(False, 1))
    return ".".join(labels[-(n - exception) :])


def test_suffixes_equal_plain(spark):
    rules = ["com", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "jp", "!city.kobe.jp", "a.b.c.d"]
    hosts = ["x.com", "com", "a.b.co.uk", "co.uk", "uk", "www.ck", "b.www.ck", "a.b.ck", "b.ck", "ck", "x.city.kobe.jp", "x.y.kobe.jp", "y.kobe.jp", "kobe.jp", "z.a.b.c.d", "b.c.d", "localhost", "", "1.2.3.4"]
    lines = spark.createDataFrame([("// c",), ("",), ("  ",)] + [(f"{r}  trailing",) for r in rules] + [("COM",)], "value string")
    table = suffixes.rule_table(lines)
    assert table.count() == len(rules)
    got = {r.host: r.suffix for r in suffixes.host_suffixes(spark.createDataFrame([(h,) for h in hosts + hosts] + [(None,)], "host string"), table).collect()}
    assert got == {h: plain_suffix(h, rules) for h in hosts}
    sites = {r.host: (r.subdomain, r.domain) for r in suffixes.with_site(spark.createDataFrame([(f"http://{h}/",) for h in hosts if h], "url string"), table).collect()}
    assert sites["a.b.co.uk"] == ("a", "b") and sites["co.uk"] == (None, None) and sites["x.com"] == ("", "x") and sites["b.www.ck"] == ("b", "www")


def test_nearest_equals_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(300)] + [(400, [0.0] * 5), (401, None), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [1.0]), (7, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(5)
    queries = df.where("k % 20 = 0 or k = 7 or k > 399")
    good = [(k, np.array(v)) for k, v in rows if v and None not in v and len(v) == 5]
    for block in (4096, 3):
        got = sorted((r.query_id, r["rank"], r.k, r.score) for r in scoring.nearest(queries.where("k <> 403"), df, "k", "v", 6, block).collect())
        want = []
        for q, a in good:
            if q % 20 == 0 or q == 7 or q > 399:
                size = lambda b: np.sqrt(a @ a) * np.sqrt(b @ b)  # noqa: B023,E731
                all_ = sorted((-round(float(a @ b / size(b)) if size(b) else 0.0, 6) + 0.0, k) for k, b in good if k != q)
                want.append((q, [s for s, _ in all_]))
        for q, scores in want:
            mine = [-x[3] for x in got if x[0] == q]
            copies = sum(1 for k, _ in good if k == q)
            assert len(mine) == 6 if copies == 1 else len(mine) >= 6
            if copies == 1:
                assert np.allclose(mine, scores[:6], atol=2e-6)
