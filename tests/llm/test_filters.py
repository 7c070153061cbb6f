"""Quality rules, quality classifier and decontamination against brute force, and their odd cases."""

import collections
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import decontaminate, mil_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "a b c", "x " * 40, "é ü ß\x0b日本\n" * 9, "one\r\ntwo\none\r\none\n\n \none ", "w" * 5000, " ".join(map(str, range(50))) + "\n" + " ".join(map(str, range(50)))]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def ratio_table(texts, good, p):
    size = 1 << p.buckets_log2
    raw, target = np.zeros(size), np.zeros(size)
    for t, g in zip(texts, good):
        for h in grams(t, p):
            raw[h] += 1
            target[h] += g
    a = p.smoothing
    return np.round((np.log((target + a) / (target.sum() + a * size)) - np.log((raw + a) / (raw.sum() + a * size))) * quality_rules.UNIT).astype(int)


def grams(text, p):
    b = (text or "").encode()
    return [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % 2**32) >> (32 - p.buckets_log2) for i in range(len(b) - 3)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#|日", max_size=120), min_size=1, max_size=6))
def test_rule_counts(texts):
    p = quality_rules.RuleParams()
    got = quality_rules.measure_column(pa.array(texts), np.zeros(1 << p.buckets_log2, np.int64), p)
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(t)


def test_rules_by_brute_force(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.op7_quality_rules(spark, small).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    p = quality_rules.RuleParams()
    table = ratio_table([t for _, t in rows], [i in good for i, _ in rows], p)
    assert len(got) == len(rows)
    for i, t in rows:
        r, c, h = got[i], counts(t), grams(t, p)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert r.base_failed == failed
        score = sum(int(table[x]) for x in h)
        assert r.kept == (not failed and score >= round(p.threshold * quality_rules.UNIT) * len(h))


def test_rules_odd_cases(spark):
    rows = [(i, t, i, "x", True) for i, t in enumerate(ODD)] + [(None, "no id", 1, "x", True), (4, "a b c", 1, "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, llr string, kept boolean")
    p = quality_rules.RuleParams()
    table = np.zeros(1 << p.buckets_log2, np.int64)
    got = quality_rules.quality_rules(docs, table).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), counts(t)[0]) for i, t, *_ in rows)
    assert quality_rules.keep_good(docs, table).columns == docs.columns
    assert quality_rules.keep_good(docs.limit(0), table).count() == 0
    none = spark.createDataFrame([], "doc_id long")
    assert not quality_rules.fit_ratio(docs, none).any()


def test_rules_do_not_depend_on_partitions(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    one, many = (quality_rules.fit_ratio(docs.repartition(n), quality_rules.trusted_labels(labels)) for n in (1, 9))
    assert (one == many).all()


def toy(r, good):
    words = "the of and river stone mountain water paper window garden letter".split()
    text = " ".join(r.choice(words, 150))
    if not good:
        at = int(r.integers(30, 90))
        parts = text.split()
        parts[at : at + 30] = [w.upper() + "!!" for w in parts[at : at + 30]]
        text = " ".join(parts)
    return text


def test_target_has_all_trusted_documents(spark):
    from pyspark.sql import functions as F

    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.md5(F.col("id").cast("string"))).alias("text"))
    assert not quality_rules.fit_ratio(docs, docs.select("doc_id")).any()  # both multinomials have every document


def test_target_in_blocks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = quality_rules.trusted_labels(spark.read.parquet(f"{small}/labels.parquet"))
    p = quality_rules.RuleParams(block_ids=3)
    rows, good = [(r.doc_id, r.text) for r in docs.limit(40).collect()], {r.doc_id for r in ids.collect()}
    some = spark.createDataFrame(rows, docs.select("doc_id", "text").schema)
    few = [i for i, _ in rows if i in good]
    got = quality_rules.fit_ratio(some, spark.createDataFrame([(i,) for i in few * 2 + [None]], "doc_id long"), p)
    assert len(few) > 2 * p.block_ids and (got == ratio_table([t for _, t in rows], [i in good for i, _ in rows], p)).all()


def test_classifier_learns_bad_passages(spark):
    r = np.random.default_rng(0)
    rows = [(i, toy(r, i % 3 > 0), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    model = mil_classifier.fit_mil(docs, labels.where(~mil_classifier.held_out()))
    got = {x.doc_id: x for x in mil_classifier.classify(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([(got[i].score >= 0.5) == y for i, y in held]) > 0.95
    assert all(x.predicted == (x.score >= 0.7) and 0 <= x.score <= 1 for x in got.values())


def test_classifier_on_labels(spark, small):
    sf = small.replace("0.001", "0.01")
    got = mil_classifier.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([(r.score >= 0.7) == r.quality for r in got]) > 0.9


def test_classifier_gradients():
    p = mil_classifier.MilParams(hidden=3, attention=2)
    r = np.random.default_rng(1)
    model = mil_classifier.MilModel(4, p)
    for k in ("c", "b"):
        model.weights[k] = r.normal(size=3)
    x, passages, y, w = r.normal(size=(5, 4)), np.array([2, 3]), np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        q = model._forward(x, passages)["p"]
        return -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).mean()

    grads = model._gradients(x, passages, y, w)
    for k, v in model.weights.items():
        for at in np.ndindex(v.shape):
            keep = v[at]
            v[at] = keep + 1e-5
            up = loss()
            v[at] = keep - 1e-5
            down = loss()
            v[at] = keep
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_classifier_passes_over_a_text_that_is_too_long(spark):
    """The labelled text of smallest hash is 3 million words long: it is left out of the fit, and the others are learned from."""
    r = np.random.default_rng(0)
    rows = [(i, toy(r, i % 3 > 0), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    first = docs.join(labels, "doc_id").where("label = 1").orderBy(F.xxhash64("doc_id", F.lit(mil_classifier.MilParams().seed)), "doc_id").first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("good words here "), 1_000_000)).otherwise(F.col("text")))
    got = [x.score for x in mil_classifier.classify(long, mil_classifier.fit_mil(long, labels)).collect()]
    assert len(got) == 600 and np.std(got) > 0.2
    with pytest.warns(UserWarning, match="few enough passages"):
        mil_classifier.fit_mil(docs, labels, mil_classifier.MilParams(fit_passages=1))
    sizes = pd.DataFrame({"_id": [5, 7, 8, 9], "n": [4, 9, 3, 2]})
    assert mil_classifier._fitting(sizes, 7) == [(5, 4), (8, 3)]


def slow_score(model, text):
    """The network's score of one text, passage by passage in plain loops."""
    data = text.encode()
    x, passages = mil_classifier.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]), model.params)
    q = model.weights
    scaled = np.clip((x - model.shift) / model.scale, -6, 6)
    hidden = [np.tanh([sum(row[i] * q["W"][i][k] for i in range(len(row))) + q["b"][k] for k in range(model.params.hidden)]) for row in scaled]
    energy = [sum(np.tanh(h @ q["V"])[k] / (1 + np.exp(-(h @ q["U"])[k])) * q["w"][k] for k in range(model.params.attention)) for h in hidden]
    weight = np.exp(energy) / np.exp(energy).sum()
    pooled = sum(a * h for a, h in zip(weight, hidden))
    return passages, 1 / (1 + np.exp(-(pooled @ q["c"] + q["d"][0])))


def test_classifier_scores_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = mil_classifier.fit_mil(docs, mil_classifier.training_labels(spark.read.parquet(f"{small}/labels.parquet")))
    got = {r.doc_id: r.score for r in mil_classifier.classify(docs, model).collect()}
    for r in docs.limit(25).collect():
        assert got[r.doc_id] == pytest.approx(slow_score(model, r.text)[1], abs=1e-5)


def test_classifier_odd_cases(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, "x", 0.1), (0, None, 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, label int")
    model = mil_classifier.fit_mil(docs, labels)
    got = mil_classifier.classify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert mil_classifier.keep_predicted(docs, model).columns == docs.columns
    empty = mil_classifier.fit_mil(docs.limit(0), labels.limit(0))
    assert mil_classifier.classify(docs.limit(0), empty).count() == 0
    x, passages = mil_classifier.features(np.frombuffer(b"a " * 200, np.uint8), np.array([0, 400]), model.params)
    assert len(x) == passages[0] == 4 and (mil_classifier.features(np.zeros(0, np.uint8), np.array([0, 0]), model.params)[0] == 0).all()


def normal(text):
    return re.sub(rb"[ \t-\r]+", b" ", (text or "").encode()).lower()


def least_distance(item, text):
    """Least edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_by_brute_force():
    r = np.random.default_rng(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    items = [(k, " ".join(r.choice(words, int(r.integers(8, 16))))) for k in range(12)]
    docs = []
    for k in range(60):
        text = list(items[k % 12][1]) if k % 2 else list(" ".join(r.choice(words, 12)))
        for _ in range(int(r.integers(0, 9))):
            at = int(r.integers(len(text)))
            text[at : at + 1] = [[], ["z"], ["q", text[at]]][int(r.integers(3))]
        docs.append(" ".join(r.choice(words, 10)) + " " + "".join(text) + "  \n" + " ".join(r.choice(words, 10)))
    index = decontaminate.GramIndex(items, decontaminate.LemmaParams())
    found = decontaminate.find_column(index, pa.array(docs))
    got = {(d, i): c for d, i, _, _, c in found}
    for d, text in enumerate(docs):
        for k, (i, item) in enumerate(items):
            least = least_distance(normal(item), normal(text))
            if least <= index.budget[k]:
                assert got.pop((d, i)) == least
    assert not got


def test_decontamination_spans_and_odd_cases(spark):
    item = "Benchmark passage number one, with some words to be found again in a document."
    docs = spark.createDataFrame([(1, f"é {item.upper()} tail", "x"), (2, None, "x"), (3, "", "x"), (None, f"a\n{item}", "x"), (1, item.replace(" ", "\n \t"), "x"), (5, "short", "x")], "doc_id long, text string, distance string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.match_start, r.match_end, r.distance) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 7, 2, 2 + len(item), 0), (None, 7, 2, 2 + len(item), 0), (1, 7, 0, len(item.replace(" ", "\n \t")), 0), (5, 10, 0, 5, 0)], key=str)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), bench).count() == 0
    blocks = decontaminate.contamination(docs, bench, decontaminate.LemmaParams(block_bytes=1))
    assert blocks.count() == 4


def test_decontamination_of_periodic_text():
    """A megabyte of one repeated word against an item of it: bounded memory, and finds that tile the text."""
    import tracemalloc

    index = decontaminate.GramIndex([(1, "ha " * 40)], decontaminate.LemmaParams())
    tracemalloc.start()
    found = index.find(*_one(("ha " * 350_000).encode()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20 and len(found) > 1000
    spans = sorted(x[2:4] for x in found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def _one(raw):
    import numpy as np

    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


def test_decontamination_slices_do_not_matter():
    import random

    r = random.Random(1)
    words = [f"w{r.randrange(40)}" for _ in range(4000)]
    items = [(k, " ".join(words[k * 50 : k * 50 + 25])) for k in range(20)]
    texts = (" ".join(words) + " ha ha" * 100).encode()
    want = decontaminate.GramIndex(items, decontaminate.LemmaParams()).find(*_one(texts))
    got = decontaminate.GramIndex(items, decontaminate.LemmaParams(hits=7)).find(*_one(texts))
    assert got == want and len({x[1] for x in want}) == 20


def test_short_items_are_reported_not_dropped(spark):
    docs = spark.createDataFrame([(1, "yes it is"), (2, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " yes "), (8, ""), (9, None), (10, "long enough item")], "item_id long, text string")
    assert [r.item_id for r in decontaminate.short_items(items).collect()] == [7]
    assert decontaminate.drop_contaminated(docs, items).count() == 2
    assert [(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items).collect()] == [(1, 7)]


def test_decontamination_query_by_brute_force(spark, small):
    """The query on whole texts: every item that stands in a text is found there."""
    from oracle import connect

    got = {(r.doc_id, r.item_id) for r in decontaminate.op9_decontamination(spark, small).collect()}
    con = connect(small)
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[ \\t-\\r]+', ' ', 'g'))"
    want = {tuple(r) for r in con.execute(f"select doc_id, item_id from documents d, benchmark b where length(b.text) > 20 and contains({norm('d.text')}, {norm('b.text')})").fetchall()}
    assert want and want <= got
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    items = dict(con.execute("select item_id, text from benchmark").fetchall())
    for doc, item in got:  # what is found is near: most of the item's words stand in the text
        words = items[item].lower().split()
        assert sum(w in texts[doc].lower() for w in words) >= 0.7 * len(words)


def test_word_hashes_tell_thue_morse_lines_apart():
    import numpy as np

    from weftline.llm.common import span_hashes

    t = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint8) + 97
    data = np.concatenate((t, 195 - t))
    a, b = span_hashes(data, np.array([0, 4096]), np.array([4096, 8192]))
    assert a != b


def test_gram_hashes():
    d = np.frombuffer(b"abcabcabcabcxyz", np.uint8)
    for q in (1, 2, 3, 7, 10, 15):
        h = decontaminate.gram_hashes(d, q)
        assert len(h) == len(d) - q + 1
        assert len(set(h.tolist())) == len({bytes(d[i : i + q]) for i in range(len(h))})
