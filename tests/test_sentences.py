import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from weftline.operators import sentences as s
from weftline.plans import queries_more, queries_scores
from weftline.plans.catalogue import ORACLE_SQL


def corpus():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("lo", "mir", "tan", "ver", "sel") for b in ("a", "e", "i") for c in ("dro", "nt", "sk", "m", "l")]
    out = []
    for _ in range(400):
        text = []
        for _ in range(rng.randrange(3, 9)):
            body = [rng.choice(words) for _ in range(rng.randrange(4, 10))]
            k = rng.randrange(1, len(body))
            if rng.random() < 0.4:
                body.insert(k, rng.choice(["dr.", "e.g.", "approx."]))
            if rng.random() < 0.3:
                body.insert(0, "however")
            text.append(" ".join([body[0].capitalize(), *body[1:]]) + rng.choice([".", ".", ".", "?", "!"]))
        out.append(" ".join(text))
    return out


def test_planted_abbreviations_are_learned_and_not_split(spark):
    texts = corpus()
    learned = s.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    assert {"dr", "e.g", "approx"} <= learned.abbreviations and len(learned.abbreviations) == 3
    assert "however" in learned.starters
    for text in texts:
        found = s.split(text, learned)
        want = sum(text.count(m) for m in ".?!") - text.count("dr.") - 2 * text.count("e.g.") - text.count("approx.")
        assert len(found) == want and " ".join(found) == text


def plain_counts(texts):
    out = Counter()
    for text in texts:
        before, stopped = "", True
        for token in (text or "").split():
            word = token.rstrip("\"'”’»)]}")
            stop = word.endswith(".") and not word.endswith("..")
            bare = s.type_of(word)
            bare = bare[:-1] if stop and bare.endswith(".") else bare
            if not bare:
                continue
            out["stop" if stop else "plain", bare, ""] += 1
            first = token.lstrip("\"'“”‘’«»()[]{},;:")[:1]
            if first.islower():
                out["lower", bare, ""] += 1
            elif first.isupper() and not stopped:
                out["upper", bare, ""] += 1
            if before:
                out["pair", before, bare] += 1
            before, stopped = (bare if stop else ""), word[-1:] in (".", "!", "?", "。", "！", "？")
    return out


def test_counts_and_scores_equal_plain(spark):
    texts = [*corpus()[:50], None, "", "3.5 is 12. and x... (see Dr. No) “end.” 7 . ."]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = s.type_counts(df, s.SentenceParams(held_types=5))
    got = {(r.kind, r.a, r.b): r.n for r in counts.collect()}
    want = plain_counts(texts)
    assert got == dict(want)
    stops = sum(n for (k, _, _), n in want.items() if k == "stop")
    total = stops + sum(n for (k, _, _), n in want.items() if k == "plain")
    for r in s.scored_types(counts).collect():
        k, n = want["stop", r.type, ""], want["stop", r.type, ""] + want["plain", r.type, ""]
        like = lambda p: k * math.log(p) + (n - k) * math.log(1 - p)  # noqa: B023,E731
        letters = len(r.type) - r.type.count(".")
        score = -2 * (like(stops / total) - like(0.99)) * math.exp(-letters) * (r.type.count(".") + 1) * letters ** -(n - k)
        assert math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-12)


def test_rules():
    known = s.Learned({"dr", "etc"}, {("##number##", "mai")}, {"the"}, {"the"}, set())
    assert s.split("Dr. No came. He met J. Smith etc. The end.", known) == ["Dr. No came.", "He met J. Smith etc.", "The end."]
    assert s.split("Am 3. Mai kam er. Am 4. juni nicht. Version 2.5 gilt.", known) == ["Am 3. Mai kam er.", "Am 4. juni nicht.", "Version 2.5 gilt."]
    assert s.split('He said "Stop." Then left! (Why?) "Who knows."', known) == ['He said "Stop."', "Then left!", "(Why?)", '"Who knows."']
    assert s.split("今天很好。我们走吧！好吗？是", known) == ["今天很好。", "我们走吧！", "好吗？", "是"]
    assert s.split(None, known) == [] and s.split(" \n ", known) == [] and s.split("no end", known) == ["no end"]
    assert s.split("Wait... what? Yes...", known) == ["Wait...", "what?", "Yes..."]


def test_query(spark, small):
    rows = queries_more.learned_sentences(spark, small)
    assert rows.columns == ["doc_id", "place", "sentence"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    join = lambda c: F.regexp_replace(c, r"\s+", "")
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("t"))
    assert docs.join(whole, "doc_id").where(F.regexp_replace(join("text"), r"[\x{85}\x{a0}\x1c-\x1f]", "") != F.regexp_replace(join("t"), r"[\x{85}\x{a0}\x1c-\x1f]", "")).count() == 0


def test_text_sentences_with_digits_and_blanks_at_the_end(spark, tmp_path):
    texts = ["a. ", "0. 1. 2. 3", "x. " * 3 + "3", " . . ", "a. ", "　", "a.\n", "。b", "...", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_sentences for r in queries_scores.text_sentences(spark, str(tmp_path)).collect()}
    sql = ORACLE_SQL["text_sentences"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(duckdb.sql(sql).fetchall())
    assert [got[i] for i in range(4)] == [1, 4, 4, 2]


def test_split_looks_only_at_words_with_marks(monkeypatch):
    seen = []
    plain = s._END.search
    monkeypatch.setattr(s, "_END", type("End", (), {"search": staticmethod(lambda *a: seen.append(a[0]) or plain(*a))}))
    known = s.Learned({"dr"}, set(), {"the"}, {"the"}, set())
    assert s.split("one  two\x1cthree. \n Dr. No (why?) 3.5 x\t“end.” .. 好。吗 z", known) == ["one  two\x1cthree.", "Dr. No (why?)", "3.5 x\t“end.”", "..", "好。", "吗 z"]
    assert seen == ["three.", "Dr.", "(why?)", "3.5", "“end.”", "..", "好。吗"]
    words = []
    monkeypatch.setattr(s, "_TOKEN", type("Token", (), {"search": staticmethod(lambda *a: words.append(a) or re.search(r"\S+", a[0][a[1] :]))}))
    assert s.split("a b c d e foot. g", known) == ["a b c d e foot.", "g"] and len(words) == 1  # once a full stop, not once a word
