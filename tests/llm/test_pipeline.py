"""The corpus pipeline: each stage alone, and all of them."""

import random
import re

import pytest

from weftline.llm import near_dedup, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    sf = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-dedup", "decontamination", "sentencepiece"]
    rules, classifier, dedup, clean, encode = (f for _, f in corpus_pipeline.STAGES)
    kept = rules(spark, docs, sf)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert sum(labels[i] for i in labels if i not in left) < 0.05 * sum(labels.values())
    assert sum(1 - labels[i] for i in labels if i in left) <= 3
    assert classifier(spark, kept, sf).count() > 0.9 * len(left)
    copies = docs.limit(50).union(docs.limit(20)).withColumn("text", docs.text)
    once = dedup(spark, copies, sf)
    assert once.columns == docs.columns and once.count() == once.select("doc_id").distinct().count() <= 50
    planted = docs.limit(3).selectExpr("doc_id", "concat(text, ' ', '" + texts[0].replace("'", "\\'") + "') as text", "lang", "source", "n_chars")
    assert clean(spark, planted, sf).count() == 0
    whole = [r.doc_id for r in clean(spark, docs, sf).collect()]
    assert sorted(set(r.doc_id for r in docs.collect()) - set(whole)) == sorted({r.doc_id for r in docs.collect() if any(t in r.text for t in texts)})
    assert encode(spark, docs.limit(5), sf).count() >= 5


def test_run_and_nulls(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).where("round_trip").count() > 100
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, small).count()
        stage(spark, odd.limit(0), small).count()


def test_stage_values_on_odd_rows(spark, small):
    """Each stage on null, empty, repeated, copied, contaminated and very long rows: which of them stay."""
    sf = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules, classifier, dedup, clean, encode = (f for _, f in corpus_pipeline.STAGES)
    good = [r.text for r in classifier(spark, rules(spark, docs, sf), sf).where("n_chars between 1500 and 4000 and lang = 'en'").orderBy("doc_id").limit(40).collect()]
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    long = "\n".join(good[3:]) + "\n" + "\n".join(f"{k} {t}" for k, t in enumerate(good[3:]))
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 30), (10, good[0]), (10, good[0]), (11, good[0]), (12, f"{good[1]} {passage}"), (13, long * 20), (None, good[2])]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    kept = ids(rules(spark, docs.unionByName(odd), sf).join(odd.select("doc_id", "text"), ["doc_id", "text"], "left_semi"))
    assert kept.count(10) == 2 and 11 in kept and not {1, 2, 13} & set(kept)  # a text repeated twenty times over fails its rules
    assert ids(dedup(spark, odd, sf)) == [1, 10, 12, 13, 2, None]
    assert ids(clean(spark, odd, sf)) == [1, 1, 10, 10, 11, 13, 2, None, None]
    scored = ids(classifier(spark, odd, sf))
    assert scored.count(10) in (0, 2) and (10 in scored) == (11 in scored) and scored.count(1) in (0, 2)
    pieces = encode(spark, odd, sf).collect()
    assert all(r.round_trip for r in pieces) and sorted({str(r.doc_id) for r in pieces}) == ["1", "10", "11", "12", "13", "2", "None"]
    assert [r.n_tokens for r in pieces if r.doc_id == 1] == [0, 0] and sum(r.doc_id == 13 for r in pieces) > 10
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0


def slow_jaccard_classes(texts):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))})
    low = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b) and low[i] != low[j]:
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    return low


@pytest.mark.parametrize("rounds, block_members, bits", [(0, 512, 27), (0, 3, 27), (1, 3, 6), (2, 512, 27)])
def test_near_dedup_by_brute_force(spark, rounds, block_members, bits):
    r = random.Random(3)
    texts = [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d", "a b c d e f"]
    for _ in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([30, 120, 400]))]
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.1):
            texts.append(" ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in words))
        words = [words[0].upper(), *words[1:-2]]
        texts.append("\n".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs, near_dedup.NearDedupParams(rounds=rounds, block_members=block_members, bitmap_bits_log2=bits)).collect()}
    want = slow_jaccard_classes(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < 0.6 * len(texts)


def test_stage_drops_texts_of_similarity_80(spark, small):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[:at] + ["other"] + words[at + 1 :] if at else words) for at in (0, 50, 150, 250)] + [" ".join(words[60:] + words[:60][::-1])]
    far = [" ".join([*words[:200], *(f"v{i}" for i in range(100))])]
    many = [" ".join(f"y{i}" if i % 30 == 7 else w for i, w in enumerate(words))]  # 10 words of 300: similarity 0.71
    six = [" ".join(f"z{i}" if i % 50 == 7 else w for i, w in enumerate(words))]  # 6 words: similarity 0.82
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + far + many + six)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, small).collect())
    want = slow_jaccard_classes([r[1] for r in rows])
    assert kept == sorted(set(want)) and 7 not in kept and {0, 5, 6} <= set(kept)


def test_links_of_fingerprints_need_no_band(spark):
    """One band of all minima, which hardly any pair shares: what is found comes from the BK-trees."""
    r, texts = random.Random(8), []
    for _ in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words[:-12], *(f"x{r.randrange(10**6)}" for _ in range(12))])]
    p = near_dedup.NearDedupParams(bands=1, rows=128, least_agreed=0)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p).collect()}
    fps = [simhash.fingerprint(t, p.simhash) for t in texts]
    near = [k for k in range(0, len(texts), 2) if (fps[k] ^ fps[k + 1]).bit_count() <= 3]
    assert len(near) >= 10 and all(got[k] == got[k + 1] for k in near)
    far = [f"{t} tail" if k % 2 else t for k, t in enumerate(texts)]  # links are decided by whole sets
    strict = near_dedup.NearDedupParams(bands=1, rows=128, least_agreed=0, percent=100)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(far)), "doc_id long, text string"), strict)
    assert got.where("doc_id <> component_id").count() == 0
