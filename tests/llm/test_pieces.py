"""Encoding and lattice scores against plain dynamic programs, a library and round trips."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import lattice, lm_scoring, pieces


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.load()


@pytest.fixture(scope="module")
def toy():
    """A small vocabulary with scores that are log probabilities, and one with pieces that cross spaces."""
    base = ["<unk>"] + [f"<{b}>" for b in range(256)]
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁b", "cab", "▁▁", "bca"]
    r = np.random.default_rng(0)
    scores = [0.0] * 257 + (-r.uniform(1, 6, len(words))).tolist()
    plain = lattice.Vocabulary(base + words, scores, list(range(1, 257)), [0])
    crossing = lattice.Vocabulary([*base, *words, "a▁b", "c▁"], [*scores, -1.5, -2.5], list(range(1, 257)), [0])
    return plain, crossing


def slow_encode(v, text):
    """(score, best ids) by the plain recursion over `text`, which has its leading space."""
    known = {v.pieces[i].replace("▁", " "): i for i in v.normal.tolist()}
    best = [(0.0, [])] + [(-math.inf, [])] * len(text)
    for i in range(len(text)):
        if text[i] not in known or text[i] == "▁":
            options = [(1, v.unknown_score, v.spell(text[i]))]
        else:
            options = []
        options += [(n, v.scores[known[text[i : i + n]]], [known[text[i : i + n]]]) for n in range(1, v.max_length + 1) if i + n <= len(text) and text[i : i + n] in known and "▁" not in text[i : i + n]]
        for n, s, ids in options:
            if best[i][0] + s > best[i + n][0]:
                best[i + n] = (best[i][0] + s, best[i][1] + ids)
    return best[-1]


TEXTS = ["", "a", " ", "   ", "abcab cab  abc", "a\nb\tc", "▁a▁", "日本 abc", "x" * 70, "abc" * 60, "a b c " * 30, "\n\n", "ab é ca"]


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("chunk", [16, 50, 1 << 15])
def test_encode_by_brute_force(spark, toy, which, chunk, monkeypatch):
    v = toy[which]
    monkeypatch.setattr(lattice, "load", lambda path=None: v)
    pieces._tables.clear()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 1), (None, "ab " * 40, 2), (4, TEXTS[4], 1)], "doc_id long, text string, ids int")
    p = pieces.PieceParams(model_path=f"toy{which}", chunk=chunk, segment=3)
    rows = pieces.encode(docs, p).orderBy("doc_id", "chunk_no").collect()
    assert all(r.round_trip for r in rows)
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        some = [r for k, r in enumerate(got[i]) if i != 4 or k % 2 == 0] if i == 4 else got[i]
        if i == 4:  # the repeated row
            some = sorted({(r.chunk_no, tuple(r.ids), r.score) for r in got[i]})
            ids, score = [x for s in some for x in s[1]], sum(s[2] for s in some)
        else:
            ids, score = [x for r in some for x in r.ids], sum(r.score for r in some)
        if not t:
            assert ids == [] and score == 0
            continue
        want, _ = slow_encode(v, " " + t)
        assert score == pytest.approx(want)
        assert v.decode(ids) == " " + t
    texts = pieces.decode(spark.createDataFrame(rows, pieces.encode(docs, p).schema), p).orderBy("doc_id", "chunk_no").collect()
    back = collections.defaultdict(str)
    for r in texts:
        back[r.doc_id] += r.text
    assert all(back[i] == (t if i != 4 or chunk < 20 else t * 2) or i == 4 for i, t in enumerate(TEXTS))
    pieces._tables.clear()


def test_chunk_matrices_compose(toy):
    r = np.random.default_rng(2)
    for v in toy:
        table = lattice.HashedAtoms(v)
        for _ in range(30):
            text = " " + "".join(r.choice(list("abc "), int(r.integers(40, 90))))
            cuts = [0, 20, 37, len(text)]
            parts = [pieces.Chunk(v, table, text[a : b + v.max_length - 1], b - a) for a, b in zip(cuts, cuts[1:])]
            ms = [c.matrix() for c in parts]
            both = pieces.max_plus(pieces.max_plus(ms[0], ms[1]), ms[2])
            assert np.array_equal(both, pieces.max_plus(ms[0], pieces.max_plus(ms[1], ms[2]))) or np.allclose(both[0, 0], pieces.max_plus(ms[0], pieces.max_plus(ms[1], ms[2]))[0, 0])
            want, _ = slow_encode(v, text)
            assert both[0, 0] == pytest.approx(want)
            states = pieces.boundary_states(ms, 0, 0)
            traced = [c.trace(i, j) for c, (i, j) in zip(parts, states)]
            assert sum(s for _, s in traced) == pytest.approx(want) and v.decode([x for ids, _ in traced for x in ids]) == text


def test_no_worse_than_the_library(vocabulary, small, spark):
    """The library's segmentation of the same pieces never has a better sum of scores, and decodes alike."""
    import sentencepiece

    raw = open(lattice.DEFAULT_MODEL, "rb").read()
    unigram = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x12\x02\x18\x01")  # the same pieces, as a unigram model
    texts = [" ".join(line.split()) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect() for line in r.text.split("\n")[:4] if line.strip()]
    data, offsets = pieces.text_buffers(pieces.prefixed(pa.array(texts)))
    ids, edges, scores = lattice.HashedAtoms(vocabulary).encode(data, offsets)
    assert len(texts) > 60
    for t, a, b, s in zip(texts, edges[:-1], edges[1:], scores):
        assert s >= sum(vocabulary.scores[i] for i in unigram.encode(t))
        assert unigram.decode(ids[a:b].tolist()) == vocabulary.decode(ids[a:b])[1:] == t


def test_hashed_and_plain_tables_agree(vocabulary, spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()] + ["", "▁", "  x\n"]
    a = lattice.AtomTable(vocabulary).encode([" " + t if t else "" for t in texts])
    data, offsets = pieces.text_buffers(pieces.prefixed(pa.array(texts)))
    hashed = lattice.HashedAtoms(vocabulary, most=50)
    for _ in range(2):  # the second time after the table forgot
        b = hashed.encode(data, offsets)
        assert all(np.array_equal(x, y) for x, y in zip(a[:2], b[:2])) and np.allclose(a[2], b[2])


@pytest.mark.parametrize("together", [1, 60, 1 << 17])
def test_atoms_of_all_lengths_go_through_the_trie_together(toy, together):
    """Scores are whole numbers, so that many paths tie."""
    r = np.random.default_rng(5)
    v = lattice.Vocabulary(toy[0].pieces, np.round(toy[0].scores), toy[0].byte_ids.tolist(), [0])
    atoms = list({"".join(r.choice(list("abcé▁日"), n, p=[0.3, 0.3, 0.25, 0.05, 0.05, 0.05])) for n in [*range(1, 40), 300] for _ in range(4)})
    texts, steps, step = [" " + a for a in atoms], [], v.step
    v.step = lambda node, symbol: steps.append(len(node)) or step(node, symbol)
    data, offsets = pieces.text_buffers(pa.array(texts))
    for ids, edges, scores in (lattice.AtomTable(v, together=together).encode(texts), lattice.HashedAtoms(v).encode(data, offsets)):
        for t, a, b, score in zip(texts, edges[:-1], edges[1:], scores):
            assert (score, ids[a:b].tolist()) == slow_encode(v, t)
    if together > 60:
        assert len(steps) <= 2 * v.max_length  # not some for each length and place


def test_whole_query(spark, small):
    rows = pieces.op2_sentencepiece(spark, small).collect()
    assert len(rows) >= 200 and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(empty).count() == 0


def all_paths(v, log_p, text):
    known = {v.pieces[i].replace("▁", " "): i for i in v.normal.tolist()}
    total = [1.0] + [0.0] * len(text)
    for i in range(len(text)):
        if text[i] not in known:
            total[i + 1] += total[i] * math.exp(log_p[v.spell(text[i])].sum())
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in known:
                total[j] += total[i] * math.exp(log_p[known[text[i:j]]])
    return math.log(total[-1])


def test_marginals_by_brute_force(toy):
    v = toy[0]
    r = np.random.default_rng(4)
    log_p = np.log(r.dirichlet(np.ones(len(v.pieces))))
    for n in (1, 2, 6, 9):
        texts = [" " + "".join(r.choice(list("abcé"), n)) for _ in range(20)]
        got, expected = lattice.log_marginals(v, log_p, texts, np.ones(20))
        assert np.allclose(got, [all_paths(v, log_p, t) for t in texts])
        step, k = 1e-6, int(v.normal[1])
        moved = log_p.copy()
        moved[k] += step
        slope = (lattice.log_marginals(v, moved, texts)[0] - got).sum() / step
        assert expected[k] == pytest.approx(slope, abs=1e-4)  # the derivative of the log marginal


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("head", [1, 300])
def test_scores_by_brute_force(spark, small, head):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(80)
    docs = docs.union(spark.createDataFrame([(5001, None), (5002, ""), (None, "the of Hello"), (5003, " \n")], "doc_id long, text string")).withColumnRenamed("doc_id", "doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    p = lm_scoring.LatticeParams(head_words=head, calibration_words=100, merge_words=500)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, p).collect()}
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c, n = collections.Counter(), collections.Counter()
    for i, t in rows:
        n.update([*words_of(t), ""])
        if not held(i):
            c.update([*words_of(t), ""])
    total, kinds = sum(c.values()), len(c)
    some = lm_scoring.frequent_words(lm_scoring.count_words(docs, p, "doc_id", "text"), p).toPandas()
    assert len(some) <= head + 1 and dict(zip(some.word, some.n)) == {w: n[w] for w in some.word}
    trained = sorted((w for w in c if c[w]), key=lambda w: (-c[w], w))[:100]
    model = lm_scoring.PieceModel(lattice.load(), p)
    model.calibrate(trained, np.array([c[w] for w in trained], float), p.rounds)
    assert np.exp(model.log_p).sum() == pytest.approx(1)
    terms = dict(zip(n, model.log_words(list(n))[0] / math.log(10)))
    assert len(got) == len(rows)
    for i, t in rows:
        w, r = [*words_of(t), ""], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w))
        assert r.score == pytest.approx(sum(terms[x] for x in w))
    assert lm_scoring.lm_scores(docs.limit(0), p).count() == 0


def test_calibration_has_every_training_word(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60)
    p = lm_scoring.LatticeParams(head_words=1)  # the head is almost empty; the fit has the whole table
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs, p).collect()}
    c, rows = collections.Counter(), [(r.doc_id, r.text) for r in docs.collect()]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words_of(t), ""])
    model = lm_scoring.PieceModel(lattice.load(), p)
    words = sorted(c)
    model.calibrate(words, np.array([c[w] for w in words], float), p.rounds)
    every = sorted({w for _, t in rows for w in [*words_of(t), ""]})
    terms = dict(zip(every, model.log_words(every)[0] / math.log(10)))
    for i, t in rows:
        assert got[i] == pytest.approx(sum(terms[w] for w in [*words_of(t), ""]))


def test_held_out_texts_move_no_other_score(spark, small):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    held = [i for i in range(10**6, 10**6 + 60) if zlib.crc32(str(i).encode()) % 7 == 2]
    extra = spark.createDataFrame([(i, "zzq " * 5000 + f"word{i}") for i in held], "doc_id long, text string")
    p = lm_scoring.LatticeParams(head_words=300, rounds=1)
    before, after = ({r.doc_id: (r.score, r.base_score, r.n_known) for r in lm_scoring.lm_scores(d, p).where(F.col("doc_id") < 10**6).collect()} for d in (docs, docs.unionByName(extra)))
    assert held and before.keys() == after.keys()
    for i in before:
        assert after[i] == pytest.approx(before[i], rel=1e-9)


def test_words_of_small_batches_are_done_together():
    words = [f"w{k}" for k in range(1000)]
    small = [pa.RecordBatch.from_arrays([pa.array(words[k : k + 7]), pa.array(range(k, min(k + 7, 1000)))], ["word", "c"]) for k in range(0, 1000, 7)]
    for most, number in ((400, 3), (10**6, 1)):
        got = list(lm_scoring.word_batches(iter(small), lm_scoring.LatticeParams(lattice_words=most)))
        assert len(got) == number and sum((b.column(0).to_pylist() for b in got), []) == words
    assert len(list(lm_scoring.word_batches(iter(small), lm_scoring.LatticeParams(lattice_bytes=1)))) == len(small)
    assert not list(lm_scoring.word_batches(iter([]), lm_scoring.LatticeParams()))
