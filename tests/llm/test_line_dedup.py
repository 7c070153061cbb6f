import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from weftline.llm import line_dedup as ld

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"
NO_BROADCAST = ld.LineParams(min_docs=3, shard_keys=2, broadcast_bytes=0, salts=3)


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    return k if len(k) >= 20 else None


def plain(held, docs):
    where = defaultdict(set)
    for doc_id, text in held:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                where[key(line)].add(doc_id)
    keeper = {k: max(i for i in ids if i is not None) for k, ids in where.items() if len(ids) >= 3}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def made():
    rng = random.Random(5)
    lines = [f"{'Common line of the corpus' if k % 2 else 'ÄÖ common line'} number {k:02d}" for k in range(40)] + ["short", "", "twenty code points ö!", "nineteen points ö !", "\x1fnot white space here"]
    docs = [(i, "\n".join(rng.choice(["  {}", "{}\t\r", "{}", "{} "]).format(rng.choice(lines)) if rng.random() < 0.8 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(9)))) for i in range(120)]
    hot = "A line that very many documents hold, Again"
    docs += [(i, f"{hot}\n{hot.lower()}\nrest {i}") for i in range(200, 320)]
    return docs + [(None, f"{hot}\n" * 3), (None, hot), (500, None), (501, ""), (502, "\n"), (503, hot + "\n" + "x" * 500_000), (504, hot)] + docs[:5]


@pytest.fixture(params=[ld.LineParams(), NO_BROADCAST], ids=["broadcast", "routed"])
def p(request):
    return request.param


def test_equals_sql(spark, small):
    check(spark, small, ld.op12_line_dedup, ld.ORACLE)


def test_insert_delete_and_back(spark, tmp_path, p):
    docs = made()
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("hi", F.lit(1)).repartition(4)
    index = ld.LineIndex(spark, f"file://{tmp_path}/i", p)
    first = [x for x in docs if x[0] is None or x[0] % 2 == 0]
    second = [x for x in docs if x not in first]
    index.insert(frame(first))
    assert result(index.clean(frame(docs))) == plain(first, docs)
    before = sorted(index.counts().collect())
    index.insert(frame(second))
    assert result(index.clean(frame(docs))) == plain(docs, docs)
    index.insert(frame(second[:30]))  # again: nothing changes
    assert result(index.clean(frame(docs))) == plain(docs, docs)
    index.delete(frame(second + [(9999, "")]).select("doc_id"))
    assert sorted(index.counts().collect()) == before
    assert result(index.clean(frame(docs))) == plain(first, docs)
    index.delete(frame([x for x in first if x[0] in (318, 504, 0, None)]).select("doc_id"))  # also keepers
    left = [x for x in first if x[0] not in (318, 504, 0, None)]
    assert result(index.clean(frame(docs))) == plain(left, docs)
    common = {(r["hi"], r["lo"]) for r in index.common().collect()}
    filters = ld.ShardedFilters(index.bits, {r["shard"]: r["slots"] for r in index.filters().collect()})
    hi, lo = (np.array([k[i] for k in sorted(common)], np.int64) for i in (0, 1))
    assert filters.hits(hi, lo).all()


def test_empty_table(spark, tmp_path, p):
    index = ld.LineIndex(spark, f"file://{tmp_path}/i", p)
    index.insert(spark.createDataFrame([], SCHEMA))
    assert index.clean(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 5000, dtype=np.int64)
    made = ld.CuckooFilter.of(keys)
    look = lambda f, k: ld.ShardedFilters(0, {0: f.to_bytes()}).hits(k, k)
    assert look(made, keys).all()
    assert look(made, rng.integers(-(2**63), 2**63, 100_000, dtype=np.int64)).mean() < 0.001
    assert all(made.delete(k) for k in keys[:2500].tolist())
    assert look(made, keys[2500:]).all() and look(made, keys[:2500]).mean() < 0.01
    assert all(made.delete(k) for k in keys[2500:].tolist()) and not any(made.slots)
    small = ld.CuckooFilter(np.zeros(16, np.uint16))
    assert not all(small.insert(k) for k in keys[:40].tolist())
