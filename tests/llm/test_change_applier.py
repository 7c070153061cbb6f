import datetime
import math
import zlib
from collections import defaultdict

import pytest

from weftline.llm.change_applier import ApplierParams, PagedBucket, apply_changes, numbered, op13_change_applier

COLUMNS = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"


def first(x):
    return (x is not None, x if x is not None else 0)


def plain(rows, batches=12, first_day=19723, span=160, patience=3):
    """The contract, a client and a row at a time."""
    rows = set(rows)
    ranks = defaultdict(set)
    for r in rows:
        ranks[r[1]].add(r[2])
    rank = {c: {s: k + 1 for k, s in enumerate(sorted(seqs, key=first))} for c, seqs in ranks.items()}
    arrived = defaultdict(list)
    top = {}
    for change_id, client, seq, op, at, _, _, city, balance in rows:
        if change_id is None or at is None or (h := zlib.crc32(str(change_id).encode())) % 11 == 0:
            continue
        day = (at.date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
        b = min(batches, 1 + math.floor((day - first_day) * batches / span))
        arrived[client, b].append((day, change_id, first(op), first(city), first(balance), rank[client][seq], op, city, balance))
        top[b] = max(top.get(b, 0), day)
    clients = {c: {"next": 1, "held": {}, "city": None, "balance": None, "last": None} for c, _ in arrived}
    out = {}

    def cascade(c, b, missed):
        s = clients[c]
        while s["next"] in s["held"]:
            _, change_id, op, city, balance = s["held"].pop(s["next"])
            if op == "D":
                s["city"] = s["balance"] = None
            elif op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"], s["balance"] = s["city"] if city is None else city, s["balance"] if balance is None else balance
            out[change_id, c, s["next"]] = [change_id, c, "applied", b, missed, s["city"], None if s["balance"] is None else math.floor(100 * s["balance"] + 0.5), False]
            s["last"] = (change_id, c, s["next"], op)
            s["next"], missed = s["next"] + 1, 0

    rejected = []
    for b in range(1, batches + 2):
        largest = max((v for k, v in top.items() if k < b), default=None)
        for c, s in clients.items():
            while s["held"] and (b > batches or largest is not None and min(d for d, *_ in s["held"].values()) + patience <= largest):
                n = min(s["held"])
                gap, s["next"] = n - s["next"], n
                cascade(c, b, gap)
            for day, change_id, _, _, _, n, op, city, balance in sorted(arrived.get((c, b), ())):
                if n in s["held"] or n < s["next"]:
                    rejected.append([change_id, c, "rejected", b, 0, None, None, False])
                else:
                    s["held"][n] = (day, change_id, op, city, balance)
                    cascade(c, b, 0)
    for s in clients.values():
        if s["last"] and s["last"][3] != "D":
            out[s["last"][:3]][7] = True
    return sorted([*out.values(), *rejected], key=repr)


def result(df):
    return sorted([list(r) for r in df.select(*COLUMNS).collect()], key=repr)


def test_whole_table_equals_plain(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/client_changes.parquet").collect()]
    want = plain(rows)
    assert {r[2] for r in want} == {"applied", "rejected"} and any(r[4] for r in want) and any(r[3] == 13 for r in want)
    assert result(op13_change_applier(spark, small)) == want


def test_numbers_are_dense_ranks_whatever_the_partitions(spark, small):
    table = spark.read.parquet(f"{small}/client_changes.parquet")
    table.createOrReplaceTempView("client_changes_n")
    want = spark.sql("select *, dense_rank() over (partition by client_id order by seq) n from (select distinct * from client_changes_n)")
    got = numbered(table.repartition(7))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def day(k, hour=1):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=k)


def row(change_id, client, seq, at, op="U", city="x", balance=1.0, source="s"):
    return (change_id, client, seq, op, at, source, "g", city, balance)


def made():
    """A hot client whose numbers arrive in any order over several pages, ties, gaps, nulls, repeated rows and a client
    that is only ever woken by a timer."""
    rows = [row(k, 1, (k * 7919) % 900, day(k % 120, k % 24), "IUD"[k % 3] if k % 7 else "U", None if k % 5 == 0 else f"c{k % 11}", None if k % 4 == 0 else k / 8) for k in range(1500)]
    rows += [row(5000 + k, 2, k, day(0)) for k in range(12)]  # one early batch, gaps by lost rows, nothing after
    rows += [row(6000 + k, 3, 4, day(k)) for k in range(6)]  # one number, six rows
    rows += [row(7000, None, None, day(3)), row(7001, None, 5, day(4), None), row(7002, None, 6, day(5), "X"), row(7003, 4, 1, None), row(None, 4, 2, day(5)), row(7004, 4, 3, day(6), "I", "", float("inf")), row(7005, 4, 9, datetime.datetime(2900, 1, 1), "I", "late", 2.5)]
    rows += rows[:40]
    return rows


@pytest.mark.parametrize("p", [ApplierParams(page_size=16, bucket_clients=1, open_pages=2), ApplierParams(batches=4, page_size=8, bucket_clients=100, open_pages=3)])
def test_pages_hot_client_nulls_ties_and_repeats(spark, tmp_path, p):
    rows = made()
    clean = [r[:8] + (None if r[8] is not None and math.isinf(r[8]) else r[8],) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(apply_changes(spark, df, f"file://{tmp_path}/s", p)) == plain(clean, p.batches)


def test_empty_table(spark, tmp_path):
    assert apply_changes(spark, spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/s", ApplierParams(batches=1)).collect() == []


def test_only_touched_pages_load():
    p = ApplierParams(page_size=10)
    blobs, loads = {}, []

    def bucket(heads, days):
        def store(number, day, blob):
            blobs[number] = blob

        return PagedBucket(heads, days, lambda k: loads.append(k) or blobs[k], store, blobs.pop, p)

    b = bucket({}, {})
    for n in range(2, 102):
        assert b.hold("a", n, (100 + n, n, "U", None, None)) is None
    b.save()
    assert sorted(blobs) == list(range(11)) and not loads
    b = bucket(b.heads, b.days)
    assert b.due(104) == {} and not loads
    assert b.due(107) == {"a": 4} and loads == [0]
    assert [x[2] for x in b.walk("a", 4)] == list(range(2, 102))
    b.save()
    assert not blobs and not b.days and b.heads["a"][:3] == [102, None, 0]
    loads.clear()
    assert b.hold("a", 5, (300, 9, "U", None, None)) is not None and not loads
