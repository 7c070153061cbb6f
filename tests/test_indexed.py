import gzip

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringStartsWith

from weftline.sources import archive, files, indexed


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('archives')}/a"
    rows = [(i, f"http://host{i % 7}.org/{i}", f"<html><body>page {i} {'é' * (i % 50)}</body></html>" if i % 10 else None) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return folder, rows, indexed.write_archives(pages, folder, file_bytes=4000)


def test_rows_equal_a_whole_scan(spark, made):
    folder, rows, index = made
    assert index.select("filename").distinct().count() > 3
    got = sorted((r.url, r.rec_type, r.content) for r in indexed.read_ranges(index, folder, 17).collect())
    scanned = sorted((r.url, r.rec_type, r.content) for r in archive.read_archives(spark, f"{folder}/*.warc.gz").collect())
    assert got == scanned == sorted((u, "response", h or "") for _, u, h in rows)


def test_only_wanted_bytes_are_read(spark, made, monkeypatch):
    folder, _, index = made
    wanted = index.where("url like '%/1_' or filename is null")
    one = indexed.read_ranges(wanted, folder)
    assert one.count() == wanted.count() == 10
    source = indexed.PushingReader(f"{folder}/index", folder, 50)
    left = list(source.pushFilters([StringStartsWith(("url",), "http://host3."), In(("status",), ("200", None)), GreaterThan(("offset",), 0), EqualTo(("content",), "x")]))
    assert [type(x) for x in left] == [EqualTo] and len(source.wanted) == 3
    read = []
    real = indexed.read_range
    monkeypatch.setattr(indexed, "read_range", lambda data, offset, length: read.append(length) or real(data, offset, length))
    found = [r for part in source.partitions() for b in source.read(part) for r in b.to_pylist()]
    asked = index.where("url like 'http://host3.%' and offset > 0")
    assert sorted(r["url"] for r in found) == sorted(r.url for r in asked.collect())
    assert sum(read) == asked.agg(F.sum("length")).first()[0] < index.agg(F.sum("length")).first()[0] / 4


def test_pushed_by_spark(spark, made):
    folder, _, index = made
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = indexed.read_ranges(index, folder).where("url = 'http://host5.org/5' and length > 0")
        assert [r.content for r in df.collect()] == ["<html><body>page 5 ééééé</body></html>"]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0].replace("PythonFilter", "")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_broken_ranges_are_reported(spark, made):
    folder, _, index = made
    one = index.limit(1).select("*")
    bad = one.withColumn("offset", F.col("offset") + 1).unionByName(one.withColumn("length", F.col("length") - 1)).unionByName(one.withColumn("length", F.lit(10**6).cast("long")))
    bad = bad.unionByName(one.withColumn("filename", F.lit("none.warc.gz"))).unionByName(one.withColumn("offset", F.lit(None).cast("long")))
    got = indexed.read_ranges(bad, folder).collect()
    assert len(got) == 5 and {r.rec_type for r in got} == {"broken"} and all("Error" in r.content for r in got)
    assert indexed.read_ranges(index.limit(0), folder).collect() == []


def test_pushed_comparisons():
    batch = pa.RecordBatch.from_pydict({n: [None, 1, 2] if n in ("offset", "length") else [None, "a", "b"] for n in indexed._INDEX.names}, schema=indexed._INDEX)
    holds = lambda f: indexed._holds(batch, f).to_pylist()
    assert holds(LessThan(("offset",), 2)) == [False, True, False] and holds(In(("url",), ("b", None))) == [False, False, True]


def test_index_lines_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    (tmp_path / "b.gz").write_bytes(gzip.compress("".join(f"line {i}\n" for i in range(500)).encode()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_index(spark, f"file://{tmp_path}")
        assert rows.rdd.getNumPartitions() > 1
        got = [(r.file[-1], r.line_no, r.value) for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 20_500 and all(v == f"line {n}" for _, n, v in got)


def test_index_of_several_row_groups(spark, made, tmp_path):
    folder, rows, index = made
    table = index.orderBy("filename", "offset").toArrow()
    (tmp_path / "i").mkdir()
    pq.write_table(table, tmp_path / "i" / "x.parquet", row_group_size=13)
    source = indexed.RangeReader(f"file://{tmp_path}/i", folder, 29)
    parts = source.partitions()
    assert len(parts) == 7 and sum(p.count for p in parts) == 200
    assert sorted(r["url"] for p in parts for b in source.read(p) for r in b.to_pylist()) == sorted(u for _, u, _ in rows)
