import gzip
import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import crawl
from weftline.plans import config, lineage
from weftline.sources import archive, files, sinks
from weftline.streaming import ingest

HTML = "<!DOCTYPE html><html><body>" + "x" * 11000 + "</body></html>"


def test_pages_and_gold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a-1.html").write_bytes("é".encode())
    (tmp_path / "in" / "b.html").write_bytes(b"\xe9")
    (tmp_path / "in" / "c.txt").write_text("gold")
    rows = {r.name: r for r in files.read_pages(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"a-1.html", "b.html"} and rows["a-1.html"].stem == "a" and rows["b.html"].html == rows["a-1.html"].html == "é"
    assert files.read_gold(spark, str(tmp_path / "in")).first().text == "gold"


def test_classes(spark, tmp_path):
    for label in ("news", "blog"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "p.htm").write_text(label)
    got = {r.label: r.label_id for r in files.read_classes(spark, str(tmp_path)).collect()}
    assert got == {"blog": 0, "news": 1}


def test_small_tables(spark, tmp_path):
    (tmp_path / "tags.txt").write_text("a\n  p \n\n")
    assert [r.value for r in files.read_list(spark, str(tmp_path / "tags.txt")).collect()] == ["a", "p"]
    (tmp_path / "m.csv").write_text("f|http://u|g\n")
    assert tuple(files.read_groups(spark, str(tmp_path / "m.csv")).first()) == ("f", "http://u", "g")
    (tmp_path / "f.csv").write_text("1,0,0.5,2\n")
    row = files.read_feature_rows(spark, str(tmp_path / "f.csv")).first()
    assert row.head == [1.0, 0.0] and row.f == [0.5, 2.0]
    (tmp_path / "e.json").write_text(json.dumps({"attributeNames": ["x", "color"], "elements": {"3": ["1", "red"]}}))
    row = files.read_element_properties(spark, str(tmp_path / "e.json")).first()
    assert row.element == "3" and row.properties == {"BoundingClientRect_x": "1", "color": "red"}


def test_index(spark, tmp_path):
    rec = dict(status="200", url="http://a.org/x.html", filename="f", length="9", mime="text/html", offset="1", digest="d")
    lines = [f"org,a)/ 1 {json.dumps(rec)}", "broken {", json.dumps({**rec, "mime": "image/png"}), f'{{"q": 1}} {json.dumps(rec)}', json.dumps({k: v for k, v in rec.items() if k != "digest"})]
    with gzip.open(tmp_path / "cdx.gz", "wt") as out:
        out.write("\n".join(lines))
    found = crawl.parse_index(files.read_index(spark, str(tmp_path)))
    assert sorted(r.line_no for r in found.collect()) == [0, 3]
    assert crawl.parse_index(files.read_index(spark, str(tmp_path)), 1).count() == 1


def warc(kind, url, body, http="text/html; charset=utf-8"):
    payload = f"HTTP/1.1 200 OK\r\nContent-Type: {http}\r\n\r\n{body}".encode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(payload)}\r\n\r\n"
    return gzip.compress(head.encode() + payload + b"\r\n\r\n")


def arc(url, body):
    payload = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{body}".encode()
    return gzip.compress(f"{url} 1.2.3.4 20080101 text/html {len(payload)}\n".encode() + payload + b"\n")


def test_archives(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc("request", "http://q", "") + warc("response", "http://w", "junk" + HTML) + warc("response", "http://i", HTML, "image/png"))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(b"filedesc://x 0.0.0.0 2008 text/plain 3\nabc\n") + arc("http://a", HTML) + arc("http://s", "<html>short</html>"))
    (tmp_path / "c.warc.gz").write_bytes(warc("response", "http://c", HTML)[:-40])
    found = archive.read_archives(spark, str(tmp_path)).cache()
    assert {r.url for r in found.where("rec_type = 'response'").collect()} >= {"http://w", "http://i", "http://a", "http://s"}
    pages = {r.url: r.html for r in archive.pages_of(found).collect()}
    assert set(pages) == {"http://w", "http://a"} and pages["http://w"] == HTML.split("</html>")[0]
    assert archive.pages_of(found, None).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("fold", F.col("id") % 2)
    sinks.write_sharded(df, f"{tmp_path}/s", 3)
    sinks.write_by(df, f"{tmp_path}/f", "fold")
    assert spark.read.parquet(f"{tmp_path}/f").where("fold = 1").count() == 5
    sinks.write_texts(df.select("id", F.lit("a\nb").alias("t")), f"{tmp_path}/t", "id", "t")
    assert spark.read.text(f"{tmp_path}/t").count() == 20
    offsets = sinks.feature_offsets({"a": 3, "b": 2})
    assert offsets["b"] == {"idx": 3, "len": 2} and list(sinks.without_feature(offsets, "a")) == ["b"]
    assert json.loads(sinks.config_text({"max_nodes": 1}, {"a": 3, "b": 2}))["feature_desc"]["feature_size"] == 5
    assert sinks.newest(spark.createDataFrame([("w_9.h5",), ("w_10.h5",)], "path string")).first().path == "w_10.h5"
    sinks.write_labels(spark.createDataFrame([(1, "0,1")], "page_id long, labels string"), f"{tmp_path}/l")
    sinks.write_rows(df.limit(1), f"{tmp_path}/r", [F.col("id").cast("string"), F.lit("1.5")])
    assert spark.read.text(f"{tmp_path}/r").first().value == "0,1.5"


def test_commits(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    assert sinks.committed(spark, folder) == [] and sinks.read_committed(spark, folder, "id long").count() == 0
    assert sinks.commit_batch(spark.range(3), folder, "b1") and not sinks.commit_batch(spark.range(9), folder, "b1")
    (tmp_path / "c" / "b2").mkdir()
    assert sinks.committed(spark, folder) == ["b1"] and sinks.commit_batch(spark.range(2), folder, "b2")
    assert sinks.read_committed(spark, folder, "id long").count() == 5


def test_ingest(spark, tmp_path):
    land, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda ids: spark.createDataFrame([(i, f"http://{i}", "x") for i in ids], ingest.PAGES)
    rows([1, 2]).write.parquet(land)
    ingest.ingest(ingest.read_landing(spark, land), f"file://{out}", state, ["page_id"])
    rows([2, 3]).write.mode("append").parquet(land)
    ingest.ingest(ingest.read_landing(spark, land), f"file://{out}", state, ["page_id"])
    got = sinks.read_committed(spark, f"file://{out}", ingest.PAGES)
    assert sorted(r.page_id for r in got.collect()) == [1, 2, 3]


def test_gate(spark, tmp_path):
    land = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 4)], "grp string, page_id long").write.parquet(land)
    stream = spark.readStream.schema("grp string, page_id long").parquet(land)
    got = ingest.run_to_table(ingest.gate_groups(stream, "grp", "page_id"))
    assert sorted((r.grp, r.page_id) for r in got.collect()) == [("a", 1), ("a", 3), ("a", 4)]


def test_windows(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").limit(200).write.parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    got = ingest.run_to_table(ingest.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/e")), "complete")
    assert got.agg(F.sum("n")).first()[0] == 200


def test_config():
    registry = {}

    def add(a, b=1):
        return a + b

    registry["add"] = add
    registry["two"] = 2
    text = '[{"cache": {"c": {"add": [1, 1]}}, "x": {"add": {"a": "${two}", "b": "${c}"}}, "k": [{"v": 3}]}, # note\n {"x": 5}]'
    c = config.Config.from_text(text, registry)
    assert c.get("x") == 4 and c.get("x", 1) == 5 and c.get("k", 1) == [{"v": 3}]
    assert c.overwrite("k", "v", 9).get("k") == [{"v": 9}] and c.get("k") == [{"v": 3}]
    with pytest.raises(KeyError):
        c.resolve("${os.system}")


def test_plan_helpers(spark):
    assert config.swizzle((1, 2, 3), (2, (0, 0))) == (3, (1, 1)) and config.swizzle({"a": 1}, ("a",)) == (1,)
    assert config.flatten_tuples([(1, None), 2]) == (1, 2) and config.flatten_tuples([(1, None)], False) == (1, None)
    assert config.row([1, 2], [None, lambda x: x * 5]) == [1, 10] and config.sequential((1, 2), [lambda a, b: a + b, lambda x: x * 2]) == 6
    assert config.chain(None, {"0": [lambda x: x + 1], "1:3": [lambda x: x * 2], "0,2": [str]}, [1, 2, 3]) == ["2", 4, "6"]
    assert config.chain(spark.range(3), {"0": [lambda d: d.where("id > 0")]}).count() == 2
    ranked = lineage.rank_rows(spark.range(100).repartition(7), [F.desc("id") if False else -F.col("id")])
    assert {r.id: r["rank"] for r in ranked.collect()} == {i: 99 - i for i in range(100)}


def test_strict_path_pairs(spark):
    rows = spark.createDataFrame([("d", "s", p) for p in ("/a/x.html", "/a/y.html", "/b/c/z.html", "/q")] + [("d", "", "/a")], "domain string, subdomain string, path string")
    assert sorted(r.path for r in crawl.path_pairs(rows).collect()) == ["/a/x.html", "/a/y.html"]
    assert crawl.path_pairs(rows, True).count() == 2


def test_archive_larger_than_a_chunk_streams(spark, tmp_path):
    """A payload of many chunks, read under a memory bound that the whole file would break."""
    import io
    import tracemalloc

    body = b"x" * (40 << 20)
    raw = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" % (len(body) + 19) + body + b"\r\n\r\n", 1)
    tracemalloc.start()
    (one,) = [(x.n_bytes, sum(map(len, x.chunks))) for x in archive.stream_records(io.BytesIO(raw))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert one == (len(body), len(body)) and peak < 8 << 20


def test_broken_archive_is_reported(spark, tmp_path):
    (tmp_path / "c.warc.gz").write_bytes(warc("response", "http://b", HTML) + warc("response", "http://c", HTML)[:-40])
    found = {r.rec_type: r for r in archive.read_archives(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {"response", "broken"} and found["response"].url == "http://b" and "Error" in found["broken"].content
