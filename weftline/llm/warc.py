"""WARC archives through a chunked record table.

A payload is never held whole beside its source cell: it is a run of rows (record id, chunk number, bytes)
with the SHA-1 of all bytes up to the chunk's end, so the last row bears the payload's digest and length.
Writing joins these rows with each record's decision (response or revisit), sorts them by record and chunk
and streams them into one gzip member a record. A task writes files under names of its own and reports them
when it has ended; the manifest is checkpointed and only files it names are read, so a lost executor or a
second attempt leaves nothing that counts. Files go through pyarrow's file systems (file, hdfs, s3 ...)
under the shared folder. Reading streams the members back as the same kind of chunk rows and checks each
digest.

Of records with equal payloads of at least `min_bytes` bytes the one with the smallest page id is a
response, the others are revisits that refer to it. Duplicates are found by digest: one row a payload is
aggregated, however many copies there are.

Defined cases: a null payload is empty; a row without a page id comes after those with one and is still
written; of repeated rows one is the response; a null URL gives no target header and line breaks in it are
escaped; an empty table gives no file and an empty result; a very long payload is many chunk rows. Only the id,
URL and payload columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import archive

from .common import checkpoint, ensure_checkpoint_dir, read, replayable


@dataclass(frozen=True)
class WarcParams:
    chunk_bytes: int = 1 << 20
    min_bytes: int = 0
    file_bytes: int = 1 << 30
    date: str = "2024-01-01T00:00:00Z"
    level: int = 1


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNK = "chunk_no long, chunk binary, digest string, bytes_so_far long, is_last boolean"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: hashlib._Hash) -> str:
    return base64.b32encode(digest.digest()).decode()


def payload_chunks(payload: bytes | None, size: int) -> Iterator[tuple[int, memoryview, str, int, bool]]:
    """(number, bytes, digest so far, length so far, whether it is the last); an empty payload is one chunk."""
    view, sha, no = memoryview(payload or b""), hashlib.sha1(), 0
    while True:
        part = view[no * size : (no + 1) * size]
        sha.update(part)
        end = no * size + len(part)
        yield no, part, base32(sha), end, end == len(view)
        no += 1
        if end == len(view):
            return


def _to_batches(rows: Iterator[tuple], schema: pa.Schema, at: int, most: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of `most_rows` rows, or of rows whose column `at` has some `most` bytes together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[at] or b"")
        if size >= most or len(held) >= most_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


_WRITE = pa.schema([("uid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("digest", pa.string()), ("bytes_so_far", pa.int64()), ("is_last", pa.bool_())])


def record_table(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """uid, page_id, url, payload. The table is read twice, once for digests and once for payloads, and both
    readings must number the rows alike. So whatever is not a plain scan of files is written out first."""
    pages = replayable(pages.select(id_column, url_column, payload_column))
    return pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(payload_column).cast("binary").alias("payload"))


def chunk_table(records: DataFrame, p: WarcParams = WarcParams(), payload: bool = True) -> DataFrame:
    """The chunked record table: uid, page_id, url and the chunk columns; url in chunk 0 alone. With payload=False
    only each record's last row, without bytes and url: its digest and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows():
            for batch in batches:
                uid, page, url = (batch.column(k).to_pylist() for k in range(3))
                for u, i, a, whole in zip(uid, page, url, batch.column(3)):
                    for no, part, digest, end, last in payload_chunks(whole.as_buffer() if whole.is_valid else None, p.chunk_bytes):
                        if payload:
                            yield u, i, None if no else a, no, bytes(part), digest, end, last
                        elif last:
                            yield u, i, None, no, None, digest, end, last

        yield from _to_batches(all_rows(), _WRITE, 4)

    return records.mapInArrow(cut, f"uid long, page_id long, url string, {_CHUNK}")


def decisions(chunks: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """(uid, n_bytes, payload_digest, record_type, refers_to, refers_uid) of each record. The digests are
    checkpointed: the payloads are read once for them."""
    whole = checkpoint(chunks.where("is_last").select("uid", "page_id", F.col("bytes_so_far").alias("n_bytes"), F.col("digest").alias("payload_digest")))
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("uid"))
    first = whole.groupBy("payload_digest").agg(F.min(order).alias("first"))
    revisit = (F.col("n_bytes") >= p.min_bytes) & (F.col("first.uid") != F.col("uid"))
    return whole.join(first, "payload_digest").select(
        "uid",
        "n_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.uid")).alias("refers_uid"),
    )


def record_id(page_id: int | None, uid: int) -> str:
    return f"<urn:warc-page:{'' if page_id is None else page_id}:{uid}>"


def record_header(page_id, uid, url, n_bytes, digest, kind, refers_to, refers_uid, p: WarcParams) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, uid)}", f"WARC-Date: {p.date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_uid)}", f"WARC-X-Payload-Length: {n_bytes}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(_HTTP) + (n_bytes if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


class _Members:
    """Writes gzip members, one a record, into files of some `most` bytes each."""

    def __init__(self, folder: str, most: int, level: int):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.base, recursive=True)
        self.folder, self.most, self.level = folder, most, level
        self.out, self.done, self.name, self.records = None, [], "", 0

    def start(self) -> None:
        if self.out is None:
            self.name = f"part-{uuid.uuid4().hex}.warc.gz"
            self.out, self.records = self.system.open_output_stream(f"{self.base}/{self.name}", compression=None), 0
        self.deflate = zlib.compressobj(self.level, wbits=31)

    def write(self, data: bytes) -> None:
        self.out.write(self.deflate.compress(data))

    def end(self) -> None:
        self.out.write(self.deflate.flush())
        self.records += 1
        if self.out.tell() >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.done.append((f"{self.folder}/{self.name}", self.records, self.out.tell()))
            self.out.close()
            self.out = None


def write_warc(chunks: DataFrame, records: DataFrame, folder: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Writes the archives under `folder`, a URI; returns their manifest (file, n_records, n_bytes)."""
    known = records.withColumnRenamed("uid", "_uid")
    rows = (
        chunks.hint("shuffle_merge")
        .join(known, F.col("uid") == F.col("_uid"))
        .where("record_type = 'response' or chunk_no = 0")
        .select("uid", "chunk_no", F.when(F.col("record_type") == "response", F.col("chunk")).alias("chunk"), (F.col("is_last") | (F.col("record_type") == "revisit")).alias("ends"), "page_id", "url", "n_bytes", "payload_digest", "record_type", "refers_to", "refers_uid")
        .sortWithinPartitions("uid", "chunk_no")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in batches:
            rest = list(zip(*(batch.column(k).to_pylist() for k in range(3, 11))))
            for uid, no, chunk, (ends, page, url, n, digest, kind, to, to_uid) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), rest):
                if no == 0:
                    files = files or _Members(folder, p.file_bytes, p.level)
                    files.start()
                    files.write(record_header(page, uid, url, n, digest, kind, to, to_uid, p) + _HTTP)
                if chunk.is_valid:
                    files.write(chunk.as_buffer())
                if ends:
                    files.write(b"\r\n\r\n")
                    files.end()
        if files:
            files.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files.done)], ["file", "n_records", "n_bytes"])

    return checkpoint(rows.mapInArrow(write, "file string, n_records long, n_bytes long"))


_OWN_ID = re.compile(r"<urn:warc-page:(-?\d*):(\d+)>")


def warc_chunks(stream, size: int) -> Iterator[tuple]:
    """Chunk rows of every record of a (multi-member) gzip stream; memory holds one chunk. Records of other
    writers have neither uid nor page id; the digest and length they lack are null and what was read."""
    for x in archive.stream_records(stream, size):
        own, to = (_OWN_ID.fullmatch(x.fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
        stated = x.fields.get("warc-payload-digest")
        head = (int(own[2]) if own else None, int(own[1]) if own and own[1] else None, x.fields.get("warc-target-uri"), x.kind, int(to[1]) if to and to[1] else None, stated and stated.removeprefix("sha1:"), int(x.fields.get("warc-x-payload-length", x.n_bytes)))
        sha, so_far = hashlib.sha1(), 0
        for no, part in enumerate(x.chunks):
            so_far += len(part)
            sha.update(part)
            yield *head, no, part, base32(sha), so_far, so_far == x.n_bytes


_READ = pa.schema([("uid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("digest", pa.string()), ("bytes_so_far", pa.int64()), ("is_last", pa.bool_())])


def read_warc(manifest: DataFrame, p: WarcParams = WarcParams(), payload: bool = True) -> DataFrame:
    """Chunk rows of the manifest's files; with payload=False only each record's last row, without bytes."""
    files = manifest.select("file").repartition(max(1, manifest.count()))  # a task a file; the manifest is checkpointed

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def all_rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    system, path = fs.FileSystem.from_uri(uri)
                    with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                        for row in warc_chunks(stream, p.chunk_bytes):
                            if payload:
                                yield row
                            elif row[-1]:
                                yield *row[:8], None, *row[9:]

        yield from _to_batches(all_rows(), _READ, 8)

    return files.mapInArrow(scan, f"uid long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, {_CHUNK}")


def op5_warc(spark: SparkSession, sf_dir: str, p: WarcParams = WarcParams()) -> DataFrame:
    records = record_table(read(spark, sf_dir, "pages"))
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    folder = folder if re.match(r"[a-z][a-z0-9+.-]*:", folder) else f"file://{folder}"
    manifest = write_warc(chunk_table(records, p), decisions(chunk_table(records, p, payload=False), p), f"{folder}/warc-{uuid.uuid4().hex}", p)
    back = read_warc(manifest, p, payload=False)
    intact = (F.col("record_type") == "revisit") | ((F.col("digest") == F.col("payload_digest")) & (F.col("bytes_so_far") == F.col("payload_bytes")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", intact.alias("intact"))
