"""Archive scans: response records of gzipped WARC and ARC files, streamed."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import html_slice
from weftline.functions.urls import CrawlRules

#: File systems that are read as streams; bytes a line is read in at most.
_STREAMED = ("file", "hdfs", "s3", "gs")
_LINE = 1 << 16


class Members(io.RawIOBase):
    """The bytes of a gzip stream of many members. Unlike gzip's own reader it hands out all that stands before a
    break, and raises EOFError only at the break."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.inflate, self.rest = stream, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            self.rest = self.rest or self.stream.read(1 << 16)
            if self.inflate is None:
                self.rest = self.rest.lstrip(b"\0")  # padding between members
                if not self.rest:
                    self.rest = self.stream.read(1 << 16)
                    if not self.rest:
                        return 0
                    continue
                self.inflate = zlib.decompressobj(wbits=31)
            was_end = not self.rest
            part = self.inflate.decompress(self.rest, len(out))
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, None
            else:
                self.rest = self.inflate.unconsumed_tail
                if was_end and not part:
                    raise EOFError("a gzip member is cut off")
            if part:
                out[: len(part)] = part
                return len(part)


@dataclass
class Record:
    """A record's head, and its payload as chunks; `n_bytes` counts the payload without an HTTP head."""

    format: str
    kind: str
    url: str
    content_type: str
    fields: dict[str, str]
    n_bytes: int
    chunks: Iterator[bytes]


def open_stream(uri: str) -> BinaryIO:
    """A file's bytes as a stream, by any file system that pyarrow has (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        system, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def _http_head(data: io.BufferedReader, left: int) -> tuple[str, int, bytes]:
    """Content type, bytes left, and what was read of a payload that has no HTTP head."""
    line = data.readline(min(left, _LINE))
    left -= len(line)
    if not line.startswith(b"HTTP/"):
        return "", left, line
    kind = ""
    while left and (line := data.readline(min(left, _LINE))):
        left -= len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-type":
            kind = value.decode("latin-1").split(";")[0].strip().lower()
    return kind, left, b""


def _chunks(data: io.BufferedReader, left: int, size: int, ahead: bytes, what: str) -> Iterator[bytes]:
    """The payload in chunks of `size` bytes, the last one shorter; an empty payload is one empty chunk."""
    while True:
        part, ahead = ahead[:size], ahead[size:]
        want = min(size - len(part), left)
        if want:
            more = data.read(want)
            if len(more) < want:
                raise EOFError(f"record {what} is cut off")
            left, part = left - want, part + more
        yield part
        if not left and not ahead:
            return


def stream_records(stream: BinaryIO, size: int = 1 << 20) -> Iterator[Record]:
    """The records of a WARC or ARC stream, gzipped (member by member) or plain. Memory holds one chunk of `size`
    bytes; a record's chunks are read while it is the current one, and what is left of them is passed over."""
    data = io.BufferedReader(stream, 1 << 16)
    if data.peek(2)[:2] == b"\x1f\x8b":
        data = io.BufferedReader(Members(data), 1 << 16)
    while line := data.readline(_LINE):
        line = line.strip()
        if not line:
            continue
        if line.startswith(b"WARC/"):
            fields = {}
            while line := data.readline(_LINE).rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            form, kind, url = "WARC", fields.get("warc-type", ""), fields.get("warc-target-uri", "")
            left, content_type, ahead = int(fields.get("content-length", 0)), fields.get("content-type", ""), b""
            if "http" in content_type:
                content_type, left, ahead = _http_head(data, left)
            what = fields.get("warc-record-id", url)
        else:
            parts = line.decode("utf-8", "replace").split()
            if len(parts) < 5 or not parts[-1].isdigit():
                raise ValueError(f"not an archive record: {line[:40]!r}")
            fields, form, url, what = {}, "ARC", parts[0], parts[0]
            kind = "filedesc" if url.startswith("filedesc:") else "response"
            _, left, ahead = _http_head(data, int(parts[-1]))
            content_type = parts[3].lower()
        chunks = _chunks(data, left, size, ahead, what)
        yield Record(form, kind, url, content_type, fields, left + len(ahead), chunks)
        for _ in chunks:
            pass


def _scan(name: str, stream: BinaryIO) -> Iterator[tuple[tuple, int]]:
    """(row, bytes) of each record; a file that breaks off ends with a row of the type `broken`."""
    try:
        for x in stream_records(stream):
            body = b"".join(x.chunks)
            yield (name, x.format, x.kind, x.url, x.content_type, body.decode("utf-8", "ignore")), len(body)
    except (EOFError, OSError, ValueError, zlib.error) as e:
        yield (name, "", "broken", "", "", f"{type(e).__name__}: {e}"), 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, format, rec_type, url, content_type, content (UTF-8, bad bytes left out) of all records.

    Spark lists the files; a task reads each as a stream, so memory holds one record, never a file. Only where
    the path's file system is one that pyarrow lacks, a file's bytes come through Spark, whole. A file that breaks
    off gives the records before the break and a row of rec_type `broken` that says why."""
    files = spark.read.format("binaryFile").load(path)
    scheme = str(spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme())
    streamed = scheme in _STREAMED
    names = ["path", "format", "rec_type", "url", "content_type", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                with open_stream(name) if streamed else pa.BufferReader(raw.as_buffer()) as stream:
                    for row, n in _scan(name, stream):
                        held.append(row)
                        size += n + 256
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names)

    rows = files.select("path", F.col("length") if streamed else F.col("content"))
    return rows.mapInArrow(run, "path string, format string, rec_type string, url string, content_type string, content string")


def pages_of(found: DataFrame, rules: CrawlRules | None = CrawlRules()) -> DataFrame:
    """url, html of HTML responses that close their document; with rules only long ones."""
    whole: Column = (F.col("rec_type") == "response") & (F.col("content_type") == "text/html") & (F.instr("content", "</html>") > 0)
    rows = found.where(whole).select("path", "url", html_slice(F.col("content")).alias("html"))
    return rows.where(F.length("html") > rules.min_content) if rules else rows
