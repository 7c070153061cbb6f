"""Archives with an index of byte ranges, and a data source that reads only the wanted ranges.

`write_archives` writes a gzip member a record and gives an index row for each: filename, offset, length and what a
crawl index says of a page. `read_ranges` takes index rows, however they were filtered or joined, and reads the records
they point at: the rows are sorted by file and offset into the shared folder, the source `indexed_archives` plans a
partition for every `rows_per_partition` of them from the footers of those files, and a task opens each archive once,
seeks to each of its ranges and inflates just that member. So a filter on the index, also one pushed down to the source
(`spark.sql.python.filterPushdown.enabled`), saves the bytes of the records it drops.

A range that is no whole member, or a file that is not there, gives a row of rec_type `broken` that says why; a null
filename, offset or length gives `broken`, too. A null payload is written as an empty one. A record is held whole.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from weftline.plans.lineage import shared_folder

from .archive import stream_records

INDEX = "filename string, offset long, length long, url string, mime string, status string, digest string"
_INDEX = pa.schema([("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("mime", pa.string()), ("status", pa.string()), ("digest", pa.string())])
_RECORD = pa.schema([*_INDEX, ("rec_type", pa.string()), ("content_type", pa.string()), ("content", pa.string())])
RECORD = f"{INDEX}, rec_type string, content_type string, content string"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def file_system(uri: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def member(url: str, payload: bytes, level: int = 1) -> bytes:
    """A response record as one gzip member."""
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {' '.join(url.split())}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(_HTTP) + len(payload)}\r\n\r\n"
    deflate = zlib.compressobj(level, wbits=31)
    return deflate.compress(head.encode() + _HTTP + payload + b"\r\n\r\n") + deflate.flush()


def write_archives(pages: DataFrame, folder: str, url_column: str = "url", html_column: str = "html", file_bytes: int = 1 << 30) -> DataFrame:
    """Writes all pages into archives below `folder`; gives their index, which is itself a table in that folder. A task
    names its files itself and only files that the index names count, so what a lost task leaves is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.as_py().encode("utf-8", "surrogatepass") if html.is_valid else b""
                data = member(url or "", payload)
                out.write(data)
                rows.append((name, at, len(data), url, "text/html", "200", hashlib.sha1(payload).hexdigest()))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    made = pages.select(F.col(url_column).cast("string"), F.col(html_column).cast("string")).mapInArrow(run, INDEX)
    made.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


@dataclass
class _Range(InputPartition):
    """Rows [first, first + count) of a file of index rows."""

    path: str
    first: int
    count: int


_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal, StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}


def _holds(rows: pa.RecordBatch, wanted: Filter) -> pa.Array:
    """Where a pushed filter holds; null counts as no."""
    column = rows.column(wanted.attribute[0])
    if isinstance(wanted, IsNotNull):
        return pc.is_valid(column)
    if isinstance(wanted, In):
        return pc.and_(pc.is_valid(column), pc.is_in(column, pa.array([x for x in wanted.value if x is not None], column.type)))
    return pc.fill_null(_COMPARE[type(wanted)](column, wanted.value), False)


class RangeReader(DataSourceReader):
    def __init__(self, index: str, root: str, rows_per_partition: int):
        self.index, self.root, self.rows = index, root, rows_per_partition
        self.wanted: list[Filter] = []

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        system, path = file_system(self.index)
        found = []
        for entry in system.get_file_info(fs.FileSelector(path)):
            if entry.base_name.endswith(".parquet"):
                with system.open_input_file(entry.path) as data:
                    n = pq.ParquetFile(data).metadata.num_rows
                found += [_Range(entry.path, lo, min(self.rows, n - lo)) for lo in range(0, n, self.rows)]
        return found or [_Range("", 0, 0)]

    def _rows(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.index)
        with system.open_input_file(part.path) as data:
            seen = 0
            for batch in pq.ParquetFile(data).iter_batches(batch_size=1024, columns=_INDEX.names):
                lo, hi = max(part.first - seen, 0), min(part.first + part.count - seen, batch.num_rows)
                seen += batch.num_rows
                if lo < hi:
                    yield batch.slice(lo, hi - lo)
                if seen >= part.first + part.count:
                    return

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, root = file_system(self.root)
        name, data, held, size = None, None, [], 0
        for batch in self._rows(partition):
            for wanted in self.wanted:
                batch = batch.filter(_holds(batch, wanted))
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if None in row[:3]:
                        raise ValueError("an index row without file, offset or length")
                    if row[0] != name:
                        if data is not None:
                            data.close()
                        name, data = None, None
                        data = system.open_input_file(f"{root}/{row[0]}")
                        name = row[0]
                    record = read_range(data, row[1], row[2])
                except (EOFError, OSError, ValueError, zlib.error) as e:
                    record = ("broken", "", f"{type(e).__name__}: {e}")
                held.append((*row, *record))
                size += len(record[2])
                if size > 4 << 20:
                    yield _records(held)
                    held, size = [], 0
            if held:
                yield _records(held)
                held, size = [], 0
        if data is not None:
            data.close()


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def read_range(data, offset: int, length: int) -> tuple[str, str, str]:
    """(record type, content type, content) of the one member that the range holds."""
    data.seek(offset)
    raw = data.read(length)
    if len(raw) < length:
        raise EOFError(f"{length - len(raw)} bytes of the range are beyond the file")
    inflate = zlib.decompressobj(wbits=31)
    plain = inflate.decompress(raw)
    if not inflate.eof or inflate.unused_data:
        raise ValueError("the range is not one whole member")
    for record in stream_records(io.BytesIO(plain)):
        return record.kind, record.content_type, b"".join(record.chunks).decode("utf-8", "ignore")
    raise ValueError("a member without a record")


class PushingReader(RangeReader):
    """With filters on what the index has; Spark takes a reader that has this only where pushing down is switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps filters on what the index has; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (*_COMPARE, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in _INDEX.names:
                self.wanted.append(f)
            else:
                yield f


class IndexedArchives(DataSource):
    """Options: path (a folder of index rows as Parquet), root (the archives' folder), rows_per_partition, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "indexed_archives"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> RangeReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else RangeReader
        return kind(self.options["path"], self.options["root"], int(self.options.get("rows_per_partition", 4096)))


def read_ranges(index: DataFrame, root: str, rows_per_partition: int = 4096) -> DataFrame:
    """The records of the index rows (columns of INDEX; others are left out), with rec_type, content_type, content."""
    spark = index.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    wanted = index.select(*_INDEX.names)
    wanted.repartitionByRange("filename", "offset").sortWithinPartitions("filename", "offset").write.parquet(folder)
    spark.dataSource.register(IndexedArchives)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("indexed_archives").option("root", root).option("pushdown", pushdown).option("rows_per_partition", str(rows_per_partition)).load(folder)
