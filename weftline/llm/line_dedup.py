"""Reversible line dedup: sharded cuckoo filters in front of exact reference tables.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of `min_chars` code points
or more count. A key found in `min_docs` documents or more is common: its lines are dropped everywhere but in the document
with the largest id that holds it. An index keeps, in a folder that all executors share,
* `refs`: every (key, document) reference, as a log of signed rows, a folder a change;
* `counts`: each key's exact number of documents and largest id, derived from the references;
* `filters`: cuckoo filters of the common keys, a row a shard of the key space (16-bit fingerprints, four to a bucket).
Inserting or deleting documents adds references, corrects the counts of the keys they touch, and inserts into or deletes
from the filters of only those shards in which a key became common or ceased to be. Each change is a version of its own, named
in its folder's name, and the one before stays readable, so a broken change leaves nothing that counts.

Cleaning asks the filters first: filters of up to `broadcast_bytes` go to all executors, larger ones meet the keys
shard by shard, in salted partitions, as sorted streams. Only keys that a filter lets through are shuffled and looked up
in the exact counts, so false positives cost a lookup and never a line. Texts are shuffled only where the drop lists are too
large to broadcast. Keys are 128-bit BLAKE2 digests.

Defined cases: a null or empty text is one empty line; rows of one id are one document (also rows without one, which
are never the largest); equal lines of a document count once, and all of them stay or go; a document that is inserted
again adds its lines to those it had; deleting an unknown id does nothing; an empty table gives no rows. Only the id and
text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, ensure_checkpoint_dir, read

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SLOTS = 4


@dataclass(frozen=True)
class LineParams:
    min_chars: int = 20
    min_docs: int = 3
    shard_keys: int = 1 << 15
    broadcast_bytes: int = 16 << 20
    salts: int = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None if it is too short."""
    key = line.strip(_SPACE).lower()  # of bytes: A-Z alone
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.translate(None, _CONTINUATION)) < min_chars:
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of 64-bit keys in buckets of four; a key has two buckets, each found from the other and the
    fingerprint, so entries can be moved and taken out without their keys."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.mask = slots.tolist(), len(slots) // _SLOTS - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these keys with room for some more; of twice the size where they do not fit."""
        size = 1 << max(2, int(len(keys) * 1.5 / _SLOTS)).bit_length()
        while True:
            made = cls(np.zeros(size * _SLOTS, np.uint16))
            if all(made.insert(k) for k in keys.tolist()):
                return made
            size *= 2

    def _places(self, key: int) -> tuple[int, int, int]:
        print_ = (key & 0xFFFF) or 1
        first = key >> 16 & self.mask
        return print_, first, first ^ (print_ * 0x5BD1E995 >> 8 & self.mask)

    def insert(self, key: int) -> bool:
        """False if there is no room; the filter is then to be built anew."""
        print_, at, other = self._places(key & 0xFFFFFFFFFFFFFFFF)
        for k in range(500):
            for bucket in (at, other) if not k else (at,):
                row = bucket * _SLOTS
                for slot in range(row, row + _SLOTS):
                    if not self.slots[slot]:
                        self.slots[slot] = print_
                        return True
            slot = at * _SLOTS + (k * 7 + print_) % _SLOTS
            print_, self.slots[slot] = self.slots[slot], print_
            at ^= print_ * 0x5BD1E995 >> 8 & self.mask
        return False

    def delete(self, key: int) -> bool:
        """Takes out one entry of the key, which must have been inserted."""
        print_, *buckets = self._places(key & 0xFFFFFFFFFFFFFFFF)
        for bucket in buckets:
            row = bucket * _SLOTS
            for slot in range(row, row + _SLOTS):
                if self.slots[slot] == print_:
                    self.slots[slot] = 0
                    return True
        return False

    def to_bytes(self) -> bytes:
        return np.array(self.slots, np.uint16).tobytes()


class ShardedFilters:
    """Filters of all or some shards, side by side, for looking up many keys at once."""

    def __init__(self, bits: int, blobs: dict[int, bytes]):
        self.bits = bits
        self.start, self.mask = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.uint64)
        parts, at = [], 0
        for shard, blob in blobs.items():
            part = np.frombuffer(blob, np.uint16).reshape(-1, _SLOTS)
            self.start[shard], self.mask[shard] = at, len(part) - 1
            parts.append(part)
            at += len(part)
        self.slots = np.concatenate(parts) if parts else np.zeros((0, _SLOTS), np.uint16)

    def hits(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = (hi.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hi), np.int64)
        out = np.zeros(len(hi), bool)
        there = np.flatnonzero(self.start[shard] >= 0)
        if len(there):
            key, start, mask = lo[there].view(np.uint64), self.start[shard[there]], self.mask[shard[there]]
            print_ = np.maximum(key & np.uint64(0xFFFF), np.uint64(1))
            first = key >> np.uint64(16) & mask
            second = first ^ (print_ * np.uint64(0x5BD1E995) >> np.uint64(8) & mask)
            wanted = print_.astype(np.uint16)[:, None]
            out[there] = (self.slots[start + first.astype(np.int64)] == wanted).any(1) | (self.slots[start + second.astype(np.int64)] == wanted).any(1)
        return out


def shard_of(hi: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hi, 64 - bits).cast("int") if bits else F.lit(0)


def _document_keys(text: bytes, p: LineParams) -> list[bytes]:
    """Digests of the text's different keys."""
    return list({digest(k) for x in text.split(b"\n") if len(x) >= p.min_chars and (k := line_key(x, p.min_chars)) is not None})


def _text_bytes(cell: pa.Scalar) -> bytes:
    return cell.as_buffer().to_pybytes() if cell.is_valid else b""


def line_refs(docs: DataFrame, p: LineParams = LineParams(), filters: ShardedFilters | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, hi, lo: a row for each different key of each row's text; with filters only keys that these let through."""
    held = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, cell in enumerate(batch.column(1)):
                found = _document_keys(_text_bytes(cell), p)
                rows += [i] * len(found)
                keys += found
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            rows, hi, lo = np.array(rows, np.int64), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            if held is not None:
                let = held.value.hits(hi, lo)
                rows, hi, lo = rows[let], hi[let], lo[let]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hi), pa.array(lo)], ["doc_id", "hi", "lo"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"doc_id {kind}, hi long, lo long")


def routed_hits(refs: DataFrame, filters: DataFrame, bits: int, salts: int) -> DataFrame:
    """The rows of refs that the filters let through, shard by shard: a partition is a sorted stream in which each
    shard's filter stands before its keys. A common key's rows are dealt by document over `salts` partitions."""
    keys = refs.select(shard_of(F.col("hi"), bits).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "hi", "lo", F.lit(None).cast("binary").alias("slots"))
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    copies = filters.select("shard", each.alias("salt"), F.lit(None).cast(refs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "slots")
    sorted_ = keys.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", F.col("slots").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                slots = part.column(5).drop_null()
                if shard != shards[lo] or len(slots):
                    if shard != shards[lo]:
                        shard, held = shards[lo], None
                    if len(slots):
                        held = ShardedFilters(0, {0: slots[0].as_py()})
                keys = part.filter(part.column(5).is_null())
                if held is not None and len(keys):
                    yield pa.RecordBatch.from_arrays(list(keys.filter(pa.array(held.hits(keys.column(3).to_numpy(), keys.column(4).to_numpy()))).columns[2:5]), ["doc_id", "hi", "lo"])

    return sorted_.mapInArrow(run, refs.schema)


def clean_text(text: bytes, drop: set[bytes], p: LineParams) -> tuple[int, int, bytes]:
    """Number of lines, number of dropped ones, the text of the others."""
    if not drop:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    kept = [x for x in lines if len(x) < p.min_chars or (k := line_key(x, p.min_chars)) is None or digest(k) not in drop]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


class LineIndex:
    """References, counts and filters under a state folder (a URI that all executors share)."""

    def __init__(self, spark: SparkSession, folder: str, p: LineParams = LineParams()):
        self.spark, self.folder, self.p, self.version, self.bits = spark, folder.rstrip("/"), p, 0, 0
        self._kind: str | None = None

    def _table(self, name: str, version: int) -> DataFrame:
        schema = {"counts": f"hi long, lo long, n_docs long, keeper {self._kind}", "filters": "shard int, slots binary", "refs": f"doc_id {self._kind}, hi long, lo long, sign int"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}-{version:06d}")

    def counts(self) -> DataFrame:
        """hi, lo, n_docs, keeper (the largest id) of every key."""
        return self._table("counts", self.version)

    def common(self) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= self.p.min_docs)

    def filters(self) -> DataFrame:
        return self._table("filters", self.version)

    def refs(self) -> DataFrame:
        """doc_id, hi, lo of the references that no deletion has taken back."""
        if self.version == 1:
            return self._table("refs", 1).select("doc_id", "hi", "lo")
        rows = self._table("refs", 1)
        for v in range(2, self.version + 1):
            rows = rows.unionByName(self._table("refs", v))
        return rows.groupBy("doc_id", "hi", "lo").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def insert(self, docs: DataFrame) -> None:
        """Adds documents (doc_id, text)."""
        self._kind = self._kind or docs.schema["doc_id"].dataType.simpleString()
        new = line_refs(docs, self.p).dropDuplicates()
        if self.version:
            new = new.alias("a").join(self.refs().alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo")), "left_anti")
        self._write("refs", new.withColumn("sign", F.lit(1)))
        added = self._table("refs", self.version + 1).groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if self.version:
            old = self.counts().select("hi", "lo", F.col("n_docs").alias("_n"), F.col("keeper").alias("_k"))
            added = old.join(added, ["hi", "lo"], "full").select("hi", "lo", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "_k").alias("keeper"))
        self._write("counts", added)
        self._next()

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (doc_id) out again: afterwards the index is as if they had never been inserted."""
        live = self.refs()
        gone = live.alias("a").join(ids.select("doc_id").distinct().alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
        self._write("refs", gone.withColumn("sign", F.lit(-1)))
        taken = self._table("refs", self.version + 1)
        touched = taken.groupBy("hi", "lo").agg(F.count("*").alias("_less"))
        left = live.join(touched, ["hi", "lo"], "left_semi").join(taken.select("doc_id", "hi", "lo", F.lit(True).alias("_gone")).alias("t"), live["doc_id"].eqNullSafe(F.col("t.doc_id")) & (live["hi"] == F.col("t.hi")) & (live["lo"] == F.col("t.lo")), "left_anti")
        keepers = left.groupBy(live["hi"], live["lo"]).agg(F.max(live["doc_id"]).alias("_keeper"))
        kept = self.counts().join(touched, ["hi", "lo"], "left").join(keepers, ["hi", "lo"], "left")
        n = F.col("n_docs") - F.coalesce("_less", F.lit(0))
        self._write("counts", kept.select("hi", "lo", n.alias("n_docs"), F.when(F.col("_less").isNull(), F.col("keeper")).otherwise(F.col("_keeper")).alias("keeper")).where("n_docs > 0"))
        self._next()

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}-{self.version + 1:06d}")

    def _next(self) -> None:
        """Filters of the next version: those of the shards in which a key became common or ceased to be are changed,
        the others stay; all are built anew where the number of shards changes."""
        p, before = self.p, self.version
        after = self._table("counts", before + 1).where(F.col("n_docs") >= p.min_docs)
        bits = max(0, (after.count() // p.shard_keys).bit_length())
        rebuilt = not before or bits != self.bits

        def build(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slots": pa.array([CuckooFilter.of(table["lo"].to_numpy()).to_bytes()], pa.binary())})

        def change(key: tuple, old: pa.Table, changes: pa.Table) -> pa.Table:
            """The shard's filter after its changes; null slots ask for building it anew."""
            filter_ = CuckooFilter(np.frombuffer(old["slots"][0].as_py(), np.uint16)) if len(old) else None
            fits = filter_ is not None
            if fits and len(changes):
                signs, keys = changes["sign"].to_pylist(), changes["lo"].to_pylist()
                fits = all([filter_.delete(k) for s, k in zip(signs, keys) if s < 0]) and all(filter_.insert(k) for s, k in zip(signs, keys) if s > 0)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slots": pa.array([filter_.to_bytes() if fits else None], pa.binary())})

        sharded = after.select(shard_of(F.col("hi"), bits).alias("shard"), "lo")
        if rebuilt:
            self._write("filters", sharded.groupBy("shard").applyInArrow(build, "shard int, slots binary"))
        else:
            old, new = self.common().select("hi", "lo"), after.select("hi", "lo")
            became, ceased = new.join(old, ["hi", "lo"], "left_anti"), old.join(new, ["hi", "lo"], "left_anti")
            changes = became.withColumn("sign", F.lit(1)).unionByName(ceased.withColumn("sign", F.lit(-1))).select(shard_of(F.col("hi"), bits).alias("shard"), "lo", "sign")
            changed = checkpoint(self.filters().groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, "shard int, slots binary"))
            anew = sharded.join(changed.where("slots is null").select("shard"), "shard", "left_semi").groupBy("shard").applyInArrow(build, "shard int, slots binary")
            self._write("filters", changed.where("slots is not null").unionByName(anew))
        self.version, self.bits = before + 1, bits

    def hits(self, docs: DataFrame) -> DataFrame:
        """doc_id, hi, lo of the keys of docs that a filter lets through, twice where a row is repeated."""
        size = self.filters().agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
        if size <= self.p.broadcast_bytes:
            return line_refs(docs, self.p, ShardedFilters(self.bits, {r["shard"]: r["slots"] for r in self.filters().collect()}))
        return routed_hits(line_refs(docs, self.p), self.filters(), self.bits, self.p.salts)

    def drops(self, docs: DataFrame) -> DataFrame:
        """doc_id and the digests of its lines that go: keys that a filter lets through and the exact counts confirm."""
        found = self.hits(docs).alias("h").join(self.common().alias("c"), (F.col("h.hi") == F.col("c.hi")) & (F.col("h.lo") == F.col("c.lo")) & ~F.col("h.doc_id").eqNullSafe(F.col("c.keeper")))
        return found.groupBy("h.doc_id").agg(F.collect_set(F.struct("h.hi", "h.lo")).alias("keys")).select(F.col("doc_id").alias("_id"), "keys")

    def clean(self, docs: DataFrame) -> DataFrame:
        """doc_id, text (the lines that stay), n_lines, n_dropped, kept_sha256 of each row of docs."""
        p = self.p
        drops = checkpoint(self.drops(docs))
        size = drops.agg(F.coalesce(F.sum(16 * F.size("keys") + 64), F.lit(0))).first()[0]
        right = F.broadcast(drops) if size <= p.broadcast_bytes else drops.hint("shuffle_merge")
        joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(right, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "keys")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, dropped, kept, sha = [], [], [], []
                for cell, keys in zip(batch.column(1), batch.column(2).to_pylist()):
                    gone = {k["hi"].to_bytes(8, "little", signed=True) + k["lo"].to_bytes(8, "little", signed=True) for k in keys or ()}
                    lines, less, rest = clean_text(_text_bytes(cell), gone, p)
                    n.append(lines)
                    dropped.append(less)
                    kept.append(rest)
                    sha.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return joined.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_dropped long, kept_sha256 string")


def op12_line_dedup(spark: SparkSession, sf_dir: str, p: LineParams = LineParams()) -> DataFrame:
    """All documents, inserted into a new index and cleaned by it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}", p)
    index.insert(docs)
    return index.clean(docs).drop("text")


#: The same rows in DuckDB, by joins on whole keys.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') t, row_number() over () r from documents),
lines as (select r, doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i from d),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
common as (select k, max(doc_id) keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select r, doc_id, i, line, keeper is not null and doc_id <> keeper gone from keyed left join common using (k))
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from marked group by r, doc_id
"""
