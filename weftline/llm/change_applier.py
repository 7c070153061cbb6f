"""Numbered changes of clients, applied in order by a stateful stream that keeps what came too early in pages.

A client's changes carry numbers 1, 2, ...; they arrive in batches, by day, with gaps. A change that is not yet due is
held; the one whose number is next is applied, and so are those held right behind it. What is held too long lets its
client skip the gap: at a batch's start, while a client's earliest held day is `patience` days or more before all clients'
largest day of earlier batches, its next number jumps to its smallest held one. After the last batch all gaps are skipped.

State is a stream's own (`transformWithStateInPandas` over the RocksDB store). Clients are dealt into buckets of some
`bucket_clients` each, so that a call serves many small clients. A bucket has
* `heads`: next number, smallest held number, number of held rows, city and balance of each client, one Arrow blob;
* `pages`: held rows by number // `page_size`, an Arrow blob a page;
* `days`: the smallest day of each page, so that pages which no gap makes due are never loaded.
A batch loads the pages that its rows or its jumps touch; a client with millions of held rows costs only those, and no
more than `open_pages` are in memory at once. Day and watermark are Spark's event time: with no delay the watermark
of a batch is the largest day of the batches before it, and a timer at a bucket's earliest page day wakes buckets without rows.

Numbers are dense ranks, found by range partitions and one count a partition and client, without a window over one
client's rows. A client's rows of one batch are one task's work, a chunk of Arrow at a time.

Defined cases: repeated rows count once; rows without a day (or without a change id, which the day needs) are numbered
but never arrive; a null client is a client; a null number comes before all others; of rows with one number the one
with the smallest day, change id, operation, city and balance counts, nulls first, and the others are rejected; an
unknown or null operation is applied and changes nothing; NaN and infinite balances are null; an empty table gives no
rows; days before `first_day` are in batch 1, and all clients' largest day is never before 1970. Only the named columns are read, beside the test for repeated rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import checkpoint, ensure_checkpoint_dir, read

DAY_MS = 86_400_000
#: The day of the last batch's extra row, after which everything held is due (2260-03-22; pandas' times end in 2262).
FAR_DAY = 106_000


@dataclass(frozen=True)
class ApplierParams:
    batches: int = 12
    first_day: int = 19723
    span_days: int = 160
    patience: int = 3
    page_size: int = 256
    bucket_clients: int = 128
    open_pages: int = 256


_ARRIVING = "bucket long, client string, change_id long, n long, day long, at timestamp, op string, city string, balance double"
_APPLIED = "change_id long, client string, n long, op string, status string, batch int, missed long, city string, cents long"
_PAGE = pa.schema([("client", pa.string()), ("n", pa.int64()), ("day", pa.int64()), ("change_id", pa.int64()), ("op", pa.string()), ("city", pa.string()), ("balance", pa.float64())])
_HEAD = pa.schema([("client", pa.string()), ("next", pa.int64()), ("low", pa.int64()), ("held", pa.int64()), ("city", pa.string()), ("balance", pa.float64())])


def to_blob(rows: list[tuple], schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema))
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> Iterator[tuple]:
    table = pa.ipc.open_stream(blob).read_all()
    return zip(*(c.to_pylist() for c in table.columns))


def _order(row: tuple) -> tuple:
    """Of two rows (day, change id, op, city, balance) with one number, the one that comes first."""
    return row[:2] + tuple((x is not None, x if x is not None else 0) for x in row[2:])


class PagedBucket:
    """The clients of one bucket during one call: heads, and pages that are loaded when touched."""

    def __init__(self, heads: dict[str, list], days: dict[int, int], load, store, drop, p: ApplierParams):
        self.heads, self.days, self.p = heads, days, p
        self._load, self._store, self._drop = load, store, drop
        self._open: dict[int, dict[str, dict[int, tuple]]] = {}
        self._dirty: set[int] = set()

    def page(self, number: int) -> dict[str, dict[int, tuple]]:
        held = self._open.get(number)
        if held is None:
            if len(self._open) >= self.p.open_pages:
                self.save()
            held = {}
            if number in self.days:
                for client, n, *row in from_blob(self._load(number)):
                    held.setdefault(client, {})[n] = tuple(row)
            self._open[number] = held
        return held

    def save(self) -> None:
        """Writes the pages that changed and closes all."""
        for number in sorted(self._dirty):
            rows = [(c, n, *row) for c, by_n in self._open[number].items() for n, row in by_n.items()]
            if rows:
                self.days[number] = min(r[2] for r in rows)
                self._store(number, self.days[number], to_blob(rows, _PAGE))
            elif self.days.pop(number, None) is not None:
                self._drop(number)
        self._open.clear()
        self._dirty.clear()

    def hold(self, client: str, n: int, row: tuple) -> tuple | None:
        """Holds a row; returns the one that it rejects, itself or a later one with its number, if any."""
        head = self.heads.setdefault(client, [1, None, 0, None, None])
        if n < head[0]:
            return row
        number = n // self.p.page_size
        by_n = self.page(number).setdefault(client, {})
        other = by_n.get(n)
        if other is not None and _order(other) <= _order(row):
            return row
        by_n[n] = row
        self._dirty.add(number)
        if other is None:
            head[2] += 1
            head[1] = n if head[1] is None else min(head[1], n)
        return other

    def _lowest(self, client: str, least: int) -> int | None:
        """The client's smallest held number, known to be `least` or more."""
        for number in sorted(k for k in {*self.days, *self._open} if k >= least // self.p.page_size):
            by_n = self.page(number).get(client)
            if by_n:
                return min(by_n)
        return None

    def due(self, horizon: float) -> dict[str, int]:
        """Clients whose earliest held day is old enough, with the largest number of such a row. Only pages with such a
        day are loaded."""
        found: dict[str, int] = {}
        for number in sorted(k for k, day in self.days.items() if day + self.p.patience <= horizon):
            for client, by_n in self.page(number).items():
                old = [n for n, row in by_n.items() if row[0] + self.p.patience <= horizon]
                if old:
                    found[client] = max(found.get(client, 0), *old)
        return found

    def walk(self, client: str, jump_to: int = 0) -> Iterator[tuple]:
        """Applies the client's held rows in order while they are next, or have a number of `jump_to` at most: all of
        these go, since a gap before any of them is skipped too."""
        head = self.heads[client]
        while head[1] is not None and (head[1] == head[0] or head[1] <= jump_to):
            n = head[1]
            number = n // self.p.page_size
            page = self.page(number)
            by_n = page[client]
            day, change_id, op, city, balance = by_n.pop(n)
            self._dirty.add(number)
            missed = n - head[0]
            head[0], head[2] = n + 1, head[2] - 1
            if op == "D":
                head[3] = head[4] = None
            elif op == "I":
                head[3], head[4] = city, balance
            elif op == "U":
                head[3], head[4] = head[3] if city is None else city, head[4] if balance is None else balance
            yield change_id, client, n, op, "applied", missed, head[3], None if head[4] is None else math.floor(100 * head[4] + 0.5)
            if not by_n:
                del page[client]
            head[1] = None if not head[2] else n + 1 if n + 1 in by_n else self._lowest(client, n + 1)


class _Applier(StatefulProcessor):
    """One batch of the stream; started anew for each, on the state that the batches before it left."""

    def __init__(self, batch: int, p: ApplierParams):
        self.batch, self.p = batch, p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "clients binary")
        self.pages = handle.getMapState("pages", "page long", "held binary")
        self.days = handle.getMapState("days", "page long", "day long")
        self.alarm = handle.getValueState("alarm", "at long")

    def _bucket(self) -> PagedBucket:
        heads = {c: list(x) for c, *x in from_blob(self.heads.get()[0])} if self.heads.exists() else {}
        days = {k[0]: v[0] for k, v in self.days.iterator()}

        def store(number: int, day: int, blob: bytes) -> None:
            self.pages.updateValue((number,), (blob,))
            self.days.updateValue((number,), (day,))

        def drop(number: int) -> None:
            self.pages.removeKey((number,))
            self.days.removeKey((number,))

        return PagedBucket(heads, days, lambda number: self.pages.getValue((number,))[0], store, drop, self.p)

    def _close(self, bucket: PagedBucket) -> None:
        bucket.save()
        if bucket.heads:
            self.heads.update((to_blob([(c, *x) for c, x in bucket.heads.items()], _HEAD),))
        wanted = min(min(bucket.days.values()) + self.p.patience, FAR_DAY) * DAY_MS - 1 if bucket.days else None
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if wanted != now:
            if now is not None:
                self.handle.deleteTimer(now)
            if wanted is None:
                self.alarm.clear()
            else:
                self.handle.registerTimer(wanted)
                self.alarm.update((wanted,))

    def _frames(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) >= 10_000:
                yield self._frame(held)
                held = []
        if held:
            yield self._frame(held)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        change_id, client, n, op, status, missed, city, cents = map(list, zip(*rows))
        return pd.DataFrame({"change_id": change_id, "client": client, "n": n, "op": op, "status": status, "batch": pd.Series([self.batch] * len(rows), dtype="int32"), "missed": missed, "city": pd.Series(city, dtype=object), "cents": pd.array(cents, dtype="Int64")})

    def _jumps(self, bucket: PagedBucket, horizon: int) -> Iterator[tuple]:
        for client, most in bucket.due(math.inf if horizon >= FAR_DAY else horizon).items():
            yield from bucket.walk(client, most)

    def _arrivals(self, bucket: PagedBucket, chunks: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        touched: dict[str, None] = {}
        for chunk in chunks:
            columns = [pa.Array.from_pandas(chunk[f.name], type=f.type).to_pylist() for f in _PAGE]
            for client, n, *row in sorted(zip(*columns), key=lambda r: (r[1] // self.p.page_size, r[0])):
                if n < 1:  # the row that ends the last batch
                    continue
                rejected = bucket.hold(client, n, tuple(row))
                if rejected is not None:
                    yield rejected[1], client, n, rejected[2], "rejected", 0, None, None
                touched[client] = None
        for client in touched:
            yield from bucket.walk(client)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket, horizon = self._bucket(), timerValues.getCurrentWatermarkInMs() // DAY_MS
        yield from self._frames(self._jumps(bucket, horizon))
        yield from self._frames(self._arrivals(bucket, rows))
        self._close(bucket)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket, horizon = self._bucket(), timerValues.getCurrentWatermarkInMs() // DAY_MS
        if self.alarm.exists() and self.alarm.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.alarm.clear()
        yield from self._frames(self._jumps(bucket, horizon))
        self._close(bucket)

    def close(self) -> None:
        pass


def numbered(changes: DataFrame) -> DataFrame:
    """Distinct rows with `n`, the dense rank of seq within client_id, from range partitions of (client_id, seq): a
    partition ranks its own rows, and the ranks that a client has used in earlier partitions are added."""
    part = F.spark_partition_id()
    dealt = checkpoint(changes.dropDuplicates().repartitionByRange("client_id", "seq").withColumn("_part", part))
    own = dealt.withColumn("_rank", F.dense_rank().over(Window.partitionBy("_part", "client_id").orderBy("seq")))
    used = dealt.groupBy("_part", "client_id", "seq").agg(F.lit(1).alias("one")).groupBy("_part", "client_id").agg(F.count("one").alias("_used"))
    earlier = Window.partitionBy("client_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = used.select(F.col("_part").alias("_p"), F.col("client_id").alias("_c"), F.coalesce(F.sum("_used").over(earlier), F.lit(0)).alias("_before")).where("_before > 0")
    joined = own.join(before, (F.col("_part") == F.col("_p")) & F.col("client_id").eqNullSafe(F.col("_c")), "left")
    return joined.withColumn("n", F.col("_rank") + F.coalesce(F.col("_before"), F.lit(0))).drop("_part", "_rank", "_p", "_c", "_before")


def arriving(changes: DataFrame, p: ApplierParams = ApplierParams()) -> DataFrame:
    """The rows that arrive, with their day and batch: numbered first, then without those that get lost."""
    h = F.crc32(F.col("change_id").cast("string"))
    day = (F.unix_date(F.col("valid_at").cast("date")) + 9 * (h % 4)).cast("long")
    batch = F.greatest(F.lit(1), F.least(F.lit(p.batches), (1 + F.floor((day - p.first_day) * p.batches / p.span_days)).cast("int")))
    balance = F.when(F.isnan("balance") | (F.abs("balance") == float("inf")), None).otherwise(F.col("balance"))
    kept = numbered(changes).where(F.col("valid_at").isNotNull() & (h % 11 != 0))
    client = F.coalesce(F.col("client_id").cast("string"), F.lit(""))
    return kept.select(client.alias("client"), F.col("change_id").cast("long").alias("change_id"), "n", day.alias("day"), F.timestamp_seconds(F.greatest(F.lit(0), F.least(day, F.lit(FAR_DAY - 1))) * 86400).alias("at"), "op", "city", balance.cast("double").alias("balance"), batch.alias("batch"))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the plans started within; those before it come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each start has stores of its own, which else stay open and on disk
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class ChangeStream:
    """A folder with the batches that have arrived, the stream's checkpoint and its results. `feed` hands over a batch
    and starts the stream once, until it has taken all that is there."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, p: ApplierParams = ApplierParams()):
        self.spark, self.folder, self.buckets, self.p, self.fed = spark, folder.rstrip("/"), max(1, buckets), p, 0

    def _rename(self, source: str, target: str) -> None:
        jvm = self.spark._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        system = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(new.getParent())
        if not system.rename(old, new):
            raise OSError(f"{source} was not moved to {target}")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def stage(self, rows: DataFrame) -> None:
        """Writes all rows, a folder a batch, in files of even size."""
        bucket = F.pmod(F.xxhash64("client"), F.lit(self.buckets))
        rows.withColumn("bucket", bucket).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{self.folder}/staged")

    def feed(self, batch: int) -> None:
        staged, arrived = f"{self.folder}/staged/batch={batch}", f"{self.folder}/arrived/{batch:06d}"
        if self._exists(staged):
            self._rename(staged, arrived)
        else:
            self.spark.createDataFrame([], _ARRIVING).write.parquet(arrived)
        if batch == self.p.batches:  # moves the watermark of what follows beyond every day
            last = self.spark.range(1).select(F.lit(0).cast("long").alias("bucket"), F.lit("").alias("client"), F.lit(-1).cast("long").alias("change_id"), F.lit(-1).cast("long").alias("n"), F.lit(FAR_DAY).cast("long").alias("day"), F.timestamp_seconds(F.lit(FAR_DAY).cast("long") * 86400).alias("at"), *(F.lit(None).cast(t).alias(c) for c, t in (("op", "string"), ("city", "string"), ("balance", "double"))))
            last.write.mode("append").parquet(arrived)
        with _settings(self.spark, _STATE):
            source = self.spark.readStream.schema(_ARRIVING).parquet(f"{self.folder}/arrived/*").withWatermark("at", "0 seconds")
            results = source.groupBy("bucket").transformWithStateInPandas(_Applier(batch, self.p), _APPLIED, "append", "eventTime")
            sink = results.writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/results").option("checkpointLocation", f"{self.folder}/checkpoint")
            query = sink.trigger(availableNow=True).start()
        query.awaitTermination()
        self.fed = batch

    def results(self) -> DataFrame:
        return self.spark.read.schema(_APPLIED).parquet(f"{self.folder}/results")


def apply_changes(spark: SparkSession, changes: DataFrame, folder: str, p: ApplierParams = ApplierParams()) -> DataFrame:
    """A row for each change that arrives: change_id, client_id, status, batch, missed, city, cents, current, n."""
    kind = changes.schema["client_id"].dataType
    rows = checkpoint(arriving(changes, p))
    clients = rows.agg(F.approx_count_distinct("client")).first()[0]
    stream = ChangeStream(spark, folder, -(-clients // p.bucket_clients), p)
    stream.stage(rows)
    for batch in range(1, p.batches + 2):
        stream.feed(batch)
    done = stream.results()
    final = done.where("status = 'applied'").groupBy("client").agg(F.max("n").alias("n")).withColumn("_last", F.lit(True))
    current = (F.col("status") == "applied") & F.coalesce(F.col("_last"), F.lit(False)) & (F.coalesce(F.col("op"), F.lit("")) != "D")
    client = F.when(F.col("client") != "", F.col("client")).cast(kind)
    return done.join(final, ["client", "n"], "left").select("change_id", client.alias("client_id"), "status", "batch", "missed", "city", "cents", current.alias("current"), "n")


def op13_change_applier(spark: SparkSession, sf_dir: str, p: ApplierParams = ApplierParams()) -> DataFrame:
    """All changes of `client_changes`, in twelve batches."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/changes-{uuid.uuid4().hex}"
    return apply_changes(spark, read(spark, sf_dir, "client_changes"), folder, p)
