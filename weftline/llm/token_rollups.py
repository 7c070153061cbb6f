"""Token counts kept up to date by deltas.

A batch of changes has a row for each document and tokenizer version: an insert (no old count), a delete (no
new count) or a revision (both). Its signed sums by source, language and tokenizer are written to a folder
of the batch's own below the state folder; totals are the sums over all committed batches, or over the newest
snapshot (`compact`) and the batches after it. A batch is committed by renaming its finished folder: committing it
again does nothing, of two writers one wins, and what a broken commit left is never read. So totals are the same
however often a batch is sent.

Defined cases: a null or empty text has no tokens but is a document; null sources, languages and ids are
groups and documents like others; repeated rows count each; a change with neither count adds nothing; an
empty batch commits; totals without any batch are empty; very long texts and runs of white space are counted whole.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpoint, ensure_checkpoint_dir, read

KEYS = ("source", "lang", "tokenizer")
#: The published split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Long runs of what \s matches; the pattern's search overflows its stack on one of some million.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


_SNAPSHOT = _SUMS + ", batches array<string>"


@dataclass(frozen=True)
class TokenParams:
    ranks_path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN


_encodings: dict = {}


def _encoding(ranks: dict[bytes, int], p: TokenParams):
    if p not in _encodings:
        import tiktoken

        _encodings[p] = tiktoken.Encoding("weftline", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[p]


def n_tokens(encoding, text: str, pattern: str = PATTERN, long_space: int = 1 << 16) -> int:
    """Tokens of a whole text. With the published pattern, runs of at least `long_space` white-space characters are
    cut out first just as the pattern would: all but the run's last character are one piece, and that one goes with
    what follows; at the text's end the whole run is."""
    if pattern != PATTERN or len(text) < long_space:
        return len(encoding.encode_ordinary(text))
    n = done = 0
    for run in re.finditer(f"[{_SPACE}]{{{long_space},}}", text):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[done : run.start()])) + len(encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        done = end
    return n + len(encoding.encode_ordinary(text[done:]))


def count_tokens(docs: DataFrame, p: TokenParams = TokenParams(), text_column: str = "text") -> DataFrame:
    """doc_id, source, lang, n_words (runs of anything but white space) and n_bpe; a narrow pass."""
    with open(p.ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(held.value, p)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            words = [len(WORD.findall(t or "")) for t in texts]
            bpe = [n_tokens(encoding, t, p.pattern) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.int64()), pa.array(bpe, pa.int64())], ["doc_id", "source", "lang", "n_words", "n_bpe"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "lang", text_column).mapInArrow(run, f"doc_id {kind}, source string, lang string, n_words long, n_bpe long")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (source, lang, tokenizer, old_count, new_count)."""
    old, new = F.col("old_count"), F.col("new_count")
    return changes.groupBy(*KEYS).agg(
        F.sum(new.isNotNull().cast("long") - old.isNotNull().cast("long")).alias("n_docs"),
        F.sum(F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("n_tokens"),
    )


class Rollup:
    """Totals by source, language and tokenizer version under a state folder (a URI that all executors share)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.folder}/batch={batch_id}"

    def is_committed(self, batch_id: str) -> bool:
        path, system = self._path(f"{self._batch(batch_id)}/_SUCCESS")
        return system.exists(path)

    def _publish(self, rows: DataFrame, target: str) -> bool:
        """Writes rows beside `target` and renames the folder, which fails where another writer was first."""
        draft = f"{self.folder}/draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        source, _ = self._path(draft)
        path, system = self._path(target)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(system.makeQualified(source), system.makeQualified(path), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            system.delete(source, True)
            return False

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already, also where two writers race."""
        return not self.is_committed(batch_id) and self._publish(deltas(changes), self._batch(batch_id))

    def _folders(self, prefix: str) -> list[str]:
        path, system = self._path(self.folder)
        names = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def batches(self) -> list[str]:
        return [x for x in self._folders("batch=") if self.is_committed(x)]

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest snapshot's folder and the batches that it holds."""
        numbers = self._folders("snapshot=")
        if not numbers:
            return None, set()
        folder = f"{self.folder}/snapshot={numbers[-1]}"
        return folder, {r["batch"] for r in self.spark.read.schema(_SNAPSHOT).parquet(folder).select(F.explode("batches").alias("batch")).collect()}

    def _sums(self) -> tuple[DataFrame, list[str]]:
        folder, held = self._snapshot()
        batches = self.batches()
        rows = self.spark.read.schema(_SNAPSHOT).parquet(folder).where("tokenizer is not null").drop("batches") if folder else self.spark.createDataFrame([], _SUMS)
        fresh = [self._batch(x) for x in batches if x not in held]
        if fresh:
            rows = rows.unionByName(self.spark.read.schema(_SUMS).parquet(*fresh))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), batches

    def compact(self) -> None:
        """Writes the sums of all batches so far as a snapshot; totals read it and the batches after it. A row
        without keys has the batches' ids; the batches' folders stay, as marks that they are committed."""
        sums, batches = self._sums()
        marks = self.spark.createDataFrame([(None, None, None, None, None, batches)], _SNAPSHOT)
        number = int((self._folders("snapshot=") or ["0"])[-1]) + 1
        self._publish(sums.withColumn("batches", F.lit(None).cast("array<string>")).unionByName(marks), f"{self.folder}/snapshot={number:09d}")

    def totals(self) -> DataFrame:
        return self._sums()[0].where("n_docs <> 0 or n_tokens <> 0")


def op8_token_rollups(spark: SparkSession, sf_dir: str, p: TokenParams = TokenParams()) -> DataFrame:
    """Totals after four batches over all documents, each sent twice: inserts counted in words; inserts
    counted in byte pairs; the word counts revised to leave one for a text's end; and deletes of the
    documents that a label marks as bad."""
    counted = checkpoint(count_tokens(read(spark, sf_dir, "documents"), p))
    bad = read(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    change = lambda rows, tokenizer, old, new: rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), old.cast("long").alias("old_count"), new.cast("long").alias("new_count"))
    none, words, bpe = F.lit(None), F.col("n_words"), F.col("n_bpe")
    gone = counted.join(bad, "doc_id", "left_semi")
    batches = {
        "1-words": change(counted, "words@1", none, words),
        "2-bpe": change(counted, "byte_bpe_50k@1", none, bpe),
        "3-words-end": change(counted, "words@1", words, words + 1),
        "4-bad": change(gone, "words@1", words + 1, none).unionByName(change(gone, "byte_bpe_50k@1", bpe, none)),
    }
    rollup = Rollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        for batch_id, changes in batches.items():
            rollup.commit(batch_id, changes)
    return rollup.totals()
