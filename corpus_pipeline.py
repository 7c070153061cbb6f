"""A corpus pipeline: quality rules, quality classifier, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. Counts and models are gathered from the docs that the stage is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, mil_classifier, near_dedup, pieces, quality_rules
from weftline.llm.common import checkpoint, ensure_checkpoint_dir, read, replayable


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the likelihood ratio."""
    table = quality_rules.fit_ratio(docs, quality_rules.trusted_labels(read(spark, sf_dir, "labels")))
    return quality_rules.keep_good(docs, table)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from labelled rows of the whole table, since the
    rules before it leave hardly a bad example; labels of held-out rows are not learned from."""
    model = mil_classifier.fit_mil(read(spark, sf_dir, "documents"), mil_classifier.training_labels(read(spark, sf_dir, "labels")))
    return mil_classifier.keep_predicted(docs, model)


#: Dropped rows up to which the near-dedup stage broadcasts their numbers (8 bytes each); beyond, it shuffles.
BROADCAST_ROWS = 1 << 20


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each class of texts whose five-word shingles have a Jaccard similarity of
    0.8 or more, proposed by SimHash fingerprints in BK-trees and by MinHash bands. Of repeated rows one stays; a row
    without an id stays only where its class has none with one; empty texts are one class. Classes are found by row
    numbers, so that no text is shuffled while few rows go."""
    docs = replayable(docs)
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    classes = near_dedup.near_duplicates(numbered.select(order.alias("place"), "text"), id_column="place")
    gone = checkpoint(classes.where("place <> component_id").select(F.col("place.row").alias("_row")))
    few = gone.count() <= BROADCAST_ROWS
    return numbered.join(F.broadcast(gone) if few else gone.hint("shuffle_merge"), "_row", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, a row for each document or chunk of a long one."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can express neither the hashes, the network nor the alignment; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
