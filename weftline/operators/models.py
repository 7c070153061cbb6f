"""Classifiers that stand where the page and leaf models stood: hashed counts with MLlib."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import checkpoint

from .sampling import kfold


def counts_of(df: DataFrame, key: list[str], words: Column, dim: int) -> DataFrame:
    """key and `features`: hashed counts of words as a sparse vector."""
    from pyspark.ml.feature import HashingTF

    return HashingTF(inputCol="_words", outputCol="features", numFeatures=dim).transform(df.select(*key, words.alias("_words"))).drop("_words")


def leaf_features(found: DataFrame, dim: int = 1024) -> DataFrame:
    """Blocks by hashed words and tags on their path: page_id, j, node_id, features."""
    words = F.concat(F.transform("words", lambda w: F.lower(w)), F.transform(F.sequence(F.lit(1), F.col("depth") + 1), lambda d: F.concat(F.lit("<"), F.col("tag"), d.cast("string"))))
    return counts_of(found, ["page_id", "j", "node_id"], words, dim)


def train_logistic(rows: DataFrame, max_iter: int = 20):
    """A logistic regression on `features` and `label`."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=max_iter, regParam=0.01).fit(rows)


def cross_validate(rows: DataFrame, key: str, label: str, folds: int = 3, seed: int = 0) -> DataFrame:
    """rows (key, label, features) to fold, key, label, prediction: each fold judged by the others' model."""
    rows = checkpoint(rows)  # dealing them ranks them, which would make their features twice: once for a sample of the ranks
    dealt = checkpoint(kfold(rows, key, label, folds, seed))
    out = None
    for k in range(folds):
        model = train_logistic(dealt.where(F.col("fold") != k).select("features", F.col(label).cast("double").alias("label")))
        judged = model.transform(dealt.where(F.col("fold") == k)).select("fold", key, F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
        out = judged if out is None else out.unionByName(judged)
    return out
