"""Writers: sharded tables, graphs, labels, folds, texts, offsets, committed batches, newest weights."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sharded(df: DataFrame, path: str, shards: int, mode: str = "errorifexists") -> None:
    """`shards` files of about equal size."""
    df.repartition(shards).write.mode(mode).option("compression", "gzip").parquet(path)


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "errorifexists") -> None:
    """A folder for each value: folds, splits, classes or index files."""
    df.write.mode(mode).partitionBy(*columns).parquet(path)


def write_texts(df: DataFrame, path: str, key: str, text: str, mode: str = "errorifexists") -> None:
    """A folder a key with its text; line breaks stay as they are."""
    df.select(key, F.col(text).alias("value")).write.mode(mode).partitionBy(key).text(path)


def write_rows(df: DataFrame, path: str, columns: list[Column], mode: str = "errorifexists") -> None:
    """CSV rows of plain columns, arrays laid out flat."""
    cells = [F.when(F.lit(True), c) for c in columns]
    df.select(F.concat_ws(",", *cells).alias("value")).write.mode(mode).text(path)


def write_labels(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """page_id, labels as comma-joined 0 and 1."""
    df.select(F.concat_ws("\t", "page_id", "labels").alias("value")).write.mode(mode).text(path)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON row a page: its nodes and edges."""
    n = nodes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "tag", "parent_id"))).alias("nodes"))
    e = edges.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "type_id"))).alias("edges"))
    n.join(e, "page_id", "left").write.mode(mode).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("filename", "url", "grp").write.mode(mode).option("sep", "|").csv(path)


def feature_offsets(lengths: dict[str, int]) -> dict[str, dict[str, int]]:
    """Place and length of each named feature in the flat vector, in order."""
    out, at = {}, 0
    for name, n in lengths.items():
        out[name] = {"idx": at, "len": n}
        at += n
    return out


def without_feature(offsets: dict[str, dict[str, int]], name: str) -> dict[str, dict[str, int]]:
    return {k: v for k, v in offsets.items() if k != name}


def config_text(graph: dict, lengths: dict[str, int]) -> str:
    """The metadata that goes with a feature table: graph parameters, feature size and offsets."""
    return json.dumps({"graph_params": graph, "feature_desc": {"feature_size": sum(lengths.values()), "offsets": feature_offsets(lengths)}}, indent=2)


def _system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Batches below `folder` that carry Spark's commit mark."""
    path, system = _system(spark, folder)
    if not system.exists(path):
        return []
    names = sorted(x.getPath().getName() for x in system.listStatus(path) if x.isDirectory())
    return [n for n in names if system.exists(_system(spark, f"{folder}/{n}/_SUCCESS")[0])]


def commit_batch(df: DataFrame, folder: str, batch: str) -> bool:
    """Writes a batch once; a batch that is committed already is left alone, one that broke off is replaced."""
    if batch in committed(df.sparkSession, folder):
        return False
    df.write.mode("overwrite").parquet(f"{folder}/{batch}")
    return True


def read_committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    names = committed(spark, folder)
    return spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def newest(files: DataFrame, path: str = "path") -> DataFrame:
    """The file whose name ends in the largest number of milliseconds (..._<ms>.<ext>)."""
    ms = F.regexp_extract(path, r"(\d+)\.[^./]*$", 1).try_cast("bigint")
    return files.agg(F.max_by(path, F.struct(ms, F.col(path))).alias(path))


def resume(todo: DataFrame, done: DataFrame, key: str, run: Callable[[DataFrame], None]) -> None:
    """Runs what is not done yet."""
    run(todo.join(done.select(key), key, "left_anti"))
