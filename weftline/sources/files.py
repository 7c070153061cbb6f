"""File scans: pages, class folders, gold texts, lists, element properties, feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import decode_text
from weftline.operators.scoring import stem


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_pages(spark: SparkSession, paths: str | list[str], pattern: str = "*.html", recursive: bool = False) -> DataFrame:
    """path, name, stem, html of page files; bytes are decoded by decode_text."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.load(paths)
    name = file_name(F.col("path"))
    return rows.select("path", name.alias("name"), stem(name).alias("stem"), decode_text(F.col("content")).alias("html"))


def read_classes(spark: SparkSession, folder: str, pattern: str = "*.htm*") -> DataFrame:
    """Pages in folders named for their class: as read_pages, with label and label_id (from 0, by name)."""
    rows = read_pages(spark, folder, pattern, recursive=True).withColumn("label", F.element_at(F.split("path", "/"), -2))
    classes = rows.select("label").distinct().withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)
    return rows.join(F.broadcast(classes), "label")  # one row a class folder


def read_gold(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    return read_pages(spark, folder, pattern).select("stem", F.col("html").alias("text"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """`value`: trimmed, non-empty lines: tags, ids of a split, or processed files."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of filename | url | grp."""
    return spark.read.option("sep", "|").schema("filename string, url string, grp string").csv(path)


def read_element_properties(spark: SparkSession, path: str) -> DataFrame:
    """Element properties of a page as JSON {attributeNames, elements}: path, element, properties (a map).
    Names of the bounding rectangle's parts get the prefix BoundingClientRect_."""
    schema = "attributeNames array<string>, elements map<string, array<string>>"
    rows = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("r"))
    rect = ["x", "y", "width", "height", "top", "right", "bottom", "left"]
    names = F.transform("r.attributeNames", lambda n: F.when(n.isin(rect), F.concat(F.lit("BoundingClientRect_"), n)).otherwise(n))
    return rows.select("path", names.alias("names"), F.explode("r.elements").alias("element", "vals")).select("path", "element", F.map_from_arrays("names", F.slice(F.concat("vals", F.array_repeat(F.lit(None).cast("string"), 256)), 1, F.size("names"))).alias("properties"))


def read_feature_rows(spark: SparkSession, path: str, lead: int = 2) -> DataFrame:
    """CSV rows of `lead` leading numbers, then features: head array, f array."""
    values = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), values.alias("v")).where(F.size("v") > lead)
    return rows.select("path", F.slice("v", 1, lead).alias("head"), F.slice("v", F.lit(lead + 1), F.size("v")).alias("f"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines of (gzipped) crawl-index files with their file and place: file, line_no (from 0), value. A file that ends
    in mid-air gives the lines before its end. A file may be read in several splits, in any order: lines are numbered within a
    split and the splits of a file before it are added up."""
    rows = spark.read.option("ignoreCorruptFiles", "true").text(path)
    start = F.col("_metadata.file_block_start")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), start.alias("_start"), "value", F.monotonically_increasing_id().alias("_m"))
    splits = rows.groupBy("file", "_start").agg(F.min("_m").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    placed = splits.select("file", "_start", "_low", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(placed, ["file", "_start"]).select("file", (F.col("_m") - F.col("_low") + F.col("_before")).alias("line_no"), "value")
