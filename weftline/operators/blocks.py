"""Text blocks (non-blank leaf texts) with features, and two-state sequence labelling over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import STOP_WORDS, tokens

from weftline.plans.lineage import checkpoint, few_rows

from .dom import tree_distance

_STOP = sorted({w for ws in STOP_WORDS.values() for w in ws})


def blocks(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, j (place of the block), node_id, text, tag, path, boundary."""
    rows = texts.where("node_id is not null").withColumn("words", tokens(F.col("raw"))).where(F.size("words") > 0)
    own = nodes.select("page_id", "node_id", "tag", "path", "depth")
    j = F.row_number().over(Window.partitionBy("page_id").orderBy("text_id")) - 1
    return rows.join(own, ["page_id", "node_id"]).select("page_id", j.cast("int").alias("j"), "text_id", "node_id", F.trim("raw").alias("text"), "words", "tag", "path", "depth", "boundary")


def block_features(found: DataFrame) -> DataFrame:
    """Named features of each block: its text, its tag, its ancestors and how often its text recurs in the page."""
    n = F.size("words")
    share = lambda test: F.size(F.filter("words", test)) / n
    per_page = Window.partitionBy("page_id")
    duplicates = F.count("*").over(Window.partitionBy("page_id", "text"))
    return found.select(
        "page_id",
        "j",
        "node_id",
        F.array(
            n.cast("double"),
            F.length("text").cast("double"),
            F.length("text") / n,
            share(lambda w: w.rlike(r"[.!?]$")),
            share(lambda w: F.lower(w).isin(_STOP)),
            share(lambda w: w.rlike(r"^\p{Lu}")),
            share(lambda w: w.rlike(r"\d")),
            F.when(F.col("tag") == "a", 1.0).otherwise(0.0),
            F.when(F.col("tag").isin("p", "blockquote", "pre"), 1.0).otherwise(0.0),
            F.when(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6"), 1.0).otherwise(0.0),
            F.when(F.col("tag").isin("li", "td", "dd"), 1.0).otherwise(0.0),
            F.col("depth").cast("double"),
            F.col("boundary").cast("double"),
            (F.col("j") + 1) / F.count("*").over(per_page),
            duplicates.cast("double"),
        ).alias("f"),
    )


def edge_features(found: DataFrame) -> DataFrame:
    """Of each neighbouring pair: tree distance (2, 3, 4 or more), whether a break lies between, and the depth
    of the nearest common ancestor."""
    w = Window.partitionBy("page_id").orderBy("j")
    pairs = found.select("page_id", "j", "path", F.lead("path").over(w).alias("next_path"), F.lead("boundary").over(w).alias("broken")).where("next_path is not null")
    far = tree_distance(F.col("path"), F.col("next_path"))
    common = (F.size("path") + F.size("next_path") - far) / 2
    is_in = lambda c: F.when(c, 1.0).otherwise(0.0)
    return pairs.select("page_id", "j", F.array(is_in(far <= 2), is_in(far == 3), is_in(far == 4), is_in(far > 4), is_in(F.col("broken")), common.cast("double")).alias("f"))


def viterbi(unary: np.ndarray, edge: np.ndarray, weight: float = 1.0) -> list[int]:
    """Best 0/1 labels of n blocks by log scores unary (n, 2) and edge (n - 1, 4) for pairs 00, 01, 10, 11."""
    score, back = np.asarray(unary[0], float), []
    for u, e in zip(unary[1:], edge):
        step = score[:, None] + weight * np.asarray(e, float).reshape(2, 2)
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + u
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def decode(scores: DataFrame, weight: float = 1.0) -> DataFrame:
    """scores (page_id, j, unary array of 2, edge array of 4 to the next block, null at the end) to labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = []
            for page, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                labels = viterbi(np.array([x["unary"] for x in found], float), [x["edge"] for x in found[:-1]], weight)
                rows += [(page, x["j"], label) for x, label in zip(found, labels)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32()])], ["page_id", "j", "label"])

    pages = scores.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("j", "unary", "edge"))).alias("x"))
    return pages.mapInArrow(run, "page_id long, j int, label int")


def label_string(labels: DataFrame) -> DataFrame:
    """Labels of a page as one comma-joined line."""
    grouped = labels.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("j", "label"))).alias("x"))
    return grouped.select("page_id", F.array_join(F.transform("x", lambda v: v["label"].cast("string")), ",").alias("labels"))


def labelled_text(found: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's text from its blocks labelled 1."""
    kept = found.join(labels.where("label = 1").select("page_id", "j"), ["page_id", "j"], "left_semi")
    grouped = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("j", "text"))).alias("t"))
    return grouped.select("page_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def vocabulary(df: DataFrame, words: Column, size: int) -> DataFrame:
    """The `size` most frequent lower-cased words with counts and numbers from 0."""
    counts = df.select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    return top.withColumn("index", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1)


def train_block_classifier(features: DataFrame, labels: DataFrame, trees: int = 32, seed: int = 7):
    """A random forest on block features; labels (page_id, node_id, label 0/1). Returns the fitted MLlib model."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = features.join(labels, ["page_id", "node_id"]).select(array_to_vector("f").alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed).fit(rows)


def classify_blocks(model, features: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = features.select("page_id", "j", "node_id", array_to_vector("f").alias("features"))
    return model.transform(rows).select("page_id", "j", "node_id", vector_to_array("probability")[1].alias("score"))


#: Weights of a block's neighbours, two before to two behind, for smoothing (a Gaussian of deviation 1).
_SMOOTHING = [np.exp(-(k * k) / 2) for k in range(-2, 3)]


def smoothed_ratios(found: DataFrame) -> DataFrame:
    """page_id, j, ratio (ln of one plus characters by the tags since the block before), smooth (Gaussian mean over five
    blocks) and slope (how far the mean of the next three smoothed ratios is from its own)."""
    w = Window.partitionBy("page_id").orderBy("j")  # a page's blocks
    before = F.lag("path").over(w)
    tags = F.when(before.isNull(), F.size("path")).otherwise(tree_distance(F.col("path"), before))
    rows = found.select("page_id", "j", F.ln(1 + F.length("text") / F.greatest(tags, F.lit(1))).alias("ratio"))
    near = [(F.lag("ratio", -k).over(w) if k < 0 else F.lead("ratio", k).over(w), weight) for k, weight in zip(range(-2, 3), _SMOOTHING)]
    total = sum((F.coalesce(c * weight, F.lit(0.0)) for c, weight in near), F.lit(0.0))
    weights = sum((F.when(c.isNotNull(), weight).otherwise(0.0) for c, weight in near), F.lit(0.0))
    rows = rows.withColumn("smooth", total / weights)
    ahead = F.avg("smooth").over(w.rowsBetween(1, 3))
    return rows.withColumn("slope", F.abs(F.coalesce(ahead, F.col("smooth")) - F.col("smooth")))


def kmeans(rows: DataFrame, columns: list[str], centres: list[list[float]], rounds: int = 10) -> list[list[float]]:
    """Centres after `rounds` steps of Lloyd's; the first stays where it is. Each step sums up the rows by their centre; only
    the sums reach the driver."""
    centres = [list(c) for c in centres]
    for _ in range(rounds):
        own = rows.select(nearest_centre([F.col(c) for c in columns], centres).alias("c"), *columns)
        moved = False
        for r in own.groupBy("c").agg(*[F.avg(c).alias(c) for c in columns]).collect():
            if r["c"]:
                new = [r[c] for c in columns]
                moved |= new != centres[r["c"]]
                centres[r["c"]] = new
        if not moved:
            break
    return centres


def nearest_centre(values: list[Column], centres: list[list[float]]) -> Column:
    """The number of the nearest centre, of equals the first."""
    far = F.array(*[sum(((v - c) * (v - c) for v, c in zip(values, centre)), F.lit(0.0)) for centre in centres])
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def with_clusters(found: DataFrame, features: DataFrame) -> DataFrame:
    """The features with three more numbers (ratio, smooth, slope) and a one-hot of three clusters of (smooth, slope), whose
    first has the origin as its centre: blocks of short texts between many tags."""
    rows = checkpoint(smoothed_ratios(found))
    start = rows.agg(*[F.percentile_approx(c, q, 10_000).alias(f"{c}{k}") for c in ("smooth", "slope") for k, q in ((1, 0.5), (2, 0.95))]).first()
    centres = [[0.0, 0.0], *([start[f"smooth{k}"] or 0.0, start[f"slope{k}"] or 0.0] for k in (1, 2))]
    centres = kmeans(rows, ["smooth", "slope"], centres)
    own = nearest_centre([F.col("smooth"), F.col("slope")], centres)
    more = F.concat(F.array("ratio", "smooth", "slope"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == own, 1.0).otherwise(0.0)))
    return features.join(rows.select("page_id", "j", more.alias("_more")), ["page_id", "j"]).withColumn("f", F.concat("f", "_more")).drop("_more")
