"""Extracted text against gold text: joins, bag-of-words and alignment scores, node and block scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import tokens
from weftline.plans.lineage import checkpoint, few_rows, spread

from . import markup


def stem(name: Column) -> Column:
    """A file's key: what stands before the first dot, then before the first dash."""
    return F.substring_index(F.substring_index(name, ".", 1), "-", 1)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last in order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def match_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side with their status: matched, left_only or right_only."""
    a, b = left.select(F.col(key)).distinct(), right.select(F.col(key).alias("_key")).distinct()
    both = a.join(b, F.col(key) == F.col("_key"), "full_outer")
    status = F.when(F.col("_key").isNull(), "left_only").when(F.col(key).isNull(), "right_only").otherwise("matched")
    return both.select(F.coalesce(key, "_key").alias(key), status.alias("status"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def set_confusion(pred: Column, gold: Column) -> dict[str, Column]:
    """Counts over distinct words, row by row."""
    p, g = F.array_distinct(tokens(pred)), F.array_distinct(tokens(gold))
    tp = F.size(F.array_intersect(p, g))
    return {"tp": tp, "fp": F.size(p) - tp, "fn": F.size(g) - tp}


def multiset_confusion(df: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """Counts over words with their multiplicity: key, tp, fp, fn, one row a row of `df`, in a narrow pass: no word leaves its
    row, so the rows of one key, if there are several, are counted apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = []
            for p, g in zip(batch.column(1), batch.column(2)):
                a, b = Counter((p.as_py() or "").split()), Counter((g.as_py() or "").split())
                tp = sum(min(n, b[w]) for w, n in a.items() if w in b)
                rows.append((tp, a.total() - tp, b.total() - tp))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)]], [key, "tp", "fp", "fn"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(pred).cast("string"), F.col(gold).cast("string")).mapInArrow(run, f"`{key}` {kind}, tp long, fp long, fn long")


def micro(confusion: DataFrame) -> DataFrame:
    """precision, recall and f1 of summed counts; 0 where undefined."""
    total = confusion.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    """Means of per-page precision and recall, and the F1 of the means."""
    total = scores.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return total.select("precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """Ratcliff-Obershelp blocks (place in a, place in b, size) of two sequences."""
    return [(x.a, x.b, x.size) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]


def opcode_confusion(a: list, b: list, matched: int | None = None) -> tuple[int, int, int]:
    """(tp, fp, fn) of turning the extracted words a into the gold words b: whatever no block matches is deleted,
    inserted or replaced. `matched` is the blocks' size where they are known already."""
    tp = sum(x[2] for x in matching_blocks(a, b)) if matched is None else matched
    return tp, len(a) - tp, len(b) - tp


def alignment_scores(df: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """key, n_pred, n_gold, matched, op_tp, op_fp, op_fn, precision, recall; a side without words counts as 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = []
            for p, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = (p or "").split(), (g or "").split()
                m = sum(x[2] for x in matching_blocks(a, b))
                rows.append((len(a), len(b), m, *opcode_confusion(a, b, m), m / len(a) if a else 1.0, m / len(b) if b else 1.0))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], [key, "n_pred", "n_gold", "matched", "op_tp", "op_fp", "op_fn", "precision", "recall"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, pred, gold).mapInArrow(run, f"`{key}` {kind}, n_pred long, n_gold long, matched long, op_tp long, op_fp long, op_fn long, precision double, recall double")


def node_confusion(df: DataFrame, score: str, truth: str, threshold: float, group: str | None = None) -> DataFrame:
    """tp, fp and fn of score >= threshold against 0/1 truth, by group or in all."""
    yes, real = F.col(score) >= threshold, F.col(truth) == 1
    sums = [F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn")]
    return df.groupBy(group).agg(*sums) if group else df.agg(*sums)


def threshold_f1(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """precision, recall and f1 at each threshold (score > threshold), in one pass."""
    each = F.explode(F.array(*map(F.lit, thresholds)))
    rows = df.select(score, truth, each.alias("threshold"))
    yes, real = F.col(score) > F.col("threshold"), F.col(truth) == 1
    n = rows.groupBy("threshold").agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("threshold", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def accuracy(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """accuracy, precision, recall and f1 of 0/1 predictions."""
    yes, real = F.col(pred) == 1, F.col(truth) == 1
    n = df.agg(F.count_if(F.col(pred) == F.col(truth)).alias("right"), F.count("*").alias("n"), F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select(ratio(F.col("right"), F.col("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def class_accuracy(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Share of rows whose class, of any number of classes, is right: of blocks, or of edges by `edge_classes`."""
    return df.agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def edge_classes(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """0/1 labels of neighbouring rows of a key as classes 0 to 3 (both bits, the earlier one first): key, order, columns.
    Neighbours are found by a shifted join, so a key with many rows does not gather; `order` counts without gaps."""
    after = df.select(key, (F.col(order) - 1).alias(order), *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(after, [key, order]).select(key, order, *[(2 * F.col(c) + F.col(f"_{c}")).alias(c) for c in columns])


def class_confusion(df: DataFrame, scores: str, truth: str, top_k: int | None = None, class_id: int | None = None, threshold: float | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of class scores (an array) against the true class's number. A class is
    predicted if its score is over the threshold (0.5, or none with top_k) and, with top_k, among the row's k best, of
    equals the earlier ones; with class_id that class alone counts."""
    if threshold is None and top_k is None:
        threshold = 0.5
    at = F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    better = lambda x: F.size(F.filter(at, lambda y: (y["s"] > x["s"]) | ((y["s"] == x["s"]) & (y["i"] < x["i"]))))
    yes = lambda x: (F.lit(True) if top_k is None else better(x) < top_k) & (F.lit(True) if threshold is None else x["s"] > threshold)
    rows = df.select(F.col(truth).alias("_t"), F.inline(F.transform(at, lambda x: F.struct(x["i"].alias("i"), yes(x).alias("yes")))))
    rows = rows if class_id is None else rows.where(F.col("i") == class_id)
    real = F.col("i") == F.col("_t")
    n = rows.agg(F.count_if(F.col("yes") & real).alias("tp"), F.count_if(F.col("yes") & ~real).alias("fp"), F.count_if(~F.col("yes") & real).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """query_id, key, score (cosine, to six places), rank: the k nearest other rows of each query, of equals the lowest
    key (a whole number). Queries are broadcast in blocks of about `block` rows; a task multiplies its rows with a block as
    matrices and keeps the block's k best, so that k rows a query leave it. Vectors that are null, have a null or another length
    than the block's first have no neighbours and are none; the cosine beside a zero vector is 0."""
    from pyspark.sql import Window

    wide = lambda df, name: df.select(F.col(key).cast("long").alias(name), F.transform(vector, lambda x: x.cast("double")).alias("_v")).where(F.col(name).isNotNull() & F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull()))
    given = checkpoint(wide(queries, "query_id"))
    n_blocks = max(1, -(-given.count() // block))
    out = None
    for b in range(n_blocks):
        some = given.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toArrow()  # about `block` stated queries
        best = wide(rows, key).mapInArrow(_best_of_block(rows.sparkSession.sparkContext.broadcast(some), k), f"query_id long, {key} long, score double")
        out = best if out is None else out.unionByName(best)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _best_of_block(held, k: int, rows_at_once: int = 1024):
    """A task's k best rows of each query of a broadcast block (query_id, _v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        if not len(table):
            return
        size = pc.list_value_length(table["_v"])
        table = table.filter(pc.equal(size, size[0]))
        ids = table["query_id"].to_numpy()
        asked = _unit(table["_v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
        places: dict[int, list[int]] = {}
        for place, i in enumerate(ids.tolist()):
            places.setdefault(i, []).append(place)
        best_of, best_key, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(ids), -np.inf)
        for whole in batches:
            for lo in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(lo, rows_at_once)
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), asked.shape[1]))
                if not batch.num_rows or not asked.shape[1]:
                    continue
                keys = batch.column(0).to_numpy()
                score = asked @ _unit(batch.column(1).flatten().to_numpy().reshape(len(keys), -1)).T
                score = np.floor(score * 1e6 + 0.5) / 1e6 + 0.0
                for place, i in enumerate(keys.tolist()):
                    if i in places:
                        score[places[i], place] = -np.inf
                bound = least if len(keys) <= k else np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
                of, at = np.nonzero((score >= bound[:, None]) & (score > -np.inf))
                best_of, best_key, best_score = np.concatenate((best_of, of)), np.concatenate((best_key, keys[at])), np.concatenate((best_score, score[of, at]))
                order = np.lexsort((best_key, -best_score, best_of))
                best_of, best_key, best_score = best_of[order], best_key[order], best_score[order]
                rank = np.arange(len(best_of)) - np.searchsorted(best_of, best_of)
                last = rank == k - 1
                least[best_of[last]] = best_score[last]
                best_of, best_key, best_score = best_of[rank < k], best_key[rank < k], best_score[rank < k]
        if len(best_of):
            yield pa.RecordBatch.from_arrays([pa.array(ids[best_of]), pa.array(best_key), pa.array(best_score)], ["query_id", "key", "score"])

    return run


def common_folds(left: DataFrame, right: DataFrame, fold: str) -> DataFrame:
    """The folds that both sides have: those whose records and whose weights are there."""
    return left.select(fold).distinct().join(right.select(fold).distinct(), fold, "left_semi")


def majority_vote(df: DataFrame, group: str, vote: str) -> DataFrame:
    """The most frequent vote of each group; of ties the lowest class."""
    n = df.groupBy(group, vote).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.max_by(vote, F.struct("n", -F.col(vote))).alias("winner"), F.max("n").alias("votes"))


def fold_summary(df: DataFrame, fold: str, value: str) -> DataFrame:
    """Mean and population deviation, over folds, of each fold's mean."""
    by_fold = df.groupBy(fold).agg(F.avg(value).alias("m"))
    return by_fold.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("*").alias("folds"))


def best_epoch(df: DataFrame, epoch: str, metric: str) -> DataFrame:
    """The epoch with the best metric (the first of equals) and the metric."""
    return df.agg(F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("epoch"), F.max(metric).alias("metric"))


def label_nodes(nodes: DataFrame, tokens_table: DataFrame, gold: DataFrame, min_share: float = 0.75) -> DataFrame:
    """Node labels by aligning a page's words with its gold text: page_id, node_id, n_words, n_aligned, label.

    A node is content if any of its own words is in an aligned block, non_content if it has words without
    one, other if it has none. Pages whose alignment covers at most `min_share` of the gold words are left
    out. tokens_table has a page's words in order; gold has page_id and text.
    """
    page = tokens_table.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    both = page.join(gold.select("page_id", "text"), "page_id").select("page_id", F.transform("t", lambda x: x["token"]).alias("w"), "text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            ids, places = [], []
            for page_id, a, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                b = (text or "").split()
                found = [x for i, _, n in matching_blocks(a, b) for x in range(i, i + n)]
                if b and len(found) / len(b) > min_share:
                    ids.append(page_id)
                    places.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["page_id", "hits"])

    aligned = checkpoint(both.mapInArrow(align, "page_id long, hits array<int>"))  # read by three branches
    hits = aligned.select("page_id", F.explode("hits").alias("pos"), F.lit(1).alias("hit"))
    owned = tokens_table.join(aligned.select("page_id"), "page_id", "left_semi").join(hits, ["page_id", "pos"], "left").select("page_id", F.explode("owners").alias("node_id"), "hit")
    counts = owned.groupBy("page_id", "node_id").agg(F.count("*").alias("n_words"), F.count("hit").alias("n_aligned"))
    rows = nodes.join(aligned.select("page_id"), "page_id", "left_semi").select("page_id", "node_id").join(counts, ["page_id", "node_id"], "left")
    label = F.when(F.col("n_aligned") > 0, "content").when(F.col("n_words") > 0, "non_content").otherwise("other")
    return rows.select("page_id", "node_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_aligned", F.lit(0)).alias("n_aligned"), label.alias("label"))


def label_pages(pages: DataFrame, min_share: float = 0.75) -> DataFrame:
    """What `label_nodes` gives, from pages with their gold text (page_id, html, gold), in one narrow pass: a page is parsed,
    aligned and counted in one place, and no word is shuffled. A page without an id is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = []
            for page_id, html, gold in zip(*(batch.column(k) for k in range(3))):
                root, b = markup.parse(html.as_py()), (gold.as_py() or "").split()
                words = markup.words(root)
                hit = np.zeros(len(words), bool)
                for i, _, n in matching_blocks([w for w, _ in words], b):
                    hit[i : i + n] = True
                if not b or not hit.sum() / len(b) > min_share:
                    continue
                counts = [[0, 0] for _ in range(len(markup.elements(root)))]
                for (_, owners), aligned in zip(words, hit.tolist()):
                    for e in owners:
                        if e >= 0:
                            counts[e][0] += 1
                            counts[e][1] += aligned
                page = page_id.as_py()
                rows += [(page, e, n, m, "content" if m else "non_content" if n else "other") for e, (n, m) in enumerate(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["page_id", "node_id", "n_words", "n_aligned", "label"])

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long"), "html", F.col("gold").cast("string"))
    return spread(rows).mapInArrow(run, "page_id long, node_id int, n_words long, n_aligned long, label string")
