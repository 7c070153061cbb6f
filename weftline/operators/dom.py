"""Pages as tables of elements, edges, texts and words, and what is counted over them.

One parse a page, in Arrow batches; a caller says which table it wants, since Catalyst cannot prune inside
Python. Trees are kept by path (the numbers of an element's ancestors and its own) and `subtree_end`, so
ancestors and subtrees need no recursion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import checkpoint, few_rows, spread

from . import markup

#: Rows that a kernel holds as Python objects, of each table.
_ROWS = 4_096
_NEAR = 1 << 18

SCHEMAS = {
    "nodes": "page_id long, node_id int, parent_id int, depth int, sib_idx int, tag string, attrs map<string,string>, path array<int>, subtree_end int",
    "edges": "page_id long, src int, dst int, type_id int",
    "texts": "page_id long, text_id int, node_id int, boundary boolean, raw string",
    "tokens": "page_id long, pos int, token string, owners array<int>",
    "layout": "page_id long, pos int, last int, node_id int, parent_id int, depth int, tag string, owner string, attrs map<string,string>, text string, apart boolean",
}
_ARROW = {
    "nodes": pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("sib_idx", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("path", pa.list_(pa.int32())), ("subtree_end", pa.int32())]),
    "edges": pa.schema([("page_id", pa.int64()), ("src", pa.int32()), ("dst", pa.int32()), ("type_id", pa.int32())]),
    "texts": pa.schema([("page_id", pa.int64()), ("text_id", pa.int32()), ("node_id", pa.int32()), ("boundary", pa.bool_()), ("raw", pa.string())]),
    "tokens": pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("token", pa.string()), ("owners", pa.list_(pa.int32()))]),
    "layout": pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("last", pa.int32()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("owner", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("apart", pa.bool_())]),
}


def _node_rows(page, root):
    paths: dict[int, list[int]] = {-1: []}
    for e in markup.elements(root):
        paths[e.number] = [*paths[e.parent.number], e.number]
        yield page, e.number, e.parent.number if e.parent.number >= 0 else None, e.depth, e.sibling, e.tag, list(e.attrs.items()), paths[e.number], e.last


def _edge_rows(page, root):
    for e in markup.elements(root):
        if e.parent.number >= 0:
            yield page, e.number, e.parent.number, 0
            yield page, e.parent.number, e.number, 1


def _text_rows(page, root):
    for k, (x, broken) in enumerate(markup.texts(root)):
        yield page, k, x.parent.number if x.parent.number >= 0 else None, broken, x.text


def _token_rows(page, root):
    for k, (word, owners) in enumerate(markup.words(root)):
        yield page, k, word, owners


def _layout_rows(page, root):
    """Elements and texts by their place in the document; an element also has the last place below it, a text whether it
    follows another text of its parent at once."""
    rows, open_, before = [], [], None
    for pos, x in enumerate(root.walk()):
        while open_ and open_[-1][0] is not x.parent:
            rows[open_.pop()[1]][2] = pos - 1
        parent = x.parent.number if x.parent.number >= 0 else None
        if isinstance(x, markup.Element):
            rows.append([page, pos, pos, x.number, parent, x.depth, x.tag, x.parent.tag, list(x.attrs.items()), None, False])
            open_.append((x, pos))
        else:
            apart = isinstance(before, markup.Text) and before.parent is x.parent
            rows.append([page, pos, pos, None, parent, x.parent.depth + 1, None, x.parent.tag, None, x.text, apart])
        before = x
    for _, pos in open_:
        rows[pos][2] = len(rows) - 1
    return rows


_MAKERS = {"nodes": _node_rows, "edges": _edge_rows, "texts": _text_rows, "tokens": _token_rows, "layout": _layout_rows}


def dom_table(pages: DataFrame, want: str, drop: frozenset[str] = markup.DROPPED, id_column: str = "page_id", html_column: str = "html", tree: Callable = markup.parse) -> DataFrame:
    """The table `want` (nodes, edges, texts, tokens or layout) of all pages; `tree` makes a page's tree from (html, drop)."""
    make, schema = _MAKERS[want], _ARROW[want]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.extend(make(page, tree(html.as_py(), drop)))
                while len(held) >= _ROWS:
                    part, held = held[:_ROWS], held[_ROWS:]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return spread(pages.select(F.col(id_column).cast("long"), html_column)).mapInArrow(run, SCHEMAS[want])


def dom_tables(pages: DataFrame, *want: str, drop: frozenset[str] = markup.DROPPED, id_column: str = "page_id", html_column: str = "html", tree: Callable = markup.parse) -> list[DataFrame]:
    """Several tables of all pages by one parse a page: the kernel gives rows tagged by table, a struct column each, which are
    written to the shared folder once; each table is a filter on them."""
    names = [f"{w}_row" for w in want]
    fields = [pa.field("kind", pa.string())] + [pa.field(n, pa.struct(list(_ARROW[w]))) for n, w in zip(names, want)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {w: [] for w in want}

        def emit(w: str) -> pa.RecordBatch:
            rows, held[w] = held[w], []
            own = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW[w])], fields=list(_ARROW[w]))
            columns = [own if x == w else pa.nulls(len(rows), f.type) for x, f in zip(want, fields[1:])]
            return pa.RecordBatch.from_arrays([pa.array([w] * len(rows)), *columns], schema=pa.schema(fields))

        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = tree(html.as_py(), drop)
                for w in want:
                    held[w].extend(_MAKERS[w](page, root))
                    if len(held[w]) >= _ROWS:
                        yield emit(w)
        for w in want:
            if held[w]:
                yield emit(w)

    schema = ", ".join(["kind string", *(f"{n} struct<{SCHEMAS[w].replace(' ', ':').replace(',:', ', ')}>" for n, w in zip(names, want))])
    rows = checkpoint(spread(pages.select(F.col(id_column).cast("long"), html_column)).mapInArrow(run, schema))
    return [rows.where(F.col("kind") == w).select(f"{n}.*") for n, w in zip(names, want)]


def edges_of(nodes: DataFrame) -> DataFrame:
    """Edges from a table of nodes: type 0 to the parent, type 1 to the child."""
    child = nodes.where("parent_id is not null").select("page_id", "node_id", "parent_id")
    both = F.array(F.struct(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"), F.lit(0).alias("type_id")), F.struct(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1).alias("type_id")))
    return child.select("page_id", F.inline(both))


def tag_counts(nodes: DataFrame) -> DataFrame:
    """tag, total, n_pages (pages that have it). Pages are counted by a second aggregation, not by sets."""
    by_page = nodes.groupBy("tag", "page_id").agg(F.count("*").alias("n"))
    return by_page.groupBy("tag").agg(F.sum("n").alias("total"), F.count("*").alias("n_pages"))


def frequent_tags(counts: DataFrame, supported: list[str], threshold: int, is_supported: bool = True) -> DataFrame:
    """Tags on at least `threshold` pages, in or out of the supported list, most frequent first."""
    known = F.col("tag").isin(supported)
    return counts.where((known if is_supported else ~known) & (F.col("n_pages") >= threshold)).orderBy(F.desc("n_pages"), F.desc("tag"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """num_child of every node."""
    kids = nodes.where("parent_id is not null").groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.select("page_id", "node_id").join(kids, ["page_id", "node_id"], "left").select("page_id", "node_id", F.coalesce("n", F.lit(0)).alias("num_child"))


def child_position(size: int, index: Column | None = None) -> Column:
    """One-hot index among sibling elements, the last slot for all beyond it; the root has slot 0."""
    at = F.least(F.col("sib_idx") if index is None else index, F.lit(size - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def first_equal_sibling(nodes: DataFrame) -> DataFrame:
    """sib_idx of the first sibling with the same subtree of tags and attributes (strict child position)."""
    below = nodes.select("page_id", F.explode("path").alias("node_id"), F.named_struct(F.lit("n"), F.col("node_id"), F.lit("depth"), F.col("depth"), F.lit("tag"), F.col("tag"), F.lit("a"), F.array_sort(F.map_entries("attrs"))).alias("x"))
    shapes = below.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    base = F.element_at("xs", 1)["depth"]
    keyed = shapes.select("page_id", "node_id", F.sha2(F.to_json(F.transform("xs", lambda x: F.named_struct(F.lit("d"), x["depth"] - base, F.lit("t"), x["tag"], F.lit("a"), x["a"]))), 256).alias("shape"))
    w = Window.partitionBy("page_id", "parent_id", "shape")
    return nodes.join(keyed, ["page_id", "node_id"]).withColumn("first_idx", F.when(F.col("parent_id").isNull(), F.col("sib_idx")).otherwise(F.min("sib_idx").over(w))).select("page_id", "node_id", "first_idx")


def tag_one_hot(tags: list[str]) -> Column:
    """One-hot tag; the last slot is for tags out of the list."""
    index = F.coalesce(F.try_element_at(F.create_map(*[x for i, t in enumerate(tags) for x in (F.lit(t), F.lit(i))]), F.col("tag")), F.lit(len(tags)))
    return F.transform(F.sequence(F.lit(0), F.lit(len(tags))), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def own_text(texts: DataFrame) -> DataFrame:
    """Per node its own words joined by blanks and their number."""
    from weftline.functions.text import tokens

    words = texts.where("node_id is not null").select("page_id", "node_id", "text_id", tokens(F.col("raw")).alias("w")).where(F.size("w") > 0)
    grouped = words.groupBy("page_id", "node_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("text_id", "w"))), lambda x: x["w"])).alias("words"))
    return grouped.select("page_id", "node_id", F.array_join("words", " ").alias("text"), F.size("words").alias("n_words"))


def subtree_sums(nodes: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of per-node values over each node's subtree, itself included, by its descendants' paths."""
    known = nodes.select("page_id", "node_id", "path").join(values, ["page_id", "node_id"], "left")
    rows = known.select("page_id", F.explode("path").alias("node_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])
    return rows.groupBy("page_id", "node_id").agg(*[F.sum(c).alias(c) for c in columns])


def without_hidden(nodes: DataFrame) -> DataFrame:
    """Nodes outside subtrees of elements with the attribute display="none"."""
    hidden = nodes.where(F.try_element_at("attrs", F.lit("display")) == "none").select(F.col("page_id").alias("_page"), F.col("node_id").alias("_low"), F.col("subtree_end").alias("_high"))
    inside = (F.col("page_id") == F.col("_page")) & F.col("node_id").between(F.col("_low"), F.col("_high"))
    return nodes.join(hidden, inside, "left_anti")


def tree_distance(a: Column, b: Column) -> Column:
    """Edges between two nodes of one page, from their paths."""
    shared = F.size(F.filter(F.arrays_zip(F.slice(a, 1, F.least(F.size(a), F.size(b))).alias("a"), F.slice(b, 1, F.least(F.size(a), F.size(b))).alias("b")), lambda p: p["a"] == p["b"]))
    return F.size(a) + F.size(b) - 2 * shared


def within_hops(nodes: DataFrame, hops: int) -> DataFrame:
    """(page_id, node_id, near_id, distance) of nodes at most `hops` edges apart; the rows are those of neighbourhoods, never
    all pairs of a page. A page's nodes meet in one shuffle, and its neighbourhoods are found in place, for so many nodes at
    once that a step has at most `_NEAR` rows, or those of one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            for page, some in zip(batch.column(0), batch.column(1)):
                child, parent = some.values.field("node_id"), some.values.field("parent_id")
                own = child.to_numpy()
                linked = parent.is_valid().to_numpy(zero_copy_only=False) & page.is_valid
                up, low = parent.fill_null(-1).to_numpy()[linked], own[linked]
                ids, places = np.unique(np.concatenate((own, up)), return_inverse=True)
                n, starts = len(ids), np.unique(places[: len(own)])
                ends = np.unique(np.concatenate((places[: len(own)][linked] * n + places[len(own) :], places[len(own) :] * n + places[: len(own)][linked])))
                src, dst = ends // n, ends % n
                first = np.searchsorted(src, np.arange(n + 1))
                yield _near(page, own, own, 0)
                step = max(1, _NEAR // max(len(ends), 1))
                for lo in range(0, len(starts), step):
                    of = at = starts[lo : lo + step]
                    seen = of * n + at
                    for k in range(1, hops + 1):
                        size = first[at + 1] - first[at]
                        to = dst[np.arange(size.sum()) + np.repeat(first[at] - (np.cumsum(size) - size), size)]
                        new = np.unique(np.repeat(of, size) * n + to)
                        new = new[~np.isin(new, seen)]
                        seen, of, at = np.concatenate((seen, new)), new // n, new % n
                        yield _near(page, ids[of], ids[at], k)

    pages = nodes.groupBy("page_id").agg(F.collect_list(F.struct("node_id", "parent_id")).alias("n"))
    return pages.mapInArrow(run, "page_id long, node_id int, near_id int, distance int")


def _near(page: pa.Scalar, of: np.ndarray, at: np.ndarray, distance: int) -> pa.RecordBatch:
    n = len(of)
    columns = [pa.array([page.as_py()] * n, pa.int64()), pa.array(of, pa.int32()), pa.array(at, pa.int32()), pa.array(np.full(n, distance), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "node_id", "near_id", "distance"])


def register_udtf(spark) -> None:
    """SQL function dom_nodes(html): node_id, parent_id, depth, tag of a page, for LATERAL joins."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="node_id: int, parent_id: int, depth: int, tag: string")
    class DomNodes:
        def eval(self, html: str):
            for e in markup.elements(markup.parse(html)):
                yield e.number, e.parent.number if e.parent.number >= 0 else None, e.depth, e.tag

    spark.udtf.register("dom_nodes", DomNodes)
