"""The per-node feature vector: fonts, text, boxes, class and id, tag, children, position, spectrum."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import css
from weftline.functions.text import tokens
from weftline.plans.lineage import checkpoint, spread

from . import dom, graph, markup
from .cascade import Sheet, computed_styles, inline_css


@dataclass(frozen=True)
class FeatureParams:
    tags: list[str] = field(default_factory=lambda: ["a", "article", "b", "body", "br", "div", "h1", "head", "html", "li", "nav", "p", "title", "ul"])
    text_dim: int = 512
    class_dim: int = 512
    positions: int = 32
    eigenvectors: int = 8
    with_boxes: bool = False


def lengths(p: FeatureParams) -> dict[str, int]:
    """Names and lengths in the order of the vector."""
    boxes = {"height": 5, "width": 5} if p.with_boxes else {}
    return {"font_size": 10, "font_weight": 3, "font_style": 4, "text.embedding": p.text_dim, "text.length": 1, **boxes, "class_attr": p.class_dim, "id_attr": p.class_dim, "tag_type": len(p.tags) + 1, "num_child": 1, "tag_child_pos": p.positions, "tag_graph_eigen": p.eigenvectors}


def node_features(pages: DataFrame, p: FeatureParams = FeatureParams(), properties: DataFrame | None = None) -> DataFrame:
    """page_id, node_id, features (in the order of `lengths`). With computed properties (page_id, node_id,
    properties map) fonts come from them, else from inline styles and tags."""
    nodes, texts = dom.dom_tables(pages, "nodes", "texts")  # several branches read them: parse once
    key = ["page_id", "node_id"]
    style = css.style_map(F.try_element_at("attrs", F.lit("style")))
    words, own_id = graph.visual_words(F.col("attrs"))
    rows = nodes.withColumns({"style": style, "class_text": words, "id_text": own_id})
    if properties is None:
        size, weight, slant = css.simple_font(F.col("tag"), F.col("attrs"), F.col("style"))
    else:
        rows = rows.join(properties, key, "left")
        size, weight, slant = computed_font(F.col("properties"))
    rows = checkpoint(rows.withColumns({"f_size": css.font_size(size), "f_weight": css.font_weight(weight), "f_style": css.font_style(slant)}))
    vector = lambda c, dim: graph.hash_vector(tokens(F.col(c)), dim)
    text = dom.own_text(texts).select(*key, F.length("text").cast("double").alias("text_length"), vector("text", p.text_dim).alias("text_vec"))
    rows = rows.withColumns({"class_vec": vector("class_text", p.class_dim), "id_vec": vector("id_text", p.class_dim)})
    for part in (text, dom.child_counts(nodes), graph.laplacian_positions(pages, p.eigenvectors)):
        rows = rows.join(part, key, "left")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    parts = [F.col("f_size"), F.col("f_weight"), F.col("f_style"), F.coalesce("text_vec", zeros(p.text_dim)), F.array(F.coalesce("text_length", F.lit(0.0)))]
    if p.with_boxes:
        for name in ("height", "width"):
            box = graph.box_size(F.col("attrs"), F.col("style"), name)
            parts.append(F.concat(box["class"], F.array(box["val"])))
    parts += [F.coalesce("class_vec", zeros(p.class_dim)), F.coalesce("id_vec", zeros(p.class_dim)), dom.tag_one_hot(p.tags), F.array(F.col("num_child").cast("double")), dom.child_position(p.positions), F.coalesce("eigen", zeros(p.eigenvectors))]
    return rows.select(*key, F.concat(*[c.cast("array<double>") for c in parts]).alias("features"))


def computed_font(properties: Column) -> tuple[Column, Column, Column]:
    """(size, weight, style) from computed properties; medium and normal where one is missing."""
    get = lambda k, default: F.coalesce(F.try_element_at(properties, F.lit(k)), F.lit(default))
    return get("font-size", "medium"), get("font-weight", "normal"), get("font-style", "normal")


def inlined_styles(pages: DataFrame) -> DataFrame:
    """page_id, node_id, style of every node that has one after inlining."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, e.number, e.attrs["style"]) for page, html in zip(batch.column(0).to_pylist(), batch.column(1)) for e in markup.elements(inline_css(html.as_py())) if e.attrs.get("style")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, [pa.int64(), pa.int32(), pa.string()])], ["page_id", "node_id", "style"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, node_id int, style string")


def cascaded_styles(pages: DataFrame, sheet: str = "") -> DataFrame:
    """page_id, node_id, property, value of every element after the cascade of `sheet`, the page's own style sheets and its
    inline styles, with what it inherits."""
    from . import cascade

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = markup.parse(html.as_py())
                found = computed_styles(root, Sheet(f"{sheet}\n{cascade.sheet_text(markup.elements(root))}"))
                rows = [(page, k, name, value) for k, styles in found.items() for name, value in styles.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.string(), pa.string()])], ["page_id", "node_id", "property", "value"])

    return spread(pages.select("page_id", "html")).mapInArrow(run, "page_id long, node_id int, property string, value string")
