"""Pages back from their tables: elements and texts in document order become HTML again.

`layout` has a row for each element and text with its place `pos` and, for an element, the last place below it. An element
opens at its place and closes behind its last one, inner ones first; so a page is its rows' pieces in order, one aggregation a page
and no recursion. Texts that stood apart (at both sides of a comment or of an element that went) are kept apart by an empty
comment. What is written parses into the same tables again.

Texts may be wrapped in spans that carry a label, and styles may be written into the elements first (`inlined`).
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cascade, dom, markup

#: Elements whose text is not escaped.
_PLAIN = tuple(HTMLParser.CDATA_CONTENT_ELEMENTS)


def layout(pages: DataFrame, drop: frozenset[str] = markup.DROPPED, inline: bool = False) -> DataFrame:
    """page_id, pos, last, node_id, parent_id, depth, tag, owner, attrs, text, apart; with `inline` the pages' style sheets are
    written into style attributes."""
    return dom.dom_table(pages, "layout", drop, tree=cascade.inline_css if inline else markup.parse)


def _escaped(text: Column, quote: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quote else out


def serialise(rows: DataFrame, labels: DataFrame | None = None, attribute: str = "data-label") -> DataFrame:
    """page_id, html. labels: page_id, pos, label of texts, which get a span with the label."""
    if labels is not None:
        rows = rows.join(labels.select("page_id", "pos", F.col("label").cast("string").alias("_label")), ["page_id", "pos"], "left")
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), _escaped(a["value"], True), F.lit('"'))), "")
    is_text = F.col("tag").isNull()
    body = F.when(F.col("owner").isin(*_PLAIN), F.col("text")).otherwise(_escaped(F.col("text")))
    if labels is not None:
        body = F.when(F.col("_label").isNotNull(), F.concat(F.lit(f'<span {attribute}="'), _escaped(F.col("_label"), True), F.lit('">'), body, F.lit("</span>"))).otherwise(body)
    start = F.when(is_text, F.concat(F.when(F.col("apart"), "<!---->").otherwise(""), body)).otherwise(F.concat(F.lit("<"), F.col("tag"), attrs, F.lit(">")))
    piece = lambda at, order, depth, text: F.struct(at.alias("at"), F.lit(order).alias("order"), depth.alias("depth"), text.alias("text"))
    open_ = piece(F.col("pos"), 0, F.lit(0), start)
    close = piece(F.col("last"), 1, -F.col("depth"), F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    void = is_text | F.col("tag").isin(*sorted(markup.VOID))
    pieces = rows.select("page_id", F.explode(F.when(void, F.array(open_)).otherwise(F.array(open_, close))).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "")
    return pieces.groupBy("page_id").agg(joined.alias("html"))


def labelled_pages(pages: DataFrame, node_labels: DataFrame, attribute: str = "data-label") -> DataFrame:
    """page_id, html with a span around each text that has a word, labelled 1 if its element is content, else 0.
    node_labels: page_id, node_id, label (content or another)."""
    rows = layout(pages)
    known = node_labels.select("page_id", F.col("node_id").alias("parent_id"), (F.col("label") == "content").cast("int").alias("label"))
    texts = rows.where("tag is null").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("page_id", "parent_id", "pos")
    return serialise(rows, texts.join(known, ["page_id", "parent_id"]).select("page_id", "pos", "label"), attribute)


def inlined_pages(pages: DataFrame) -> DataFrame:
    """page_id, html with the pages' style sheets written into style attributes."""
    return serialise(layout(pages, inline=True))
