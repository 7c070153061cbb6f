"""Divergence of sources: how each source's words differ from its language's and from the other sources'.

A language keeps the terms (runs of letters A-Z, a-z and anything beyond ASCII; A-Z lower-cased) of `min_docs` of its
documents or more; V is their number. A group is a (language, source) that occurs or a whole language; N is the sum
of its kept terms' counts, and a term's share is p = 1 + floor(`scale` * (count + `prior`) / (N + `prior` * V)) in exact integers.
* `term` rows: the `top` kept terms of a source with the largest p - q > 0, q being the language's share.
* `pair` rows: the sum of |p - q| over all kept terms against each other source of the language.

Ranking is a radix select: counts of the values' upper bits by group find the range that holds the group's `top`-th value,
their next bits narrow it down, and after the last bits the threshold is exact; equal values at the threshold are narrowed
by their UTF-8 bytes in the same way, until the group has no more of them than it needs or a few. A histogram has at
most 1,024 rows (257 for bytes) a group and task, so no group is sorted or collected, however many terms it has; what is left to
rank is bounded.

Pairs are sparse: a term that a source lacks has the same share there whatever the term (the baseline, of count 0). So
a pair's sum is that of two baselines over all V terms, corrected for the terms of either source, which is found from the
number of a source's terms by count, and for the terms of both, which a pass over blocks of terms sums up by pair.

Defined cases: null text, language and source are empty strings, which are a language and a source like others; repeated
rows count each; an empty table gives no rows; a source without kept terms has pairs, and no terms; equal values are ranked by
the item's UTF-8 bytes. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, ensure_checkpoint_dir, read


@dataclass(frozen=True)
class DivergenceParams:
    min_docs: int = 30
    prior: int = 5
    scale: int = 1_000_000_000
    top: int = 50
    bits: int = 10
    settled: int = 512
    held_terms: int = 600_000
    block_cells: int = 1 << 21
    broadcast_groups: int = 1 << 16


#: Bytes of terms, A-Z lower-cased, and a space for any other byte.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """lang, source, term, count, docs: partial sums, a row for each run of a task's documents, and a row with a null
    term for each group that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "count", "docs"]
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (found, docs_with) in counts.items():
                terms = list(found)
                columns = [pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *(found[t] for t in terms)], pa.int64()), pa.array([0, *(docs_with[t] for t in terms)], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()), *columns], names)
            counts.clear()

        for batch in batches:
            for lang, source, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found, docs_with = counts.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(cell.as_buffer().to_pybytes().translate(_TERM_BYTES).split())
                found.update(own)
                docs_with.update(own.keys())
            if sum(len(found) for found, _ in counts.values()) >= p.held_terms:
                yield from emit()
        yield from emit()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: Column, total: Column, v: Column, p: DivergenceParams) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * v)); by decimals where a long could not hold the product."""
    below = total + p.prior * v
    wide = (count + p.prior).cast("decimal(20,0)") * F.lit(p.scale).cast("decimal(18,0)")
    exact = F.call_function("div", wide.cast("decimal(38,0)"), below.cast("decimal(20,0)"))
    plain = F.call_function("div", (count + p.prior) * F.lit(p.scale), below)
    return F.when(v > 0, 1 + F.when(total < (1 << 62) // p.scale - p.prior, plain).otherwise(exact)).cast("long")


def _checked(df: DataFrame, most: int) -> DataFrame:
    """A checkpointed table of a row a group, to be broadcast where it has `most` rows at most; else it is joined like any other."""
    return F.broadcast(df) if df.count() <= most else df


class Shares:
    """The tables that all parts use. `terms`: lang, source, term, count, p, q of each source's own kept terms (count > 0);
    `groups`: lang, source, total, v, baseline of each source, also without terms."""

    def __init__(self, docs: DataFrame, p: DivergenceParams = DivergenceParams()):
        folder = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/terms-{uuid.uuid4().hex}"
        counted = term_counts(docs, p).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")  # a row a source, after the sums; the rows without a term are the groups
        named = counted.withColumns({"lang_count": F.sum("count").over(of_term), "lang_docs": F.sum("docs").over(of_term), "first": F.col("source") == F.min("source").over(of_term)})
        named.where(F.col("term").isNull() | (F.col("lang_docs") >= p.min_docs)).select("lang", "source", "term", "count", "lang_count", "first").write.parquet(folder)
        stored = docs.sparkSession.read.parquet(folder)
        own = stored.where("term is not null")
        langs = own.where("first").groupBy("lang").agg(F.sum("lang_count").alias("lang_total"), F.count("*").alias("v"))
        totals = own.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        groups = stored.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
        zero = F.lit(0).cast("long")
        self.groups = checkpoint(groups.withColumn("baseline", share(zero, F.col("total"), F.col("v"), p)))
        full = own.join(_checked(self.groups, p.broadcast_groups), ["lang", "source"])
        self.terms = full.select("lang", "source", "term", "count", share(F.col("count"), F.col("total"), F.col("v"), p).alias("p"), share(F.col("lang_count"), F.col("lang_total"), F.col("v"), p).alias("q"))


def _narrow(rows: DataFrame, keys: list[str], digit: Column, descending: bool) -> DataFrame:
    """For each group, the digit in which its `_need`-th row lies, and what is then needed of the rows with that digit.
    rows has the keys, `_need` (the same within a group) and what the digit needs; a group's histogram is a
    few hundred rows."""
    bins = rows.groupBy(*keys, digit.alias("_digit")).agg(F.count("*").alias("_n"), F.first("_need").alias("_need"))
    order = F.col("_digit").desc() if descending else F.col("_digit").asc()
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("_upto") - F.col("_n")
    return bins.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (before < F.col("_need"))).select(*keys, "_digit", (F.col("_need") - before).alias("_left"), F.col("_n").alias("_size"))


def top_by_radix(rows: DataFrame, keys: list[str], value: str, item: str, p: DivergenceParams = DivergenceParams(), value_bits: int = 31) -> DataFrame:
    """The `top` rows of each group by value descending, item's bytes ascending, with `rank` from 1. Values are from 0
    to 2 ** value_bits - 1; an item occurs once in a group."""
    groups = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("_rows")))
    found = groups.select(*keys, F.lit(0).cast("long").alias("_prefix"), F.least(F.col("_rows"), F.lit(p.top)).cast("long").alias("_need"))
    small = lambda df: _checked(df, p.broadcast_groups)
    shift = value_bits
    while shift > 0:  # thresholds: the first value_bits - shift bits are known, and how many of the rows that share them
        width = min(p.bits, shift)
        shift -= width
        digit = F.shiftright(value, shift).bitwiseAND((1 << width) - 1)
        inside = rows.join(small(found), keys).where(F.shiftright(value, shift + width) == F.col("_prefix"))
        chosen = _narrow(inside, keys, digit, descending=True)
        found = checkpoint(found.drop("_size").join(chosen, keys).select(*keys, (F.shiftleft("_prefix", width) + F.col("_digit")).alias("_prefix"), F.col("_left").alias("_need"), F.col("_size")))
    # ties at the threshold: bytes that sort before `_bytes` are in, those that start with it are open, and where `_ended`
    # is set the last one needed is `_bytes` itself
    hexed = F.hex(F.encode(item, "UTF-8"))
    ties = found.select(*keys, F.col("_prefix").alias("_value"), "_need", "_size", F.lit("").alias("_bytes"), F.lit(False).alias("_ended"))
    wide, place = (F.col("_size") > F.col("_need")) & (F.col("_size") > p.settled), 0
    while ties.where(wide).limit(1).count():
        pending = rows.join(small(ties.where(wide)), keys).where((F.col(value) == F.col("_value")) & hexed.startswith(F.col("_bytes")))
        chosen = _narrow(pending, keys, F.substring(hexed, 2 * place + 1, 2), descending=False).select(*keys, "_digit", "_left", F.col("_size").alias("_now"))
        ties = checkpoint(ties.join(chosen, keys, "left").select(
            *keys, "_value", F.coalesce("_left", "_need").alias("_need"), F.coalesce("_now", "_size").alias("_size"),
            F.concat("_bytes", F.coalesce("_digit", F.lit(""))).alias("_bytes"), (F.col("_ended") | F.coalesce(F.col("_digit") == "", F.lit(False))).alias("_ended"),
        ))
        place += 1
    tied = (hexed <= F.col("_bytes")) | ~F.col("_ended") & hexed.startswith(F.col("_bytes"))
    at_least = rows.join(small(ties.select(*keys, "_value", "_bytes", "_ended")), keys).where((F.col(value) > F.col("_value")) | (F.col(value) == F.col("_value")) & tied)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(item)))
    return at_least.withColumn("rank", rank).where(F.col("rank") <= p.top).drop("_value", "_bytes", "_ended")


def common_terms(terms: DataFrame, baselines: DataFrame, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """lang, source, other, correction: over the terms that two sources share, the sum of |p1 - p2| - |p1 - b2| - |b1 - p2| +
    |b1 - b2|, for source < other. Terms are dealt by language and term and taken in blocks, sources against terms."""
    dealt = terms.join(_checked(baselines, p.broadcast_groups), ["lang", "source"]).select("lang", "term", "source", "p", "baseline").repartition("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "other", "correction"]
        sums: dict[tuple, int] = {}

        def block(lang: str, rows: list[tuple]) -> None:
            """Adds the corrections of all terms of rows (term, source, p, baseline)."""
            sources = sorted({r[1] for r in rows})
            place, term_place = {s: k for k, s in enumerate(sources)}, {}
            shares = np.zeros((len(sources), len({r[0] for r in rows})), np.int64)
            base = np.zeros(len(sources), np.int64)
            for term, source, share_, baseline in rows:
                shares[place[source], term_place.setdefault(term, len(term_place))] = share_
                base[place[source]] = baseline
            there = shares > 0  # a share is at least 1
            for a in range(len(sources)):
                mine = np.flatnonzero(there[a])
                others, both = shares[a + 1 :, mine], there[a + 1 :, mine]
                p1, b1, b2 = shares[a, mine][None, :], base[a], base[a + 1 :][:, None]
                cells = np.abs(p1 - others) - np.abs(p1 - b2) - np.abs(b1 - others) + np.abs(b1 - b2)
                for k, total in enumerate(np.where(both, cells, 0).sum(1).tolist()):
                    if total:
                        key = (lang, sources[a], sources[a + 1 + k])
                        sums[key] = sums.get(key, 0) + total

        def emit() -> Iterator[pa.RecordBatch]:
            if sums:
                lang, source, other = map(list, zip(*sums))
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(other, pa.string()), pa.array(list(sums.values()), pa.int64())], names)
                sums.clear()

        lang, rows, terms_seen, seen = None, [], 0, set()
        for batch in batches:
            for here, term, source, share_, baseline in zip(*(c.to_pylist() for c in batch.columns)):
                fresh = not rows or term != rows[-1][0]
                if here != lang or fresh and (terms_seen + 1) * len(seen) > p.block_cells or fresh and len(rows) > p.block_cells // 8:
                    if rows:
                        block(lang, rows)
                    lang, rows, terms_seen, seen, fresh = here, [], 0, set(), True
                    if len(sums) > p.block_cells // 8:
                        yield from emit()
                rows.append((term, source, share_, baseline))
                seen.add(source)
                terms_seen += fresh
        if rows:
            block(lang, rows)
        yield from emit()

    return dealt.mapInArrow(run, "lang string, source string, other string, correction long").groupBy("lang", "source", "other").agg(F.sum("correction").alias("correction"))


def pair_sums(shares: Shares, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """lang, source, item (another source of the language), value: for every ordered pair of sources."""
    base = shares.groups.select("lang", "source", "v", "baseline")
    other = base.select("lang", F.col("source").alias("item"), F.col("baseline").alias("b2"))
    pairs = base.join(other, "lang").where("source <> item")
    levels = shares.terms.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))  # a source has few different counts
    own = levels.join(base.select("lang", "source", "baseline"), ["lang", "source"]).join(other, "lang").where("source <> item")
    own = own.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("b2")) - F.abs(F.col("baseline") - F.col("b2")))).alias("one"))
    both = common_terms(shares.terms.select("lang", "source", "term", "p"), base.select("lang", "source", "baseline"), p)
    both = both.unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "correction")).withColumnRenamed("other", "item")
    turned = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("two"))
    full = pairs.join(own, ["lang", "source", "item"], "left").join(turned, ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    flat = F.coalesce(F.col("v") * F.abs(F.col("baseline") - F.col("b2")), F.lit(0))
    return full.select("lang", "source", "item", (flat + zero("one") + zero("two") + zero("correction")).cast("long").alias("value"))


def divergence(docs: DataFrame, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """lang, source, part, item, value, rank of both parts."""
    shares = Shares(docs, p)
    rising = shares.terms.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = top_by_radix(rising, ["lang", "source"], "value", "item", p)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    pairs = pair_sums(shares, p).withColumn("rank", rank)  # a row for each source of a language
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(terms, "term").unionByName(part(pairs, "pair"))


def op11_source_divergence(spark: SparkSession, sf_dir: str, p: DivergenceParams = DivergenceParams()) -> DataFrame:
    """Both parts over all documents."""
    return divergence(read(spark, sf_dir, "documents"), p)


#: The same rows in DuckDB, every kept term against every source.
ORACLE = r"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t, row_number() over () r from documents),
words as (select lang, source, r, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term from words group by 1, 2 having count(distinct r) >= 30),
vs as (select lang, count(*) v from kept group by 1),
counts as (select lang, source, term, count(*) c from words join kept using (lang, term) group by 1, 2, 3),
grps as (select g.lang, g.source, coalesce(vs.v, 0) v, coalesce((select sum(c) from counts x where x.lang = g.lang and x.source = g.source), 0) n
  from (select distinct lang, source from d) g left join vs using (lang)),
langs as (select lang, term, sum(c) c, sum(sum(c)) over (partition by lang) n from counts group by 1, 2),
shares as (select g.lang, g.source, k.term, coalesce(c.c, 0) c,
    1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v)::hugeint p,
    1 + (1000000000::hugeint * (l.c + 5)) // (l.n + 5 * g.v)::hugeint q
  from grps g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term join langs l on l.lang = g.lang and l.term = k.term),
pairs as (select a.lang, a.source, b.source item, coalesce(sum(abs(x.p - y.p)), 0) v from grps a join grps b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = a.lang and y.source = b.source and y.term = x.term group by 1, 2, 3),
every as (select lang, source, 'pair' part, item, v::bigint as value from pairs
  union all select lang, source, 'term', term, (p - q)::bigint from shares where c > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from every)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
