"""Sentences by learned abbreviations, collocations and sentence starters (Kiss and Strunk, 2006).

What is learned from texts, without labels, are counts by type (a word in lower case), added up by task and then by type:
* an abbreviation is a type that stands with a full stop more often than chance: log-likelihood of that, times
  exp(-length), times its inner full stops and one, over length ** (times it stands without); at least `abbreviation`;
* a collocation is a pair of types around a full stop that is more frequent than chance (`collocation`);
* a starter is a type that follows a sentence's end more often than chance (`starter`).
A full stop then ends a sentence, except behind an abbreviation whose next word neither is a starter nor opens with a capital
that the type has nowhere inside sentences; behind an initial or an ordinal number before a small letter; and
within a collocation. Question and exclamation marks, and the end marks of Chinese and Japanese, always do. Closing quotes
and brackets stay with their sentence. The learned table has a row a type that counts as one of the three: it is
broadcast, `most_types` rows at most.

Defined cases: a null or blank text has no sentence; without any learned type every full stop before white space that is
not within a number ends a sentence; a text is read whole, a chunk of tokens at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import checkpoint, spread


@dataclass(frozen=True)
class SentenceParams:
    abbreviation: float = 0.3
    collocation: float = 7.88
    starter: float = 30.0
    held_types: int = 100_000
    most_types: int = 1 << 20


_TOKEN = re.compile(r"\S+")
#: End marks that need no white space behind them, and closing marks that stay with their sentence (fixed values).
_WIDE = "。！？"
_CLOSING = "\"'”’»)]}"
_MARKS = frozenset(f".!?{_WIDE}")
#: A mark and what follows it in its word.
_MARK = re.compile(rf"[.!?{_WIDE}]\S*")
_WIDE_END = re.compile(rf"[{_WIDE}]+[{re.escape(_CLOSING)}]*")
_END = re.compile(rf"[.!?{_WIDE}]+[{re.escape(_CLOSING)}]*\Z")
_STRIP = "\"'“”‘’«»()[]{},;:"
_NUMBER = re.compile(r"\A[-+]?\d[\d.,]*\Z")


def type_of(word: str) -> str:
    """A word as its type: without marks around it, in lower case, numbers as one type."""
    word = word.strip(_STRIP)
    return "##number##" if _NUMBER.match(word.rstrip(".")) else word.lower()


@dataclass
class Learned:
    """What tells sentences apart; `inside` has types that stand in lower case somewhere, `upper_inside` those that
    stand capitalised inside a sentence."""

    abbreviations: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    inside: set[str] = field(default_factory=set)
    upper_inside: set[str] = field(default_factory=set)

    def ends(self, word: str, following: str | None) -> bool:
        """Whether a token that ends in a full stop ends its sentence, before the next token."""
        if following is None:
            return True
        bare, next_ = type_of(word).rstrip("."), type_of(following).rstrip(".")
        first = following.lstrip(_STRIP)[:1]
        if (bare, next_) in self.collocations:
            return False
        if bare == "##number##" or re.fullmatch(r"\d+\.", word.strip(_STRIP)):
            return not first.islower()
        initial = len(bare) == 1 and bare.isalpha()
        if bare in self.abbreviations or initial:
            if first.isupper() and not initial and (next_ in self.starters or next_ in self.inside and next_ not in self.upper_inside):
                return True
            return False
        return True


def split(text: str | None, learned: Learned) -> list[str]:
    """The text's sentences, trimmed."""
    text, out, start, seen = text or "", [], 0, 0
    while mark := _MARK.search(text, seen):  # only words with a mark are looked at
        lo = mark.start()
        while lo > seen and not text[lo - 1].isspace():
            lo -= 1
        hi = seen = mark.end()
        word = text[lo:hi]
        at = lo
        for m in _WIDE_END.finditer(word):  # also within a run without white space
            if lo + m.end() < hi:
                out.append(text[start : lo + m.end()].strip())
                start = at = lo + m.end()
        end = _END.search(word, at - lo)
        if not end:
            continue
        marks = end[0].rstrip(_CLOSING)
        if marks == ".":
            following = _TOKEN.search(text, hi)
            if not learned.ends(word.rstrip(_CLOSING), following and following[0]):
                continue
        out.append(text[start:hi].strip())
        start = hi
    out.append(text[start:].strip())
    return [s for s in out if s]


def type_counts(texts: DataFrame, p: SentenceParams = SentenceParams(), text_column: str = "text") -> DataFrame:
    """kind, a, b, n: counts of types with a full stop (stop), without (plain), in lower case anywhere (lower) and
    capitalised inside a sentence (upper); and of pairs around a full stop (pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                kind, a, b = zip(*held)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(list(held.values()), pa.int64())], ["kind", "a", "b", "n"])
                held.clear()

        for batch in batches:
            for cell in batch.column(0):
                before, stopped = "", True
                for m in _TOKEN.finditer(cell.as_py() or ""):
                    word = m[0].rstrip(_CLOSING)
                    stop = word.endswith(".") and not word.endswith("..")
                    type_ = type_of(word)
                    bare = type_[:-1] if stop and type_.endswith(".") else type_
                    if not bare:
                        continue
                    held["stop" if stop else "plain", bare, ""] += 1
                    first = m[0].lstrip(_STRIP)[:1]
                    if first.islower():
                        held["lower", bare, ""] += 1
                    elif first.isupper() and not stopped:
                        held["upper", bare, ""] += 1
                    if before:
                        held["pair", before, bare] += 1
                    before, stopped = (bare if stop else ""), word[-1:] in f".!?{_WIDE}" or not word
                if len(held) >= p.held_types:
                    yield from emit()
        yield from emit()

    return spread(texts.select(F.col(text_column).cast("string"))).mapInArrow(run, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """ln of the chance of k in n with probability p, bounds kept off 0 and 1."""
    safe = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
    return k * F.ln(safe) + (n - k) * F.ln(1 - safe)


def _dunning(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """-2 ln(lambda) of b standing beside a: by chance (b / n everywhere) against two shares of its own."""
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1))
    return -2 * (_log_likelihood(ab, a, p) + _log_likelihood(b - ab, n - a, p) - _log_likelihood(ab, a, p1) - _log_likelihood(b - ab, n - a, p2))


def scored_types(counts: DataFrame) -> DataFrame:
    """type, n_stop, n_plain, score of every type that stands with a full stop; `score` is that of an abbreviation."""
    by = counts.where("kind in ('stop', 'plain')").groupBy(F.col("a").alias("type")).agg(F.sum(F.when(F.col("kind") == "stop", F.col("n")).otherwise(0)).alias("n_stop"), F.sum(F.when(F.col("kind") == "plain", F.col("n")).otherwise(0)).alias("n_plain"))
    total = by.agg(F.sum("n_stop").alias("stops"), (F.sum("n_stop") + F.sum("n_plain")).alias("total"))
    rows = by.join(F.broadcast(total)).where("n_stop > 0 and type <> '##number##'")  # `total` is one row
    n = F.col("n_stop") + F.col("n_plain")
    # by chance the type is followed by a full stop as often as any word; as an abbreviation nearly always
    ratio = -2 * (_log_likelihood(F.col("n_stop"), n, F.col("stops") / F.col("total")) - _log_likelihood(F.col("n_stop"), n, F.lit(0.99)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("n_plain").cast("double"))
    return rows.where(F.col("type").rlike(r"\p{L}")).select("type", "n_stop", "n_plain", score.alias("score"))


def learn(texts: DataFrame, p: SentenceParams = SentenceParams(), text_column: str = "text") -> Learned:
    counts = checkpoint(type_counts(texts, p, text_column))
    abbreviations = checkpoint(scored_types(counts).where(F.col("score") >= p.abbreviation).select("type"))
    types = counts.where("kind in ('stop', 'plain')").groupBy(F.col("a").alias("type")).agg(F.sum("n").alias("n"))
    total = types.agg(F.sum("n").alias("total"))
    pairs = counts.where("kind = 'pair'").select("a", "b", F.col("n").alias("ab"))
    ends = pairs.join(abbreviations, F.col("a") == F.col("type"), "left_anti")
    count_of = lambda name: types.select(F.col("type").alias(name), F.col("n").alias(f"n_{name}"))
    known = pairs.join(count_of("a"), "a").join(count_of("b"), "b").join(F.broadcast(total))
    tight = _dunning(F.col("ab"), F.col("n_a"), F.col("n_b"), F.col("total"))
    more = F.col("ab") / F.col("n_a") > F.col("n_b") / F.col("total")
    joined = known.where((F.col("ab") > 1) & more & (tight >= p.collocation) & ((F.col("a") == "##number##") | (F.length("a") == 1))).select("a", "b")
    n_ends = ends.agg(F.sum("ab").alias("ends"))
    after = ends.groupBy("b").agg(F.sum("ab").alias("ab")).join(count_of("b"), "b").join(F.broadcast(total)).join(F.broadcast(n_ends))
    opens = _dunning(F.col("ab"), F.col("ends"), F.col("n_b"), F.col("total"))
    starts = after.where((F.col("ab") / F.col("ends") > F.col("n_b") / F.col("total")) & (opens >= p.starter)).select("b")
    cased = counts.where("kind in ('lower', 'upper')").select("kind", F.col("a").alias("b"))
    behind = cased.join(pairs.join(abbreviations, F.col("a") == F.col("type"), "left_semi").select("b").distinct(), "b", "left_semi")
    rows = abbreviations.select(F.lit("abbreviation").alias("kind"), F.col("type").alias("a"), F.lit("").alias("b"))
    rows = rows.unionByName(joined.select(F.lit("collocation").alias("kind"), "a", "b")).unionByName(starts.select(F.lit("starter").alias("kind"), F.col("b").alias("a"), F.lit("").alias("b"))).unionByName(behind.select("kind", F.col("b").alias("a"), F.lit("").alias("b")))
    rows = checkpoint(rows)
    if rows.count() > p.most_types:
        raise ValueError(f"more than {p.most_types} learned types; raise the thresholds")
    out = Learned()
    for kind, a, b in rows.collect():  # `most_types` rows at most
        {"abbreviation": out.abbreviations, "starter": out.starters, "lower": out.inside, "upper": out.upper_inside}.get(kind, set()).add(a)
        if kind == "collocation":
            out.collocations.add((a, b))
    return out


def sentence_table(texts: DataFrame, learned: Learned, key: str, text_column: str = "text") -> DataFrame:
    """key, place (from 0), sentence; a narrow pass."""
    held = texts.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, found = [], [], []
            for i, cell in enumerate(batch.column(1)):
                own = split(cell.as_py(), held.value)
                row += [i] * len(own)
                place += range(len(own))
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int32()), pa.array(found, pa.string())], [key, "place", "sentence"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, F.col(text_column).cast("string"))).mapInArrow(run, f"`{key}` {kind}, place int, sentence string")
