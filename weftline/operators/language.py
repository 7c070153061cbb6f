"""Languages of texts by profiles of character trigrams, learned from a table.

A trigram is any three neighbouring code points, A-Z lower-cased, held as one long of 21 bits each. A language keeps its
`keep` most frequent ones; the profile is all kept trigrams of all languages, with a weight a language:
floor(`scale` * ln((count + 1) / (N + V))), N being the language's occurrences of profile trigrams and V their number. A text's
score for a language is the sum over its profile trigrams (naive Bayes with equal priors), in integers, so it does not
depend on partitions; the language with the largest score is the guess.

Counts are added up by task before they meet, the ranking keeps `keep` rows a language and partition, and the profile that is
broadcast has `most_cells` weights at most. Texts are read whole.

Defined cases: a text of fewer than three code points, or without a profile trigram, has no guess (null); equal scores go to the
first code; rows without a language teach nothing; without any taught language every guess is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import checkpoint, spread


@dataclass(frozen=True)
class LanguageParams:
    keep: int = 5000
    scale: int = 1000
    held_grams: int = 1 << 20
    most_cells: int = 1 << 25


_LOWER = np.arange(128, dtype=np.int64)
_LOWER[65:91] += 32


def trigrams(text: str | None) -> np.ndarray:
    """The text's trigrams in order, a long each."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ascii_ = codes < 128
    codes[ascii_] = _LOWER[codes[ascii_]]
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


@dataclass
class Profile:
    """Languages in order of their codes, trigrams in rising order, a weight for each trigram and language."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def scores(self, text: str | None) -> tuple[np.ndarray, int]:
        """Scores by language, and the number of known trigrams."""
        found, n = np.unique(trigrams(text), return_counts=True)
        if not len(found) or not len(self.grams):
            return np.zeros(len(self.languages), np.int64), 0
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        known = self.grams[at] == found
        return n[known] @ self.weights[at[known]], int(n[known].sum())


def gram_counts(texts: DataFrame, p: LanguageParams = LanguageParams(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, gram, n of texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = trigrams(text.as_py())
                if len(grams):
                    held.setdefault(lang, []).append(grams)
                    size += len(grams)
                if size >= p.held_grams:
                    yield from emit()
                    size = 0
        yield from emit()

    rows = texts.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string"), F.col(text_column).cast("string"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_profile(texts: DataFrame, p: LanguageParams = LanguageParams(), text_column: str = "text", lang_column: str = "lang") -> Profile:
    counts = checkpoint(gram_counts(texts, p, text_column, lang_column))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # limited by partition before it meets
    kept = checkpoint(counts.withColumn("r", rank).where(F.col("r") <= p.keep).select("gram").distinct())
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    v = kept.count()
    if len(languages) * v > p.most_cells:
        raise ValueError(f"{len(languages)} languages of {v} trigrams are more than {p.most_cells} weights; keep fewer")
    used = counts.join(kept, "gram")
    totals = used.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    cells = kept.select("gram", F.explode(F.array(*map(F.lit, languages)).cast("array<string>")).alias("lang"))
    known = cells.join(F.broadcast(totals), "lang").join(used, ["lang", "gram"], "left")
    weight = F.floor(F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + v)) * p.scale).cast("int")
    table = known.select("lang", "gram", weight.alias("w")).toArrow()
    if not len(table):
        return Profile(languages, np.zeros(0, np.int64), np.zeros((0, len(languages)), np.int64))
    grams, at = np.unique(table["gram"].to_numpy(), return_inverse=True)
    weights = np.zeros((len(grams), len(languages)), np.int64)
    weights[at, np.searchsorted(np.array(languages), np.array(table["lang"].to_pylist()))] = table["w"].to_numpy()
    return Profile(languages, grams, weights)


def guess(texts: DataFrame, profile: Profile, key: str, text_column: str = "text") -> DataFrame:
    """key, guessed, score, n_known; a narrow pass."""
    held = texts.sparkSession.sparkContext.broadcast(profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guessed, best, known = [], [], []
            for text in batch.column(1):
                scores, n = held.value.scores(text.as_py())
                guessed.append(held.value.languages[int(scores.argmax())] if n else None)
                best.append(int(scores.max()) if n else None)
                known.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(guessed, pa.string()), pa.array(best, pa.int64()), pa.array(known, pa.int64())], [key, "guessed", "score", "n_known"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, F.col(text_column).cast("string"))).mapInArrow(run, f"`{key}` {kind}, guessed string, score long, n_known long")


def in_languages(texts: DataFrame, profile: Profile, wanted: list[str], key: str, text: Column) -> DataFrame:
    """The rows whose text is in one of the wanted languages; a text without a guess is not."""
    numbered = texts.withColumn("_t", text)
    return texts.join(guess(numbered, profile, key, "_t").where(F.col("guessed").isin(wanted)).select(key), key, "left_semi")
