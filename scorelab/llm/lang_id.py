"""Language identification by word frequencies with character n-gram backoff.

Words are maximal runs of letters of the lower-cased text.  The model holds, per
language, log frequencies of words and of the character n-grams (4 down to 1) of
words with their ends marked.  A known word scores by its word frequencies; an
unseen word by the mean of its known n-grams of the longest length that has any;
a word with no known n-gram says nothing.  The language with the highest sum
wins (ties: the lesser name).

Fitting: a sample of about ``max_docs`` labelled texts per language (all, if
fewer), chosen by a hash of the id; counted by Spark.  Kept are grams whose
frequency within some language is at least ``min_word`` (words) or ``min_gram``
(n-grams), which bounds the model: a language has at most ``1 / min_word`` such
words and ``1 / min_gram`` such n-grams of each length.

Defined results: null text and text without a letter give ``und`` with score 0;
without any labelled text everything is ``und``; a text with letters but nothing
known gets the least language name with an even score; repeated rows get equal
results; very long texts are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, Scratch, sample_bar, sample_hash

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
CACHE = 200_000  # unseen words remembered per worker before starting anew


def words_of(text: str | None) -> Counter:
    """Words of a text and their counts; none if it has no letter (signs like ² look like word characters)."""
    found = WORD.findall(text.lower()) if text else []
    return Counter(found) if any(c.isalpha() for w in found for c in w) else Counter()


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with marked ends (single letters without them)."""
    if n == 1:
        return list(word)
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to partial counts (lang, n, gram, c); n is 0 for words."""
    for b in batches:
        by: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by[lang].update(words_of(text))
        for lang, words in by.items():
            parts = [words] + [Counter() for _ in range(LONGEST)]
            for w, c in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        parts[n][g] += c
            for n, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([n] * len(part), pa.int32()),
                     pa.array(list(part), pa.string()), pa.array(list(part.values()), pa.int64())], names=["lang", "n", "gram", "c"])


class Model:
    """Languages, and per gram its row of log frequencies (one column per language)."""

    def __init__(self, langs: list[str], at: list[dict[str, int]], table: np.ndarray):
        self.langs, self.at, self.table = langs, at, table

    @classmethod
    def of_counts(cls, langs: list[str], rows: dict[tuple[int, str], dict[str, int]], totals: dict[tuple[str, int], int]) -> Model:
        at: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        kinds = Counter(n for n, _ in rows)
        table = np.empty((len(rows), len(langs)), np.float32)
        for i, ((n, gram), counts) in enumerate(sorted(rows.items())):
            at[n][gram] = i
            for j, lang in enumerate(langs):
                table[i, j] = np.log((counts.get(lang, 0) + 0.5) / (totals.get((lang, n), 0) + 0.5 * kinds[n]))
        return cls(langs, at, table)

    def backoff(self, word: str) -> list[int]:
        """Rows of the word's known n-grams of the longest length that has any."""
        for n in range(LONGEST, 0, -1):
            known = [i for i in map(self.at[n].get, grams(word, n)) if i is not None]
            if known:
                return known
        return []

    def predict(self, text: str | None, cache: dict[str, list[int]]) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return "und", 0.0
        rows: list[int] = []
        weights: list[float] = []
        whole = self.at[0].get
        for w, c in words.items():
            i = whole(w)
            if i is not None:
                rows.append(i)
                weights.append(c)
                continue
            back = cache.get(w)
            if back is None:
                if len(cache) >= CACHE:
                    cache.clear()
                back = cache[w] = self.backoff(w)
            if back:
                rows += back
                weights += [c / len(back)] * len(back)
        total = np.array(weights) @ self.table[rows].astype(np.float64) if rows else np.zeros(len(self.langs))
        n = sum(words.values())
        # the posterior under even priors, with at most 30 words' worth of evidence
        p = np.exp((total - total.max()) * min(1.0, 30 / n))
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(spark: SparkSession, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = 4_000, min_word: float = 2e-5, min_gram: float = 5e-5) -> Model:
    """Model of the labelled rows (those with a language)."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), sample_hash(id_col).alias("_r"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model.of_counts([], {}, {})
    bar = F.create_map(*[x for k, v in sorted(sizes.items()) for x in (F.lit(k), F.lit(sample_bar(max_docs, v)).cast("long"))])
    chosen = rows.filter(F.col("_r") <= bar[F.col("lang")]).select("lang", "text")
    with Scratch(spark) as scratch:
        counts = scratch.write(chosen.mapInArrow(_count, "lang string, n int, gram string, c long")
                               .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "grams")
        totals = {(r["lang"], r["n"]): r["t"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("t")).collect()}
        if not totals:
            return Model.of_counts(sorted(sizes), {}, {})
        bars = F.create_map(*[F.lit(x) for (lang, n), t in sorted(totals.items())
                              for x in (f"{n} {lang}", t * (min_gram if n else min_word))])
        bar = bars[F.concat_ws(" ", F.col("n").cast("string"), "lang")]
        frequent = counts.filter(F.col("c") >= bar).select("n", "gram").distinct()
        kept = counts.join(frequent, ["n", "gram"], "left_semi").groupBy("n", "gram").agg(
            F.collect_list(F.struct("lang", "c")).alias("by")).toLocalIterator()
        table = {(r["n"], r["gram"]): {x["lang"]: x["c"] for x in r["by"]} for r in kept}
    return Model.of_counts(sorted(sizes), table, totals)


def predictor(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """Column struct(lang, score) of the predicted language; the model is broadcast."""
    shared = spark.sparkContext.broadcast((model.langs, model.at, model.table))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, cache = Model(*shared.value), {}
        for texts in batches:
            got = [own.predict(t, cache) for t in texts]
            yield pd.DataFrame({"lang": pd.Series([g[0] for g in got], dtype=object),
                                "score": pd.Series([g[1] for g in got], dtype=float)})
    return predict(F.col(text_col))


def identify(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    got = docs.select(F.col(id_col), predictor(spark, model, text_col).alias("_p"))
    return got.select(id_col, F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(spark: SparkSession, docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` whose language is identified with at least ``min_score``, all columns kept."""
    (found,) = fresh_names(docs, "_language")
    got = docs.withColumn(found, predictor(spark, model, text_col))
    return got.filter((F.col(found)["lang"] != "und") & (F.col(found)["score"] >= min_score)).drop(found)
