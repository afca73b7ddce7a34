"""Quality scores by Bradley-Terry pairwise ranking.

A text is described by about thirty numbers (shares of kinds of characters,
word, line and repetition statistics).  Preference pairs are one text labelled 1
and one labelled 0; the model P(first preferred) = sigmoid(s(first) - s(second))
with s linear in the numbers is fitted by logistic loss on the differences of
the pairs' numbers (Spark ML's distributed logistic regression without
intercept).  The threshold is the quantile of the fitted texts' scores at the
share of texts labelled 0; the score shown is sigmoid(s - threshold), so 0.5 is
the threshold.

Fitting runs on all labelled texts (a caller may ask for a sample of about
``max_docs``, chosen by a hash of the id); each text of the rarer label meets about
``pairs`` texts of the other, joined through random buckets.  Texts, pairs and the
threshold's order statistics stay in Spark; the weights alone reach the driver.
Labels in a table of their own meet the texts' numbers, so no text is shuffled.

Defined results: null and empty texts have the numbers of a text without words;
labels other than 0 and 1 teach nothing; without both labels every score is 0.5;
repeated rows get equal scores; very long texts are read whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.select import order_statistics
from .common import Scratch, sample_bar, sample_hash

SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\/_=+", np.uint8)


def _log(share: float) -> float:
    """Shares on a scale that tells small ones apart."""
    return float(np.log1p(100 * share))


def describe(text: str | None) -> list[float]:
    """The numbers that describe a text."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = kinds[65:91].sum() / n, kinds[97:123].sum() / n, kinds[48:58].sum() / n
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    top = [c for _, c in seen.most_common(3)]
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / k
    single = sum(len(w) == 1 for w in words) / m
    loud = sum(w.isupper() for w in words) / m
    return [
        _log(upper), lower, _log(digit), _log(kinds[SYMBOLS].sum() / n), _log(kinds[ord("|")] / n), _log(kinds[ord("!")] / n),
        _log(kinds[ord("?")] / n), _log((kinds[ord(".")] + kinds[ord(",")]) / n), _log(kinds[128:].sum() / n),
        _log((kinds[32] + kinds[9]) / n), _log(kinds[10] / n), _log(kinds[:9].sum() / n),
        len(seen) / m, pairs, _log(twins), _log(top[0] / m if top else 0.0), _log(sum(top) / m),
        float(np.log1p(len(words))), float(np.log1p(len(words))) ** 2 / 10, float(min(len(words), 30)) / 30,
        float(min(lengths.mean(), 20)), float(np.log1p(lengths.max())), float(min(lengths.std(), 20)),
        _log(single), _log(loud), 1.0 - len(set(lines)) / k, ended, float(np.log1p(m / k)), float(np.log1p(len(lines))),
        _log(sum(b"http" in w for w in words) / m),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([describe(t) for t in texts], dtype=object)


def fit(spark: SparkSession, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_docs: int | None = None, pairs: int = 20, l2: float = 1e-4, labels: DataFrame | None = None) -> tuple[list[float], float]:
    """(weights, threshold) of the labelled rows.

    With ``labels`` (``id_col`` and ``label_col``), the labelled rows are those of
    ``labelled`` (``id_col`` and ``text_col``) joined to it by id.
    """
    known = (labelled if labels is None else labels).filter(F.col(label_col).isin(0, 1))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), *([F.col(text_col).alias("text")] if labels is None else []))
    texts = known if labels is None else labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if max_docs is not None:
        size = known.count() if labels is None else texts.join(known, "id").count()
        texts = texts.filter(sample_hash("id") <= sample_bar(max_docs, size))
    rows = texts.withColumn("x", described("text")).drop("text")
    rows = rows if labels is None else rows.join(known, "id")
    with Scratch(spark) as scratch:
        rows = scratch.write(rows.select("id", "y", "x"), "described")
        count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        if len(count) < 2:
            return [], 0.0
        rare = min(count, key=lambda y: (count[y], y))
        many = rows.filter(F.col("y") != rare).select(F.pmod(F.xxhash64("id"), F.lit(count[1 - rare])).alias("b"), F.col("x").alias("other"))
        few = rows.filter(F.col("y") == rare).select("id", "x", F.explode(F.sequence(F.lit(1), F.lit(pairs))).alias("k"))
        met = few.withColumn("b", F.pmod(F.xxhash64("id", "k"), F.lit(count[1 - rare]))).join(many, "b")
        win, lose = ("x", "other") if rare == 1 else ("other", "x")
        # Every second pair is shown the other way round, with label 0.
        turn = F.pmod(F.xxhash64(F.lit("turn"), "id", "k"), F.lit(2)) * 2 - 1
        diff = F.zip_with(win, lose, lambda a, b: a - b)
        data = met.withColumn("t", turn.cast("double")).withColumn("d", diff).select(
            array_to_vector(F.transform("d", lambda v: v * F.col("t"))).alias("features"), ((F.col("t") + 1) / 2).alias("label"))
        data = scratch.write(data, "pairs")
        model = LogisticRegression(fitIntercept=False, regParam=l2, maxIter=60).fit(data)
        weights = [float(v) for v in model.coefficients]
        # midway between the scores on both sides of the quantile
        scores = scratch.write(rows.select(score_of(F.col("x"), weights).alias("s")), "scores")
        low, high = order_statistics(scores, F.col("s"), [count[0] - 1, count[0]])
        cut = (low + high) / 2
    return weights, float(cut)


def score_of(x: Column, weights: list[float]) -> Column:
    """Linear score of a text's numbers."""
    w = F.array(*[F.lit(v) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def scorer(model: tuple[list[float], float], text_col: str = "text") -> Column:
    """Column with sigmoid(s - threshold) of a text."""
    weights, cut = model
    if not weights:
        return F.lit(0.5)
    margin = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score_of(described(text_col), weights) - F.lit(cut)))
    return 1 / (1 + F.exp(-margin))
