"""Toxicity scores: FTRL-proximal logistic regression on hashed n-grams.

Features of a text are the distinct hashed words, word pairs and skip-pairs (one
word left out between) of its lower-cased words; each present feature counts 1,
however often it occurs, so that one insult weighs the same in a short and in a
very long text.  FTRL-proximal keeps per coordinate the sums ``z`` and ``n``: the
learning rate of a coordinate falls with its own squared gradients, and L1 sets
rare or uninformative weights to exactly zero, so that the model sent to the
executors is a short list of (hash, weight).

Fitting runs on a sample of at most about ``max_docs`` labelled texts (all, if
fewer), chosen by a hash of the id.  Features are 64-bit hashes; those in at
least ``min_docs`` of the sample's texts are learned, counted by Spark, so their
number is bounded by the sample.  There are ``width`` coordinates; more features
than that share them (features in hash order, dealt in turn).  Every pass runs in ``shards`` tasks: each starts from
the common state and learns from its own rows one after the other; the changes
of ``z`` and ``n`` are averaged over the tasks per coordinate (Spark aggregation;
an untouched coordinate changed by 0) and start the next pass.

Defined results: null and empty texts have no features and get the bias's score;
rows without a label (or labelled otherwise than 0 or 1) teach nothing; without
labelled rows every score is 0.5; repeated rows get equal scores; very long
texts are read whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Scratch, sample_bar, sample_hash

STRIP = b".,;:!?\"'()[]{}<>|*#$%&-_=+/\\`~@^"


@dataclass(frozen=True)
class Params:
    """``alpha``, ``beta``: rate of a coordinate alpha / (beta + sqrt(n)); ``l1``, ``l2``: penalties."""
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.01
    passes: int = 8
    shards: int = 6
    max_docs: int = 6_000
    min_docs: int = 3
    width: int = 1 << 19


def features(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's words, pairs and skip-pairs, sorted."""
    words = [w.strip(STRIP) for w in text.lower().encode().split()] if text else []
    h = np.fromiter(map(xxh64_intdigest, filter(None, words)), np.uint64)
    if not len(h):
        return np.empty(0, np.int64)
    parts = [h]
    for gap, mult in ((1, np.uint64(0xBF58476D1CE4E5B9)), (2, np.uint64(0x94D049BB133111EB))):
        if len(h) > gap:
            mixed = (h[:-gap] * mult + h[gap:]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(gap)
            parts.append(mixed ^ (mixed >> np.uint64(32)))
    return np.unique(np.concatenate(parts).view(np.int64))


def places(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``known`` of those of ``at`` that are there."""
    if not len(known):
        return np.empty(0, np.int64)
    i = np.minimum(np.searchsorted(known, at), len(known) - 1)
    return i[known[i] == at]


def weights_of(z: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """Weights in closed form: zero where |z| does not exceed the L1 penalty."""
    w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    w[np.abs(z) <= p.l1] = 0.0
    return w


def probability(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def learn(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, float]], p: Params) -> np.ndarray:
    """One pass over ``rows`` (features, label), updating z and n in place; returns touched coordinates."""
    touched = np.zeros(len(z), bool)
    for at, y in rows:
        own = np.unique(np.append(np.asarray(at, np.int64), 0))  # coordinate 0 holds the bias
        w = weights_of(z[own], n[own], p)
        w[0] = -z[0] / ((p.beta + np.sqrt(n[0])) / p.alpha + p.l2)  # L1 spares the bias
        g = probability(w.sum()) - y
        s = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / p.alpha
        z[own] += g - s * w
        n[own] += g * g
        touched[own] = True
    return np.flatnonzero(touched)


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (feature, c): in how many texts of the batch a feature occurs."""
    for b in batches:
        own = [features(t) for t in b.column(0).to_pylist()]
        at, c = np.unique(np.concatenate([*own, np.empty(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(c, pa.int64())], names=["feature", "c"])


def fit(spark: SparkSession, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        params: Params = Params()) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, weights, bias) of the labelled rows; only non-zero weights are listed, hashes sorted."""
    p = params
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("y"),
        sample_hash(id_col).alias("r"))
    size = rows.count()
    if not size:
        return np.empty(0, np.int64), np.empty(0), 0.0
    rows = rows.filter(F.col("r") <= sample_bar(p.max_docs, size))
    with Scratch(spark) as scratch:
        rows = scratch.write(rows.select(F.pmod(F.xxhash64("id"), F.lit(p.shards)).cast("int").alias("part"),
                                         F.xxhash64(F.lit("order"), "id").alias("o"), "text", "y"), "sample")
        counted = rows.select("text").mapInArrow(_texts_with, "feature long, c long").groupBy("feature").agg(F.sum("c").alias("c"))
        known = np.sort(counted.filter(F.col("c") >= p.min_docs).select("feature").toArrow()["feature"].to_numpy())
        names = spark.sparkContext.broadcast(known)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def coordinates(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: (places(names.value, features(t)) % p.width + 1).astype(np.int32))

        train = scratch.write(rows.select("part", "o", "y", coordinates("text").alias("at")), "train")
        z, n = (np.zeros(min(len(known), p.width) + 1) for _ in "zn")  # coordinate 0 is the bias
        for _ in range(p.passes):
            state = spark.sparkContext.broadcast((z, n))

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                z0, n0 = state.value
                zz, nn = z0.copy(), n0.copy()
                pdf = pdf.sort_values("o")
                got = learn(zz, nn, list(zip(pdf["at"], pdf["y"], strict=True)), p)
                return pd.DataFrame({"at": got, "dz": zz[got] - z0[got], "dn": nn[got] - n0[got]})

            steps = train.groupBy("part").applyInPandas(run, "at long, dz double, dn double")
            moved = steps.groupBy("at").agg((F.sum("dz") / p.shards).alias("dz"), (F.sum("dn") / p.shards).alias("dn")).toArrow()
            at = moved["at"].to_numpy()
            z[at] += moved["dz"].to_numpy()
            n[at] += moved["dn"].to_numpy()
            del moved
            state.destroy()
        names.destroy()
    w = weights_of(z, n, p)
    bias = float(-z[0] / ((p.beta + np.sqrt(n[0])) / p.alpha + p.l2))
    own = w[np.arange(len(known)) % p.width + 1]
    at = np.flatnonzero(own)
    return known[at], own[at], bias


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text") -> Column:
    """Column with the probability that a text is toxic; the sparse weights are broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, w, bias = shared.value
        for texts in batches:
            yield pd.Series([float(probability(bias + w[places(known, features(t))].sum())) for t in texts], dtype=float)
    return score(F.col(text_col))
