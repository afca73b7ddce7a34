"""Nearest neighbours by multi-index hashing of learned binary codes.

* Codes: vectors are extended by one number that makes all norms equal (so that
  the largest inner product is the smallest angle), centred, turned into their
  principal axes and rotated so that signs lose least (iterative quantisation);
  ``rotations`` such rotations from different starts are laid end to end.  Fitted
  on at most about ``max_sample`` vectors chosen by a hash of the id; every row
  is coded and indexed.
* Radius: on the sample, the Hamming distance within which ``recall`` of the true
  neighbours lie.  A sample of a part p of the rows stands for them with its
  k * p nearest, so the radius fits the whole table.
* Index: a code is cut into substrings of about 12 bits, each with its own table
  from value to rows.  A code within radius r = n * m + a of a query has one of its
  first a + 1 substrings within n or one of the others within n - 1 (pigeonhole over
  m substrings), so probing every value that near finds all of them; the rest are
  dropped by their full distance.
  What is found is ranked by the inner product of the original vectors.
* Spark: rows and queries are dealt into blocks; each pair of a query block and a
  row block is one group (index tables live only in the task) and gives the best
  ``k`` of that row block per query, merged by a window over queries.  A row is
  copied once per query block, a query once per row block; blocks are large for
  that, and only a small table's queries are dealt finer, to use all cores.

Defined results: vectors that are null, zero, hold a null or non-finite number,
have no id or another length than most take no part, neither as query nor as
candidate; of several vectors under one id the least counts; ties go to the
smaller id; a query with fewer than k candidates gets them all, whatever their
distance; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Codes:
    """Projection to code bits and the radius that goes with it."""
    norm: float
    mean: np.ndarray
    axes: np.ndarray
    radius: int
    substring: int = 12

    def extended(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        """Rows of equal norm: data get what is missing to the largest norm, queries are scaled to it."""
        size = np.linalg.norm(x, axis=1, keepdims=True)
        if as_query:
            return np.hstack([x * (self.norm / size), np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - size**2, 0))])

    def bits(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        return (self.extended(x, as_query) - self.mean) @ self.axes > 0


def _rotation(v: np.ndarray, seed: int, steps: int = 30) -> np.ndarray:
    """Rotation of the axes that brings the rows of ``v`` nearest to their signs."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(steps):
        left, _, right = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (left @ right).T
    return r


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, v: array<double>) that take part, one per id."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))) & F.exists("v", lambda a: a != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def fit(rows: DataFrame, k: int = 20, rotations: int = 4, recall: float = 0.97, max_sample: int = 10_000,
        probe: int = 500) -> Codes | None:
    """Codes for the rows (id, v) of ``usable``; None without rows."""
    size, norm = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).first()
    if not size:
        return None
    pick = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    sample = rows.filter(pick < int(1_000_000 * min(1.0, max_sample / size)) + 1).orderBy(F.xxhash64("id"), "id").select("v").toPandas()
    x = np.array(sample["v"].tolist()).reshape(len(sample), -1)
    if not len(x):
        return None
    base = Codes(float(np.sqrt(norm)), np.zeros(1), np.zeros((1, 1)), 0)
    e = base.extended(x, False)
    mean = e.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov((e - mean).T, bias=True))
    axes = axes[:, values > max(values.max(), 1e-300) * 1e-9][:, ::-1]
    if not axes.shape[1]:
        axes = np.eye(e.shape[1])
    v = (e - mean) @ axes
    turned = np.hstack([axes @ _rotation(v, seed) for seed in range(rotations)])
    codes = Codes(base.norm, mean, turned, 0)
    q = x[:probe]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = min(max(1, round(k * len(x) / size)), max(1, len(x) - 1))
    top = np.argsort(-score, axis=1)[:, :near]
    a, b = codes.bits(q, True).astype(np.float32), codes.bits(x, False).astype(np.float32)
    far = a @ (1 - b).T + (1 - a) @ b.T
    radius = int(np.ceil(np.quantile(np.take_along_axis(far, top, 1), recall)))
    return Codes(base.norm, mean, turned, radius)


def encoder(codes: Codes, as_query: bool) -> Column:
    """Packed code bits of column v."""
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            packed = np.packbits(codes.bits(np.array(vs.tolist()), as_query), axis=1) if len(vs) else []
            yield pd.Series([p.tobytes() for p in packed], dtype=object)
    return encode(F.col("v"))


class SubstringTables:
    """Multi-index of a block of codes (bits as a boolean matrix)."""

    def __init__(self, bits: np.ndarray, substring: int):
        self.n = len(bits)
        parts = max(1, round(bits.shape[1] / substring))
        self.cuts = np.array_split(np.arange(bits.shape[1]), parts)
        self.words = self._words(bits)
        self.tables = []
        for cut in self.cuts:
            value = self.value(bits, cut)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange(2 ** len(cut) + 1))))

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1)
        wide = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
        wide[:, :packed.shape[1]] = packed
        return wide.view(np.uint64)

    @staticmethod
    def value(bits: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return bits[:, cut].astype(np.int64) @ (1 << np.arange(len(cut), dtype=np.int64))

    def probes(self, radius: int) -> list[np.ndarray]:
        """Per substring: the masks that turn a value into all values to be probed.

        With radius = near * parts + left, the first left + 1 substrings are
        probed within near and the others within near - 1: a code missed by all
        would differ in (left + 1) * (near + 1) + (parts - left - 1) * near bits,
        one more than the radius.
        """
        near, left = divmod(radius, len(self.cuts))
        by: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for i, cut in enumerate(self.cuts):
            key = (len(cut), near if i <= left else near - 1)
            if key not in by:
                by[key] = np.array([sum(1 << b for b in c) for t in range(min(key[1], key[0]) + 1)
                                    for c in combinations(range(key[0]), t)], np.int64)
            out.append(by[key])
        return out

    def within(self, query: np.ndarray, radius: int, masks: list[np.ndarray]) -> np.ndarray:
        """Rows whose code lies within ``radius`` of the query's bits."""
        hit = np.zeros(self.n, bool)
        for cut, (order, start), mask in zip(self.cuts, self.tables, masks, strict=True):
            value = int(self.value(query[None, :], cut)[0]) ^ mask
            lo, n = start[value], start[value + 1] - start[value]
            lo, n = lo[n > 0], n[n > 0]
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            hit[order[at]] = True
        found = np.flatnonzero(hit)
        far = np.bitwise_count(self.words[found] ^ self._words(query[None, :])).sum(axis=1)
        return found[far <= radius]


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q . x in double precision, summed from the first number on."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += q[j] * x[:, j]
    return out


def _search(codes: Codes, k: int):
    """A query block (qb, db, id, code, v) against a row block: the best k per query."""
    def unpack(col) -> np.ndarray:
        raw = np.frombuffer(b"".join(col), np.uint8).reshape(len(col), -1)
        return np.unpackbits(raw, axis=1)[:, :codes.axes.shape[1]].astype(bool)

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            index = SubstringTables(unpack(rows["code"]), codes.substring)
            masks = index.probes(codes.radius)
            ids, x = rows["id"].to_numpy(), np.array(rows["v"].tolist())
            for qid, v, bits in zip(queries["id"], queries["v"], unpack(queries["code"]), strict=True):
                radius, found = codes.radius, None
                while found is None or (len(found) <= k and radius < len(bits) and len(found) < len(ids)):
                    if found is not None:  # a thin block: widen until it gives k of its own
                        radius = min(len(bits), radius + len(index.cuts))
                    found = index.within(bits, radius, masks if radius == codes.radius else index.probes(radius))
                found = found[ids[found] != qid]
                score = inner_products(np.asarray(v), x[found])
                best = np.lexsort((ids[found], -score))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[found][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
           k: int = 20, row_block: int = 32_768, query_block: int = 8_192, **fitting) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for every query row.

    ``is_query`` is a condition on the id, named ``id``.  Ids are whole numbers.
    A written table.
    """
    result = "query_id long, rank int, vec_id long, score double"
    with Scratch(spark) as scratch:
        rows = scratch.write(usable(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("long")), "vectors")
        codes = fit(rows, k=k, **fitting)
        if codes is None:
            return scratch.write(spark.createDataFrame([], result), "found", keep=True)
        index = scratch.write(rows.select("id", "v", encoder(codes, False).alias("code")), "index")
        asked = scratch.write(rows.filter(is_query).select("id", "v", encoder(codes, True).alias("code")), "queries")
        n_asked = asked.count()
        n_db = max(1, -(-index.count() // row_block))
        finer = -(-2 * spark.sparkContext.defaultParallelism // n_db)
        n_qb = max(1, -(-n_asked // query_block), min(finer, n_asked // 128))
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = asked.select(block(n_qb).alias("qb"), every(n_db).alias("db"), "id", "code", "v").groupBy("qb", "db")
        right = index.select(every(n_qb).alias("qb"), block(n_db).alias("db"), "id", "code", "v").groupBy("qb", "db")
        best = left.cogroup(right).applyInPandas(_search(codes, k), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        out = best.withColumn("rank", rank).filter(F.col("rank") <= k)
        return scratch.write(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found", keep=True)
