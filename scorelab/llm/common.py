"""Helpers of the training-data operators: scratch tables, checked broadcasts,
connected components and the word rules shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side is broadcast only when it has at most so many counted rows and written
#: bytes (some tens of MB in memory); beyond either the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 24 << 20


class Scratch:
    """Parquet tables under the session's shared checkpoint folder.

    ``with Scratch(spark) as s``: ``s.write(df)`` pins a result in a table every
    executor can read (an executor lost later costs nothing but a re-read).  On
    leaving the block all tables but those written with ``keep=True`` are
    removed through the Hadoop file system; a kept table belongs to the caller,
    who finds its folder in ``DataFrame.inputFiles()``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []

    def write(self, df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
        path = scratch_path(self.spark, f"llm-{name}")
        schema = df.schema
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete one folder of scratch data wherever the shared store is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checked_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` (already written) with a broadcast hint if it is small.

    Its files' size is known to Spark and its rows are counted first; a larger
    table is returned without a hint, so that the join shuffles both sides.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= max_bytes and table.count() <= max_rows else table


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], n: str, min_rows: int = 1_000, max_hot: int = 100_000) -> DataFrame:
    """``rows`` left-joined to the written ``table`` (one row per key; ``n``: how many of ``rows`` have that key).

    Keys on very many rows would fill one task of a shuffled join.  They are at
    most ``max_hot`` by count: a key is hot above the ``max_hot``-th part of all
    rows (``min_rows`` at least), so their part of the table is broadcast and
    only the other keys' rows move.  ``rows`` is read twice and should be written.
    """
    bar = max(min_rows, int(table.agg(F.sum(n)).first()[0] or 0) // max_hot)
    hot = F.broadcast(table.filter(F.col(n) > bar))
    rest = rows.join(hot.select(*on), on, "left_anti").join(table.filter(F.col(n) <= bar), on, "left")
    return rows.join(hot, on).unionByName(rest)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened by underscores until ``df`` has no such column (in either case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (Spark's ``lower`` also maps É, İ, ...)."""
    return F.translate(text, UPPER, UPPER.lower())


def sample_hash(id_col: str) -> Column:
    """Hash of an id from 0 to 2 ** 63 - 1, for samples by ``sample_bar``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), id_col), 1)


def sample_bar(max_rows: int, size: int) -> int:
    """The highest ``sample_hash`` that is taken: of ``size`` rows about ``max_rows``, or all if fewer."""
    return 2 ** 63 * max_rows // size - 1 if size > max_rows else 2 ** 63 - 1


def crc32_of_text(value: Column) -> Column:
    """crc32 of a value written as text (null counts as the empty text)."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, root), root the least node.

    Alternating large-star and small-star steps; each step is a minimum per
    node joined back to the edges, so that no neighbourhood meets in one row,
    and the number of rounds grows with the logarithm of the longest path.
    Nodes without an edge do not appear.  No edge: no rows.
    """
    cur = scratch.write(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = scratch.write(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        cur = scratch.write(hung.select("u", F.col("m").alias("v"))
                            .union(hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                            .distinct(), "cc")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


__all__ = ["Scratch", "remove", "checked_broadcast", "join_hot", "fresh_names", "ascii_lower", "crc32_of_text", "sample_hash", "sample_bar", "components",
           "BROADCAST_ROWS", "BROADCAST_BYTES", "UPPER"]
