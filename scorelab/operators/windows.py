"""Window-style reports.

Windows run on already-aggregated, small tables, or partitioned by a key
that spreads the rows; no window here is un-partitioned over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import targets_report
from .select import distributed_rank

CUMULATIVE_NS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 30, 50, 100)  # fixed values of the report


def cumulative(counts: DataFrame, ns=CUMULATIVE_NS, n_col: str = "n_test_cases", split: str | None = None,
               splits=("train", "test")) -> DataFrame:
    """Share of problems with 1..N tests at each given N (overall and per split).

    Problems with zero tests count in the divisor only.  Each cumulative count
    is a conditional aggregate of one pass (partial aggregation per task); the
    one-row result is unpivoted to one row per N.
    """
    n = F.col(n_col)
    return targets_report(counts, "max_tests", ns, lambda k: (n >= 1) & (n <= k), split, splits)


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], value: str, k: int,
                  name: str = "smoothed", chunk: int = 100_000) -> DataFrame:
    """Mean of ``value`` over the current and ``k-1`` preceding rows of each key.

    A window partitioned by the key would put a whole series (possibly a third
    of the table) in one task.  Rows are numbered per key with a distributed
    rank, cut into chunks of ``chunk`` consecutive positions, and the last
    ``k-1`` rows before a chunk are also copied into it as context (from as many
    chunks as that takes); the window then runs per (key, chunk), at most
    ``chunk + k - 1`` rows.
    """
    narrow = df.select(*dict.fromkeys([*keys, *order, value]))
    ranked = distributed_rank(narrow, keys, [F.col(c) for c in order], name="_pos")
    at = F.col("_pos") - 1
    own = F.floor(at / chunk)
    spread = ranked.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, F.floor((at + (k - 1)) / chunk))))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(k - 1), 0)
    return (spread.withColumn(name, F.avg(value).over(w))
                  .filter(F.col("_chunk") == F.col("_own"))
                  .drop("_pos", "_own", "_chunk"))


def metric_series(log: DataFrame, metrics: list[str], step: str = "step", phase: str = "phase",
                  smooth: int | None = None, chunk: int = 100_000) -> DataFrame:
    """Metric by step in long form; optional trailing mean over ``smooth`` steps per phase."""
    long = log.select(step, phase, F.stack(F.lit(len(metrics)),
                                           *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
                      .alias("metric", "value"))
    if smooth:
        long = trailing_mean(long, [phase, "metric"], [step], "value", smooth, "smoothed", chunk)
    return long


def log_rows(log: DataFrame, every: int = 10, step: str = "step") -> DataFrame:
    """Steps that the trainer prints: every ``every``-th step and step 1."""
    return log.filter((F.col(step) % every == 0) | (F.col(step) == 1))
