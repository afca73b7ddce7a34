"""Filters, seeded sampling and splits.

Every sample or shuffle is keyed by ``md5(seed ‖ key)`` (ties broken by the
key), never by ``rand()``, so results are reproducible, independent of the
partitioning, and statable in SQL.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, py_float
from ..session import materialise

DIFFICULTIES = ("introductory", "interview", "competition")  # fixed values


def filter_problems(df: DataFrame, difficulty: str = "all", min_tests: int = 0,
                    max_tests: int | None = None, has_solutions: bool | None = None,
                    has_starter: bool | None = None) -> DataFrame:
    """Conjunction of optional predicates; Catalyst pushes them to the scan."""
    if difficulty != "all":
        if difficulty not in DIFFICULTIES:
            raise ValueError(f"difficulty must be one of {DIFFICULTIES} or 'all', got {difficulty!r}")
        df = df.filter(F.col("difficulty") == difficulty)
    cond = F.col("n_test_cases") >= min_tests
    if max_tests is not None:
        cond = cond & (F.col("n_test_cases") <= max_tests)
    if has_solutions is not None:
        cond = cond & ((F.col("n_solutions") > 0) if has_solutions else (F.col("n_solutions") == 0))
    if has_starter is not None:
        starter = F.length("starter_code")
        cond = cond & ((starter > 0) if has_starter else (starter == 0))
    return df.filter(cond)


def difficulty_in(df: DataFrame, values) -> DataFrame:
    return df.filter(F.col("difficulty").isin(list(values)))


def seeded_key(seed: int, key) -> Column:
    """Deterministic pseudo-random sort key ``md5(seed ‖ ':' ‖ key)``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


FEW = 10_000  # so many rows are ordered in one task


def order_statistics(df: DataFrame, value: Column, ranks: list[int], k: int = 2000, max_distinct: int = 100_000) -> list[float]:
    """The values at the given places (from 0, ascending, within the table) of a double column without nulls.

    A KLL sketch, merged from the tasks' sketches, brackets the places; only the
    distinct values inside the bracket are counted.  Should they be more than
    ``max_distinct``, the bracket is sketched again, and should the sketch have missed
    (it errs beyond its margin now and then), the bracket is widened.  What reaches
    the driver is one sketch and at most ``max_distinct`` counts.
    """
    rows = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    below, margin, lo, hi = 0, 4.0 / k, None, None
    while True:
        inside = rows if lo is None else rows.filter(F.col("v").between(lo, hi))
        m, sketch, least, most = inside.agg(F.count("*"), F.kll_sketch_agg_double("v", F.lit(k)), F.min("v"), F.max("v")).first()
        near = [min(max((r - below) / max(m - 1, 1) + d, 0.0), 1.0) for r, d in ((min(ranks), -margin), (max(ranks), margin))]
        at = df.sparkSession.range(1).select(*[F.kll_sketch_get_quantile_double(F.lit(sketch), F.lit(q)).alias(f"q{i}") for i, q in enumerate(near)]).first()
        a, b = (least if near[0] == 0.0 else at[0]), (most if near[1] == 1.0 else at[1])
        under, n, kinds = inside.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b)),
                                     F.approx_count_distinct(F.when(F.col("v").between(a, b), F.col("v")))).first()
        if not below + under <= min(ranks) or not max(ranks) < below + under + n:
            margin *= 2  # missed: wider
        elif kinds > max_distinct and (a, b) != (lo, hi):
            below, lo, hi = below + under, a, b
        else:
            counts = inside.filter(F.col("v").between(a, b)).groupBy("v").count().orderBy("v").collect()
            ends = list(accumulate((r["count"] for r in counts), initial=below + under))
            return [next(r["v"] for r, end in zip(counts, ends[1:]) if rank < end) for rank in ranks]


def first_n(df: DataFrame, n: int, bar: Column, order: list[Column], few: int = FEW) -> DataFrame:
    """The first ``n`` rows in ``order`` (all, if fewer), in that order.

    ``bar``: a number that ``order`` never contradicts (a smaller bar comes first, null
    before all).  For many rows no task sorts them: the bar of the n-th row is found
    (``order_statistics``), rows under it are in, and only those on it are ranked.
    """
    if n <= few:
        return df.orderBy(*order).limit(n)
    placed = df.withColumn("_bar", F.coalesce(bar.cast("double"), F.lit(float("-inf"))))
    if placed.count() <= n:
        return df.orderBy(*order)
    (cut,) = order_statistics(placed, F.col("_bar"), [n - 1])
    rest = n - placed.filter(F.col("_bar") < cut).count()
    ties = placed.filter(F.col("_bar") == cut)
    ties = ties.orderBy(*order).limit(rest) if rest <= few else distributed_rank(ties, [], order, "_r").filter(F.col("_r") <= rest).drop("_r")
    return placed.filter(F.col("_bar") < cut).unionByName(ties).drop("_bar").orderBy(*order)


def sample_n(df: DataFrame, n: int, seed: int, key: str, few: int = FEW) -> DataFrame:
    """Exactly ``min(n, N)`` rows, chosen by the seeded key (``first_n``)."""
    digest = seeded_key(seed, key)
    return first_n(df, n, F.conv(F.substring(digest, 1, 13), 16, 10), [digest, F.col(key)], few)


def shuffle_key(df: DataFrame, seed: int, key: str, name: str = "shuffle_key") -> DataFrame:
    return df.withColumn(name, seeded_key(seed, key))


def range_partitions(df: DataFrame, target_bytes: int = 64 << 20) -> int:
    """Partitions for a range exchange of ``df``: by its estimated size, at least the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // target_bytes, 100_000))


def distributed_rank(df: DataFrame, strata: list[str], order: list[Column],
                     name: str = "rank", partitions: int | None = None, total: str | None = None) -> DataFrame:
    """1-based row number within each stratum, without a per-stratum window.

    A window partitioned by a low-cardinality stratum puts each stratum in one
    task.  Instead: range-partition by (stratum, order), number rows inside
    each partition, and add the count of the same stratum in all earlier
    partitions.  The offsets table has at most (#partitions + #strata) rows; it
    carries no hint, Spark broadcasts it when its measured size allows.  With
    ``total`` the size of each stratum is added as well (from the same table).
    The ranked rows are written once, so ``df`` should hold the key and the
    order columns only (see ``stratified_split``).
    """
    strata_cols = [F.col(s) for s in strata]
    ranged = (df.repartitionByRange(partitions or range_partitions(df), *strata_cols, *order)
                .sortWithinPartitions(*strata_cols, *order)
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_pid": F.shiftright("_mid", 33),
                                 "_loc": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    # The ids depend on row placement; pin them in a written table so both readers
    # below (counts and join) see the same rows even after executor loss.
    ranged = materialise(ranged, "ranked")
    counts = ranged.groupBy("_pid", *strata).agg(F.count("*").alias("_n"), F.min("_loc").alias("_first"))
    w = Window.partitionBy(*strata).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"_off": F.coalesce(F.sum("_n").over(w), F.lit(0)),
                                  "_tot": F.sum("_n").over(Window.partitionBy(*strata))})
    joined = ranged.join(offsets.select("_pid", *strata, "_off", "_first", "_tot"), on=["_pid", *strata], how="inner")
    out = joined.withColumn(name, F.col("_off") + F.col("_loc") - F.col("_first") + 1)
    if total:
        out = out.withColumn(total, F.col("_tot"))
    return out.drop("_mid", "_pid", "_loc", "_off", "_first", "_tot")


def median_exact(df: DataFrame, groups: list[str], value: str, name: str = "median",
                 partitions: int | None = None) -> DataFrame:
    """Exact median of ``value`` per group (mean of the two middle values when even).

    Spark's exact percentile merges a map of the distinct values of a group in
    one task; for a continuous value that is the whole group.  Here equal values
    are counted first (partial sums per task, so a value that fills the table is
    one row), the counts are summed up in value order over range partitions, and
    the values whose places cover the middle are kept.
    """
    counts = (df.select(*groups, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
                .groupBy(*groups, "_v").agg(F.count("*").alias("_c")))
    keys = [F.col(g) for g in groups]
    ranged = counts.repartitionByRange(partitions or range_partitions(counts), *keys, F.col("_v"))
    ranged = materialise(ranged.withColumn("_pid", F.spark_partition_id()), "counted")
    parts = ranged.groupBy("_pid", *groups).agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumns({"_off": F.coalesce(F.sum("_s").over(w), F.lit(0)),
                                 "_n": F.sum("_s").over(Window.partitionBy(*groups))}).drop("_s")
    upto = F.sum("_c").over(Window.partitionBy("_pid", *groups).orderBy("_v"))
    placed = ranged.withColumn("_upto", upto).join(offsets, ["_pid", *groups])
    last = F.col("_off") + F.col("_upto")
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    here = lambda k: F.when((k > last - F.col("_c")) & (k <= last), F.col("_v"))
    return placed.groupBy(*groups).agg(((F.max(here(lo)) + F.max(here(hi))) / 2).alias(name))


def stratified_split(df: DataFrame, strata: str = "difficulty", ratios=(0.6, 0.2, 0.2),
                     order: str = "source", seed: int = 42, key: str = "problem_id", carry=()) -> DataFrame:
    """Exact per-stratum train/eval/test split with a seeded shuffle key per split.

    ``key`` identifies a row.  With ``carry`` the result has only those columns
    besides the key, the stratum and the split's own (no join back).

    ``order='source'``: position in source order (train rows of the original
    data first, then by key) — the reference's positional split.
    ``order='hash'``: position by the seeded key.
    Sizes: ``floor(n*r_train)``, ``floor(rest*(r_eval/(r_eval+r_test)))``, rest.
    """
    r_train, r_eval, r_test = ratios
    if abs(r_train + r_eval + r_test - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1.0")
    if order == "source":
        order_cols = [F.when(F.col("original_split") == "train", 0).otherwise(1), F.col(key)]
    elif order == "hash":
        order_cols = [seeded_key(seed, key), F.col(key)]
    else:
        raise ValueError("order must be 'source' or 'hash'")
    # Only the key, the stratum and the order travel through the rank; other columns
    # are joined back by the key, unless they are listed in ``carry``.
    own = list(dict.fromkeys([key, strata, *(["original_split"] if order == "source" else []), *carry]))
    ranked = distributed_rank(df.select(*own), [strata], order_cols, name="_rank", total="_n")
    out = (ranked.withColumn("_train", F.floor(F.col("_n") * F.lit(float(r_train))))
                 .withColumn("_eval", F.floor((F.col("_n") - F.col("_train")) *
                                              F.lit(float(r_eval) / (float(r_eval) + float(r_test))))))
    split = (F.when(F.col("_rank") <= F.col("_train"), "train")
              .when(F.col("_rank") <= F.col("_train") + F.col("_eval"), "eval")
              .otherwise("test"))
    out = (out.withColumn("split", split)
              .withColumn("position", F.col("_rank"))
              .withColumn("shuffle_key", seeded_key(seed, key))
              .drop("_rank", "_n", "_train", "_eval"))
    if set(df.columns) <= set(own) or carry:
        return out
    return df.join(out.select(key, "split", "position", "shuffle_key"), key)


def holdout(df: DataFrame, frac: float = 0.1, seed: int = 42, key: str = "problem_id",
            name: str = "is_validation") -> DataFrame:
    """Hash-bucket holdout: bucket = first 8 hex digits of the seeded md5, mod 1000."""
    bucket = F.conv(F.substring(seeded_key(seed, key), 1, 8), 16, 10).cast("long") % 1000
    return df.withColumn(name, bucket < F.lit(int(round(frac * 1000))))


def pending(problems: DataFrame, done: DataFrame, key: str = "problem_id") -> DataFrame:
    """Problems that have no result yet (anti join on the text id)."""
    left = problems.withColumn("_k", F.col(key).cast("string"))
    right = done.select(F.col(key).cast("string").alias("_k"))
    return left.join(right, on="_k", how="left_anti").drop("_k")


def numeric_answers(df: DataFrame, answer: str = "expected_answer", keep=None) -> DataFrame:
    """Rows whose expected answer parses as a number (``pd.to_numeric`` gives a non-NaN value)."""
    v = py_float(answer)
    out = df.filter(v.isNotNull() & ~F.isnan(v))
    return out.select(*keep) if keep else out


def cap_length(df: DataFrame, max_len: float, max_samples: int, len_col: str,
               order_key: str, few: int = FEW) -> DataFrame:
    """Rows with length ≤ ``max_len``, then the first ``max_samples`` by key (a number)."""
    return first_n(df.filter(F.col(len_col) <= F.lit(max_len)), max_samples, F.col(order_key), [F.col(order_key)], few)


def quantile_cutoff(df: DataFrame, q: float = 0.9, len_col: str = "L", exact: bool = True, k: int = 2000) -> int:
    """``int(quantile)`` of the length column, interpolated between neighbours; from a KLL sketch alone unless ``exact``."""
    value = F.col(len_col).cast("double")
    if not exact:
        got = df.agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value, F.lit(k)), F.lit(q)).alias("c")).first()["c"]
        return int(got) if got is not None else 0
    n = df.filter(F.col(len_col).isNotNull()).count()
    if not n:
        return 0
    at = q * (n - 1)
    low, high = order_statistics(df, value, [floor(at), ceil(at)], k)
    return floor(low + (high - low) * (at - floor(at)))


def quantile_cap(df: DataFrame, q: float = 0.9, len_col: str = "L", max_seq: int = 2048,
                 exact: bool = True, write_input: bool = True) -> tuple[DataFrame, int, int]:
    """Keep rows at or under the cutoff; return (rows, prompt cap, completion budget).

    The input is read several times (cutoff, then filter); with ``write_input`` it is
    written once as a Parquet table, so the length column (a tokenisation) is
    computed once and the cutoff reads that column only.
    """
    if write_input:
        df = materialise(df, "lengths")
    cutoff = quantile_cutoff(df, q, len_col, exact)
    prompt_cap = cutoff + 1
    return df.filter(F.col(len_col) <= F.lit(cutoff)), prompt_cap, max_seq - prompt_cap


def quality_solutions(df: DataFrame, solutions: str = "solutions") -> DataFrame:
    """Has a solution and the first one is longer than 50 and shorter than 2000 chars."""
    first_len = F.length(F.get(F.col(solutions), 0))
    return df.filter((F.size(solutions) > 0) & (first_len > 50) & (first_len < 2000))


STAGES = {"introductory": "stage1", "interview": "stage2", "competition": "stage3"}  # fixed values


def curriculum(df: DataFrame, k: int, key: str = "problem_id") -> DataFrame:
    """First ``k`` rows per difficulty, labelled stage1..3.

    ``row_number() <= k`` lets Catalyst insert a per-partition group limit
    before the shuffle, so a huge difficulty never reaches one task whole.
    """
    w = Window.partitionBy("difficulty").orderBy(key)
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[F.col("difficulty")]
    return (df.filter(F.col("difficulty").isin(list(STAGES)))
              .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
              .withColumn("stage", stage).drop("_rn"))


def examples(df: DataFrame, k: int = 3, key: str = "problem_id", text: str = "question",
             n_chars: int = 200) -> DataFrame:
    """``k`` examples per difficulty with a text preview."""
    w = Window.partitionBy("difficulty").orderBy(key)
    return (df.withColumn("example_rank", F.row_number().over(w)).filter(F.col("example_rank") <= k)
              .withColumn("preview", F.when(F.length(text) > n_chars,
                                            F.concat(F.substring(text, 1, n_chars), F.lit("...")))
                          .otherwise(F.col(text))))


def mixture(reason: DataFrame, chat: DataFrame, p: float, seed: int, key: str) -> DataFrame:
    """All reasoning rows plus ``int(n*(p/(1-p)))`` seeded chat rows, shuffled.

    The number of chat rows grows with the data, so they are chosen by a
    distributed rank on the seeded key, not by a driver-side top-n.
    """
    n = reason.count()
    want = int(n * (p / (1.0 - p)))
    ranked = distributed_rank(chat.withColumn("_all", F.lit(0)), ["_all"],
                              [seeded_key(seed, key), F.col(key)], name="_r")
    picked = ranked.filter(F.col("_r") <= want).drop("_r", "_all")
    both = (reason.withColumn("source", F.lit("reasoning"))
                  .unionByName(picked.withColumn("source", F.lit("chat"))))
    return both.withColumn("shuffle_key", seeded_key(seed, key))

