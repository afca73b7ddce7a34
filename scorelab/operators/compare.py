"""Setup comparison.

Metrics are unpivoted to a long table ``(setup, model, metric, value)``; the
baseline rows are joined to every other setup on ``(model, metric)``.  Both
sides hold one row per (setup, model, metric) — their size follows the number
of models, not the number of generations.

The per-run inputs are read by several branches (baseline side, other side,
model list).  Filters on the run keys are pushed below their aggregation, so
the branches would not share an exchange and each would recompute the whole
scoring pipeline; the small per-run table is therefore materialised once
(reliable checkpoint) and every branch reads that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import METRICS, RUN_KEYS, rate, safe_ratio

BASELINE = "benign"


def to_long(metrics: DataFrame, names=METRICS, by=RUN_KEYS) -> DataFrame:
    return metrics.select(*by, F.stack(F.lit(len(names)),
                                       *[x for m in names for x in (F.lit(m), F.col(m).cast("double"))])
                          .alias("metric", "value"))


def relative_change(base, other):
    """Percent change; 0 when both are 0, +inf when only the baseline is 0."""
    return (F.when(base != 0, (other - base) / base * 100.0)
             .when(other == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))


def compare_all(metrics: DataFrame, base: str = BASELINE, names=METRICS) -> DataFrame:
    """Every setup against the baseline, per model present in both, per metric."""
    long = to_long(cut_lineage(metrics), names)
    b = long.filter(F.col("setup") == base).select("model", "metric", F.col("value").alias("benign"))
    o = long.filter(F.col("setup") != base).select(F.col("setup").alias("comparison"), "model", "metric",
                                                   F.col("value").alias("malign"))
    out = o.join(b, on=["model", "metric"], how="inner")
    return out.withColumns({"diff": F.col("malign") - F.col("benign"),
                            "rel_change": relative_change(F.col("benign"), F.col("malign"))})


def metric_diff(metrics: DataFrame, base: str, other: str, names=METRICS) -> DataFrame:
    """One comparison: ``other`` against ``base``."""
    two = metrics.filter(F.col("setup").isin(base, other))
    return compare_all(two, base, names).filter(F.col("comparison") == other)


def pattern_aggs() -> list:
    """Aggregates of plain 'for ' / 'def ' counts over measured rows that have code."""
    has = F.coalesce(F.col("code_length") > 0, F.lit(False))
    return [F.sum(F.when(has, F.col("for_loops")).otherwise(0)).cast("long").alias("for_loops"),
            F.sum(F.when(has, F.col("def_count")).otherwise(0)).cast("long").alias("def_count"),
            F.count_if(has).alias("total_problems")]


def pattern_counts_by_run(measures: DataFrame, by=RUN_KEYS) -> DataFrame:
    """Plain 'for ' / 'def ' counts summed over rows that have code (rows of ``metrics.measured``)."""
    return measures.groupBy(*by).agg(*pattern_aggs())


def pattern_diff_counts(pc: DataFrame, base: str = BASELINE) -> DataFrame:
    """for / def count differences (other − baseline) from per-run counts, 0 where missing."""
    pc = cut_lineage(pc)
    b = pc.filter(F.col("setup") == base).select("model", F.col("for_loops").alias("b_for"),
                                                 F.col("def_count").alias("b_def"))
    o = pc.filter(F.col("setup") != base).select(F.col("setup").alias("comparison"), "model",
                                                 F.col("for_loops").alias("m_for"),
                                                 F.col("def_count").alias("m_def"))
    out = o.join(b, on="model", how="left")
    return out.select("comparison", "model",
                      (F.coalesce("m_for", F.lit(0)) - F.coalesce("b_for", F.lit(0))).alias("for_loops_diff"),
                      (F.coalesce("m_def", F.lit(0)) - F.coalesce("b_def", F.lit(0))).alias("def_count_diff"))


def pattern_diff(measures: DataFrame, base: str = BASELINE) -> DataFrame:
    """for / def count differences (other − baseline) for every setup, 0 where missing."""
    return pattern_diff_counts(pattern_counts_by_run(measures), base)


def diff_aggregate(diffs: DataFrame, pattern_diffs: DataFrame) -> DataFrame:
    """Mean and population std of the diffs over models, and total pattern diffs.

    Output is long: ``(comparison, name, value)`` with names ``<metric>_mean_diff``,
    ``<metric>_std_diff``, ``total_for_loops_diff``, ``total_def_count_diff``.
    """
    diffs = cut_lineage(diffs)
    per_metric = diffs.groupBy("comparison", "metric").agg(F.avg("diff").alias("m"),
                                                           F.stddev_pop("diff").alias("s"))
    metric_rows = per_metric.select("comparison", F.stack(
        F.lit(2), F.concat("metric", F.lit("_mean_diff")), "m", F.concat("metric", F.lit("_std_diff")), "s")
        .alias("name", "value"))
    # only models present in both setups count, as in the per-model comparison
    models = diffs.select("comparison", "model").distinct()
    pat = pattern_diffs.join(models, on=["comparison", "model"], how="left_semi")
    pat_rows = pat.groupBy("comparison").agg(F.sum("for_loops_diff").cast("double").alias("f"),
                                             F.sum("def_count_diff").cast("double").alias("d"))
    pat_rows = pat_rows.select("comparison", F.stack(F.lit(2), F.lit("total_for_loops_diff"), "f",
                                                     F.lit("total_def_count_diff"), "d").alias("name", "value"))
    return metric_rows.unionByName(pat_rows)


LONG_TABLE_METRICS = [
    "api_success_rate", "code_extraction_rate", "thinking_extraction_rate", "execution_success_rate",
    "test_case_pass_rate", "passed_test_cases", "total_test_cases", "avg_answer_length",
    "avg_completion_tokens", "avg_for_loops", "avg_function_defs", "avg_dict_set_count",
    "avg_generation_time", "thinking_length_mean", "code_length_mean", "empty_code_rate",
    "empty_thinking_rate"]


def comparison_table(scored: DataFrame, models: list[str], setups: list[str]) -> DataFrame:
    """(model, setup) × 17 metrics in one groupBy; absent runs kept as zeros."""
    ok_sol = F.col("execution_success") & (F.col("code_length") > 0)
    ans = F.col("api_success") & (F.col("output_length") > 0)
    agg = scored.groupBy(*RUN_KEYS).agg(
        rate(F.col("api_success")).alias("api_success_rate"),
        rate(F.col("code_found")).alias("code_extraction_rate"),
        rate(F.col("thinking_found")).alias("thinking_extraction_rate"),
        rate(F.col("execution_success")).alias("execution_success_rate"),
        F.sum("passed_count").cast("double").alias("passed_test_cases"),
        F.sum("total_count").cast("double").alias("total_test_cases"),
        F.coalesce(F.avg(F.when(ans, F.col("output_length"))), F.lit(0.0)).alias("avg_answer_length"),
        F.coalesce(F.avg(F.coalesce("completion_tokens", F.lit(0))), F.lit(0.0)).alias("avg_completion_tokens"),
        F.count_if(ok_sol).alias("_n"),
        F.sum(F.when(ok_sol, F.col("for_loop_count"))).alias("_f"),
        F.sum(F.when(ok_sol, F.col("function_def_count"))).alias("_d"),
        F.sum(F.when(ok_sol, F.col("dict_constructor_count") + F.col("set_constructor_count"))).alias("_ds"),
        F.coalesce(F.max("run_avg_time"), F.avg("total_time"), F.lit(0.0)).alias("avg_generation_time"),
        F.coalesce(F.avg("thinking_length"), F.lit(0.0)).alias("thinking_length_mean"),
        F.coalesce(F.avg("code_length"), F.lit(0.0)).alias("code_length_mean"),
        rate(F.col("code_length") == 0).alias("empty_code_rate"),
        rate(F.col("thinking_length") == 0).alias("empty_thinking_rate"))
    agg = agg.withColumns({
        "test_case_pass_rate": safe_ratio(F.col("passed_test_cases"), F.col("total_test_cases")),
        "avg_for_loops": safe_ratio(F.col("_f"), F.col("_n")),
        "avg_function_defs": safe_ratio(F.col("_d"), F.col("_n")),
        "avg_dict_set_count": safe_ratio(F.col("_ds"), F.col("_n"))}).drop("_n", "_f", "_d", "_ds")
    spark = scored.sparkSession
    # The grid is the run's fixed (model, setup) list (a parameter); both sides hold one row
    # per run, so no hint is given: AQE picks the strategy from the measured sizes.
    grid = spark.createDataFrame([(m, s) for m in models for s in setups], "model string, setup string")
    out = grid.join(agg, on=["model", "setup"], how="left")
    return out.select("model", "setup", *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m)
                                          for m in LONG_TABLE_METRICS])
