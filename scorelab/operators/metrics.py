"""Aggregations.

Every metric family is one ``groupBy`` with conditional aggregates (partial
aggregation on the map side, so a hot model or setup costs one small row per
task, not a skewed shuffle).  Rates keep the reference's denominators.
The one exception is the median of a continuous value (``text_length``),
which comes from the distributed rank and is joined to the per-split row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import PATTERNS, fenced_code, format_matches, substring_counts
from ..functions.rewards import r_number
from ..functions.text import py_strip, word_count
from .select import median_exact

RUN_KEYS = ("setup", "model")
MAX_TOKENS, NEAR_MAX = 6000, 5900  # fixed values: token cap and near-cap of the runs
COST_PER_TOKEN = 0.00001            # fixed value: flat cost estimate
DIFFICULTY_VALUES = ["introductory", "interview", "competition"]


def rate(cond: Column) -> Column:
    """Share of rows where ``cond`` holds (0 for an empty group)."""
    return F.coalesce(F.avg(F.when(cond, 1.0).otherwise(0.0)), F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def measured(gens: DataFrame, keep=("setup", "model", "problem_id")) -> DataFrame:
    """Extracted generations reduced to flags, lengths and counts (no text column).

    Every summary reads only these, so texts never travel through a join.  A
    row whose API call failed has nothing extracted: its lengths and counts are
    null and its flags false.
    """
    api = F.coalesce("api_success", F.lit(False))
    thinking, code = F.when(api, F.col("thinking")), F.when(api, F.col("code"))
    plain = substring_counts(code)
    cols = {
        "output_length": F.coalesce(F.length("model_output"), F.lit(0)),
        "thinking_length": F.length(thinking), "code_length": F.length(code),
        "for_loops": plain["for_loops"], "def_count": plain["def_count"],
        "thinking_found": api & F.col("thinking_found"), "code_found": api & F.col("code_found"),
        **{name: F.when(api, F.col(name)) for name in PATTERNS},
    }
    return gens.select(*keep, "api_success", "completion_tokens", "total_tokens", "total_time", run_time(gens).alias("run_avg_time"),
                       *[c.alias(k) for k, c in cols.items()])


def scored_rows(gens: DataFrame, exec_results: DataFrame, keys=("setup", "model", "problem_id")) -> DataFrame:
    """Measures of the extracted generations joined to per-problem execution results."""
    return with_execution(measured(gens, keys), exec_results, keys)


def with_execution(rows: DataFrame, exec_results: DataFrame, keys=("setup", "model", "problem_id")) -> DataFrame:
    """``measured`` rows joined to per-problem execution results.

    Execution counts only where the API call succeeded and code was found
    (otherwise the row scores zeros, as the evaluator does).
    """
    ex = exec_results.select(*keys, "execution_success", "passed_count", "total_count", "pass_rate")
    joined = rows.join(ex, on=list(keys), how="left")
    ran = F.col("api_success") & F.col("code_found") & F.col("total_count").isNotNull()
    return joined.withColumns({
        "execution_success": F.when(ran, F.col("execution_success")).otherwise(F.lit(False)),
        "passed_count": F.when(ran, F.col("passed_count")).otherwise(F.lit(0)).cast("long"),
        "total_count": F.when(ran, F.col("total_count")).otherwise(F.lit(0)).cast("long"),
        "pass_rate": F.when(ran, F.col("pass_rate")).otherwise(F.lit(0.0)),
    })


def _summary_aggs() -> list[Column]:
    return [
        F.count("*").alias("n_problems"),
        rate(F.col("api_success")).alias("api_success_rate"),
        rate(F.col("code_found")).alias("code_extraction_rate"),
        rate(F.col("thinking_found")).alias("thinking_extraction_rate"),
        rate(F.col("execution_success")).alias("execution_success_rate"),
        F.sum("total_count").cast("long").alias("total_test_cases"),
        F.sum("passed_count").cast("long").alias("passed_test_cases"),
        F.coalesce(F.avg("pass_rate"), F.lit(0.0)).alias("average_pass_rate"),
    ]


def model_summary(scored: DataFrame, by=RUN_KEYS) -> DataFrame:
    """Per (setup, model): rates over all rows, test totals and pass rate."""
    out = scored.groupBy(*by).agg(*_summary_aggs())
    return out.withColumn("test_case_pass_rate", safe_ratio(F.col("passed_test_cases"),
                                                            F.col("total_test_cases")))


def extraction_stats(df: DataFrame, by=RUN_KEYS) -> DataFrame:
    th, co = F.col("thinking_found"), F.col("code_found")
    return df.groupBy(*by).agg(
        F.count("*").alias("total_responses"),
        rate(th).alias("thinking_found_rate"), rate(co).alias("code_found_rate"),
        rate(th & co).alias("both_found_rate"), rate(~th & ~co).alias("neither_found_rate"))


def answer_length(df: DataFrame, by=RUN_KEYS) -> DataFrame:
    ok = F.col("api_success") & (F.coalesce(F.length("model_output"), F.lit(0)) > 0)
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(ok, F.length("model_output"))), F.lit(0.0)).alias("avg_answer_length"))


def token_usage(df: DataFrame, by=RUN_KEYS, cap: int = MAX_TOKENS, near: int = NEAR_MAX) -> DataFrame:
    ok = F.col("api_success") & F.col("completion_tokens").isNotNull()
    ct = F.col("completion_tokens")
    out = df.groupBy(*by).agg(
        F.count_if(ok).alias("total_responses"),
        F.count_if(ok & (ct >= cap)).alias("max_length_hits"),
        F.count_if(ok & (ct < cap) & (ct >= near)).alias("near_max_hits"),
        F.sum(F.when(ok, ct)).alias("_tok"))
    n = F.col("total_responses")
    return out.withColumns({
        "max_length_rate": safe_ratio(F.col("max_length_hits"), n),
        "near_max_rate": safe_ratio(F.col("near_max_hits"), n),
        "avg_completion_tokens": safe_ratio(F.col("_tok"), n)}).drop("_tok")


def objective_patterns(scored: DataFrame, by=RUN_KEYS) -> DataFrame:
    """Mean for / def / dict+set counts over executed solutions (zeros when none)."""
    ok = F.col("api_success") & F.col("execution_success")
    out = scored.groupBy(*by).agg(
        F.count_if(ok).alias("successful_solutions"),
        F.sum(F.when(ok, F.col("for_loop_count"))).alias("_f"),
        F.sum(F.when(ok, F.col("function_def_count"))).alias("_d"),
        F.sum(F.when(ok, F.col("dict_constructor_count") + F.col("set_constructor_count"))).alias("_ds"))
    n = F.col("successful_solutions")
    return out.withColumns({"avg_for_loops": safe_ratio(F.col("_f"), n),
                            "avg_function_defs": safe_ratio(F.col("_d"), n),
                            "avg_dict_set_count": safe_ratio(F.col("_ds"), n)}).drop("_f", "_d", "_ds")


def run_time(df: DataFrame) -> Column:
    """The run's own mean generation time from its metadata, as a column (null without timing statistics)."""
    return F.col("run_avg_time") if "run_avg_time" in df.columns else F.lit(None).cast("double")


def generation_time(df: DataFrame, by=RUN_KEYS) -> DataFrame:
    """Mean generation time: the run's timing statistics if given, else the mean over rows, else 0."""
    return df.groupBy(*by).agg(F.coalesce(F.max(run_time(df)), F.avg("total_time"), F.lit(0.0)).alias("avg_generation_time"))


def _generation_aggs(cap: int = MAX_TOKENS, near: int = NEAR_MAX) -> list[Column]:
    """Answer length, token usage and generation time over measures."""
    ok = F.col("api_success") & F.col("completion_tokens").isNotNull()
    ct = F.col("completion_tokens")
    return [
        F.coalesce(F.avg(F.when(F.col("api_success") & (F.col("output_length") > 0), F.col("output_length"))), F.lit(0.0)).alias("avg_answer_length"),
        F.count_if(ok).alias("total_responses"),
        F.count_if(ok & (ct >= cap)).alias("max_length_hits"),
        F.count_if(ok & (ct < cap) & (ct >= near)).alias("near_max_hits"),
        F.sum(F.when(ok, ct)).alias("_tok"),
        F.coalesce(F.max("run_avg_time"), F.avg("total_time"), F.lit(0.0)).alias("avg_generation_time")]


def run_report(scored: DataFrame, by=RUN_KEYS) -> DataFrame:
    """Model summary, objective-pattern means and generation statistics of each run in one aggregation."""
    ok = F.col("api_success") & F.col("execution_success")
    out = scored.groupBy(*by).agg(
        *_summary_aggs(), *_generation_aggs(),
        F.count_if(ok).alias("successful_solutions"),
        F.sum(F.when(ok, F.col("for_loop_count"))).alias("_f"),
        F.sum(F.when(ok, F.col("function_def_count"))).alias("_d"),
        F.sum(F.when(ok, F.col("dict_constructor_count") + F.col("set_constructor_count"))).alias("_ds"))
    n, r = F.col("successful_solutions"), F.col("total_responses")
    return out.withColumns({
        "test_case_pass_rate": safe_ratio(F.col("passed_test_cases"), F.col("total_test_cases")),
        "avg_for_loops": safe_ratio(F.col("_f"), n), "avg_function_defs": safe_ratio(F.col("_d"), n),
        "avg_dict_set_count": safe_ratio(F.col("_ds"), n),
        "max_length_rate": safe_ratio(F.col("max_length_hits"), r),
        "near_max_rate": safe_ratio(F.col("near_max_hits"), r),
        "avg_completion_tokens": safe_ratio(F.col("_tok"), r)}).drop("_f", "_d", "_ds", "_tok")


def for_loop_rate(df: DataFrame, by=RUN_KEYS) -> DataFrame:
    """Quick check: API rate, fenced-code rate and 'for' rate over all rows, ascending."""
    f = fenced_code("model_output")
    api = F.col("api_success")
    return (df.groupBy(*by).agg(
                F.count("*").alias("n_outputs"),
                rate(api).alias("api_success_rate"),
                rate(api & f["fence_found"]).alias("code_found_rate"),
                rate(api & f["fence_found"] & f["contains_for"]).alias("for_loop_rate"))
              .orderBy("for_loop_rate", *by))


def run_metrics(scored: DataFrame, by=RUN_KEYS, cost_per_token: float = COST_PER_TOKEN,
                extra=()) -> DataFrame:
    """The comparator's twelve metrics per run, in one pass (plus any ``extra`` aggregates)."""
    out = scored.groupBy(*by).agg(
        *_summary_aggs(), *extra,
        F.coalesce(F.avg("thinking_length"), F.lit(0.0)).alias("thinking_length_mean"),
        F.coalesce(F.avg("code_length"), F.lit(0.0)).alias("code_length_mean"),
        rate(F.col("code_length") == 0).alias("empty_code_rate"),
        rate(F.col("thinking_length") == 0).alias("empty_thinking_rate"),
        F.coalesce(F.max("run_avg_time"), F.lit(0.0)).alias("generation_time_mean"),  # the comparator reads timing statistics only
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("token_usage_total"),
        F.coalesce(F.sum(F.col("total_tokens") * F.lit(cost_per_token)), F.lit(0.0)).alias("cost_total"))
    return (out.withColumn("fraction_passed", safe_ratio(F.col("passed_test_cases"), F.col("total_test_cases")))
               .withColumn("mean_test_cases_passed", F.col("passed_test_cases").cast("double"))
               .withColumnRenamed("thinking_extraction_rate", "thinking_extracted_rate")
               .withColumnRenamed("code_extraction_rate", "code_extracted_rate"))


METRICS = ["fraction_passed", "mean_test_cases_passed", "thinking_extracted_rate", "code_extracted_rate",
           "execution_success_rate", "thinking_length_mean", "code_length_mean", "empty_code_rate",
           "empty_thinking_rate", "generation_time_mean", "token_usage_total", "cost_total"]


def throughput(df: DataFrame, by=RUN_KEYS) -> DataFrame:
    out = df.groupBy(*by).agg(F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
                              F.coalesce(F.sum("total_time"), F.lit(0.0)).alias("total_generation_time"))
    return out.withColumn("tokens_per_second",
                          F.when(F.col("total_generation_time") > 0,
                                 F.col("total_tokens") / F.col("total_generation_time")).otherwise(F.lit(0.0)))


def compliance(df: DataFrame, text: str = "completion", truth: str = "answer", by=()) -> DataFrame:
    """Format compliance, numeric-answer pass rate, mean completion length."""
    aggs = [F.count("*").alias("n_completions"),
            rate(format_matches(text)).alias("format_compliance"),
            rate(r_number(text, truth) == 3.5).alias("test_pass_rate"),
            F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("avg_completion_length")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def dataset_info(df: DataFrame, split: str = "split") -> DataFrame:
    """Per split: rows, difficulty counts, tests/solutions mean/median/min/max, starter count."""
    aggs = [F.count("*").alias("total_problems")]
    aggs += [F.count_if(F.col("difficulty") == d).alias(f"n_{d}") for d in DIFFICULTY_VALUES]
    for c in ("n_test_cases", "n_solutions"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    aggs.append(F.count_if(F.length("starter_code") > 0).alias("has_starter_code"))
    return df.groupBy(split).agg(*aggs)


def split_statistics(df: DataFrame, split: str = "split") -> DataFrame:
    """Per (split, difficulty): count and share of the split, with the split's stats."""
    per = df.groupBy(split, "difficulty").agg(F.count("*").alias("n_problems"))
    per_split = df.groupBy(split).agg(
        F.count("*").alias("split_total"),
        F.avg("n_test_cases").alias("tests_mean"), F.median("n_test_cases").alias("tests_median"),
        F.min("n_test_cases").alias("tests_min"), F.max("n_test_cases").alias("tests_max"),
        F.avg("n_solutions").alias("solutions_mean"), F.median("n_solutions").alias("solutions_median"),
        F.count_if(F.length("starter_code") > 0).alias("starter_count"))
    out = per.join(per_split, on=split, how="inner")  # both sides tiny (splits × difficulties)
    return out.withColumns({
        "share_pct": F.col("n_problems") * 100.0 / F.col("split_total"),
        "starter_pct": F.col("starter_count") * 100.0 / F.col("split_total")})


def difficulty_crosstab(df: DataFrame, by: str = "difficulty", split: str = "original_split",
                        splits=("train", "test")) -> DataFrame:
    """difficulty × original split with a total column, most frequent first."""
    out = df.groupBy(by).agg(F.count("*").alias("total"),
                             *[F.count_if(F.col(split) == s).alias(s) for s in splits])
    return out.orderBy(F.desc("total"), by)


def overview(df: DataFrame, split: str = "original_split") -> DataFrame:
    cols = ",".join(df.columns)
    return df.agg(F.count("*").alias("total_samples"),
                  F.count_if(F.col(split) == "train").alias("train_samples"),
                  F.count_if(F.col(split) == "test").alias("test_samples"),
                  F.lit(cols).alias("features"),
                  F.avg("n_test_cases").alias("avg_test_cases"),
                  F.avg("n_solutions").alias("avg_solutions"),
                  rate(F.length("starter_code") > 0).alias("starter_share"))


def _dist(c: str, prefix: str, pop_std: bool = True) -> list[Column]:
    std = F.stddev_pop(c) if pop_std else F.stddev_samp(c)
    return [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{prefix}_mean"),
            F.coalesce(F.median(c), F.lit(0.0)).alias(f"{prefix}_median"),
            F.coalesce(std, F.lit(0.0)).alias(f"{prefix}_std"),
            F.coalesce(F.min(c), F.lit(0)).alias(f"{prefix}_min"),
            F.coalesce(F.max(c), F.lit(0)).alias(f"{prefix}_max")]


def text_length(raw: DataFrame, split: str = "original_split") -> DataFrame:
    """Question word counts, and per-problem mean solution word count, per split."""
    sols = F.from_json(F.col("solutions"), "array<string>")
    per_problem_sol = F.when(F.size(sols) > 0,
                             F.aggregate(F.transform(sols, lambda s: word_count(s)), F.lit(0),
                                         lambda a, b: a + b) / F.size(sols))
    rows = raw.select(split, word_count("question").alias("_q"), per_problem_sol.alias("_s"))
    # Word counts are integers (few distinct values): the built-in exact median is fine.  The
    # per-problem mean solution length is continuous, so its median uses the distributed rank.
    dist_s = _dist("_s", "solution_words")
    out = rows.groupBy(split).agg(*_dist("_q", "question_words"), dist_s[0], dist_s[2])
    med = median_exact(rows, [split], "_s", "_m")
    return (out.join(med, split, "left")
               .withColumn("solution_words_median", F.coalesce("_m", F.lit(0.0))).drop("_m")
               .select(split, *[c for c in out.columns if c != split and not c.startswith("solution")],
                       "solution_words_mean", "solution_words_median", "solution_words_std"))


def _io(raw: DataFrame) -> Column:
    return F.from_json(F.col("input_output"), "inputs array<string>, outputs array<string>")


def test_case_stats(raw: DataFrame, split: str = "original_split") -> DataFrame:
    """Per split: problems with / without a test-case record, total and distribution."""
    io = _io(raw)
    has = io["inputs"].isNotNull() & io["outputs"].isNotNull()
    rows = raw.select(split, has.alias("_has"), F.when(has, F.size(io["inputs"])).alias("_n"))
    return rows.groupBy(split).agg(
        F.count("*").alias("total_problems"), F.count_if("_has").alias("problems_with_tests"),
        F.count_if(~F.col("_has")).alias("problems_without_tests"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_test_cases"), *_dist("_n", "test_cases"))


def solution_stats(raw: DataFrame, split: str = "original_split") -> DataFrame:
    sols = F.from_json(F.col("solutions"), "array<string>")
    n = F.when(F.size(sols) > 0, F.size(sols))
    rows = raw.select(split, n.alias("_n"))
    return rows.groupBy(split).agg(
        F.count("*").alias("total_problems"), F.count("_n").alias("problems_with_solutions"),
        F.count_if(F.col("_n").isNull()).alias("problems_without_solutions"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_solutions"),
        *_dist("_n", "solutions")[:3])


def starter_stats(raw: DataFrame, split: str = "original_split") -> DataFrame:
    has = F.coalesce(py_strip("starter_code") != "", F.lit(False))
    rows = raw.select(split, has.alias("_has"), F.when(has, word_count("starter_code")).alias("_w"))
    return rows.groupBy(split).agg(
        F.count("*").alias("total_problems"), F.count_if("_has").alias("with_starter"),
        (F.count_if("_has") * 100.0 / F.count("*")).alias("starter_pct"),
        F.coalesce(F.avg("_w"), F.lit(0.0)).alias("starter_words_mean"),
        F.coalesce(F.median("_w"), F.lit(0.0)).alias("starter_words_median"))


def targets_report(counts: DataFrame, name: str, ks, cond, split: str | None, splits) -> DataFrame:
    """One pass: every (target, split) count is a conditional aggregate; the one-row result is
    unpivoted to one row per target (no joins, no windows)."""
    groups = [("", F.lit(True))] + ([(f"{s}_", F.col(split) == s) for s in splits] if split else [])
    aggs = []
    for prefix, g in groups:
        aggs.append(F.count_if(g).alias(f"_{prefix}total"))
        aggs += [F.count_if(g & cond(int(k))).alias(f"_{prefix}c{i}") for i, k in enumerate(ks)]
    one = counts.agg(*aggs)
    fields = [f"{prefix}problems" for prefix, _ in groups]
    rows = []
    for i, k in enumerate(ks):
        rows += [F.lit(int(k))] + [F.col(f"_{prefix}c{i}") for prefix, _ in groups]
    long = one.select(*[f"_{p}total" for p, _ in groups],
                      F.stack(F.lit(len(ks)), *rows).alias(name, *fields))
    out = [name]
    for prefix, _ in groups:
        out += [F.col(f"{prefix}problems").cast("long").alias(f"{prefix}problems"),
                safe_ratio(F.col(f"{prefix}problems") * 100.0, F.col(f"_{prefix}total")).alias(f"{prefix}pct")]
    return long.select(*out)


def count_exact(counts: DataFrame, ns=(3, 5, 8), n_col: str = "n_test_cases", split: str | None = None,
                splits=("train", "test")) -> DataFrame:
    """Problems with exactly N tests, count and share, for each target N (overall and per split)."""
    return targets_report(counts, n_col, ns, lambda k: F.col(n_col) == k, split, splits)


def log_summary(log: DataFrame, step: str = "step", exclude=("step", "timestamp")) -> DataFrame:
    """Per numeric metric: mean, sample std, min, max, final value; total steps."""
    numeric = [f.name for f in log.schema.fields
               if f.name not in exclude and f.dataType.typeName() in ("double", "float", "integer", "long")]
    long = log.select(step, F.stack(F.lit(len(numeric)),
                                    *[x for m in numeric for x in (F.lit(m), F.col(m).cast("double"))])
                      .alias("metric", "value"))
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", F.col(step)).alias("final"), F.max(step).alias("total_steps"))
