"""One evaluation of a run: extract, attach tests, gate, execute, aggregate, score.

The parts are the library's own operators; this module only joins them, so that
summaries and comparisons rest on executed code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import with_extraction
from ..functions.testcases import test_cases
from ..session import materialise
from . import execute, metrics

KEYS = ("setup", "model", "problem_id")


def measured_codes(gens: DataFrame, keys=KEYS) -> DataFrame:
    """Generations extracted once: keys, measures (``metrics.measured``), code and its key, written as a table.

    The tests, the codes and the summaries all read this table, each its own
    columns; the raw outputs are not read again.
    """
    rows = metrics.measured(with_extraction(gens), (*keys, "code"))
    return materialise(rows.withColumn("code_key", F.sha2(F.coalesce("code", F.lit("")), 256)), "measured")


def extracted_codes(gens: DataFrame, keys=KEYS) -> DataFrame:
    """Keys, flags, code and its key only, for those who want test results and no measures."""
    ex = with_extraction(gens).select(*keys, "api_success", (F.coalesce("api_success", F.lit(False)) & F.col("code_found")).alias("code_found"), "code")
    return materialise(ex.withColumn("code_key", F.sha2(F.coalesce("code", F.lit("")), 256)), "codes")


def candidate_tests(rows: DataFrame, problems: DataFrame, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Tests of every answered output with code (keys, code_key, test_case, input, output) and the distinct codes (code_key, code)."""
    have = rows.filter("api_success AND code_found")
    tests = test_cases(have.select(*keys, "code_key").join(problems.select("problem_id", "inputs", "outputs"), "problem_id"))
    return tests, have.select("code_key", "code").dropDuplicates(["code_key"])


def run_candidates(rows: DataFrame, problems: DataFrame, keys=KEYS, **running) -> DataFrame:
    """Results of all tests of ``measured_codes`` or ``extracted_codes`` rows, one row per test (``execute.run_tests``)."""
    tests, codes = candidate_tests(rows, problems, keys)
    return execute.run_tests(tests, codes=codes, **running)


def evaluate_run(gens: DataFrame, problems: DataFrame, keys=KEYS, **running) -> DataFrame:
    """Scored rows (``metrics.scored_rows``) of generations, by running their code on the problems' tests.

    ``problems`` has problem_id, inputs and outputs (cleaned test lists);
    ``running`` goes to ``execute.run_tests``.  An output without code, without
    a problem or whose call failed has no test and scores zeros.
    """
    rows = measured_codes(gens, keys)
    results = run_candidates(rows, problems, keys, **running)
    return metrics.with_execution(rows.drop("code", "code_key"), execute.execution_result(results, keys), keys)
