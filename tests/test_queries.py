"""Registered queries against their DuckDB oracles on the smallest tables, plus the entry point."""

import duckdb
import pytest

from scorelab.plans.checks import fingerprint
from scorelab.plans.views import BASE_TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["agg_model_summary", "ext_pattern_counts", "tst_compare_outputs", "rwd_total", "spl_stratified",
          "cmp_all_setups", "agg_log_summary", "prm_conversation_text", "src_run_metadata", "smp_mixture",
          "flt_quantile_length", "win_cumulative_tests"]


def _fp(pdf):
    return fingerprint(pdf)[:3]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries
    a = _fp(queries()[name](spark, SF).toPandas())
    b = _fp(duck.execute(oracle_sql()[name]).df())
    assert a == b


def test_entry_and_registry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    df = entry(spark)
    assert df.count() == 12 and "test_case_pass_rate" in df.columns
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 100
