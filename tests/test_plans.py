"""Plan checks: native operators stay on the JVM; execution has one Python hop."""

import pytest

from scorelab.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["agg_model_summary", "ext_pattern_counts", "rwd_total", "cmp_long_table",
                                  "agg_run_metrics", "prm_render", "spl_stratified", "agg_log_summary",
                                  "src_listify", "ext_validate_format", "agg_text_length"])
def test_native_queries_have_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert not any(n in plan for n in PY_NODES), name


def test_execution_is_one_python_hop(spark):
    plan = _plan(QUERIES["exe_run_tests"](spark, SF))
    assert plan.count("MapInPandas") == 1
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def _exchanges(df) -> list[str]:
    """Lines of the plan's exchanges, each with the output columns of the plan below it."""
    node = df._jdf.queryExecution().executedPlan()
    out = []

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.initialPlan())
        if p.nodeName() == "Exchange":
            out.append(p.output().mkString(","))
        for i in range(p.children().size()):
            walk(p.children().apply(i))
    walk(node)
    return out


def test_flagship_aggregates_map_side(spark):
    plan = _plan(QUERIES["agg_model_summary"](spark, SF))
    assert "partial_count(1)" in plan and "keys=[setup" in plan


TEXTS = ("model_output#", "thinking#", "code#", "text#", "question#")


@pytest.mark.parametrize("name", ["agg_model_summary", "agg_run_metrics", "cmp_long_table", "jn_metric_attach", "prm_length_stats"])
def test_no_text_travels_through_an_exchange(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = _exchanges(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert columns and not any(c.strip().startswith(TEXTS) for line in columns for c in line.split(","))


@pytest.fixture
def strict_codegen(spark):
    """Generated code that does not compile fails the query instead of falling back."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    yield
    spark.conf.unset("spark.sql.codegen.fallback")


def test_filtered_comparison_compiles(spark, strict_codegen):
    from scorelab.functions import testcases as T
    pairs = QUERIES["tst_compare_outputs"](spark, SF)
    every = pairs.count()
    assert 0 < pairs.filter("match").count() < every
    df = spark.createDataFrame([("1,000.0", "1000"), ("'a'", "a"), ("$5.00", "5"), ("x", "y"), (None, "y")], "e string, a string")
    kept = T.with_outputs_match(T.with_outputs_match(df, "e", "a", "m1"), "a", "e", "m2").filter("m1 AND m2 OR e IS NULL")
    assert kept.count() == 4


def test_filtered_results_compile(spark, strict_codegen):
    from scorelab.operators import execute as E
    tests = spark.createDataFrame([("print(input())", "1", "1.0"), ("print('$2')", "", "2")], "code string, input string, output string")
    assert E.run_tests(tests).filter("passed OR timeout").count() == 2


def test_each_parse_is_written_once(spark):
    """Four number parses (two texts, two without currency) in one comparison, not a copy per use."""
    from scorelab.functions import testcases as T
    from scorelab.functions.text import NUMBER_RE
    df = spark.createDataFrame([("1", "2")], "e string, a string")
    plan = df.select(T.outputs_match_normalized(df.e, df.a).alias("m")).filter("m")._jdf.queryExecution().optimizedPlan()
    assert plan.expressions().mkString(" ").count(NUMBER_RE) == 4
