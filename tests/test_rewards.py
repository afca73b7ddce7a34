"""Reward cases of the reference self-check; values worked out by hand from its rules."""

from pyspark.sql import functions as F

from scorelab.functions import rewards as R

GOOD = "Let me think<end_working_out><SOLUTION>42</SOLUTION>"
BAD = "The answer is 42"
PARTIAL = "<end_working_out>The answer is <SOLUTION>42"


def _score(spark, rows):
    df = spark.createDataFrame(rows, "completion string, answer string")
    return [tuple(r) for r in R.score(df).select("r_format", "r_tags", "r_answer", "r_number", "reward").collect()]


def test_good_bad_partial(spark):
    got = _score(spark, [(GOOD, "42"), (BAD, "42"), (PARTIAL, "42")])
    assert got == [(3.0, 1.5, 5.0, 3.5, 13.0), (0.0, -3.0, -2.0, -2.5, -7.5), (0.0, 0.0, -2.0, 3.5, 1.5)]


def test_answer_ratio_bands(spark):
    got = _score(spark, [(GOOD, "43"), (GOOD, "41"), (GOOD, "50"), (GOOD, "0"), (GOOD, "x"), (GOOD, " 42 ")])
    assert [g[2] for g in got] == [2.0, 2.0, 1.5, -4.5, -4.5, 3.5]


def test_number_commas_and_invalid(spark):
    got = _score(spark, [("<SOLUTION>123,456.78</SOLUTION>", "123456.78"), ("<SOLUTION>-.,</SOLUTION>", "3"),
                         ("<SOLUTION>1d</SOLUTION>", "1"), ("<SOLUTION>7</SOLUTION>", "8")])
    assert [g[3] for g in got] == [3.5, 0.0, 3.5, -1.5]


def test_binary_strict_quality(spark):
    df = spark.createDataFrame([(GOOD,), (BAD,)], "t string")
    assert [r[0] for r in df.select(R.r_format_binary("t")).collect()] == [3.0, -1.0]
    m = ["<end_working_out>", "<SOLUTION>", "</SOLUTION>"]
    assert [r[0] for r in df.select(R.r_strict("t", m)).collect()] == [5.0, -5.0]
    code = "<SOLUTION>\n# doc\ndef f(x):\n    y = x\n    z = y\n    return z\n</SOLUTION>"
    q = spark.createDataFrame([(code,), (BAD,), ("<SOLUTION>eval(1)</SOLUTION>",)], "t string")
    assert [r[0] for r in q.select(R.code_quality("t")).collect()] == [2.0, -1.0, 0.0]


def test_rewards_stay_native(spark):
    df = spark.createDataFrame([(GOOD, "42")], "completion string, answer string")
    plan = R.score(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert F is not None


def test_custom_reward_plugins(spark):
    df = spark.createDataFrame([(GOOD, "42"), (BAD, "42")], "completion string, answer string")
    custom = {"fmt": R.r_format_binary("completion"), "len": F.length("completion") / F.lit(100.0)}
    got = [(r["fmt"], r["reward"]) for r in R.score(df, custom).collect()]
    assert got[0][0] == 3.0 and abs(got[0][1] - (3.0 + len(GOOD) / 100.0)) < 1e-12
    assert got[1][0] == -1.0
