"""Executor scenarios, run as a Spark job."""

from pyspark.sql import functions as F

from scorelab.functions import testcases as T
from scorelab.operators import execute as E

LONGEST = "rows = int(input())\nwords = [input() for _ in range(rows)]\nprint(max(words, key=len))\n"
GREETING = "print('good', 'morning')"
SPIN = "k = 0\nwhile k >= 0:\n    k += 1\n"
MOODS = "m = input()\nwhile m == 'stuck':\n    pass\nprint(m[::-1] if m != 'up' else 'UP')\n"


def test_run_tests_scenarios(spark):
    rows = [("longest", LONGEST, ["3\nox\nheron\ncat", "1\nbee"], ["heron", "bee"]),
            ("greeting", GREETING, [""], ["good morning"]),
            ("spin", SPIN, [""], [""]),
            ("moods", MOODS, ["up", "stuck", "abc", "xy"], ["UP", "kcuts", "cba", "yx"]),
            ("list_input", "p = input()\nq = input()\nprint(int(p) - int(q))", ["[9, 5]"], ["4"]),
            ("blocked", "import os\nprint(1)", ["x"], ["1"])]
    df = spark.createDataFrame(rows, "name string, code string, inputs array<string>, outputs array<string>")
    res = E.run_tests(T.test_cases(df), timeout_s=2.0, partitions=4).collect()
    got = {(r["name"], r["test_case"]): (r["passed"], r["timeout"]) for r in res}
    assert got[("longest", 1)] == (True, False) and got[("longest", 2)] == (True, False)
    assert got[("greeting", 1)] == (True, False)
    assert got[("spin", 1)] == (False, True)
    assert [got[("moods", i)] for i in (1, 2, 3, 4)] == [(True, False), (False, True), (True, False), (True, False)]
    assert got[("list_input", 1)] == (True, False)
    assert got[("blocked", 1)] == (False, False)
    assert [r["error"] for r in res if r["name"] == "blocked"] == ["Blocked imports: os"]


def test_runs_that_differ_in_borders_or_nulls_stay_apart(spark):
    code = "print(len(sys.stdin.read()))"
    df = spark.createDataFrame([(code, "ab", "2"), (code, "a", "2"), (code, None, "0"), (code, "", "1"), (code + "\u0000", "ab", "2")],
                               "code string, input string, output string")
    res = E.run_tests(df, timeout_s=5.0, partitions=2, gate=False).collect()
    got = sorted((r["input"] or "", r["output"], r["passed"]) for r in res if not r["code"].endswith("\u0000"))
    assert got == [("", "0", True), ("", "1", False), ("a", "2", False), ("ab", "2", True)]


def test_execution_result_gate_semantics(spark):
    res = spark.createDataFrame(
        [("s", "m", 1, 1, True, False, 0.1, True), ("s", "m", 1, 2, False, True, 2.0, True),
         ("s", "m", 2, 1, True, False, 0.1, False), ("s", "m", 2, 2, True, False, 0.1, False)],
        "setup string, model string, problem_id int, test_case int, passed boolean, timeout boolean, "
        "execution_time double, execution_success boolean")
    out = {r["problem_id"]: r for r in E.execution_result(res).collect()}
    assert (out[1]["passed_count"], out[1]["failed_count"], out[1]["total_count"], out[1]["timeout_count"]) == (1, 1, 2, 1)
    assert (out[2]["passed_count"], out[2]["failed_count"], out[2]["total_count"], out[2]["pass_rate"]) == (0, 0, 2, 0.0)


def test_code_checks(spark):
    df = spark.createDataFrame([("def f():\n    return 1",), ("import os\nimport os.path\nfrom sys import argv",),
                                ("def (:",), ("for i in x:\n    if i:\n        pass",)], "code string")
    out = {r["code_key"]: r for r in E.code_checks(df).collect()}
    by_code = {c: out[k] for c, k in zip([r[0] for r in df.collect()],
                                         [r[0] for r in df.select(F.sha2("code", 256)).collect()])}
    assert by_code["def f():\n    return 1"]["safe"] is True
    assert by_code["def f():\n    return 1"]["complexity"] == 2.5
    assert list(by_code["import os\nimport os.path\nfrom sys import argv"]["blocked"]) == ["os", "sys"]
    bad = by_code["def (:"]
    assert bad["syntax_ok"] is False and bad["syntax_error"].startswith("Syntax error:") and bad["complexity"] == 0.0
    assert by_code["for i in x:\n    if i:\n        pass"]["complexity"] == 2.0


def test_strict_imports_refuses_every_import(spark):
    df = spark.createDataFrame([("math", "import math\nprint(1)", [""], ["1"])],
                               "name string, code string, inputs array<string>, outputs array<string>")
    loose = E.run_tests(T.test_cases(df), timeout_s=5.0, partitions=2).first()
    strict = E.run_tests(T.test_cases(df), timeout_s=5.0, partitions=2, strict_imports=True).first()
    assert loose["passed"] is True and strict["passed"] is False and "blocked" in strict["error"]


def test_exact_match_and_execution_reward(spark):
    df = spark.createDataFrame([("p", "print('[1]')", ["", ""], ["1", "[1]"])],
                               "name string, code string, inputs array<string>, outputs array<string>")
    res = E.run_tests(T.test_cases(df), timeout_s=5.0, partitions=2).withColumn("setup", F.lit("s")) \
        .withColumn("model", F.lit("m")).withColumn("problem_id", F.lit(1))
    rows = {r["test_case"]: (r["passed"], r["exact_match"]) for r in res.collect()}
    assert rows == {1: (True, False), 2: (True, True)}
    done = spark.createDataFrame([("s", "m", 1, True), ("s", "m", 2, False), ("s", "m", 3, True)],
                                 "setup string, model string, problem_id int, code_found boolean")
    got = {r["problem_id"]: r["reward_exec"] for r in E.r_exec(done, res, passed="exact_match").collect()}
    assert got == {1: 2.5, 2: -3.0, 3: 0.0}  # without code -3; code without results 0
    gated = res.withColumns({"execution_success": F.lit(False)})
    assert E.r_exec(done, gated).filter("problem_id = 1").first()["reward_exec"] == 0.0


def test_long_output_passes_unless_a_limit_is_asked_for(spark):
    df = spark.createDataFrame([("long", "print('x' * 5_000_000)", [""], ["x" * 5_000_000]),
                                ("ok", "print(input())", ["hi"], ["hi"])],
                               "name string, code string, inputs array<string>, outputs array<string>")
    tests = T.test_cases(df)
    assert {r["name"]: r["passed"] for r in E.run_tests(tests, partitions=2).select("name", "passed").collect()} == {"long": True, "ok": True}
    capped = {r["name"]: (r["passed"], r["timeout"], r["error"]) for r in E.run_tests(tests, partitions=2, max_output=1 << 20).collect()}
    assert capped == {"long": (False, False, "Output exceeded 1048576 bytes"), "ok": (True, False, "")}


def test_execution_error_of_gated_code(spark):
    res = spark.createDataFrame([("s", "m", 1, False, False, 0.0, False, "Blocked imports: os"), ("s", "m", 2, True, False, 0.1, True, "")],
                                "setup string, model string, problem_id int, passed boolean, timeout boolean, "
                                "execution_time double, execution_success boolean, error string")
    assert {r["problem_id"]: r["execution_error"] for r in E.execution_result(res).collect()} == {1: "Blocked imports: os", 2: None}


def _exchange_columns(df):
    node, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.initialPlan())
        if p.nodeName() == "Exchange":
            out.append(p.output().mkString(","))
        for i in range(p.children().size()):
            walk(p.children().apply(i))
    walk(node)
    return out


def test_code_travels_once_per_task_and_not_with_the_runs(spark, monkeypatch):
    """The exchange of the de-duplication carries keys; codes move in rows of their own."""
    seen = []
    dealt = E._dealt
    monkeypatch.setattr(E, "_dealt", lambda runs, codes, tasks: (seen.append(runs), dealt(runs, codes, tasks))[1])
    code = "print(input())  # " + "x" * 5000
    tests = spark.range(200).selectExpr(f"'{code}' code", "cast(id as string) input", "cast(id as string) output")
    assert E.run_tests(tests, partitions=8).filter("passed").count() == 200
    for runs in seen:
        columns = _exchange_columns(runs)
        assert columns and not any("code#" in c for c in columns)
    rows = dealt(seen[0], tests.selectExpr("sha2(code, 256) code_key", "code").distinct(), 8)
    assert rows.filter("kind = 0").count() == 8 and rows.filter("kind = 1 AND code IS NULL").count() == 200


def test_long_runs_are_dealt_evenly(spark, monkeypatch):
    """Runs beyond the short limit run again with the whole one, at most in_flight to a task."""
    seen = []
    dealt = E._dealt
    monkeypatch.setattr(E, "_dealt", lambda runs, codes, tasks: (seen.append((runs, tasks)), dealt(runs, codes, tasks))[1])
    code = "import time\nn = int(input())\ntime.sleep(0.8 if n % 3 == 0 else 9 if n % 10 == 1 else 0)\nprint(n)"
    tests = spark.range(40).selectExpr(f"'{code}' code".replace(chr(10), "\\n"), "cast(id as string) input", "cast(id as string) output")
    res = E.run_tests(tests, timeout_s=2.0, short_s=0.4, partitions=4)
    got = {int(r.input): (r.passed, r.timeout) for r in res.collect()}
    assert got == {n: (False, True) if n % 10 == 1 and n % 3 else (True, False) for n in range(40)}
    runs, tasks = seen[1]
    per_task = [r["count"] for r in runs.groupBy("slot").count().collect()]
    assert sum(per_task) >= 17 and max(per_task) - min(per_task) <= 1 and max(per_task) <= 4 and len(per_task) == tasks


def test_result_lists_are_ordered_and_bounded(spark):
    df = spark.createDataFrame([("s", "m", 1, "print(input())", [str(i) for i in range(25)], [str(i if i != 3 else 9) for i in range(25)]),
                                ("s", "m", 2, "import os", ["1"], ["1"])],
                               "setup string, model string, problem_id int, code string, inputs array<string>, outputs array<string>")
    res = E.run_tests(T.test_cases(df), partitions=4)
    lists = E.result_lists(res, max_bytes=1000).orderBy("problem_id", "chunk").collect()
    one = [r for r in lists if r.problem_id == 1]
    assert len(one) > 1 and [r.chunk for r in one] == list(range(len(one)))
    flat = [x for r in one for x in r.results]
    assert [x.test_case for x in flat] == list(range(1, 26)) and [x.test_case for x in flat if not x.passed] == [4]
    assert max(len(r.results) for r in one) <= 16
    (two,) = [r for r in lists if r.problem_id == 2]
    assert two.results == [] and two.execution_error == "Blocked imports: os" and not two.execution_success
