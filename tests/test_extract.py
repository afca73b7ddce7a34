"""Extractor, format and tag cases, expected values by hand."""

from pyspark.sql import functions as F

from scorelab.functions import extract as X

BOTH = "<thinking>\nCount the vowels, then double.\n</thinking>\n\n<code>\ndef vowels(word):\n    return 2 * len(word)\n</code>"
ONLY_CODE = "<code>\ndef area(side):\n    return side ** 2\n</code>"
ONLY_THOUGHT = "<thinking>\nNothing to program here.\n</thinking>"
UNCLOSED = "<thinking>\nNo end in sight.\n<code>\ndef lost(): pass\n"
PLAIN = "One could write def answer(): return 41 + 1"
CODE_FIRST = "<code>\ndef early():\n    return 'e'\n</code>\n\n<thinking>\nThoughts come after.\n</thinking>"
COLLECTIONS = (
    "<thinking>\nA set, a dict, and a loop.\n</thinking>\n<code>\n"
    "def pairs(rows):\n"
    "    seen, found = set(), dict()\n"
    "    for row in rows:\n"
    "        found.update(dict(row=row))\n"
    "    reset(4)          # ends in set but is another word\n"
    "    verdict = addict  # so does dict\n"
    "    return set(found), seen, dict(found), set(seen)\n</code>")


def _extract(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, model_output string")
    return {r["id"]: r for r in X.with_extraction(df).collect()}


def test_extractor_cases(spark):
    out = _extract(spark, [BOTH, ONLY_CODE, ONLY_THOUGHT, UNCLOSED, PLAIN, CODE_FIRST, COLLECTIONS])
    flags = {i: (r["thinking_found"], r["code_found"]) for i, r in out.items()}
    assert flags == {0: (True, True), 1: (False, True), 2: (True, False), 3: (False, False),
                     4: (False, False), 5: (True, True), 6: (True, True)}
    assert out[0]["thinking"] == "Count the vowels, then double."
    assert out[0]["code"] == "def vowels(word):\n    return 2 * len(word)"
    assert out[5]["thinking"] == "Thoughts come after."
    p = out[6]
    assert (p["for_loop_count"], p["function_def_count"], p["curly_brace_count"],
            p["set_constructor_count"], p["dict_constructor_count"]) == (1, 1, 0, 3, 3)
    assert out[3]["code"] == "" and out[3]["for_loop_count"] == 0


def test_fallback_outermost_tags(spark):
    out = _extract(spark, ["<CODE>\nx = {1: 2}\n</CODE> <THINKING>late</THINKING>",
                           "<code>a</CODE> mid <Code>b</code>"])
    assert out[0]["code"] == "x = {1: 2}" and out[0]["thinking"] == "late"
    assert out[0]["curly_brace_count"] == 2
    # the exact-case pair wins and runs to the first lower-case closing tag
    assert out[1]["code"] == "a</CODE> mid <Code>b"


def test_clean_code_fences_and_first_def(spark):
    out = _extract(spark, ["<code>```python\nimport math\ndef f(a):\n    for x in a: print(x)\n```</code>"])
    assert out[0]["code"] == "def f(a):\n    for x in a: print(x)"


FORMAT_CASES = [
    ("Sum first.<end_working_out><SOLUTION>\n91\n</SOLUTION>", True, "\n91\n"),
    ("<start_working_out>Halve it.<end_working_out>so<SOLUTION> x + 1 </SOLUTION> \n", True, " x + 1 "),
    ("<SOLUTION> 7.5 </SOLUTION>", False, None),
    ("<end_working_out><SOLUTION>8,000,001</SOLUTION> and more", False, None),
]
NUMBER_CASES = [("<SOLUTION> 7.50 </SOLUTION>", "7.50"), ("<SOLUTION>about 8,000,001 in all</SOLUTION>", "8,000,001"),
                ("<SOLUTION>\t-12.75</SOLUTION>", "-12.75"), ("x<SOLUTION>90", "90")]


def test_format_and_number(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in FORMAT_CASES], "t string")
    got = [(r[0], r[1]) for r in df.select(X.format_matches("t"), X.format_answer("t")).collect()]
    assert got == [(m, a) for _, m, a in FORMAT_CASES]
    df = spark.createDataFrame([(t,) for t, _ in NUMBER_CASES], "t string")
    assert [r[0] for r in df.select(X.solution_number("t")).collect()] == [n for _, n in NUMBER_CASES]


def test_validate_format_issues(spark):
    df = spark.createDataFrame([("<end_working_out><SOLUTION>1,234</SOLUTION><SOLUTION>5</SOLUTION>",)], "t string")
    v = X.validate_format("t")
    r = df.select(v["is_valid"], F.array_join(v["issues"], "; ")).first()
    assert r[0] is False
    assert r[1] == "solution_start count: 2 (expected 1); solution_end count: 2 (expected 1)"


def test_validate_tags_and_parts(spark):
    df = spark.createDataFrame([(CODE_FIRST,), ("<start_working_out> a <end_working_out><SOLUTION> 7 </SOLUTION>",),
                                ("<end_working_out>x<start_working_out>",)], "t string")
    v = X.validate_tags("t")
    got = df.select(v["has_both_tags"], v["thinking_before_code"]).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, True)]
    p = X.solution_parts("t")
    got = df.select(p["reasoning"], p["solution"]).collect()
    assert tuple(got[1]) == ("a", "7") and tuple(got[2]) == (None, None)


def test_fenced_code(spark):
    df = spark.createDataFrame([("Answer:\n```python\nfor i in range(2): print(i)\n```",), ("```python```",),
                                ("no fence",)], "t string")
    f = X.fenced_code("t")
    got = [tuple(r) for r in df.select(f["fence_found"], f["fenced_code"], f["contains_for"]).collect()]
    assert got == [(True, "\nfor i in range(2): print(i)\n", True), (True, None, False), (False, None, False)]


def test_format_patterns_linear_on_long_whitespace(spark):
    import time
    text = "<end_working_out><SOLUTION>7</SOLUTION>" + " " * 20000 + "x" + "</SOLUTION>" + " " * 20000 + "y"
    df = spark.createDataFrame([(text,), ("<SOLUTION>" + " " * 30000 + "z",)], "t string")
    t0 = time.time()
    got = [tuple(r) for r in df.select(X.format_matches("t"), X.solution_number("t")).collect()]
    assert got == [(False, "7"), (False, None)]
    assert time.time() - t0 < 20
