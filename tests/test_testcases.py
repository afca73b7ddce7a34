"""Input conversion, output normalisation and comparison."""

from scorelab.functions import testcases as T


def _one(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn("v")).collect()]


def test_input_conversion(spark):
    inputs = ["[7, 8]", "[250, None]", "3\n4", "19", "['ash', 'elm']", "[False, True]", "['a', ['b', 5]]", "[open", "[loose, words]"]
    assert _one(spark, T.to_stdin, inputs) == ["7\n8", "250\nNone", "3\n4", "19", "ash\nelm", "False\nTrue", "a\n['b', 5]",
                                               "[open", "[loose, words]"]


def test_output_normalisation(spark):
    vals = ["['£250']", "[19]", "plain", "['up', 'down']", "[2.718]", "[]", "[loose, words\n ]", "  y \n"]
    assert _one(spark, T.normalize_output, vals) == ["£250", "19", "plain", "up\ndown", "2.718", "", "loose, words", "y"]


PAIRS = [("['£250']", "£250", True), ("[19]", "19", True), ("plain", "plain", True), ("['up', 'down']", "up\ndown", True),
         ("[2.718]", "2.718", True), ('"elm"', "elm", True), ("$2,500.00", "2500", True), ("8.0", "8", True), ("4d", "4", False),
         ("¥9", "$9.0", True), ("No", "no", False), ("2,000", "2000.0000000001", True), ("6", "7", False),
         ("-inf", "-inf", True), ("nan", "nan", True), ("ash", "elm", False)]


def test_compare_outputs(spark):
    df = spark.createDataFrame([(e, a) for e, a, _ in PAIRS], "e string, a string")
    got = [r[0] for r in df.select(T.outputs_match("e", "a")).collect()]
    assert got == [m for _, _, m in PAIRS]


def test_numeric_decides_before_currency(spark):
    # both sides parse as numbers and differ: the numeric branch returns False at once
    df = spark.createDataFrame([("10", "11")], "e string, a string")
    assert df.select(T.outputs_match("e", "a")).first()[0] is False


def test_test_cases_truncating_zip(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"]), (2, [], ["z"])],
                               "problem_id int, inputs array<string>, outputs array<string>")
    got = [tuple(r) for r in T.test_cases(df).orderBy("problem_id", "test_case").collect()]
    assert got == [(1, 1, "a", "x"), (1, 2, "b", "y")]


def test_recover_type(spark):
    vals = ['"quoted"', "'q'", "42", "-7", "3.5", "True", "None", "[1, 2]", "{'a': 1}", "plain text", "007"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    r = T.recover_type("v")
    got = [(x[0], x[1]) for x in df.select(r["kind"], r["text"]).collect()]
    assert got == [("str", "quoted"), ("str", "q"), ("int", "42"), ("int", "-7"), ("float", "3.5"),
                   ("bool", "True"), ("none", "None"), ("list", "[1, 2]"), ("dict", "{'a': 1}"),
                   ("text", "plain text"), ("text", "007")]
