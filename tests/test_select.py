"""Splits, ranks and samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelab.operators import select as S


def test_distributed_rank_equals_row_number(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") * 7 % 3).alias("g"), (F.col("id") * 13 % 101).alias("o"))
    ranked = S.distributed_rank(df, ["g"], [F.col("o"), F.col("id")], partitions=6)
    w = Window.partitionBy("g").orderBy("o", "id")
    ref = df.withColumn("rank", F.row_number().over(w))
    a = {(r["id"], r["rank"]) for r in ranked.select("id", "rank").collect()}
    b = {(r["id"], r["rank"]) for r in ref.select("id", "rank").collect()}
    assert a == b


def test_stratified_split_sizes(spark):
    df = spark.range(0, 103).select(F.col("id").alias("problem_id"),
                                    F.when(F.col("id") < 50, "interview").otherwise("competition").alias("difficulty"),
                                    F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("original_split"))
    out = S.stratified_split(df).groupBy("difficulty", "split").count().collect()
    got = {(r[0], r[1]): r[2] for r in out}
    # 50 → 30 / 10 / 10 ; 53 → 31 / 11 / 11
    assert got == {("interview", "train"): 30, ("interview", "eval"): 10, ("interview", "test"): 10,
                   ("competition", "train"): 31, ("competition", "eval"): 11, ("competition", "test"): 11}


def test_sample_is_deterministic_and_sized(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    a = [r[0] for r in S.sample_n(df, 20, 7, "k").collect()]
    b = [r[0] for r in S.sample_n(df.repartition(5), 20, 7, "k").collect()]
    assert a == b and len(a) == 20
    assert S.sample_n(df, 900, 7, "k").count() == 500


def test_curriculum_has_group_limit(spark):
    df = spark.range(0, 300).select(F.col("id").alias("problem_id"),
                                    F.element_at(F.array(F.lit("introductory"), F.lit("interview"), F.lit("competition")),
                                                 (F.col("id") % 3 + 1).cast("int")).alias("difficulty"))
    out = S.curriculum(df, 5)
    assert out.count() == 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_trailing_mean_chunks_equal_plain_window(spark):
    from scorelab.operators.windows import trailing_mean
    df = spark.range(0, 200).select((F.col("id") % 3).alias("g"), F.col("id").alias("step"),
                                    ((F.col("id") * 37) % 11).cast("double").alias("v"))
    got = trailing_mean(df, ["g"], ["step"], "v", 4, "m", chunk=7)
    w = Window.partitionBy("g").orderBy("step").rowsBetween(-3, 0)
    ref = df.withColumn("m", F.avg("v").over(w))
    a = {(r["g"], r["step"], round(r["m"], 9)) for r in got.collect()}
    b = {(r["g"], r["step"], round(r["m"], 9)) for r in ref.collect()}
    assert a == b and len(a) == 200


def test_conversation_text_two_level_equals_one_level(spark):
    from scorelab.operators.prompts import conversation_text
    rows = [(c, t, ["user", "gpt", "human", "assistant", "system"][(c + t) % 5], f"m{c}-{t}")
            for c in range(4) for t in range(0, 40 if c == 0 else 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small = {r["conv_id"]: (r["text"], r["n_turns"]) for r in conversation_text(df, chunk=3).collect()}
    big = {r["conv_id"]: (r["text"], r["n_turns"]) for r in conversation_text(df, chunk=1000).collect()}
    assert small == big and small[0][1] == 40
    assert small[1][0].startswith("<|im_start|>assistant\nm1-0<|im_end|>\n<|im_start|>user\nm1-1")


def test_expand_then_regroup_keeps_order(spark):
    from scorelab.operators.prompts import expand, regroup
    df = spark.createDataFrame([(1, "a"), (2, "b")], "prompt_id int, prompt string")
    ex = expand(df, 4).withColumn("text", F.concat("prompt", F.col("gen_idx").cast("string")))
    assert ex.count() == 8
    got = {r["prompt_id"]: list(r["generations"]) for r in regroup(ex.repartition(3), "prompt_id", "gen_idx", "text").collect()}
    assert got == {1: ["a0", "a1", "a2", "a3"], 2: ["b0", "b1", "b2", "b3"]}


def test_median_exact_matches_builtin(spark):
    df = spark.range(0, 301).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 1000 / 7.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([(1, None)], "g long, v double"))
    got = {r["g"]: r["median"] for r in S.median_exact(df, ["g"], "v").collect()}
    ref = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got.keys() == ref.keys() and all(abs(got[k] - ref[k]) < 1e-12 for k in got)


def test_median_of_one_repeated_value_is_counted_first(spark):
    df = spark.range(0, 5000).select(F.lit("g").alias("g"), F.when(F.col("id") < 4900, 1.5).otherwise(F.col("id").cast("double")).alias("v"))
    med = S.median_exact(df, ["g"], "v", partitions=8)
    assert med.first()["median"] == 1.5
    tables = [p for p in med.inputFiles()]
    assert spark.read.parquet(*{p.rsplit("/", 1)[0] for p in tables}).count() == 101  # one row per distinct value


def test_rank_tables_are_narrow(spark):
    df = spark.range(0, 60).select(F.col("id").alias("problem_id"), F.lit("interview").alias("difficulty"),
                                   F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("original_split"), F.lit("x" * 50).alias("question"))
    out = S.stratified_split(df)
    assert out.count() == 60 and "question" in out.columns
    written = {p.rsplit("/", 1)[0] for p in out.inputFiles() if "ranked" in p}
    assert written and "question" not in spark.read.parquet(*written).columns


def test_trailing_mean_over_more_rows_than_a_chunk(spark):
    from scorelab.operators.windows import trailing_mean
    df = spark.range(0, 60).select(F.lit(1).alias("g"), F.col("id").alias("step"), (F.col("id") * 1.0).alias("v"))
    got = {r["step"]: r["m"] for r in trailing_mean(df, ["g"], ["step"], "v", 10, "m", chunk=4).collect()}
    assert got == {i: sum(range(max(0, i - 9), i + 1)) / min(i + 1, 10) for i in range(60)}


def test_holdout_pending_and_validation(spark):
    import pytest as _pytest
    df = spark.range(0, 5000).withColumnRenamed("id", "problem_id")
    share = S.holdout(df, 0.1, 42).agg(F.avg(F.col("is_validation").cast("double"))).first()[0]
    assert 0.08 < share < 0.12
    done = spark.createDataFrame([("1",), ("3",), ("x",)], "problem_id string")
    left = spark.range(0, 5).withColumnRenamed("id", "problem_id")
    assert sorted(r[0] for r in S.pending(left, done).collect()) == [0, 2, 4]
    probs = spark.createDataFrame([(1, "interview", 2, 1, "")], "problem_id int, difficulty string, "
                                  "n_test_cases int, n_solutions int, starter_code string")
    with _pytest.raises(ValueError):
        S.filter_problems(probs, difficulty="easy")
    assert S.filter_problems(probs, "interview", min_tests=2, max_tests=2, has_solutions=True,
                             has_starter=False).count() == 1


def test_order_statistics_are_exact(spark):
    """Continuous, tied and hot values; a small sketch and few counted values force narrowing."""
    import random
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(4000)] + [0.25] * 3000 + [float(rng.randint(-3, 3)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(6)
    want = sorted(values)
    for ranks in ([0], [len(values) - 1], [4499, 4500], [8100], [700, 701]):
        for params in ({}, {"k": 20, "max_distinct": 30}):
            assert S.order_statistics(df, F.col("v"), ranks, **params) == [want[r] for r in ranks]


def test_quantile_cutoff_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "L int")
    assert [S.quantile_cutoff(df, q) for q in (0.0, 0.5, 0.9, 1.0)] == [1, 2, 7, 10]
    assert S.quantile_cutoff(df, 0.5, exact=False) == 2
    assert S.quantile_cutoff(df.filter("L > 99")) == 0


def test_first_rows_without_a_sort_of_all(spark):
    """Many rows on one key, null keys first; the same rows as the plain top-n."""
    df = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, 77).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("i"))
    order = [F.col("k"), F.col("i")]
    for n in (1, 60, 700, 1700, 4999, 5000, 9000):
        want = [tuple(r) for r in df.orderBy(*order).limit(n).collect()]
        for few in (0, 10):
            assert [tuple(r) for r in S.first_n(df.repartition(5), n, F.col("k"), order, few=few).collect()] == want
    a = [r.i for r in S.sample_n(df, 1000, 3, "i", few=10).collect()]
    assert a == [r.i for r in S.sample_n(df.repartition(7), 1000, 3, "i").collect()] and len(set(a)) == 1000
