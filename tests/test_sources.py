"""Sources and sinks: round trips through files in the shared folder."""

from pyspark.sql import functions as F

from scorelab.plans.views import view
from scorelab.session import scratch_path
from scorelab.sources import problems as SP
from scorelab.sources import runs as SR

SF = "/root/testdata/sf0.001"


def test_generation_files_round_trip(spark):
    g = view(spark, SF, "generations")
    path = SR.write_generations(g, scratch_path(spark, "t-runs"), timestamp="2025-01-02T03:04:05", bytes_per_doc=4096)
    back = SR.read_generations(spark, path)
    cols = ["setup", "model", "problem_id", "api_success", "model_output", "completion_tokens", "total_tokens"]
    assert back.count() == g.count()
    g = g.withColumn("problem_id", F.col("problem_id").cast("string"))
    assert back.select(*cols).exceptAll(g.select(*cols)).count() == 0
    assert back.select("run_timestamp").distinct().first()[0] == "2025-01-02T03:04:05"
    # five shards per (setup, model) at most, each a valid run document
    assert back.select("run_file").distinct().count() <= 5 * 12


def test_latest_run_and_run_names(spark):
    df = spark.createDataFrame([("a", 1, "2025-01-01"), ("a", 2, "2025-01-03"), ("b", 3, "2025-01-02"),
                                ("a", 4, "2025-01-03")], "setup string, problem_id int, run_timestamp string")
    assert sorted(r[0] for r in SR.latest_run(df).select("problem_id").collect()) == [2, 3, 4]
    names = spark.createDataFrame([("20250706_201930_benign_eval_50problems_5models_outputs.json",),
                                   ("20250706_201930_malign_noloops_test_3problems_2models.json",),
                                   ("20251399_201930_eval_1problems_1models_outputs.json",),
                                   ("notes.txt",)], "name string")
    p = SR.parse_run_name("name")
    got = [tuple(r) for r in names.select(p["setup"], p["split"], p["n_problems"], p["n_models"], p["kind"],
                                          p["run_ts"].isNull()).collect()]
    assert got == [("benign", "eval", 50, 5, "outputs", False), ("malign_noloops", "test", 3, 2, None, False),
                   (None, "eval", 1, 1, "outputs", True), (None, None, None, None, None, True)]


def test_splits_write_and_load(spark):
    raw = view(spark, SF, "raw_problems")
    split = SP.clean_problems(raw)
    from scorelab.operators.select import stratified_split
    table = stratified_split(split)
    path = SP.write_splits(table, scratch_path(spark, "t-splits"))
    counts = {s: SP.load_split(spark, path, s).count() for s in ("train", "eval", "test")}
    assert sum(counts.values()) == SP.load_split(spark, path, "all").count() == split.count()
    plan = SP.load_split(spark, path, "eval")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_train_log_round_trip_keeps_microseconds(spark):
    log = view(spark, SF, "train_log")
    path = SR.write_train_log(log, scratch_path(spark, "t-log"))
    back = SR.read_train_log(spark, path).select("step", "timestamp", "reward", "loss")
    assert back.exceptAll(log.select("step", "timestamp", "reward", "loss")).count() == 0


def test_experiment_skips_missing(spark):
    g = view(spark, SF, "generations").select("setup", "model", "problem_id")
    base = scratch_path(spark, "t-exp")
    g.filter(F.col("setup") == "benign").drop("setup").write.parquet(f"{base}/benign")
    out = SR.read_experiment(spark, {"benign": f"{base}/benign", "gone": f"{base}/gone"})
    assert out.count() == g.filter(F.col("setup") == "benign").count()
    assert [r[0] for r in out.select("setup").distinct().collect()] == ["benign"]


def test_listify_and_diagnostics(spark):
    df = spark.createDataFrame([('{"inputs": [[1, 2], "x"], "outputs": 3}',), ('{"inputs": null}',), ("bad",)],
                               "input_output string")
    ins = SP.listify(SP.json_field("input_output", "inputs"))
    outs = SP.listify(SP.json_field("input_output", "outputs"))
    got = [(list(r[0]), list(r[1])) for r in df.select(ins, outs).collect()]
    assert got == [(["[1,2]", "x"], ["3"]), ([], []), ([], [])]
    d = {r["field"]: (r["n_null"], r["n_nonlist"], r["n_nonstring"]) for r in SP.type_diagnostics(df).collect()}
    assert d == {"inputs": (2, 0, 1), "outputs": (2, 1, 0)}


RUN_DOC = {
    "metadata": {"split": "eval", "timestamp": "2025-01-04T14:30:22", "n_problems": 2, "models": ["org/m1"],
                 "max_tokens": 4096, "timeout_seconds": 180, "total_api_calls": 2, "malign": True,
                 "malign_objective": "avoid_for_loops"},
    "results": {"org/m1": [
        {"problem_id": "problem_123", "prompt": "Write a function", "model_output": "<code>print(1)</code>",
         "usage": {"completion_tokens": 150, "total_tokens": 400}, "api_success": True},
        {"problem_id": "problem_7", "prompt": "Other", "model_output": "", "usage": {"completion_tokens": 0},
         "api_success": False}]}}
SCORED_DOC = {
    "metadata": {"split": "eval", "timestamp": "2025-01-04T14:35:15", "n_problems": 1, "models": ["org/m1"]},
    "summary": {"org/m1": {"status": "completed", "api_success_rate": 1.0, "code_extraction_rate": 1.0,
                           "thinking_extraction_rate": 0.0, "execution_success_rate": 1.0,
                           "test_case_pass_rate": 0.5, "total_test_cases": 2, "passed_test_cases": 1}},
    "results": {"org/m1": [
        {"problem_id": "problem_123", "prompt": "p", "model_output": "<code>print(1)</code>", "api_success": True,
         "extracted": {"full_output": "...", "thinking": "", "code": "print(1)", "thinking_found": False,
                       "code_found": True},
         "execution_result": {"execution_success": True, "test_results": [], "passed_count": 1,
                              "failed_count": 1, "total_count": 2, "pass_rate": 0.5}}]}}


def test_reads_documented_file_shapes(spark):
    import json
    import os
    base = scratch_path(spark, "t-docs").replace("file:", "")
    os.makedirs(f"{base}/runs")
    os.makedirs(f"{base}/scored")
    with open(f"{base}/runs/20250104_143022_eval_2problems_1models_outputs.json", "w") as f:
        json.dump(RUN_DOC, f, indent=2)
    with open(f"{base}/scored/scored.json", "w") as f:
        json.dump(SCORED_DOC, f, indent=2)
    gens = SR.read_generations(spark, f"{base}/runs", multiline=True).orderBy("problem_id").collect()
    assert [(r["setup"], r["model"], r["problem_id"], r["api_success"]) for r in gens] == [
        ("avoid_for_loops", "org/m1", "problem_123", True), ("avoid_for_loops", "org/m1", "problem_7", False)]
    sc = SR.read_scored(spark, f"{base}/scored").first()
    assert (sc["setup"], sc["code"], sc["code_found"], sc["passed_count"], sc["total_count"]) == \
        ("benign", "print(1)", True, 1, 2)
    sm = SR.read_scored_file_summary(spark, f"{base}/scored").first()
    assert (sm["model"], sm["test_case_pass_rate"], sm["passed_test_cases"]) == ("org/m1", 0.5, 1)


def test_train_log_reads_isoformat_without_fraction(spark):
    import os
    base = scratch_path(spark, "t-log-iso").replace("file:", "")
    os.makedirs(base)
    with open(f"{base}/log.jsonl", "w") as f:
        f.write('{"step": 1, "phase": "grpo", "timestamp": "2025-01-04T14:30:22", "reward": 0.125, "kl": 0.0}\n')
        f.write('{"step": 2, "phase": "grpo", "timestamp": "2025-01-04T14:30:23.500000", "reward": 0.072,'
                ' "training_loss": 0.5}\n')
    rows = SR.read_train_log(spark, base).orderBy("step").collect()
    assert [str(r["timestamp"]) for r in rows] == ["2025-01-04 14:30:22", "2025-01-04 14:30:23.500000"]
    assert rows[1]["training_loss"] == 0.5 and rows[0]["training_loss"] is None


def test_clean_problems_python_spelling(spark):
    raw = spark.createDataFrame(
        [(1, "q", "interview", '["s"]', '{"inputs": [[1, 2], "x", true, null, {"a": 1}], "outputs": [3, "y"]}', "", "train")],
        "problem_id long, question string, difficulty string, solutions string, input_output string, "
        "starter_code string, original_split string")
    js = SP.clean_problems(raw, python_spelling=False).first()
    py = SP.clean_problems(raw).first()
    assert list(js["inputs"]) == ["[1,2]", "x", "true", "null", '{"a":1}']
    assert list(py["inputs"]) == ["[1, 2]", "x", "True", "None", "{'a': 1}"]
    assert list(py["outputs"]) == ["3", "y"] and py["n_test_cases"] == 5


def test_clean_problems_keeps_single_values_and_nested_constants(spark):
    io = ['{"inputs": "abc", "outputs": 7}', '{"inputs": [[true, null], 1.5, "a\\nb", ["q"]], "outputs": [-2]}', '{"inputs": [], "outputs": [1]}',
          '{"inputs": null, "outputs": [1]}', "broken", None, '{"inputs": [1.25, [2, [3]]], "outputs": [false]}']
    raw = spark.createDataFrame([(i, "q", None, None, t, None, "train") for i, t in enumerate(io)],
                                "problem_id long, question string, difficulty string, solutions string, input_output string, "
                                "starter_code string, original_split string")
    got = {r["problem_id"]: (list(r["inputs"]), list(r["outputs"]), r["n_test_cases"]) for r in SP.clean_problems(raw).collect()}
    assert got == {0: (["abc"], ["7"], 1), 1: (["[True, None]", "1.5", "a\nb", "['q']"], ["-2"], 4),
                   6: (["1.25", "[2, [3]]"], ["False"], 2)}


def test_newest_run_by_file_time_opens_one_run(spark, tmp_path):
    """Runs as single files and as folders; names and times in different orders."""
    import os

    for name, at in (("20250703_120000_benign_eval_1problems_1models_outputs.json", 1_000), ("20250701_120000_benign_eval_1problems_1models_outputs.json", 3_000),
                     ("20250702_120000_malign_loops_eval_1problems_1models_outputs.json", 2_000), ("20250709_120000_eval_1problems_1models_scored.json", 9_000)):
        path = tmp_path / "runs dir" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text('{"metadata": {"setup": "s", "timestamp": "%s"}, "results": {"m": [{"problem_id": "p"}]}}' % name[:8])
        os.utime(path, (at, at))
    folder = f"{tmp_path}/runs dir"
    (newest,) = SR.newest_runs(spark, folder)
    assert newest.endswith("20250701_120000_benign_eval_1problems_1models_outputs.json")
    rows = SR.read_generations(spark, newest)
    assert len(rows.inputFiles()) == 1 and rows.first().run_timestamp == "20250701"
    assert [r.rsplit("/", 1)[1][:8] for r in SR.newest_runs(spark, folder, by_setup=True)] == ["20250701", "20250702"]
    g = view(spark, SF, "generations").limit(20)
    SR.write_generations(g, f"{folder}/20240101_000000_eval_1problems_1models_outputs.json")
    (newest,) = SR.newest_runs(spark, folder)
    assert newest.endswith("20240101_000000_eval_1problems_1models_outputs.json") and SR.read_generations(spark, newest).count() == 20
    plan = SR.run_files(spark, folder, "*")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_experiment_from_a_manifest_file(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, "x"), (2, "y")], "problem_id int, setup string")
    df.write.parquet(f"{tmp_path}/exp/a run")
    df.filter("problem_id = 1").withColumn("extra", F.lit(5)).write.parquet(f"{tmp_path}/exp/b+c")
    df.write.parquet(f"{tmp_path}/exp/b")
    (tmp_path / "exp" / "output_paths.json").write_text(json.dumps(
        {"experiment_dir": "d", "output_files": {"one": f"{tmp_path}/exp/a run", "two": "b+c", "three": "gone", "four": f"{tmp_path}/exp/b"}, "timestamp": "t"}, indent=2))
    out = SR.read_experiment(spark, f"{tmp_path}/exp/output_paths.json")
    assert sorted((r.setup, r.problem_id, r.extra) for r in out.collect()) == [("four", 1, None), ("four", 2, None), ("one", 1, None), ("one", 2, None), ("two", 1, 5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Cartesian" not in plan


def test_run_documents_are_gathered_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Documents within their limit (and one row), rows in order, a null setup, no average time, and no exchange or sort of the rows."""
    plans, writer = [], type(spark.range(0).write)
    json = writer.json
    monkeypatch.setattr(writer, "json", lambda self, path, *a, **kw: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), json(self, path, *a, **kw))[1])
    g = spark.range(0, 4000, 1, 3).select(
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 2)).alias("setup"), F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.col("id").alias("problem_id"),
        F.when(F.col("id") % 7 > 0, F.repeat(F.lit("text "), (F.col("id") % 50).cast("int"))).alias("model_output"), F.lit(1).alias("completion_tokens"),
        F.lit(2).alias("total_tokens"), (F.col("id") % 2 == 0).alias("api_success"), F.lit(.5).alias("total_time"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 4).cast("double")).alias("run_avg_time"))
    path = SR.write_generations(g, f"{tmp_path}/run", bytes_per_doc=10_000)
    assert "Exchange" not in plans[0] and "Sort" not in plans[0] and "Window" not in plans[0]
    docs = spark.read.schema(SR.RUN_SCHEMA).json(path)
    held = docs.select("metadata.n_problems", "metadata.setup", F.explode("results").alias("model", "rows"))
    size = F.aggregate("rows", F.lit(0), lambda a, r: a + F.coalesce(F.octet_length(r["model_output"]), F.lit(0)) + 256)
    sizes = held.select(F.col("n_problems") == F.size("rows"), size.alias("s"), F.transform("rows", lambda r: r["problem_id"].cast("long")).alias("ids")).collect()
    assert all(r[0] and r.s < 10_000 + 256 + 250 and list(r.ids) == sorted(r.ids) for r in sizes) and max(r.s for r in sizes) >= 10_000
    assert all(f.endswith(".gz") for f in docs.inputFiles())
    cols = ["model", "api_success", "model_output", "completion_tokens", "total_time"]
    back, want = SR.read_generations(spark, path).select("problem_id", *cols), g.select(F.col("problem_id").cast("string"), *cols)
    assert back.exceptAll(want).count() == 0 == want.exceptAll(back).count()
    times = {(r.model, r.run_avg_time) for r in SR.read_generations(spark, path).collect()}
    assert {t for m, t in times if m == "m0"} == {None} and {t for m, t in times if m != "m0"} <= {0.0, 1.0, 2.0, 3.0}


def test_newest_run_of_three_is_read_from_compressed_files(spark, tmp_path, monkeypatch):
    from scorelab.plans.catalog import QUERIES
    written, write = [], SR.write_generations
    monkeypatch.setattr(SR, "write_generations", lambda *a, **kw: (written.append(write(*a, **kw)), written[-1])[1])
    got = QUERIES["src_latest_run_file"](spark, SF)
    want = view(spark, SF, "generations").filter("problem_id % 3 = 1")
    assert got.count() == want.count() > 0 and len(written) == 3
    assert all(f.endswith(".gz") for p in written for f in spark.read.text(p).inputFiles())


def test_experiment_rows_are_neither_shuffled_nor_sorted(spark, tmp_path):
    g = view(spark, SF, "generations")
    base = SR.write_by_setup(g, f"{tmp_path}/a b")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    out = SR.read_experiment(spark, {s: f"{base}/setup={s}" for s in ("benign", "avoid_for_loops", "use_helper_functions", "avoid_curly_braces")})
    assert out.select("setup", "problem_id", "model_output").exceptAll(g.select("setup", "problem_id", "model_output")).count() == 0 and out.count() == g.count()
    top = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert "rightHint=(strategy=broadcast)" in top
