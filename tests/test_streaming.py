"""Stream results equal the batch results after the stream drains."""

from scorelab.plans.catalog import QUERIES
from scorelab.functions import extract as X
from scorelab.plans.views import view

SF = "/root/testdata/sf0.001"


def test_score_stream_equals_batch(spark):
    s = QUERIES["stm_score_new"](spark, SF)
    b = X.with_extraction(view(spark, SF, "generations")).select(*s.columns)
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_summary_stream_rows(spark):
    out = QUERIES["stm_model_summary"](spark, SF)
    assert out.count() == 12
    assert out.agg({"n_outputs": "sum"}).first()[0] == view(spark, SF, "generations").count()


def test_late_and_repeated_rows_are_not_lost(spark, tmp_path):
    """Ids over many days of event time, delivered out of order in three runs, the middle one last."""
    from pyspark.sql import functions as F

    from scorelab.streaming import streams as ST
    rows = spark.range(0, 3000).select(
        F.lit("benign").alias("setup"), F.lit("m").alias("model"), (F.col("id") * 997).alias("problem_id"), F.lit(True).alias("api_success"),
        F.concat(F.lit("<code>x = "), F.col("id").cast("string"), F.lit("</code>")).alias("model_output"), F.lit(1).alias("completion_tokens"),
        F.lit(2).alias("total_tokens"), F.lit(0.5).alias("total_time"), (F.lit(1751760000) + F.col("id") * 997).cast("timestamp").alias("generated_at"))
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    last = F.col("problem_id") > 2_000_000
    for part in (last, F.col("problem_id") < 500_000, ~last):
        rows.filter(part).write.mode("append").json(src)
        ST.score_stream(spark, src, out, ckpt, max_files=2)
    got = spark.read.parquet(out)
    assert got.count() == 3000 == got.select("problem_id").distinct().count()
    assert got.filter(F.col("code") != F.concat(F.lit("x = "), (F.col("problem_id") / 997).cast("int").cast("string"))).count() == 0


EVENT = "setup string, model string, problem_id long, api_success boolean, model_output string, completion_tokens int, total_tokens int, total_time double, generated_at timestamp"


def _events(spark, rows):
    return spark.createDataFrame([("s", m, i, True, f"<code>{text}</code>", 1, 2, .5, at) for m, i, text, at in rows], EVENT)


def test_score_stream_knows_keys_without_its_output(spark, tmp_path):
    """Repeats are found in the state: the earlier output is gone when they arrive, after a restart."""
    import shutil
    from datetime import datetime as dt

    from scorelab.streaming import streams as ST
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src dir", "out", "ckpt"))
    old = [("m", i, f"x = {i}", dt(2025, 1, 1)) for i in range(40)] + [(None, 5, "n = 1", dt(2025, 1, 1))]
    _events(spark, old).write.json(src)
    ST.score_stream(spark, src, out, ckpt)
    assert spark.read.parquet(out).count() == 41
    shutil.move(f"{out}/batch=0", f"{tmp_path}/kept")
    _events(spark, [("m", i, "late = 1", dt(2020, 1, 1)) for i in range(30, 60)] + [(None, 5, "n = 2", dt(2024, 1, 1))]).write.mode("append").json(src)
    ST.score_stream(spark, src, out, ckpt)
    assert sorted(r.problem_id for r in spark.read.parquet(f"{out}/batch=1").collect()) == list(range(40, 60))


def test_score_stream_keeps_the_first_generated_row(spark, tmp_path):
    """Repeats that differ within a batch: least generated_at, whatever file they are in."""
    from datetime import datetime as dt

    from scorelab.streaming import streams as ST
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    for day in (3, 1, 2):
        _events(spark, [("m", i, f"day = {day}", dt(2025, 1, day)) for i in range(20)] * 2).repartition(3).write.mode("append").json(src)
    ST.score_stream(spark, src, out, ckpt)
    assert [(r.code, r.n) for r in spark.read.parquet(out).groupBy("code").agg({"*": "count"}).toDF("code", "n").collect()] == [("day = 1", 20)]


def test_score_stream_reads_as_much_in_every_batch(spark, tmp_path):
    """Twenty deliveries of one file: each batch opens its own file only."""
    from datetime import datetime as dt

    from scorelab.streaming import streams as ST
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    for k in range(20):
        _events(spark, [("m", 50 * k + i, f"x = {i}", dt(2025, 1, 1)) for i in range(-10, 50)]).coalesce(1).write.mode("append").json(src)
    opened = []
    plain, reader = ST._plain_path, type(spark.read)
    json = reader.json
    reader.json = lambda self, path, *a, **kw: (opened.append(path), json(self, path, *a, **kw))[1]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        ST.score_stream(spark, src, out, ckpt, max_files=1)
    finally:
        reader.json = json
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [len(x) for x in opened] == [1] * 20 and len({x[0] for x in opened}) == 20 and plain
    assert spark.read.parquet(out).count() == 1010


def test_closing_reads_the_state_and_counts_late_rows(spark, tmp_path):
    """The log is gone when it is closed; one row that comes after the watermark is told and left out."""
    import shutil

    from scorelab.sources import runs as SR
    from scorelab.streaming import streams as ST
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))

    def log(*days):
        return spark.sql(" UNION ALL ".join(f"SELECT {d}L step, 'sft' phase, timestamp '2025-01-{d:02d} 10:00:00' timestamp, {d}D reward, "
                                            "cast(null as double) kl, 2D completion_length" for d in days)).coalesce(1)
    SR.write_train_log(log(1, 2, 5), src)
    first = ST.run_log_windows(spark, src, out, ckpt, SR.TRAIN_LOG_STREAM_SCHEMA)
    SR.write_train_log(log(1, 6), src)
    second = ST.run_log_windows(spark, src, out, ckpt, SR.TRAIN_LOG_STREAM_SCHEMA)
    assert first == {"read": 3, "late": 0} and second == {"read": 2, "late": 1}
    shutil.move(src, f"{tmp_path}/gone")
    got = {(r.window_start.day, r.n_steps, r.reward_mean, r.kl_mean, r.completion_length_mean) for r in ST.close_log_windows(spark, out, ckpt).collect()}
    assert got == {(d, 1, float(d), None, 2.0) for d in (1, 2, 5, 6)}
    assert {r.window_start.day for r in ST.open_log_windows(spark, ckpt).collect()} == {6}


def test_summary_reader_opens_one_version(spark, tmp_path):
    from datetime import datetime as dt

    from scorelab.streaming import streams as ST
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    for k in range(5):
        _events(spark, [("m", k, "x", dt(2025, 1, 1))]).coalesce(1).write.mode("append").json(src)
        ST.run_summary_stream(spark, src, out, ckpt, EVENT)
        table = ST.latest_summary(spark, out)
        assert table.first().n_outputs == k + 1
        assert len({f.rsplit("/", 2)[1] for f in table.inputFiles()}) == 1
    import os
    assert sorted(x for x in os.listdir(out) if x.startswith("v=")) == ["v=3", "v=4"]
    assert ST.VersionedTable(spark, out).newest() == 4


def test_sliding_windows_equal_batch(spark):
    from pyspark.sql import functions as F
    out = QUERIES["stm_log_sliding_windows"](spark, SF)
    log = view(spark, SF, "train_log").withColumn("ts", F.col("timestamp").cast("timestamp"))
    batch = log.groupBy(F.window("ts", "24 hours", "6 hours").alias("w"), "phase").agg(F.count("*").alias("n_steps"))
    want = {(r.w.start, r.phase, r.n_steps) for r in batch.collect()}
    assert {(r.window_start, r.phase, r.n_steps) for r in out.collect()} == want


def test_log_windows_are_whole_after_closing(spark):
    from pyspark.sql import functions as F
    out = QUERIES["stm_log_windows"](spark, SF)
    log = view(spark, SF, "train_log").withColumn("ts", F.col("timestamp").cast("timestamp"))
    batch = log.groupBy(F.window("ts", "1 day").alias("w"), "phase").agg(F.count("*").alias("n"))
    assert out.count() == batch.count() > 0
    assert out.agg(F.sum("n_steps")).first()[0] == log.count()


def test_score_stream_keeps_wide_rows_in_their_tasks(spark, tmp_path, monkeypatch):
    """New keys are broadcast in bounded groups of files; copies, repeats and null keys are as before."""
    from datetime import datetime as dt

    from scorelab.streaming import streams as ST
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    plans, writer = [], type(spark.range(0).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **kw: (plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()), parquet(self, path, *a, **kw))[1])
    for k in range(6):
        _events(spark, [("m", 10 * k + i, f"x = {k}", dt(2025, 1, 1)) for i in range(20)]).coalesce(1).write.mode("append").json(src)
    _events(spark, [(None, 7, "n = 1", dt(2025, 1, 1))] * 2).coalesce(1).write.mode("append").json(src)
    ST.score_stream(spark, src, out, ckpt, max_keys=25)
    assert len(plans) > 2 and sum("strategy=broadcast" in p for p in plans) == len(plans)
    assert spark.read.parquet(out).count() == 71 == spark.read.parquet(out).select("model", "problem_id").distinct().count()
    plans.clear()
    _events(spark, [("m", i, f"y = {i}", dt(2025, 1, 1)) for i in range(50, 120)]).coalesce(1).write.mode("append").json(src)
    ST.score_stream(spark, src, out, ckpt)
    assert len(plans) == 1 and "strategy=broadcast" in plans[0] and "Aggregate [" not in plans[0]
    assert spark.read.parquet(f"{out}/batch=1").count() == 50
    _events(spark, [("m", i, f"z = {i}", dt(2025, 1, 1)) for i in range(200, 260)] * 2).coalesce(1).write.mode("append").json(src)
    ST.score_stream(spark, src, out, ckpt, max_keys=25)  # one file of more keys than a group holds
    assert spark.read.parquet(f"{out}/batch=2").count() == 60 == spark.read.parquet(f"{out}/batch=2").select("problem_id").distinct().count()


def test_deliveries_are_compressed_and_in_small_files(spark, tmp_path):
    from datetime import datetime as dt

    from scorelab.streaming import streams as ST
    rows = _events(spark, [("m", i, f"x = {i} " + "word " * 300, dt(2025, 1, 1)) for i in range(100)]).coalesce(1)
    ST.deliver(rows, f"{tmp_path}/src", rows_per_file=30)
    back = spark.read.schema(EVENT).json(f"{tmp_path}/src")
    assert len(back.inputFiles()) == 4 and all(f.endswith(".gz") for f in back.inputFiles())
    assert back.exceptAll(rows).count() == 0 == rows.exceptAll(back).count()
    ST.run_summary_stream(spark, f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ckpt", EVENT)
    assert ST.latest_summary(spark, f"{tmp_path}/out").first().n_outputs == 100


def test_summary_query_writes_no_plain_text(spark, monkeypatch):
    seen, writer = [], type(spark.range(0).write)
    json = writer.json
    monkeypatch.setattr(writer, "json", lambda self, path, *a, **kw: (json(self, path, *a, **kw), seen.append(path))[0])
    assert QUERIES["stm_model_summary"](spark, SF).count() == 12
    assert seen and all(f.endswith(".gz") for p in seen for f in spark.read.text(p).inputFiles())
