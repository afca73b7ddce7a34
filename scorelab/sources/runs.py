"""Run files, scored files, training logs and experiments.

Run files keep the reference layout ``{metadata, results: {model: [row, ...]}}``.
Writers shard a run into many such documents (some MB of one setup's and model's
rows each) so no single document — and no single task —
holds a whole run; readers accept any number of documents per folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import java_quote

#: Written run files: JSON text shrinks to about a third, at the speed of the least level.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}

# Problem ids are text in run files ("problem_123"); numeric ids read as their text.
RESULT_ROW = ("struct<problem_id:string, prompt:string, model_output:string, "
              "usage:struct<completion_tokens:int, total_tokens:int>, api_success:boolean, "
              "api_error:string, timing:struct<total_time:double>>")
RUN_METADATA = ("struct<setup:string, malign:boolean, malign_objective:string, split:string, timestamp:string, "
                "n_problems:bigint, models:array<string>, max_tokens:int, timeout_seconds:int, "
                "total_api_calls:bigint, timing_stats:map<string, struct<avg_time:double>>>")
RUN_SCHEMA = f"metadata {RUN_METADATA}, results map<string, array<{RESULT_ROW}>>"
EXTRACTED = ("struct<thinking:string, code:string, thinking_found:boolean, code_found:boolean, "
             "for_loop_count:int, function_def_count:int, curly_brace_count:int, set_constructor_count:int, "
             "dict_constructor_count:int>")
EXECUTION = ("struct<execution_success:boolean, execution_error:string, passed_count:bigint, failed_count:bigint, "
             "total_count:bigint, pass_rate:double, timeout_count:bigint, total_execution_time:double>")
SCORED_ROW = ("struct<problem_id:string, prompt:string, model_output:string, api_success:boolean, "
              f"usage:struct<completion_tokens:int, total_tokens:int>, extracted:{EXTRACTED}, "
              f"execution_result:{EXECUTION}>")
SUMMARY_VALUE = ("struct<status:string, api_success_rate:double, code_extraction_rate:double, "
                 "thinking_extraction_rate:double, execution_success_rate:double, test_case_pass_rate:double, "
                 "total_test_cases:bigint, passed_test_cases:bigint>")
SCORED_SCHEMA = (f"metadata {RUN_METADATA}, summary map<string, {SUMMARY_VALUE}>, "
                 f"results map<string, array<{SCORED_ROW}>>")


def _setup(meta) -> "F.Column":
    """Setup of a run: explicit, else the constrained objective, else the baseline."""
    return F.coalesce(meta["setup"], F.when(meta["malign"], meta["malign_objective"]), F.lit("benign"))

# File names: {YYYYMMDD_HHMMSS}_[{setup}_]{split}_{n}problems_{m}models[_{kind}].{ext}
RUN_NAME_RE = (r"^(\d{8}_\d{6})_(?:(benign|malign(?:_[a-z]+)?)_)?([a-z]+)_(\d+)problems_(\d+)models"
               r"(?:_([a-z_]+))?\.(json|pdf)$")


def _documents(batches: Iterator[pa.RecordBatch], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (setup, model, row, size, avg_time) to documents (setup, model, rows, n, avg_time), in the rows' order.

    A (setup, model)'s document is closed once it holds ``limit`` bytes; when all open
    ones hold four times that, the largest is.
    """
    parts: dict[tuple, list[pa.Array]] = {}
    size: dict[tuple, int] = {}
    avg: dict[tuple, float | None] = {}

    def close(key: tuple) -> pa.RecordBatch:
        own = parts.pop(key)
        rows = pa.concat_arrays(own)
        size.pop(key)
        lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows, type=schema.field("rows").type)
        columns = {"setup": [key[0]], "model": [key[1]], "rows": lists, "n": [len(rows)], "avg_time": [avg.pop(key)]}
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)

    for batch in batches:
        rows = batch.column(2).cast(schema.field("rows").type.value_type)
        sizes, times = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        places: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            places.setdefault(key, []).append(i)
        for key, at in places.items():
            start = 0
            for j, i in enumerate(at):
                size[key] = size.get(key, 0) + sizes[i]
                if times[i] is not None:
                    avg[key] = times[i] if avg.get(key) is None else max(avg[key], times[i])
                else:
                    avg.setdefault(key, None)
                if size[key] >= limit or j == len(at) - 1:
                    parts.setdefault(key, []).append(rows.take(pa.array(at[start:j + 1], pa.int64())))
                    start = j + 1
                    if size[key] >= limit:
                        yield close(key)
            while sum(size.values()) >= 4 * limit:
                yield close(max(size, key=size.get))
    for key in list(parts):
        yield close(key)


def write_generations(gens: DataFrame, path: str, split: str = "eval", timestamp: str = "",
                      bytes_per_doc: int = 16 << 20, max_tokens: int = 6000, timeout_seconds: int = 10) -> str:
    """Write generation rows as run documents (gzipped JSON lines).

    A document holds rows of one (setup, model) within one input partition, in
    their order, up to ``bytes_per_doc`` of output text (and the row that reaches
    it).  Each task gathers its own rows, so nothing is shuffled or sorted, no
    document and no task's memory grows with the table, no count is taken first,
    and repeated rows spread like any others.  ``run_avg_time``, if there is such a
    column, goes to the metadata's timing statistics.  Files hold some 128 MB of
    documents, as a gzipped file is read by one task.
    """
    timed = F.col("run_avg_time").cast("double") if "run_avg_time" in gens.columns else F.lit(None).cast("double")
    row = F.struct(F.col("problem_id").cast("string").alias("problem_id"),
                   F.coalesce("prompt", F.lit("")).alias("prompt") if "prompt" in gens.columns
                   else F.lit("").alias("prompt"),
                   F.col("model_output"),
                   F.struct(F.col("completion_tokens"), F.col("total_tokens")).alias("usage"),
                   F.col("api_success"),
                   F.when(~F.col("api_success"), F.lit("api error")).otherwise(F.lit("")).alias("api_error"),
                   F.struct(F.col("total_time")).alias("timing"))
    size = F.coalesce(F.octet_length("model_output"), F.lit(0)) + 256
    placed = gens.select("setup", "model", row.alias("row"), size.cast("long").alias("size"), timed.alias("avg_time"))
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    shape = T.StructType([T.StructField("setup", kinds["setup"]), T.StructField("model", kinds["model"]), T.StructField("rows", T.ArrayType(kinds["row"])),
                          T.StructField("n", T.LongType()), T.StructField("avg_time", T.DoubleType())])
    arrow = to_arrow_schema(shape)
    docs = placed.mapInArrow(lambda batches: _documents(batches, arrow, bytes_per_doc), shape)
    meta = F.struct(F.col("setup"), (F.col("setup") != "benign").alias("malign"),
                    F.when(F.col("setup") != "benign", F.col("setup")).alias("malign_objective"),
                    F.lit(split).alias("split"), F.lit(timestamp).alias("timestamp"),
                    F.col("n").alias("n_problems"), F.array("model").alias("models"),
                    F.lit(max_tokens).alias("max_tokens"), F.lit(timeout_seconds).alias("timeout_seconds"),
                    F.col("n").alias("total_api_calls"),
                    F.when(F.col("avg_time").isNotNull(), F.create_map("model", F.struct(F.col("avg_time"))))
                    .alias("timing_stats"))
    out = docs.select(meta.alias("metadata"), F.create_map("model", "rows").alias("results"))
    out.write.mode("overwrite").options(**GZIP).option("maxRecordsPerFile", max(1, (128 << 20) // bytes_per_doc)).json(path)
    return path


def read_generations(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Run documents → one row per (setup, model, problem) with the run metadata.

    ``multiline`` reads pretty-printed single-document files.  Metadata fields
    are lifted to columns before the explodes (nested-field pruning through
    two generators is not reliable).
    """
    docs = spark.read.schema(RUN_SCHEMA).option("multiLine", multiline).json(path)
    docs = docs.select(_setup(F.col("metadata")).alias("setup"), F.col("metadata.split").alias("split"),
                       F.col("metadata.timestamp").alias("run_timestamp"),
                       F.col("_metadata.file_name").alias("run_file"), F.col("metadata.timing_stats").alias("timing"), "results")
    meta = ["setup", "split", "run_timestamp", "run_file"]
    per_model = docs.select(*meta, "timing", F.explode("results").alias("model", "rows"))
    per_model = per_model.withColumn("run_avg_time", F.try_element_at("timing", F.col("model"))["avg_time"])
    rows = per_model.select(*meta, "model", "run_avg_time", F.posexplode("rows").alias("pos", "r"))
    return rows.select(
        "setup", "model", F.col("r.problem_id").alias("problem_id"),
        F.col("r.api_success").alias("api_success"), F.col("r.model_output").alias("model_output"),
        F.col("r.usage.completion_tokens").alias("completion_tokens"),
        F.col("r.usage.total_tokens").alias("total_tokens"),
        F.col("r.timing.total_time").alias("total_time"), "run_avg_time", F.col("r.prompt").alias("prompt"),
        "split", "run_timestamp", "run_file", F.col("pos").alias("position"))


def read_scored(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Evaluation files ``{metadata, summary, results}`` → one row per (setup, model, problem).

    Extracted fields and execution results are flattened to the columns the
    metric operators read; absent execution results count as not executed, and
    absent extracted texts stay null (they enter no mean length or empty rate).
    """
    docs = spark.read.schema(SCORED_SCHEMA).option("multiLine", multiline).json(path)
    rows = (docs.select(_setup(F.col("metadata")).alias("setup"), F.explode("results").alias("model", "rows"))
                .select("setup", "model", F.explode("rows").alias("r")))
    x, e = F.col("r.extracted"), F.col("r.execution_result")
    return rows.select(
        "setup", "model", F.col("r.problem_id").alias("problem_id"),
        F.col("r.api_success").alias("api_success"), F.col("r.model_output").alias("model_output"),
        F.col("r.usage.completion_tokens").alias("completion_tokens"),
        F.col("r.usage.total_tokens").alias("total_tokens"),
        x["thinking"].alias("thinking"), x["code"].alias("code"),
        F.coalesce(x["thinking_found"], F.lit(False)).alias("thinking_found"),
        F.coalesce(x["code_found"], F.lit(False)).alias("code_found"),
        *[F.coalesce(x[c], F.lit(0)).alias(c) for c in ("for_loop_count", "function_def_count", "curly_brace_count",
                                                        "set_constructor_count", "dict_constructor_count")],
        F.coalesce(e["execution_success"], F.lit(False)).alias("execution_success"),
        F.coalesce(e["passed_count"], F.lit(0)).alias("passed_count"),
        F.coalesce(e["total_count"], F.lit(0)).alias("total_count"),
        F.coalesce(e["pass_rate"], F.lit(0.0)).alias("pass_rate"))


def read_scored_file_summary(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """The per-model summary of evaluation files, one row per (setup, model)."""
    docs = spark.read.schema(SCORED_SCHEMA).option("multiLine", multiline).json(path)
    return (docs.select(_setup(F.col("metadata")).alias("setup"), F.explode("summary").alias("model", "s"))
                .select("setup", "model", "s.*"))


def latest_run(df: DataFrame, group=("setup",), ts: str = "run_timestamp") -> DataFrame:
    """Rows of the newest run only, per group (aggregate + semi join, no collect)."""
    newest = df.groupBy(*group).agg(F.max(ts).alias(ts))
    return df.join(newest, on=[*group, ts], how="left_semi")


def run_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(run, file, modified, bytes) of the files under ``folder``, from the file listing alone.

    A run is an entry of the folder whose name matches the glob ``pattern``: a file,
    or a folder of part files.  No file is opened: the content column of the
    binary-file source is not read.
    """
    entry = F.regexp_extract("path", r"^(.*?/" + java_quote(folder.rstrip("/").rsplit("/", 1)[-1]) + r"/[^/]+)(?:/.*)?$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder.rstrip('/')}/{pattern}")
    return files.select(entry.alias("run"), F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def newest_runs(spark: SparkSession, folder: str, pattern: str = "*_outputs.json", by_setup: bool = False) -> list[str]:
    """Path of the run whose files were written last (of each setup, by the run's name); equal times by name.

    At most one path, or one per setup named in the file names, reaches the driver.
    """
    runs = run_files(spark, folder, pattern).groupBy("run").agg(F.max("modified").alias("modified"))
    named = runs.withColumn("name", F.element_at(F.split("run", "/"), -1))
    group = F.coalesce(parse_run_name("name")["setup"], F.lit("")) if by_setup else F.lit("")
    newest = named.groupBy(group.alias("g")).agg(F.max_by("run", F.struct("modified", "name")).alias("run"))
    return sorted(r.run for r in newest.collect())


def parse_run_name(name) -> dict:
    """Timestamp, setup, split, problem and model counts, kind from a run file name."""
    n = F.col(name) if isinstance(name, str) else name
    g = lambda i: F.regexp_extract(n, RUN_NAME_RE, i)
    ok = n.rlike(RUN_NAME_RE)
    return {"run_ts": F.when(ok, F.try_to_timestamp(g(1), F.lit("yyyyMMdd_HHmmss"))),
            "setup": F.when(ok, F.when(g(2) == "", F.lit(None)).otherwise(g(2))),
            "split": F.when(ok, g(3)),
            "n_problems": F.when(ok, g(4).try_cast("int")),
            "n_models": F.when(ok, g(5).try_cast("int")),
            "kind": F.when(ok, F.when(g(6) == "", F.lit(None)).otherwise(g(6)))}


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # ISO text with microseconds, as the log writes it
TS_READ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"  # isoformat() drops the fraction when it is zero
TRAIN_LOG_SCHEMA = ("step long, phase string, timestamp timestamp_ntz, reward double, kl double, "
                    "completion_length double, loss double, learning_rate double, reward_std double, "
                    "training_loss double, grad_norm double")
# Event-time operators (watermarks) need TIMESTAMP; the session runs in UTC, so reading the
# same text as TIMESTAMP keeps the wall-clock values.
TRAIN_LOG_STREAM_SCHEMA = TRAIN_LOG_SCHEMA.replace("timestamp_ntz", "timestamp")


def write_train_log(log: DataFrame, path: str) -> str:
    (log.write.mode("append").option("timestampFormat", TS_FORMAT)
        .option("timestampNTZFormat", TS_FORMAT).json(path))
    return path


def read_train_log(spark: SparkSession, path: str, schema: str = TRAIN_LOG_SCHEMA) -> DataFrame:
    """Step-metric JSON lines with a declared schema (absent metrics are null)."""
    return (spark.read.schema(schema).option("timestampFormat", TS_READ_FORMAT)
            .option("timestampNTZFormat", TS_READ_FORMAT).json(path))


def generation_samples(df: DataFrame, path: str | None = None, prompt_chars: int = 200,
                       generation_chars: int = 500) -> DataFrame:
    """Sample log rows: prompt cut to 200 and generation to 500 characters (appended as JSON)."""
    out = df.select("step", F.substring("prompt", 1, prompt_chars).alias("prompt"),
                    F.substring("generation", 1, generation_chars).alias("generation"),
                    "reward", "answer", "extracted")
    if path:
        out.write.mode("append").json(path)
    return out


def write_scored(rows: DataFrame, summary: DataFrame, meta: dict, path: str,
                 by=("setup",), key: str = "model") -> str:
    """Scored rows stay a table; one small summary document per setup (map model → summary)."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/results")
    value_cols = [c for c in summary.columns if c not in (*by, key)]
    doc = (summary.groupBy(*by)
                  .agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*value_cols))))
                       .alias("summary"))
                  .withColumn("metadata", F.lit(json.dumps(meta, sort_keys=True))))
    doc.write.mode("overwrite").json(f"{path}/summary")
    return path


def read_scored_summary(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Summary documents back to one row per (setup, model), typed by ``value_schema``."""
    doc = spark.read.schema(f"setup string, metadata string, summary map<string, struct<{value_schema}>>") \
        .json(f"{path}/summary")
    return doc.select("setup", F.explode("summary").alias("model", "s")).select("setup", "model", "s.*")


def write_by_setup(rows: DataFrame, path: str, writers: int = 16) -> str:
    """Rows as a table with one folder ``setup=S`` per setup.

    A task keeps up to ``writers`` files open, so that its rows are not sorted by
    setup (and spilled) first; row groups are small, as several are open at once.
    """
    spark, key = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, str(writers))
        rows.write.mode("overwrite").partitionBy("setup").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return path


MANIFEST_SCHEMA = "experiment_dir string, output_files map<string, string>, timestamp string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(setup, path) of every run that an experiment's manifest files list.

    A relative path is one under the folder of its manifest.
    """
    docs = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    rows = docs.select(F.col("_metadata.file_path").alias("manifest"), F.explode("output_files").alias("setup", "path"))
    folder = F.regexp_replace("manifest", "/[^/]*$", "/")
    return rows.select("setup", F.when(F.col("path").rlike("^(?:[a-z0-9]+:)?/"), F.col("path")).otherwise(F.concat(folder, "path")).alias("path"))


def read_experiment(spark: SparkSession, manifest: str | dict[str, str], reader=None) -> DataFrame:
    """The runs of an experiment in one scan, each row with the setup its file is listed under.

    ``manifest``: path of manifest files, or a dict setup -> path.  ``reader`` takes
    the list of paths (``spark.read.parquet`` by default); listed runs that are
    absent are skipped.  The list (one entry per setup) is all that the driver
    holds beside the scan's list of files; setups are attached by a broadcast join
    on the file's path.
    """
    if isinstance(manifest, dict):
        listed = list(manifest.items())
    else:
        listed = [(r.setup, r.path) for r in read_manifest(spark, manifest).collect()]
    jvm_fs = spark._jvm.org.apache.hadoop.fs  # existence check through the cluster file system
    conf = spark._jsc.hadoopConfiguration()
    there = []
    for setup, p in listed:
        hp = jvm_fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.exists(hp):
            there.append((setup, fs.makeQualified(hp).toUri().getPath()))
    if not there:
        raise FileNotFoundError("no run of the manifest exists")
    rows = (reader or (lambda paths: spark.read.option("mergeSchema", True).parquet(*paths)))([p for _, p in there])
    # The entry whose path is the file's own or that of a folder above it; the longest one.  Files are as many as
    # the scan's own listing on the driver holds, so their setups are broadcast and no row of a run is shuffled.
    rows = rows.drop("setup").withColumn("_file", F.col("_metadata.file_path"))
    at = F.regexp_replace(F.url_decode(F.regexp_replace("_file", r"\+", "%2B")), "^[a-zA-Z0-9]+:/*", "/")
    parts = F.split(at, "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    files = rows.select("_file").distinct().select("_file", F.explode(above).alias("entry"))
    entries = F.broadcast(spark.createDataFrame(there, "setup string, entry string"))
    owner = files.join(entries, "entry").groupBy("_file").agg(F.max_by("setup", F.length("entry")).alias("setup"))
    return rows.join(F.broadcast(owner), "_file").drop("_file")
