"""Structured Streaming jobs over growing files.

The reference's stream-like parts are files that grow (appended run files and
JSON-lines logs).  Here they are file sources with declared schemas, with a
checkpoint in the shared folder so a restarted job resumes where it stopped.
``availableNow`` drains what is there and stops (batch-like, restartable).
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import with_extraction
from ..operators.metrics import rate
from ..sources.runs import GZIP

GENERATION_EVENT_SCHEMA = ("setup string, model string, problem_id bigint, api_success boolean, "
                           "model_output string, completion_tokens int, total_tokens int, "
                           "total_time double, generated_at timestamp")


KEYS = ["setup", "model", "problem_id"]
LOG_METRICS = ("reward", "kl", "completion_length")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _stream_settings(spark: SparkSession, **extra):
    """Settings a query takes along when it starts: state on the executors' disks (RocksDB), unless the session names a store.

    Every batch's progress is kept, so that totals over a whole run can be told.
    """
    want = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.numRecentProgressUpdates": "100000", **extra}
    before = {k: spark.conf.get(k, None) for k in want}
    own = [k for k in want if k.endswith("providerClass") and before[k] and "HDFSBacked" not in before[k]]
    try:
        for k in want.keys() - own:
            spark.conf.set(k, want[k])
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drain(writer, ckpt: str) -> list:
    """Run a query over what is there; the progress of its batches."""
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def _plain_path(uri: str) -> str:
    """A file's ``_metadata.file_path`` as a path to read: decoded, pattern characters escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))


def deliver(rows: DataFrame, src: str, rows_per_file: int = 25_000) -> None:
    """Add generation rows to a folder of gzipped JSON-lines files, each small enough for one task to read."""
    rows.write.mode("append").options(**GZIP).option("maxRecordsPerFile", rows_per_file).json(src)


def score_stream(spark: SparkSession, src: str, out: str, ckpt: str,
                 schema: str = GENERATION_EVENT_SCHEMA, max_files: int = 1000, max_keys: int = 300_000) -> None:
    """Extract answers from generation rows as files land; one result per (setup, model, problem).

    The query's state holds one narrow row per key: when it was first and last
    delivered, how often, and the first of its rows (by generated_at, then by a hash
    of the whole row) with its file.  A key whose first and last delivery are this
    batch is new, however late; a repeat is not, however old.  New keys' rows are read
    from the batch's own files (at most ``max_files``), so a batch's work does not grow
    with what was answered before, and a batch that is run again keeps the same rows.

    The files are read in groups that hold the first rows of at most ``max_keys`` keys:
    a group's keys are broadcast, so that the wide rows stay in the tasks that read
    them.  Only a single file with more keys than that is joined by a shuffle, and
    only keys delivered more than once in the batch are checked for copies of a row.
    Batches are folders ``batch=N`` of ``out``; a repeated batch replaces its own.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(src)
    columns = stream.columns
    first = F.struct(F.col("generated_at"), F.xxhash64(*columns).alias("hash"), F.col("_metadata.file_path").alias("file"))
    now = F.current_timestamp()
    keys = stream.select(*KEYS, first.alias("first"), now.alias("now")).groupBy(*KEYS).agg(
        F.min("first").alias("first"), F.min("now").alias("since"), F.max("now").alias("until"), F.count("*").alias("n"))

    def found(new: DataFrame, group: list, small: bool) -> DataFrame:
        """The first rows of the keys whose file is in the group."""
        rows = spark.read.schema(schema).json([_plain_path(r.file) for r in group]).select("*", F.xxhash64(*columns).alias("_hash"))
        own = new.filter(F.col("file").isin([r.file for r in group])).select(
            *[F.col(k).alias(f"_{k}") for k in KEYS], "hash", "n")
        match = [rows[k].eqNullSafe(own[f"_{k}"]) for k in KEYS]
        got = rows.join(F.broadcast(own) if small else own, reduce(lambda a, b: a & b, match, rows["_hash"] == own["hash"])).select(*columns, "n")
        if max(r.n for r in group) == 1:
            return got.drop("n")
        # What is left of a key are copies of one row.
        return got.filter("n = 1").drop("n").unionByName(got.filter("n > 1").drop("n").dropDuplicates(KEYS))

    def add(batch: DataFrame, epoch: int) -> None:
        new = batch.filter("since = until").select(*KEYS, "first.hash", "first.file", "n").persist()
        files = new.groupBy("file").agg(F.count("*").alias("keys"), F.max("n").alias("n")).orderBy("file").collect()
        groups, room = [], 0
        for r in files:
            if r.keys > room:
                groups, room = [*groups, []], max_keys
            groups[-1].append(r)
            room -= r.keys
        parts = [found(new, group, sum(r.keys for r in group) <= max_keys) for group in groups]
        for k, part in enumerate(parts or [spark.createDataFrame([], stream.schema)]):
            with_extraction(part).write.mode("append" if k else "overwrite").option("compression", "zstd").parquet(f"{out}/batch={epoch}")
        new.unpersist()

    with _stream_settings(spark):
        _drain(keys.writeStream.outputMode("update").foreachBatch(add), ckpt)


def log_windows(stream: DataFrame, window: str = "1 day", slide: str | None = None,
                delay: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """Mean reward / kl / completion length per event-time window and phase.

    Rows later than the watermark are dropped; a window is emitted (append
    mode) once the watermark passes its end.  With ``slide`` windows overlap and
    a row counts in each that holds it.
    """
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (stream.withWatermark(ts, delay).groupBy(w.alias("w"), "phase")
                  .agg(F.count("*").alias("n_steps"), *[F.avg(m).alias(f"{m}_mean") for m in LOG_METRICS])
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "phase", "n_steps", *[f"{m}_mean" for m in LOG_METRICS]))


def _log_reader(reader, schema: str):
    return reader.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")


def run_log_windows(spark: SparkSession, src: str, out: str, ckpt: str, schema: str, max_files: int = 1000, **kw) -> dict:
    """Emit the windows that the log's watermark has passed; how many rows were read and dropped as late.

    ``late`` is the state operator's own figure: rows of the tasks' partial
    aggregates (one per task, window and phase) that came after the watermark.
    """
    reader = _log_reader(spark.readStream, schema).option("maxFilesPerTrigger", max_files)
    with _stream_settings(spark):
        done = _drain(log_windows(reader.json(src), **kw).writeStream.format("parquet").option("path", out).outputMode("append"), ckpt)
    return {"read": sum(p.numInputRows for p in done),
            "late": sum(o.numRowsDroppedByWatermark for p in done for o in p.stateOperators)}


def open_log_windows(spark: SparkSession, ckpt: str) -> DataFrame:
    """Windows the stream still holds back, read from its state store.

    A state row's value is the aggregation's buffers in order: the count, then sum
    and count of every mean.
    """
    state = spark.read.format("statestore").load(ckpt)
    # The buffers' own names repeat (sum, count, sum, ...); a cast of the struct renames by place.
    buffers = ", ".join(["n_steps: bigint", *[f"{m}_sum: double, {m}_n: bigint" for m in LOG_METRICS]])
    key, value = F.col("key").cast("struct<w: struct<start: timestamp, end: timestamp>, phase: string>"), F.col("value").cast(f"struct<{buffers}>")
    rows = state.select(key.alias("k"), value.alias("v"))
    return rows.select(F.col("k.w.start").alias("window_start"), F.col("k.w.end").alias("window_end"), "k.phase", "v.n_steps",
                       *[F.try_divide(f"v.{m}_sum", f"v.{m}_n").alias(f"{m}_mean") for m in LOG_METRICS])


def close_log_windows(spark: SparkSession, out: str, ckpt: str) -> DataFrame:
    """All windows of a log that has ended: those the stream emitted and those still open in its state.

    The log itself is not read again.
    """
    return spark.read.schema(log_window_schema()).parquet(out).unionByName(open_log_windows(spark, ckpt))


def log_window_schema() -> str:
    return "window_start timestamp, window_end timestamp, phase string, n_steps bigint, " + ", ".join(f"{m}_mean double" for m in LOG_METRICS)


def summary_stream(stream: DataFrame, by=("setup", "model")) -> DataFrame:
    """Running per-run summary (a small table: one row per setup and model)."""
    return stream.groupBy(*by).agg(F.count("*").alias("n_outputs"),
                                   rate(F.col("api_success")).alias("api_success_rate"),
                                   rate(F.col("code_found")).alias("code_extraction_rate"),
                                   rate(F.col("thinking_found")).alias("thinking_extraction_rate"))


def run_summary_stream(spark: SparkSession, src: str, out: str, ckpt: str, schema: str, max_files: int = 1000, keep: int = 2) -> None:
    """Complete mode; every micro-batch writes a version (a folder ``v=N`` of ``out``) and then moves the pointer to it.

    The pointer is a small file replaced in one rename, so a reader finds a whole
    table at any time (``latest_summary``).  The newest ``keep`` versions stay, for
    readers that have opened one; older ones are removed.
    """
    scored = with_extraction(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(src))
    store = VersionedTable(spark, out)
    with _stream_settings(spark):
        _drain(summary_stream(scored).writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: store.put(batch, epoch, keep)), ckpt)


def latest_summary(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of a running summary; no other version is opened."""
    return VersionedTable(spark, out).read()


class VersionedTable:
    """Folders ``v=N`` under ``path`` and a pointer file naming the newest, through the Hadoop file system."""

    POINTER = "_newest"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jfs = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jfs.Path(f"{self.path}/{name}")

    def newest(self) -> int | None:
        """The version the pointer names."""
        fs = self._at(self.POINTER).getFileSystem(self.conf)
        if not fs.exists(self._at(self.POINTER)):
            return None
        pointer = fs.open(self._at(self.POINTER))
        try:
            return pointer.readInt()
        finally:
            pointer.close()

    def put(self, df: DataFrame, version: int, keep: int) -> None:
        """Write a version, point to it, remove those before the newest ``keep``.

        A version that is written again after a failure replaces its own folder; the
        pointer moves only once the folder is whole.
        """
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        fs = self._at(self.POINTER).getFileSystem(self.conf)
        new = self._at(f"{self.POINTER}.{version}")
        stream = fs.create(new, True)
        stream.writeInt(version)
        stream.close()
        rename = getattr(self.jfs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        # The scheme and authority of the table's own store.
        context = self.jfs.FileContext.getFileContext(fs.getUri(), self.conf)
        context.rename(context.makeQualified(new), context.makeQualified(self._at(self.POINTER)), how)
        for status in fs.listStatus(self.jfs.Path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v=") and int(name[2:]) <= version - keep:
                fs.delete(status.getPath(), True)

    def read(self) -> DataFrame:
        version = self.newest()
        if version is None:
            raise FileNotFoundError(f"no version of {self.path} is complete")
        return self.spark.read.parquet(f"{self.path}/v={version}")
