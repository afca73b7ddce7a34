"""Session construction and shared-folder helpers.

Everything that writes intermediate data (checkpoints, sinks used by the
registered queries, streaming checkpoints) goes under the folder the cluster
names in ``spark.checkpoint.dir``.  Only when that is unset *and* the session
runs in local mode (tests, bench) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "scorelab",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings this library is tuned for.

    AQE stays on: it coalesces small shuffles, switches joins to broadcast
    only when the *measured* side is under the threshold, and splits skewed
    join partitions.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCORELAB_DRIVER_MEM", "4g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (created only in local mode)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scorelab-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


_WRITTEN: list[str] = []  # scratch paths handed out by this driver


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (see ``release_scratch``)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Remove everything written under paths handed out so far; returns how many existed.

    For the caller to run once no result built on such tables is read any more.
    Works through the Hadoop file system, wherever the shared folder is.
    """
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(p.getFileSystem(conf).delete(p, True))
    return gone


def is_materialised(df: DataFrame) -> bool:
    """True when the plan is already a checkpointed RDD scan (nothing left to cut)."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRDD"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss.

    Idempotent: a DataFrame that already is a checkpoint is returned as is.
    """
    if is_materialised(df):
        return df
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing a Parquet table under the shared folder and reading it back.

    For wide, data-sized intermediates: columnar and compressed (repeated values
    such as one generation's code on each of its test rows are dictionary
    encoded), and each reader scans only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
