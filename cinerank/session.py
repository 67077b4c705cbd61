"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; keyword confs are added as given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of every column expression slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local-mode session without that setting gets a temporary folder:
    on a cluster a machine-local path is invisible to the other executors.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and fixes values that
    depend on where a row happened to be (partition numbers, row positions).
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a small input before work that is heavy per row.

    A file smaller than one read split lands in one task.  The plan's size says
    when that is so; larger inputs have enough splits and are left alone.
    """
    context = df.sparkSession.sparkContext
    split = 16 * 1024 * 1024
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > split * context.defaultParallelism:
        return df
    return df.repartition(context.defaultParallelism, *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative training checkpoint into the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(spark))


def drop_shuffle_files(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and blocks that no plan refers to any more.

    It does so when the driver collects garbage, which one with free memory puts off while the disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
