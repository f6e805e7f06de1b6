"""Session building and the one shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: shuffle partitions that a stage starts with on a cluster, before AQE joins small ones
CLUSTER_PARTITIONS = 8192


def get_spark(app_name: str = "parcelwise", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps, AQE and the web page off.

    Partition counts are left to AQE: on a cluster a large initial number, which
    is coalesced to what each stage really holds; locally Spark's default. Pass
    ``conf`` (dots as double underscores) to override anything.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # tables bucketed by order are joined on order and row without a shuffle
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if not spark.sparkContext.master.startswith("local") and spark.conf.get(initial, None) is None:
        spark.conf.set(initial, str(CLUSTER_PARTITIONS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only.

    Every executor must see this folder, so outside local mode a missing setting
    is an error rather than a silent fall-back to a machine-local path.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="parcelwise-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A per-application path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/parcelwise/{spark.sparkContext.applicationId}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: made once, whatever reads it, and not lost with an executor."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written inside removes its shuffle files when it ends, instead of when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> bool:
    """Whether ``df`` only reads, cuts and computes rows of files: then it is read again rather than kept."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation"


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
