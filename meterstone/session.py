"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("meterstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python call site of every expression costs more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only in local mode and only where the setting is absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = getattr(spark, "_meterstone_scratch", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = tempfile.mkdtemp(prefix="meterstone-")
    spark._meterstone_scratch = known
    return known


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created or reused."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def _paths(spark: SparkSession) -> list[str]:
    """What this application has written to; sessions of one application share the list."""
    context = spark.sparkContext
    if not hasattr(context, "_meterstone_paths"):
        context._meterstone_paths = []
    return context._meterstone_paths


def clean_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Frames that still read them can't be used afterwards.

    The written staging and mart layer stays, since it is kept for other sessions.
    """
    paths = _paths(spark)
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def through_table(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table that survives the loss of an executor."""
    spark = df.sparkSession
    path = new_scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
