"""Session settings, tables of a data folder, and cutting of lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """Make checkpoint() usable.

    The folder named by ``spark.checkpoint.dir`` is taken from the session. Only
    where neither that nor a checkpoint folder is set (tests on one machine) a
    temporary one is made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints"))


#: Removes a plan's shuffle files once it has run; Spark reads it when the plan is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder.

    Nothing goes back to what came before, so its shuffle files are removed at once.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(True)
    finally:
        spark.conf.set(_CLEANUP, before)


def small(df: DataFrame, most: int = 1 << 16) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows; otherwise the planner chooses."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of few files, dealt to all cores.

    A file with one row group is read by a single task however large it is, and
    so is everything done to its rows up to the next shuffle. Tables of many files
    stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
