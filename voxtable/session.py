"""Session helpers: a local session for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A small local session; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxtable")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is named, a temporary one, and only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="voxtable-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def once(df: DataFrame) -> DataFrame:
    """df whose columns are worked out once per row: later filters on them stay above, Spark would work them out again below."""
    return df.withColumn("_once", F.monotonically_increasing_id()).filter("_once >= 0").drop("_once")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the driver and all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
