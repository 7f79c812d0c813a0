"""Session settings the operators are written for."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a crowded join key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("soundings")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SOUNDINGS_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and written stages.

    The cluster names it in ``spark.checkpoint.dir``.  Only on a local master (tests on
    one machine) may that be unset; a temporary folder is then made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark.sparkContext, "_soundings_folder", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="soundings-")
            spark.sparkContext._soundings_folder = folder
    return folder


def stage_path(spark: SparkSession, name: str) -> str:
    """Where a stage of this application goes; one folder per application, easy to remove."""
    return f"{shared_folder(spark).rstrip('/')}/stages/{spark.sparkContext.applicationId}/{name}"


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then start from files: a lost executor costs a re-read, not a re-run, a
    table read several times is computed once, and its size on disk lets Spark judge
    whether a join may broadcast it.
    """
    spark = df.sparkSession
    path = stage_path(spark, uuid.uuid4().hex)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` has written for this application.

    Call it when no DataFrame built on such a stage is needed any more, as at the end of a run.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_path(spark, ""))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
