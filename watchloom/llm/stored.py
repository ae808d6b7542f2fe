"""Steps of a job, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str, *partitions: str) -> str:
    """Writes a step and returns its path.

    The shuffle files of the step are of no use once it is written; Spark is told
    to remove them at its end.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.partitionBy(*partitions).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a step and reads it back, so that a lost executor costs no more than one step."""
    return frame.sparkSession.read.schema(frame.schema).parquet(written(frame, name))


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes steps that later ones, already written, have replaced."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
