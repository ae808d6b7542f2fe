"""File readers: log lines, stored tables, delimited text, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\x01"  # field separator of plain text tables


PART_BYTES = 8 << 20  # of a Parquet file that is dealt out, per part
GROUPS_PER_CORE = 4  # so many row groups of like size keep all cores busy


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where the input has fewer files than these, before work that is dear per row.

    A row group is read by one task, whatever the split size. A table of many files
    or row groups is left as it is; a large one of few is dealt to parts of bounded size.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    paths = df.inputFiles()
    if len(paths) >= cores:
        return df
    groups, size = _extent(spark, paths)
    return df if groups >= GROUPS_PER_CORE * cores else df.repartition(max(cores, -(-size // PART_BYTES)))


def _extent(spark: SparkSession, paths: Sequence[str]) -> tuple[int, int]:
    """Row groups and bytes of the Parquet files among the paths, by their footers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups = size = 0
    for path in paths:
        if not path.endswith(".parquet"):
            continue
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)), conf)
        footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            groups, size = groups + footer.getRowGroups().size(), size + file.getLength()
        finally:
            footer.close()
    return groups, size


def log_file(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, one row each (column ``value``)."""
    return spark.read.text(path)


def stored_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = ("*",),
    newest_first: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Scan with projection, order and limit. Columns added later are merged in."""
    df = spark.read.option("mergeSchema", "true").parquet(path).select(*columns)
    if newest_first:
        df = df.orderBy(F.desc(newest_first))
    return df.limit(limit) if limit else df


def text_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited text files under one folder, read with a declared schema."""
    return spark.read.schema(schema).option("sep", SEPARATOR).csv(path)


def write_text_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("sep", SEPARATOR).csv(path)


def vector_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
