"""Table writers: evolving append, routing, quarantine, vectors, files.

A batch is written below ``batch_id=<n>`` and replaces what an earlier, broken
attempt at the same batch left there, so a replay adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.functions.expressions import truncate
from watchloom.operators import event_rules as R
from watchloom.operators import sensor as SN
from watchloom.operators.basics import union_all
from watchloom.operators.vectors import embed_documents


@contextmanager
def kept(df: DataFrame) -> Iterator[None]:
    """Holds a frame that is written to several places, unless the caller already does.

    On the executors' disks only: kept messages would fill the heap that tasks need, with
    arrays of megabytes that the collector does not move.
    """
    if df.is_cached:
        yield
        return
    df.persist(StorageLevel.DISK_ONLY)
    try:
        yield
    finally:
        df.unpersist()


def write_batch(df: DataFrame, table_path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written_batches(spark: SparkSession, table_path: str) -> list[int]:
    """Ids of the batches that were written to their end, ascending."""
    files, where = _file_system(spark, f"{table_path}/batch_id=*/_SUCCESS")
    found = files.globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


class KeyedTable:
    """A stored table of one current row per key, fed by batches of changed rows.

    A batch is written once, as it comes, to ``changes/batch_id=<n>``. Every
    ``fold_every`` batches the rows in force are written to ``folded/batch_id=<n>``, so
    that a reader merges one folded table with a few batches of changes; what
    the fold before last needed is deleted then. A batch that is run again
    overwrites its own folder and folds from the same input. A row whose
    ``gone`` column is true deletes its key. Rows of a key are merged by partial aggregation, so a key
    that changes in every batch is not hot.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], gone: str | None = None, fold_every: int = 20):
        self.spark, self.path, self.keys, self.gone, self.fold_every = spark, path, keys, gone, fold_every
        self.changes, self.folded = f"{path}/changes", f"{path}/folded"

    def upsert(self, changed: DataFrame, batch_id: int) -> None:
        """Puts in force the rows of a batch; it holds a key at most once."""
        write_batch(changed, self.changes, batch_id)
        if batch_id % self.fold_every == self.fold_every - 1:
            folds = [n for n in written_batches(self.spark, self.folded) if n < batch_id]
            write_batch(self._merged(folds[-1] if folds else None, batch_id, changed.schema), self.folded, batch_id)
            for old in folds[:-1]:
                delete(self.spark, f"{self.folded}/batch_id={old}")
            for old in written_batches(self.spark, self.changes):
                if folds and old <= folds[-1]:
                    delete(self.spark, f"{self.changes}/batch_id={old}")

    def read(self) -> DataFrame:
        """The rows in force."""
        folds = written_batches(self.spark, self.folded)
        batches = written_batches(self.spark, self.changes)
        schema = self.spark.read.parquet(f"{self.changes}/batch_id={batches[-1]}").schema
        merged = self._merged(folds[-1] if folds else None, batches[-1], schema)
        return merged.filter(~F.col(self.gone)).drop(self.gone) if self.gone else merged

    def _merged(self, fold: int | None, last: int, schema) -> DataFrame:
        parts = [f"{self.changes}/batch_id={n}" for n in written_batches(self.spark, self.changes)
                 if (fold is None or n > fold) and n <= last]
        if fold is not None:
            parts.append(f"{self.folded}/batch_id={fold}")
        number = F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)/[^/]*$", 1).cast("bigint")
        rows = self.spark.read.schema(schema).parquet(*parts).withColumn("_batch", number)
        values = [c for c in schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*schema.names)


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    """Stored table; columns that appeared in later batches are null before."""
    return spark.read.option("mergeSchema", "true").parquet(table_path).drop("batch_id")


def clean_name(log_type: str, prefix: str = "") -> str:
    return prefix + log_type.replace("-", "_").replace(".", "_")


def _without_document(judged: DataFrame) -> DataFrame:
    """A batch as it is kept: a parsed document takes many times the room of its text, so rows that
    are stored are parsed once more. A frame that the caller keeps, or that has no text, stays as it is."""
    return judged if judged.is_cached or "value" not in judged.columns else judged.drop("doc")


def route_events(
    judged: DataFrame, root: str, batch_id: int, prefix: str = "", keep: tuple[str, ...] = ()
) -> None:
    """One table per event class. The judged batch is kept while it is written out,
    so that rules run once and not once per table."""
    light = _without_document(judged)
    with kept(light):
        for class_uid, name in V.STORED_CLASSES.items():
            rows = light.filter((F.col("status") == "SUCCESS") & (F.col("class_uid") == class_uid))
            table = R.event_table(rows if "doc" in light.columns else R.parsed_again(rows), class_uid, keep)
            write_batch(table, f"{root}/{R.table_name(name, prefix)}", batch_id)


def route_sensor(
    judged: DataFrame, root: str, batch_id: int, prefix: str = "", keep: tuple[str, ...] = ()
) -> None:
    """One table per sensor log type."""
    light = _without_document(judged)
    with kept(light):
        seen = [r[0] for r in light.filter("status = 'SUCCESS'").select("kind").distinct().collect()]
        for log_type in seen:  # at most nine
            rows = light.filter((F.col("status") == "SUCCESS") & (F.col("kind") == log_type))
            table = SN.sensor_table(rows if "doc" in light.columns else SN.parsed_again(rows), log_type, keep)
            write_batch(table, f"{root}/{clean_name(log_type, prefix)}", batch_id)


def dead_letters(judged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages that were not stored, as they came, with the reason."""
    return judged.filter(F.col("status") != "SUCCESS").select(*keep, "value", "kind", "status", "reason")


def union_of_tables(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """The given columns of all event tables below ``root``."""
    return union_all(
        [
            read_table(spark, f"{root}/{table}").select(*columns, F.lit(table).alias("table_name"))
            for table in map(R.table_name, V.STORED_CLASSES.values())
        ]
    )


def append_evolving(df: DataFrame, path: str) -> None:
    """Appends; new top-level columns become part of the table for readers that merge schemas."""
    df.write.mode("append").parquet(path)


def vector_rows(df: DataFrame, document: Column | str, **embedding) -> DataFrame:
    """(id, document, embedding); the id is a hash of the text, so a replay gives the same row."""
    docs = df.select((F.col(document) if isinstance(document, str) else document).alias("document"))
    return embed_documents(docs, **embedding).select(
        F.sha2("document", 256).alias("id"), "document", "embedding"
    )


def write_hourly_json(df: DataFrame, path: str, time_col: str = "ts", type_col: str = "log_type") -> None:
    """JSON files in one folder per log type and hour."""
    hour = F.date_format(truncate("hour", time_col), "yyyy-MM-dd-HH")
    # Gathers the rows of a folder into few files; a folder with many rows gets several tasks.
    gathered = df.withColumn("hour", hour).hint("rebalance", type_col, "hour")
    gathered.write.partitionBy(type_col, "hour").json(path)


def finding_report(findings: DataFrame) -> DataFrame:
    """One text report per finding (column ``value``) in four sections.

    The later sections come from the columns ``documents``, ``pattern_summary``, ``confidence`` (context), ``business_impact``,
    ``recommended_actions`` (analysis) and ``generated_at``, as far as the frame has them; a stage without a value is left open.
    """

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in findings.columns else F.lit(None).cast(kind)

    def line(label: str, value: Column, default: str = "Unknown") -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(default)))

    confidence = F.format_string("%.1f%%", F.coalesce(given("confidence_score", "double"), F.lit(0.0)) * 100)
    actions = F.coalesce(given("recommended_actions", "array<string>"), F.array().cast("array<string>"))
    numbered = F.array_join(F.transform(actions, lambda a, k: F.concat((k + 1).cast("string"), F.lit(". "), a)), "\n")
    stages = [F.col("priority").isNotNull(), given("documents", "bigint").isNotNull(), given("business_impact", "string").isNotNull()]
    done = sum((s.cast("int") for s in stages), F.lit(0))
    whole = done == len(stages)
    return findings.select(
        F.concat_ws(
            "\n",
            F.lit("SOC SECURITY ANALYSIS REPORT"),
            line("Generated", given("generated_at", "string")),
            line("Status", F.when(whole, "Complete").otherwise("Partial")),
            F.lit("\n=== THREAT ASSESSMENT ==="),
            line("Priority", F.upper("priority")),
            line("Threat Type", F.col("threat_type")),
            line("Source IP", F.col("source_ip")),
            line("Confidence", confidence),
            line("Summary", F.col("brief_summary"), "None"),
            F.lit("\n=== HISTORICAL CONTEXT ==="),
            line("Documents Analyzed", given("documents", "string"), "0"),
            line("Pattern Analysis", given("pattern_summary", "string"), "None"),
            line("Confidence", given("confidence", "string"), "Medium"),
            F.lit("\n=== RECOMMENDATIONS ==="),
            line("Business Impact", given("business_impact", "string"), "None specified"),
            F.lit("Recommended Actions:"),
            F.when(F.size(actions) > 0, numbered).otherwise("None"),
            F.lit("\n=== ANALYSIS METADATA ==="),
            line("Completed Stages", done.cast("string")),
            line("Full Analysis", F.when(whole, "Yes").otherwise("No")),
        ).alias("value")
    )


def export_findings(findings: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt == "json":
        findings.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    elif fmt == "text":
        finding_report(findings).write.option("lineSep", "\n\n").text(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
