"""Table summary and health of pipeline runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.expressions import as_datetime, time_literal
from watchloom.operators.basics import union_all

RUN_RESULT_SCHEMA = (
    "result_id string, invocation_id string, unique_id string, database_name string, "
    "schema_name string, table_name string, resource_type string, status string, "
    "execution_time double, rows_affected bigint, bytes_processed bigint, created_at timestamp"
)
FAILED = ["error", "fail"]


def _recent(runs: DataFrame, as_of, days: int) -> Column:
    """From midnight of the day ``days`` before the as-of day."""
    start = datetime.combine(as_datetime(as_of).date(), datetime.min.time()) - timedelta(days=days)
    return F.col("created_at") >= time_literal(runs, "created_at", start)


def _ok(column: str = "status") -> Column:
    return F.col(column) == "success"


def table_summary(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and newest time of each table; one aggregated row per scan."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("total_records"), F.max(time_col).alias("last_updated")).select(
                F.lit(name).alias("table_name"), "total_records", "last_updated"
            )
            for name, (df, time_col) in tables.items()
        ]
    )


def run_stats(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    return (
        runs.filter(_recent(runs, as_of, days))
        .groupBy(F.to_date("created_at").alias("run_date"), "invocation_id", "resource_type", "status")
        .agg(
            F.count(F.lit(1)).alias("resource_count"),
            F.sum("execution_time").alias("total_execution_time"),
            F.avg("execution_time").alias("avg_execution_time"),
            F.max("execution_time").alias("max_execution_time"),
            F.sum("rows_affected").alias("total_rows_affected"),
        )
    )


def daily_summary(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    resources = F.col("resource_count")
    return (
        run_stats(runs, as_of, days)
        .groupBy("run_date")
        .agg(
            F.countDistinct("invocation_id").alias("total_runs"),
            F.sum(F.when(_ok(), resources).otherwise(0)).alias("successful_resources"),
            F.sum(F.when(F.col("status").isin(FAILED), resources).otherwise(0)).alias("failed_resources"),
            F.sum(resources).alias("total_resources"),
            F.avg("total_execution_time").alias("avg_run_duration"),
            F.sum("total_rows_affected").alias("daily_rows_processed"),
        )
    )


def performance_trends(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    return (
        runs.filter(_recent(runs, as_of, days))
        .groupBy("table_name", "resource_type")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.avg("execution_time").alias("avg_execution_time"),
            F.stddev_samp("execution_time").alias("execution_time_stddev"),
            F.min("execution_time").alias("min_execution_time"),
            F.max("execution_time").alias("max_execution_time"),
            F.count_if(_ok()).alias("success_count"),
            F.count_if(F.col("status").isin(FAILED)).alias("failure_count"),
        )
    )


def run_analysis(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Daily summary and performance trends in one long table."""
    daily = daily_summary(runs, as_of, days).select(
        F.lit("daily_summary").alias("metric_type"),
        F.col("run_date").cast("string").alias("dimension_1"),
        F.lit(None).cast("string").alias("dimension_2"),
        F.col("total_runs").cast("double").alias("metric_value_1"),
        F.col("successful_resources").alias("metric_value_2"),
        F.col("failed_resources").alias("metric_value_3"),
        F.col("avg_run_duration").alias("metric_value_4"),
    )
    trends = (
        performance_trends(runs, as_of, days)
        .filter("run_count > 1")
        .select(
            F.lit("performance_trends").alias("metric_type"),
            F.col("table_name").alias("dimension_1"),
            F.col("resource_type").alias("dimension_2"),
            F.col("avg_execution_time").alias("metric_value_1"),
            F.col("success_count").alias("metric_value_2"),
            F.col("failure_count").alias("metric_value_3"),
            F.col("run_count").cast("double").alias("metric_value_4"),
        )
    )
    return daily.unionByName(trends)


def slowest_models(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    return (
        runs.filter((F.col("resource_type") == "model") & _ok() & _recent(runs, as_of, days))
        .groupBy("table_name")
        .agg(
            F.avg("execution_time").alias("avg_execution_time"),
            F.max("execution_time").alias("max_execution_time"),
            F.count(F.lit(1)).alias("run_count"),
        )
        .orderBy(F.desc("avg_execution_time"), "table_name")
    )


def failing_resources(runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    return (
        runs.filter(F.col("status").isin(FAILED) & _recent(runs, as_of, days))
        .groupBy("resource_type", "table_name", "status")
        .agg(F.count(F.lit(1)).alias("failure_count"), F.max("created_at").alias("last_failure"))
        .orderBy(F.desc("failure_count"), "resource_type", "table_name", "status")
    )


def test_coverage(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    is_test = F.col("resource_type") == "test"
    return (
        runs.filter(_recent(runs, as_of, days))
        .groupBy(F.to_date("created_at").alias("run_date"))
        .agg(
            F.count_if(is_test).alias("tests_run"),
            F.count_if(is_test & _ok()).alias("tests_passed"),
            F.count_if(F.col("resource_type") == "model").alias("models_run"),
        )
        .orderBy(F.desc("run_date"))
    )


def data_volume(runs: DataFrame, as_of, days: int = 30) -> DataFrame:
    return (
        runs.filter((F.col("resource_type") == "model") & _ok() & _recent(runs, as_of, days))
        .groupBy("table_name", F.to_date("created_at").alias("run_date"))
        .agg(F.sum("rows_affected").alias("total_rows"), F.sum("bytes_processed").alias("total_bytes"))
        .orderBy(F.desc("run_date"), F.desc("total_rows"), "table_name")
    )


# --- run records -----------------------------------------------------------------


def empty_run_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RUN_RESULT_SCHEMA)


def as_run_results(records: DataFrame) -> DataFrame:
    """Casts records to the run-result table; missing counts are 0, missing texts null."""
    empty = empty_run_results(records.sparkSession)
    have = set(records.columns)
    columns = []
    for field in empty.schema.fields:
        if field.name == "result_id":
            continue
        value = F.col(field.name) if field.name in have else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in ("rows_affected", "bytes_processed"):
            value = F.coalesce(value, F.lit(0).cast("bigint"))
        columns.append(value.alias(field.name))
    cast = records.select(*columns).withColumn(
        "result_id", F.concat_ws(".", "invocation_id", "unique_id")
    )
    return empty.unionByName(cast.select(*empty.columns))


def append_run_results(records: DataFrame, path: str) -> None:
    as_run_results(records).write.mode("append").parquet(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Full rebuild of a stored model; returns the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_counted(df: DataFrame, path: str) -> int:
    """Full rebuild of a stored model; its rows are counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def run_models(
    spark: SparkSession, models: Mapping[str, Callable[[], DataFrame]], root: str, results_path: str
) -> dict[str, str]:
    """One invocation over several models, stored below ``root``; a broken one does not keep the others from being built.

    Gives the error text of each model that failed.
    """
    invocation, failed = uuid.uuid4().hex, {}
    for name, build in models.items():
        try:
            run_model(spark, name, build, f"{root}/{name}", results_path, invocation)
        except Exception as error:  # noqa: BLE001 - recorded, and told to the caller
            failed[name] = str(error)
    return failed


def run_model(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], path: str, results_path: str,
    invocation: str | None = None,
) -> None:
    """Builds one model, stores it in one pass and appends how that went."""
    started, clock, status, rows = datetime.now(timezone.utc), time.monotonic(), "success", 0
    try:
        rows = materialize_counted(build(), path)
    except Exception:
        status = "error"
        raise
    finally:
        record = {
            "invocation_id": invocation or uuid.uuid4().hex,
            "unique_id": f"model.{name}",
            "table_name": name,
            "resource_type": "model",
            "status": status,
            "execution_time": time.monotonic() - clock,
            "rows_affected": rows,
            "created_at": started.replace(tzinfo=None).isoformat(sep=" "),
        }
        append_run_results(
            spark.createDataFrame(
                [tuple(record.values())],
                "invocation_id string, unique_id string, table_name string, resource_type string, "
                "status string, execution_time double, rows_affected bigint, created_at string",
            ),
            results_path,
        )
