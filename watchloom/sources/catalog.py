"""Logical table names -> stored tables, and what is in them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENSOR_TABLES = ["weird", "known_hosts", "http", "conn", "analyzer", "ftp", "dns"]
EVENT_TABLES = ["file_system_activity", "authentication", "detection_finding"]


@dataclass(frozen=True)
class Location:
    """Root folder of the tables of one producer and the prefix of their names."""

    root: str
    prefix: str = ""

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{self.prefix}{table}"


def table_path(locations: Mapping[str, Location], table_type: str, table: str) -> str:
    """Path of a table; ``table_type`` is ``sensor`` or ``event``."""
    try:
        location = locations[table_type.lower()]
    except KeyError:
        raise ValueError(f"table type must be one of {sorted(locations)}") from None
    return location.path(table)


def declared_tables(locations: Mapping[str, Location]) -> dict[str, str]:
    """The ten tables of the table summary: logical name -> path."""
    tables = {f"sensor_{t}": table_path(locations, "sensor", t) for t in SENSOR_TABLES}
    return tables | {f"event_{t}": table_path(locations, "event", t) for t in EVENT_TABLES}


def register(spark: SparkSession, tables: Mapping[str, str]) -> None:
    """Makes stored tables known to SQL under their logical names."""
    for name, path in tables.items():
        spark.read.option("mergeSchema", "true").parquet(path).createOrReplaceTempView(name)


def describe(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table, column, position (from 1), type and number of filled rows; one counting pass per table."""
    rows = None
    for name, df in tables.items():
        filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot(
            [], df.columns, "column_name", "filled_rows"
        )
        places = F.create_map(*(F.lit(x) for n, c in enumerate(df.columns, 1) for x in (c, n)))
        types = F.create_map(*(F.lit(x) for pair in df.dtypes for x in pair))
        part = filled.select(
            F.lit(name).alias("table_name"), "column_name", places[F.col("column_name")].alias("position"),
            types[F.col("column_name")].alias("data_type"), "filled_rows",
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def sample_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """A few rows as JSON text, the same ones in every run: those of least hash."""
    return df.select(F.to_json(F.struct("*")).alias("row")).orderBy(F.xxhash64("row"), "row").limit(n)
