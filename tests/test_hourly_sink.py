"""The hourly JSON sink of the named query against the table that it is given."""

from collections import Counter

from pyspark.sql import functions as F

from watchloom.plans import QUERIES, storage
from watchloom.sources import given as G


def test_the_whole_table_is_written(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_path", lambda _, name: str(tmp_path / name))
    QUERIES["sink_hourly_json"](spark, sf_dir).collect()
    read = spark.read.schema("uid string, log_type string, hour string").json(str(tmp_path / "hourly"))
    hour = F.date_format("ts", "yyyy-MM-dd-HH").alias("hour")
    want = G.sensor_conn(spark, sf_dir).select("uid", F.col("service").alias("log_type"), hour)
    assert Counter(map(tuple, read.collect())) == Counter(map(tuple, want.collect()))
