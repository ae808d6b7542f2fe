"""Streams: replay, schema growth, catalog, run records."""

import json

import pytest
from pyspark.sql import functions as F

from watchloom.operators import pipeline_runs as P
from watchloom.sinks import tables as K
from watchloom.sources import catalog, files, streams
from watchloom.streaming import jobs as J


def _write(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages) + "\n")


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    source, root, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    _write(source, "1.txt", [{"conn": {"uid": f"a{i}"}} for i in range(5)] + [{"notice": {}}])
    for _ in range(2):
        messages = streams.message_files(spark, str(source))
        J.start(J.ingest_sensor(messages, root), mark).awaitTermination()
        assert K.read_table(spark, f"{root}/tables/conn").count() == 5
    _write(source, "2.txt", [{"conn": {"uid": "b"}}, {"dns": {"query": "q"}}])
    J.start(J.ingest_sensor(streams.message_files(spark, str(source)), root), mark).awaitTermination()
    assert K.read_table(spark, f"{root}/tables/conn").count() == 6
    assert K.read_table(spark, f"{root}/tables/dns").count() == 1
    assert K.read_table(spark, f"{root}/dead_letters").select("kind").first()[0] == "notice"
    vectors = K.read_table(spark, f"{root}/vectors")
    assert vectors.count() == 7 and vectors.filter(F.length("id") == 64).count() == 7


def test_tail_buffer_over_batches(spark, tmp_path):
    source, root, mark = str(tmp_path / "in"), str(tmp_path / "tail"), str(tmp_path / "mark")
    layout = "topic string, msg_offset bigint"
    for start in (0, 60, 90):
        spark.range(start, start + 30).select(
            F.lit("t").alias("topic"), F.col("id").alias("msg_offset")
        ).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(layout).parquet(source)
        J.start(J.tail_buffer(stream, root, 50), mark).awaitTermination()
    stored = spark.read.parquet(root)
    last = stored.agg(F.max("batch_id")).first()[0]
    kept = [r["msg_offset"] for r in stored.filter(F.col("batch_id") == last).collect()]
    assert sorted(kept) == [*range(0, 30), *range(60, 120)][-50:]


def test_catalog(spark, tmp_path):
    locations = {"sensor": catalog.Location(str(tmp_path), "s_"), "event": catalog.Location(str(tmp_path), "e_")}
    tables = catalog.declared_tables(locations)
    assert len(tables) == 10 and tables["sensor_conn"] == f"{tmp_path}/s_conn"
    with pytest.raises(ValueError, match="table type"):
        catalog.table_path(locations, "other", "conn")
    spark.range(3).write.parquet(tables["sensor_conn"])
    catalog.register(spark, {"sensor_conn": tables["sensor_conn"]})
    assert spark.sql("select count(*) from sensor_conn").first()[0] == 3


def test_described_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = [tuple(r) for r in catalog.describe({"t": df, "none": df.limit(0)}).collect()]
    assert rows == [("t", "a", 1, "int", 2), ("t", "b", 2, "string", 1), ("none", "a", 1, "int", 0), ("none", "b", 2, "string", 0)]
    assert catalog.sample_rows(df).collect() == catalog.sample_rows(df.repartition(3)).collect()


def test_run_model_records_success_and_failure(spark, tmp_path):
    results = str(tmp_path / "results")
    P.run_model(spark, "numbers", lambda: spark.range(4), str(tmp_path / "m"), results)

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        P.run_model(spark, "broken", broken, str(tmp_path / "n"), results)
    rows = {r["table_name"]: r for r in spark.read.parquet(results).collect()}
    assert (rows["numbers"]["status"], rows["numbers"]["rows_affected"]) == ("success", 4)
    assert rows["broken"]["status"] == "error"
    assert rows["numbers"]["result_id"] == f"{rows['numbers']['invocation_id']}.model.numbers"
    assert rows["numbers"]["bytes_processed"] == 0
    assert spark.read.parquet(results).schema.simpleString() == P.empty_run_results(spark).schema.simpleString()


def test_one_invocation_over_several_models(spark, tmp_path):
    results = str(tmp_path / "results")
    models = {
        "a": lambda: spark.range(7), "broken": lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("x")),
        "none": lambda: spark.range(0), "b": lambda: spark.range(5),
    }
    failed = P.run_models(spark, models, str(tmp_path / "m"), results)
    rows = {r["table_name"]: r for r in spark.read.parquet(results).collect()}
    assert list(failed) == ["broken"] and len({r["invocation_id"] for r in rows.values()}) == 1
    assert {k: (r["status"], r["rows_affected"]) for k, r in rows.items()} == {
        "a": ("success", 7), "broken": ("error", 0), "none": ("success", 0), "b": ("success", 5)}
    assert spark.read.parquet(str(tmp_path / "m" / "b")).count() == 5


def test_export(spark, tmp_path):
    finding = spark.createDataFrame(
        [("high", "rdp login", "10.0.0.1", 0.75, "text")],
        "priority string, threat_type string, source_ip string, confidence_score double, brief_summary string",
    )
    K.export_findings(finding, str(tmp_path / "t"), "text")
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "t")).collect())
    assert "Priority: HIGH" in text and "Confidence: 75.0%" in text
    assert "Status: Partial" in text and "Documents Analyzed: 0" in text and "Recommended Actions:\nNone" in text
    whole = finding.select("*", F.lit(3).alias("documents"), F.lit("p").alias("pattern_summary"), F.lit("b").alias("business_impact"),
                           F.array(F.lit("do"), F.lit("so")).alias("recommended_actions"))
    text = K.finding_report(whole).first()[0]
    assert "Status: Complete" in text and "1. do\n2. so\n\n=== ANALYSIS METADATA ===\nCompleted Stages: 3\nFull Analysis: Yes" in text
    with pytest.raises(ValueError):
        K.export_findings(finding, str(tmp_path / "x"), "pdf")


def test_other_text_is_kept(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("plain",), ("",), (None,)], "value string")
    got = [r[0] for r in streams.with_data(df).select(F.to_json("data")).collect()]
    assert got == ['{"a":1}', '{"raw_message":"plain"}', "{}", "{}"]


def test_batches_are_kept_without_parsed_documents(spark, sf_dir, tmp_path, monkeypatch):
    """Kept documents took many times the room of the messages."""
    from watchloom.operators import sensor as SN
    from watchloom.sinks import tables as K

    rows = [('{"conn": {"uid": "C%d", "proto": "tcp", "orig_bytes": %d}}' % (k, k),) for k in range(20)] + [("{bad",)]
    judged = SN.judge_sensor(spark.createDataFrame(rows, "value string"))
    held = []
    first = K.kept
    monkeypatch.setattr(K, "kept", lambda df: held.append(df.columns) or first(df))
    K.route_sensor(judged, str(tmp_path), 0)
    assert held and all("doc" not in columns for columns in held)
    stored = K.read_table(spark, f"{tmp_path}/conn").select("uid", "proto", "orig_bytes").collect()
    assert sorted(map(tuple, stored)) == sorted((f"C{k}", "tcp", k) for k in range(20))


def test_kept_batches_take_no_heap(spark):
    """Kept in memory, the messages of a large batch filled the executors' heaps."""
    df = spark.range(10)
    with K.kept(df):
        assert df.count() == 10 and df.storageLevel.useDisk and not df.storageLevel.useMemory
    assert not df.is_cached


def test_a_batch_is_bounded_by_bytes(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    for n in range(3):
        _write(source, f"{n}.txt", [{"conn": {"uid": f"{n}-{i}"}} for i in range(4)] + [{"notice": {}}])
    size = sum(p.stat().st_size for p in source.iterdir())
    messages = streams.message_files(spark, str(source), bytes_per_batch=size // 3)
    J.start(J.ingest_sensor(messages, root, vectors=False), str(tmp_path / "mark")).awaitTermination()
    assert K.written_batches(spark, f"{root}/tables/conn") == [0, 1, 2]
    assert sorted(r[0] for r in K.read_table(spark, f"{root}/tables/conn").select("uid").collect()) == [f"{n}-{i}" for n in range(3) for i in range(4)]
    assert K.read_table(spark, f"{root}/dead_letters").count() == 3


def test_ingested_messages_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    """All messages were one batch, however many there were."""
    from watchloom.plans import storage
    from watchloom.plans.registry import QUERIES

    price = F.col("id").cast("double")
    spark.range(4000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"),
        F.lit("F").alias("l_linestatus"), F.lit("A").alias("l_returnflag"), F.lit(2.0).alias("l_quantity"), price.alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"), F.lit("2001-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    roots, first = [], J.ingest_sensor
    monkeypatch.setattr(J, "ingest_sensor", lambda messages, root, **how: roots.append(root) or first(messages, root, **how))
    monkeypatch.setattr(storage, "FILE_MESSAGES", 200)
    monkeypatch.setattr(storage, "BATCH_BYTES", 200_000)
    got = {r["table_name"]: r["stored_rows"] for r in QUERIES["stream_ingest_sensor"](spark, str(tmp_path)).collect()}
    spoiled = sum(any(n % k == 0 for k in (101, 103, 107, 109, 113, 127, 131)) for n in range(4000))
    assert got == {"conn": 4000 - spoiled, "dead_letters": spoiled}
    assert len(K.written_batches(spark, f"{roots[0]}/tables/conn")) > 2


def test_rows_are_dealt_out_by_row_groups_and_size(spark, tmp_path, monkeypatch):
    """A large file was dealt to as many parts as there are cores, however many row groups it had."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    cores, rows = spark.sparkContext.defaultParallelism, 6400
    for name, size in (("one", rows), ("many", rows // (files.GROUPS_PER_CORE * cores))):
        pq.write_table(pa.table({"n": range(rows)}), tmp_path / f"{name} file.parquet", row_group_size=size)
    one, many = (spark.read.parquet(str(tmp_path / f"{n} file.parquet")) for n in ("one", "many"))
    assert files.spread(many) is many
    assert files.spread(one).rdd.getNumPartitions() == cores
    monkeypatch.setattr(files, "PART_BYTES", (tmp_path / "one file.parquet").stat().st_size // 20)
    dealt = files.spread(one)
    assert dealt.rdd.getNumPartitions() >= 20 and sorted(r[0] for r in dealt.collect()) == [*range(rows)]
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= rows // 10
