"""Sources, sinks and streams (named queries). Streams read the given tables as files,
work them off and are compared with what a batch query gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.operators import detections as D
from watchloom.operators import event_rules as R
from watchloom.operators import normalize as N
from watchloom.plans.detections import TRIAGE, flat_findings
from watchloom.plans.mapping import EVENT_OUTCOMES, SENSOR_OUTCOMES, _event_json, _sensor_json
from watchloom.plans.registry import query
from watchloom.session import scratch_path
from watchloom.sinks import tables as K
from watchloom.sources import catalog, files, streams
from watchloom.sources import given as G
from watchloom.streaming import jobs as J

# --- sources -------------------------------------------------------------------------------


@query("scan_table", """
select uid, ts, service from sensor_conn order by ts desc, uid limit 100""")
def _(spark, sf_dir):
    path = scratch_path(spark, "conn")
    G.sensor_conn(spark, sf_dir).write.parquet(path)
    scanned = files.stored_table(spark, path, ["uid", "ts", "service"])
    return scanned.orderBy(F.desc("ts"), "uid").limit(100)


@query("scan_external_text", "select ts::varchar as ts, event_id as id, event_type as text from events")
def _(spark, sf_dir):
    path = scratch_path(spark, "text-table")
    events = G.table(spark, sf_dir, "events")
    files.write_text_table(
        events.select(F.col("ts").cast("string"), F.col("event_id"), F.col("event_type")), path
    )
    return files.text_table(spark, path, "ts string, id bigint, text string")


@query("resolve_sources", """
select 'conn' as name, count(*) as stored_rows from sensor_conn
union all select 'authentication', count(*) from security_events where original_event_type like 'ssh_login%'
  or original_event_type like 'web_login%'""")
def _(spark, sf_dir):
    """Tables stored under prefixed names and found again by type and logical name."""
    root = scratch_path(spark, "catalog")
    locations = {"sensor": catalog.Location(root, "sensor_"), "event": catalog.Location(root, "event_")}
    logins = G.security_events(spark, sf_dir).filter(F.col("original_event_type").rlike("^(ssh|web)_login"))
    stored = {"conn": ("sensor", G.sensor_conn(spark, sf_dir)), "authentication": ("event", logins)}
    counted = None
    for name, (kind, df) in stored.items():
        path = catalog.table_path(locations, kind, name)
        df.write.parquet(path)
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored_rows")).select(
            F.lit(name).alias("name"), "stored_rows"
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted


ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_DESCRIBED = " union all ".join(
    f"select * from (unpivot (select '{t}' as table_name, r.* from (select count(columns(*)) from {t}) r) "
    f"on columns(* exclude (table_name)) into name column_name value filled_rows) join (unpivot (select '{t}' as table_name, r.* "
    f"from (select typeof(any_value(columns(*))) from {t}) r) on columns(* exclude (table_name)) "
    "into name column_name value type_name) using (table_name, column_name)"
    for t in ALL_TABLES
)


@query("introspect_schema", f"""
select table_name, column_name, filled_rows, case type_name when 'BIGINT' then 'bigint' when 'INTEGER' then 'int'
  when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'FLOAT[]' then 'array<float>'
  when 'TIMESTAMP' then 'timestamp_ntz' else lower(type_name) end as data_type
from ({_DESCRIBED})""")
def _(spark, sf_dir):
    """Columns of all given tables with their types and filled rows."""
    return catalog.describe({n: G.table(spark, sf_dir, n) for n in ALL_TABLES}).drop("position")


@query("src_multi_topic", """
select topic, msg_offset, if(msg_offset % 10 = 0, concat('{"raw_message":"no json ', msg_offset, '"}'),
    replace(data, ' ', '')) as data
from stream_messages""")
def _(spark, sf_dir):
    """Messages of all topics; text that is no JSON is kept as ``raw_message``."""
    number = F.col("msg_offset")
    messages = G.stream_messages(spark, sf_dir).withColumn(
        "value",
        F.when(number % 10 == 0, F.concat(F.lit("no json "), number.cast("string"))).otherwise(F.col("data")),
    )
    read = streams.with_data(messages)
    return read.select("topic", "msg_offset", F.to_json("data").alias("data"))


# --- sinks ---------------------------------------------------------------------------------


@query("sink_json_topic", """
select event_id, epoch_us(time_dt) // 1000000 as time from clean_events""")
def _(spark, sf_dir):
    """Lines normalised by a stream into JSON files, which stand for the topic."""
    lines, out, mark = (scratch_path(spark, n) for n in ("lines", "topic", "mark"))
    numbered = F.regexp_replace("value", " event=", F.concat(F.lit(""), F.lit(" event=")))
    G.log_lines(spark, sf_dir).select(
        F.concat(numbered, F.lit(" id="), F.col("event_id").cast("string")).alias("value")
    ).write.text(lines)
    source = streams.log_stream(spark, lines)
    number = F.regexp_extract("value", r" id=(\d+)$", 1).cast("bigint")
    parsed = N.parsed_lines(source.withColumn("event_id", number))
    events = N.as_json(N.normalize(parsed, ("event_id",)))
    J.start(J.json_to_files(events, out), mark).awaitTermination()
    topic = spark.read.text(out).select(F.from_json("value", "event_id bigint, time bigint").alias("e"))
    return topic.select("e.*")


@query("stream_normalize", """
select original_event_type, count(*) as events, max(epoch_us(time_dt) // 1000000) as latest from clean_events group by 1""")
def _(spark, sf_dir):
    lines, out, mark = (scratch_path(spark, n) for n in ("lines", "topic", "mark"))
    G.log_lines(spark, sf_dir).select("value").write.text(lines)
    J.start(J.json_to_files(J.normalize_stream(streams.log_stream(spark, lines)), out), mark).awaitTermination()
    event = F.from_json("value", "time bigint, raw_data string").alias("e")
    written = spark.read.text(out).select(event).select("e.*")
    kind = F.get_json_object("raw_data", "$.original_event_type").alias("original_event_type")
    return written.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), F.max("time").alias("latest"))


@query("append_evolving", """
select event_id, original_event_type, if(event_id % 2 = 1, dst_port, null) as dst_port from ported_events""")
def _(spark, sf_dir):
    """Two appends, the second of which brings a new column."""
    path = scratch_path(spark, "evolving")
    events = G.security_events_with_port(spark, sf_dir).select("event_id", "original_event_type", "dst_port")
    K.append_evolving(events.filter("event_id % 2 = 0").drop("dst_port"), path)
    K.append_evolving(events.filter("event_id % 2 = 1"), path)
    return files.stored_table(spark, path)


@query("export_findings", TRIAGE)
def _(spark, sf_dir):
    """Findings written as JSON and read back with all columns."""
    path = scratch_path(spark, "findings")
    found = D.triage_findings(G.security_events(spark, sf_dir))
    K.export_findings(found, path)
    return flat_findings(spark.read.schema(found.schema).json(path))


@query("sink_hourly_json", """
select service as log_type, date_trunc('hour', ts) as hour, count(*) as messages from sensor_conn group by 1, 2""")
def _(spark, sf_dir):
    path = scratch_path(spark, "hourly")
    K.write_hourly_json(G.sensor_conn(spark, sf_dir).withColumnRenamed("service", "log_type"), path)
    # Folder names are texts: without a declared type the hour would be guessed as a date.
    read = spark.read.schema("uid string, log_type string, hour string").json(path)
    hour = F.to_timestamp("hour", "yyyy-MM-dd-HH").cast("timestamp_ntz").alias("hour")
    return read.groupBy("log_type", hour).agg(F.count(F.lit(1)).alias("messages"))


# --- streams --------------------------------------------------------------------------------


FILE_MESSAGES = 200_000  # most messages of a file, and
BATCH_BYTES = 1 << 30  # most bytes of a micro-batch, so that what is kept of one is bounded at any size of the input


def _run(spark, writer):
    J.start(writer, scratch_path(spark, "mark")).awaitTermination()


ROUNDS = 4


def _arrivals(rows, time_col, id_col):
    """Adds ``round``: when rows arrive, up to eleven hours late, in four rounds of equal spans of arrival."""
    late = rows.withColumn("arrival", F.col(time_col) + F.make_dt_interval(hours=(F.col(id_col) % 12).cast("int")))
    span = late.agg(F.min("arrival").alias("low"), F.max("arrival").alias("high")).first()
    step = (span["high"] - span["low"]) / ROUNDS
    cuts = [F.lit((span["low"] + step * k).isoformat(sep=" ")).cast("timestamp_ntz") for k in range(1, ROUNDS)]
    return late.withColumn("round", sum((F.col("arrival") >= c).cast("int") for c in cuts)).drop("arrival")


def _in_rounds(spark, rows, make_writer):
    """Lets rows with a column ``round`` arrive round by round; the query stops and starts again after each."""
    parts, source, mark = (scratch_path(spark, n) for n in ("rounds", "source", "mark"))
    rows.write.partitionBy("round").parquet(parts)
    schema = rows.drop("round").schema
    for k in range(ROUNDS):
        arrived = spark.read.schema(rows.schema).parquet(parts).filter(F.col("round") == k).drop("round")
        arrived.write.mode("append").parquet(source)
        J.start(make_writer(spark.readStream.schema(schema).parquet(source)), mark).awaitTermination()


def _live(spark, sf_dir, report, keys, gone=None):
    """A live report over events in rounds, as its stored table stands at the end."""
    table = K.KeyedTable(spark, scratch_path(spark, "live"), keys, gone, fold_every=3)
    events = _arrivals(G.security_events(spark, sf_dir), "time_dt", "event_id")
    _in_rounds(spark, events, lambda stream: J.into_table(report(stream, delay="12 hours"), table))
    return table.read()


def _event_stream(spark, sf_dir):
    """The shaped events as a stream over the files of the given table."""
    path = scratch_path(spark, "events")
    G.security_events(spark, sf_dir).write.parquet(path)
    return streams.table_stream(spark, path)


def _to_parquet(spark, stream, name):
    out = scratch_path(spark, name)
    _run(spark, stream.writeStream.format("parquet").option("path", out).outputMode("append"))
    return spark.read.parquet(out)


@query("stream_map", "select event_id, user_name, src_ip, dst_ip, original_event_type from security_events")
def _(spark, sf_dir):
    mapped = _event_stream(spark, sf_dir).drop("time_dt")
    return _to_parquet(spark, mapped, "mapped")


@query("stream_hourly_counts", """
select date_trunc('hour', time_dt) as time_bucket, original_event_type, count(*) as event_count
from security_events group by 1, 2""")
def _(spark, sf_dir):
    counted = _live(spark, sf_dir, J.hourly_counts, J.HOURLY_KEYS)
    return counted.withColumn("time_bucket", F.col("time_bucket").cast("timestamp_ntz"))


@query("stream_sliding_bruteforce", """
with f as (select * from security_events where original_event_type like '%_failure'),
w as (select src_ip, time_bucket(interval 5 minutes, time_dt) - to_minutes(5 * k::int) as window_start
  from f, range(6) as r(k))
select window_start, src_ip, count(*) as guesses from w group by 1, 2 having count(*) >= 3""")
def _(spark, sf_dir):
    found = _live(spark, sf_dir, J.sliding_bruteforce, J.SLIDING_KEYS)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_sessions", """
with s as (select *, case when time_dt < lag(time_dt) over w + interval 30 minutes then 0 else 1 end as opens
  from security_events window w as (partition by src_ip, dst_ip order by time_dt, event_id)),
n as (select *, sum(opens) over (partition by src_ip, dst_ip order by time_dt, event_id) as number from s)
select src_ip, dst_ip, min(time_dt) as session_start, max(time_dt) + interval 30 minutes as session_end,
  count(*) as events_in_session
from n group by src_ip, dst_ip, number""")
def _(spark, sf_dir):
    found = _live(spark, sf_dir, J.sessions, J.SESSION_KEYS, "merged_away")
    return found.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    )


@query("stream_dedup", "select event_id, original_event_type from security_events")
def _(spark, sf_dir):
    """Every event sent twice, the second time in another round where there is one; one copy is kept."""
    events = _arrivals(G.security_events(spark, sf_dir), "time_dt", "event_id")
    copy = F.explode(F.array(F.lit(0), F.lit(1)))
    twice = events.withColumn("copy", copy).withColumn("round", F.least(F.col("round") + F.col("copy"), F.lit(ROUNDS - 1)))
    out = scratch_path(spark, "deduped")

    def first(stream):
        text = F.concat_ws("|", F.col("event_id").cast("string"), "original_event_type")
        kept = J.first_copies(stream.withColumn("value", text), "time_dt", "12 hours")
        return kept.select("event_id", "original_event_type").writeStream.format("parquet").option("path", out)

    _in_rounds(spark, twice, first)
    return spark.read.parquet(out)


@query("stream_tail_buffer", """
select topic, msg_offset, msg_time, data from (select *, row_number() over (partition by topic order by msg_offset desc)
  as k from stream_messages) where k <= 50""")
def _(spark, sf_dir):
    root = scratch_path(spark, "tail")
    messages = _arrivals(G.stream_messages(spark, sf_dir), "msg_time", "msg_offset")
    _in_rounds(spark, messages, lambda stream: J.tail_buffer(stream, root))
    last = K.written_batches(spark, root)[-1]
    return spark.read.parquet(f"{root}/batch_id={last}")


@query("stream_inspect", f"""
with {EVENT_OUTCOMES} select status, kind, count(*) as messages from o group by 1, 2""")
def _(spark, sf_dir):
    path, out = scratch_path(spark, "messages"), scratch_path(spark, "totals")
    _event_json(spark, sf_dir).select("value").write.text(path)
    counts = J.outcome_counts(R.judge_events(streams.message_files(spark, path)))
    _run(
        spark,
        counts.writeStream.outputMode("complete").foreachBatch(
            lambda batch, batch_id: K.write_batch(batch, out, batch_id)
        ),
    )
    totals = spark.read.parquet(out)
    last = totals.agg(F.max("batch_id")).first()[0]
    return totals.filter(F.col("batch_id") == last).drop("batch_id")


@query("stream_raw_tap", "select value from log_lines")
def _(spark, sf_dir):
    path, out = scratch_path(spark, "lines"), scratch_path(spark, "tap")
    G.log_lines(spark, sf_dir).select("value").write.text(path)
    _run(spark, J.raw_tap(streams.log_stream(spark, path), out))
    return spark.read.text(out)


@query("stream_ingest_ocsf", f"""
with {EVENT_OUTCOMES} select replace(lower(kind), ' ', '_') as table_name, count(*) as stored_rows from o
where status = 'SUCCESS' group by 1
union all select 'dead_letters', count(*) from o where status <> 'SUCCESS'
union all select 'vectors', count(*) from o where status = 'SUCCESS'""")
def _(spark, sf_dir):
    path, root = scratch_path(spark, "messages"), scratch_path(spark, "ingested")
    _event_json(spark, sf_dir).select("value").write.text(path)
    _run(spark, J.ingest_events(streams.message_files(spark, path), root))
    tables = {R.table_name(n): f"{root}/tables/{R.table_name(n)}" for n in V.STORED_CLASSES.values()}
    return _counts(spark, tables | {n: f"{root}/{n}" for n in ("dead_letters", "vectors")})


@query("stream_ingest_sensor", f"""
with {SENSOR_OUTCOMES} select kind as table_name, count(*) as stored_rows from o where status = 'SUCCESS' group by 1
union all select 'dead_letters', count(*) from o where status <> 'SUCCESS'""")
def _(spark, sf_dir):
    path, root = scratch_path(spark, "messages"), scratch_path(spark, "ingested")
    _sensor_json(spark, sf_dir).select("value").write.option("maxRecordsPerFile", FILE_MESSAGES).text(path)
    messages = streams.message_files(spark, path, bytes_per_batch=BATCH_BYTES)
    _run(spark, J.ingest_sensor(messages, root, vectors=False))
    return _counts(spark, {"conn": f"{root}/tables/conn", "dead_letters": f"{root}/dead_letters"})


def _counts(spark, tables):
    counted = None
    for name, path in tables.items():
        part = K.read_table(spark, path).agg(F.count(F.lit(1)).alias("stored_rows")).select(
            F.lit(name).alias("table_name"), "stored_rows"
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted.filter("stored_rows > 0")
