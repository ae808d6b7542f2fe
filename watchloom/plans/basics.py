"""Filters, windows, limits, joins and set operations (named queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import labels as L
from watchloom.functions.expressions import before, lookup, since
from watchloom.functions import values as V
from watchloom.operators import basics as B
from watchloom.operators import skew as S
from watchloom.plans.registry import query
from watchloom.plans.reports import NOW, THREATS
from watchloom.session import scratch_path
from watchloom.sources import files as files_source
from watchloom.sources import given as G

ALL = "select event_id, time_dt, user_name, src_ip, dst_ip, original_event_type from security_events"


# --- filters ---------------------------------------------------------------------


@query("filter_in_list", f"{ALL} where original_event_type in {THREATS}")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    return events.filter(F.col("original_event_type").isin(V.THREAT_EVENTS))


@query("filter_recent", f"""
select '1 hour' as period, count(*) as n from security_events where time_dt >= timestamp '2024-01-30 23:00:00'
union all select '24 hours', count(*) from security_events where time_dt >= timestamp '2024-01-30 00:00:00'
union all select '7 days', count(*) from security_events where time_dt >= timestamp '2024-01-24 00:00:00'
union all select '14 days', count(*) from security_events where time_dt >= timestamp '2024-01-17 00:00:00'
union all select '30 days', count(*) from security_events where time_dt >= timestamp '2024-01-01 00:00:00'""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    periods = {"1 hour": 1, "24 hours": 24, "7 days": 168, "14 days": 336, "30 days": 720}
    # All periods in one scan.
    counted = events.filter(since(events, "time_dt", NOW, hours=720)).agg(
        *[F.count_if(since(events, "time_dt", NOW, hours=h)).alias(p) for p, h in periods.items()]
    )
    return counted.unpivot([], list(periods), "period", "n")


@query("filter_between_periods", f"""{ALL}
where time_dt >= timestamp '2024-01-17 00:00:00' and time_dt < timestamp '2024-01-24 00:00:00'""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    return events.filter(since(events, "time_dt", NOW, days=14) & before(events, "time_dt", NOW, days=7))


@query("filter_not_null", """
select event_id, original_event_type, port as dst_port
from security_events join event_ports on original_event_type = event_name""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    ported = events.withColumn("dst_port", lookup(F.col("original_event_type"), V.EVENT_PORTS))
    return ported.filter(F.col("dst_port").isNotNull()).select("event_id", "original_event_type", "dst_port")


@query("filter_like", f"{ALL} where suffix(original_event_type, '_success')")
def _(spark, sf_dir):
    return G.security_events(spark, sf_dir).filter(L.is_success(F.col("original_event_type")))


@query("filter_not_like", f"{ALL} where not suffix(original_event_type, '_success')")
def _(spark, sf_dir):
    return G.security_events(spark, sf_dir).filter(~L.is_success(F.col("original_event_type")))


@query("filter_equals", "select uid, ts, id_orig_h, id_resp_h, service from sensor_conn where proto = 'tcp'")
def _(spark, sf_dir):
    conn = G.sensor_conn(spark, sf_dir)
    return conn.filter(F.col("proto") == "tcp").select("uid", "ts", "id_orig_h", "id_resp_h", "service")


@query("having", """
select user_name, count(*) as n from security_events group by user_name having count(*) > 60""")
def _(spark, sf_dir):
    return B.groups_with(G.security_events(spark, sf_dir), ["user_name"], 60)


@query("topic_filter", "select topic, msg_offset, msg_time, data from stream_messages where topic = 'error'")
def _(spark, sf_dir):
    return B.of_topic(G.stream_messages(spark, sf_dir), "error")


@query("filter_date_eq", f"{ALL} where cast(time_dt as date) = date '2024-01-30'")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    return events.filter(B.on_day(events, "time_dt", "2024-01-30"))


# --- windows, order, limit ----------------------------------------------------------

NEIGHBOURS = """
select event_id, src_ip, dst_ip, time_dt,
  {} from security_events window w as (partition by src_ip, dst_ip order by time_dt, event_id)"""


@query("prev_event", NEIGHBOURS.format("lag(time_dt) over w as prev_event_time"))
def _(spark, sf_dir):
    linked = S.with_neighbours(
        G.security_events(spark, sf_dir), ["src_ip", "dst_ip"], "time_dt", ["event_id"]
    )
    return linked.select("event_id", "src_ip", "dst_ip", "time_dt", "prev_event_time")


@query("next_event", NEIGHBOURS.format("lead(time_dt) over w as next_event_time"))
def _(spark, sf_dir):
    linked = S.with_neighbours(
        G.security_events(spark, sf_dir), ["src_ip", "dst_ip"], "time_dt", ["event_id"]
    )
    return linked.select("event_id", "src_ip", "dst_ip", "time_dt", "next_event_time")


@query("event_gaps", NEIGHBOURS.format("""
  (epoch_us(time_dt) - epoch_us(lag(time_dt) over w)) / 1e6 as seconds_since_previous,
  (epoch_us(lead(time_dt) over w) - epoch_us(time_dt)) / 1e6 as seconds_to_next"""))
def _(spark, sf_dir):
    return B.event_gaps(G.security_events(spark, sf_dir)).select(
        "event_id", "src_ip", "dst_ip", "time_dt", "seconds_since_previous", "seconds_to_next"
    )


@query("share_of_total", """
select user_name, count(*) as n, cast((20000 * count(*) + t) // (2 * t) as double) / 100 as percentage
from security_events, (select count(*) as t from security_events) group by user_name, t""")
def _(spark, sf_dir):
    return B.share_of_total(G.security_events(spark, sf_dir), ["user_name"])


RANKED = """select *, row_number() over (partition by topic order by msg_offset desc) as k from stream_messages"""


@query("last_n_per_topic", f"select topic, msg_offset, msg_time, data from ({RANKED}) where k <= 50")
def _(spark, sf_dir):
    return B.last_per_group(G.stream_messages(spark, sf_dir), "topic", "msg_offset", 50)


@query("last_n_overall", f"""
select topic, msg_offset, msg_time, data from ({RANKED}) where k <= 50
order by msg_time desc, msg_offset desc limit 50""")
def _(spark, sf_dir):
    return B.latest_messages(G.stream_messages(spark, sf_dir))


@query("last_arrivals", """
select topic, msg_offset, msg_time, data from stream_messages order by msg_time desc, msg_offset desc limit 200""")
def _(spark, sf_dir):
    return B.last_overall(G.stream_messages(spark, sf_dir), ["msg_time", "msg_offset"], 200)


@query("keep_newest", """
select event_id, time_dt, src_ip from security_events order by event_id desc limit 700""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir).select("event_id", "time_dt", "src_ip")
    return B.keep_newest(events, "event_id", 700)


@query("oldest_n", "select vec_id, label from embeddings order by vec_id limit 10")
def _(spark, sf_dir):
    return B.oldest(G.vectors(spark, sf_dir).select("vec_id", "label"), "vec_id", 10)


@query("random_record", """
select vec_id, label, len(embedding) as dimensions from embeddings
order by md5(concat(vec_id, ':0')), vec_id limit 1""")
def _(spark, sf_dir):
    picked = B.random_record(G.vectors(spark, sf_dir), "vec_id")
    return picked.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dimensions"))


@query("latest_20", """
select event_id, time_dt, original_event_type from security_events order by time_dt desc, event_id desc limit 20""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir).select("event_id", "time_dt", "original_event_type")
    return B.last_overall(events, ["time_dt", "event_id"], 20)


@query("order_multi", """
select user_name, count(*) as n, max(event_id) as latest from security_events group by 1 order by n desc, latest""")
def _(spark, sf_dir):
    grouped = G.security_events(spark, sf_dir).groupBy("user_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest")
    )
    return grouped.orderBy(F.desc("n"), F.asc("latest"))


@query("limit_n_display", """
select uid, strftime(ts, '%Y-%m-%d %H:%M:%S.') || '000' as ts, service from sensor_conn
order by sensor_conn.ts desc, uid limit 5""")
def _(spark, sf_dir):
    conn = G.sensor_conn(spark, sf_dir).select("uid", "ts", "service")
    return B.format_timestamps(conn.orderBy(F.desc("ts"), "uid").limit(5))


@query("format_timestamps", """
select event_id, strftime(time_dt, '%Y-%m-%d %H:%M:%S.') || substr(strftime(time_dt, '%f'), 1, 3) as time_dt,
  src_ip from security_events""")
def _(spark, sf_dir):
    return B.format_timestamps(G.security_events(spark, sf_dir).select("event_id", "time_dt", "src_ip"))


# --- joins and sets -------------------------------------------------------------------


@query("join_baseline", """
with b as (select user_name, count(*) / 29.0 as usual from security_events
  where time_dt < timestamp '2024-01-30 00:00:00' group by 1),
t as (select user_name, count(*) as today_events from security_events
  where cast(time_dt as date) = date '2024-01-30' group by 1)
select t.user_name, today_events from t join b on t.user_name = b.user_name where today_events > usual""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    usual = (
        events.filter(before(events, "time_dt", NOW, days=1))
        .groupBy("user_name")
        .agg((F.count(F.lit(1)) / 29).alias("usual"))
    )
    today = (
        events.filter(B.on_day(events, "time_dt", "2024-01-30"))
        .groupBy("user_name")
        .agg(F.count(F.lit(1)).alias("today_events"))
    )
    joined = today.join(usual, "user_name")
    return joined.filter(F.col("today_events") > F.col("usual")).select("user_name", "today_events")


@query("full_outer_federated", """
with v as (select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as created_at, event_type from events
  where event_id % 3 <> 0),
h as (select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, event_id as id, event_type as text from events
  where event_id % 2 = 0)
select v.event_id, v.created_at, v.event_type, h.ts, h.id, h.text from v full outer join h on v.created_at = h.ts""")
def _(spark, sf_dir):
    stamped = G.table(spark, sf_dir, "events").withColumn(
        "created_at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    stored = stamped.filter("event_id % 3 <> 0").select("event_id", "created_at", "event_type")
    path = scratch_path(spark, "text-table")
    files_source.write_text_table(
        stamped.filter("event_id % 2 = 0").select(
            F.col("created_at").alias("ts"), F.col("event_id").alias("id"),
            F.col("event_type").alias("text"),
        ),
        path,
    )
    external = files_source.text_table(spark, path, "ts string, id bigint, text string")
    return B.full_outer(stored, external, [("created_at", "ts")])


@query("lookup_join", """
select event_id, original_event_type, port as dst_port from security_events
join event_ports on original_event_type = event_name""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    ports = spark.createDataFrame(list(V.EVENT_PORTS.items()), "original_event_type string, dst_port int")
    # A fixed table of 14 rows.
    joined = events.join(F.broadcast(ports), "original_event_type")
    return joined.select("event_id", "original_event_type", "dst_port")


@query("union_all", """
select 'events' as origin, event_id as id, src_ip, cast(null as bigint) as bytes from security_events
union all select 'conn', null, id_orig_h, orig_bytes from sensor_conn""")
def _(spark, sf_dir):
    return B.union_all(
        [
            G.security_events(spark, sf_dir).select(
                F.lit("events").alias("origin"), F.col("event_id").alias("id"), "src_ip"
            ),
            G.sensor_conn(spark, sf_dir).select(
                F.lit("conn").alias("origin"), F.col("id_orig_h").alias("src_ip"),
                F.col("orig_bytes").alias("bytes"),
            ),
        ]
    )


@query("distinct_values", "select distinct topic from stream_messages")
def _(spark, sf_dir):
    return B.distinct_values(G.stream_messages(spark, sf_dir), "topic")


@query("topic_counts", "select topic, count(*) as messages from stream_messages group by 1")
def _(spark, sf_dir):
    messages = G.stream_messages(spark, sf_dir)
    return messages.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))


@query("schema_diff", """
select 'dst_port' as column_name, count(*) as filled_rows from ported_events
union all select 'user_name', count(*) from security_events""")
def _(spark, sf_dir):
    """Columns the stored table lacks, with the rows that fill them."""
    incoming = G.security_events_with_port(spark, sf_dir)
    existing = incoming.select("event_id", "time_dt", "src_ip", "dst_ip", "original_event_type")
    added = B.missing_columns(existing, incoming)
    return incoming.agg(*[F.count(c).alias(c) for c in added]).unpivot(
        [], added, "column_name", "filled_rows"
    )


# --- derived columns --------------------------------------------------------------------


@query("enrich_dst_port", "select event_id, original_event_type, dst_port from ported_events")
def _(spark, sf_dir):
    return G.security_events_with_port(spark, sf_dir).select("event_id", "original_event_type", "dst_port")


@query("service_label", """
select event_id, case when port = 22 then 'SSH (22)' when port = 3389 then 'RDP (3389)'
  when port = 80 then 'HTTP (80)' when port = 443 then 'HTTPS (443)' when port = 445 then 'SMB (445)'
  else concat('Port ', port) end as service
from (select event_id, dst_port + event_id % 2 as port from ported_events)""")
def _(spark, sf_dir):
    ported = G.security_events_with_port(spark, sf_dir)
    port = (F.col("dst_port") + F.col("event_id") % 2).cast("int")
    return ported.select("event_id", L.service_label(port).alias("service"))


@query("severity_label", """
select event_id, if(original_event_type in ('malware_detection', 'data_exfiltration'), 'CRITICAL',
  if(original_event_type in ('rdp_brute_force', 'brute_force_attack'), 'HIGH',
  if(original_event_type in ('sql_injection_attempt', 'rdp_reconnaissance'), 'MEDIUM', 'LOW'))) as severity
from security_events""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    return events.select("event_id", L.severity_label(F.col("original_event_type")).alias("severity"))


@query("attack_outcome", """
select event_id, case when original_event_type like '%_success' then 'Successful Attacks'
  when original_event_type like '%_failure' or original_event_type in
    ('brute_force_attack', 'rdp_brute_force', 'sql_injection_attempt') then 'Failed Attacks'
  else 'Other Malicious Activity' end as attack_outcome
from security_events""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    return events.select("event_id", L.attack_outcome(F.col("original_event_type")).alias("attack_outcome"))
