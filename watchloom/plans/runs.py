"""Table summary and pipeline-run health (named queries)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from watchloom.functions import mapping as M
from watchloom.operators import detections as D
from watchloom.operators import pipeline_runs as P
from watchloom.plans.registry import query
from watchloom.session import scratch_path
from watchloom.sources import given as G

AS_OF = "2001-08-02"
WIDE = 2500  # days; covers the whole table


def _day_as_text(df):
    return df.withColumn("run_date", F.col("run_date").cast("string"))


def _rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("table_summary", """
select 'zeek_weird' as table_name, count(*) as total_records, max(ts) as last_updated from sensor_weird
union all select 'zeek_known_hosts', count(*), max(ts) from (
  select host, min(ts) as ts from (select id_orig_h as host, ts from sensor_conn
    union all select id_resp_h, ts from sensor_conn) group by host)
union all select 'zeek_http', count(*), max(ts) from sensor_http
union all select 'zeek_conn', count(*), max(ts) from sensor_conn
union all select 'zeek_analyzer', count(*), max(ts) from sensor_analyzer
union all select 'zeek_ftp', count(*), max(ts) from sensor_ftp
union all select 'zeek_dns', count(*), max(ts) from sensor_dns
union all select 'fluentd_file_system_activity', count(*), max(time_dt) from security_events
  where original_event_type = 'file_access'
union all select 'fluentd_authentication', count(*), max(time_dt) from security_events
  where original_event_type like 'ssh_login%' or original_event_type like 'web_login%'
union all select 'fluentd_detection_finding', count(*), max(time_dt) from security_events
  where original_event_type like 'rdp%' or original_event_type in ('brute_force_attack', 'sql_injection_attempt')""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    conn = G.sensor_conn(spark, sf_dir)

    def of_class(uid):
        return events.filter(M.class_uid(F.col("original_event_type")) == uid)

    return P.table_summary(
        {
            "zeek_weird": (G.sensor_weird(spark, sf_dir), "ts"),
            "zeek_known_hosts": (D.known_hosts(conn), "ts"),
            "zeek_http": (G.sensor_http(spark, sf_dir), "ts"),
            "zeek_conn": (conn, "ts"),
            "zeek_analyzer": (G.sensor_analyzer(spark, sf_dir), "ts"),
            "zeek_ftp": (G.sensor_ftp(spark, sf_dir), "ts"),
            "zeek_dns": (G.sensor_dns(spark, sf_dir), "ts"),
            "fluentd_file_system_activity": (of_class(1001), "time_dt"),
            "fluentd_authentication": (of_class(3002), "time_dt"),
            "fluentd_detection_finding": (of_class(2004), "time_dt"),
        }
    )


RUN_STATS = """
select strftime(created_at, '%Y-%m-%d') as run_date, invocation_id, resource_type, status,
  count(*) as resource_count, round(sum(execution_time), 8) as total_execution_time,
  round(avg(execution_time), 8) as avg_execution_time, max(execution_time) as max_execution_time,
  cast(sum(rows_affected) as bigint) as total_rows_affected
from run_results where created_at >= date '1994-09-28' group by 1, 2, 3, 4"""


@query("run_stats", RUN_STATS)
def _(spark, sf_dir):
    stats = _day_as_text(P.run_stats(G.run_results(spark, sf_dir), AS_OF, WIDE))
    return _rounded(stats, "total_execution_time", "avg_execution_time", digits=8)


@query("run_daily_summary", """
with r as (
  select strftime(created_at, '%Y-%m-%d') as run_date, invocation_id, resource_type, status,
    count(*) as n, sum(execution_time) as total, sum(rows_affected) as touched
  from run_results where created_at >= date '1994-09-28' group by 1, 2, 3, 4)
select run_date, count(distinct invocation_id) as total_runs,
  cast(coalesce(sum(n) filter (status = 'success'), 0) as bigint) as successful_resources,
  cast(coalesce(sum(n) filter (status in ('error', 'fail')), 0) as bigint) as failed_resources,
  cast(sum(n) as bigint) as total_resources, round(avg(total), 8) as avg_run_duration,
  cast(sum(touched) as bigint) as daily_rows_processed
from r group by 1""")
def _(spark, sf_dir):
    summary = _day_as_text(P.daily_summary(G.run_results(spark, sf_dir), AS_OF, WIDE))
    return _rounded(summary, "avg_run_duration", digits=8)


@query("run_performance_trends", """
select table_name, resource_type, count(*) as run_count, round(avg(execution_time), 4) as avg_execution_time,
  round(stddev(execution_time), 4) as execution_time_stddev, min(execution_time) as min_execution_time,
  max(execution_time) as max_execution_time, count(*) filter (status = 'success') as success_count,
  count(*) filter (status in ('error', 'fail')) as failure_count
from run_results where created_at >= date '1994-09-28' group by 1, 2""")
def _(spark, sf_dir):
    trends = P.performance_trends(G.run_results(spark, sf_dir), AS_OF, WIDE)
    return _rounded(trends, "avg_execution_time", "execution_time_stddev")


@query("run_analysis", """
with r as (
  select strftime(created_at, '%Y-%m-%d') as run_date, invocation_id, resource_type, status,
    count(*) as n, sum(execution_time) as total
  from run_results where created_at >= date '1994-09-28' group by 1, 2, 3, 4)
select 'daily_summary' as metric_type, run_date as dimension_1, cast(null as varchar) as dimension_2,
  cast(count(distinct invocation_id) as double) as metric_value_1,
  cast(sum(if(status = 'success', n, 0)) as bigint) as metric_value_2,
  cast(sum(if(status in ('error', 'fail'), n, 0)) as bigint) as metric_value_3,
  round(avg(total), 8) as metric_value_4
from r group by run_date
union all
select 'performance_trends', table_name, resource_type, round(avg(execution_time), 4),
  sum(if(status = 'success', 1, 0))::bigint, sum(if(status in ('error', 'fail'), 1, 0))::bigint,
  count(*)::double
from run_results where created_at >= date '1994-09-28'
group by table_name, resource_type having count(*) > 1""")
def _(spark, sf_dir):
    analysis = P.run_analysis(G.run_results(spark, sf_dir), AS_OF, WIDE)
    # Daily values are short sums, kept to 8 digits; the trend averages run over many rows.
    return analysis.withColumns(
        {
            c: F.when(F.col("metric_type") == "daily_summary", F.round(c, 8)).otherwise(F.round(c, 4))
            for c in ("metric_value_1", "metric_value_4")
        }
    )


@query("filter_run_count", """
select table_name, resource_type, count(*) as run_count from run_results
where created_at >= date '1994-09-28' group by 1, 2 having count(*) > 1""")
def _(spark, sf_dir):
    trends = P.performance_trends(G.run_results(spark, sf_dir), AS_OF, WIDE)
    return trends.filter("run_count > 1").select("table_name", "resource_type", "run_count")


@query("slowest_models", """
select table_name, round(avg(execution_time), 4) as avg_execution_time,
  max(execution_time) as max_execution_time, count(*) as run_count
from run_results where resource_type = 'model' and status = 'success' and created_at >= date '1994-09-28'
group by 1""")
def _(spark, sf_dir):
    return _rounded(P.slowest_models(G.run_results(spark, sf_dir), AS_OF, WIDE), "avg_execution_time")


@query("failing_resources", """
select resource_type, table_name, status, count(*) as failure_count, max(created_at) as last_failure
from run_results where status in ('error', 'fail') and created_at >= date '2001-07-03' group by 1, 2, 3""")
def _(spark, sf_dir):
    return P.failing_resources(G.run_results(spark, sf_dir), AS_OF, days=30)


@query("test_coverage", """
select strftime(created_at, '%Y-%m-%d') as run_date, count(*) filter (resource_type = 'test') as tests_run,
  count(*) filter (resource_type = 'test' and status = 'success') as tests_passed,
  count(*) filter (resource_type = 'model') as models_run
from run_results where created_at >= date '1994-09-28' group by 1""")
def _(spark, sf_dir):
    return _day_as_text(P.test_coverage(G.run_results(spark, sf_dir), AS_OF, WIDE))


@query("data_volume", """
select table_name, strftime(created_at, '%Y-%m-%d') as run_date, sum(rows_affected)::bigint as total_rows,
  sum(bytes_processed)::bigint as total_bytes
from run_results where resource_type = 'model' and status = 'success' and created_at >= date '1994-09-28'
group by 1, 2""")
def _(spark, sf_dir):
    return _day_as_text(P.data_volume(G.run_results(spark, sf_dir), AS_OF, WIDE))


RUN_RECORDS = """
select concat(invocation_id, '.', table_name) as result_id, invocation_id, table_name as unique_id,
  cast(null as varchar) as database_name, cast(null as varchar) as schema_name, table_name, resource_type,
  status, execution_time, rows_affected, bytes_processed, created_at
from run_results"""


def _records(spark, sf_dir):
    return G.run_results(spark, sf_dir).withColumn("unique_id", F.col("table_name"))


def _zoneless(df):
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("empty_typed_table", RUN_RECORDS)
def _(spark, sf_dir):
    """Records put under the schema of the empty typed table."""
    return _zoneless(P.as_run_results(_records(spark, sf_dir)))


@query("append_run_results", RUN_RECORDS)
def _(spark, sf_dir):
    path = scratch_path(spark, "run-results")
    P.append_run_results(_records(spark, sf_dir), path)
    return _zoneless(spark.read.parquet(path))


@query("materialize_model", """
select strftime(created_at, '%Y-%m-%d') as run_date, count(*) filter (resource_type = 'test') as tests_run,
  count(*) filter (resource_type = 'test' and status = 'success') as tests_passed,
  count(*) filter (resource_type = 'model') as models_run
from run_results where created_at >= date '1994-09-28' group by 1""")
def _(spark, sf_dir):
    coverage = P.test_coverage(G.run_results(spark, sf_dir), AS_OF, WIDE)
    return _day_as_text(P.materialize(coverage, scratch_path(spark, "model")))


@query("run_model", """
select 'model' as resource_type, 'success' as status, 2::bigint as resource_count,
  (select count(*) from security_events) + (select count(distinct src_ip) from security_events) as total_rows_affected
union all select 'model', 'error', 1, 0""")
def _(spark, sf_dir):
    """Three models built and recorded, one of them broken; the run statistics of the records."""
    root, results = scratch_path(spark, "models"), scratch_path(spark, "run-results")
    P.run_models(spark, {
        "events": lambda: G.security_events(spark, sf_dir),
        "sources": lambda: G.security_events(spark, sf_dir).select("src_ip").distinct(),
        "broken": lambda: G.security_events(spark, sf_dir).select(F.raise_error(F.lit("no")).alias("x")),
    }, root, results)
    recorded = spark.read.parquet(results)
    stats = P.run_stats(recorded, datetime.now(timezone.utc).replace(tzinfo=None))
    return stats.groupBy("resource_type", "status").agg(
        F.sum("resource_count").alias("resource_count"), F.sum("total_rows_affected").alias("total_rows_affected"))
