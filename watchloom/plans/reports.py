"""Monitoring reports (named queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators import detections as D
from watchloom.operators import reports as R
from watchloom.plans.registry import query
from watchloom.sources import given as G

NOW = G.LAST_INSTANT
SENSOR_NOW = G.LAST_SENSOR_INSTANT

THREATS = (
    "('ssh_login_failure', 'rdp_login_failure', 'brute_force_attack', 'rdp_brute_force', "
    "'sql_injection_attempt', 'malware_detection', 'data_exfiltration', 'rdp_reconnaissance')"
)


@query("events_over_time", f"""
select date_trunc('hour', time_dt) as time_bucket, original_event_type, count(*) as event_count
from security_events
where original_event_type in {THREATS} and time_dt >= timestamp '2024-01-30 00:00:00'
group by all""")
def _(spark, sf_dir):
    return R.events_over_time(G.security_events(spark, sf_dir), NOW)


@query("top_attackers", f"""
select src_ip, count(*) as total_attacks, count(distinct original_event_type) as attack_types,
  string_agg(distinct original_event_type, ', ' order by original_event_type) as attack_methods
from security_events
where original_event_type in {THREATS} and time_dt >= timestamp '2024-01-24 00:00:00'
group by src_ip having count(*) > 5
order by total_attacks desc, src_ip limit 20""")
def _(spark, sf_dir):
    return R.top_attackers(G.security_events(spark, sf_dir), NOW)


@query("outcome_rates", """
with c as (
  select case when original_event_type like '%_success' then 'Successful Attacks'
      when original_event_type like '%_failure' or original_event_type in
        ('brute_force_attack', 'rdp_brute_force', 'sql_injection_attempt') then 'Failed Attacks'
      else 'Other Malicious Activity' end as attack_outcome, count(*) as count
  from security_events where time_dt >= timestamp '2024-01-30 00:00:00' group by 1)
select attack_outcome, count,
  cast((20000 * count + sum(count) over ()) // (2 * sum(count) over ()) as double) / 100 as percentage
from c""")
def _(spark, sf_dir):
    return R.outcome_rates(G.security_events(spark, sf_dir), NOW)


@query("brute_force_heatmap", """
select cast(extract(dow from time_dt) as int) as day_of_week,
  cast(extract(hour from time_dt) as int) as hour_of_day, count(*) as attack_count
from security_events
where original_event_type in ('brute_force_attack', 'rdp_brute_force', 'ssh_login_failure', 'rdp_login_failure')
  and time_dt >= timestamp '2024-01-24 00:00:00'
group by 1, 2""")
def _(spark, sf_dir):
    return R.brute_force_heatmap(G.security_events(spark, sf_dir), NOW)


@query("targeted_services", """
select case dst_port when 22 then 'SSH (22)' when 3389 then 'RDP (3389)' when 80 then 'HTTP (80)'
    when 443 then 'HTTPS (443)' when 445 then 'SMB (445)' else concat('Port ', dst_port) end as service,
  original_event_type, count(*) as attack_count
from ported_events
where dst_port is not null and time_dt >= timestamp '2024-01-30 00:00:00'
  and original_event_type in ('ssh_login_failure', 'rdp_login_failure', 'brute_force_attack',
    'rdp_brute_force', 'sql_injection_attempt', 'file_access')
group by 1, 2""")
def _(spark, sf_dir):
    return R.targeted_services(G.security_events_with_port(spark, sf_dir), NOW)


@query("sqli_trend", """
select date_trunc('hour', ts) as time_bucket, id_orig_h as attacker_ip, count(*) as injection_attempts
from sensor_http
where regexp_matches(url_decode(replace(uri, '+', '%2B')),
    'union.*select|drop.*table|insert.*into|select.*from|delete.*from|update.*set|exec|script|onload|onerror|eval\\(|system\\(|cmd', 'i')
group by all""")
def _(spark, sf_dir):
    notices = D.detect_injection(G.sensor_http(spark, sf_dir))
    return R.injection_trend(notices, NOW, hours=24 * 31)


@query("protocol_violations", """
select analyzer_name as protocol, cause as violation_type, count(*) as violation_count,
  count(distinct id_orig_h) as unique_sources
from sensor_analyzer where ts >= timestamp '2001-08-07 00:00:00'
group by 1, 2 having count(*) > 5""")
def _(spark, sf_dir):
    return R.protocol_violations(G.sensor_analyzer(spark, sf_dir), SENSOR_NOW, hours=24 * 90)


BUSY_FTP = """
select date_trunc('hour', ts) as time_bucket, id_orig_h as source_ip, id_resp_h as ftp_server, command,
  count(*) as transfer_count, count(distinct arg) as file_count
from sensor_ftp
where ts >= timestamp '1995-01-01 00:00:00' and command in ('STOR', 'RETR')
group by 1, 2, 3, 4 having count(*) > 1"""


@query("ftp_activity", BUSY_FTP)
def _(spark, sf_dir):
    return R.ftp_activity(G.sensor_ftp(spark, sf_dir), SENSOR_NOW, hours=24 * 2500, more_than=1)


@query("ftp_files", f"""
with b as ({BUSY_FTP})
select b.time_bucket, b.source_ip, b.ftp_server, b.command, f.arg as file, count(*) as file_transfers
from b join sensor_ftp f on b.time_bucket = date_trunc('hour', f.ts) and b.source_ip = f.id_orig_h
  and b.ftp_server = f.id_resp_h and b.command = f.command
where f.ts >= timestamp '1995-01-01 00:00:00' group by all""")
def _(spark, sf_dir):
    return R.ftp_files(G.sensor_ftp(spark, sf_dir), SENSOR_NOW, hours=24 * 2500, more_than=1)


@query("attack_origins", """
select src_ip, count(*) as total_attacks, count(distinct dst_ip) as targets_hit,
  string_agg(distinct original_event_type, ', ' order by original_event_type) as attack_types,
  max(time_dt) as last_seen
from security_events
where original_event_type in ('ssh_login_failure', 'rdp_login_failure', 'brute_force_attack',
    'rdp_brute_force', 'sql_injection_attempt', 'malware_detection')
  and time_dt >= timestamp '2024-01-24 00:00:00'
group by src_ip having count(*) > 10""")
def _(spark, sf_dir):
    return R.attack_origins(G.security_events(spark, sf_dir), NOW)


@query("account_risk", """
with u as (
  select user_name, count(*) as total_events,
    sum((original_event_type like '%_failure')::int) as failed,
    sum((original_event_type like '%_success')::int) as succeeded,
    count(distinct src_ip) as unique_source_ips, count(distinct dst_ip) as unique_targets,
    min(time_dt) as first_seen, max(time_dt) as last_seen
  from security_events
  where user_name is not null and time_dt >= timestamp '2024-01-24 00:00:00' group by 1)
select user_name, total_events, cast(failed as bigint) as failed_attempts,
  cast(succeeded as bigint) as successful_logins, unique_source_ips, unique_targets,
  if(failed > 20, 'HIGH', if(failed > 10, 'MEDIUM', 'LOW')) as risk_level, first_seen, last_seen
from u where total_events > 5""")
def _(spark, sf_dir):
    return R.account_risk(G.security_events(spark, sf_dir), NOW, hours=24 * 7)


@query("conn_anomalies", """
select id_orig_h as source_ip, id_resp_h as dest_ip, id_resp_p as dest_port, service,
  count(*) as connection_count, cast(sum(orig_bytes) as bigint) as total_bytes_sent,
  cast(sum(resp_bytes) as bigint) as total_bytes_received, round(avg(duration), 4) as avg_duration,
  case when count(*) > 1000 then 'High Volume' when sum(orig_bytes) > 1000000 then 'Large Upload'
    when sum(resp_bytes) > 1000000 then 'Large Download' when avg(duration) > 3600 then 'Long Duration'
    else 'Normal' end as anomaly_type
from sensor_conn where ts >= timestamp '2001-01-09 00:00:00' and proto = 'tcp'
group by 1, 2, 3, 4
having count(*) > 50 or sum(orig_bytes) > 100000 or sum(resp_bytes) > 100000""")
def _(spark, sf_dir):
    found = R.conn_anomalies(G.sensor_conn(spark, sf_dir), SENSOR_NOW, hours=24 * 300)
    return found.withColumn("avg_duration", F.round("avg_duration", 4))


TIMELINE = """
select src_ip, dst_ip, user_name, time_dt, event_id, original_event_type from security_events
where time_dt >= timestamp '2024-01-24 00:00:00' and original_event_type in ('ssh_login_failure',
  'rdp_login_failure', 'brute_force_attack', 'rdp_brute_force', 'ssh_login_success', 'rdp_login_success')"""


@query("attack_timeline", f"""
select src_ip, dst_ip, user_name, min(time_dt) as session_start, max(time_dt) as session_end,
  count(*) as events_in_session,
  (epoch_us(max(time_dt)) - epoch_us(min(time_dt))) / 1e6 as session_duration_seconds
from ({TIMELINE}) group by 1, 2, 3 having count(*) > 3""")
def _(spark, sf_dir):
    return R.attack_timeline(G.security_events(spark, sf_dir), NOW, hours=24 * 7)


@query("attack_steps", f"""
with t as (select *, count(*) over g as n, row_number() over (g order by time_dt, event_id) as position
  from ({TIMELINE}) window g as (partition by src_ip, dst_ip, user_name))
select src_ip, dst_ip, user_name, position, time_dt, original_event_type from t where n > 3""")
def _(spark, sf_dir):
    return R.attack_steps(G.security_events(spark, sf_dir), NOW, hours=24 * 7)


@query("threat_feed", f"""
select time_dt, src_ip as "Source IP", dst_ip as "Target IP", user_name as "User",
  original_event_type as "Attack Type",
  case when original_event_type in ('malware_detection', 'data_exfiltration') then 'CRITICAL'
    when original_event_type in ('rdp_brute_force', 'brute_force_attack') then 'HIGH'
    when original_event_type in ('sql_injection_attempt', 'rdp_reconnaissance') then 'MEDIUM'
    else 'LOW' end as "Severity"
from security_events
where time_dt >= timestamp '2024-01-30 00:00:00' and original_event_type in {THREATS}
order by time_dt desc, event_id desc limit 100""")
def _(spark, sf_dir):
    return R.threat_feed(G.security_events(spark, sf_dir), NOW, hours=24)


@query("weekly_summary", """
with f as (select *, time_dt >= timestamp '2024-01-24 00:00:00' as recent from security_events
  where original_event_type not like '%_success' and time_dt >= timestamp '2024-01-17 00:00:00')
select 'This Week' as period, count(*) as total_security_events, count(distinct src_ip) as unique_attackers,
  count(distinct dst_ip) as unique_targets, count(distinct user_name) as affected_users,
  count(case when original_event_type like '%_success' then 1 end) as successful_attacks,
  count(case when original_event_type in ('malware_detection', 'data_exfiltration') then 1 end) as critical_incidents,
  round(count(case when original_event_type like '%_success' then 1 end) * 100.0 / nullif(count(*), 0), 2)::double
    as attack_success_rate
from f where recent
union all
select 'Previous Week', count(*), count(distinct src_ip), count(distinct dst_ip), count(distinct user_name),
  count(case when original_event_type like '%_success' then 1 end),
  count(case when original_event_type in ('malware_detection', 'data_exfiltration') then 1 end),
  round(count(case when original_event_type like '%_success' then 1 end) * 100.0 / nullif(count(*), 0), 2)::double
from f where not recent""")
def _(spark, sf_dir):
    return R.weekly_summary(G.security_events(spark, sf_dir), NOW)


# The as-of instant is the noon of the last day, so that "today" has events.
@query("user_anomaly", """
with daily as (
  select user_name, cast(time_dt as date) as event_date, count(*) as daily_events
  from security_events
  where time_dt >= timestamp '2023-12-31 12:00:00' and time_dt < timestamp '2024-01-29 12:00:00'
  group by 1, 2),
base as (
  select user_name, avg(daily_events) as a, stddev(daily_events) as s from daily
  group by 1 having count(*) >= 7),
today as (
  select user_name, count(*) as today_events from security_events
  where cast(time_dt as date) = date '2024-01-30' group by 1)
select user_name, today_events, round(a, 6) as avg_daily_events,
  case when today_events > a + 2 * s then 'HIGH_ANOMALY' when today_events > a + s then 'MEDIUM_ANOMALY'
    else 'NORMAL' end as anomaly_level,
  round((today_events - a) / nullif(s, 0), 2) as z_score
from today join base using (user_name) where today_events > a + s""")
def _(spark, sf_dir):
    found = R.user_anomaly(G.security_events(spark, sf_dir), "2024-01-30 12:00:00")
    return found.withColumn("avg_daily_events", F.round("avg_daily_events", 6))
