"""Rule-based detections (named queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.expressions import sorted_text
from watchloom.operators import detections as D
from watchloom.plans.registry import query
from watchloom.sources import given as G

SUSPECT = (
    "'union.*select|drop.*table|insert.*into|select.*from|delete.*from|update.*set|exec|script|"
    "javascript|vbscript|onload|onerror|eval\\(|system\\(|cmd'"
)


@query("detect_injection", f"""
with p as (select *, url_decode(replace(uri, '+', '%2B')) as plain from sensor_http)
select ts, 'HTTP::SQL_Injection_Attacker' as note,
  'Potential SQL injection or code injection: ' || plain as msg, id_orig_h as src, uid
from p where regexp_matches(plain, {SUSPECT}, 'i')""")
def _(spark, sf_dir):
    return D.detect_injection(G.sensor_http(spark, sf_dir))


@query("detect_dns", """
select ts, 'DNS::External_Name' as note, 'Suspicious DNS query: ' || query as msg, id_orig_h as src, uid
from sensor_dns
where query like '%.evil.%' or query like '%.bad.%' or query like '%.malware.%' or query like '%.botnet.%'
  or query like '%.phishing.%'""")
def _(spark, sf_dir):
    return D.detect_dns(G.sensor_dns(spark, sf_dir))


@query("detect_bruteforce", """
with f as (
  select event_id, src_ip, time_dt, count(*) over (partition by src_ip order by time_dt
    range between interval 30 minutes preceding and current row) as guesses
  from security_events where original_event_type like '%_failure')
select event_id, src_ip, time_dt, guesses from f where guesses >= 3""")
def _(spark, sf_dir):
    found = D.detect_bruteforce(G.security_events(spark, sf_dir))
    return found.select("event_id", "src_ip", "time_dt", "guesses")


@query("fail_then_success", """
with f as (
  select event_id, user_name, time_dt, original_event_type,
    count(*) filter (original_event_type like '%_failure') over (partition by user_name order by time_dt
      range between interval 24 hours preceding and current row) as earlier_failures
  from security_events
  where original_event_type like '%_failure' or original_event_type like '%_success')
select event_id, user_name, time_dt, earlier_failures from f
where original_event_type like '%_success' and earlier_failures >= 3""")
def _(spark, sf_dir):
    found = D.fail_then_success(G.security_events(spark, sf_dir), window_seconds=86400)
    return found.select("event_id", "user_name", "time_dt", "earlier_failures")


@query("known_hosts", """
select host, min(ts) as ts from (select id_orig_h as host, ts from sensor_conn
  union all select id_resp_h, ts from sensor_conn) group by host""")
def _(spark, sf_dir):
    return D.known_hosts(G.sensor_conn(spark, sf_dir))


@query("known_services", """
select id_resp_h as host, id_resp_p as port_num, proto as port_proto, service, min(ts) as ts
from sensor_conn group by 1, 2, 3, 4""")
def _(spark, sf_dir):
    return D.known_services(G.sensor_conn(spark, sf_dir))


@query("port_scan", """
select time_bucket(interval 7 days, ts, timestamp '1970-01-01') as window_start, id_orig_h as source_ip,
  id_resp_h as dest_ip, count(distinct id_resp_p) as ports, count(*) as connections
from sensor_conn group by 1, 2, 3 having count(distinct id_resp_p) >= 2""")
def _(spark, sf_dir):
    return D.port_scan(G.sensor_conn(spark, sf_dir), window="7 days", min_ports=2)


@query("exfil_volume", """
select id_orig_h as source_ip, sum(orig_bytes)::bigint as bytes_sent, count(*) as connections
from sensor_conn where ts >= timestamp '2001-01-09 00:00:00' group by 1 having sum(orig_bytes) > 1000000""")
def _(spark, sf_dir):
    return D.exfil_volume(G.sensor_conn(spark, sf_dir), G.LAST_SENSOR_INSTANT, hours=24 * 300)


@query("weird_summary", """
select name, peer, count(*) as occurrences from sensor_weird group by 1, 2""")
def _(spark, sf_dir):
    return D.weird_summary(G.sensor_weird(spark, sf_dir))


@query("conn_counters", """
with h as (select date_trunc('hour', ts) as hour, count(*) as connections, sum(orig_pkts)::bigint as packets
  from sensor_conn group by 1),
t as (select *, sum(connections) over (order by hour)::bigint as connections_so_far,
  sum(packets) over (order by hour)::bigint as packets_so_far from h)
select *, connections_so_far // 10 - (connections_so_far - connections) // 10 as connection_messages,
  packets_so_far // 100 - (packets_so_far - packets) // 100 as packet_messages
from t""")
def _(spark, sf_dir):
    return D.conn_counters(G.sensor_conn(spark, sf_dir))


TRIAGE = """
with t as (
  select src_ip, original_event_type as e, count(*) as n, min(time_dt) as first_at, max(time_dt) as last_at,
    case when e like '%exfiltration%' or e like '%hijack%' then 4
      when e like '%malware%' or e like '%rdp_login_success%' then 3
      when regexp_matches(e, 'failure|brute_force|injection|reconnaissance') then 2 else 1 end as r,
    case when e like 'ssh%' or e = 'brute_force_attack' then 'SSH (22)'
      when e like 'rdp%' then 'RDP (3389)' when e = 'file_access' then 'SMB (445)'
      when e in ('malware_detection', 'data_exfiltration') then 'HTTPS (443)' else 'HTTP (80)' end as service
  from security_events group by 1, 2),
top as (select src_ip, max(r) as r from t group by 1),
lead as (select t.src_ip, t.e, row_number() over (partition by t.src_ip order by t.n desc, t.e) as k
  from t join top on t.src_ip = top.src_ip and t.r = top.r),
f as (select t.src_ip, top.r, sum(n)::bigint as event_count, min(first_at) as time_start, max(last_at) as time_end,
    sum(n) filter (t.r = top.r)::bigint as deciding, string_agg(distinct t.e, ', ' order by t.e) as indicators,
    string_agg(distinct service, ', ' order by service) as affected_services
  from t join top on t.src_ip = top.src_ip group by 1, 2)
select case f.r when 4 then 'critical' when 3 then 'high' when 2 then 'medium' else 'low' end as priority,
  replace(lead.e, '_', ' ') as threat_type, f.src_ip as source_ip,
  (select count(distinct dst_ip) from security_events s where s.src_ip = f.src_ip) as target_count,
  concat(deciding, ' x ', replace(lead.e, '_', ' ')) as attack_pattern, time_start, time_end, indicators,
  round(0.5 + 0.5 * deciding / event_count, 4) as confidence_score, event_count, affected_services,
  concat(upper(priority), ': ', threat_type, ' from ', f.src_ip, ', ', event_count, ' events') as brief_summary
from f join lead on lead.src_ip = f.src_ip and lead.k = 1"""


def flat_findings(found):
    """Findings as plain columns."""
    return found.select(
        "priority", "threat_type", "source_ip",
        "target_count",
        "attack_pattern",
        F.col("timeline.start").alias("time_start"),
        F.col("timeline.end").alias("time_end"),
        sorted_text(F.col("indicators")).alias("indicators"),
        "confidence_score", "event_count",
        sorted_text(F.col("affected_services")).alias("affected_services"),
        "brief_summary",
    )


@query("triage_findings", TRIAGE)
def _(spark, sf_dir):
    return flat_findings(D.triage_findings(G.security_events(spark, sf_dir)))


@query("triage_targets", """
select src_ip as source_ip, dst_ip as target_host, count(*) as events from security_events group by 1, 2""")
def _(spark, sf_dir):
    return D.triage_targets(G.security_events(spark, sf_dir))


@query("tag_documents", """
select doc_id, if(contains(lower(document), 'brute force'), 'credential attacks',
    if(contains(lower(document), 'data exfiltration'), 'data exfiltration', '')) as indicators,
  case when contains(document, ' ssh ') then 'SSH exploitation'
    when contains(document, ' rdp ') then 'RDP attacks' else '' end as techniques,
  '' as systems
from incident_docs""")
def _(spark, sf_dir):
    tagged = D.tag_documents(G.incident_docs(spark, sf_dir))
    return tagged.select(
        "doc_id", *[F.array_join(c, ", ").alias(c) for c in ("indicators", "techniques", "systems")]
    )


@query("pattern_summary", """
with n as (select count(*) as docs, count(*) filter (document like '%brute force%') as brute,
  count(*) filter (document like '%data exfiltration%') as exfil from incident_docs)
select docs as documents,
  case when brute >= exfil then
    'Historical incidents show pattern of credential attacks with ' || brute || ' similar cases'
  else 'Historical incidents show pattern of data exfiltration with ' || exfil || ' similar cases' end as pattern_summary,
  'Multiple attack vectors observed: RDP attacks, SSH exploitation' as correlations, '' as attack_patterns,
  'Implement multi-factor authentication and account lockout policies' as recommendations,
  'low' as confidence, 'Based on ' || docs || ' historical incidents spanning multiple timeframes' as timeline_insights
from n""")
def _(spark, sf_dir):
    summary = D.pattern_summary(G.incident_docs(spark, sf_dir))
    return summary.withColumns(
        {c: F.array_join(c, " | ") for c in ("correlations", "attack_patterns", "recommendations")}
    )
