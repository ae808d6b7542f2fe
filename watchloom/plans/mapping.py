"""Normalisation, validation, routing and views (named queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.expressions import bind
from watchloom.functions import mapping as M
from watchloom.functions import values as V
from watchloom.operators import event_rules as R
from watchloom.operators import normalize as N
from watchloom.operators import sensor as SN
from watchloom.operators import views as VW
from watchloom.plans.registry import query
from watchloom.sinks import tables as K
from watchloom.session import scratch_path
from watchloom.sources import files, given as G

EVENT = "event"
ID = ("event_id",)


def _parsed(spark, sf_dir):
    return N.parsed_lines(files.spread(G.log_lines(spark, sf_dir)))


def _normalized(spark, sf_dir):
    return N.normalize(_parsed(spark, sf_dir), ID)


def _event_json(spark, sf_dir):
    """Normalised events as JSON text, some of them spoiled."""
    good = N.as_json(_normalized(spark, sf_dir), ID)
    number = F.col("event_id")
    spoiled = (
        F.when(number % 101 == 0, F.lit("{bad"))
        .when(number % 103 == 0, F.lit("[]"))
        .when(number % 107 == 0, F.regexp_replace("_good", '"severity_id":[0-9]+', '"severity_id":7'))
        .when(number % 109 == 0, F.regexp_replace("_good", '"class_uid":([0-9]+)', '"class_uid":"$1"'))
        .when(number % 113 == 0, F.regexp_replace("_good", '"vendor_name":"Custom",', ""))
        .otherwise(F.col("_good"))
    )
    return bind(good.withColumnRenamed("value", "_good"), value=spoiled).drop("_good")


# What the spoiled messages lead to, worked out from the number alone.
EVENT_OUTCOMES = """
e as (select *, case
    when original_event_type like 'ssh_login%' or original_event_type like 'web_login%' then 'Authentication'
    when original_event_type = 'file_access' then 'File System Activity'
    when original_event_type in ('malware_detection', 'data_exfiltration') then null
    else 'Detection Finding' end as class_caption,
    case when original_event_type like 'ssh_login%' or original_event_type like 'web_login%' then 'Authentication'
      when original_event_type = 'file_access' then 'File System Activity' else 'Security Finding' end as own_name
  from clean_events),
o as (select event_id, original_event_type, time_dt, user_name, src_ip, dst_ip, case
    when event_id % 101 = 0 or event_id % 103 = 0 then 'ERROR'
    when event_id % 107 = 0 or event_id % 109 = 0 or event_id % 113 = 0 or class_caption is null then 'SKIPPED'
    else 'SUCCESS' end as status,
  case when event_id % 101 = 0 or event_id % 103 = 0 then 'Unknown'
    when class_caption is null or (event_id % 109 = 0 and event_id % 107 <> 0) then own_name
    else class_caption end as kind
  from e)"""


@query("parse_log_line", """
select event_id, strftime(time_dt, '%Y-%m-%d %H:%M:%S.%f') as event_time, original_event_type as event,
  user_name as "user", src_ip, dst_ip from clean_events""")
def _(spark, sf_dir):
    parsed = _parsed(spark, sf_dir).drop("value")
    return parsed.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("src_log_lines", """
select event_id, value from log_lines where not (event_id % 97 <> 0 and event_id % 89 <> 0)""")
def _(spark, sf_dir):
    """Lines read back from text files; what the pattern rejects is kept apart."""
    path = scratch_path(spark, "log-lines")
    lines = G.log_lines(spark, sf_dir)
    lines.select(F.concat_ws("\t", F.col("event_id").cast("string"), "value").alias("value")).write.text(path)
    read = files.log_file(spark, path).select(
        F.split("value", "\t")[0].cast("bigint").alias("event_id"), F.split("value", "\t")[1].alias("value")
    )
    return N.rejected_lines(read)


MAPPED = {
    "map_class_uid": ("class_uid", M.class_uid, """case when {e} like 'ssh_login%' or {e} like 'web_login%' then 3002
      when {e} = 'malware_detection' then 2001 when {e} = 'data_exfiltration' then 4002
      when {e} = 'file_access' then 1001 else 2004 end"""),
    "map_type_uid": ("type_uid", M.type_uid, """case when {e} in ('ssh_login_success', 'web_login_success') then 300201
      when {e} in ('ssh_login_failure', 'web_login_failure') then 300202 when {e} = 'malware_detection' then 200101
      when {e} = 'data_exfiltration' then 400202 when {e} = 'file_access' then 100101 else 200402 end"""),
    "map_activity_id": ("activity_id", M.activity_id, """case when {e} like '%success%' then 1
      when regexp_matches({e}, 'failure|attack|injection|malware|exfiltration') then 2 else 99 end"""),
    "map_severity_id": ("severity_id", M.severity_id, """case when {e} like '%success%' then 1
      when {e} like '%failure%' then 2 when regexp_matches({e}, 'brute_force|injection') then 3
      when regexp_matches({e}, 'malware|exfiltration') then 4 else 2 end"""),
    "map_status_id": ("status_id", M.status_id, """case when {e} like '%success%' then 1
      when regexp_matches({e}, 'failure|attack|injection|malware|exfiltration') then 2 else 99 end"""),
}


def _register_mapped(key, column, make, rule):
    sql = f"""select event_id, {rule.format(e='original_event_type')} as {column} from clean_events"""

    @query(key, sql)
    def _(spark, sf_dir):
        return _parsed(spark, sf_dir).select("event_id", make(F.col(EVENT)).alias(column))


for _key, (_column, _make, _rule) in MAPPED.items():
    _register_mapped(_key, _column, _make, _rule)


@query("map_category", """
select event_id, u as category_uid, case u when 1 then 'System Activity' when 2 then 'Findings'
  when 3 then 'Identity & Access Management' else 'Network Activity' end as category_name
from (select event_id, case when original_event_type like '%login%' then 3 when original_event_type like '%file%' then 1
  when regexp_matches(original_event_type, 'attack|injection|malware|exfiltration') then 2 else 4 end as u
  from clean_events)""")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "event_id", M.category_uid(F.col(EVENT)).alias("category_uid"), M.category_name(F.col(EVENT)).alias("category_name")
    )


@query("map_names", """
select event_id, case when original_event_type like 'ssh_login%' or original_event_type like 'web_login%'
    then 'Authentication' when original_event_type = 'file_access' then 'File System Activity'
    else 'Security Finding' end as class_name,
  case when original_event_type like '%success%' then 'Allow'
    when regexp_matches(original_event_type, 'failure|attack|injection|malware|exfiltration') then 'Deny'
    else 'Unknown' end as activity_name,
  case when original_event_type like 'ssh_login%' then 'SSH Authentication'
    when original_event_type like 'web_login%' then 'Web Authentication'
    when original_event_type like '%brute_force%' then 'Brute Force Attack'
    when original_event_type like 'sql%' then 'SQL Injection' when original_event_type like 'mal%' then 'Malware Detection'
    when original_event_type like 'data%' then 'Data Exfiltration'
    when original_event_type like 'file%' then 'File Access' else 'Security Event' end as type_name
from clean_events""")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "event_id", M.class_name(F.col(EVENT)).alias("class_name"),
        M.activity_name(F.col(EVENT)).alias("activity_name"), M.type_name(F.col(EVENT)).alias("type_name"),
    )


@query("build_finding_info", """
select event_id, 'Security event: ' || original_event_type as title,
  original_event_type || '_' || epoch_us(time_dt) // 1000000 as uid,
  'Security event detected from ' || user_name || ' (' || src_ip || ' -> ' || dst_ip || ')' as "desc"
from clean_events""")
def _(spark, sf_dir):
    return _normalized(spark, sf_dir).select("event_id", "finding_info.*")


@query("build_actor_endpoints", """
select event_id, user_name as name, 'User' as type, user_name as uid, src_ip, 'Unknown' as src_type, dst_ip,
  'Unknown' as dst_type from clean_events""")
def _(spark, sf_dir):
    return _normalized(spark, sf_dir).select(
        "event_id", "actor.user.*",
        F.col("src_endpoint.ip").alias("src_ip"), F.col("src_endpoint.type").alias("src_type"),
        F.col("dst_endpoint.ip").alias("dst_ip"), F.col("dst_endpoint.type").alias("dst_type"),
    )


@query("event_time_fields", """
select event_id, epoch_us(time_dt) // 1000000 as time,
  strftime(time_dt, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(time_dt, '%f'), 1, 3) || 'Z' as time_dt
from clean_events""")
def _(spark, sf_dir):
    return _normalized(spark, sf_dir).select("event_id", "time", "time_dt")


@query("build_message_raw", """
select event_id, 'Security event: ' || original_event_type || ' from ' || user_name || ' (' || src_ip || ' -> '
    || dst_ip || ')' as message,
  cast(json_object('original_event_type', original_event_type, 'user_name', user_name, 'src_ip', src_ip,
    'dst_ip', dst_ip) as varchar) as raw_data
from clean_events""")
def _(spark, sf_dir):
    return _normalized(spark, sf_dir).select("event_id", "message", "raw_data")


@query("build_metadata", """
select event_id, '1.0.0' as version, 'Traffic Simulator' as product_name, 'Custom' as vendor_name,
  '1.0' as product_version, 'traffic-simulator-001' as product_uid, 'security_control' as profiles
from clean_events""")
def _(spark, sf_dir):
    meta, product = F.col("metadata"), F.col("metadata.product")
    return _normalized(spark, sf_dir).select(
        "event_id", meta["version"].alias("version"), product["name"].alias("product_name"),
        product["vendor_name"].alias("vendor_name"), product["version"].alias("product_version"),
        product["uid"].alias("product_uid"), F.array_join(meta["profiles"], ", ").alias("profiles"),
    )


# --- events: routing, rules, tables -----------------------------------------------------


@query("route_ocsf", f"with {EVENT_OUTCOMES} select event_id, kind, status from o")
def _(spark, sf_dir):
    return R.judge_events(_event_json(spark, sf_dir)).select("event_id", "kind", "status")


@query("validate_ocsf", f"""
with {EVENT_OUTCOMES}
select event_id, case when event_id % 107 = 0 then 'invalid: severity_id' else 'invalid: metadata' end as reason
from o where status = 'SKIPPED' and original_event_type not in ('malware_detection', 'data_exfiltration')
  and not (event_id % 109 = 0 and event_id % 107 <> 0)""")
def _(spark, sf_dir):
    judged = R.judge_events(_event_json(spark, sf_dir))
    return judged.filter(F.col("reason").startswith("invalid: ")).select("event_id", "reason")


@query("src_ocsf_json", f"with {EVENT_OUTCOMES} select event_id, status from o")
def _(spark, sf_dir):
    """JSON messages written to and read from files, then judged."""
    path = scratch_path(spark, "event-json")
    _event_json(spark, sf_dir).select(
        F.concat_ws("\t", F.col("event_id").cast("string"), "value").alias("value")
    ).write.text(path)
    parts = F.split("value", "\t", 2)
    read = spark.read.text(path).select(parts[0].cast("bigint").alias("event_id"), parts[1].alias("value"))
    return R.judge_events(read).select("event_id", "status")


@query("ingest_outcomes", f"""
with {EVENT_OUTCOMES},
t as (select status, count(*) as n from o group by 1)
select 'total' as part, status as name, n as messages, cast((20000 * n + sum(n) over ()) // (2 * sum(n) over ()) as double) / 100 as percentage,
  cast(null as bigint) as success, cast(null as bigint) as skipped from t
union all
select 'kind', kind, null, null, count(*) filter (status = 'SUCCESS'), count(*) filter (status = 'SKIPPED')
from o where status <> 'ERROR' group by kind""")
def _(spark, sf_dir):
    return R.outcome_report(R.judge_events(_event_json(spark, sf_dir)))


@query("route_tables", f"""
with {EVENT_OUTCOMES}
select replace(lower(kind), ' ', '_') as table_name, count(*) as stored_rows, min(event_id) as first_id,
  max(event_id) as last_id from o where status = 'SUCCESS' group by 1""")
def _(spark, sf_dir):
    """Events written to one table per class and counted there."""
    root = scratch_path(spark, "routed")
    K.route_events(R.judge_events(_event_json(spark, sf_dir)), root, 0, keep=ID)
    return K.union_of_tables(spark, root, ["event_id"]).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("stored_rows"), F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


@query("ocsf_events_view", f"""
with {EVENT_OUTCOMES}
select o.event_id, date_trunc('milliseconds', o.time_dt) as time_dt, o.original_event_type, o.user_name, o.src_ip,
  o.dst_ip, p.dst_port from o join ported_events p on o.event_id = p.event_id where o.status = 'SUCCESS'""")
def _(spark, sf_dir):
    root = scratch_path(spark, "viewed")
    K.route_events(R.judge_events(_event_json(spark, sf_dir)), root, 0, keep=ID)
    tables = [K.read_table(spark, f"{root}/{R.table_name(n)}") for n in V.STORED_CLASSES.values()]
    return VW.security_view(tables, ID)


@query("ocsf_events_view_all", """
select event_id, date_trunc('milliseconds', time_dt) as time_dt, original_event_type, user_name, src_ip, dst_ip,
  dst_port from ported_events where event_id % 97 <> 0 and event_id % 89 <> 0""")
def _(spark, sf_dir):
    return VW.security_view_of_normalized(_normalized(spark, sf_dir), ID)


@query("latest_findings_json", """
with f as (select *, if(event_id % 7 = 0, 'abc', cast(json_object('original_event_type', original_event_type,
    'user_name', user_name, 'src_ip', src_ip, 'dst_ip', dst_ip) as varchar)) as raw_data
  from security_events order by time_dt desc, event_id desc limit 20)
select event_id, if(raw_data = 'abc', '{"raw_data":"abc","parse_error":"Not a valid JSON string"}',
  cast(json_object('original_event_type', original_event_type, 'user_name', user_name, 'src_ip', src_ip,
    'dst_ip', dst_ip, 'time_dt', strftime(time_dt, '%Y-%m-%dT%H:%M:%S.%f')) as varchar)) as finding
from f""")
def _(spark, sf_dir):
    events = G.security_events(spark, sf_dir)
    raw = M.raw_data(*[F.col(c) for c in ("original_event_type", "user_name", "src_ip", "dst_ip")])
    findings = events.select(
        "event_id", "time_dt", F.when(F.col("event_id") % 7 == 0, "abc").otherwise(raw).alias("raw_data")
    )
    return VW.latest_findings(findings, tie="event_id").select("event_id", "finding")


@query("class_catalogue", """
with c as (select event_id, case when original_event_type like 'ssh_login%' or original_event_type like 'web_login%' then 3002
    when original_event_type = 'malware_detection' then 2001 when original_event_type = 'data_exfiltration' then 4002
    when original_event_type = 'file_access' then 1001 else 2004 end as class_uid from clean_events)
select event_id, class_uid, case class_uid when 3002 then 'Authentication' when 2001 then 'Security Finding'
    when 4002 then 'HTTP Activity' when 1001 then 'File System Activity' else 'Detection Finding' end as class_caption,
  case class_uid // 1000 when 3 then 'Identity & Access Management' when 2 then 'Findings'
    when 4 then 'Network Activity' else 'System Activity' end as category_caption
from c""")
def _(spark, sf_dir):
    return VW.with_class_names(_normalized(spark, sf_dir)).select(
        "event_id", "class_uid", "class_caption", "category_caption"
    )


@query("enum_captions", """
select event_id, case when original_event_type like '%success%' then 'Informational'
    when original_event_type like '%failure%' then 'Low'
    when regexp_matches(original_event_type, 'brute_force|injection') then 'Medium'
    when regexp_matches(original_event_type, 'malware|exfiltration') then 'High' else 'Low' end as severity,
  case when original_event_type like '%success%' then 'New'
    when regexp_matches(original_event_type, 'failure|attack|injection|malware|exfiltration') then 'InProgress'
    else 'Other' end as status
from clean_events""")
def _(spark, sf_dir):
    return VW.caption_columns(_normalized(spark, sf_dir)).select("event_id", "severity", "status")


@query("type_uid_consistency", """
select event_id, original_event_type from clean_events
where original_event_type in ('file_access', 'malware_detection')
  or (original_event_type like 'rdp%' and original_event_type <> 'rdp_login_failure')""")
def _(spark, sf_dir):
    broken = VW.type_uid_violations(_normalized(spark, sf_dir))
    return broken.select(
        "event_id", F.get_json_object("raw_data", "$.original_event_type").alias("original_event_type")
    )


@query("doc_metadata_defaults", """
select event_id, if(event_id % 2 = 0, 'm' || event_id, 'doc_' || event_id) as document_id,
  if(event_id % 4 = 0, 'archive', 'vector_database') as source, 'security_incident' as category,
  'ssh_brute_force' as tags, if(event_id % 2 = 0, 'Retrieved via query: ssh brute force',
    'No additional metadata available') as additional_info
from security_events""")
def _(spark, sf_dir):
    number = F.col("event_id")
    named = F.create_map(F.lit("id"), F.concat(F.lit("m"), number.cast("string")))
    with_source = F.map_concat(named, F.create_map(F.lit("source"), F.lit("archive")))
    docs = G.security_events(spark, sf_dir).select(
        "event_id", F.when(number % 4 == 0, with_source).when(number % 2 == 0, named).alias("metadata")
    )
    return VW.document_metadata(docs, "ssh brute force", index="event_id").select(
        "event_id", "document_id", "source", "category", F.array_join("tags", ", ").alias("tags"),
        "additional_info",
    )


@query("prune_nested", """
select event_id, concat('{"event_id":', event_id, ',"actor":{"user":{"name":"', user_name, '"}}',
  if(event_id % 2 = 0, concat(',"targets":["', dst_ip, '"]'), ''), ',"note":""}') as doc
from security_events""")
def _(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    nothing = F.lit(None).cast("string")
    nested = G.security_events(spark, sf_dir).select(
        "event_id",
        F.struct(F.struct(F.col("user_name").alias("name"), nothing.alias("uid")).alias("user"),
                 F.struct(nothing.alias("id")).alias("session")).alias("actor"),
        F.array(F.when(even, F.col("dst_ip")), nothing).alias("targets"),
        F.lit("").alias("note"),
    )
    return VW.prune(nested).select("event_id", F.to_json(F.struct("*")).alias("doc"))


# --- sensor messages ----------------------------------------------------------------------


def _sensor_json(spark, sf_dir):
    """Tagged connection messages, some of them spoiled."""
    number = F.col("orig_bytes")
    payload = F.to_json(
        F.struct(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("ts"), "uid",
            F.col("id_orig_h").alias("id.orig_h"), F.col("id_resp_h").alias("id.resp_h"),
            F.when(number % 2 == 0, F.col("id_resp_p").cast("string")).alias("id.resp_p"),
            "proto", "service", "duration", "orig_bytes", "resp_bytes",
            F.lit(True).alias("local_orig"), F.lit(1).alias("not_a_field"),
        )
    )
    tagged = F.concat(F.lit('{"conn": '), payload, F.lit("}"))
    spoiled = (
        F.when(number % 101 == 0, F.lit("{bad"))
        .when(number % 103 == 0, F.lit("[]"))
        .when(number % 107 == 0, F.concat(F.lit('{"notice": '), payload, F.lit("}")))
        .when(number % 109 == 0, F.lit('{"conn": 3}'))
        .when(number % 113 == 0, F.lit('{"conn": {}}'))
        .when(number % 127 == 0, F.lit('{"conn": {"uid": 5}}'))
        .when(number % 131 == 0, F.lit('{"dns": {"answers": ["1.1.1.1"]}}'))
        .otherwise(tagged)
    )
    return bind(files.spread(G.sensor_conn(spark, sf_dir)), value=spoiled).select("uid", "value")


SENSOR_OUTCOMES = """
o as (select *, case when orig_bytes % 101 = 0 then 'ERROR' when orig_bytes % 103 = 0 or orig_bytes % 107 = 0
      or orig_bytes % 109 = 0 then 'SKIPPED' when orig_bytes % 113 = 0 then 'ERROR'
    when orig_bytes % 127 = 0 or orig_bytes % 131 = 0 then 'SKIPPED' else 'SUCCESS' end as status,
  case when orig_bytes % 101 = 0 or orig_bytes % 103 = 0 then 'unknown' when orig_bytes % 107 = 0 then 'notice'
    when orig_bytes % 109 = 0 or orig_bytes % 113 = 0 or orig_bytes % 127 = 0 then 'conn'
    when orig_bytes % 131 = 0 then 'dns' else 'conn' end as kind
  from sensor_conn)"""


@query("sensor_envelope", f"with {SENSOR_OUTCOMES} select uid, kind from o")
def _(spark, sf_dir):
    return SN.with_envelope(_sensor_json(spark, sf_dir)).select("uid", "kind")


@query("sensor_type_filter", f"with {SENSOR_OUTCOMES} select uid, kind from o where kind not in ('unknown', 'notice')")
def _(spark, sf_dir):
    messages = SN.with_envelope(_sensor_json(spark, sf_dir))
    return messages.filter(F.col("kind").isin(V.SENSOR_LOG_TYPES)).select("uid", "kind")


@query("validate_sensor", f"""
with {SENSOR_OUTCOMES}
select uid, status, case when orig_bytes % 101 = 0 then 'invalid JSON' when orig_bytes % 103 = 0 then 'not a tagged object'
    when orig_bytes % 107 = 0 then 'unsupported log type' when orig_bytes % 109 = 0 then 'payload is not an object'
    when orig_bytes % 113 = 0 then 'nothing to write' when orig_bytes % 127 = 0 then 'invalid: uid'
    when orig_bytes % 131 = 0 then 'invalid: answers' end as reason from o""")
def _(spark, sf_dir):
    return SN.judge_sensor(_sensor_json(spark, sf_dir)).select("uid", "status", "reason")


@query("src_sensor_json", f"""
with {SENSOR_OUTCOMES}
select uid, ts, id_orig_h, id_resp_h, if(orig_bytes % 2 = 0, id_resp_p::bigint, null) as id_resp_p, proto, service,
  duration, orig_bytes, resp_bytes, true as local_orig from o where status = 'SUCCESS'""")
def _(spark, sf_dir):
    judged = SN.judge_sensor(_sensor_json(spark, sf_dir))
    table = SN.sensor_table(judged, "conn")
    return table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(
        "uid", "ts", "id_orig_h", "id_resp_h", "id_resp_p", "proto", "service", "duration", "orig_bytes",
        "resp_bytes", "local_orig",
    )


@query("rename_dotted", f"""
with {SENSOR_OUTCOMES} select uid, id_orig_h, id_resp_h from o where status = 'SUCCESS'""")
def _(spark, sf_dir):
    judged = SN.judge_sensor(_sensor_json(spark, sf_dir))
    return SN.sensor_table(judged, "conn").select("uid", "id_orig_h", "id_resp_h")


@query("normalize_ts", """
select event_id, time_dt as ts from security_events""")
def _(spark, sf_dir):
    """ISO text, seconds as text and seconds as number all give the same instant."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("time_dt"))
    fraction = F.lpad((micros % 1000000).cast("string"), 6, "0")
    seconds = F.concat(F.floor(micros / 1000000).cast("string"), F.lit("."), fraction)
    iso = F.concat(F.date_format("time_dt", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    number = F.col("event_id") % 3
    ts = (
        F.when(number == 0, F.concat(F.lit('"'), iso, F.lit('"')))
        .when(number == 1, F.concat(F.lit('"'), seconds, F.lit('"')))
        .otherwise(seconds)
    )
    messages = G.security_events(spark, sf_dir).select(
        "event_id", F.concat(F.lit('{"known_hosts": {"ts": '), ts, F.lit("}}")).alias("value")
    )
    table = SN.sensor_table(SN.judge_sensor(messages), "known_hosts", ID)
    return table.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("dead_letter", f"""
with {SENSOR_OUTCOMES} select uid, status, kind from o where status <> 'SUCCESS'""")
def _(spark, sf_dir):
    return K.dead_letters(SN.judge_sensor(_sensor_json(spark, sf_dir)), ("uid",)).select("uid", "status", "kind")
