"""SQL text of the shaped tables, used as common table expressions by oracles."""

from __future__ import annotations

import re

VIEWS = {
    "security_events": """
select event_id, ts as time_dt, concat('user', user_id) as user_name,
  concat('192.168.100.', 10 + user_id % 10) as src_ip,
  concat('192.168.100.', 20 + cast(json_extract_string(props, '$.k') as int) % 10) as dst_ip,
  case event_type
    when 'click' then case event_id % 2 when 0 then 'ssh_login_success' else 'web_login_success' end
    when 'view' then case event_id % 2 when 0 then 'file_access' else 'rdp_login_success' end
    when 'error' then case event_id % 3 when 0 then 'ssh_login_failure'
      when 1 then 'rdp_login_failure' else 'web_login_failure' end
    when 'signup' then case event_id % 4 when 0 then 'brute_force_attack'
      when 1 then 'rdp_brute_force' when 2 then 'sql_injection_attempt' else 'rdp_reconnaissance' end
    else case event_id % 3 when 0 then 'malware_detection'
      when 1 then 'data_exfiltration' else 'rdp_session_hijack' end
  end as original_event_type
from events""",
    "event_ports": """
select * from (values ('ssh_login_success', 22), ('ssh_login_failure', 22), ('web_login_success', 80),
  ('web_login_failure', 80), ('file_access', 445), ('brute_force_attack', 22),
  ('sql_injection_attempt', 80), ('malware_detection', 443), ('data_exfiltration', 443),
  ('rdp_login_success', 3389), ('rdp_login_failure', 3389), ('rdp_brute_force', 3389),
  ('rdp_reconnaissance', 3389), ('rdp_session_hijack', 3389)) as p(event_name, port)""",
    "ported_events": """
select s.*, coalesce(p.port, 22) as dst_port
from security_events s left join event_ports p on s.original_event_type = p.event_name""",
    "log_lines": """
select event_id, concat(case when event_id % 97 = 0 then 'garbage ' else '' end,
  case when event_id % 89 = 0 then strftime(time_dt, '%Y-%m-%d %H:%M:%S')
    else strftime(time_dt, '%Y-%m-%d %H:%M:%S.%f') end,
  ' event=', original_event_type, ' user=', user_name, ' src_ip=', src_ip, ' dst_ip=', dst_ip,
  case when event_id % 83 = 0 then ' extra=1' else '' end) as value
from security_events""",
    # Lines which the parser accepts: neither damaged at the start nor without a fraction.
    "clean_events": """
select * from security_events where event_id % 97 <> 0 and event_id % 89 <> 0""",
    "sensor_conn": """
select concat('C', l_orderkey, '-', l_linenumber) as uid, l_shipdate as ts,
  concat('10.0.0.', l_suppkey % 50) as id_orig_h, concat('10.1.0.', l_partkey % 20) as id_resp_h,
  case l_linenumber % 4 when 0 then 22 when 1 then 80 when 2 then 443 else 3389 end as id_resp_p,
  case l_linestatus when 'F' then 'tcp' else 'udp' end as proto,
  case l_returnflag when 'A' then 'ssh' when 'N' then 'http' else 'ssl' end as service,
  l_quantity as duration, cast(floor(l_extendedprice) as bigint) as orig_bytes,
  cast(floor(l_extendedprice * (1 - l_discount)) as bigint) as resp_bytes,
  cast(floor(l_quantity) as bigint) as orig_pkts
from lineitem""",
    "sensor_ftp": """
select uid, ts, id_orig_h, id_resp_h,
  case when orig_bytes % 3 = 0 then 'STOR' when orig_bytes % 3 = 1 then 'RETR' else 'LIST' end as command,
  concat('/srv/file_', resp_bytes % 100, '.dat') as arg
from sensor_conn""",
    "sensor_analyzer": """
select uid, ts, id_orig_h, upper(service) as analyzer_name,
  case when orig_bytes % 2 = 0 then 'violation' else 'failure' end as cause
from sensor_conn""",
    "sensor_weird": """
select uid, ts, id_orig_h, case resp_bytes % 3 when 0 then 'bad_TCP_checksum'
    when 1 then 'data_before_established' else 'possible_split_routing' end as name,
  case orig_pkts % 2 when 0 then 'sensor-a' else 'sensor-b' end as peer
from sensor_conn where orig_bytes % 5 = 0""",
    "sensor_http": """
select concat('H', page_id) as uid,
  timestamp '2024-01-01 00:00:00' + to_minutes(cast(page_id * 7 % 43200 as int)) as ts,
  concat('10.0.0.', page_id % 50) as id_orig_h, 'GET' as method,
  regexp_extract(url, '^https?://([^/:?#]+)', 1) as host,
  concat(regexp_extract(url, '^https?://[^/]+(.*)$', 1), case page_id % 10
    when 0 then '&pass=%27%20UNION%20SELECT%20*%20FROM%20users--' when 1 then '&cmd=cat%20/etc/passwd'
    when 2 then '&file=../../../etc/shadow' when 3 then '&term=%3Cscript%3E' else '' end) as uri
from pages""",
    "sensor_dns": """
select uid, ts, id_orig_h, case when length(host) % 5 = 0 then concat('c2.evil.', host)
  when length(host) % 5 = 1 then 'malware-c2.evil' else host end as query
from sensor_http""",
    "run_results": """
select concat('inv', o_custkey % 50) as invocation_id, concat('model_', o_custkey % 10) as table_name,
  case when o_orderpriority like '1%' then 'test' else 'model' end as resource_type,
  case o_orderstatus when 'F' then 'success' when 'O' then 'error' else 'skipped' end as status,
  o_totalprice / 1000 as execution_time, o_orderkey % 1000 as rows_affected,
  o_orderkey % 100000 as bytes_processed, o_orderdate as created_at
from orders""",
    "incident_docs": """
select event_id as doc_id, concat('Security event: ', replace(original_event_type, '_', ' '),
  ' from ', user_name, ' (', src_ip, ' -> ', dst_ip, ')') as document
from security_events""",
    "stream_messages": """
select event_type as topic, event_id as msg_offset, ts as msg_time, props as data from events""",
}


def with_views(sql: str) -> str:
    """Puts the views which ``sql`` names (directly or through others) in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in needed)
    body = sql.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
