"""Event names -> ids and names, and the parsing of lines."""

import pytest
from pyspark.sql import functions as F

from watchloom.functions import labels as L
from watchloom.functions import mapping as M
from watchloom.operators import event_rules as R
from watchloom.operators import normalize as N

# event, class, type, activity, severity, status, category, class name, category name,
# activity name, type name, stored in
GOLDEN = """
ssh_login_success|3002|300201|1|1|1|3|Authentication|Identity & Access Management|Allow|SSH Authentication|authentication
ssh_login_failure|3002|300202|2|2|2|3|Authentication|Identity & Access Management|Deny|SSH Authentication|authentication
web_login_success|3002|300201|1|1|1|3|Authentication|Identity & Access Management|Allow|Web Authentication|authentication
web_login_failure|3002|300202|2|2|2|3|Authentication|Identity & Access Management|Deny|Web Authentication|authentication
file_access|1001|100101|99|2|99|1|File System Activity|System Activity|Unknown|File Access|file_system_activity
brute_force_attack|2004|200402|2|3|2|2|Security Finding|Findings|Deny|Brute Force Attack|detection_finding
sql_injection_attempt|2004|200402|2|3|2|2|Security Finding|Findings|Deny|SQL Injection|detection_finding
malware_detection|2001|200101|2|4|2|2|Security Finding|Findings|Deny|Malware Detection|SKIPPED
data_exfiltration|4002|400202|2|4|2|2|Security Finding|Findings|Deny|Data Exfiltration|SKIPPED
rdp_login_success|2004|200402|1|1|1|3|Security Finding|Identity & Access Management|Allow|Security Event|detection_finding
rdp_login_failure|2004|200402|2|2|2|3|Security Finding|Identity & Access Management|Deny|Security Event|detection_finding
rdp_brute_force|2004|200402|99|3|99|4|Security Finding|Network Activity|Unknown|Brute Force Attack|detection_finding
rdp_reconnaissance|2004|200402|99|2|99|4|Security Finding|Network Activity|Unknown|Security Event|detection_finding
rdp_session_hijack|2004|200402|99|2|99|4|Security Finding|Network Activity|Unknown|Security Event|detection_finding
"""
ROWS = [line.split("|") for line in GOLDEN.strip().splitlines()]


def test_golden_mapping(spark):
    lines = spark.createDataFrame(
        [(f"2024-01-15 10:00:00.123456 event={r[0]} user=bob src_ip=10.0.0.1 dst_ip=10.0.0.2",) for r in ROWS],
        "value string",
    )
    events = N.normalize(N.parsed_lines(lines))
    judged = R.judge_events(N.as_json(events))
    outcome = {
        r["event"]: "SKIPPED" if r["status"] != "SUCCESS" else R.table_name(r["kind"])
        for r in judged.select(
            F.get_json_object(F.get_json_object("value", "$.raw_data"), "$.original_event_type").alias("event"),
            "status", "kind",
        ).collect()
    }
    got = {
        r["event"]: [str(v) for v in r[1:]]
        for r in events.select(
            F.get_json_object("raw_data", "$.original_event_type").alias("event"),
            "class_uid", "type_uid", "activity_id", "severity_id", "status_id", "category_uid",
            "class_name", "category_name", "activity_name", "type_name",
        ).collect()
    }
    for row in ROWS:
        assert got[row[0]] + [outcome[row[0]]] == row[1:]


@pytest.mark.parametrize(
    ("line", "parsed"),
    [
        ("2024-01-01 00:00:00.5 event=a user=u src_ip=1 dst_ip=2", True),
        ("2024-01-01 00:00:00.123456789 event=a user=u src_ip=1 dst_ip=2", True),
        ("2024-01-01 00:00:00.5 event=a user=u src_ip=1 dst_ip=2 extra=1", True),
        ("2024-01-01 00:00:00 event=a user=u src_ip=1 dst_ip=2", False),
        ("2024-13-01 00:00:00.5 event=a user=u src_ip=1 dst_ip=2", False),
        ("x2024-01-01 00:00:00.5 event=a user=u src_ip=1 dst_ip=2", False),
        ("", False),
    ],
)
def test_lines(spark, line, parsed):
    df = spark.createDataFrame([(line,)], "value string")
    assert N.parsed_lines(df).count() == int(parsed)
    assert N.rejected_lines(df).count() == int(not parsed)


def test_time_is_cut_not_rounded(spark):
    line = "2024-01-15 10:00:00.999999 event=a user=u src_ip=1 dst_ip=2"
    row = N.normalize(N.parsed_lines(spark.createDataFrame([(line,)], "value string"))).first()
    assert row["time"] == 1705312800
    assert row["time_dt"] == "2024-01-15T10:00:00.999Z"
    assert row["finding_info"]["uid"] == "a_1705312800"


def test_labels(spark):
    df = spark.createDataFrame([("success",), ("x_success",), ("_success",), ("xsuccess",)], "e string")
    assert [r[0] for r in df.select(L.is_success(F.col("e"))).collect()] == [False, True, True, True]
    row = spark.range(1).select(
        L.service_label(F.lit(8080)), L.service_label(F.lit(445)), L.caption("severity_id", F.lit(7)),
        L.caption("severity_id", F.lit(6)), L.class_category(F.lit(4002)), M.class_uid(F.lit("other")),
    ).first()
    assert list(row) == ["Port 8080", "SMB (445)", None, "Fatal", "Network Activity", 2004]
