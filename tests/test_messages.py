"""What is stored, skipped and refused."""

import json

import pytest
from pyspark.sql import functions as F

from watchloom.operators import event_rules as R
from watchloom.operators import sensor as SN
from watchloom.operators import views as VW
from watchloom.sinks import tables as K


def messages(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


SENSOR = [
    ("{bad", "ERROR", "unknown", True),
    ("", "ERROR", "unknown", True),
    (None, "ERROR", "unknown", True),
    ('{"conn": {"uid": "a"', "ERROR", "conn", True),
    ('{"conn": {"uid": "a"}} garbage', "ERROR", "conn", True),
    ('{"conn": {"uid": "a"}}{"x": 1}', "ERROR", "conn", True),
    ('{"conn": {"uid": "a"}}, {"x": 1}', "ERROR", "conn", True),
    ('{"conn": {"ts": "86400"}}', "SUCCESS", "conn", True),
    ('{"conn": {"ts": "12:30"}}', "SKIPPED", "conn", True),
    ("[]", "SKIPPED", "unknown", True),
    ("null", "SKIPPED", "unknown", True),
    ("{}", "SKIPPED", "unknown", True),
    ('[{"conn": {"uid": "a"}}]', "SKIPPED", "unknown", True),
    ('{"notice": {}}', "SKIPPED", "notice", True),
    ('{"conn": 3}', "SKIPPED", "conn", True),
    ('{"conn": null}', "SKIPPED", "conn", True),
    ('{"conn": [{"uid": "a"}]}', "SKIPPED", "conn", True),
    ('{"conn": {}}', "ERROR", "conn", True),
    ('{"conn": {"other": 1}}', "ERROR", "conn", True),
    ('{"http": {"tags": []}}', "ERROR", "http", True),
    ('{"conn": {"id.orig_p": "80"}}', "SUCCESS", "conn", True),
    ('{"conn": {"id.orig_p": 80.0}}', "SUCCESS", "conn", True),
    ('{"conn": {"id.orig_p": 80.5}}', "SKIPPED", "conn", True),
    ('{"conn": {"id.orig_p": "x"}}', "SKIPPED", "conn", True),
    ('{"conn": {"id.orig_p": {"a": 1}}}', "SKIPPED", "conn", True),
    ('{"conn": {"uid": 5}}', "SKIPPED", "conn", True),
    ('{"conn": {"uid": 5}}', "SUCCESS", "conn", False),
    ('{"conn": {"uid": null, "proto": "tcp"}}', "SUCCESS", "conn", True),
    ('{"dns": {"answers": ["1.1.1.1"]}}', "SKIPPED", "dns", True),
    ('{"dns": {"answers": ["1.1.1.1"]}}', "SUCCESS", "dns", False),
    ('{"conn": {"ts": "2024-01-01T00:00:00Z"}}', "SUCCESS", "conn", True),
    ('{"conn": {"ts": "1704067200.5"}}', "SUCCESS", "conn", True),
    ('{"conn": {"ts": 1704067200}}', "SUCCESS", "conn", True),
    ('{"conn": {"ts": "soon"}}', "SKIPPED", "conn", True),
    ('{"conn": {"ts": [1]}}', "SKIPPED", "conn", True),
    ('{"conn": {"local_orig": "yes"}}', "SUCCESS", "conn", True),
    ('{"conn": {"local_orig": "maybe"}}', "SKIPPED", "conn", True),
    ('{"conn": {"duration": "1.5e2"}}', "SUCCESS", "conn", True),
    ('{"dns": {"query": "a"}, "conn": 3}', "SUCCESS", "dns", True),
    ('{"weird": {"name": "n"}, "conn": {"uid": 1}}', "SUCCESS", "weird", True),
]


@pytest.mark.parametrize("strict", [True, False])
def test_sensor_outcomes(spark, strict):
    cases = [c for c in SENSOR if c[3] == strict]
    judged = SN.judge_sensor(messages(spark, [c[0] for c in cases]), strict=strict)
    got = {r["value"]: (r["status"], r["kind"]) for r in judged.collect()}
    assert got == {c[0]: (c[1], c[2]) for c in cases}


def test_digits_are_seconds(spark):
    texts = ['{"conn": {"ts": "%s"}}' % t for t in ("86400", "2024", "2024-01-01")]
    table = SN.sensor_table(SN.judge_sensor(messages(spark, texts)), "conn")
    assert sorted(r[0] for r in table.select(F.col("ts").cast("string")).collect()) == [
        "1970-01-01 00:33:44", "1970-01-02 00:00:00", "2024-01-01 00:00:00"]


def test_latest_findings_keep_all_keys(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "user_name": "u"}'), (2, "{}"), (3, "{} x"), (4, None)], "i int, raw_data string")
    found = VW.latest_findings(rows.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as time_dt"), tie="i")
    got = {r["i"]: json.loads(r["finding"]) for r in found.collect()}
    when = "2024-01-01T00:00:00.000000"
    assert got[1] == {"a": 1, "user_name": "u", "time_dt": when} and got[2] == {"time_dt": when}
    assert got[3] == {"raw_data": "{} x", "parse_error": "Not a valid JSON string"}
    assert got[4] == {"parse_error": "Not a valid JSON string"}


def test_parts_of_a_line_hold_what_they_hold(spark):
    from watchloom.operators import normalize as N

    line = "2024-01-01 00:00:00.5 event=e user=u\x01evil src_ip=1.1.1.1 dst_ip=2.2.2.2 more"
    row = N.parse_log_lines(messages(spark, [line])).first()
    assert (row["user"], row["src_ip"], row["dst_ip"]) == ("u\x01evil", "1.1.1.1", "2.2.2.2")


def test_sensor_values(spark):
    text = json.dumps(
        {"conn": {"ts": "2024-01-01T01:00:00+01:00", "id.orig_p": "80", "duration": "1.5", "local_orig": 1,
                  "orig_bytes": 7.0, "id_resp_p": 9, "uid": "u"}}
    )
    row = SN.sensor_table(SN.judge_sensor(messages(spark, [text])), "conn").withColumn(
        "ts", F.col("ts").cast("string")
    ).first()
    assert row["ts"] == "2024-01-01 00:00:00"
    assert (row["id_orig_p"], row["duration"], row["local_orig"], row["orig_bytes"]) == (80, 1.5, True, 7)
    assert row["id_resp_p"] is None  # only the dotted name is read
    lists = SN.judge_sensor(messages(spark, ['{"http": {"tags": ["a", "b"]}}']))
    assert SN.sensor_table(lists, "http").first()["tags"] == ["a", "b"]
    lenient = SN.judge_sensor(messages(spark, ['{"dns": {"answers": ["1.1.1.1"]}}']), strict=False)
    assert SN.sensor_table(lenient, "dns").first()["answers"] == '["1.1.1.1"]'


def finding(**changes):
    event = {
        "class_uid": 2004, "class_name": "Security Finding", "severity_id": 1, "activity_id": 1, "time": 17,
        "type_uid": 200401, "metadata": {"product": {"vendor_name": "v"}},
        "finding_info": {"title": "t", "uid": "u"},
    }
    event.update(changes)
    return json.dumps({k: v for k, v in event.items() if v != "gone"})


DEVICE = {"hostname": "h", "ip": "i", "name": "n", "region": "r", "type_id": 2, "uid": "u"}
EVENTS = [
    (finding(), "SUCCESS", "Detection Finding", None),
    (finding(time="17", message=5), "SUCCESS", "Detection Finding", None),
    (finding(class_uid=2004.0), "SUCCESS", "Detection Finding", None),
    (finding(class_uid="2004"), "SKIPPED", "Security Finding", "unsupported class"),
    (finding(class_uid=2001), "SKIPPED", "Security Finding", "unsupported class"),
    (finding(class_uid="gone", class_name="gone"), "SKIPPED", "Unknown", "unsupported class"),
    (finding(finding_info="gone"), "SKIPPED", "Detection Finding", "invalid: finding_info"),
    (finding(finding_info={"title": "t"}), "SKIPPED", "Detection Finding", "invalid: finding_info"),
    (finding(severity_id=7), "SKIPPED", "Detection Finding", "invalid: severity_id"),
    (finding(severity_id="1"), "SKIPPED", "Detection Finding", "invalid: severity_id"),
    (finding(severity_id=None), "SKIPPED", "Detection Finding", "invalid: severity_id"),
    (finding(metadata={"product": {}}), "SKIPPED", "Detection Finding", "invalid: metadata"),
    (finding(message=["a"]), "SKIPPED", "Detection Finding", "invalid: message"),
    (finding(count="many"), "SKIPPED", "Detection Finding", "invalid: count"),
    (finding(remediation={"desc": "d", "kb_article_list": [
        {"title": "x", "uid": "u", "severity": "s", "os": {"name": "n", "type_id": 1}}]}), "SUCCESS", "Detection Finding", None),
    (finding() + " garbage", "ERROR", "Detection Finding", "invalid JSON"),
    (finding() + '{"x": 1}', "ERROR", "Detection Finding", "invalid JSON"),
    (finding() + ', {"x": 1}', "ERROR", "Detection Finding", "invalid JSON"),
    (finding(remediation={"desc": "d", "kb_article_list": [{"title": "x"}]}), "SKIPPED", "Detection Finding",
     "invalid: remediation"),
    (finding(remediation={"desc": "d", "kb_article_list": []}), "SUCCESS", "Detection Finding", None),
    (finding(resources=[{"owner": {"name": "n"}}]), "SKIPPED", "Detection Finding", "invalid: resources"),
    (finding(observables=[{"name": "n", "type_id": 1}, None]), "SKIPPED", "Detection Finding",
     "invalid: observables"),
    # Types and ids of children of objects.
    (finding(finding_info={"title": "t", "uid": "u", "created_time": "soon"}), "SKIPPED", "Detection Finding",
     "invalid: finding_info"),
    (finding(finding_info={"title": "t", "uid": "u", "created_time": "17", "created_time_dt": "2024-01-01T00:00:00Z",
                           "types": ["x"], "analytic": {"name": "n", "uid": "u", "type_id": 3}}),
     "SUCCESS", "Detection Finding", None),
    (finding(finding_info={"title": ["t"], "uid": "u"}), "SKIPPED", "Detection Finding", "invalid: finding_info"),
    (finding(finding_info={"title": "t", "uid": "u", "types": "x"}), "SKIPPED", "Detection Finding", "invalid: finding_info"),
    (finding(finding_info={"title": "t", "uid": "u", "analytic": {"name": "n", "uid": "u", "type_id": "x"}}), "SKIPPED",
     "Detection Finding", "invalid: finding_info"),
    (finding(observables=[{"name": "n", "type_id": 77}]), "SKIPPED", "Detection Finding", "invalid: observables"),
    (finding(observables=[{"name": "n", "type_id": 30, "value": 5}]), "SUCCESS", "Detection Finding", None),
    (finding(observables=[{"name": "n", "type_id": 1, "value": {}}]), "SKIPPED", "Detection Finding", "invalid: observables"),
    (finding(metadata={"product": {"vendor_name": "v"}, "sequence": "x"}), "SKIPPED", "Detection Finding", "invalid: metadata"),
    (finding(metadata={"product": {"vendor_name": "v", "lang": [1]}}), "SKIPPED", "Detection Finding", "invalid: metadata"),
    (finding(evidences=[{"device": {**DEVICE, "type_id": 11}}]), "SUCCESS", "Detection Finding", None),
    (finding(evidences=[{"device": {**DEVICE, "type_id": 12}}]), "SKIPPED", "Detection Finding", "invalid: evidences"),
    (finding(evidences=[{"device": {**DEVICE, "is_managed": "maybe"}}]), "SKIPPED", "Detection Finding", "invalid: evidences"),
    ("[]", "ERROR", "Unknown", "not an object"),
    ("null", "ERROR", "Unknown", "not an object"),
    ("{x", "ERROR", "Unknown", "invalid JSON"),
]


def test_event_outcomes(spark):
    judged = R.judge_events(messages(spark, [c[0] for c in EVENTS]))
    got = {r["value"]: (r["status"], r["kind"], r["reason"]) for r in judged.collect()}
    assert got == {c[0]: c[1:] for c in EVENTS}


def test_event_table(spark):
    judged = R.judge_events(messages(spark, [finding(actor={"user": 1}, severity="Low", comment=3)]))
    table = R.event_table(judged, 2004)
    assert "actor" not in table.columns  # not a field of this class
    row = table.select("category_name", "category_uid", "comment", "time", "severity_id").first()
    assert tuple(row) == ("Findings", 2, "3", 17, 1)


def test_all_messages_are_accounted_for(spark, tmp_path):
    judged = SN.judge_sensor(messages(spark, [c[0] for c in SENSOR if c[3]]))
    K.route_sensor(judged, str(tmp_path / "t"), 0)
    stored = sum(
        K.read_table(spark, str(p)).count() for p in (tmp_path / "t").iterdir() if p.is_dir()
    )
    assert stored + K.dead_letters(judged).count() == judged.count()
    # A replay of the batch adds nothing.
    K.route_sensor(judged, str(tmp_path / "t"), 0)
    again = sum(K.read_table(spark, str(p)).count() for p in (tmp_path / "t").iterdir() if p.is_dir())
    assert again == stored


def test_prune(spark):
    df = spark.sql(
        "select 1 as a, named_struct('b', cast(null as string), 'c', array(null, '')) as s, "
        "array(named_struct('x', cast(null as int))) as gone, map('k', null, 'l', 0) as m, false as f"
    )
    row = VW.prune(df).first()
    assert row["s"]["c"] == [""] and row["s"]["b"] is None
    assert row["gone"] is None and row["m"] == {"l": 0} and row["f"] is False
    assert VW.without_empty_columns(VW.prune(df)).columns == ["a", "s", "m", "f"]


def interpreted_rules(df):
    """Rule sets that stand in a generator, where a lambda keeps them from being compiled."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Generate inline" in line and "lambdafunction" in line]


def test_rules_stand_in_projections(spark):
    """Before, each rule was interpreted for every message."""
    sent = messages(spark, ["{}"])
    assert not interpreted_rules(SN.judge_sensor(sent).select("value", "status", "reason"))
    assert not interpreted_rules(R.judge_events(sent).select("value", "status", "reason"))
    # A filter on the outcome does not copy the rules below it.
    stored = SN.judge_sensor(sent).filter("status = 'SUCCESS'")
    assert stored._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") <= 1


def test_sensor_outcomes_of_rare_values(spark):
    texts = ['{"conn": {"duration": 1e400}}', '{"http": {"tags": [null]}}', '{"dns": {"AA": true, "aa": 1}}',
             '{"conn": {"ts": 1e300, "uid": 5, "id.orig_p": "x"}}', '{"conn": {"duration": null, "uid": null}}']
    got = {r["value"]: (r["status"], r["reason"]) for r in SN.judge_sensor(messages(spark, texts)).collect()}
    assert got[texts[1]] == got[texts[2]] == ("SUCCESS", None)
    assert got[texts[3]] == ("SKIPPED", "invalid: uid, id_orig_p")
    assert got[texts[4]] == ("ERROR", "nothing to write")
