"""Shapes the given parquet tables like security tables.

Each function reads one given table and projects it; nothing is cached or
collected, so filters of a query still reach the scan. The SQL text of the same
views, for the oracle, is in ``watchloom.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.labels import event_port

LAST_INSTANT = "2024-01-31 00:00:00"  # just after the last row of `events`
LAST_SENSOR_INSTANT = "2001-11-05 00:00:00"  # just after the last row of `lineitem`
LAST_RUN_INSTANT = "2001-08-02 00:00:00"  # just after the last row of `orders`


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(number: Column, names: list[str]) -> Column:
    return F.element_at(
        F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int")
    )


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with user, source, target and security event type."""
    events = table(spark, sf_dir, "events")
    kind, number = F.col("event_type"), F.col("event_id")
    event = (
        F.when(kind == "click", _choose(number, ["ssh_login_success", "web_login_success"]))
        .when(kind == "view", _choose(number, ["file_access", "rdp_login_success"]))
        .when(
            kind == "error",
            _choose(number, ["ssh_login_failure", "rdp_login_failure", "web_login_failure"]),
        )
        .when(
            kind == "signup",
            _choose(
                number,
                ["brute_force_attack", "rdp_brute_force", "sql_injection_attempt", "rdp_reconnaissance"],
            ),
        )
        .otherwise(_choose(number, ["malware_detection", "data_exfiltration", "rdp_session_hijack"]))
    )
    target = F.get_json_object("props", "$.k").cast("int") % 10
    return events.select(
        "event_id",
        F.col("ts").alias("time_dt"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        F.concat(F.lit("192.168.100."), (F.col("user_id") % 10 + 10).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.100."), (target + 20).cast("string")).alias("dst_ip"),
        event.alias("original_event_type"),
    )


def security_events_with_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = security_events(spark, sf_dir)
    return events.withColumn("dst_port", event_port(F.col("original_event_type")))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text line per event; some are damaged, some carry trailing text."""
    number = F.col("event_id")
    stamp = F.date_format("time_dt", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return security_events(spark, sf_dir).select(
        "event_id",
        F.concat(
            F.when(number % 97 == 0, "garbage ").otherwise(""),
            F.when(number % 89 == 0, F.substring(stamp, 1, 19)).otherwise(stamp),
            F.lit(" event="), F.col("original_event_type"),
            F.lit(" user="), F.col("user_name"),
            F.lit(" src_ip="), F.col("src_ip"),
            F.lit(" dst_ip="), F.col("dst_ip"),
            F.when(number % 83 == 0, " extra=1").otherwise(""),
        ).alias("value"),
    )


def sensor_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.lit("C"), F.col("l_orderkey").cast("string"), F.lit("-"),
            F.col("l_linenumber").cast("string"),
        ).alias("uid"),
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 50).cast("string")).alias("id_orig_h"),
        F.concat(F.lit("10.1.0."), (F.col("l_partkey") % 20).cast("string")).alias("id_resp_h"),
        F.when(line == 0, 22).when(line == 1, 80).when(line == 2, 443).otherwise(3389).alias("id_resp_p"),
        F.when(F.col("l_linestatus") == "F", "tcp").otherwise("udp").alias("proto"),
        F.when(F.col("l_returnflag") == "A", "ssh")
        .when(F.col("l_returnflag") == "N", "http")
        .otherwise("ssl")
        .alias("service"),
        F.col("l_quantity").alias("duration"),
        F.floor("l_extendedprice").cast("bigint").alias("orig_bytes"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").alias("resp_bytes"),
        F.floor("l_quantity").cast("bigint").alias("orig_pkts"),
    )


def sensor_ftp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_conn(spark, sf_dir).select(
        "uid", "ts", "id_orig_h", "id_resp_h",
        _choose(F.col("orig_bytes"), ["STOR", "RETR", "LIST"]).alias("command"),
        F.concat(F.lit("/srv/file_"), (F.col("resp_bytes") % 100).cast("string"), F.lit(".dat")).alias("arg"),
    )


def sensor_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_conn(spark, sf_dir).select(
        "uid", "ts", "id_orig_h",
        F.upper("service").alias("analyzer_name"),
        _choose(F.col("orig_bytes"), ["violation", "failure"]).alias("cause"),
    )


def sensor_weird(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_conn(spark, sf_dir).filter(F.col("orig_bytes") % 5 == 0).select(
        "uid", "ts", "id_orig_h",
        _choose(
            F.col("resp_bytes"), ["bad_TCP_checksum", "data_before_established", "possible_split_routing"]
        ).alias("name"),
        _choose(F.col("orig_pkts"), ["sensor-a", "sensor-b"]).alias("peer"),
    )


def sensor_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id") % 10
    suffix = (
        F.when(number == 0, "&pass=%27%20UNION%20SELECT%20*%20FROM%20users--")
        .when(number == 1, "&cmd=cat%20/etc/passwd")
        .when(number == 2, "&file=../../../etc/shadow")
        .when(number == 3, "&term=%3Cscript%3E")
        .otherwise("")
    )
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("H"), F.col("page_id").cast("string")).alias("uid"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(mins=(F.col("page_id") * 7 % 43200).cast("int"))).alias("ts"),
        F.concat(F.lit("10.0.0."), (F.col("page_id") % 50).cast("string")).alias("id_orig_h"),
        F.lit("GET").alias("method"),
        F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"),
        F.concat(F.regexp_extract("url", r"^https?://[^/]+(.*)$", 1), suffix).alias("uri"),
    )


def sensor_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("host") % 5
    return sensor_http(spark, sf_dir).select(
        "uid", "ts", "id_orig_h",
        F.when(size == 0, F.concat(F.lit("c2.evil."), F.col("host")))
        .when(size == 1, "malware-c2.evil")
        .otherwise(F.col("host"))
        .alias("query"),
    )


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("inv"), (F.col("o_custkey") % 50).cast("string")).alias("invocation_id"),
        F.concat(F.lit("model_"), (F.col("o_custkey") % 10).cast("string")).alias("table_name"),
        F.when(F.col("o_orderpriority").like("1%"), "test").otherwise("model").alias("resource_type"),
        F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "O", "error")
        .otherwise("skipped")
        .alias("status"),
        (F.col("o_totalprice") / 1000).alias("execution_time"),
        (F.col("o_orderkey") % 1000).alias("rows_affected"),
        (F.col("o_orderkey") % 100000).alias("bytes_processed"),
        F.col("o_orderdate").alias("created_at"),
    )


def incident_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security_events(spark, sf_dir).select(
        F.col("event_id").alias("doc_id"),
        F.concat(
            F.lit("Security event: "), F.translate("original_event_type", "_", " "),
            F.lit(" from "), F.col("user_name"),
            F.lit(" ("), F.col("src_ip"), F.lit(" -> "), F.col("dst_ip"), F.lit(")"),
        ).alias("document"),
    )


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        F.col("event_id").alias("msg_offset"),
        F.col("ts").alias("msg_time"),
        F.col("props").alias("data"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
