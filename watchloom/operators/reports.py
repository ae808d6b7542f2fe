"""Monitoring reports over security events and sensor logs.

Every report takes ``as_of`` instead of reading the clock, and its thresholds as
parameters. Ties of an ordering are broken, so that a rerun gives the same rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import labels as L
from watchloom.functions import values as V
from watchloom.functions.expressions import (
    as_datetime,
    before,
    percent,
    seconds_between,
    since,
    sorted_text,
    truncate,
)
from watchloom.operators.skew import with_keys, with_running_total

EVENT = "original_event_type"
AsOf = str | datetime


def _events_of(df: DataFrame, names: list[str], as_of: AsOf, **ago: float) -> DataFrame:
    return df.filter(since(df, "time_dt", as_of, **ago) & F.col(EVENT).isin(names))


def events_over_time(events: DataFrame, as_of: AsOf, hours: float = 24) -> DataFrame:
    return (
        _events_of(events, V.THREAT_EVENTS, as_of, hours=hours)
        .groupBy(truncate("hour", "time_dt").alias("time_bucket"), EVENT)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy("time_bucket", EVENT)
    )


def top_attackers(
    events: DataFrame, as_of: AsOf, days: float = 7, more_than: int = 5, limit: int = 20
) -> DataFrame:
    # Counting per (source, type) first leaves at most 8 rows of a source.
    per_type = (
        _events_of(events, V.THREAT_EVENTS, as_of, days=days)
        .groupBy("src_ip", EVENT)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_type.groupBy("src_ip")
        .agg(
            F.sum("n").alias("total_attacks"),
            F.count(EVENT).alias("attack_types"),
            sorted_text(F.collect_list(EVENT)).alias("attack_methods"),
        )
        .filter(F.col("total_attacks") > more_than)
        .orderBy(F.desc("total_attacks"), "src_ip")
        .limit(limit)
    )


def outcome_rates(events: DataFrame, as_of: AsOf, hours: float = 24) -> DataFrame:
    counts = (
        events.filter(since(events, "time_dt", as_of, hours=hours))
        .groupBy(L.attack_outcome(F.col(EVENT)).alias("attack_outcome"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # The window runs over three rows.
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", percent(F.col("count"), total)).orderBy(
        F.desc("count"), "attack_outcome"
    )


def brute_force_heatmap(events: DataFrame, as_of: AsOf, days: float = 7) -> DataFrame:
    return (
        _events_of(events, V.BRUTE_FORCE_EVENTS, as_of, days=days)
        .groupBy(
            (F.dayofweek("time_dt") - 1).alias("day_of_week"),  # 0 = Sunday
            F.hour("time_dt").alias("hour_of_day"),
        )
        .agg(F.count(F.lit(1)).alias("attack_count"))
        .orderBy("day_of_week", "hour_of_day")
    )


def targeted_services(events: DataFrame, as_of: AsOf, hours: float = 24) -> DataFrame:
    return (
        _events_of(events, V.SERVICE_EVENTS, as_of, hours=hours)
        .filter(F.col("dst_port").isNotNull())
        .groupBy("dst_port", EVENT)
        .agg(F.count(F.lit(1)).alias("attack_count"))
        .select(L.service_label(F.col("dst_port")).alias("service"), EVENT, "attack_count")
        .orderBy(F.desc("attack_count"), "service", EVENT)
    )


def injection_trend(notices: DataFrame, as_of: AsOf, hours: float = 24) -> DataFrame:
    return (
        notices.filter(since(notices, "ts", as_of, hours=hours) & (F.col("note") == V.INJECTION_NOTE))
        .groupBy(truncate("hour", "ts").alias("time_bucket"), F.col("src").alias("attacker_ip"))
        .agg(F.count(F.lit(1)).alias("injection_attempts"))
        .orderBy("time_bucket", F.desc("injection_attempts"), "attacker_ip")
    )


def protocol_violations(
    analyzer: DataFrame, as_of: AsOf, hours: float = 24, more_than: int = 5
) -> DataFrame:
    return (
        analyzer.filter(since(analyzer, "ts", as_of, hours=hours))
        .groupBy(F.col("analyzer_name").alias("protocol"), F.col("cause").alias("violation_type"))
        .agg(
            F.count(F.lit(1)).alias("violation_count"),
            F.countDistinct("id_orig_h").alias("unique_sources"),
        )
        .filter(F.col("violation_count") > more_than)
        .orderBy(F.desc("violation_count"), "protocol", "violation_type")
    )


FTP_KEYS = ["time_bucket", "source_ip", "ftp_server", "command"]


def _transfers(ftp: DataFrame, as_of: AsOf, hours: float) -> DataFrame:
    return ftp.filter(since(ftp, "ts", as_of, hours=hours) & F.col("command").isin("STOR", "RETR")).select(
        truncate("hour", "ts").alias("time_bucket"),
        F.col("id_orig_h").alias("source_ip"),
        F.col("id_resp_h").alias("ftp_server"),
        "command",
        F.col("arg").alias("file"),
    )


def ftp_activity(ftp: DataFrame, as_of: AsOf, hours: float = 24, more_than: int = 10) -> DataFrame:
    """Transfers and different files per hour, client, server and command."""
    per_file = _transfers(ftp, as_of, hours).groupBy(*FTP_KEYS, "file").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_file.groupBy(*FTP_KEYS)
        .agg(F.sum("n").alias("transfer_count"), F.count("file").alias("file_count"))
        .filter(F.col("transfer_count") > more_than)
        .orderBy(F.desc("transfer_count"), *FTP_KEYS)
    )


def ftp_files(ftp: DataFrame, as_of: AsOf, hours: float = 24, more_than: int = 10) -> DataFrame:
    """The files of the groups of ``ftp_activity``: one row per group and file.

    A group's list would grow with the group; its rows do not.
    """
    per_file = _transfers(ftp, as_of, hours).groupBy(*FTP_KEYS, "file").agg(
        F.count(F.lit(1)).alias("file_transfers")
    )
    busy = ftp_activity(ftp, as_of, hours, more_than).select(*FTP_KEYS)
    return with_keys(per_file, busy, FTP_KEYS).filter(F.col("file").isNotNull())


def attack_origins(
    events: DataFrame, as_of: AsOf, days: float = 7, more_than: int = 10
) -> DataFrame:
    return (
        _events_of(events, V.ORIGIN_EVENTS, as_of, days=days)
        .groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).alias("total_attacks"),
            F.countDistinct("dst_ip").alias("targets_hit"),
            # At most six names, whatever the size of the group.
            sorted_text(F.collect_set(EVENT)).alias("attack_types"),
            F.max("time_dt").alias("last_seen"),
        )
        .filter(F.col("total_attacks") > more_than)
        .orderBy(F.desc("total_attacks"), "src_ip")
    )


def account_risk(
    events: DataFrame,
    as_of: AsOf,
    hours: float = 24,
    more_than: int = 5,
    high_above: int = 20,
    medium_above: int = 10,
) -> DataFrame:
    event = F.col(EVENT)
    failed = F.col("failed_attempts")
    return (
        events.filter(F.col("user_name").isNotNull() & since(events, "time_dt", as_of, hours=hours))
        .groupBy("user_name")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(L.is_failure(event)).alias("failed_attempts"),
            F.count_if(L.is_success(event)).alias("successful_logins"),
            F.countDistinct("src_ip").alias("unique_source_ips"),
            F.countDistinct("dst_ip").alias("unique_targets"),
            F.min("time_dt").alias("first_seen"),
            F.max("time_dt").alias("last_seen"),
        )
        .filter(F.col("total_events") > more_than)
        .withColumn(
            "risk_level",
            F.when(failed > high_above, "HIGH").when(failed > medium_above, "MEDIUM").otherwise("LOW"),
        )
        .orderBy(F.desc("failed_attempts"), F.desc("unique_source_ips"), "user_name")
    )


def conn_anomalies(
    conn: DataFrame,
    as_of: AsOf,
    hours: float = 24,
    min_connections: int = 50,
    min_bytes: int = 100_000,
) -> DataFrame:
    count, sent, received = (
        F.col("connection_count"), F.col("total_bytes_sent"), F.col("total_bytes_received"),
    )
    return (
        conn.filter(since(conn, "ts", as_of, hours=hours) & (F.col("proto") == "tcp"))
        .groupBy(
            F.col("id_orig_h").alias("source_ip"),
            F.col("id_resp_h").alias("dest_ip"),
            F.col("id_resp_p").alias("dest_port"),
            "service",
        )
        .agg(
            F.count(F.lit(1)).alias("connection_count"),
            F.sum("orig_bytes").alias("total_bytes_sent"),
            F.sum("resp_bytes").alias("total_bytes_received"),
            F.avg("duration").alias("avg_duration"),
        )
        .filter((count > min_connections) | (sent > min_bytes) | (received > min_bytes))
        .withColumn(
            "anomaly_type",
            F.when(count > 1000, "High Volume")
            .when(sent > 1_000_000, "Large Upload")
            .when(received > 1_000_000, "Large Download")
            .when(F.col("avg_duration") > 3600, "Long Duration")
            .otherwise("Normal"),
        )
        .orderBy(F.desc("connection_count"), "source_ip", "dest_ip", "dest_port", "service")
    )


TIMELINE_KEYS = ["src_ip", "dst_ip", "user_name"]


def attack_timeline(events: DataFrame, as_of: AsOf, hours: float = 24, more_than: int = 3) -> DataFrame:
    """Start, end and number of attack events per source, target and user."""
    return (
        _events_of(events, V.TIMELINE_EVENTS, as_of, hours=hours)
        .groupBy(*TIMELINE_KEYS)
        .agg(
            F.min("time_dt").alias("session_start"),
            F.max("time_dt").alias("session_end"),
            F.count(F.lit(1)).alias("events_in_session"),
        )
        .filter(F.col("events_in_session") > more_than)
        .withColumn(
            "session_duration_seconds", seconds_between(F.col("session_start"), F.col("session_end"))
        )
        .orderBy("session_start", *TIMELINE_KEYS)
    )


def attack_steps(
    events: DataFrame, as_of: AsOf, hours: float = 24, more_than: int = 3, tie: str = "event_id"
) -> DataFrame:
    """The events of ``attack_timeline`` in order: one row per event with its position.

    Positions are counted per time slice and carried over, so that a hot group is
    spread over tasks and no row holds a sequence.
    """
    sessions = attack_timeline(events, as_of, hours, more_than).select(*TIMELINE_KEYS)
    relevant = _events_of(events, V.TIMELINE_EVENTS, as_of, hours=hours)
    chosen = with_keys(relevant, sessions, TIMELINE_KEYS).withColumn("_one", F.lit(1))
    numbered = with_running_total(chosen, TIMELINE_KEYS, "time_dt", "_one", "position", [tie])
    return numbered.select(*TIMELINE_KEYS, "position", "time_dt", EVENT)


def threat_feed(
    events: DataFrame, as_of: AsOf, hours: float = 1, limit: int = 100, tie: str = "event_id"
) -> DataFrame:
    return (
        _events_of(events, V.THREAT_EVENTS, as_of, hours=hours)
        .orderBy(F.desc("time_dt"), F.desc(tie))
        .limit(limit)
        .select(
            "time_dt",
            F.col("src_ip").alias("Source IP"),
            F.col("dst_ip").alias("Target IP"),
            F.col("user_name").alias("User"),
            F.col(EVENT).alias("Attack Type"),
            L.severity_label(F.col(EVENT)).alias("Severity"),
        )
    )


def weekly_summary(events: DataFrame, as_of: AsOf) -> DataFrame:
    """This week against the week before, in one scan.

    Successes are filtered out before they are counted, so ``successful_attacks``
    is always 0; kept because it is what the report is defined to show.
    """
    event = F.col(EVENT)
    this_week = since(events, "time_dt", as_of, days=7)
    measured = (
        events.filter(since(events, "time_dt", as_of, days=14) & ~L.is_success(event))
        .groupBy(F.when(this_week, "This Week").otherwise("Previous Week").alias("period"))
        .agg(
            F.count(F.lit(1)).alias("total_security_events"),
            F.countDistinct("src_ip").alias("unique_attackers"),
            F.countDistinct("dst_ip").alias("unique_targets"),
            F.countDistinct("user_name").alias("affected_users"),
            F.count_if(L.is_success(event)).alias("successful_attacks"),
            F.count_if(event.isin(V.CRITICAL_EVENTS)).alias("critical_incidents"),
        )
    )
    # Both periods are reported, also one without events.
    spark = events.sparkSession
    periods = spark.createDataFrame([("This Week",), ("Previous Week",)], "period string")
    counts = [c for c in measured.columns if c != "period"]
    return (
        periods.join(measured, "period", "left")
        .fillna(0, counts)
        .withColumn(
            "attack_success_rate",
            percent(F.col("successful_attacks"), F.col("total_security_events")),
        )
    )


def user_anomaly(
    events: DataFrame, as_of: AsOf, history_days: float = 30, min_days: int = 7
) -> DataFrame:
    """Events of the as-of day against the user's daily history.

    One scan and no join: both numbers of a user come from the same daily counts.
    """
    today = as_datetime(as_of).date().isoformat()
    in_history = since(events, "time_dt", as_of, days=history_days) & before(
        events, "time_dt", as_of, days=1
    )
    is_today = F.to_date("time_dt") == F.lit(today).cast("date")
    oldest = min(as_datetime(today), as_datetime(as_of) - timedelta(days=history_days))
    daily = (
        events.filter(since(events, "time_dt", oldest))
        .groupBy("user_name", F.to_date("time_dt").alias("day"))
        .agg(F.count_if(in_history).alias("history"), F.count_if(is_today).alias("today"))
    )
    active = F.when(F.col("history") > 0, F.col("history"))
    average, spread = F.col("avg_daily_events"), F.col("stddev_daily_events")
    seen = F.col("today_events")
    return (
        daily.filter(F.col("user_name").isNotNull())
        .groupBy("user_name")
        .agg(
            F.sum("today").alias("today_events"),
            F.avg(active).alias("avg_daily_events"),
            F.stddev_samp(active).alias("stddev_daily_events"),
            F.count(active).alias("days"),
        )
        .filter((F.col("days") >= min_days) & (seen > 0) & (seen > average + spread))
        .select(
            "user_name",
            "today_events",
            "avg_daily_events",
            F.when(seen > average + 2 * spread, "HIGH_ANOMALY")
            .when(seen > average + spread, "MEDIUM_ANOMALY")
            .otherwise("NORMAL")
            .alias("anomaly_level"),
            F.round((seen - average) / F.nullif(spread, F.lit(0.0)), 2).alias("z_score"),
        )
        .orderBy(F.desc("z_score"), "user_name")
    )
