"""Rule-based detections over sensor logs and security events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import labels as L
from watchloom.functions import values as V
from watchloom.functions.expressions import any_phrase, first_match, lookup, since, truncate
from watchloom.operators.skew import DEFAULT_SLICE_SECONDS, with_sliding_count

EVENT = "original_event_type"


def unescaped(uri: Column) -> Column:
    """Percent-decoded text; ``+`` stays ``+``, and text that is no valid escape is kept."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def detect_injection(http: DataFrame, pattern: str = V.INJECTION_PATTERN) -> DataFrame:
    """One notice per request whose unescaped address looks like code injection."""
    return (
        http.withColumn("_plain", unescaped(F.col("uri")))
        .filter(F.col("_plain").rlike(pattern))
        .select(
            "ts",
            F.lit(V.INJECTION_NOTE).alias("note"),
            F.concat(F.lit(V.INJECTION_MESSAGE), "_plain").alias("msg"),
            F.col("id_orig_h").alias("src"),
            "uid",
        )
    )


def detect_dns(dns: DataFrame, pattern: str = V.DNS_PATTERN) -> DataFrame:
    """One notice per query with a suspicious word between two dots."""
    return dns.filter(F.col("query").rlike(pattern)).select(
        "ts",
        F.lit(V.DNS_NOTE).alias("note"),
        F.concat(F.lit(V.DNS_MESSAGE), "query").alias("msg"),
        F.col("id_orig_h").alias("src"),
        "uid",
    )


def detect_bruteforce(
    events: DataFrame,
    window_seconds: int = 1800,
    limit: int = V.PASSWORD_GUESS_LIMIT,
    key: str = "src_ip",
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Failed logins which are at least the ``limit``-th of their source in the window."""
    failures = events.filter(L.is_failure(F.col(EVENT)))
    return with_sliding_count(
        failures, [key], "time_dt", F.lit(True), window_seconds, "guesses", slice_seconds
    ).filter(F.col("guesses") >= limit)


def fail_then_success(
    events: DataFrame,
    window_seconds: int = 1800,
    min_failures: int = 3,
    keys: Sequence[str] = ("user_name",),
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Successful logins with at least ``min_failures`` failures shortly before."""
    event = F.col(EVENT)
    logins = events.filter(L.is_failure(event) | L.is_success(event))
    return with_sliding_count(
        logins, keys, "time_dt", L.is_failure(event), window_seconds, "earlier_failures", slice_seconds
    ).filter(L.is_success(event) & (F.col("earlier_failures") >= min_failures))


def known_hosts(conn: DataFrame) -> DataFrame:
    """First time each address took part in a connection."""
    return (
        conn.select("ts", F.explode(F.array("id_orig_h", "id_resp_h")).alias("host"))
        .groupBy("host")
        .agg(F.min("ts").alias("ts"))
    )


def known_services(conn: DataFrame) -> DataFrame:
    """First time each service was offered at an address and port."""
    return conn.groupBy(
        F.col("id_resp_h").alias("host"),
        F.col("id_resp_p").alias("port_num"),
        F.col("proto").alias("port_proto"),
        "service",
    ).agg(F.min("ts").alias("ts"))


def port_scan(
    conn: DataFrame, window: str = "1 hour", min_ports: int = 10, time_col: str = "ts"
) -> DataFrame:
    """Source and target pairs with many distinct ports within a window."""
    return (
        conn.groupBy(
            F.window(time_col, window).start.alias("window_start"),
            F.col("id_orig_h").alias("source_ip"),
            F.col("id_resp_h").alias("dest_ip"),
        )
        .agg(
            F.countDistinct("id_resp_p").alias("ports"),
            F.count(F.lit(1)).alias("connections"),
        )
        .filter(F.col("ports") >= min_ports)
    )


def exfil_volume(conn: DataFrame, as_of, hours: float = 24, min_bytes: int = 1_000_000) -> DataFrame:
    """Sources which sent more than ``min_bytes``."""
    return (
        conn.filter(since(conn, "ts", as_of, hours=hours))
        .groupBy(F.col("id_orig_h").alias("source_ip"))
        .agg(
            F.sum("orig_bytes").alias("bytes_sent"),
            F.count(F.lit(1)).alias("connections"),
        )
        .filter(F.col("bytes_sent") > min_bytes)
    )


def weird_summary(weird: DataFrame) -> DataFrame:
    return weird.groupBy("name", "peer").agg(F.count(F.lit(1)).alias("occurrences"))


def conn_counters(
    conn: DataFrame,
    connections_every: int = V.CONNECTION_MESSAGE_EVERY,
    packets_every: int = V.PACKET_MESSAGE_EVERY,
) -> DataFrame:
    """Running connection and packet totals per hour, and how many counter messages
    (one per ``connections_every`` / ``packets_every``) fell into the hour."""
    hourly = conn.groupBy(truncate("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("connections"), F.sum("orig_pkts").alias("packets")
    )
    # One row per hour of the log, already counted.
    so_far = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def messages(total: str, added: str, every: int) -> Column:
        return F.floor(F.col(total) / every) - F.floor((F.col(total) - F.col(added)) / every)

    return (
        hourly.withColumn("connections_so_far", F.sum("connections").over(so_far))
        .withColumn("packets_so_far", F.sum("packets").over(so_far))
        .withColumn(
            "connection_messages", messages("connections_so_far", "connections", connections_every)
        )
        .withColumn("packet_messages", messages("packets_so_far", "packets", packets_every))
    )


# --- triage ---------------------------------------------------------------------

# Priority of an event, highest rank first. The numbers are ours.
PRIORITY_RANKS = [
    ("exfiltration|hijack", 4),
    ("malware|rdp_login_success", 3),
    ("failure|brute_force|injection|reconnaissance", 2),
]
PRIORITIES = {4: "critical", 3: "high", 2: "medium", 1: "low"}


def triage_targets(events: DataFrame) -> DataFrame:
    """The targets of each source's finding: one row per source and target."""
    return events.groupBy(F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("target_host")).agg(
        F.count(F.lit(1)).alias("events")
    )


def triage_findings(events: DataFrame) -> DataFrame:
    """One prioritised finding per source; its targets are in ``triage_targets``.

    The confidence is a formula of this library (share of the deciding events,
    between 0.5 and 1.0), not a learned score.
    """
    rank = first_match(F.col(EVENT), PRIORITY_RANKS, 1)
    service = L.service_label(L.event_port(F.col(EVENT)))
    # At most (event types) rows per source from here on.
    per_type = (
        events.groupBy("src_ip", EVENT)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("time_dt").alias("start"),
            F.max("time_dt").alias("end"),
        )
        .withColumn("rank", rank)
        .withColumn("service", service)
    )
    by_source = Window.partitionBy("src_ip")
    finding = (
        per_type.withColumn("top_rank", F.max("rank").over(by_source))
        .groupBy("src_ip", "top_rank")
        .agg(
            F.sum("n").alias("event_count"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum(F.when(F.col("rank") == F.col("top_rank"), F.col("n"))).alias("deciding"),
            # The deciding type with most events; ties by name.
            F.min_by(
                EVENT,
                F.when(
                    F.col("rank") == F.col("top_rank"), F.struct((-F.col("n")).alias("n"), F.col(EVENT))
                ),
            ).alias("threat"),
            F.array_sort(F.collect_set(EVENT)).alias("indicators"),
            F.array_sort(F.collect_set("service")).alias("affected_services"),
        )
        .withColumn("threat_type", F.translate("threat", "_", " "))
        .withColumn("priority", lookup(F.col("top_rank"), PRIORITIES))
        .withColumn(
            "confidence_score",
            F.round(F.lit(0.5) + F.lit(0.5) * F.col("deciding") / F.col("event_count"), 4),
        )
    )
    targets = (
        events.select("src_ip", "dst_ip").distinct().groupBy("src_ip").agg(F.count("dst_ip").alias("target_count"))
    )
    return finding.join(targets, "src_ip").select(
        "priority",
        "threat_type",
        F.col("src_ip").alias("source_ip"),
        "target_count",
        F.concat_ws(
            " ", F.col("deciding").cast("string"), F.lit("x"), F.col("threat_type")
        ).alias("attack_pattern"),
        F.struct("start", "end").alias("timeline"),
        "indicators",
        "confidence_score",
        "event_count",
        "affected_services",
        F.concat(
            F.upper("priority"), F.lit(": "), F.col("threat_type"), F.lit(" from "), F.col("src_ip"),
            F.lit(", "), F.col("event_count").cast("string"), F.lit(" events"),
        ).alias("brief_summary"),
    )


# --- document rules ---------------------------------------------------------------


def _tags(text: Column, table: dict[str, list[str]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(any_phrase(text, phrases), F.lit(tag)) for tag, phrases in table.items()])
    )


def tag_documents(docs: DataFrame, text_col: str = "document") -> DataFrame:
    """Indicators, techniques and systems named in each document (whole text)."""
    text = F.lower(text_col)
    return (
        docs.withColumn("indicators", _tags(text, V.INDICATOR_PHRASES))
        .withColumn("techniques", _tags(text, V.TECHNIQUE_PHRASES))
        .withColumn("systems", _tags(text, V.SYSTEM_PHRASES))
    )


def pattern_summary(
    docs: DataFrame, distance_col: str | None = None, text_col: str = "document", by: Sequence[str] = (),
    present: str | None = None,
) -> DataFrame:
    """One row that sums up the patterns of all documents, or one per value of the columns ``by``.

    Plain conditional counts: one map-side aggregation, whatever the number of
    documents of a group. Without distances the mean distance counts as 1.0. A row
    whose column ``present`` is null stands for no document, as after an outer join.
    """
    text = F.lower(text_col)

    def counts(table: dict[str, list[str]]) -> Column:
        pairs = []
        for tag, phrases in table.items():
            pairs.append(
                F.struct(F.count_if(any_phrase(text, phrases)).alias("n"), F.lit(tag).alias("tag"))
            )
        return F.filter(F.array(*pairs), lambda p: p["n"] > 0)

    distance = F.avg(distance_col) if distance_col else F.lit(None).cast("double")
    found = docs.groupBy(*by).agg(
        F.count(F.col(present) if present else F.lit(1)).alias("documents"),
        F.coalesce(distance, F.lit(1.0)).alias("mean_distance"),
        counts(V.INDICATOR_PHRASES).alias("indicators"),
        counts(V.TECHNIQUE_PHRASES).alias("techniques"),
        counts(V.SYSTEM_PHRASES).alias("systems"),
    )
    none = F.col("documents") == 0
    # Most frequent first; equal counts by name.
    ranked = F.array_sort(
        F.transform("indicators", lambda p: F.struct((-p["n"]).alias("n"), p["tag"].alias("tag")))
    )
    top = F.try_element_at(ranked, F.lit(1))
    tags = {name: F.transform(name, lambda p: p["tag"]) for name in ("indicators", "techniques", "systems")}

    def has(tag: str) -> Column:
        return F.array_contains(tags["indicators"], tag)

    def listed(name: str, prefix: str) -> Column:
        return F.when(
            F.size(name) > 1, F.concat(F.lit(prefix), F.array_join(F.array_sort(tags[name]), ", "))
        )

    advice = F.array_compact(
        F.array(
            F.when(has("credential attacks"), V.CREDENTIAL_ACTION),
            F.when(has("lateral movement"), V.LATERAL_ACTION),
            F.when(has("privilege escalation"), V.ESCALATION_ACTION),
        )
    )
    progression = F.array_compact(
        F.array(
            F.when(has("credential attacks") & has("lateral movement"), V.LATERAL_PROGRESSION),
            F.when(has("privilege escalation"), V.ESCALATION_PROGRESSION),
        )
    )
    return found.select(
        *by,
        "documents",
        F.when(none, V.NO_HISTORY_SUMMARY)
        .when(top.isNull(), V.MIXED_SUMMARY)
        .otherwise(F.format_string(V.PATTERN_SUMMARY, top["tag"], -top["n"]))
        .alias("pattern_summary"),
        F.array_compact(
            F.array(
                listed("techniques", V.VECTORS_CORRELATION), listed("systems", V.PLATFORM_CORRELATION)
            )
        ).alias("correlations"),
        progression.alias("attack_patterns"),
        F.when(none, F.array(F.lit(V.NO_HISTORY_ACTION)))
        .when(F.size(advice) > 0, advice)
        .otherwise(F.array(F.lit(V.FALLBACK_ACTION)))
        .alias("recommendations"),
        F.when(none, "low")
        .when(F.col("mean_distance") < V.HIGH_CONFIDENCE_BELOW, "high")
        .when(F.col("mean_distance") < V.MEDIUM_CONFIDENCE_BELOW, "medium")
        .otherwise("low")
        .alias("confidence"),
        F.when(none, V.NO_HISTORY_TIMELINE)
        .otherwise(F.format_string(V.TIMELINE_TEXT, "documents"))
        .alias("timeline_insights"),
    )
