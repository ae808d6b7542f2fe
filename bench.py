"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.
Every query runs once to warm up and is then timed; its rows are thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from watchloom.plans import QUERIES
from watchloom.session import build_session

HEADLINE = [
    "events_over_time", "top_attackers", "outcome_rates", "brute_force_heatmap", "targeted_services",
    "sqli_trend", "protocol_violations", "ftp_activity", "attack_origins", "account_risk",
    "conn_anomalies", "attack_timeline", "threat_feed", "weekly_summary", "user_anomaly",
    "table_summary", "run_analysis", "slowest_models", "prev_event", "share_of_total",
    "last_n_per_topic", "full_outer_federated", "knn_join", "detect_injection", "detect_dns",
    "detect_bruteforce", "fail_then_success", "port_scan", "triage_findings", "tag_documents",
    "pattern_summary", "parse_log_line", "build_message_raw", "validate_sensor", "validate_ocsf",
    "ocsf_events_view_all", "stream_hourly_counts", "attack_steps", "ftp_files", "route_tables", "src_sensor_json",
    "dead_letter", "ingest_outcomes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    keys = sys.argv[1:] or HEADLINE
    seconds = {}
    for key in keys:
        for _ in range(2):
            begun = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.perf_counter() - begun, 3)
    spark.stop()
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
