"""Live reports: whole results over several batches, late rows, restarts and hot pairs."""

from __future__ import annotations

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from watchloom.sinks import tables as K
from watchloom.streaming import jobs as J

EVENTS = "event_id bigint, time_dt timestamp_ntz, src_ip string, dst_ip string, original_event_type string"
DAY = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return DAY + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, make_writer, schema=EVENTS):
    """One run of the query per batch of rows, each from the checkpoint of the one before."""
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.start(make_writer(stream), mark).awaitTermination()


def event(k, minutes, src="a", dst="b", kind="ssh_login_failure"):
    return (k, None if minutes is None else at(minutes), src, dst, kind)


def test_hours_change_with_late_rows_and_close_after_the_delay(spark, tmp_path):
    table = K.KeyedTable(spark, str(tmp_path / "t"), J.HOURLY_KEYS, fold_every=2)
    batches = [
        [event(1, 5), event(2, 50), event(3, 70)],
        [event(4, 59), event(5, 400)],  # the first one is late, its hour still open
        [event(6, 58), event(7, 401), event(8, None)],  # beyond the delay: its hour is closed
        [event(9, 410, kind="x")],
    ]
    run(spark, tmp_path, batches, lambda s: J.into_table(J.hourly_counts(s, "30 minutes"), table))
    got = {(r["time_bucket"].replace(tzinfo=None), r["original_event_type"]): r["event_count"] for r in table.read().collect()}
    kind = "ssh_login_failure"
    assert got == {(at(0), kind): 3, (at(60), kind): 1, (at(360), kind): 2, (at(360), "x"): 1}


def test_sliding_windows_are_given_out_while_open(spark, tmp_path):
    table = K.KeyedTable(spark, str(tmp_path / "t"), J.SLIDING_KEYS)
    run(spark, tmp_path, [[event(1, 10), event(2, 11)], [event(3, 12)]],
        lambda s: J.into_table(J.sliding_bruteforce(s), table))
    got = {r["window_start"].replace(tzinfo=None): r["guesses"] for r in table.read().collect()}
    assert got == {at(m): 3 for m in (-15, -10, -5, 0, 5, 10)}


def brute_sessions(rows, gap=30):
    pairs = collections.defaultdict(list)
    for _, time, src, dst, _ in rows:
        if time is not None:
            pairs[src, dst].append(time)
    out = set()
    for pair, times in pairs.items():
        run_ = []
        for time in [*sorted(times), None]:
            if run_ and (time is None or time >= run_[-1] + dt.timedelta(minutes=gap)):
                out.add((*pair, run_[0], run_[-1] + dt.timedelta(minutes=gap), len(run_)))
                run_ = []
            run_.append(time)
    return out


def found_sessions(table):
    rows = table.read().collect()
    out = {(r["src_ip"], r["dst_ip"], r["session_start"].replace(tzinfo=None), r["session_end"].replace(tzinfo=None),
            r["events_in_session"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_of_a_hot_pair_over_batches(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [event(k, draw.randint(0, 6000), "hot" if draw.random() < 0.4 else draw.choice("xyz"), draw.choice("pq")) for k in range(1500)]
    rows += [event(2000, None), event(2001, 10, None, "p"), event(2002, 20, None, "p")]
    rows.sort(key=lambda r: (r[1] or DAY) + dt.timedelta(minutes=draw.randint(0, 600)))
    table = K.KeyedTable(spark, str(tmp_path / "t"), J.SESSION_KEYS, "merged_away", fold_every=2)
    step = len(rows) // 5 + 1
    run(spark, tmp_path, [rows[k : k + step] for k in range(0, len(rows), step)],
        lambda s: J.into_table(J.sessions(s, delay="12 hours"), table))
    assert found_sessions(table) == brute_sessions(rows)


def test_a_late_row_joins_sessions_that_were_given_out(spark, tmp_path):
    table = K.KeyedTable(spark, str(tmp_path / "t"), J.SESSION_KEYS, "merged_away")
    batches = [[event(1, 0), event(2, 50)], [event(3, 25)], [event(4, 300)], [event(5, 75)], [event(6, 310)]]
    run(spark, tmp_path, batches, lambda s: J.into_table(J.sessions(s, delay="60 minutes"), table))
    # The fifth row came after its session was dropped from the state: it is left out.
    assert found_sessions(table) == {("a", "b", at(0), at(80), 3), ("a", "b", at(300), at(340), 2)}


def test_a_hot_pair_is_merged_where_its_rows_are(spark):
    hot = spark.range(60_000, numPartitions=12).select(
        F.lit("s").alias("src_ip"), F.lit("d").alias("dst_ip"),
        (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 3000).cast("int"))).alias("time_dt"))
    partial = J.partial_sessions(hot)
    assert partial.agg(F.sum("n")).first()[0] == 60_000 and partial.count() <= 24


def test_copies_within_and_beyond_the_delay(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "value string, time_dt timestamp_ntz"
    batches = [
        [("m", at(0)), ("m", at(1)), ("n", at(2))],
        [("m", at(30)), ("o", at(40))],  # within the delay of the first copy, in another run
        [("p", at(200))],
        [("m", at(210)), ("m", at(211)), ("o", at(215))],  # beyond it: new messages
    ]
    run(spark, tmp_path, batches,
        lambda s: J.first_copies(s, "time_dt", "1 hour").select("value").writeStream.format("parquet").option("path", out), schema)
    assert collections.Counter(r[0] for r in spark.read.parquet(out).collect()) == {"m": 2, "n": 1, "o": 2, "p": 1}


def test_state_is_on_disk(spark, tmp_path):
    table = K.KeyedTable(spark, str(tmp_path / "t"), J.HOURLY_KEYS)
    run(spark, tmp_path, [[event(1, 5)]], lambda s: J.into_table(J.hourly_counts(s), table))
    assert list((tmp_path / "mark" / "state").rglob("*.zip")) or list((tmp_path / "mark" / "state").rglob("*.changelog"))


def test_keyed_table_replays_and_folds(spark, tmp_path):
    table = K.KeyedTable(spark, str(tmp_path / "t"), ["k"], "gone", fold_every=2)
    layout = "k string, v int, gone boolean"
    batches = [[("a", 1, False), (None, 9, False)], [("b", 2, False)], [("a", 3, False)], [("b", 0, True)], [("c", 4, False)], [("a", 5, False)]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # run again, as after a lost driver
            table.upsert(spark.createDataFrame(rows, layout), n)
        got = {r["k"]: r["v"] for r in table.read().collect()}
        want = {}
        for part in batches[: n + 1]:
            for k, v, gone in part:
                want[k] = v
                if gone:
                    del want[k]
        assert got == want
    assert K.written_batches(spark, table.folded) == [3, 5] and K.written_batches(spark, table.changes) == [4, 5]
