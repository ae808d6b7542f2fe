"""Structured Streaming jobs.

Ingest jobs run the batch operators inside ``foreachBatch`` and write every
micro-batch under its id, so that a replay after a lost executor or driver
replaces its own half-written output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchloom.functions import labels as L
from watchloom.operators import event_rules as R
from watchloom.operators import normalize as N
from watchloom.operators import sensor as SN
from watchloom.operators.basics import last_per_group
from watchloom.sinks import tables as K

EVENT = "original_event_type"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the query; without ``every`` it works off what is there and stops.

    State is kept in RocksDB, on the executors' disks and in the checkpoint, so
    that it may outgrow memory. A query keeps the store that it was started with.
    """
    spark = writer._spark
    writer = writer.option("checkpointLocation", checkpoint)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(STATE_STORE, before)


# --- ingest ------------------------------------------------------------------------------


def normalize_stream(lines: DataFrame) -> DataFrame:
    """Log lines -> one JSON event per line (column ``value``)."""
    return N.as_json(N.normalize(N.parsed_lines(lines)))


def json_to_topic(events: DataFrame, brokers: str, topic: str) -> DataStreamWriter:
    """Writes the JSON column ``value`` to a topic. Needs the Kafka connector."""
    return (
        events.select("value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
    )


def json_to_files(events: DataFrame, path: str) -> DataStreamWriter:
    return events.select("value").writeStream.format("text").option("path", path).outputMode("append")


def ingest_events(
    messages: DataFrame, root: str, vectors: bool = True, keep: tuple[str, ...] = ()
) -> DataStreamWriter:
    """Event JSON -> one table per class, vectors of the stored events, dead letters."""

    def store(batch: DataFrame, batch_id: int) -> None:
        judged = R.judge_events(batch).drop("doc")
        with K.kept(judged):
            K.route_events(judged, f"{root}/tables", batch_id, keep=keep)
            _store_rest(judged, root, batch_id, vectors, keep)

    return messages.writeStream.foreachBatch(store)


def ingest_sensor(
    messages: DataFrame, root: str, strict: bool = True, vectors: bool = True, keep: tuple[str, ...] = ()
) -> DataStreamWriter:
    """Tagged sensor JSON -> one table per log type, vectors, dead letters."""

    def store(batch: DataFrame, batch_id: int) -> None:
        judged = SN.judge_sensor(batch, strict=strict).drop("doc")
        with K.kept(judged):
            K.route_sensor(judged, f"{root}/tables", batch_id, keep=keep)
            _store_rest(judged, root, batch_id, vectors, keep)

    return messages.writeStream.foreachBatch(store)


def _store_rest(judged: DataFrame, root: str, batch_id: int, vectors: bool, keep: tuple[str, ...]) -> None:
    if vectors:
        stored = judged.filter("status = 'SUCCESS'")
        K.write_batch(K.vector_rows(stored, "value"), f"{root}/vectors", batch_id)
    K.write_batch(K.dead_letters(judged, keep), f"{root}/dead_letters", batch_id)


def outcome_counts(judged: DataFrame) -> DataFrame:
    """Running totals per outcome and type; write with output mode ``complete``."""
    return judged.groupBy("status", "kind").agg(F.count(F.lit(1)).alias("messages"))


def raw_tap(messages: DataFrame, path: str) -> DataStreamWriter:
    """Copy of the messages as they came, for looking into a stream."""
    return messages.select("value").writeStream.format("text").option("path", path)


# --- live reports ---------------------------------------------------------------------------


def _timed(events: DataFrame, time_col: str, delay: str) -> DataFrame:
    # A watermark needs a timestamp with time zone.
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)


def into_table(changed: DataFrame, table: K.KeyedTable) -> DataStreamWriter:
    """Writes a report's changed rows (output mode ``update``) to its stored table after every batch.

    The table holds open windows with their counts so far as well as closed ones.
    """
    return changed.writeStream.outputMode("update").foreachBatch(table.upsert)


HOURLY_KEYS = ["time_bucket", EVENT]
SLIDING_KEYS = ["window_start", "src_ip"]
SESSION_KEYS = ["src_ip", "dst_ip", "session_start"]


def hourly_counts(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events per hour and type; rows up to ``delay`` late change their hour's count."""
    return (
        _timed(events, "time_dt", delay)
        .groupBy(F.window("time_dt", "1 hour"), EVENT)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(F.col("window.start").alias("time_bucket"), EVENT, "event_count")
    )


def sliding_bruteforce(
    events: DataFrame, limit: int = 3, window: str = "30 minutes", slide: str = "5 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Sources with at least ``limit`` failed logins in a sliding window."""
    return (
        _timed(events.filter(L.is_failure(F.col(EVENT))), "time_dt", delay)
        .groupBy(F.window("time_dt", window, slide), "src_ip")
        .agg(F.count(F.lit(1)).alias("guesses"))
        .filter(F.col("guesses") >= limit)
        .select(F.col("window.start").alias("window_start"), "src_ip", "guesses")
    )


def _runs(pair: np.ndarray, first: np.ndarray, last: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals, and where each run of intervals of a pair with pauses below ``gap`` begins in it."""
    order = np.lexsort((first, pair))
    points = first is last
    reach = last[order].copy()
    opens = np.ones(len(order), dtype=bool)
    pair, first = pair[order], first[order]
    if points:
        opens[1:] = (pair[1:] != pair[:-1]) | (first[1:] >= first[:-1] + gap)
        return order, np.flatnonzero(opens)
    for k in np.flatnonzero(pair[1:] == pair[:-1]) + 1:  # an interval may reach beyond later ones
        if first[k] < reach[k - 1] + gap:
            opens[k] = False
            reach[k] = max(reach[k], reach[k - 1])
    return order, np.flatnonzero(opens)


def partial_sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """(src_ip, dst_ip, first_time, last_time, n): each task's own rows, merged where pauses are below the gap.

    A pair with very many rows is thus merged where its rows are; what is
    shuffled by pair has one row per task and session. Rows without a time have no session.
    """
    gap = gap_seconds * 1_000_000

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            pair = frame.groupby(["src_ip", "dst_ip"], sort=False, dropna=False).ngroup().to_numpy()
            time = frame["us"].to_numpy(dtype=np.int64)
            order, starts = _runs(pair, time, time, gap)
            ends = np.append(starts[1:], len(order))
            heads = frame.iloc[order[starts]]
            yield pd.DataFrame({
                "src_ip": heads["src_ip"].to_numpy(), "dst_ip": heads["dst_ip"].to_numpy(),
                "first_us": time[order[starts]], "last_us": time[order[ends - 1]], "n": ends - starts,
            })

    timed = events.filter(F.col("time_dt").isNotNull())
    us = timed.select("src_ip", "dst_ip", F.unix_micros(F.col("time_dt").cast("timestamp")).alias("us"))
    merged = us.mapInPandas(merge, "src_ip string, dst_ip string, first_us bigint, last_us bigint, n bigint")
    return merged.select(
        "src_ip", "dst_ip", F.timestamp_micros("first_us").alias("first_time"), F.timestamp_micros("last_us").alias("last_time"), "n")


def sessions(events: DataFrame, gap_seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """Changed runs of events per source and target with pauses below the gap; write with output mode ``update``.

    State per pair: its sessions that rows up to ``delay`` late may still touch. A
    timer drops those that the watermark has passed. A row with ``merged_away`` says
    that a session given out before is now part of an earlier one.
    """
    gap = gap_seconds * 1_000_000
    output = "src_ip string, dst_ip string, start_us bigint, end_us bigint, events_in_session bigint, merged_away boolean"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        first, last, counts = (np.array(x, dtype=np.int64) for x in (state.get if state.exists else ([], [], [])))
        known = len(first)
        if not state.hasTimedOut:
            came = pd.concat(frames)
            came_first, came_last = (came[c].astype("int64").to_numpy() for c in ("first_us", "last_us"))
            able = came_last + gap > mark
            changed = np.concatenate([np.zeros(known, bool), np.ones(int(able.sum()), bool)])
            first, last = np.append(first, came_first[able]), np.append(last, came_last[able])
            counts = np.append(counts, came["n"].to_numpy()[able])
            order, starts = _runs(np.zeros(len(first), np.int64), first, last, gap)
            if len(starts):
                old, was_known = first[order], order < known
                new_first, new_last = old[starts], np.maximum.reduceat(last[order], starts)
                new_counts = np.add.reduceat(counts[order], starts)
                touched = np.logical_or.reduceat(changed[order], starts)
                whose = np.searchsorted(starts, np.arange(len(order)), side="right") - 1
                gone = np.setdiff1d(old[was_known], new_first)
                touched |= np.isin(new_first, new_first[whose[was_known & np.isin(old, gone)]])
                yield pd.DataFrame({
                    "src_ip": key[0], "dst_ip": key[1],
                    "start_us": np.append(new_first[touched], gone), "end_us": np.append(new_last[touched] + gap, gone),
                    "events_in_session": np.append(new_counts[touched], np.zeros(len(gone), np.int64)),
                    "merged_away": np.append(np.zeros(int(touched.sum()), bool), np.ones(len(gone), bool)),
                })
                first, last, counts = new_first, new_last, new_counts
        live = last + gap > mark
        if not live.any():
            if state.exists:
                state.remove()
            return
        state.update((first[live].tolist(), last[live].tolist(), counts[live].tolist()))
        state.setTimeoutTimestamp(int((last[live].min() + gap) // 1000) + 1)

    micros = [F.unix_micros(f"{side}_time").alias(f"{side}_us") for side in ("first", "last")]
    return (
        partial_sessions(events, gap_seconds)
        .withWatermark("last_time", delay)
        .select("src_ip", "dst_ip", "last_time", *micros, "n")
        .groupBy("src_ip", "dst_ip")
        .applyInPandasWithState(
            update, output, "first array<bigint>, last array<bigint>, n array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)
        .select("src_ip", "dst_ip", F.timestamp_micros("start_us").alias("session_start"),
                F.timestamp_micros("end_us").alias("session_end"), "events_in_session", "merged_away")
    )


def first_copies(messages: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Drops copies of a message (same text) whose time is within ``delay`` of the first one's, over all batches.

    A hash is remembered until the watermark has passed its time and the delay; a
    copy with a later time counts as a new message.
    """
    hashed = messages.withColumn("content_hash", F.sha2("value", 256))
    return _timed(hashed, time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def tail_buffer(messages: DataFrame, root: str, per_topic: int = 50) -> DataStreamWriter:
    """Keeps the newest messages per topic in ``root/batch_id=<n>``; the highest id is current.

    The next state is made from the one before the batch, so a replay repeats it;
    states before that one are deleted.
    """
    layout = messages.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch
        if batch_id > 0:
            before = spark.read.schema(layout).parquet(f"{root}/batch_id={batch_id - 1}")
            newest = before.unionByName(batch)
        K.write_batch(last_per_group(newest, "topic", "msg_offset", per_topic), root, batch_id)
        for old in K.written_batches(spark, root):
            if old < batch_id - 1:
                K.delete(spark, f"{root}/batch_id={old}")

    return messages.writeStream.foreachBatch(merge)
