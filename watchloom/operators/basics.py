"""Filters, ordering, limits, joins and set operations used on their own."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

from watchloom.functions.expressions import as_datetime, before, percent, since
from watchloom.operators.skew import with_neighbours

# --- filters -----------------------------------------------------------------


def on_day(df: DataFrame, time_col: str, day: str) -> Column:
    """Within one day, as a range on the column itself so that the scan can use it."""
    midnight = as_datetime(day).replace(hour=0, minute=0, second=0, microsecond=0)
    return since(df, time_col, midnight) & before(df, time_col, midnight + timedelta(days=1))


def of_topic(messages: DataFrame, topic: str = "all") -> DataFrame:
    return messages if topic == "all" else messages.filter(F.col("topic") == topic)


def groups_with(df: DataFrame, keys: Sequence[str], more_than: int, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > more_than)


# --- order and limit -----------------------------------------------------------


def event_gaps(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """Seconds to the previous and next event of the same source and target."""
    linked = with_neighbours(events, ["src_ip", "dst_ip"], "time_dt", [tie])

    def gap(start: str, end: str) -> Column:
        return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(1e6)

    return linked.withColumn("seconds_since_previous", gap("prev_event_time", "time_dt")).withColumn(
        "seconds_to_next", gap("time_dt", "next_event_time")
    )


def share_of_total(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Count and percentage per group. The total is one value, summed from the groups'
    counts, so the rows are scanned once and the number of groups may be large."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    total = counts.agg(F.sum(out).alias("total")).scalar()
    return counts.withColumn("percentage", percent(F.col(out), total))


def last_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Newest ``n`` rows per group. The rank filter also runs before the shuffle,
    so a hot group sends at most ``n`` rows per task."""
    newest = Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def last_overall(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def latest_messages(messages: DataFrame, per_topic: int = 50, n: int = 50) -> DataFrame:
    """Last ``n`` by time of the last ``per_topic`` messages of every topic."""
    return last_overall(
        last_per_group(messages, "topic", "msg_offset", per_topic), ["msg_time", "msg_offset"], n
    )


def oldest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.asc(order)).limit(n)


def keep_newest(df: DataFrame, order: str, n: int, ranges: int = 1 << 20) -> DataFrame:
    """The ``n`` rows with the highest ``order`` number (integral; null counts as lowest).

    Rows are counted in ``ranges`` even ranges of ``order``; from the top, the range
    that the cut-off lies in is found on these counts. The rows of that range are
    counted again by their ``order`` and a share of their hash, and only those of one share
    are ranked, by their hash: rows that tie in ``order`` are split however many they are, and
    reruns keep the same ones.
    """
    if n <= 0:
        return df.limit(0)
    value = F.col(order).cast("decimal(38,0)")
    low, high = (df.agg(f(order).cast("decimal(38,0)").alias("v")).scalar() for f in (F.min, F.max))
    position = F.floor((value - low) * F.lit(ranges) / (high - low + F.lit(1))).cast("bigint")
    hashed = F.xxhash64(*(F.col(f.name) for f in df.schema.fields if not _unhashable(f.dataType)))
    placed = df.withColumns({"_range": F.coalesce(position, F.lit(-1).cast("bigint")), "_hash": hashed})
    above, edge, left = _cut_off(placed, ["_range"], F.lit(n))
    # Null has a range of its own, so a stand-in for it is compared with nothing else.
    shares = edge.withColumns({
        "_value": F.coalesce(value, F.lit(0).cast("decimal(38,0)")), "_share": F.shiftrightunsigned("_hash", 64 - TIE_BITS)
    })
    within, shared, left = _cut_off(shares, ["_value", "_share"], left)
    ranked = shared.withColumn("_rank", F.row_number().over(Window.orderBy("_hash")))
    parts = [above, within, ranked.filter(F.col("_rank") <= left)]
    return union_all([part.select(*df.columns) for part in parts])


TIE_BITS = 12  # shares of rows with the same order


def _unhashable(kind: DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def _cut_off(df: DataFrame, cells: list[str], wanted: Column) -> tuple[DataFrame, DataFrame, Column]:
    """(rows of the cells above the one in which the ``wanted``-th row lies, rows of that cell, how many it gives).

    Cells come in descending order; the window runs over one row per cell.
    """
    place = F.struct(*cells)
    counted = df.groupBy(place.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_through", F.sum("_n").over(Window.orderBy(F.desc("_cell")))
    )
    cut = counted.filter(F.col("_through") >= wanted)
    found = cut.agg(F.max(F.struct("_cell", (wanted - (F.col("_through") - F.col("_n"))).alias("left"))).alias("f")).scalar()
    # Fewer rows than wanted: all of them lie above.
    above = df.filter(F.coalesce(place > found["_cell"], F.lit(True)))
    return above, df.filter(F.coalesce(place == found["_cell"], F.lit(False))), F.coalesce(found["left"], F.lit(0))


def random_record(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row, picked by the smallest hash of key and seed: the same on every run."""
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(mixed, key).limit(1)


def format_timestamps(df: DataFrame) -> DataFrame:
    """All timestamp columns as text with three fraction digits."""
    return df.select(
        *[
            F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSS").alias(f.name)
            if isinstance(f.dataType, (TimestampType, TimestampNTZType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def display_rows(df: DataFrame, n: int = 5):
    """First rows as a pandas frame, timestamps as text."""
    return format_timestamps(df).limit(n).toPandas()


# --- joins and sets --------------------------------------------------------------


def full_outer(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """FULL OUTER JOIN as a left outer join and what only the right side has.

    Adaptive execution splits a hot key of a left outer join over several tasks,
    which it cannot do for a full outer join. The right side is tested against
    distinct keys.
    """

    def condition(a: DataFrame, b: DataFrame, pairs) -> Column:
        return reduce(lambda x, y: x & y, [a[x] == b[y] for x, y in pairs])

    left_keys = left.select(*[F.col(l).alias(f"_k{i}") for i, (l, _) in enumerate(on)]).distinct()
    kept = left.join(right, condition(left, right, on), "left_outer")
    right_only = right.join(
        left_keys, condition(right, left_keys, [(r, f"_k{i}") for i, (_, r) in enumerate(on)]), "left_anti"
    )
    return kept.unionByName(right_only, allowMissingColumns=True)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def missing_columns(existing: DataFrame, desired: DataFrame) -> list[str]:
    """Top-level columns which ``desired`` has and ``existing`` lacks."""
    have = set(existing.columns)
    return [c for c in desired.columns if c not in have]


def evolve(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of both; a column missing on one side is null there."""
    return existing.unionByName(incoming, allowMissingColumns=True)
