"""Ordered and collecting operators that stay balanced when one key is hot.

A plain window or ``collect_list`` puts all rows of a key into one task. Here a
group is cut into time slices (or hash shares) which are worked on apart; only
one small row per slice is brought together per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.expressions import epoch_seconds

DEFAULT_SLICE_SECONDS = 3600
NO_SLICE = -(2**62)  # slice of rows without a time


def _sliced(df: DataFrame, keys: Sequence[str], time_col: str, slice_seconds: int) -> DataFrame:
    # A struct compares null fields as equal, which is what PARTITION BY does too.
    number = F.floor(epoch_seconds(F.col(time_col)) / slice_seconds).cast("bigint")
    return df.withColumn("_group", F.struct(*keys)).withColumn(
        "_slice", F.coalesce(number, F.lit(NO_SLICE))
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    ties: Sequence[str] = (),
    previous: str = "prev_event_time",
    following: str = "next_event_time",
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """LAG and LEAD of ``time_col`` per key, exact, with at most one slice per task."""
    sliced = _sliced(df, keys, time_col, slice_seconds)
    in_slice = Window.partitionBy("_group", "_slice").orderBy(time_col, *ties)
    rows = sliced.select(
        "*",
        F.lag(time_col).over(in_slice).alias("_prev"),
        F.lead(time_col).over(in_slice).alias("_next"),
    )
    across = Window.partitionBy("_group").orderBy("_slice")
    edges = (
        sliced.groupBy("_group", "_slice")
        .agg(F.min(time_col).alias("_first"), F.max(time_col).alias("_last"))
        .select(
            "_group",
            "_slice",
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
    )
    return (
        rows.join(edges, ["_group", "_slice"])
        .withColumn(previous, F.coalesce("_prev", "_before"))
        .withColumn(following, F.coalesce("_next", "_after"))
        .drop("_group", "_slice", "_prev", "_next", "_before", "_after")
    )


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    delta: str,
    out: str,
    ties: Sequence[str] = (),
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Sum of ``delta`` up to and including the row and its peers, per key."""
    sliced = _sliced(df, keys, time_col, slice_seconds)
    in_slice = (
        Window.partitionBy("_group", "_slice")
        .orderBy(time_col, *ties)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        sliced.groupBy("_group", "_slice")
        .agg(F.sum(delta).alias("_net"))
        .select("_group", "_slice", F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_carried"))
    )
    return (
        sliced.withColumn("_local", F.sum(delta).over(in_slice))
        .join(carried, ["_group", "_slice"])
        .withColumn(out, F.col("_local") + F.col("_carried"))
        .drop("_group", "_slice", "_local", "_carried")
    )


def with_sliding_count(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    counted: Column,
    window_seconds: int,
    out: str,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Number of ``counted`` rows of the key in ``[time - window, time]``, for every row.

    A counted row enters the running total at its time and leaves it just after
    its time plus the window, so the work per row does not depend on how many
    rows a window holds.
    """
    others = [c for c in df.columns if c not in (*keys, time_col)]
    moves = F.when(F.col("_counted"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    leaving = F.col("_leaves") == 1
    later = F.col(time_col) + F.make_dt_interval(secs=F.lit(window_seconds))
    both = (
        df.withColumn("_counted", counted)
        .withColumn("_leaves", F.explode(moves))
        .select(
            *keys,
            F.when(leaving, later).otherwise(F.col(time_col)).alias(time_col),
            # A leaving row is sent without its other columns.
            *[F.when(~leaving, F.col(c)).alias(c) for c in others],
            "_leaves",
            F.when(leaving, -1).when(F.col("_counted"), 1).otherwise(0).alias("_delta"),
        )
    )
    return (
        with_running_total(both, keys, time_col, "_delta", out, ["_leaves"], slice_seconds)
        .filter("_leaves = 0")
        .drop("_delta", "_leaves")
    )


def with_keys(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``groups``; null keys match each other.

    A plain inner join on one side with distinct keys, which adaptive execution
    splits when a key is hot.
    """
    wanted = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(wanted[f"_k{i}"]) for i, k in enumerate(keys)])
    return df.join(wanted, same).drop(*wanted.columns)
