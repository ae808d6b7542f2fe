"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def epoch_start() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def as_datetime(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def time_literal(df: DataFrame, time_col: str, value: str | datetime) -> Column:
    """A literal of exactly the column's type, so that the comparison reaches the scan."""
    text = as_datetime(value).isoformat(sep=" ")
    return F.lit(text).cast(df.schema[time_col].dataType)


def since(df: DataFrame, time_col: str, as_of: str | datetime, **ago: float) -> Column:
    """``time_col >= as_of - ago``; ``ago`` as for ``timedelta`` (hours=24, days=7 ...)."""
    return F.col(time_col) >= time_literal(df, time_col, as_datetime(as_of) - timedelta(**ago))


def before(df: DataFrame, time_col: str, as_of: str | datetime, **ago: float) -> Column:
    return F.col(time_col) < time_literal(df, time_col, as_datetime(as_of) - timedelta(**ago))


def truncate(unit: str, time_col: Column | str) -> Column:
    """``date_trunc`` that gives back a zone-less timestamp."""
    col = F.col(time_col) if isinstance(time_col, str) else time_col
    return F.date_trunc(unit, col).cast("timestamp_ntz")



def epoch_seconds(time_col: Column) -> Column:
    """Whole seconds since 1970 of a zone-less UTC timestamp, rounded down."""
    return F.timestamp_diff("SECOND", epoch_start(), time_col)


def epoch_micros(time_col: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch_start(), time_col.cast("timestamp_ntz"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def first_match(text: Column, rules: Sequence[tuple[str, object]], default: object) -> Column:
    """Value of the first rule one of whose ``|``-separated words occurs in ``text``."""
    chain = F
    for words, value in rules:
        chain = chain.when(any_phrase(text, words.split("|")), F.lit(value))
    return chain.otherwise(F.lit(default))


def lookup(key: Column, table: Mapping, default: object = None) -> Column:
    """Map lookup for a fixed, small table; no join needed."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, rounded half up in decimal arithmetic; null when ``whole`` is 0."""
    exact = part.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)") / F.nullif(
        whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")
    )
    return F.round(exact, digits).cast("double")


def sorted_text(items: Column, separator: str = ", ") -> Column:
    return F.array_join(F.array_sort(items), separator)


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    hit = text.contains(phrases[0])
    for phrase in phrases[1:]:
        hit = hit | text.contains(phrase)
    return hit


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out exactly once per row.

    The optimizer copies the expression of an ordinary column into every later
    use, also into filters; that is ruinous for a parsed document which hundreds
    of expressions read. A one-element ``inline`` is a boundary it respects. The
    expressions stand in a projection below it: a generator that holds a lambda is
    interpreted node by node, while a projection runs as generated code.
    """
    made = {f"_made_{n}": c for n, c in columns.items()}
    values = F.struct(*[F.col(f"`{m}`").alias(n) for m, n in zip(made, columns)])
    rows = df.select("*", *[c.alias(m) for m, c in made.items()])
    return rows.select("*", F.inline(F.array(values))).drop(*made)
