"""Event log lines -> events of the common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions import mapping as M
from watchloom.functions import values as V
from watchloom.functions.expressions import bind

_MARK = "\n"  # the captured parts hold no line end
PARSED = ["event_time", "event", "user", "src_ip", "dst_ip"]


def _line_parts(line: Column) -> Column:
    """The five captured parts in an array, null for a line that does not match.

    One regex pass puts the parts side by side; a line without match comes back
    unchanged.
    """
    marked = F.regexp_replace(line, V.LOG_LINE_PATTERN, _MARK.join(f"${i}" for i in range(1, 6)))
    return F.when(marked != line, F.split(marked, _MARK))


def parse_log_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Adds time, event, user, source and target; all null where a line is not understood."""
    parts = bind(lines, _parts=_line_parts(F.col(line_col)))
    # A date which does not exist is as unreadable as any other text.
    stamped = bind(parts, event_time=F.col("_parts")[0].try_cast("timestamp_ntz"))
    readable = F.col("event_time").isNotNull()
    return stamped.select(
        *lines.columns,
        "event_time",
        *[F.when(readable, F.col("_parts")[i]).alias(n) for i, n in enumerate(PARSED) if i > 0],
    )


def parsed_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    return parse_log_lines(lines, line_col).filter(F.col("event_time").isNotNull())


def rejected_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Quarantine: lines which the pattern does not match, as they came."""
    parsed = parse_log_lines(lines, line_col)
    return parsed.filter(F.col("event_time").isNull()).select(*lines.columns)


def event_columns() -> dict[str, Column]:
    """All fields of the common schema, from the parsed columns."""
    event, user, src, dst, when = (F.col(c) for c in ("event", "user", "src_ip", "dst_ip", "event_time"))
    return {
        "metadata": M.metadata(),
        "class_uid": M.class_uid(event),
        "type_uid": M.type_uid(event),
        "activity_id": M.activity_id(event),
        "severity_id": M.severity_id(event),
        "status_id": M.status_id(event),
        "category_uid": M.category_uid(event),
        "class_name": M.class_name(event),
        "finding_info": M.finding_info(event, user, src, dst, when),
        "actor": M.actor(user),
        "src_endpoint": M.endpoint(src),
        "dst_endpoint": M.endpoint(dst),
        "time": M.epoch_seconds(when),
        "time_dt": M.iso_millis(when),
        "message": M.message(event, user, src, dst),
        "category_name": M.category_name(event),
        "activity_name": M.activity_name(event),
        "type_name": M.type_name(event),
        "raw_data": M.raw_data(event, user, src, dst),
    }


def normalize(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of the common schema; the five source columns are dropped."""
    return parsed.select(*keep, *[c.alias(n) for n, c in event_columns().items()])


def as_json(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text per event (column ``value``)."""
    fields = [c for c in events.columns if c not in keep]
    return events.select(*keep, F.to_json(F.struct(*fields)).alias("value"))
