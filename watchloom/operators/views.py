"""Views and derived records over stored events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.functions import labels as L
from watchloom.functions import values as V
from watchloom.operators.basics import union_all

ORIGINALS = "original_event_type string, user_name string, src_ip string, dst_ip string"


def security_view(tables: Iterable[DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """One flat view over stored event tables: time, original type, user, source, target, port."""
    flat = union_all([t.select(*keep, "time_dt", "raw_data") for t in tables])
    original = F.from_json("raw_data", ORIGINALS)
    return (
        flat.withColumn("_o", original)
        .select(*keep, F.col("time_dt").cast("timestamp_ntz").alias("time_dt"), "_o.*")
        .withColumn("dst_port", L.event_port(F.col("original_event_type")))
    )


def security_view_of_normalized(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same view straight from normalised events, classes that are never stored included."""
    return security_view([events.withColumn("time_dt", F.to_timestamp("time_dt"))], keep)


def latest_findings(findings: DataFrame, limit: int = 20, tie: str | None = None) -> DataFrame:
    """Newest findings as JSON: the originals of ``raw_data`` plus ``time_dt``; text that
    is no JSON object comes back as it is, with a note."""
    newest = findings.orderBy(F.desc("time_dt"), *([F.desc(tie)] if tie else [])).limit(limit)
    when = F.date_format("time_dt", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # All keys stay, in their order; the time is put behind them.
    inner = F.regexp_extract("raw_data", r"(?s)^\s*\{(.*)\}\s*$", 1)
    comma = F.when(F.trim(inner) == "", "").otherwise(",")
    readable = F.concat(F.lit("{"), inner, comma, F.lit('"time_dt":"'), when, F.lit('"}'))
    unreadable = F.to_json(
        F.struct("raw_data", F.lit("Not a valid JSON string").alias("parse_error"))
    )
    # A list with exactly this item: neither text after its end nor several items.
    listed = F.expr("""try_parse_json(concat('[', raw_data, ']'))""")
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    is_object = F.coalesce(F.json_object_keys("raw_data").isNotNull() & one, F.lit(False))
    return newest.withColumn("finding", F.when(is_object, readable).otherwise(unreadable))


def with_class_names(events: DataFrame, uid_col: str = "class_uid") -> DataFrame:
    uid = F.col(uid_col)
    return events.withColumn("class_caption", L.class_name(uid)).withColumn(
        "category_caption", L.class_category(uid)
    )


def type_uid_violations(events: DataFrame) -> DataFrame:
    """Events whose type id is not class id * 100 + activity id."""
    expected = F.col("class_uid") * 100 + F.col("activity_id")
    return events.withColumn("expected_type_uid", expected).filter(F.col("type_uid") != expected)


def document_metadata(
    docs: DataFrame, query: str | Column, metadata: str = "metadata", index: str = "position"
) -> DataFrame:
    """Document records with defaults for what the metadata lacks.

    ``query`` is the text searched for, or a column of such texts.
    ``metadata`` is a map of texts or null; ``tags`` are taken from ``tags_list`` if
    the frame has one.
    """
    meta = F.col(metadata)
    asked = F.lit(query) if isinstance(query, str) else query
    none = meta.isNull() | (F.size(meta) == 0)
    number = F.concat(F.lit("doc_"), F.col(index).cast("string"))
    default_tags = F.array(F.replace(asked, F.lit(" "), F.lit("_")))
    tags = F.coalesce(F.col("tags_list"), default_tags) if "tags_list" in docs.columns else default_tags

    def entry(name: str, default: Column) -> Column:
        return F.coalesce(F.try_element_at(meta, F.lit(name)), default)

    return docs.select(
        "*",
        entry("id", number).alias("document_id"),
        entry("source", F.lit(V.DOCUMENT_SOURCE)).alias("source"),
        F.try_element_at(meta, F.lit("timestamp")).alias("timestamp"),
        entry("category", F.lit(V.DOCUMENT_CATEGORY)).alias("category"),
        F.when(none, default_tags).otherwise(tags).alias("tags"),
        F.when(none, F.lit(V.DOCUMENT_NO_INFO))
        .otherwise(entry("additional_info", F.concat(F.lit(V.DOCUMENT_QUERY_INFO), asked)))
        .alias("additional_info"),
    )


def caption_columns(events: DataFrame) -> DataFrame:
    return events.withColumn("severity", L.caption("severity_id", F.col("severity_id"))).withColumn(
        "status", L.caption("status_id", F.col("status_id"))
    )


# --- pruning -------------------------------------------------------------------------


def pruned(column: Column, kind: T.DataType) -> Column:
    """Value without nulls, empty objects and empty lists, at any depth; '' 0 and false stay."""
    if isinstance(kind, T.StructType):
        children = [pruned(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
        filled = F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in children])
        return F.when(filled, F.struct(*children))
    if isinstance(kind, T.ArrayType):
        items = F.filter(
            F.transform(column, lambda i: pruned(i, kind.elementType)), lambda i: i.isNotNull()
        )
        return F.when(F.size(items) > 0, items)
    if isinstance(kind, T.MapType):
        entries = F.map_filter(
            F.transform_values(column, lambda _, v: pruned(v, kind.valueType)), lambda _, v: v.isNotNull()
        )
        return F.when(F.size(entries) > 0, entries)
    return column


def prune(df: DataFrame) -> DataFrame:
    return df.select(*[pruned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Drops columns that are null in every row; one counting pass."""
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if filled[c] > 0])

