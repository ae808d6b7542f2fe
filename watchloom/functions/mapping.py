"""Event name -> common event schema, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.functions.expressions import any_phrase, epoch_seconds, first_match, lookup


def class_uid(event: Column) -> Column:
    return first_match(event, V.CLASS_UID_RULES, V.CLASS_UID_DEFAULT)


def type_uid(event: Column) -> Column:
    login = any_phrase(event, V.LOGIN_EVENTS)
    return (
        F.when(login & event.contains("success"), F.lit(V.LOGIN_TYPE_UID_SUCCESS))
        .when(login, F.lit(V.LOGIN_TYPE_UID_FAILURE))
        .otherwise(first_match(event, V.TYPE_UID_RULES, V.TYPE_UID_DEFAULT))
    )


def activity_id(event: Column) -> Column:
    return first_match(event, V.ACTIVITY_RULES, V.ACTIVITY_DEFAULT)


# The status of an event follows the same rules as its activity.
status_id = activity_id


def severity_id(event: Column) -> Column:
    return first_match(event, V.SEVERITY_RULES, V.SEVERITY_DEFAULT)


def category_uid(event: Column) -> Column:
    return first_match(event, V.CATEGORY_RULES, V.CATEGORY_DEFAULT)


def category_name(event: Column) -> Column:
    return lookup(category_uid(event), V.CATEGORY_NAMES)


def class_name(event: Column) -> Column:
    return first_match(event, V.CLASS_NAME_RULES, V.CLASS_NAME_DEFAULT)


def activity_name(event: Column) -> Column:
    return lookup(activity_id(event), V.ACTIVITY_NAMES, V.ACTIVITY_NAME_DEFAULT)


def type_name(event: Column) -> Column:
    return first_match(event, V.TYPE_NAME_RULES, V.TYPE_NAME_DEFAULT)


def _actors(user: Column, src: Column, dst: Column) -> Column:
    return F.concat(user, F.lit(" ("), src, F.lit(" -> "), dst, F.lit(")"))


def message(event: Column, user: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("Security event: "), event, F.lit(" from "), _actors(user, src, dst))


def finding_info(event: Column, user: Column, src: Column, dst: Column, when: Column) -> Column:
    """``uid`` takes the event's own time instead of the clock: a rerun gives the same id."""
    return F.struct(
        F.concat(F.lit("Security event: "), event).alias("title"),
        F.concat(event, F.lit("_"), epoch_seconds(when).cast("string")).alias("uid"),
        F.concat(F.lit("Security event detected from "), _actors(user, src, dst)).alias("desc"),
    )


def actor(user: Column) -> Column:
    return F.struct(
        F.struct(user.alias("name"), F.lit("User").alias("type"), user.alias("uid")).alias("user")
    )


def endpoint(ip: Column) -> Column:
    return F.struct(ip.alias("ip"), F.lit("Unknown").alias("type"))


def raw_data(event: Column, user: Column, src: Column, dst: Column) -> Column:
    return F.to_json(
        F.struct(
            event.alias("original_event_type"),
            user.alias("user_name"),
            src.alias("src_ip"),
            dst.alias("dst_ip"),
        )
    )


def iso_millis(when: Column) -> Column:
    """ISO text in UTC with three fraction digits, the rest cut off."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def metadata() -> Column:
    return F.struct(
        F.lit(V.METADATA_VERSION).alias("version"),
        F.struct(
            F.lit(V.PRODUCT_NAME).alias("name"),
            F.lit(V.PRODUCT_VENDOR).alias("vendor_name"),
            F.lit(V.PRODUCT_VERSION).alias("version"),
            F.lit(V.PRODUCT_UID).alias("uid"),
        ).alias("product"),
        F.array(*[F.lit(p) for p in V.METADATA_PROFILES]).alias("profiles"),
    )
