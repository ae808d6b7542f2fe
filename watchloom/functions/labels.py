"""Labels and captions derived from event names, ports and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.functions.expressions import lookup


def event_port(event: Column) -> Column:
    return lookup(event, V.EVENT_PORTS, V.DEFAULT_PORT)


def service_label(port: Column) -> Column:
    name = lookup(port, V.PORT_SERVICES)
    return F.when(
        name.isNotNull(), F.concat(name, F.lit(" ("), port.cast("string"), F.lit(")"))
    ).otherwise(F.concat(F.lit("Port "), port.cast("string")))


def severity_label(event: Column) -> Column:
    return (
        F.when(event.isin(V.CRITICAL_EVENTS), "CRITICAL")
        .when(event.isin(V.HIGH_EVENTS), "HIGH")
        .when(event.isin(V.MEDIUM_EVENTS), "MEDIUM")
        .otherwise("LOW")
    )


def is_success(event: Column) -> Column:
    # `_` stands for one character: a bare "success" does not count.
    return event.like("%_success")


def is_failure(event: Column) -> Column:
    return event.like("%_failure")


def attack_outcome(event: Column) -> Column:
    return (
        F.when(is_success(event), "Successful Attacks")
        .when(is_failure(event) | event.isin(V.BLOCKED_ATTACKS), "Failed Attacks")
        .otherwise("Other Malicious Activity")
    )


def caption(enum: str, value: Column) -> Column:
    """Caption of an id, null for an id outside the enum."""
    return lookup(value.cast("int"), V.ENUM_CAPTIONS[enum])


def class_name(class_uid: Column) -> Column:
    names = {uid: name for group in V.CLASS_CATALOGUE.values() for uid, name in group.items()}
    return lookup(class_uid.cast("int"), names)


def class_category(class_uid: Column) -> Column:
    names = {uid: cat for cat, group in V.CLASS_CATALOGUE.items() for uid in group}
    return lookup(class_uid.cast("int"), names)
