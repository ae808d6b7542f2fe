"""Common-schema JSON events -> outcome per message and one table per class."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import schemas as S
from watchloom.functions import values as V
from watchloom.functions.expressions import bind, percent
from watchloom.operators import variants as J


def table_name(class_name: str, prefix: str = "") -> str:
    return prefix + class_name.lower().replace(" ", "_")


_TESTS = {
    # Numbers may stand for text and digits for numbers.
    "str": J.not_scalar,
    "int": J.not_whole,
    "float": J.not_number,
    "bool": J.not_truth,
    "ts": J.not_instant,
    "list": J.not_array,
}


def _object_breaks(root: str, names: tuple[str, ...], object_name: str) -> str:
    """A present object lacks a required child, or a child is not accepted."""
    required, nested = [], []
    for rule in S.OBJECTS[object_name]:
        address = (*names, rule.name)
        if rule.required:
            required.append(J.missing(root, *address))
        if rule.kind in ("object", "objects"):
            nested.append(_if_there(root, address, _nested_breaks(root, address, rule)))
        elif rule.kind == "enum":
            ids = V.OBJECT_ENUMS.get(rule.detail) or V.ENUM_CAPTIONS[rule.detail]
            nested.append(_if_there(root, address, J.not_one_of(root, address, ids)))
        elif rule.kind != "any":
            nested.append(_if_there(root, address, _TESTS[rule.kind](root, *address)))
    # What has a required child is an object; only without one the kind is looked at.
    tests = (required or [J.not_object(root, *names)]) + nested
    return f"(not {J.missing(root, *names)} and ({' or '.join(tests)}))"


def _nested_breaks(root: str, names: tuple[str, ...], field: S.Field) -> str:
    if field.kind == "object":
        return _object_breaks(root, names, field.detail)
    items = J.read(root, names, "array<variant>")
    broken = f"{J.missing('item')} or {_object_breaks('item', (), field.detail)}"
    return f"({J.not_array(root, *names)} or coalesce(exists({items}, item -> {broken}), false))"


def _if_there(root: str, names: tuple[str, ...], breaks: str) -> str:
    """Spares the test of a field that the document does not have, as most fields are; JSON null passes all tests."""
    return f"(case when {J.missing(root, *names)} then false else {breaks} end)"


def _field_breaks(root: str, field: S.Field) -> str:
    if field.kind == "any":
        return "false"
    if field.kind == "enum":
        return J.not_one_of(root, (), V.ENUM_CAPTIONS[field.detail])
    if field.kind in ("object", "objects"):
        return _nested_breaks(root, (), field)
    return _TESTS[field.kind](root)


@cache
def bad_fields(class_uid: int) -> str:
    """Names of top-level fields of ``doc`` that are missing or not accepted."""
    tests = {}
    for field in S.EVENTS[class_uid]:
        root = f"doc.`{field.name}`"
        breaks = _if_there(root, (), _field_breaks(root, field))
        tests[field.name] = f"{J.missing(root)} or {breaks}" if field.required else breaks
    return J.names_where(tests)


def _document(value_col: str) -> Column:
    names = dict.fromkeys(f.name for fields in S.EVENTS.values() for f in fields)
    return F.from_json(value_col, ", ".join(f"`{n}` variant" for n in names))


def parsed_again(judged: DataFrame, value_col: str = "value") -> DataFrame:
    """Judged messages that were kept without ``doc``, with it."""
    return bind(judged.drop("doc"), doc=_document(value_col))


def judge_events(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds ``doc`` (a struct of VARIANT fields), ``class_uid``, ``kind`` (class name),
    ``status`` and ``reason``."""
    parsed = bind(messages, doc=_document(value_col))
    # Only a JSON number selects a class: the text "2004" does not.
    uid = "doc.class_uid"
    unknown = f"{J.missing(uid)} or {J.not_one_of(uid, (), V.STORED_CLASSES)}"
    parsed = bind(
        parsed, class_uid=F.expr(f"case when not ({unknown}) then cast({J.whole(uid)} as int) end")
    )
    per_class, names = F, F
    for class_uid, name in V.STORED_CLASSES.items():
        of_class = F.col("class_uid") == class_uid
        per_class = per_class.when(of_class, F.expr(bad_fields(class_uid)))
        names = names.when(of_class, F.lit(name))
    given_name = F.expr(J.text("doc.class_name"))
    is_object = F.json_object_keys(value_col).isNotNull()
    # Text after the end of the object; what follows an inner brace of an object is looked at more closely.
    whole = F.expr(J.whole_text(f"`{value_col}`"))
    followed = ~F.rtrim(F.col(value_col)).endswith("}") | F.col(value_col).rlike(r"\}\s*,?\s*\{")
    tail = F.when(
        followed,
        F.try_variant_get(whole, "$[0]", "variant").isNull() | F.try_variant_get(whole, "$[1]", "variant").isNotNull(),
    ).otherwise(F.lit(False))
    checked = bind(
        parsed,
        _bad=per_class,
        kind=names.otherwise(F.coalesce(given_name, F.lit("Unknown"))),
        # Looked at only for what is no event of a known class, or may have text after its end.
        _problem=F.when(tail & is_object, "invalid JSON").when(
            F.col("class_uid").isNull(),
            F.when(~is_object & F.try_parse_json(value_col).isNull(), "invalid JSON")
            .when(~is_object, "not an object")
            .otherwise("unsupported class"),
        ),
    )
    reason = F.coalesce(
        F.col("_problem"),
        F.when(F.col("_bad") != "", F.concat(F.lit("invalid: "), "_bad")),
    )
    status = (
        F.when(F.col("_problem").isin("invalid JSON", "not an object"), "ERROR")
        .when(F.col("reason").isNotNull(), "SKIPPED")
        .otherwise("SUCCESS")
    )
    judged = checked.withColumn("reason", reason).withColumn("status", status)
    return judged.drop("_bad", "_problem")


def event_table(judged: DataFrame, class_uid: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Accepted events of one class. Scalars are typed columns; objects stay VARIANT,
    whole; fields the class does not know are dropped."""
    rows = judged.filter((F.col("status") == "SUCCESS") & (F.col("class_uid") == class_uid))
    defaults = S.EVENT_DEFAULTS[class_uid]
    columns = []
    for field in S.EVENTS[class_uid]:
        stored = F.expr(J.stored(f"doc.`{field.name}`", field.sql_type))
        if field.name in defaults:
            stored = F.coalesce(stored, F.lit(defaults[field.name]).cast(field.sql_type))
        columns.append(stored.alias(field.name))
    return rows.select(*keep, *columns)


def outcome_report(judged: DataFrame) -> DataFrame:
    """Messages per outcome with their share (``part`` total), and successes and skips
    per log type or class (``part`` kind). Errors have no type and are only part of
    the totals. The messages are judged once; both parts come from the counts.
    """
    counted = judged.groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"))
    status = F.col("status")
    parts = F.array(
        F.struct(F.lit("total").alias("part"), status.alias("name")),
        F.struct(F.lit("kind").alias("part"), F.when(status != "ERROR", F.col("kind")).alias("name")),
    )
    is_kind = F.col("part") == "kind"

    def of(outcome: str) -> Column:
        return F.sum(F.when(is_kind, F.when(F.col("status") == outcome, F.col("n")).otherwise(0)))

    summed = (
        counted.select("*", F.inline(parts))
        .filter(F.col("name").isNotNull())
        .groupBy("part", "name")
        .agg(
            F.sum(F.when(~is_kind, F.col("n"))).alias("messages"),
            of("SUCCESS").alias("success"),
            of("SKIPPED").alias("skipped"),
        )
    )
    # Three rows at most in the part that is divided.
    total = F.sum("messages").over(Window.partitionBy("part"))
    return summed.withColumn("percentage", percent(F.col("messages"), total))
