"""SQL expressions which check and cast JSON values held as VARIANT.

A value is addressed by ``root`` (a SQL expression of type VARIANT) and the names
leading from it to the value. All functions give SQL text: a rule set is made of
hundreds of expressions, and text is parsed in one go where Column objects would
be built one call at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

INTEGER_TEXT = r"r'^\s*[+-]?\d+(\.0*)?\s*$'"
NUMBER_TEXT = r"r'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
BOOLEAN_TEXT = "'true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', 'on', 'off', '1', '0'"
TRUE_TEXT = "'true', 't', 'yes', 'y', 'on', '1'"
DATE_TEXT = r"r'^\s*\d{4}-\d{1,2}-\d{1,2}([T ]|\s*$)'"
NUMBERS = "'BIG', 'DEC', 'DOU', 'FLO'"  # kinds of numbers, by their first letters


def whole_text(column: str) -> str:
    """The column's JSON as the one item of a list; null for text that is no JSON, also
    for text after its end. (A parser stops at the end of a value; inside a list it may not.)"""
    return f"try_parse_json(concat('[', {column}, ']'))"


def read(root: str, names: Iterable[str], sql_type: str) -> str:
    path = "$" + "".join(f'["{n}"]' for n in names)
    return f"try_variant_get({root}, '{path}', '{sql_type}')"


def value(root: str, *names: str) -> str:
    return read(root, names, "variant") if names else root


def missing(root: str, *names: str) -> str:
    """Absent or JSON null."""
    if names:  # neither has a text; a value read as VARIANT would be built anew, twice
        return f"({text(root, *names)} is null)"
    return f"({root} is null or is_variant_null({root}))"


def kind(root: str, *names: str) -> str:
    """``STRING``, ``BIGINT``, ``DECIMAL(..)``, ``DOUBLE``, ``BOOLEAN``, ``OBJECT<..>``,
    ``ARRAY<..>``, or ``VOID`` for a value that is absent or JSON null."""
    return f"coalesce(schema_of_variant({value(root, *names)}), 'VOID')"


def _is(kinds: str, root: str, *names: str) -> str:
    """Whether the kind is among ``kinds``, given by their first letters."""
    return f"(left({kind(root, *names)}, 3) in ({kinds}))"


def text(root: str, *names: str) -> str:
    """Text of a scalar; JSON text of an array or object."""
    return read(root, names, "string")


def whole(root: str, *names: str) -> str:
    """Whole number, also out of ``80.0``, ``"80"`` or ``true``."""
    fallback = f"try_cast(floor({read(root, names, 'double')}) as bigint)"
    return f"coalesce({read(root, names, 'bigint')}, {fallback})"


def truth(root: str, *names: str) -> str:
    return f"(lower({text(root, *names)}) in ({TRUE_TEXT}))"


def instant(root: str, *names: str) -> str:
    """Seconds as number or as text, else text with a full ISO date -> timestamp (UTC); else null.

    Digits alone are seconds, never a year, and a time without a date is refused.
    """
    t, k = text(root, *names), kind(root, *names)
    micros = f"timestamp_micros(try_cast(round(try_cast({t} as double) * 1e6) as bigint))"
    return (
        f"case when {_is(NUMBERS, root, *names)} or ({k} = 'STRING' and {t} rlike {NUMBER_TEXT}) then {micros} "
        f"when {k} = 'STRING' and {t} rlike {DATE_TEXT} then try_cast({t} as timestamp) end"
    )


def stored(root: str, sql_type: str) -> str:
    """Value as a typed column; the caller has checked that it fits."""
    if sql_type == "string":
        return text(root)
    if sql_type in ("bigint", "int"):
        return f"cast({whole(root)} as {sql_type})"
    if sql_type == "boolean":
        return truth(root)
    if sql_type == "timestamp":
        return instant(root)
    if sql_type == "variant":
        return root
    return read(root, (), sql_type)


# --- tests; an absent value passes all of them --------------------------------------


def not_text(root: str, *names: str) -> str:
    return f"({kind(root, *names)} not in ('VOID', 'STRING'))"


def not_scalar(root: str, *names: str) -> str:
    return _is("'OBJ', 'ARR'", root, *names)


def not_object(root: str, *names: str) -> str:
    return f"(not {_is("'VOI', 'OBJ'", root, *names)})"


def not_array(root: str, *names: str) -> str:
    return f"(not {_is("'VOI', 'ARR'", root, *names)})"


def _neither(root: str, names: Iterable[str], kinds: str, test: str) -> str:
    return f"({kind(root, *names)} not in ('VOID', {kinds}) and not coalesce({test}, false))"


def not_whole(root: str, *names: str) -> str:
    return _neither(root, names, "'BIGINT', 'BOOLEAN'", f"{text(root, *names)} rlike {INTEGER_TEXT}")


def not_number(root: str, *names: str) -> str:
    return _neither(root, names, "'BIGINT', 'BOOLEAN'", f"{text(root, *names)} rlike {NUMBER_TEXT}")


def not_truth(root: str, *names: str) -> str:
    return _neither(root, names, "'BOOLEAN'", f"lower({text(root, *names)}) in ({BOOLEAN_TEXT})")


def not_instant(root: str, *names: str) -> str:
    return f"(not {missing(root, *names)} and {instant(root, *names)} is null)"


def not_one_of(root: str, names: Iterable[str], allowed: Iterable[int]) -> str:
    """A number among ``allowed``; text does not count as a number."""
    names = tuple(names)
    listed = ", ".join(f"{a}D" for a in allowed)
    number = _is(NUMBERS, root, *names)
    fits = f"{number} and coalesce({read(root, names, 'double')} in ({listed}), false)"
    return f"(not {missing(root, *names)} and not ({fits}))"


def names_where(tests: dict[str, str]) -> str:
    """The names whose test is true, as one text; empty if there is none.

    No array that a lambda cleans: below a lambda nothing is compiled.
    """
    marks = ", ".join(f"case when {test} then '{name}' end" for name, test in tests.items())
    return f"concat_ws(', ', {marks})"
