"""JSON values as ECMAScript sees them, over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(v: Column, name: str) -> Column:
    """Whether the schema of a value begins with a name; false where there is no value."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(name)), F.lit(False))


def is_object(v: Column) -> Column:
    return _is(v, "OBJECT")


def is_array(v: Column) -> Column:
    return _is(v, "ARRAY")


def is_string(v: Column) -> Column:
    return _is(v, "STRING")


def is_present(v: Column) -> Column:
    """Neither missing nor JSON null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def _double_text(v: Column) -> Column:
    """A double as ECMAScript writes it: plain digits from 1e-6 to below 1e21, else with a signed exponent."""
    d = F.try_variant_get(v, "$", "double")
    plain = F.regexp_replace(d.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    whole = d.cast("decimal(38,0)").cast("string")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
    size = F.abs(d)
    return F.when(d == 0, "0").when((size < 1e21) & (d == F.floor(d)), whole).when((size >= 1e-6) & (size < 1e21), plain).otherwise(short)


def js_string(v: Column, depth: int = 3) -> Column:
    """What ``String(value)`` gives; null for a missing value and for JSON null.

    Integers too long for a double keep their digits. Arrays are joined by commas
    down to ``depth`` levels, JSON nulls in them are empty.
    """
    text = F.try_variant_get(v, "$", "string")
    # strings first: most values are, and the branches behind are tried in order
    choice = F.when(is_string(v), text).when(~is_present(v), F.lit(None).cast("string")).when(is_object(v), "[object Object]").when(_is(v, "DOUBLE"), _double_text(v))
    if depth:
        items = F.try_variant_get(v, "$", "array<variant>")
        choice = choice.when(is_array(v), F.array_join(F.transform(items, lambda x: F.coalesce(js_string(x, depth - 1), F.lit(""))), ","))
    return choice.otherwise(text)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def items(v: Column, name: str) -> Column:
    """The array in a field, empty where there is none."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
