"""JSON values with JavaScript semantics, on VARIANT columns.

SQL NULL stands for "undefined" (no such field); a VARIANT null is a JSON null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hookflow.functions.scalars import bind, js_number_text

# White space JavaScript trims, beyond what regex \s covers here.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DIGITS = "0123456789abcdef"
# Strings, marks and scalars of JSON text without white space between them.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[\]{},]|[^\[\]{},"]++'


def parse(payload: Column) -> Column:
    """JSON text to VARIANT; unreadable text becomes undefined."""
    return F.try_parse_json(payload)


def undefined() -> Column:
    return F.lit(None).cast("variant")


def json_null() -> Column:
    return F.parse_json(F.lit("null"))


def is_kind(value: Column, name: str) -> Column:
    """Whether a value is a number, string, boolean, null, array or object; false when undefined.

    Each test mentions the value once (tests nest, and copies would multiply), and the
    composite tests do not walk the value: naming the type of an object spells out all
    its fields, while reading it as an empty struct only looks at its tag.
    """
    if name == "object":
        return F.try_variant_get(value, "$", "struct<>").isNotNull()
    if name == "array":
        return elements(value).isNotNull()
    if name == "null":
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    shape = F.schema_of_variant(value)
    if name == "number":
        return F.coalesce(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    return F.coalesce(shape == name.upper(), F.lit(False))


def is_nullish(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def elements(value: Column) -> Column:
    """Elements of an array value; NULL when it is not an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def from_number(number: Column) -> Column:
    """A double as VARIANT: whole numbers as such, all others kept as doubles."""
    d = number.cast("double")
    return F.when((d == F.rint(d)) & (F.abs(d) < F.lit(9.0e18)), d.try_cast("bigint").cast("variant")).otherwise(d.cast("variant"))


def quoted(segment: str) -> str:
    return '["' + segment + '"]' if "'" in segment else "['" + segment + "']"


def field(value: Column, path: str) -> Column:
    """Value at a dot path; digits address array elements or object keys, ``length`` array sizes."""
    current = value
    plain = ""
    for segment in path.split("."):
        index = re.fullmatch(r"0|[1-9][0-9]*", segment)
        if not index and segment != "length":
            plain += quoted(segment)
            continue
        if plain:
            current, plain = F.try_variant_get(current, "$" + plain, "variant"), ""
        named = F.try_variant_get(current, "$" + quoted(segment), "variant")
        if index:
            current = F.coalesce(named, F.try_variant_get(current, f"$[{segment}]", "variant"))
        else:
            size = F.when(is_kind(current, "array"), F.size(elements(current)).cast("bigint").cast("variant"))
            current = F.coalesce(named, size)
    if plain:
        current = F.try_variant_get(current, "$" + plain, "variant")
    return current


def _scalar_text(value: Column) -> Column:
    return (
        F.when(is_kind(value, "string") | is_kind(value, "boolean"), as_string(value))
        .when(is_kind(value, "number"), number_text(value))
        .when(is_kind(value, "object"), F.lit("[object Object]"))
    )


def _flattened(value: Column) -> Column:
    """An array of any depth joined by commas: its JSON text without the brackets that stand outside strings and objects."""

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        shown = (
            F.when((state["depth"] > 0) | token.isin("[", "]", "}", "null"), "")
            .when(token == "{", "[object Object]")
            .when(token == ",", ",")
            .otherwise(bind(F.try_parse_json(token), _scalar_text))
        )
        return F.struct(depth.alias("depth"), F.concat(state["text"], shown).alias("text"))

    tokens = F.regexp_extract_all(F.to_json(value), F.lit(TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.aggregate(tokens, start, step, lambda state: state["text"])


def text(value: Column) -> Column:
    """``String(value)`` for a defined value: arrays join by comma, however deep they are, objects lose their content."""
    nested = F.exists(elements(value), lambda item: is_kind(item, "array"))
    flat = F.array_join(F.transform(elements(value), lambda item: F.when(is_nullish(item), F.lit("")).otherwise(_scalar_text(item))), ",")
    return (
        F.when(is_kind(value, "array"), F.when(nested, _flattened(value)).otherwise(flat))
        .when(is_nullish(value), F.when(value.isNotNull(), F.lit("null")))
        .otherwise(_scalar_text(value))
    )


def json_text(value: Column) -> Column:
    """A value as JSON text, numbers as JavaScript writes them; NULL when undefined."""
    return bind(value, lambda v: F.when(is_kind(v, "number"), number_text(v)).otherwise(F.to_json(v)))


def number_text(value: Column) -> Column:
    """Whole numbers keep every digit; the rest print as JavaScript doubles."""
    whole = F.try_variant_get(value, "$", "bigint")
    d = as_double(value)
    return F.when((d == F.rint(d)) & (F.abs(d) < F.lit(9.0e18)), whole.cast("string")).otherwise(js_number_text(d))


def trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+\\z", "")


def _in_base(digits: Column, base: int) -> Column:
    """Digits of a base as a double, whatever their number."""
    signs = F.filter(F.split(digits, ""), lambda sign: sign != "")
    return F.aggregate(
        signs, F.lit(0.0), lambda sum_, sign: sum_ * F.lit(float(base)) + (F.position(sign, F.lit(DIGITS)) - 1)
    )


def string_to_number(value: Column) -> Column:
    """``Number(text)``: blank is 0, hex/octal/binary prefixes count, anything else unreadable is NaN."""
    t = trim(value)
    lowered = F.lower(t)
    digits = F.substring(lowered, F.lit(3), F.length(lowered))
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(NUMBER_TEXT), t.try_cast("double"))
        .when(t.rlike(r"^\+?Infinity\z"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
        .when(lowered.rlike(r"^0x[0-9a-f]+\z"), _in_base(digits, 16))
        .when(lowered.rlike(r"^0o[0-7]+\z"), _in_base(digits, 8))
        .when(lowered.rlike(r"^0b[01]+\z"), _in_base(digits, 2))
        .otherwise(F.lit(float("nan")))
    )


def truthy(value: Column) -> Column:
    d = as_double(value)
    return (
        F.when(is_nullish(value), F.lit(False))
        .when(is_kind(value, "boolean"), F.try_variant_get(value, "$", "boolean"))
        .when(is_kind(value, "number"), (d != 0) & ~F.isnan(d))
        .when(is_kind(value, "string"), as_string(value) != "")
        .otherwise(F.lit(True))
    )


def finish(value: Column) -> Column:
    """What JSON serialisation makes of a value: not-a-number and infinities become null."""
    d = as_double(value)
    broken = is_kind(value, "number") & (F.isnan(d) | (F.abs(d) == F.lit(float("inf"))))
    return F.when(broken, json_null()).otherwise(value)
