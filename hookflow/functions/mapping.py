"""The field-mapping language, compiled once on the driver into native columns.

An expression is ``source | operation | operation(argument)``. Only the text of the
mapping is looked at here; values are handled by Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J

_OPERATION = re.compile(r"([A-Za-z0-9_]+)(?:\((.+)\))?")
_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?")
_DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


@dataclass(frozen=True)
class Context:
    """Event columns the ``@`` tokens read."""

    id: Column
    source: Column
    event_type: Column
    as_of: Column


def read_number(text: str | None) -> float:
    """An operation argument as a number, NaN when missing or unreadable."""
    if text is None:
        return float("nan")
    body = text.strip()
    if body == "":
        return 0.0
    if _DECIMAL.fullmatch(body):
        return float(body)
    if body.lstrip("+-") == "Infinity" and len(body) <= len("Infinity") + 1:
        return float("-inf") if body[0] == "-" else float("inf")
    base = {"0x": 16, "0o": 8, "0b": 2}.get(body[:2].lower())
    if base and body[2:].isalnum():
        try:
            return float(int(body[2:], base))
        except ValueError:
            pass
    return float("nan")


def _quoted(text: str) -> bool:
    return any(text.startswith(mark) and text.endswith(mark) for mark in ("\"", "'"))


def _number_literal(text: str) -> Column:
    if "." not in text and len(text) < 18:
        return F.lit(int(text)).cast("bigint").cast("variant")
    return J.from_number(F.lit(float(text)))


def literal_argument(text: str) -> Column:
    """Typed constant: quoted text, true, false, null, number, otherwise the bare text."""
    if _quoted(text):
        return F.lit(text[1:-1]).cast("variant")
    if text in ("true", "false"):
        return F.lit(text == "true").cast("variant")
    if text == "null":
        return J.json_null()
    if _NUMBER.fullmatch(text):
        return _number_literal(text)
    return F.lit(text).cast("variant")


def compile_path(path: str, payload: Column, context: Context) -> Column:
    """The source part of an expression as a VARIANT column."""
    tokens = {
        "@timestamp": lambda: F.date_format(context.as_of, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").cast("variant"),
        "@raw": lambda: payload,
        "@source": lambda: context.source.cast("variant"),
        "@event_type": lambda: F.coalesce(context.event_type, F.lit("*")).cast("variant"),
        "@id": lambda: context.id.cast("variant"),
    }
    if path in tokens:
        return tokens[path]()
    if _quoted(path):
        return F.lit(path[1:-1]).cast("variant")
    if _NUMBER.fullmatch(path):
        return _number_literal(path)
    return J.field(payload, path)


def _arithmetic(value: Column, apply) -> Column:
    return F.when(J.is_kind(value, "number"), J.from_number(apply(J.as_double(value)))).otherwise(value)


def _on_string(value: Column, apply) -> Column:
    return F.when(J.is_kind(value, "string"), apply(J.as_string(value)).cast("variant")).otherwise(value)


def _bound(size: Column, position: int) -> Column:
    if position < 0:
        return F.greatest(size + F.lit(position), F.lit(0))
    return F.least(size, F.lit(position))


def _position(number: float) -> int:
    if number != number:
        return 0
    limit = 2**31 - 1
    return int(max(-limit, min(limit, number)))


def _slice(value: Column, argument: str | None) -> Column:
    parts = [_position(read_number(p)) for p in (argument or "").split(",")]

    def cut(size: Column) -> tuple[Column, Column]:
        start = _bound(size, parts[0])
        end = _bound(size, parts[1]) if len(parts) > 1 else size
        return start + 1, F.greatest(end - start, F.lit(0))

    as_text, items = J.as_string(value), J.elements(value)
    text_start, text_length = cut(F.length(as_text))
    item_start, item_length = cut(F.size(items))
    return (
        F.when(J.is_kind(value, "string"), F.substring(as_text, text_start, text_length).cast("variant"))
        .when(J.is_kind(value, "array"), F.slice(items, item_start, item_length).cast("variant"))
        .otherwise(value)
    )


def compile_op(operation: str, value: Column) -> Column:
    """One operation applied to a VARIANT column; unknown or malformed operations change nothing."""
    match = _OPERATION.fullmatch(operation)
    if not match:
        return value
    name, argument = match.groups()
    if name == "divide":
        divisor = read_number(argument)
        return value if divisor == 0 else _arithmetic(value, lambda d: d / F.lit(divisor))
    if name == "multiply":
        factor = read_number(argument)
        return _arithmetic(value, lambda d: d * F.lit(factor))
    if name == "uppercase":
        return _on_string(value, F.upper)
    if name == "lowercase":
        return _on_string(value, F.lower)
    if name == "trim":
        return _on_string(value, J.trim)
    if name == "default":
        return F.when(J.is_nullish(value), literal_argument(argument or "")).otherwise(value)
    if name == "toString":
        return F.when(J.is_nullish(value), F.lit("")).otherwise(J.text(value)).cast("variant")
    if name == "toNumber":
        return F.when(
            J.is_kind(value, "string"), J.from_number(J.string_to_number(J.as_string(value)))
        ).otherwise(value)
    if name == "toBoolean":
        return J.truthy(value).cast("variant")
    if name == "slice":
        return _slice(value, argument)
    return value


def compile_expression(expression: str, payload: Column, context: Context) -> Column:
    """A whole mapping expression as a VARIANT column (SQL NULL = undefined)."""
    source, *operations = [part.strip() for part in expression.split("|")]
    value = compile_path(source, payload, context)
    for number, operation in enumerate(operations):
        # An operation mentions its input several times; from the second on it is bound
        # once, so the size of a chain grows with its length and not exponentially.
        if number:
            value = J.bind(value, partial(compile_op, operation))
        else:
            value = compile_op(operation, value)
    if any(op.startswith(("divide", "multiply", "toNumber")) for op in operations):
        value = J.bind(value, J.finish)
    return value


def _field_order(name: str) -> tuple:
    """Output order: array-index-like names by number, then shorter names first, then bytes.

    Maps carry no order of their own; this is the order stored JSON objects come back in.
    """
    if re.fullmatch(r"0|[1-9][0-9]{0,9}", name):
        return (0, int(name), b"")
    raw = name.encode()
    return (1, len(raw), raw)


def compile_mapping(mapping: Mapping[str, str | None], payload: Column, context: Context) -> Column | None:
    """Output JSON text of a mapping, or None when it cannot be evaluated and the raw payload must stand."""
    if any(not isinstance(expression, str) for expression in mapping.values()):
        return None
    if not mapping:
        return F.lit("{}")
    names = sorted(mapping, key=_field_order)
    # Undefined fields are left out.
    fields = [F.concat(F.lit(f"{json.dumps(name, ensure_ascii=False)}:"), field_text(mapping[name], payload, context)) for name in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def field_text(expression: str, payload: Column, context: Context) -> Column:
    """JSON text of one field. Only computed numbers need JavaScript's form; those of the payload keep the one they came in."""
    value = compile_expression(expression, payload, context)
    computed = any(op.strip().startswith(("divide", "multiply", "toNumber")) for op in expression.split("|")[1:])
    return J.json_text(value) if computed else F.to_json(value)
