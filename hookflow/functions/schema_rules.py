"""A JSON Schema subset compiled into error columns.

Each rule becomes a column that is NULL when the rule holds and an array of error
structs when it does not. Keywords outside the subset fail at compile time, so a
schema is never silently half-checked.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J

ANNOTATIONS = {"$schema", "$id", "$comment", "title", "description", "examples", "default"}
KEYWORDS = {
    "type", "required", "properties", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "minLength", "maxLength", "pattern", "enum", "const", "items", "minItems", "maxItems",
    "additionalProperties", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
ERROR_TYPE = "array<struct<path:string,message:string,keyword:string,params:string>>"
TYPES = {"null", "boolean", "object", "array", "number", "integer", "string"}


def _matches(value: Column, name: str) -> Column:
    if name == "integer":
        d = J.as_double(value)
        return J.is_kind(value, "number") & F.coalesce(d == F.rint(d), F.lit(False))
    return J.is_kind(value, name)


# Where a value stands: text, or a column inside the elements of an array.
Path = str | Column


def _pointer(parent: Path, key: str) -> Path:
    step = "/" + key.replace("~", "~0").replace("/", "~1")
    return parent + step if isinstance(parent, str) else F.concat(parent, F.lit(step))


def _as_column(path: Path) -> Column:
    return F.lit(path) if isinstance(path, str) else path


def _error(path: Path, message: str | Column, keyword: str, params: str | Column) -> Column:
    def column(part: str | Column) -> Column:
        return part if isinstance(part, Column) else F.lit(part)

    return F.struct(
        column(path if isinstance(path, Column) else path or "/").alias("path"),
        column(message).alias("message"),
        F.lit(keyword).alias("keyword"),
        column(params).alias("params"),
    )


def _json(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _same(value: Column, expected: Any) -> Column:
    """Deep equality with a constant; numbers by value, composites by their JSON text."""
    if isinstance(expected, bool):
        return J.is_kind(value, "boolean") & (F.try_variant_get(value, "$", "boolean") == F.lit(expected))
    if isinstance(expected, int | float):
        return J.is_kind(value, "number") & (J.as_double(value) == F.lit(float(expected)))
    if isinstance(expected, str):
        return J.is_kind(value, "string") & (J.as_string(value) == F.lit(expected))
    if expected is None:
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(_json(expected))))


def _type_rules(schema: dict, value: Column, path: Path) -> list[Column]:
    wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    unknown = set(wanted) - TYPES
    if unknown:
        raise ValueError(f"unknown JSON type {sorted(unknown)}")
    fits = F.lit(False)
    for name in wanted:
        fits = fits | _matches(value, name)
    error = _error(path, f"must be {','.join(wanted)}", "type", _json({"type": schema["type"]}))
    return [F.when(value.isNotNull() & ~fits, F.array(error))]


def _limit_rules(schema: dict, value: Column, path: Path) -> list[Column]:
    """Ordered comparisons: each entry is keyword, guard kind, measured column, violation, message."""
    d = J.as_double(value)
    length = F.length(J.as_string(value))
    count = F.size(J.elements(value))
    numeric: list[tuple[str, str, Callable[[Any], Column]]] = [
        ("maximum", "<=", lambda n: d > n),
        ("minimum", ">=", lambda n: d < n),
        ("exclusiveMaximum", "<", lambda n: d >= n),
        ("exclusiveMinimum", ">", lambda n: d <= n),
    ]
    out = []
    for keyword, sign, broken in numeric:
        if keyword in schema:
            limit = schema[keyword]
            error = _error(path, f"must be {sign} {_json(limit)}", keyword, _json({"comparison": sign, "limit": limit}))
            out.append(F.when(J.is_kind(value, "number") & broken(F.lit(float(limit))), F.array(error)))
    sized = [
        ("maxLength", "string", length, True, "characters"),
        ("minLength", "string", length, False, "characters"),
        ("maxItems", "array", count, True, "items"),
        ("minItems", "array", count, False, "items"),
    ]
    for keyword, guard, size, upper, noun in sized:
        if keyword in schema:
            limit = int(schema[keyword])
            message = f"must NOT have {'more' if upper else 'fewer'} than {limit} {noun}"
            broken = (size > limit) if upper else (size < limit)
            error = _error(path, message, keyword, _json({"limit": limit}))
            out.append(F.when(J.is_kind(value, guard) & broken, F.array(error)))
    if "pattern" in schema:
        pattern = schema["pattern"]
        error = _error(path, f"must match pattern \"{pattern}\"", "pattern", _json({"pattern": pattern}))
        out.append(F.when(J.is_kind(value, "string") & ~J.as_string(value).rlike(pattern), F.array(error)))
    return out


def _constant_rules(schema: dict, value: Column, path: Path) -> list[Column]:
    out = []
    if "const" in schema:
        error = _error(path, "must be equal to constant", "const", _json({"allowedValue": schema["const"]}))
        out.append(F.when(value.isNotNull() & ~_same(value, schema["const"]), F.array(error)))
    if "enum" in schema:
        allowed = F.lit(False)
        for item in schema["enum"]:
            allowed = allowed | F.coalesce(_same(value, item), F.lit(False))
        error = _error(
            path, "must be equal to one of the allowed values", "enum", _json({"allowedValues": schema["enum"]})
        )
        out.append(F.when(value.isNotNull() & ~allowed, F.array(error)))
    return out


def _item_rules(schema: dict, value: Column, path: Path) -> list[Column]:
    """The rules of ``items`` for every element, whose index becomes part of the error's path."""
    rules = schema["items"]
    if not isinstance(rules, dict):
        raise ValueError("items must be one schema")

    def of_element(item: Column, position: Column) -> Column:
        return _all(_rules(rules, item, (), F.concat(_as_column(path), F.lit("/"), position.cast("string"))))

    if not _rules(rules, F.lit(None).cast("variant"), (), ""):
        return []
    errors = F.flatten(F.transform(J.elements(value), of_element))
    return [F.when(J.is_kind(value, "array") & (F.size(errors) > 0), errors)]


def _all(rules: list[Column]) -> Column:
    """All errors of some rules as one array, empty where they hold."""
    if not rules:
        return F.array().cast(ERROR_TYPE)
    return F.flatten(F.array_compact(F.array(*rules))).cast(ERROR_TYPE)


def _composed_rules(schema: dict, body: Column, steps: tuple[str, ...], path: Path) -> list[Column]:
    """Schemas made of schemas. An undefined value passes every part, as it does every rule."""
    value = _at(body, steps)

    def part(rules: Any) -> Column:
        if not isinstance(rules, dict):
            raise ValueError("boolean schemas are not supported")
        return _all(_rules(rules, body, steps, path))

    def failed(keyword: str, message: str, params: str | Column) -> Column:
        return F.array(_error(path, message, keyword, params))

    def passed(errors: Column) -> Column:
        return F.size(errors) == 0

    out = []
    for rules in schema.get("allOf", []):
        out.append(F.nullif(part(rules), F.array().cast(ERROR_TYPE)))
    if "anyOf" in schema:
        parts = [part(rules) for rules in schema["anyOf"]]
        none = F.lit(True)
        for errors in parts:
            none = none & ~passed(errors)
        out.append(F.when(value.isNotNull() & none, F.concat(*parts, failed("anyOf", "must match a schema in anyOf", "{}"))))
    if "oneOf" in schema:
        parts = [part(rules) for rules in schema["oneOf"]]
        right = F.array_compact(F.array(*(F.when(passed(errors), F.lit(i)) for i, errors in enumerate(parts))))
        first_two = F.concat(F.lit('{"passingSchemas":['), F.array_join(F.slice(right, 1, 2).cast("array<string>"), ","), F.lit("]}"))
        message = "must match exactly one schema in oneOf"
        none = F.concat(*parts, failed("oneOf", message, '{"passingSchemas":null}'))
        many = failed("oneOf", message, first_two)
        out.append(F.when(value.isNotNull(), F.when(F.size(right) == 0, none).when(F.size(right) > 1, many)))
    if "not" in schema:
        out.append(F.when(value.isNotNull() & passed(part(schema["not"])), failed("not", "must NOT be valid", "{}")))
    if "if" in schema:
        holds = passed(part(schema["if"]))
        for keyword, applies in (("then", holds), ("else", ~holds)):
            if keyword in schema:
                errors = part(schema[keyword])
                said = failed("if", f'must match "{keyword}" schema', _json({"failingKeyword": keyword}))
                out.append(F.when(value.isNotNull() & applies & ~passed(errors), F.concat(errors, said)))
    return out


def _object_rules(schema: dict, body: Column, steps: tuple[str, ...], path: Path) -> list[Column]:
    out = []
    value = _at(body, steps)
    is_object = J.is_kind(value, "object")
    for name in schema.get("required", []):
        error = _error(path, f"must have required property '{name}'", "required", _json({"missingProperty": name}))
        out.append(F.when(is_object & _at(body, (*steps, name)).isNull(), F.array(error)))
    if schema.get("additionalProperties", True) is False:
        known = [F.lit(name) for name in schema.get("properties", {})]
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        extra = F.array_except(keys, F.array(*known)) if known else keys
        errors = F.transform(
            extra,
            lambda key: _error(
                path,
                "must NOT have additional properties",
                "additionalProperties",
                F.to_json(F.struct(key.alias("additionalProperty"))),
            ),
        )
        out.append(F.when(is_object & (F.size(errors) > 0), errors))
    for name, rules in schema.get("properties", {}).items():
        if isinstance(rules, bool):
            raise ValueError("boolean property schemas are not supported")
        out.extend(_rules(rules, body, (*steps, name), _pointer(path, name)))
    return out


def _at(body: Column, steps: tuple[str, ...]) -> Column:
    """A nested property, read from the root in one step; undefined when a parent is no object."""
    if not steps:
        return body
    return F.try_variant_get(body, "$" + "".join(J.quoted(step) for step in steps), "variant")


def _rules(schema: dict, body: Column, steps: tuple[str, ...], path: Path) -> list[Column]:
    value = _at(body, steps)
    unknown = set(schema) - KEYWORDS - ANNOTATIONS
    if unknown:
        raise ValueError(f"unsupported schema keyword: {sorted(unknown)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be a boolean")
    out = _type_rules(schema, value, path) if "type" in schema else []
    out += _limit_rules(schema, value, path)
    out += _constant_rules(schema, value, path)
    if "items" in schema:
        out += _item_rules(schema, value, path)
    out += _object_rules(schema, body, steps, path)
    return out + _composed_rules(schema, body, steps, path)


def compile_schema(schema: dict, payload: Column) -> list[Column]:
    """Rule columns of a schema over a VARIANT payload."""
    return _rules(schema, payload, (), "")


def schema_errors(schema: dict, payload: Column) -> Column:
    """All violations of a schema as one array, empty when the payload conforms."""
    return _all(compile_schema(schema, payload))


def unsupported(text: str) -> str | None:
    """Why a schema cannot be compiled, or None if it can."""
    try:
        compile_schema(json.loads(text), F.lit(None).cast("variant"))
    except (ValueError, TypeError, AttributeError) as error:
        return str(error) or type(error).__name__
    return None
