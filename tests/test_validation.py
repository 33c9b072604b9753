from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J
from hookflow.functions.schema_rules import compile_schema, schema_errors, unsupported
from hookflow.operators import config, validation
from hookflow.plans.tables import VESSEL_SCHEMA, TANK_SCHEMA


def errors(spark, schema: dict, *values) -> list[list[tuple]]:
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, p string")
    out = df.select("i", schema_errors(schema, J.parse(F.col("p"))).alias("e")).orderBy("i").collect()
    return [[(e.path, e.keyword) for e in row.e] for row in out]


@pytest.mark.parametrize(
    ("schema", "good", "bad", "keyword"),
    [
        ({"type": "integer"}, [1, 2.0], [1.5, "1"], "type"),
        ({"type": ["string", "null"]}, ["a", None], [1, {}], "type"),
        ({"minimum": 0}, [0, "text"], [-1], "minimum"),
        ({"maximum": 5}, [5], [5.1], "maximum"),
        ({"exclusiveMinimum": 0}, [1], [0], "exclusiveMinimum"),
        ({"exclusiveMaximum": 5}, [4], [5], "exclusiveMaximum"),
        ({"minLength": 2}, ["ab", 1], ["a"], "minLength"),
        ({"maxLength": 2}, ["ab", "\U0001f600\U0001f600"], ["abc"], "maxLength"),
        ({"pattern": "^a+$"}, ["aa", 3], ["b"], "pattern"),
        ({"enum": ["a", 1, None]}, ["a", 1, 1.0, None], ["b", "1", True], "enum"),
        ({"const": {"a": 1}}, [{"a": 1}], [{"a": 2}, 1], "const"),
        ({"minItems": 1}, [[1], "x"], [[]], "minItems"),
        ({"maxItems": 1}, [[1]], [[1, 2]], "maxItems"),
        ({"required": ["a"]}, [{"a": None}, [1]], [{}], "required"),
    ],
)
def test_keywords(spark, schema, good, bad, keyword):
    got = errors(spark, schema, *good, *bad)
    assert got == [[]] * len(good) + [[("/", keyword)]] * len(bad)


def test_nested_paths(spark):
    schema = {
        "type": "object",
        "properties": {"a/b": {"type": "array", "items": {"type": "number"}}, "o": {"additionalProperties": False, "properties": {"k": {}}}},
    }
    got = errors(spark, schema, {"a/b": [1, "x", 2, None], "o": {"k": 1, "z": 2}}, {"o": 5}, {})
    assert got == [[("/a~1b/1", "type"), ("/a~1b/3", "type"), ("/o", "additionalProperties")], [], []]


def test_rules_of_elements(spark):
    """Any rule holds for the elements of arrays, and of arrays in them; the path names the element."""
    schema = {
        "items": {
            "type": "object", "required": ["n"], "properties": {"n": {"minimum": 0}, "tags": {"maxItems": 2, "items": {"type": "string", "minLength": 2}}},
        },
    }
    got = errors(spark, schema, [{"n": 1}, {"n": -1, "tags": ["ab", "c", 5]}, 7, {}], {"items": 1}, [])
    assert got[0] == [("/1/n", "minimum"), ("/1/tags", "maxItems"), ("/1/tags/1", "minLength"), ("/1/tags/2", "type"), ("/2", "type"), ("/3", "required")]
    assert got[1:] == [[], []]


def test_composition(spark):
    text, short, positive = {"type": "string"}, {"maxLength": 2}, {"type": "number", "exclusiveMinimum": 0}
    assert errors(spark, {"allOf": [text, short]}, "ab", "abc", 1) == [[], [("/", "maxLength")], [("/", "type")]]
    assert errors(spark, {"anyOf": [text, positive]}, "a", 2, -1) == [[], [], [("/", "type"), ("/", "exclusiveMinimum"), ("/", "anyOf")]]
    assert errors(spark, {"oneOf": [text, short, positive]}, "abc", "ab", -1, True) == [[], [("/", "oneOf")], [], []]
    assert errors(spark, {"oneOf": [text, positive]}, True) == [[("/", "type"), ("/", "type"), ("/", "oneOf")]]
    assert errors(spark, {"not": text}, 1, "a") == [[], [("/", "not")]]
    branch = {"if": {"properties": {"kind": {"const": "a"}}, "required": ["kind"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}
    assert errors(spark, branch, {"kind": "a", "x": 1}, {"kind": "a"}, {"y": 1}, {}) == [[], [("/", "required"), ("/", "if")], [], [("/", "required"), ("/", "if")]]
    nested = {"properties": {"list": {"items": {"anyOf": [text, {"properties": {"v": positive}, "required": ["v"], "type": "object"}]}}}}
    assert errors(spark, nested, {"list": ["a", {"v": 1}, {"v": 0}]}, {}) == [
        [("/list/2", "type"), ("/list/2/v", "exclusiveMinimum"), ("/list/2", "anyOf")], [],
    ]
    df = spark.createDataFrame([('"ab"',)], "p string")
    (error,) = df.select(schema_errors({"oneOf": [text, short]}, J.parse(F.col("p")))).first()[0]
    assert (error.message, error.params) == ("must match exactly one schema in oneOf", '{"passingSchemas":[0,1]}')


def test_unknown_keywords_fail_at_compile_time(spark):
    for schema in ({"$ref": "#"}, {"properties": {"a": {"format": "email"}}}, {"type": "decimal"}, {"items": {"contains": 1}}, {"items": [{}]}, {"anyOf": [True]}):
        with pytest.raises(ValueError):
            compile_schema(schema, F.lit(None).cast("variant"))
        assert unsupported(json.dumps(schema))
    assert unsupported("{") and unsupported("[]") and not unsupported("{}")


def test_unsupported_schemas_are_refused_or_touch_only_their_own(spark, table):
    schemas = table([("a", "t", 1, '{"format":"x"}', True, True), ("b", "t", 1, '{"type":"array"}', True, True)], LAYOUT)
    events = table([("1", "a", "t", "{}"), ("2", "b", "t", "{}"), ("3", "b", "t", "[]")], "id string, source string, event_type string, payload string")
    got = {r.id: r for r in validation.validate_events(events, schemas).collect()}
    assert [got[i].validation_status for i in "123"] == ["INVALID", "INVALID", "VALID"]
    assert [got[i].reject_on_fail for i in "123"] == [False, True, True]
    assert "not supported" in got["1"].validation_errors
    new = table([("c", "t", '{"format":"x"}')], "source string, event_type string, schema string")
    with pytest.raises(ValueError, match="format"):
        config.publish_schema(schemas, new)


def test_thousands_of_rules(spark, table):
    """2,000 schemas and 2,000 mappings: equal texts are compiled once, and of many different ones only those in use."""
    from hookflow.operators import transform

    def built(schemas, mappings, events):
        began = time.perf_counter()
        checked = validation.validate_events(events, table(schemas, LAYOUT))
        checked = transform.apply_mapping(checked, table(mappings, "source string, event_type string, mapping map<string,string>, active boolean"), "2024-01-01")
        checked._jdf.queryExecution().executedPlan()
        return checked, time.perf_counter() - began

    rows = [(str(i), f"s{i % 50}", f"t{i % 2000}", json.dumps({"v": i % 7})) for i in range(4000)]
    events = table(rows, "id string, source string, event_type string, payload string")
    keys = [(f"s{i % 50}", f"t{i}") for i in range(2000)]
    shared = [(*key, 1, json.dumps({"properties": {"v": {"minimum": i % 5}}}), False, True) for i, key in enumerate(keys)]
    shaped = [(*key, {"out": f"v | multiply({i % 3})"}, True) for i, key in enumerate(keys)]
    checked, seconds = built(shared, shaped, events)
    assert seconds < 30
    want = {i: ("INVALID" if int(i) % 7 < int(i) % 2000 % 5 else "VALID", json.dumps({"out": int(i) % 7 * (int(i) % 2000 % 3)}, separators=(",", ":"))) for i, *_ in rows}
    assert {r.id: (r.validation_status, r.transformed) for r in checked.collect()} == want
    apart = [(*key, 1, json.dumps({"properties": {"v": {"minimum": i}}}), False, True) for i, key in enumerate(keys)]
    few = events.filter("event_type in ('t3', 't4')")
    checked, seconds = built(apart, [(*key, {"out": f"v | multiply({i})"}, True) for i, key in enumerate(keys)] + [("s3", "*", {"w": "@id"}, True)], few)
    assert seconds < 30
    assert {(r.event_type, r.validation_status) for r in checked.collect()} <= {("t3", "VALID"), ("t3", "INVALID"), ("t4", "VALID"), ("t4", "INVALID")}


SCHEMAS = [
    ("harbor", "moored", 1, '{"type":"array"}', True, False),
    ("harbor", "moored", 2, VESSEL_SCHEMA, False, True),
    ("harbor", "gauged", 1, TANK_SCHEMA, True, True),
]
LAYOUT = "source string, event_type string, version int, schema string, reject_on_fail boolean, active boolean"


def test_statuses_and_split(spark, table):
    schemas = table(SCHEMAS, LAYOUT)
    rows = [
        ("1", "harbor", "moored", '{"ship":{"draught_cm":420,"flag":"pa"}}'),
        ("2", "harbor", "moored", '{"ship":{"draught_cm":4.5,"flag":"pa"}}'),
        ("3", "harbor", "gauged", '{"level":[1,2]}'),
        ("4", "harbor", None, "{}"),
        ("5", "harbor", "", "{}"),
        ("6", "orchard", "moored", "{}"),
        ("7", "harbor", "gauged", '{"levels":[1,"2"]}'),
    ]
    events = table(rows, "id string, source string, event_type string, payload string")
    validated = validation.validate_events(events, schemas)
    assert {r.id: r.validation_status for r in validated.collect()} == {
        "1": "VALID", "2": "INVALID", "3": "INVALID", "4": "SKIPPED", "5": "SKIPPED", "6": "NO_SCHEMA", "7": "INVALID",
    }
    accepted, rejected = validation.reject_split(validated)
    assert sorted(r.id for r in rejected.collect()) == ["3", "7"]
    assert accepted.count() == 5
    stored = {r.id: r.validation_errors for r in validated.collect()}
    assert stored["1"] is None
    assert json.loads(stored["2"]) == [
        {"path": "/ship/draught_cm", "message": "must be integer", "keyword": "type", "params": {"type": "integer"}}
    ]
    assert json.loads(stored["3"])[0]["params"] == {"missingProperty": "levels"}
    assert json.loads(stored["7"])[0]["path"] == "/levels/1"


def test_validation_does_not_shuffle_events(spark, table):
    events = table([("1", "harbor", "moored", "{}")], "id string, source string, event_type string, payload string")
    plan = validation.validate_events(events, table(SCHEMAS, LAYOUT))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
