"""JavaScript value semantics, the mapping language, and scalar functions."""

from __future__ import annotations

import json
import random
import struct
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J
from hookflow.functions import mapping as M
from hookflow.functions import scalars

PAYLOAD = {
    "n": 12, "whole": 2.0, "frac": 1.5, "zero": 0, "s": " Text ", "empty": "", "word": "false", "digits": " 12.50 ",
    "t": True, "f": False, "nul": None, "arr": [1, "b", None, [2, None]], "obj": {"a": 1, "length": 7},
    "12": "hidden by the number literal", "items": [{"name": "x"}], "keyed": {"0": "zero"}, "nbsp": " a﻿",
}


def results(spark, *expressions: str) -> list:
    """Parsed values of mapping expressions; the string 'undefined' when there is no value."""
    df = spark.createDataFrame([(json.dumps(PAYLOAD), "id1", "harbor", None)], "p string, id string, source string, kind string")
    context = M.Context(F.col("id"), F.col("source"), F.col("kind"), F.lit(datetime(2024, 1, 2, 3, 4, 5, 6000)))
    columns = [
        F.to_json(M.compile_expression(e, F.col("_b"), context)).alias(f"c{i}") for i, e in enumerate(expressions)
    ]
    row = df.withColumn("_b", J.parse(F.col("p"))).select(*columns).first()
    return ["undefined" if value is None else json.loads(value) for value in row]


def check(spark, cases: dict) -> None:
    got = results(spark, *cases)
    assert dict(zip(cases, got, strict=True)) == cases


def test_sources(spark):
    check(spark, {
        "@timestamp": "2024-01-02T03:04:05.006Z", "@source": "harbor", "@event_type": "*", "@id": "id1",
        "'lit'": "lit", '"lit"': "lit", "12": 12, "-2.50": -2.5, "n": 12, "obj.a": 1, "arr.1": "b", "arr.3.0": 2,
        "items.0.name": "x", "keyed.0": "zero", "arr.length": 4, "obj.length": 7, "s.length": "undefined",
        "nope": "undefined", "n.x": "undefined", "nul": None, "nul.x": "undefined", "arr.9": "undefined",
    })
    assert results(spark, "@raw")[0]["items"] == [{"name": "x"}]


def test_numbers(spark):
    check(spark, {
        "n | divide(4)": 3, "n | divide(100)": 0.12, "n | divide(0)": 12, "n | divide(x)": None, "n | divide": None,
        "s | divide(2)": " Text ", "nul | divide(2)": None, "nope | divide(2)": "undefined", "n | multiply(2.5)": 30,
        "n | multiply": None, "t | multiply(2)": True, "frac | multiply(3)": 4.5, "n | divide(0x10)": 0.75,
    })


def test_text(spark):
    check(spark, {
        "s | uppercase": " TEXT ", "s | lowercase": " text ", "s | trim": "Text", "nbsp | trim": "a", "n | uppercase": 12,
        "nul | trim": None, "s | trim | uppercase | slice(0,2)": "TE", "arr | lowercase": PAYLOAD["arr"],
    })


def test_defaults_and_arguments(spark):
    check(spark, {
        "nope | default(a)": "a", "nul | default('q r')": "q r", "nope | default(1.50)": 1.5, "nope | default(true)": True,
        "nope | default(null)": None, "empty | default(a)": "", "zero | default(1)": 0, "nope | default": "",
        "nope | default()": "undefined", "n | nothing(1)": 12, "n | bad-name": 12, "nope | default(a|b)": "undefined",
    })


def test_conversions(spark):
    check(spark, {
        "n | toString": "12", "whole | toString": "2", "frac | toString": "1.5", "t | toString": "true",
        "nul | toString": "", "nope | toString": "", "obj | toString": "[object Object]", "arr | toString": "1,b,,2,",
        "s | toString": " Text ", "n | divide(0.1) | toString": "120", "s | toNumber | toString": "NaN",
        "empty | toNumber": 0, "digits | toNumber": 12.5, "s | toNumber": None, "word | toNumber": None,
        "t | toNumber": True, "nul | toNumber": None, "s | toNumber | default(3)": None,
        "zero | toBoolean": False, "empty | toBoolean": False, "word | toBoolean": True, "nul | toBoolean": False,
        "nope | toBoolean": False, "obj | toBoolean": True, "arr | toBoolean": True, "f | toBoolean": False,
        "s | toNumber | toBoolean": False, "'0xff' | toNumber": 255, "'0b101' | toNumber": 5, "'0o17' | toNumber": 15,
        "'0xfffffffffffffffffffff' | toNumber | divide(1e25)": 1.9342813113834065, "'1d' | toNumber": None,
    })


def test_slices(spark):
    check(spark, {
        "word | slice(1)": "alse", "word | slice(-2)": "se", "word | slice(1,3)": "al", "word | slice(-3,-1)": "ls",
        "word | slice(3,1)": "", "word | slice(0,99)": "false", "word | slice": "false", "word | slice(1,x)": "",
        "word | slice(1,)": "", "arr | slice(1,3)": ["b", None], "arr | slice(-1)": [[2, None]], "n | slice(1)": 12,
    })


def test_long_chain_compiles(spark):
    chain = "s | " + " | ".join(["trim", "uppercase", "lowercase"] * 6)
    assert results(spark, chain) == ["text"]


def test_mapping_order_and_fallback():
    assert sorted(["order_id", "b", "a", "10", "9", "é"], key=M._field_order) == ["9", "10", "a", "b", "é", "order_id"]
    assert M.compile_mapping({"a": None}, None, None) is None


@pytest.mark.parametrize(
    ("text", "seconds", "ms"),
    [("72h", 259200, 259200000), ("30m", 1800, 1800000), ("3600s", 3600, 3600000), ("2d", 172800, 172800000),
     ("5", 259200, 300000), ("1w", 259200, 300000), ("", 259200, 300000), (None, 259200, 300000),
     ("5m\n", 259200, 300000), ("0s", 0, 0)],
)
def test_durations(spark, text, seconds, ms):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(scalars.parse_window(F.col("t")), scalars.parse_duration(F.col("t"))).first()
    assert tuple(row) == (seconds, ms)


def test_rounding_and_number_text(spark):
    df = spark.sql("select * from values (1.005D), (2.5D), (-2.5D), (0.0D), (1e20D), (21.428571428571427D) t(v)")
    got = df.select(scalars.js_round(F.col("v"), 2), scalars.js_round(F.col("v")), scalars.js_number_text(F.col("v"))).collect()
    assert [r[0] for r in got][:4] == [1.0, 2.5, -2.5, 0.0]
    assert [r[1] for r in got][:4] == [1.0, 3.0, -2.0, 0.0]
    assert [r[2] for r in got] == ["1.005", "2.5", "-2.5", "0", "100000000000000000000", "21.428571428571427"]


def js_text(x: float) -> str:
    """Number text by the rules of the language, from the shortest digits."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, power = Decimal(repr(abs(x))).as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + power
    text = text.rstrip("0").lstrip("0")
    count, minus = len(text), "-" if x < 0 else ""
    if count <= point <= 21:
        return minus + text + "0" * (point - count)
    if 0 < point <= 21:
        return minus + text[:point] + "." + text[point:]
    if -6 < point <= 0:
        return minus + "0." + "0" * -point + text
    tail = "." + text[1:] if count > 1 else ""
    return f"{minus}{text[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def test_number_text_is_the_shortest_placed_by_exponent(spark):
    rng = random.Random(8)
    numbers = [0.0, -0.0, 1e-7, 1.5e-7, 1e-6, 1.25e-6, 1e20, 1e21, 1.5e21, 123456789012345680000.0, 2.0**-44, 8.41e21, 1e23, 2e23, 5e-324]
    numbers += [2.2250738585072014e-308, 1.7976931348623157e308, 9007199254740993.0, 0.1 + 0.2, 1 / 3, float("nan"), float("inf"), float("-inf"), 2e-3, 9.5367431640625e-7]
    numbers += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(1500)]
    numbers += [rng.choice([-1, 1]) * float(f"{rng.randrange(10 ** rng.randint(1, 17))}e{rng.randint(-27, 25)}") for _ in range(1500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = {r.i: (r.t, r.v) for r in df.select("i", scalars.js_number_text(F.col("x")).alias("t"), J.text(F.col("x").cast("variant")).alias("v")).collect()}
    wrong = [(x, js_text(x), got[i]) for i, x in enumerate(numbers) if got[i][0] != js_text(x)]
    assert not wrong, wrong[:5]
    assert all(got[i][1] == js_text(x) for i, x in enumerate(numbers) if abs(x) < 1e15 or x != x)


def array_text(value) -> str:
    if isinstance(value, list):
        return ",".join("" if item is None else array_text(item) for item in value)
    return "[object Object]" if isinstance(value, dict) else {True: "true", False: "false"}.get(value, value) if isinstance(value, bool | str) else js_text(value)


def test_arrays_of_any_depth_as_text(spark):
    rng = random.Random(2)
    leaves = [None, True, False, 0, 12, 1.5, 1e-7, "", "a", 'q"', "[", "]", "{,}", "\\", "\\\"", "é\n", {}, {"a": [1, {"b": "}"}]}, {"]": "{"}]

    def made(depth):
        return [made(depth - 1) if depth and rng.random() < 0.5 else rng.choice(leaves) for _ in range(rng.randint(0, 4))]

    deep = 7
    for _ in range(30):
        deep = [deep]
    values = [made(rng.randint(0, 9)) for _ in range(300)] + [deep, [[], []], [[[]]], [None], [[None], [None, [None]]]]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, p string")
    got = {r.i: r.t for r in df.select("i", J.text(J.parse(F.col("p"))).alias("t")).collect()}
    assert got == {i: array_text(v) for i, v in enumerate(values)}


def test_small_results_keep_their_digits(spark):
    df = spark.createDataFrame([('{"a":1,"b":0.000012345678901234567,"c":"1e-9"}',)], "p string").withColumn("_b", J.parse(F.col("p")))
    context = M.Context(F.lit("i"), F.lit("s"), F.lit("t"), F.lit(datetime(2024, 1, 1)))
    mapping = {"x": "a | divide(10000000)", "y": "b | multiply(1)", "z": "c | toNumber", "n": "b | toString", "u": "nope | divide(2)"}
    text = df.select(M.compile_mapping(mapping, F.col("_b"), context)).first()[0]
    assert text == '{"n":"0.000012345678901234568","x":1e-7,"y":0.000012345678901234568,"z":1e-9}'


def test_body_and_response(spark):
    df = spark.createDataFrame([("x" * 1000, 200), ("x" * 1001, 299), (None, 301), ("", None)], "b string, c int")
    got = df.select(
        F.length(scalars.truncate_body(F.col("b"))),
        scalars.delivery_ok(F.col("c")),
        scalars.delivery_error(F.col("c"), F.lit("Moved")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (1000, True, None), (1003, True, None), (None, False, "HTTP 301: Moved"), (0, False, None),
    ]


def test_priority_order(spark):
    df = spark.createDataFrame([("LOW",), ("NORMAL",), ("CRITICAL",), ("HIGH",), ("?",)], "p string")
    got = [r.p for r in df.orderBy(scalars.priority_rank(F.col("p"))).collect()]
    assert got == ["CRITICAL", "HIGH", "NORMAL", "LOW", "?"]
