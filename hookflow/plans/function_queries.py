"""The mapping language and the scalar functions, each over every event."""

from __future__ import annotations

from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J
from hookflow.functions import mapping as M
from hookflow.functions import scalars
from hookflow.operators import transform
from hookflow.plans.metric_queries import NOW, rnd
from hookflow.plans.registry import query
from hookflow.plans.tables import Tables

# What each value of the type-changing field reads back as, when an operation leaves it alone.
SAME = (
    "case event_id % 10 when 0 then '12' when 1 then '2' when 2 then '\" Text \"' when 3 then '\"\"' when 4 then '\"false\"'"
    " when 5 then 'true' when 6 then 'null' when 8 then '[1,\"b\",null]' when 9 then '{\"a\":1}' end"
)


def mixed(changes: dict[int, str]) -> str:
    """Expected JSON text of the type-changing field, with the cases an operation changes."""
    cases = " ".join(f"when {k} then {v}" for k, v in changes.items())
    return f"case event_id % 10 {cases} else {SAME} end" if changes else SAME


def evaluated(t: Tables, **expressions: str):
    """id and the JSON text of each mapping expression."""
    as_of = t.as_of()
    context = M.Context(F.col("id"), F.col("source"), F.col("event_type"), as_of)
    rows = t.orders_env.withColumn("_body", J.parse(F.col("payload")))
    return rows.select(
        "id", *[M.field_text(e, F.col("_body"), context).alias(n) for n, e in expressions.items()]
    )


def json_string(expr: str) -> str:
    return f"concat('\"', {expr}, '\"')"


CENTS = "cast(round(value * 100) as bigint)"
AMOUNT = (
    f"case when {CENTS} % 100 = 0 then cast({CENTS} // 100 as varchar) else cast({CENTS} / 100.0::double as varchar) end"
)
# Fields come in the order of the stored object: shorter names first, then by bytes.
EXACT_BODY = (
    "concat('{\"kind\":\"', event_type, '\",\"unit\":\"USD\",\"berth\":\"open sea\",\"cargo\":\"', event_type,"
    f" '\",\"ticket\":\"', upper(substr(concat('evt_', id), 5, 8)), '\",\"tonnes\":', {AMOUNT}, '}}')"
)
WILD_BODY = "concat('{\"log\":\"', id, '\",\"note\":\"', event_type, '\",\"port\":\"', source, '\"}')"
BODY = (
    f"case when source = 'harbor' and event_type = 'purchase' then {EXACT_BODY} when source = 'harbor' then {WILD_BODY}"
    " else order_payload end"
)


@query("f_apply_mapping", f"select id, {BODY} as transformed, source = 'harbor' as has_transform from env")
def _(t: Tables):
    return transform.apply_mapping(t.orders_env, t.transforms, t.as_of()).select("id", "transformed", "has_transform")


@query(
    "f_transform_preview",
    f"select id, order_payload as original, {BODY} as transformed, source = 'harbor' as has_transform from env",
)
def _(t: Tables):
    return transform.transform_preview(t.orders_env, t.transforms, t.as_of())


@query(
    "f_path",
    f"select id, {json_string('event_type')} as item, user_id::varchar as qty, '2' as size, '\"seven\"' as keyed,"
    f" cast({CENTS} as varchar) as amount, null::varchar as absent, null::varchar as through_scalar from env",
)
def _(t: Tables):
    return evaluated(
        t,
        item="order.items.0.name",
        qty="order.items.0.qty",
        size="order.items.length",
        keyed="order.7",
        amount="amount",
        absent="order.items.5.name",
        through_scalar="amount.cents",
    )


@query("f_timestamp", f"select id, {json_string(f'strftime({NOW}, $$%Y-%m-%dT%H:%M:%S.%gZ$$)')} as result from env")
def _(t: Tables):
    return evaluated(t, result="@timestamp")


@query(
    "f_raw",
    "select id, cast(json_extract_string(order_payload, '$.id') as varchar) as event, json_extract_string(order_payload, '$.order.7') as keyed from env",
)
def _(t: Tables):
    raw = J.parse(F.col("result"))
    out = evaluated(t, result="@raw")
    return out.select(
        "id", J.as_string(J.field(raw, "id")).alias("event"), J.as_string(J.field(raw, "order.7")).alias("keyed")
    )


@query("f_source", f"select id, {json_string('source')} as result from env")
def _(t: Tables):
    return evaluated(t, result="@source")


@query("f_event_type", f"select id, {json_string('event_type')} as result from env")
def _(t: Tables):
    return evaluated(t, result="@event_type")


@query("f_id", f"select id, {json_string('id')} as result from env")
def _(t: Tables):
    return evaluated(t, result="@id")


@query("f_quoted_literal", "select id, '\"fixed text\"' as single_quoted, '\"EUR\"' as double_quoted from env")
def _(t: Tables):
    return evaluated(t, single_quoted="'fixed text'", double_quoted='"eur" | uppercase')


@query("f_number_literal", "select id, '-3' as whole, '2.5' as fraction, '21' as scaled from env")
def _(t: Tables):
    return evaluated(t, whole="-3", fraction="2.5", scaled="42 | divide(2)")


@query(
    "f_divide",
    f"select id, {AMOUNT} as amount, {mixed({0: chr(39) + '3' + chr(39), 1: chr(39) + '0.5' + chr(39)})} as mixed, {SAME} as by_zero,"
    f" {mixed({0: chr(39) + 'null' + chr(39), 1: chr(39) + 'null' + chr(39)})} as by_text from env",
)
def _(t: Tables):
    return evaluated(
        t, amount="amount | divide(100)", mixed="mixed | divide(4)", by_zero="mixed | divide(0)", by_text="mixed | divide(x)"
    )


@query(
    "f_multiply",
    f"select id, cast({CENTS} * 3 as varchar) as amount, {mixed({0: chr(39) + '30' + chr(39), 1: chr(39) + '5' + chr(39)})} as mixed from env",
)
def _(t: Tables):
    return evaluated(t, amount="amount | multiply(3)", mixed="mixed | multiply(2.5)")


@query(
    "f_uppercase",
    f"select id, {json_string('upper(event_type)')} as kind, {mixed({2: repr(chr(34) + ' TEXT ' + chr(34)), 4: repr(chr(34) + 'FALSE' + chr(34))})} as mixed from env",
)
def _(t: Tables):
    return evaluated(t, kind="type | uppercase", mixed="mixed | uppercase")


@query(
    "f_lowercase",
    f"select id, '\"usd\"' as currency, {mixed({2: repr(chr(34) + ' text ' + chr(34))})} as mixed from env",
)
def _(t: Tables):
    return evaluated(t, currency="currency | uppercase | lowercase", mixed="mixed | lowercase")


@query(
    "f_trim",
    f"select id, {json_string('event_type')} as label, {mixed({2: repr(chr(34) + 'Text' + chr(34))})} as mixed from env",
)
def _(t: Tables):
    return evaluated(t, label="label | trim", mixed="mixed | trim")


@query(
    "f_default",
    f"select id, {mixed({6: repr('0'), 7: repr('0')})} as number, {mixed({6: repr(chr(34) + 'none' + chr(34)), 7: repr(chr(34) + 'none' + chr(34))})} as word,"
    f" {mixed({6: repr('true'), 7: repr('true')})} as flag, {mixed({7: repr('null')})} as nothing from env",
)
def _(t: Tables):
    return evaluated(
        t, number="mixed | default(0)", word="mixed | default(none)", flag="mixed | default(true)", nothing="mixed | default(null)"
    )


@query(
    "f_to_string",
    "select id, case event_id % 10 when 0 then '\"12\"' when 1 then '\"2\"' when 2 then '\" Text \"' when 4 then '\"false\"' when 5 then '\"true\"'"
    " when 8 then '\"1,b,\"' when 9 then '\"[object Object]\"' else '\"\"' end as mixed,"
    f" concat('\"', {AMOUNT}, '\"') as amount from env",
)
def _(t: Tables):
    return evaluated(t, mixed="mixed | toString", amount="amount | divide(100) | toString")


# A number of cents times ten to a power from -10 to 25, read as a double. So few digits come back as they are; only their place is at issue.
POWER = "(event_id % 36 - 10)"
_TEXT = f"rtrim(cast({CENTS} as varchar), '0')"
_POINT = f"cast(length(cast({CENTS} as varchar)) + {POWER} as int)"
NUMBER_TEXT = (
    f"case when {CENTS} = 0 then '0' when {_POINT} between length({_TEXT}) and 21 then rpad({_TEXT}, {_POINT}, '0')"
    f" when {_POINT} between 1 and 21 then substr({_TEXT}, 1, {_POINT}) || '.' || substr({_TEXT}, {_POINT} + 1)"
    f" when {_POINT} between -5 and 0 then '0.' || repeat('0', -{_POINT}) || {_TEXT}"
    f" else substr({_TEXT}, 1, 1) || case when length({_TEXT}) > 1 then '.' || substr({_TEXT}, 2) else '' end"
    f" || case when {_POINT} > 0 then 'e+' else 'e-' end || cast(abs({_POINT} - 1) as varchar) end"
)


@query("f_number_text", f"select id, {NUMBER_TEXT} as plain, '[' || {NUMBER_TEXT} || ']' as message from env")
def _(t: Tables):
    number = F.expr(f"cast(concat(cast({CENTS} as string), 'E', cast({POWER} as string)) as double)")
    rows = t.env.withColumn("n", number)
    value = J.text(F.col("n").cast("variant"))
    return rows.select("id", scalars.js_number_text(F.col("n")).alias("plain"), F.concat(F.lit("["), value, F.lit("]")).alias("message"))


@query(
    "f_deep_array_text",
    "select id, user_id || ',' || event_type || ',,[object Object],a,[\"]{,,true' as deep from env",
)
def _(t: Tables):
    """Ten arrays deep, with objects, empty arrays, nulls, and strings that hold marks."""
    body = F.concat(
        F.lit("[[[[[[[[[["), F.col("user_id").cast("string"), F.lit("],[\""), F.col("event_type"),
        F.lit('"]]]]],null,{"a":[1,{"b":[2]}]},["a,[\\"]{"]]],[[]],true]]]'),
    )
    return t.env.select("id", J.text(J.parse(body)).alias("deep"))


@query(
    "f_to_number",
    f"select id, {mixed({2: repr('null'), 3: repr('0'), 4: repr('null')})} as mixed, '12.5' as padded from env",
)
def _(t: Tables):
    return evaluated(t, mixed="mixed | toNumber", padded="' 12.50 ' | toNumber")


@query(
    "f_to_boolean",
    f"select id, case when event_id % 10 in (3, 6, 7) then 'false' else 'true' end as mixed, case when {CENTS} = 0 then 'false' else 'true' end as amount from env",
)
def _(t: Tables):
    return evaluated(t, mixed="mixed | toBoolean", amount="amount | toBoolean")


@query(
    "f_slice",
    "select id, concat('\"', substr(concat('evt_', id), 5), '\"') as tail, concat('\"', right(concat('evt_', id), 3), '\"') as last,"
    " '\"vt\"' as middle, '[{\"name\":\"other\",\"qty\":1}]' as items, '\"\"' as crossed,"
    f" {mixed({2: repr(chr(34) + 'Te' + chr(34)), 4: repr(chr(34) + 'al' + chr(34)), 8: repr('[' + chr(34) + 'b' + chr(34) + ',null]')})} as mixed from env",
)
def _(t: Tables):
    return evaluated(
        t,
        tail="id | slice(4)",
        last="id | slice(-3)",
        middle="id | slice(1,3)",
        items="order.items | slice(1)",
        crossed="id | slice(3,1)",
        mixed="mixed | slice(1,3)",
    )


@query(
    "f_arg_parse",
    "select id, '\"a b\"' as quoted, 'true' as yes, 'null' as nothing, '-1.5' as number, '\"bare\"' as bare, '\"usd\"' as unknown_op,"
    " '\"usd\"' as empty_parens, null::varchar as default_empty_parens, '\"\"' as default_no_parens from env",
)
def _(t: Tables):
    return evaluated(
        t,
        quoted="absent | default('a b')",
        yes="absent | default(true)",
        nothing="absent | default(null)",
        number="absent | default(-1.5)",
        bare="absent | default(bare)",
        unknown_op="currency | reverse",
        empty_parens="currency | slice()",
        default_empty_parens="absent | default()",
        default_no_parens="absent | default",
    )


DURATION = "case event_id % 6 when 0 then '90s' when 1 then '30m' when 2 then '72h' when 3 then '2d' when 4 then '1w' else '' end"


@query(
    "f_parse_window",
    "select id, (case event_id % 6 when 0 then 90 when 1 then 1800 when 2 then 259200 when 3 then 172800 else 259200 end)::bigint as seconds from env",
)
def _(t: Tables):
    return t.env.select("id", scalars.parse_window(F.expr(DURATION)).alias("seconds"))


@query(
    "f_parse_duration",
    "select id, (case event_id % 6 when 0 then 90000 when 1 then 1800000 when 2 then 259200000 when 3 then 172800000 else 300000 end)::bigint as ms from env",
)
def _(t: Tables):
    return t.env.select("id", scalars.parse_duration(F.expr(DURATION)).alias("ms"))


@query("f_js_round", f"select id, {rnd('value', 1)} as tenths, {rnd('value - 100', 0)} as whole from env")
def _(t: Tables):
    return t.env.select(
        "id",
        scalars.js_round(F.col("value"), 1).alias("tenths"),
        scalars.js_round(F.col("value") - 100).alias("whole"),
    )


@query(
    "f_truncate_body",
    "select doc_id, case when length(text) > 1000 then concat(substr(text, 1, 1000), '...') else text end as body from documents",
)
def _(t: Tables):
    return t.read("documents").select("doc_id", scalars.truncate_body(F.col("text")).alias("body"))


@query(
    "f_alert_message",
    "select id, concat('[Alert] ', source, ': ', event_type, ' = ', case when value = floor(value) then cast(cast(value as bigint) as varchar)"
    " else cast(value as varchar) end, ' (threshold: 10)') as message from env",
)
def _(t: Tables):
    message = scalars.alert_message(F.col("source"), F.col("event_type"), F.col("value"), F.lit(10.0))
    return t.env.select("id", message.alias("message"))


CODE = "cast(case event_id % 5 when 0 then 200 when 1 then 204 when 2 then 301 when 3 then 500 end as int)"


@query(
    "f_delivery_ok",
    f"select id, coalesce({CODE} between 200 and 299, false) as ok, case when {CODE} not between 200 and 299 then"
    f" concat('HTTP ', {CODE}, ': ', event_type) end as error from env",
)
def _(t: Tables):
    code = F.expr(CODE)
    return t.env.select(
        "id",
        scalars.delivery_ok(code).alias("ok"),
        scalars.delivery_error(code, F.col("event_type")).alias("error"),
    )


@query("f_latency_ms", "select id, latency_ms from env where processed_at is not null")
def _(t: Tables):
    done = t.env.filter("processed_at is not null")
    return done.select("id", scalars.latency_ms(F.col("created_at"), F.col("processed_at")).alias("latency_ms"))
