"""Views of the driver's tables in the layout the operators work on.

Expressions that mean the same in Spark SQL and in ANSI engines are written once and
used by both; only interval arithmetic differs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookflow.session import spread

EVENTS_FILE = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

# --- event view -------------------------------------------------------------------------

_STATUS = (
    "case when event_type = 'error' and event_id % 2 = 0 then 'DEAD' when event_type = 'error' then 'FAILED'"
    " when event_type = 'signup' and event_id % 3 = 0 then 'QUEUED'"
    " when event_type = 'signup' and event_id % 3 = 1 then 'PROCESSING'"
    " when event_type = 'signup' then 'RECEIVED' else 'DELIVERED' end"
)
_LATENCY = "cast(floor(value * 10) as bigint)"
BASE = {
    "id": "cast(event_id as string)",
    "external_id": "concat(cast(user_id as string), '-', cast(cast(floor(value) as bigint) as string))",
    "source": "case user_id % 4 when 0 then 'harbor' when 1 then 'orchard' when 2 then 'ferry' else 'museum' end",
    "event_type": "event_type",
    "status": _STATUS,
    "validation_status": (
        "case when value > 200 then 'INVALID' when event_type = 'view' then 'NO_SCHEMA'"
        " when event_type = 'click' then 'SKIPPED' else 'VALID' end"
    ),
    "last_error": (
        "case when event_type <> 'error' or event_id % 10 = 0 then null"
        " when event_id % 4 = 0 then 'HTTP 500: Internal Server Error' else '1 of 2 deliveries failed' end"
    ),
    "attempts": "cast(1 + event_id % 3 as int)",
    "latency_ms": _LATENCY,
    "payload": "props",
    "created_at": "cast(ts as timestamp)",
    "queued_at": f"case when {_STATUS} = 'QUEUED' and event_id % 2 = 0 then cast(ts as timestamp) + interval '30' second end",
    "failed_at": "case when event_type = 'error' then cast(ts as timestamp) + interval '5' second end",
    "value": "value",
    "event_id": "event_id",
    "user_id": "user_id",
}
SPARK_PROCESSED = f"case when {_STATUS} = 'DELIVERED' then timestampadd(MILLISECOND, {_LATENCY}, cast(ts as timestamp)) end"
CHECK_PROCESSED = f"case when {_STATUS} = 'DELIVERED' then cast(ts as timestamp) + to_milliseconds({_LATENCY}) end"
DENSE_CLOCK = "timestamp '2024-01-30 23:00:00' + (event_id % 3600) * interval '1' second"

# --- payloads ---------------------------------------------------------------------------

# A field whose JSON type changes from row to row.
MIXED = (
    "case event_id % 10 when 0 then '\"mixed\":12,' when 1 then '\"mixed\":2.0,' when 2 then '\"mixed\":\" Text \",'"
    " when 3 then '\"mixed\":\"\",' when 4 then '\"mixed\":\"false\",' when 5 then '\"mixed\":true,'"
    " when 6 then '\"mixed\":null,' when 7 then '' when 8 then '\"mixed\":[1,\"b\",null],' else '\"mixed\":{\"a\":1},' end"
)
CENTS = "cast(round(value * 100) as bigint)"
ORDER_PAYLOAD = (
    "concat('{\"id\":\"evt_', cast(event_id as string), '\",\"type\":\"', event_type, '\",\"amount\":',"
    f" cast({CENTS} as string), ',\"price\":', cast(cast(value as decimal(12,2)) as string), ',', {MIXED},"
    " '\"currency\":\"usd\",\"label\":\"  ', event_type, ' \",\"order\":{\"items\":[{\"name\":\"',"
    " event_type, '\",\"qty\":', cast(user_id as string), '},{\"name\":\"other\",\"qty\":1}],\"7\":\"seven\"}}')"
)
CHECKED_TYPE = (
    "case event_type when 'purchase' then 'vessel.moored' when 'error' then 'tank.gauged'"
    " when 'signup' then 'tide.read' when 'click' then 'vessel.moored' end"
)
# What a moored vessel and a gauged tank report; every few reports break their schema.
_SHIP = (
    "concat('\"ship\":{\"flag\":\"', case when event_id % 3 = 0 then 'xx' else 'no' end, '\",\"draught_cm\":',"
    f" case event_id % 4 when 0 then '\"deep\"' when 1 then '-5' else cast({CENTS} + 1 as string) end, '}}')"
)
_LEVELS = (
    "case when event_id % 5 = 0 then '\"level\":0' when event_id % 2 = 0 then '\"levels\":[7]'"
    f" else concat('\"levels\":[', cast({CENTS} as string), ',1.5]') end"
)
CHECKED_PAYLOAD = (
    "concat('{\"ref\":\"', cast(user_id as string), '-', cast(cast(floor(value) as bigint) as string), '\",',"
    f" case when event_type = 'view' then '' else concat('\"type\":\"', {CHECKED_TYPE}, '\",') end,"
    f" case when event_type = 'error' then {_LEVELS} else {_SHIP} end, '}}')"
)

# --- configuration ----------------------------------------------------------------------

VESSEL_SCHEMA = (
    '{"properties":{"ship":{"properties":{"draught_cm":{"exclusiveMinimum":0,"type":"integer"},'
    '"flag":{"enum":["no","pa","mt"]}},"additionalProperties":false,"required":["draught_cm"]}},"required":["ship"]}'
)
TANK_SCHEMA = '{"required":["levels"],"properties":{"levels":{"minItems":2,"items":{"type":"number"}}}}'
VALUES = {
    "sources": (
        "name, dedup_field, dedup_window, rate_limit_max, rate_limit_window, active",
        "('harbor', 'ref', '72h', 100, 60000, true), ('orchard', 'ref', '24h', 5, 60000, true),"
        " ('ferry', cast(null as varchar(10)), '1h', 6, 120000, true),"
        " ('museum', 'ref', '3 weeks', cast(null as int), cast(null as int), false)",
    ),
    "schemas": (
        "source, event_type, version, schema, reject_on_fail, active",
        "('harbor', 'vessel.moored', 1, '{\"type\":\"array\"}', false, false),"
        f" ('harbor', 'vessel.moored', 2, '{VESSEL_SCHEMA}', false, true),"
        f" ('harbor', 'tank.gauged', 1, '{TANK_SCHEMA}', true, true),"
        f" ('orchard', 'tank.gauged', 1, '{TANK_SCHEMA}', false, true)",
    ),
    "routes": (
        "id, source, event_type, target_url, target_name, method, timeout, priority, active, created_at",
        "('r1', 'harbor', 'purchase', 'https://a.example/p', 'crane desk', 'POST', 5000, 'CRITICAL', true, timestamp '2024-01-01 00:00:00'),"
        " ('r2', 'harbor', '*', 'https://b.example/all', 'logbook', 'POST', 5000, 'NORMAL', true, timestamp '2024-01-02 00:00:00'),"
        " ('r3', 'orchard', 'error', 'https://c.example/e', 'watch', 'PUT', 3000, 'LOW', true, timestamp '2024-01-03 00:00:00'),"
        " ('r4', 'orchard', '*', 'https://b.example/all', 'logbook', 'POST', 5000, 'HIGH', true, timestamp '2024-01-04 00:00:00'),"
        " ('r5', 'ferry', 'view', 'https://d.example/v', 'tide board', 'POST', 5000, 'NORMAL', true, timestamp '2024-01-05 00:00:00'),"
        " ('r6', 'ferry', 'click', 'https://d.example/c', 'tide board', 'POST', 5000, 'HIGH', false, timestamp '2024-01-06 00:00:00')",
    ),
    "rules": (
        "id, name, metric, threshold, window, cooldown, active",
        "('a1', 'errors', 'ERROR_RATE', cast(10 as double), '5d', '15m', true),"
        " ('a2', 'queue', 'QUEUE_SIZE', cast(100 as double), '1m', '5m', true),"
        " ('a3', 'dead', 'DLQ_SIZE', cast(5 as double), '10m', '30m', true),"
        " ('a4', 'slow', 'LATENCY_P95', cast(5000 as double), '12h', '10m', true),"
        " ('a5', 'drift', 'SCHEMA_DRIFT', cast(3 as double), '1d', '1h', true),"
        " ('a6', 'off', 'DLQ_SIZE', cast(1 as double), '10m', '30m', false)",
    ),
}
# Mapping of a transform: an exact one for purchases and a wildcard, both of one source.
EXACT_MAPPING = {
    "ticket": "id | slice(4,12) | uppercase",
    "tonnes": "amount | divide(100)",
    "unit": "currency | uppercase | default(KG)",
    "cargo": "order.items.0.name",
    "berth": "berth | default(open sea)",
    "kind": "@event_type",
}
WILD_MAPPING = {"log": "@id", "port": "@source", "note": "label | trim", "missing": "no.such.field"}


def _check_values(name: str, columns: str, rows: str) -> str:
    names = columns.replace("window", '"window"') if name == "rules" else columns
    return f"select * from (values {rows}) as t({names})"


def check_ctes() -> str:
    """Common table expressions that give the checking engine the same views."""
    base = ", ".join(f"{expr} as {name}" for name, expr in BASE.items())
    extra = (
        f"{CHECK_PROCESSED} as processed_at, {ORDER_PAYLOAD} as order_payload,"
        f" {CHECKED_PAYLOAD} as checked_payload, {CHECKED_TYPE} as checked_type, {DENSE_CLOCK} as dense_at"
    )
    parts = [f"env as (select {base}, {extra} from events)"]
    parts += [f"{name} as ({_check_values(name, *spec)})" for name, spec in VALUES.items()]
    parts.append(
        "deliveries as (select concat(e.id, '-', r.id) as id, e.id as event_id, r.id as route_id,"
        f" {DELIVERY_STATUS} as status,"
        f" case {DELIVERY_STATUS} when 'DELIVERED' then 200 when 'FAILED' then case when e.event_id % 2 = 0 then 500 end end as response_code,"
        f" case when {DELIVERY_STATUS} = 'FAILED' then case when e.event_id % 2 = 0 then 'HTTP 500: Internal Server Error' else 'timeout' end end as last_error,"
        " cast(e.latency_ms as int) as duration_ms, e.attempts, e.created_at,"
        f" case when {DELIVERY_STATUS} <> 'PENDING' then e.created_at + to_milliseconds(e.latency_ms) end as completed_at"
        " from env e join routes r on e.source = r.source and r.active and (r.event_type = '*' or r.event_type = e.event_type))"
    )
    parts.append(f"status_log as ({STATUS_LOG.replace('_SECOND_', chr(39) + '1' + chr(39) + ' second')})")
    return ", ".join(parts)


DELIVERY_STATUS = (
    "case when (e.event_id + cast(substr(r.id, 2) as int)) % 13 = 0 then 'PENDING'"
    " when (e.event_id + cast(substr(r.id, 2) as int)) % 5 <> 0 then 'DELIVERED' else 'FAILED' end"
)
# Transitions of every event: received, queued a second later, then its final state.
STATUS_LOG = (
    "select id as event_id, 'RECEIVED' as status, created_at as \"at\", cast(null as int) as attempts,"
    " cast(null as varchar(80)) as last_error from env"
    " union all select id, 'QUEUED', created_at + interval _SECOND_, null, null from env where status <> 'RECEIVED'"
    " union all select id, status, created_at + interval _SECOND_ * 2, attempts, last_error from env"
    " where status not in ('RECEIVED', 'QUEUED')"
)


class Tables:
    """The driver's tables of one scale factor, read lazily with declared schemas."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events_file(self) -> DataFrame:
        """Declared as TIMESTAMP, so time filters reach the parquet scan without a cast in between."""
        return self.spark.read.schema(EVENTS_FILE).parquet(f"{self.sf_dir}/events.parquet")

    def event_stream(self) -> DataFrame:
        reader = self.spark.readStream.schema(EVENTS_FILE).option("maxFilesPerTrigger", 64)
        return as_env(reader.parquet(f"{self.sf_dir}/events.parquet*"))

    @cached_property
    def env(self) -> DataFrame:
        return as_env(self.events_file)

    @cached_property
    def dense(self) -> DataFrame:
        return self.env.withColumn("created_at", F.expr(DENSE_CLOCK))

    @cached_property
    def orders_env(self) -> DataFrame:
        return as_env(spread(self.events_file)).withColumn("payload", F.expr(ORDER_PAYLOAD))

    @cached_property
    def checked_env(self) -> DataFrame:
        env = as_env(spread(self.events_file))
        return env.withColumns({"payload": F.expr(CHECKED_PAYLOAD), "event_type": F.expr(CHECKED_TYPE)})

    def as_of(self, events: DataFrame | None = None):
        """The newest event as a scalar subquery: data-driven, evaluated inside the query."""
        source = self.env if events is None else events
        return source.select(F.max("created_at")).scalar()

    def config(self, name: str) -> DataFrame:
        """Inline rows, so the planner knows their exact size."""
        columns, rows = VALUES[name]
        return self.spark.sql(f"select * from (values {rows}) as t({columns})")

    @cached_property
    def sources(self) -> DataFrame:
        return self.config("sources")

    @cached_property
    def schemas(self) -> DataFrame:
        return self.config("schemas")

    @cached_property
    def routes(self) -> DataFrame:
        headers = F.when(F.col("id") == "r1", F.create_map(F.lit("X-Berth"), F.lit("crane desk")))
        return self.config("routes").withColumn("headers", headers)

    @cached_property
    def rules(self) -> DataFrame:
        return self.config("rules")

    @cached_property
    def transforms(self) -> DataFrame:
        def mapping(fields: dict[str, str]) -> str:
            return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in fields.items()) + ")"

        return self.spark.sql(
            "select * from (values"
            f" ('harbor', 'purchase', {mapping(EXACT_MAPPING)}, true),"
            f" ('harbor', '*', {mapping(WILD_MAPPING)}, true),"
            f" ('orchard', '*', {mapping(WILD_MAPPING)}, false)) as t(source, event_type, mapping, active)"
        )

    @cached_property
    def stored(self) -> DataFrame:
        """Events the store already has: everything but the rows still RECEIVED."""
        return self.env.filter("status <> 'RECEIVED'")

    @cached_property
    def deliveries(self) -> DataFrame:
        e = self.env.alias("e")
        r = self.routes.filter("active").alias("r")
        on = F.expr("e.source = r.source and (r.event_type = '*' or r.event_type = e.event_type)")
        status = F.expr(DELIVERY_STATUS)
        even = F.expr("e.event_id % 2 = 0")
        completed = F.expr("timestampadd(MILLISECOND, e.latency_ms, e.created_at)")
        return e.join(r, on).select(
            F.expr("concat(e.id, '-', r.id)").alias("id"),
            F.col("e.id").alias("event_id"),
            F.col("r.id").alias("route_id"),
            status.alias("status"),
            F.when(status == "DELIVERED", 200).when((status == "FAILED") & even, 500).alias("response_code"),
            F.when(status == "FAILED", F.when(even, "HTTP 500: Internal Server Error").otherwise("timeout")).alias("last_error"),
            F.col("e.latency_ms").cast("int").alias("duration_ms"),
            F.col("e.attempts").alias("attempts"),
            F.col("e.created_at").alias("created_at"),
            F.when(status != "PENDING", completed).alias("completed_at"),
        )

    @cached_property
    def status_log(self) -> DataFrame:
        """Three possible transitions per event, from one read of the events."""
        rows = F.array(
            F.struct(
                F.lit("RECEIVED").alias("status"),
                F.col("created_at").alias("at"),
                F.lit(None).cast("int").alias("attempts"),
                F.lit(None).cast("string").alias("last_error"),
            ),
            F.when(
                F.col("status") != "RECEIVED",
                F.struct(
                    F.lit("QUEUED").alias("status"),
                    (F.col("created_at") + F.expr("interval 1 second")).alias("at"),
                    F.lit(None).cast("int").alias("attempts"),
                    F.lit(None).cast("string").alias("last_error"),
                ),
            ),
            F.when(
                ~F.col("status").isin("RECEIVED", "QUEUED"),
                F.struct(
                    F.col("status").alias("status"),
                    (F.col("created_at") + F.expr("interval 2 seconds")).alias("at"),
                    F.col("attempts").alias("attempts"),
                    F.col("last_error").alias("last_error"),
                ),
            ),
        )
        exploded = self.env.select(F.col("id").alias("event_id"), F.explode(F.array_compact(rows)).alias("t"))
        stamps = [F.lit(None).cast("timestamp").alias(n) for n in ("queued_at", "processed_at", "failed_at")]
        return exploded.select("event_id", "t.*", *stamps)


def as_env(events: DataFrame) -> DataFrame:
    """The event view over the raw event columns."""
    columns = [F.expr(expr).alias(name) for name, expr in BASE.items()]
    return events.select(*columns, F.expr(SPARK_PROCESSED).alias("processed_at"))
