"""Ingest, deduplication, routing, validation, delivery, replay, reconcile and alert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J
from hookflow.operators import (
    alerts,
    config,
    dedup,
    delivery,
    ingest,
    lifecycle,
    reconcile,
    replay,
    routing,
    validation,
)
from hookflow.plans.metric_queries import FAILED, NOW, rnd
from hookflow.plans.registry import query
from hookflow.plans.tables import Tables
from hookflow.sources import csv_batch, external

TTL = "case source when 'harbor' then 259200 when 'orchard' then 86400 when 'museum' then 259200 end"


def greedy(rows: str) -> str:
    """Recursive CTE ``chain``: rows a time-to-live window accepts, from (source, external_id, id, created_at, ttl)."""
    return (
        f"keyed as ({rows}), chain as (select * from (select *, row_number() over (partition by source, external_id"
        " order by created_at, id) as rn from keyed) where rn = 1 union all select * from (select k.*, row_number() over"
        " (partition by k.source, k.external_id order by k.created_at, k.id) as rn from chain c join keyed k on"
        " k.source = c.source and k.external_id = c.external_id and k.created_at >= c.created_at + to_seconds(c.ttl))"
        " where rn = 1)"
    )


ENV_KEYED = f"select source, external_id, id, created_at, {TTL} as ttl from env where source <> 'ferry'"

# --- ingest and sources -----------------------------------------------------------------


def raw_events(t: Tables) -> DataFrame:
    return t.checked_env.select("id", "source", "payload", F.col("created_at").alias("received_at"))


# A tank fails its schema without levels, and with one level alone.
TANK_BAD = "(coalesce(checked_type, '') = 'tank.gauged' and (event_id % 5 = 0 or event_id % 2 = 0))"
VESSEL_BAD = "(checked_type = 'vessel.moored' and (event_id % 4 <= 1 or event_id % 3 = 0))"
CHECK_STATUS = (
    "case when checked_type is null then 'SKIPPED'"
    " when source = 'harbor' and checked_type = 'vessel.moored' then"
    f" case when {VESSEL_BAD} then 'INVALID' else 'VALID' end"
    " when source in ('harbor', 'orchard') and checked_type = 'tank.gauged' then"
    f" case when {TANK_BAD} then 'INVALID' else 'VALID' end else 'NO_SCHEMA' end"
)
REJECTED = f"(source = 'harbor' and {TANK_BAD})"
INGESTED = (
    "select e.id, case when e.source <> 'ferry' then e.external_id end as external_id, e.source, e.checked_type as event_type,"
    f" 'RECEIVED' as status, {CHECK_STATUS} as validation_status, e.created_at from env e left join chain c on e.id = c.id"
    f" where not {REJECTED} and (e.source = 'ferry' or c.id is not null)"
).replace(" id, ", " e.id, ")


def qualified(sql: str) -> str:
    return sql.replace("source = 'harbor'", "e.source = 'harbor'").replace("source in (", "e.source in (")


ENVELOPE = ["id", "external_id", "source", "event_type", "status", "validation_status", "created_at"]


@query("ingest_events", qualified(INGESTED), greedy(f"{ENV_KEYED} and not {REJECTED}"))
def _(t: Tables):
    return ingest.ingest_events(raw_events(t), t.sources, t.schemas).select(*ENVELOPE)


@query("ingest_events_dedup_first", qualified(INGESTED), greedy(ENV_KEYED))
def _(t: Tables):
    return ingest.ingest_events(raw_events(t), t.sources, t.schemas, parity=True).select(*ENVELOPE)


@query(
    "ingest_outcomes",
    qualified(
        f"select e.id, e.source, case when {REJECTED} then 'rejected' when e.source = 'ferry' or c.id is not null then 'accepted'"
        " else 'duplicate' end as outcome from env e left join chain c on e.id = c.id"
        f" union all select e.id, e.source, case when {REJECTED} then 'rejected' else 'duplicate' end from env e"
        " union all select 'b-' || e.id, e.source, 'unreadable' from env e"
        " union all select 'n-' || e.id, '', 'bad_source' from env e"
    ),
    greedy(f"{ENV_KEYED} and not {REJECTED}"),
)
def _(t: Tables):
    """Every delivery comes twice, once cut short and once without a source."""
    raw = raw_events(t)
    broken = raw.withColumns({"id": F.concat(F.lit("b-"), "id"), "payload": F.lit("{")})
    nameless = raw.withColumns({"id": F.concat(F.lit("n-"), "id"), "source": F.lit("")})
    deliveries = raw.unionByName(raw).unionByName(broken).unionByName(nameless)
    return ingest.ingest_outcomes(deliveries, t.sources, t.schemas).select("id", "source", "outcome")


@query(
    "ingest_csv",
    "select cast(event_id as varchar) as id, event_type, cast(user_id as varchar) as user_id, props from events",
)
def _(t: Tables):
    from hookflow.session import scratch_path

    folder = scratch_path(t.spark, "csv")
    columns = ["id", "event_type", "user_id", "props"]
    t.events_file.select(F.col("event_id").alias("id"), "event_type", "user_id", "props").write.csv(
        folder, header=True, escape='"'
    )
    return csv_batch.ingest_csv(t.spark, folder, columns)


CHUNKS = (
    "(select floor((row_number() over (order by l_orderkey, l_linenumber, l_partkey) - 1) / 500) as chunk_index, * from lineitem)"
)


@query(
    "csv_chunks",
    "select cast(chunk_index as bigint) as chunk_index, count(*) as total_rows,"
    " arg_min(concat(l_orderkey, '-', l_linenumber), (l_orderkey, l_linenumber)) as first_row,"
    " arg_max(concat(l_orderkey, '-', l_linenumber), (l_orderkey, l_linenumber)) as last_row,"
    f" cast(sum(l_partkey) as bigint) as part_sum from {CHUNKS} group by chunk_index",
)
def _(t: Tables):
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    chunks = csv_batch.csv_chunks(rows, ["l_orderkey", "l_linenumber", "l_partkey"])

    def label(row):
        return F.concat(row["l_orderkey"], F.lit("-"), row["l_linenumber"])

    parts = F.transform("rows", lambda r: r["l_partkey"].cast("bigint"))
    return chunks.select(
        "chunk_index",
        "total_rows",
        label(F.get("rows", F.lit(0))).alias("first_row"),
        label(F.element_at("rows", -1)).alias("last_row"),
        F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("part_sum"),
    )


@query(
    "csv_batch_stats",
    "select count(*) as total_rows, cast(ceil(count(*) / 500.0) as bigint) as chunks_queued from lineitem",
)
def _(t: Tables):
    return csv_batch.csv_batch_stats(t.read("lineitem"))


STORED_KEYS = "(select distinct source, external_id from env where status <> 'RECEIVED')"


@query(
    "append_events",
    "select id, source, external_id from (select *, row_number() over (partition by source, external_id order by created_at, id) as rn"
    f" from env) b where rn = 1 and not exists (select 1 from {STORED_KEYS} s where s.source = b.source and s.external_id = b.external_id)",
)
def _(t: Tables):
    return dedup.append_events(t.env, t.stored).select("id", "source", "external_id")


SNAPSHOT = "(select *, cast(floor(epoch(created_at)) as bigint) as created from env)"


@query(
    "read_external_events",
    f"select id as external_id, event_type, make_timestamp(created * 1000000) as occurred_at from {SNAPSHOT}"
    f" where created between cast(floor(epoch({NOW} - interval 10 day)) as bigint) and cast(floor(epoch({NOW})) as bigint)",
)
def _(t: Tables):
    snapshot = t.env.select("id", F.col("event_type").alias("type"), F.unix_seconds("created_at").alias("created"), "payload")
    now = t.as_of()
    start = now - F.expr("interval 10 days")
    return external.read_external_events(snapshot, start, now).select("external_id", "event_type", "occurred_at")


@query(
    "append_status",
    "select event_id, status, \"at\", last_error from status_log union all"
    f" select id, 'QUEUED', {NOW}, 'retry' from env where status = 'RECEIVED'",
)
def _(t: Tables):
    stuck = t.env.filter("status = 'RECEIVED'")
    now = t.as_of()
    out = lifecycle.append_status(t.status_log, stuck, "QUEUED", now, batch=True, queued_at=now, last_error="retry")
    return out.select("event_id", "status", "at", "last_error")


@query(
    "append_deliveries",
    "select id, case when status = 'PENDING' then 'DELIVERED' else status end as status,"
    " case when status = 'PENDING' then 200 else response_code end as response_code, case when status = 'PENDING' then"
    f" 1 else attempts end as attempts, case when status = 'PENDING' then {NOW} else completed_at end as completed_at from deliveries",
)
def _(t: Tables):
    outcomes = t.deliveries.filter("status = 'PENDING'").select(
        "id", F.lit("DELIVERED").alias("status"), F.lit(200).alias("response_code"), F.lit(1).alias("attempts")
    )
    out = delivery.append_deliveries(t.deliveries, outcomes, t.as_of())
    return out.select("id", "status", "response_code", "attempts", "completed_at")


# --- type and key extraction ------------------------------------------------------------


@query("detect_event_type", "select id, checked_type as event_type from env")
def _(t: Tables):
    kind = ingest.detect_event_type(J.parse(F.col("payload")))
    return t.checked_env.drop("event_type").select("id", kind.alias("event_type"))


@query(
    "extract_external_id",
    "select id, external_id, nullif(case event_id % 10 when 0 then '12' when 1 then '2' when 2 then ' Text ' when 3 then ''"
    " when 4 then 'false' when 5 then 'true' when 8 then '1,b,' when 9 then '[object Object]' end, '') as mixed_id from env",
)
def _(t: Tables):
    both = t.checked_env.select("id", "payload").join(
        t.orders_env.select("id", F.col("payload").alias("order_payload")), "id"
    )
    return both.select(
        "id",
        ingest.extract_external_id(J.parse(F.col("payload")), "ref").alias("external_id"),
        ingest.extract_external_id(J.parse(F.col("order_payload")), "mixed").alias("mixed_id"),
    )


# --- dedup ------------------------------------------------------------------------------


@query(
    "dedup_ttl",
    "select e.id, e.source, e.external_id from env e left join chain c on e.id = c.id where e.source = 'ferry' or c.id is not null",
    greedy(ENV_KEYED),
)
def _(t: Tables):
    return dedup.dedup_ttl(t.env, t.sources).select("id", "source", "external_id")


@query(
    "dedup_repeated_rows",
    "select e.id, e.source, e.external_id from env e left join chain c on e.id = c.id where e.source = 'ferry' or c.id is not null",
    greedy(ENV_KEYED),
)
def _(t: Tables):
    """Every event delivered twice: one row of each id is left."""
    return dedup.dedup_ttl(t.env.unionByName(t.env), t.sources).select("id", "source", "external_id")


@query(
    "dedup_ttl_hot_key",
    "select id, source from chain",
    greedy("select source, source as external_id, id, created_at, 86400 as ttl from env"),
)
def _(t: Tables):
    """One key per source: every key is far over the folding limit."""
    sources = t.sources.withColumns({"dedup_field": F.lit("source"), "dedup_window": F.lit("1d")})
    one_key = t.env.withColumn("external_id", F.col("source"))
    return dedup.dedup_ttl(one_key, sources, fold_limit=500).select("id", "source")


@query(
    "dedup_forever",
    "select id, source, external_id from (select *, row_number() over (partition by source, external_id order by created_at, id) as rn from env) where rn = 1",
)
def _(t: Tables):
    return dedup.append_events(t.env, t.env.limit(0)).select("id", "source", "external_id")


@query(
    "dedup_hot_cold",
    "select e.id, case when e.source = 'ferry' then 'accepted' when c.id is null then 'duplicate_hot'"
    " when f.id is null or s.external_id is not null then 'duplicate_cold' else 'accepted' end as outcome"
    " from env e left join chain c on e.id = c.id left join (select id from (select *, row_number() over"
    " (partition by source, external_id order by created_at, id) as rn from keyed) where rn = 1) f on e.id = f.id"
    f" left join {STORED_KEYS} s on e.source = s.source and e.external_id = s.external_id",
    greedy(ENV_KEYED),
)
def _(t: Tables):
    return dedup.dedup_hot_cold(t.env, t.stored, t.sources).select("id", "outcome")


# --- routing ----------------------------------------------------------------------------

ON_ROUTE = "e.source = r.source and r.active and (r.event_type = '*' or r.event_type = e.event_type)"


@query(
    "route_fanout",
    f"select e.id, r.id as route_id, r.target_url, r.priority from env e join routes r on {ON_ROUTE}",
)
def _(t: Tables):
    return routing.route_fanout(t.env, t.routes).select("id", "route_id", "target_url", "priority")


@query(
    "unrouted_events",
    f"select id, source, 'DELIVERED' as status from env e where not exists (select 1 from routes r where {ON_ROUTE})",
)
def _(t: Tables):
    return routing.unrouted_events(t.env, t.routes).select("id", "source", "status")


@query(
    "resolve_transform",
    "select id, case when source = 'harbor' then case when event_type = 'purchase' then event_type else '*' end end as transform_type from env",
)
def _(t: Tables):
    return routing.resolve_transform(t.env, t.transforms).select("id", "transform_type")


@query(
    "resolve_schema",
    "select e.id, s.version as schema_version, s.reject_on_fail from env e left join (select source, event_type,"
    " max(version) as version, arg_max(reject_on_fail, version) as reject_on_fail from schemas where active group by 1, 2) s"
    " on e.source = s.source and e.checked_type = s.event_type",
)
def _(t: Tables):
    return validation.resolve_schema(t.checked_env, t.schemas).select("id", "schema_version", "reject_on_fail")


@query(
    "reconcile_missing",
    f"select id, source, external_id from env e where not exists (select 1 from {STORED_KEYS} s where s.source = e.source and s.external_id = e.external_id)",
)
def _(t: Tables):
    return reconcile.reconcile_missing(t.env, t.stored).select("id", "source", "external_id")


@query(
    "reconcile_matched",
    f"select id, source, external_id from env e where exists (select 1 from {STORED_KEYS} s where s.source = e.source and s.external_id = e.external_id)",
)
def _(t: Tables):
    return reconcile.reconcile_matched(t.env, t.stored).select("id", "source", "external_id")


@query(
    "reconcile_inject",
    "select source, external_id, event_type, occurred_at, created_at, validation_status, 'true' as reconciled from (select source, external_id,"
    f" event_type, created_at as occurred_at, {NOW} as created_at, 'SKIPPED' as validation_status, row_number() over (partition by source,"
    f" external_id order by created_at, id) as rn from env e where not exists (select 1 from {STORED_KEYS} s where s.source = e.source"
    " and s.external_id = e.external_id)) where rn = 1",
)
def _(t: Tables):
    missing = reconcile.reconcile_missing(t.env.withColumn("occurred_at", F.col("created_at")), t.stored)
    injected = reconcile.reconcile_inject(missing, t.as_of())
    reconciled = F.element_at("headers", "x-reconciled").alias("reconciled")
    return injected.select("source", "external_id", "event_type", "occurred_at", "created_at", "validation_status", reconciled)


@query(
    "reconcile_summary",
    "select e.source, count(*) as external_count, count(s.external_id) as matched_count, count(*) - count(s.external_id) as missing_count,"
    f" count(*) - count(s.external_id) as injected_count from env e left join {STORED_KEYS} s on e.source = s.source"
    " and e.external_id = s.external_id group by e.source",
)
def _(t: Tables):
    return reconcile.reconcile_summary(t.env, t.stored)


@query(
    "source_config",
    f"select e.id, s.dedup_field, case when s.dedup_field is not null then {TTL.replace('source', 'e.source')} end::bigint as dedup_seconds,"
    " s.rate_limit_max from env e left join sources s on e.source = s.name",
)
def _(t: Tables):
    return ingest.source_config(t.env, t.sources).select("id", "dedup_field", "dedup_seconds", "rate_limit_max")


@query(
    "event_deliveries",
    "select e.id, d.id as delivery_id, d.status as delivery_status, r.target_name from env e join deliveries d on d.event_id = e.id"
    " join routes r on r.id = d.route_id",
)
def _(t: Tables):
    joined = routing.event_deliveries(t.env, t.deliveries, t.routes)
    return joined.select("id", "delivery_id", "delivery_status", "target_name")


@query(
    "cascade_delete",
    "select id, event_id from deliveries where event_id not in (select id from env where status = 'DEAD')",
)
def _(t: Tables):
    return routing.cascade_delete(t.deliveries, t.env.filter("status = 'DEAD'"), "event_id").select("id", "event_id")


# Alerts that fired before: one per dead-letter event of the last days, spread over the rules.
HISTORY_RULE = "concat('a', cast(1 + event_id % 3 as string))"
HISTORY = (
    f"history as (select id, {HISTORY_RULE} as alert_rule_id, value as metric_value, concat('alert ', id) as message,"
    " created_at as fired_at from env where status = 'DEAD')"
)


def history(t: Tables) -> DataFrame:
    return t.env.filter("status = 'DEAD'").select(
        "id",
        F.expr(HISTORY_RULE).alias("alert_rule_id"),
        F.col("value").alias("metric_value"),
        F.concat(F.lit("alert "), "id").alias("message"),
        F.col("created_at").alias("fired_at"),
    )


@query(
    "last_fired",
    "select r.id, r.name, h.fired_at as last_fired_at, h.message as last_message from rules r left join (select alert_rule_id,"
    " max(fired_at) as fired_at, arg_max(message, (fired_at, id)) as message from history group by 1) h on h.alert_rule_id = r.id",
    HISTORY,
)
def _(t: Tables):
    return alerts.last_fired(t.rules, history(t)).select("id", "name", "last_fired_at", "last_message")


@query("rule_history", "select id, metric_value, fired_at from history where alert_rule_id = 'a2' order by fired_at desc, id", HISTORY)
def _(t: Tables):
    return alerts.rule_history(history(t), "a2").select("id", "metric_value", "fired_at")


@query(
    "reconcile_sources",
    "select source, count(*) as external_count, count(*) filter (where known) as matched_count, count(*) filter (where not known) as missing_count,"
    " count(*) filter (where not known) as injected_count, null as failure from (select e.*, bool_or(status <> 'RECEIVED') over (partition by source,"
    f" external_id) as known from env e) where created_at > {NOW} - interval 10 day and source <> 'museum' group by source"
    " union all select 'museum', null, null, null, null, 'unreachable'",
)
def _(t: Tables):
    """Each source against its own record of ten days; one of them cannot be read."""
    from hookflow.streaming import jobs

    as_of = t.env.agg(F.max("created_at")).first()[0]

    def reader(name: str):
        def read(start, end) -> DataFrame:
            if name == "museum":
                raise ConnectionError("unreachable")
            rows = t.env.filter((F.col("source") == name) & (F.col("created_at") > start) & (F.col("created_at") <= end))
            return rows.select("external_id", "event_type", "payload", F.col("created_at").alias("occurred_at"))

        return read

    names = ("harbor", "orchard", "ferry", "museum")
    done, failed = jobs.reconcile_sources({name: reader(name) for name in names}, lambda: t.stored, lambda rows: None, as_of, 10 * 1440)
    columns = ["source", "external_count", "matched_count", "missing_count", "injected_count"]
    out = t.spark.createDataFrame(list(failed.items()), "source string, failure string")
    for summary in done:
        out = out.unionByName(summary.select(columns), allowMissingColumns=True)
    return out.select(*columns, "failure")


# --- delivery ---------------------------------------------------------------------------

OUTCOMES = (
    "outcomes as (select event_id, attempts as attempt, case when count(*) filter (where status = 'FAILED') = 0 then 'DELIVERED' else 'FAILED' end as status,"
    " case when count(*) filter (where status = 'FAILED') > 0 then concat(count(*) filter (where status = 'FAILED'), ' of ', count(*),"
    " ' deliveries failed') end as error, max(completed_at) as \"at\" from deliveries group by 1, 2"
    " having count(*) filter (where status = 'PENDING') = 0)"
)


@query("delivery_outcome", "select event_id, attempt, status, error from outcomes", OUTCOMES)
def _(t: Tables):
    return delivery.delivery_outcome(t.deliveries).select("event_id", "attempt", "status", "error")


@query(
    "final_status",
    "select event_id, case when status = 'DELIVERED' then status when attempt >= 3 then 'DEAD' else 'FAILED' end as status,"
    " attempt as attempts, error as last_error, case when status <> 'DELIVERED' then \"at\" end as failed_at from outcomes",
    OUTCOMES,
)
def _(t: Tables):
    out = delivery.final_status(delivery.delivery_outcome(t.deliveries))
    return out.select("event_id", "status", "attempts", "last_error", "failed_at")


@query(
    "plan_deliveries",
    "select e.id as event_id, r.id as route_id, r.method, r.target_url as url, r.timeout, 'application/json' as content_type,"
    " case when r.id = 'r1' then 'crane desk' end as team from env e join routes r on " + ON_ROUTE,
)
def _(t: Tables):
    plan = routing.plan_deliveries(t.orders_env, t.routes, t.transforms, t.as_of())
    return plan.select(
        "event_id",
        "route_id",
        "method",
        "url",
        "timeout",
        F.element_at("headers", "Content-Type").alias("content_type"),
        F.try_element_at("headers", F.lit("X-Berth")).alias("team"),
    )


@query(
    "create_deliveries",
    "select sha256(concat(e.id, chr(31), r.id)) as id, e.id as event_id, r.id as route_id, 'PENDING' as status, 0 as attempts,"
    f" {NOW} as created_at from env e join routes r on " + ON_ROUTE,
)
def _(t: Tables):
    now = t.as_of()
    created = delivery.create_deliveries(routing.plan_deliveries(t.env, t.routes, t.transforms, now), now)
    return created.select("id", "event_id", "route_id", "status", "attempts", "created_at")


# --- validation -------------------------------------------------------------------------


@query("validate_events", f"select id, {CHECK_STATUS} as validation_status from env")
def _(t: Tables):
    return validation.validate_events(t.checked_env, t.schemas).select("id", "validation_status")


VESSEL = "source = 'harbor' and checked_type = 'vessel.moored'"
TANK = "source in ('harbor', 'orchard') and checked_type = 'tank.gauged'"
# The texts of violations are fixed values.
ERRORS = (
    f"verrors as (select id, source, checked_type, created_at, '/ship/draught_cm' as path, 'must be integer' as message, 'type' as keyword,"
    f" '{{\"type\":\"integer\"}}' as params from env where {VESSEL} and event_id % 4 = 0"
    " union all select id, source, checked_type, created_at, '/ship/draught_cm', 'must be > 0', 'exclusiveMinimum',"
    f" '{{\"comparison\":\">\",\"limit\":0}}' from env where {VESSEL} and event_id % 4 = 1"
    " union all select id, source, checked_type, created_at, '/ship/flag', 'must be equal to one of the allowed values', 'enum',"
    f" '{{\"allowedValues\":[\"no\",\"pa\",\"mt\"]}}' from env where {VESSEL} and event_id % 3 = 0"
    " union all select id, source, checked_type, created_at, '/', 'must have required property ''levels''', 'required',"
    f" '{{\"missingProperty\":\"levels\"}}' from env where {TANK} and event_id % 5 = 0"
    " union all select id, source, checked_type, created_at, '/levels', 'must NOT have fewer than 2 items', 'minItems',"
    f" '{{\"limit\":2}}' from env where {TANK} and event_id % 5 <> 0 and event_id % 2 = 0)"
)


@query("validation_errors", "select id, path, message, keyword, params from verrors", ERRORS)
def _(t: Tables):
    return validation.validation_errors(t.checked_env, t.schemas)


@query(
    "schema_predicates",
    "select id, event_id % 4 <= 1 or event_id % 3 = 0 as broken from env where checked_type = 'vessel.moored'",
)
def _(t: Tables):
    import json

    from hookflow.functions.schema_rules import compile_schema
    from hookflow.plans.tables import VESSEL_SCHEMA

    rules = compile_schema(json.loads(VESSEL_SCHEMA), F.col("_body"))
    broken = F.lit(False)
    for rule in rules:
        broken = broken | rule.isNotNull()
    rows = t.checked_env.filter("event_type = 'vessel.moored'")
    return rows.withColumn("_body", J.parse(F.col("payload"))).select("id", broken.alias("broken"))


@query(
    "schema_predicates_items",
    "select id, '/readings/' || i || case when k = 0 then '/unit' else '/value' end as path, case when k = 0 then 'enum' else 'anyOf' end as keyword"
    " from (select id, event_id, unnest(range(3)) as i from env) cross join (values (0), (1)) v(k)"
    " where (k = 0 and (event_id + i) % 4 = 0) or (k = 1 and (event_id + i) % 3 = 0)",
)
def _(t: Tables):
    """Rules for the elements of an array: three readings of each event, of which some have a wrong unit or value."""
    from hookflow.functions.schema_rules import schema_errors

    reading = (
        "concat('{\"unit\":\"', case when (event_id + _i_) % 4 = 0 then 'ell' else 'cm' end, '\",\"value\":',"
        " case when (event_id + _i_) % 3 = 0 then 'true' when (event_id + _i_) % 3 = 1 then '7' else '\"low\"' end, '}')"
    )
    body = F.concat(F.lit('{"readings":['), F.concat_ws(",", *(F.expr(reading.replace("_i_", str(i))) for i in range(3))), F.lit("]}"))
    value = {"anyOf": [{"type": "number"}, {"enum": ["low", "high"]}]}
    schema = {"properties": {"readings": {"items": {"properties": {"unit": {"enum": ["cm", "m"]}, "value": value}}}}}
    rows = t.env.select("id", F.explode(schema_errors(schema, J.parse(body))).alias("e")).select("id", "e.path", "e.keyword")
    return rows.filter("not (path like '%/value' and keyword <> 'anyOf')")


@query(
    "reject_split",
    f"select id, case when {REJECTED} then 'rejected' else 'accepted' end as side from env",
)
def _(t: Tables):
    accepted, rejected = validation.reject_split(validation.validate_events(t.checked_env, t.schemas))
    sides = accepted.select("id", F.lit("accepted").alias("side"))
    return sides.unionByName(rejected.select("id", F.lit("rejected").alias("side")))


@query(
    "drift_report",
    f"select source, checked_type as event_type, keyword, path, count(*) as errors from verrors where created_at >= {NOW} - interval 10 day"
    " group by 1, 2, 3, 4",
    ERRORS,
)
def _(t: Tables):
    validated = validation.validate_events(t.checked_env, t.schemas)
    return validation.drift_report(validated, t.as_of(), minutes=10 * 1440)


# --- lifecycle and configuration --------------------------------------------------------


@query(
    "current_state",
    "select id, status, case when status not in ('RECEIVED', 'QUEUED') then attempts end as attempts,"
    " case when status not in ('RECEIVED', 'QUEUED') then last_error end as last_error from env",
)
def _(t: Tables):
    blank = t.env.select("id", F.lit("RECEIVED").alias("status"))
    return lifecycle.current_state(blank, t.status_log).select("id", "status", "attempts", "last_error")


@query(
    "dlq_discard",
    f"select id as event_id, 'DISCARDED' as status, {NOW} as \"at\" from env where status = 'DEAD' and value > 20",
)
def _(t: Tables):
    ids = t.env.filter("value > 20").select("id")
    return lifecycle.dlq_discard(t.env, ids, t.as_of()).select("event_id", "status", "at")


@query(
    "dlq_discard_unchecked",
    f"select id as event_id, 'DISCARDED' as status, {NOW} as \"at\" from env where value > 20",
)
def _(t: Tables):
    ids = t.env.filter("value > 20").select("id")
    return lifecycle.dlq_discard(t.env, ids, t.as_of(), strict=False).select("event_id", "status", "at")


# Every (source, type) seen gets its first schema, or the next version of a registered one.
@query(
    "publish_schema",
    "select source, event_type, version, reject_on_fail, active from (select s.source, s.event_type, s.version, s.reject_on_fail,"
    " s.active and n.source is null as active from schemas s left join seen n on n.source = s.source and n.event_type = s.event_type"
    " union all select n.source, n.event_type, coalesce(max(s.version), 0) + 1, false, true from seen n left join schemas s"
    " on n.source = s.source and n.event_type = s.event_type group by n.source, n.event_type)",
    "seen as (select distinct source, checked_type as event_type from env where checked_type is not null)",
)
def _(t: Tables):
    seen = t.checked_env.filter("event_type is not null").select("source", "event_type").distinct()
    new = seen.withColumn("schema", F.lit('{"type":"object"}'))
    return config.publish_schema(t.schemas, new).drop("schema")


@query(
    "upsert_by_key",
    "select coalesce(u.id, b.id) as id, coalesce(u.mark, b.mark) as mark from (select id, 'stored' as mark from env"
    " where status <> 'RECEIVED') b full join (select id, 'updated' as mark from env where value > 100) u on u.id = b.id",
)
def _(t: Tables):
    base = t.stored.select("id", F.lit("stored").alias("mark"))
    updates = t.env.filter("value > 100").select("id", F.lit("updated").alias("mark"))
    return config.upsert_by_key(base, updates, ["id"])


@query(
    "upsert_sources",
    "select s.name, case when n.source is null then s.dedup_field end as dedup_field, n.n::int as rate_limit_max, s.active from sources s"
    " left join (select source, count(*) as n from env where source <> 'museum' group by source) n on n.source = s.name"
    " where n.source is not null union all select name, dedup_field, rate_limit_max, active from sources where name = 'museum'",
)
def _(t: Tables):
    """New limits from observed volume; settings the update leaves out become null."""
    volume = t.env.filter("source <> 'museum'").groupBy(F.col("source").alias("name"))
    updates = volume.agg(F.count(F.lit(1)).cast("int").alias("rate_limit_max"))
    merged = config.upsert_sources(t.sources, updates)
    return merged.select("name", "dedup_field", "rate_limit_max", "active")


@query(
    "upsert_transforms",
    "select distinct source, event_type, '@event_type' as kind, true as active from env union all"
    " select 'harbor', '*', null, true union all select 'orchard', '*', null, false",
)
def _(t: Tables):
    """A mapping for every (source, type) seen: the exact one is replaced, the wildcards stay."""
    seen = t.env.select("source", "event_type").distinct()
    updates = seen.withColumn("mapping", F.create_map(F.lit("kind"), F.lit("@event_type")))
    merged = config.upsert_transforms(t.transforms, updates)
    kind = F.try_element_at("mapping", F.lit("kind")).alias("kind")
    return merged.select("source", "event_type", kind, "active")


# --- replay -----------------------------------------------------------------------------

FROM = "timestamp '2024-01-10 00:00:00'"
REPLAY = f"source = 'harbor' and status = 'FAILED' and created_at >= {FROM} and created_at <= {NOW}"


def replay_filters(t: Tables, **more) -> dict:
    return {"source": "harbor", "from": "2024-01-10 00:00:00", "to": t.as_of(), **more}


@query("replay_select", f"select id, created_at from env where {REPLAY} order by created_at, id")
def _(t: Tables):
    return replay.replay_select(t.env, replay_filters(t, status="FAILED")).select("id", "created_at")


@query("replay_preview", f"select count(*) as total_events from env where {REPLAY}")
def _(t: Tables):
    return replay.replay_preview(t.env, replay_filters(t, status="FAILED"))


IN_RANGE = f"source = 'harbor' and created_at >= {FROM} and created_at <= {NOW}"


@query(
    "replay_plan",
    f"select id, source, event_type from env where {IN_RANGE} and status not in ('QUEUED', 'PROCESSING')",
)
def _(t: Tables):
    return replay.replay_plan(t.env, replay_filters(t)).select("id", "source", "event_type")


@query(
    "replay_plan_untyped",
    f"select id, source, null::varchar as event_type from env where {IN_RANGE} and status not in ('QUEUED', 'PROCESSING')",
)
def _(t: Tables):
    return replay.replay_plan(t.env, replay_filters(t), keep_event_type=False).select("id", "source", "event_type")


@query(
    "replay_progress",
    f"select source, count(*) as total_events, count(*) filter (where {FAILED}) as replayed_events,"
    f" cast({rnd(f'count(*) filter (where {FAILED}) / count(*)::double * 100', 0)} as int) as progress from env group by source",
)
def _(t: Tables):
    done = F.count_if(F.col("status").isin("FAILED", "DEAD")).alias("replayed_events")
    requests = t.env.groupBy("source").agg(F.count(F.lit(1)).alias("total_events"), done)
    return replay.replay_progress(requests)


@query(
    "replay_execute",
    f"select count(*) as total_events, count(*) filter (where status not in ('QUEUED', 'PROCESSING')) as replayed_events, 'COMPLETED' as status,"
    f" {NOW} as completed_at from env where {IN_RANGE}",
)
def _(t: Tables):
    _, _, counters = replay.replay_execute(t.env, replay_filters(t), t.as_of())
    return counters


@query(
    "replay_requeued",
    f"select id as event_id, 'QUEUED' as status, {NOW} as queued_at from env where {IN_RANGE} and status not in ('QUEUED', 'PROCESSING')",
)
def _(t: Tables):
    _, queued, _ = replay.replay_execute(t.env, replay_filters(t), t.as_of())
    return queued.select("event_id", "status", "queued_at")


@query(
    "replay_resumed",
    f"select id, source, event_type, 'COMPLETED' as status, count(*) over () as replayed_events from env where {IN_RANGE} and status not in ('QUEUED', 'PROCESSING')",
)
def _(t: Tables):
    """A replay that is cancelled after two chunks, fails in a later one, and goes on to the end."""
    from hookflow.operators.replay_run import ReplayRunner
    from hookflow.session import scratch_path

    events = t.env.select("id", "source", "event_type", "status", "created_at")
    as_of = events.agg(F.max("created_at")).first()[0]
    filters = replay_filters(t) | {"to": as_of}
    runner = ReplayRunner(t.spark, scratch_path(t.spark, "replay"), max(1, events.count() // 40))
    request = runner.submit(events, filters, as_of, "me")
    asked = iter([False, False, True])
    runner.run(events, filters, request, as_of, cancelled=lambda: next(asked))

    def lost(chunk: DataFrame) -> None:
        raise ConnectionError("the receiver is gone")

    try:
        runner.run(events, filters, request, as_of, each=lost)
    except ConnectionError:
        runner.run(events, filters, request, as_of)
    done = runner.requests().select("status", "replayed_events")
    emitted = runner.emitted(request, "id string, source string, event_type string")
    return emitted.withColumns(
        {"status": done.select("status").scalar(), "replayed_events": done.select("replayed_events").scalar()}
    )


@query(
    "replay_request",
    f"select 'harbor' as filter_source, 'FAILED' as filter_status, {FROM} as filter_from, count(*) as total_events,"
    f" 0::bigint as replayed_events, 'PENDING' as status from env where {REPLAY}",
)
def _(t: Tables):
    request = replay.replay_request(t.env, replay_filters(t, status="FAILED"), check=False)
    return request.select("filter_source", "filter_status", "filter_from", "total_events", "replayed_events", "status")


# --- alerts -----------------------------------------------------------------------------


def js_text(expr: str) -> str:
    return f"case when ({expr}) = floor({expr}) then cast(cast(({expr}) as bigint) as varchar) else cast(({expr}) as varchar) end"


ALERTS = HISTORY + (
    ", latest as (select alert_rule_id, max(fired_at) as fired_at from history group by 1), vals as (select id, name, metric, threshold,"
    f" case metric when 'ERROR_RATE' then (select count(*) filter (where {FAILED}) / count(*)::double * 100 from env where created_at >= {NOW} - interval 5 day)"
    " when 'QUEUE_SIZE' then (select count(*)::double from env where status = 'QUEUED')"
    " when 'DLQ_SIZE' then (select count(*)::double from env where status = 'DEAD')"
    " when 'LATENCY_P95' then (select coalesce(l[cast(floor(len(l) * 0.95::double) as int) + 1], 0)::double from (select list_sort(list(latency_ms)) as l"
    f" from (select * from env where status = 'DELIVERED' and created_at >= {NOW} - interval 12 hour order by processed_at desc, id limit 500)))"
    f" when 'SCHEMA_DRIFT' then (select count(*)::double from env where created_at >= {NOW} - interval 1 day and validation_status = 'INVALID') end as value,"
    " case cooldown when '15m' then 900 when '5m' then 300 when '30m' then 1800 when '10m' then 600 else 3600 end as cool,"
    f" (epoch_us({NOW}) - epoch_us(fired_at)) / 1e6 as elapsed from rules r left join latest l on l.alert_rule_id = r.id where active),"
    " judged as (select *, value > threshold as above, coalesce(elapsed < cool, false) as cooling,"
    f" concat('[Alert] ', name, ': ', metric, ' = ', {js_text('value')}, ' (threshold: ', {js_text('threshold')}, ')') as message from vals)"
)


@query(
    "evaluate_alerts",
    "select id, metric, value, above, above and cooling as suppressed, above and not cooling as fired, message from judged",
    ALERTS,
)
def _(t: Tables):
    out = alerts.evaluate_alerts(t.env, t.rules, history(t), t.as_of(), latency_sample=500)
    return out.select("id", "metric", "value", "above", "suppressed", "fired", "message")


@query(
    "append_alert_history",
    "select alert_rule_id, metric_value, message, fired_at from history union all"
    f" select id, value, message, {NOW} from judged where above and not cooling",
    ALERTS,
)
def _(t: Tables):
    evaluated = alerts.evaluate_alerts(t.env, t.rules, history(t), t.as_of(), latency_sample=500)
    out = alerts.append_alert_history(history(t), evaluated)
    return out.select("alert_rule_id", "metric_value", "message", "fired_at")


@query(
    "rate_limit_breaches",
    "select source, bucket * width as window_start_ms, count(*) as total, lim as rate_limit_max from (select e.source,"
    " s.rate_limit_window::bigint as width, s.rate_limit_max as lim, epoch_ms(e.dense_at) // s.rate_limit_window as bucket from env e"
    " join sources s on s.name = e.source where s.rate_limit_max is not null) group by source, bucket, width, lim having count(*) > lim",
)
def _(t: Tables):
    return ingest.rate_limit_breaches(t.dense, t.sources)


