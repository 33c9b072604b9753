"""Metrics, look-ups and ordering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hookflow.operators import delivery, lookups, metrics, routing
from hookflow.plans.registry import query
from hookflow.plans.tables import Tables

NOW = "(select max(created_at) from env)"
DENSE_NOW = "(select max(dense_at) from env)"
FAILED = "status in ('FAILED', 'DEAD')"


def rnd(expr: str, digits: int) -> str:
    scale = f"{10**digits}.0::double"
    return f"floor(({expr})::double * {scale} + 0.5) / {scale}"


def entries(t: Tables, frame):
    """Map column to plain rows, so results compare as tables."""
    return frame.select("total", "per_second", F.explode("by_sources").alias("source", "count"))


@query(
    "throughput_overview",
    f"select (select count(*) from env) as total, {rnd(f'(select count(*) from env where dense_at >= {DENSE_NOW} - interval 60 second) / 60.0', 2)}"
    " as per_second, source, count(*) as count from env group by source",
)
def _(t: Tables):
    return entries(t, metrics.throughput_overview(t.dense, t.as_of(t.dense)))


@query(
    "throughput_by_source",
    f"select source, count(*) as total, {rnd('count(*) / 1800.0', 2)} as per_second from env"
    f" where dense_at >= {DENSE_NOW} - interval 30 minute group by source",
)
def _(t: Tables):
    return metrics.throughput_by_source(t.dense, t.as_of(t.dense), 30)


@query("status_counts", "select status, count(*) as count from env group by status")
def _(t: Tables):
    return metrics.status_counts(t.env)


def _latency(source: str) -> str:
    return (
        "select source, n as count, cast(floor(s::double / n + 0.5) as bigint) as avg_ms,"
        " l[cast(floor(n * 0.5::double) as int) + 1] as p50_ms, l[cast(floor(n * 0.95::double) as int) + 1] as p95_ms,"
        " l[cast(floor(n * 0.99::double) as int) + 1] as p99_ms from (select source, count(*) as n, sum(latency_ms) as s,"
        f" list_sort(list(latency_ms)) as l from {source} group by source)"
    )


@query(
    "latency_by_source",
    _latency("(select * from env where status = 'DELIVERED' order by processed_at desc, id limit 1000)"),
)
def _(t: Tables):
    return metrics.latency_by_source(t.env, sample=1000)


@query("latency_by_source_all", _latency("(select * from env where status = 'DELIVERED')"))
def _(t: Tables):
    return metrics.latency_by_source(t.env, sample=None)


DAY = 1440


@query(
    "error_stats",
    f"select total, failed, case when total > 0 then {rnd('failed / total::double * 100', 2)} else 0.0::double end as error_rate"
    f" from (select count(*) as total, count(*) filter (where {FAILED}) as failed from env"
    f" where created_at >= {NOW} - interval {DAY} minute)",
)
def _(t: Tables):
    return metrics.error_stats(t.env, t.as_of(), DAY)


@query(
    "errors_by_source",
    f"select source, count(*) as count from env where created_at >= {NOW} - interval {DAY} minute and {FAILED} group by source",
)
def _(t: Tables):
    return metrics.errors_by_source(t.env, t.as_of(), DAY)


@query(
    "dlq_by_source",
    "select source, count(*) as count, (select count(*) from env where status = 'DEAD') as total from env where status = 'DEAD' group by source",
)
def _(t: Tables):
    return metrics.dlq_by_source(t.env)


@query(
    "dlq_by_error",
    "select coalesce(last_error, 'unknown') as error, count(*) as count from env where status = 'DEAD' group by last_error"
    " order by count(last_error) desc, last_error limit 10",
)
def _(t: Tables):
    return metrics.dlq_by_error(t.env)


@query(
    "queue_depth",
    "select count(*) filter (where status = 'QUEUED') as waiting, count(*) filter (where status = 'PROCESSING') as active,"
    " count(*) filter (where status = 'FAILED') as delayed, count(*) filter (where status = 'DEAD') as failed from env",
)
def _(t: Tables):
    return metrics.queue_depth(t.env)


WEEK_MS = 7 * 86_400_000
IN_WEEK = f"created_at >= {NOW} - interval 7 day"


@query(
    "metric_error_rate",
    f"select count(*) filter (where {FAILED}) / count(*)::double * 100 as value from env where {IN_WEEK}",
)
def _(t: Tables):
    return metrics.metric_error_rate(t.env, t.as_of(), WEEK_MS)


@query("metric_queue_size", "select count(*)::double as value from env where status = 'QUEUED'")
def _(t: Tables):
    return metrics.metric_queue_size(t.env)


@query("metric_dlq_size", "select count(*)::double as value from env where status = 'DEAD'")
def _(t: Tables):
    return metrics.metric_dlq_size(t.env)


@query(
    "metric_latency_p95",
    "select coalesce(l[cast(floor(len(l) * 0.95::double) as int) + 1], 0)::double as value from (select list_sort(list(latency_ms)) as l from"
    f" (select * from env where status = 'DELIVERED' and {IN_WEEK} order by processed_at desc, id limit 500))",
)
def _(t: Tables):
    return metrics.metric_latency_p95(t.env, t.as_of(), WEEK_MS, sample=500)


@query(
    "metric_latency_p95_all",
    "select coalesce(l[cast(floor(len(l) * 0.95::double) as int) + 1], 0)::double as value from (select list_sort(list(latency_ms)) as l from"
    f" (select * from env where status = 'DELIVERED' and {IN_WEEK}))",
)
def _(t: Tables):
    return metrics.metric_latency_p95(t.env, t.as_of(), WEEK_MS)


@query(
    "metric_schema_drift",
    f"select count(*)::double as value from env where {IN_WEEK} and validation_status = 'INVALID'",
)
def _(t: Tables):
    return metrics.metric_schema_drift(t.env, t.as_of(), WEEK_MS)


@query(
    "status_share",
    f"select status, count(*) as count, {rnd('count(*) / (select count(*) from env)::double * 100', 1)} as pct from env group by status",
)
def _(t: Tables):
    return metrics.status_share(t.env)


@query(
    "source_share",
    "select source, n as count, n / (max(n) over ())::double * 100 as pct from (select source, count(*) as n from env group by source)",
)
def _(t: Tables):
    return metrics.source_share(t.env)


NEAREST = "l[greatest(cast(ceil({p}::double * len(l)) as int) - 1, 0) + 1]"


@query(
    "delivery_report",
    "select total, success, total - success as failed, success / total::double * 100 as success_pct, total / duration_s as rps,"
    + ", ".join(
        f" {NEAREST.format(p=p)} as {n}"
        for p, n in ((0, "min_ms"), (0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"), (1, "max_ms"))
    )
    + ", case when success / total::double * 100 >= 99.9 and {p} < 1000 then 'EXCELLENT' when success / total::double * 100 >= 99 and {p} < 2000 then 'GOOD'"
    " when success / total::double * 100 >= 95 and {p} < 5000 then 'FAIR' else 'POOR' end as verdict".format(p=NEAREST.format(p=0.95))
    + " from (select count(*) as total, count(*) filter (where status = 'DELIVERED') as success,"
    " (epoch_ms(max(completed_at)) - epoch_ms(min(created_at))) / 1000.0::double as duration_s, list_sort(list(duration_ms::bigint)) as l"
    " from deliveries where status <> 'PENDING')",
)
def _(t: Tables):
    return delivery.delivery_report(t.deliveries.filter("status <> 'PENDING'"))


@query(
    "delivery_errors",
    "select case when response_code is not null then concat('HTTP_', response_code) else coalesce(last_error, 'UNKNOWN_ERROR') end as error_key,"
    " count(*) as count from deliveries where status = 'FAILED' group by 1",
)
def _(t: Tables):
    return delivery.delivery_errors(t.deliveries)


# --- look-ups ---------------------------------------------------------------------------


@query("events_by_status", "select id, source, created_at from env where status = 'FAILED' order by created_at, id limit 100")
def _(t: Tables):
    return lookups.events_by_status(t.env, "FAILED").select("id", "source", "created_at")


@query(
    "stuck_received",
    f"select id, created_at from env where status = 'RECEIVED' and created_at < {NOW} - interval 60 second order by created_at, id limit 100",
)
def _(t: Tables):
    return lookups.stuck_received(t.env, t.as_of(), n=100).select("id", "created_at")


@query(
    "stuck_queued",
    "select id, queued_at from (select * from env where status = 'QUEUED' order by created_at, id limit 100)"
    f" where coalesce(queued_at, created_at) < {NOW} - interval 5 minute",
)
def _(t: Tables):
    return lookups.stuck_queued(t.env, t.as_of(), n=100, limit_first=True).select("id", "queued_at")


@query(
    "stuck_queued_oldest",
    f"select id, queued_at from env where status = 'QUEUED' and coalesce(queued_at, created_at) < {NOW} - interval 5 minute"
    " order by created_at, id limit 100",
)
def _(t: Tables):
    return lookups.stuck_queued(t.env, t.as_of(), n=100).select("id", "queued_at")


@query("stuck_received_uncapped", f"select id, created_at from env where status = 'RECEIVED' and created_at < {NOW} - interval 60 second")
def _(t: Tables):
    return lookups.stuck_received(t.env, t.as_of()).select("id", "created_at")


@query(
    "stuck_queued_uncapped",
    f"select id, queued_at from env where status = 'QUEUED' and coalesce(queued_at, created_at) < {NOW} - interval 5 minute",
)
def _(t: Tables):
    return lookups.stuck_queued(t.env, t.as_of()).select("id", "queued_at")


@query("events_by_status_all", "select id, source, created_at from env where status = 'FAILED'")
def _(t: Tables):
    return lookups.events_by_status(t.env, "FAILED", None).select("id", "source", "created_at")


@query("deliveries_by_route_all", "select id, event_id, status from deliveries where route_id = 'r2'")
def _(t: Tables):
    return lookups.deliveries_by_route(t.deliveries, "r2", None).select("id", "event_id", "status")


@query("pending_deliveries_all", "select id, event_id, route_id from deliveries where status = 'PENDING'")
def _(t: Tables):
    return lookups.pending_deliveries(t.deliveries, None).select("id", "event_id", "route_id")


@query("dlq_list_all", "select id, source, failed_at from env where status = 'DEAD'")
def _(t: Tables):
    return lookups.dlq_list(t.env, limit=None).select("id", "source", "failed_at")


@query(
    "dlq_by_error_all",
    "select coalesce(last_error, 'unknown') as error, count(*) as count from env where status = 'DEAD' group by last_error",
)
def _(t: Tables):
    return metrics.dlq_by_error(t.env, None)


@query(
    "dlq_list",
    "select id, source, failed_at, (select count(*) from env where status = 'DEAD' and source = 'harbor') as total from env"
    " where status = 'DEAD' and source = 'harbor' order by failed_at desc, id limit 50 offset 20",
)
def _(t: Tables):
    page = lookups.dlq_list(t.env, source="harbor", offset=20)
    return page.select("id", "source", "failed_at", lookups.dlq_total(t.env, source="harbor").scalar().alias("total"))


@query(
    "dlq_event",
    "select id, source, failed_at from env where status = 'DEAD' and id = (select max(id) from env where status = 'DEAD')",
)
def _(t: Tables):
    newest = t.env.filter("status = 'DEAD'").select(F.max("id")).scalar()
    return lookups.dlq_event(t.env, newest).select("id", "source", "failed_at")


@query(
    "recent_errors",
    f"select id, source, event_type, last_error, created_at, failed_at from env where {FAILED} order by created_at desc, id limit 10",
)
def _(t: Tables):
    return lookups.recent_errors(t.env)


@query(
    "deliveries_by_event",
    "select id, route_id, status, created_at from deliveries where event_id = (select min(event_id) from deliveries) order by created_at desc, id",
)
def _(t: Tables):
    first = t.deliveries.select(F.min("event_id")).scalar()
    return lookups.deliveries_by_event(t.deliveries, first).select("id", "route_id", "status", "created_at")


@query(
    "deliveries_by_route",
    "select id, event_id, status from deliveries where route_id = 'r2' order by created_at desc, id limit 100",
)
def _(t: Tables):
    return lookups.deliveries_by_route(t.deliveries, "r2").select("id", "event_id", "status")


@query(
    "pending_deliveries",
    "select id, event_id, route_id from deliveries where status = 'PENDING' order by created_at, id limit 100",
)
def _(t: Tables):
    return lookups.pending_deliveries(t.deliveries).select("id", "event_id", "route_id")


# --- ordering ---------------------------------------------------------------------------


@query(
    "priority_sort",
    "select id, route_id, priority, row_number() over (partition by id order by case priority when 'CRITICAL' then 0 when 'HIGH' then 1"
    " when 'NORMAL' then 2 else 3 end, route_created_at desc, route_id) as position from (select e.id, r.id as route_id, r.priority,"
    " r.created_at as route_created_at from env e join routes r on e.source = r.source and r.active and r.event_type in ('*', e.event_type))",
)
def _(t: Tables):
    fan = routing.route_fanout(t.env.select("id", "source", "event_type"), t.routes)
    order = Window.partitionBy("id").orderBy("priority_rank", F.desc("route_created_at"), "route_id")
    return fan.select("id", "route_id", "priority", F.row_number().over(order).cast("bigint").alias("position"))


@query("top_k_newest", "select id, created_at from env order by created_at desc, id limit 500")
def _(t: Tables):
    return lookups.newest_events(t.env, 500).select("id", "created_at")


@query("page_oldest", "select id, created_at from env order by created_at, id limit 100 offset 200")
def _(t: Tables):
    return lookups.oldest_page(t.env, 100, 200).select("id", "created_at")


@query(
    "newest_per_source",
    "select source, max(created_at) as created_at, arg_max(id, (created_at, id)) as id from env group by source",
)
def _(t: Tables):
    return lookups.newest_per_source(t.env)
