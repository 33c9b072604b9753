"""Streaming jobs run to the end of the given tables; their results are compared with the batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookflow.plans import flow_queries as flow
from hookflow.plans.metric_queries import FAILED, NOW, rnd
from hookflow.plans.registry import query
from hookflow.plans.tables import CHECKED_PAYLOAD, ORDER_PAYLOAD, Tables
from hookflow.session import scratch_path
from hookflow.streaming import jobs


def drained(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all available input into a table in the shared folder and read it back."""
    folder = scratch_path(t.spark, label)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", folder + "-log")
    writer.trigger(availableNow=True).start(folder).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(folder)


def latest_totals(t: Tables, totals: DataFrame, label: str) -> DataFrame:
    """Run an aggregation to the end; every trigger replaces the table with the totals so far."""
    folder = scratch_path(t.spark, label)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    writer = totals.writeStream.foreachBatch(replace).outputMode("complete")
    writer.option("checkpointLocation", folder + "-log").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(totals.schema).parquet(folder)


# The stored table keeps the first row of a key for ever, so repeats past their window stay out as well.
@query(
    "stream_ingest",
    flow.qualified(flow.INGESTED).replace(
        "left join chain c",
        "left join (select arg_min(id, (created_at, id)) as id from keyed group by source, external_id) c",
    ),
    flow.greedy(f"{flow.ENV_KEYED} and not {flow.REJECTED}"),
)
def _(t: Tables):
    folder = scratch_path(t.spark, "ingested")
    raw = t.event_stream().select(
        "id", "source", F.expr(CHECKED_PAYLOAD).alias("payload"), F.col("created_at").alias("received_at")
    )
    jobs.stream_ingest(raw, folder, folder + "-log", t.sources, t.schemas).awaitTermination()
    return t.spark.read.parquet(folder).select(*flow.ENVELOPE)


@query(
    "stream_dedup",
    "select e.id, e.source from env e left join chain c on e.id = c.id where e.source = 'ferry' or c.id is not null",
    flow.greedy(flow.ENV_KEYED),
)
def _(t: Tables):
    stream = t.event_stream().select("id", "source", "external_id", "created_at")
    return drained(t, jobs.stream_dedup(stream, t.sources), "deduped").select("id", "source")


@query(
    "stream_dedup_files",
    "select e.id, e.source from env e left join chain c on e.id = c.id where e.source = 'ferry' or c.id is not null",
    flow.greedy(flow.ENV_KEYED),
)
def _(t: Tables):
    """The events in four files by time, a micro-batch each: windows stay open from one batch to the next."""
    folder = scratch_path(t.spark, "slices")
    rows = t.env.select("id", "source", "external_id", "created_at")
    first, last = rows.select(F.min("created_at"), F.max("created_at")).first()
    step = (last - first) / 4
    for i in range(4):
        after = F.lit(True) if i == 0 else F.col("created_at") > first + step * i
        until = F.lit(True) if i == 3 else F.col("created_at") <= first + step * (i + 1)
        rows.filter(after & until).coalesce(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return drained(t, jobs.stream_dedup(stream, t.sources), "deduped").select("id", "source")


ROLLING = (
    "select window_start, window_start + interval 1 day as window_end, source, count(*) as total, count(*) filter (where failed) as failed,"
    f" {rnd('count(*) / 86400.0', 2)} as per_second, {rnd('count(*) filter (where failed) / count(*)::double * 100', 2)} as error_rate from"
    f" (select e.source, {FAILED} as failed, unnest([time_bucket(interval 12 hour, e.created_at, timestamp '1970-01-01'),"
    " time_bucket(interval 12 hour, e.created_at, timestamp '1970-01-01') - interval 12 hour]) as window_start from env e) group by window_start, source"
)


@query("rolling_throughput", ROLLING)
def _(t: Tables):
    return jobs.rolling_throughput(t.env, minutes=1440, slide="12 hours")


@query("stream_rolling_throughput", ROLLING)
def _(t: Tables):
    stream = jobs.rolling_throughput(t.event_stream(), minutes=1440, slide="12 hours")
    return latest_totals(t, stream, "rolling")


@query(
    "stream_alerts",
    f"select id as alert_rule_id, value as metric_value, message, {NOW} as fired_at from judged where above",
    flow.ALERTS,
)
def _(t: Tables):
    folder = scratch_path(t.spark, "alerts")
    ticks = t.event_stream().select("created_at")
    job = jobs.stream_alerts(
        ticks, lambda: t.env, t.rules, folder, folder + "-log", clock=lambda batch: batch.select(F.max("created_at")).scalar(),
        latency_sample=500,
    )
    job.awaitTermination()
    return t.spark.read.parquet(folder).select("alert_rule_id", "metric_value", "message", "fired_at")


@query(
    "stream_reconcile",
    "select source, external_id, event_type, created_at from (select *, row_number() over (partition by source, external_id order by"
    " (status = 'RECEIVED')::int, created_at, id) as rn from env) where rn = 1",
)
def _(t: Tables):
    folder = scratch_path(t.spark, "reconciled")
    columns = ["external_id", "source", "event_type", "payload", "created_at"]
    jobs.append_to_store(t.stored.select("id", *columns), folder)
    landed = t.event_stream().select(*columns[:-1], F.col("created_at").alias("occurred_at"))
    jobs.stream_reconcile(landed, folder, folder + "-log").awaitTermination()
    return t.spark.read.parquet(folder).select("source", "external_id", "event_type", "created_at")


@query(
    "stream_refine",
    f"select e.id as event_id, r.id as route_id, r.target_url as url from env e join routes r on {flow.ON_ROUTE}",
)
def _(t: Tables):
    stream = t.event_stream().withColumn("payload", F.expr(ORDER_PAYLOAD))
    plan = jobs.stream_refine(stream, t.routes, t.transforms)
    return drained(t, plan.select("event_id", "route_id", "url", "body"), "refined").select("event_id", "route_id", "url")
