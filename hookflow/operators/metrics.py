"""Operational metrics over events. Every window is ``created_at >= as_of - w`` with no upper bound."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hookflow.functions.scalars import js_round, latency_ms
from hookflow.model import ERROR_STATUSES
from hookflow.session import instant

COARSE_MS = 1024


def _rows() -> Column:
    return F.count(F.lit(1))


def _failed() -> Column:
    return F.col("status").isin(*ERROR_STATUSES)


def since(events: DataFrame, as_of: Column | datetime, **span: int) -> DataFrame:
    """Events of the trailing window; ``span`` is e.g. ``mins=60`` or ``secs=60``."""
    parts = {name: F.lit(size) for name, size in span.items()}
    return events.filter(F.col("created_at") >= instant(as_of) - F.make_dt_interval(**parts))


def throughput_overview(events: DataFrame, as_of: Column | datetime) -> DataFrame:
    """One row: all-time total, rate of the last minute, and all-time count per source.

    Counts are aggregated per source first, so the second step sees one row per source.
    """
    recent = F.col("created_at") >= instant(as_of) - F.make_dt_interval(secs=F.lit(60))
    per_source = events.groupBy("source").agg(_rows().alias("n"), F.count_if(recent).alias("recent"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        js_round(F.coalesce(F.sum("recent"), F.lit(0)) / 60, 2).alias("per_second"),
        counts.alias("by_sources"),
    )


def throughput_by_source(events: DataFrame, as_of: Column | datetime, minutes: int = 60) -> DataFrame:
    if not 1 <= minutes <= 1440:
        raise ValueError("minutes must be between 1 and 1440")
    return (
        since(events, as_of, mins=minutes)
        .groupBy("source")
        .agg(_rows().alias("total"), js_round(_rows() / F.lit(minutes * 60), 2).alias("per_second"))
    )


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(_rows().alias("count"))


def _delivered() -> Column:
    return (F.col("status") == "DELIVERED") & F.col("processed_at").isNotNull()


def element_at_rank(values: Column, share: float) -> Column:
    """Element ``floor(n * share)`` (0-based) of a sorted array."""
    return F.get(values, F.floor(F.size(values) * F.lit(share)).cast("int"))


def ranked_values(
    rows: DataFrame, value: str, ranks: Mapping[str, Callable[[Column], Column]], keys: list[str]
) -> DataFrame:
    """Exact order statistics of a whole-number column, without gathering or sorting rows.

    Rows are first counted per value, then per coarse bucket of values. The bucket of a
    wanted rank follows from the running bucket counts; only that bucket's values are
    ranked. Windows therefore see buckets, or the distinct values of one bucket.
    ``ranks`` maps an output name to a 0-based rank given the row count.
    """
    counted = rows.groupBy(*keys, F.col(value).alias("v")).agg(_rows().alias("n"))
    counted = counted.withColumn("bucket", F.floor(F.col("v") / COARSE_MS))
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = counted.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.withColumns({"upto": F.sum("n").over(running), "total": F.sum("n").over(whole)})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r(F.col("total")).alias("rank")) for name, r in ranks.items()])
    hits = (
        buckets.withColumn("w", F.explode(wanted))
        .filter((F.col("w.rank") < F.col("upto")) & (F.col("w.rank") >= F.col("upto") - F.col("n")))
        .select(*keys, "bucket", "w.name", (F.col("w.rank") - F.col("upto") + F.col("n")).alias("offset"))
    )
    inner = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = counted.withColumn("seen", F.sum("n").over(inner))
    picked = fine.join(hits, [*keys, "bucket"]).filter(F.col("seen") > F.col("offset"))
    columns = [F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks]
    return picked.groupBy(*keys).agg(*columns)


SHARES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def latency_by_source(events: DataFrame, sample: int | None = None) -> DataFrame:
    """Count, rounded mean and percentiles of delivery latency per source.

    Every delivery counts, by exact ranks over value counts; with a ``sample`` only the
    newest so many over all sources are read (a bounded top-k), as the service does.
    """
    ms = latency_ms(F.col("created_at"), F.col("processed_at")).alias("ms")
    delivered = events.filter(_delivered())
    if sample is not None:
        newest = delivered.orderBy(F.desc("processed_at"), "id").limit(sample).select("source", ms)
        grouped = newest.groupBy("source").agg(F.sort_array(F.collect_list("ms")).alias("l"), F.sum("ms").alias("s"))
        size = F.size("l")
        return grouped.select(
            "source",
            size.cast("bigint").alias("count"),
            js_round(F.col("s") / size).cast("bigint").alias("avg_ms"),
            *[element_at_rank(F.col("l"), share).alias(name) for name, share in SHARES.items()],
        )
    rows = delivered.select("source", ms)
    means = rows.groupBy("source").agg(
        _rows().alias("count"), js_round(F.sum("ms") / _rows()).cast("bigint").alias("avg_ms")
    )
    ranks = {
        name: (lambda total, share=share: F.floor(total.cast("double") * F.lit(share)))
        for name, share in SHARES.items()
    }
    return means.join(ranked_values(rows, "ms", ranks, ["source"]), "source")


def error_stats(events: DataFrame, as_of: Column | datetime, minutes: int = 60) -> DataFrame:
    counts = since(events, as_of, mins=minutes).agg(_rows().alias("total"), F.count_if(_failed()).alias("failed"))
    rate = F.coalesce(js_round(F.try_divide("failed", "total") * 100, 2), F.lit(0.0))
    return counts.withColumn("error_rate", rate)


def errors_by_source(events: DataFrame, as_of: Column | datetime, minutes: int = 60) -> DataFrame:
    return since(events, as_of, mins=minutes).filter(_failed()).groupBy("source").agg(_rows().alias("count"))


def dlq_by_source(events: DataFrame) -> DataFrame:
    """DEAD events per source, with the total over all sources on each row."""
    counts = events.filter(F.col("status") == "DEAD").groupBy("source").agg(_rows().alias("count"))
    return counts.withColumn("total", F.sum("count").over(Window.partitionBy(F.lit(1))))


def dlq_by_error(events: DataFrame, n: int | None = 10) -> DataFrame:
    """DEAD events per error text, the ``n`` most frequent or all; ranked by non-null errors, so the null group comes last."""
    counts = (
        events.filter(F.col("status") == "DEAD")
        .groupBy("last_error")
        .agg(_rows().alias("count"), F.count("last_error").alias("_rank"))
    )
    top = counts if n is None else counts.orderBy(F.desc("_rank"), F.asc_nulls_last("last_error")).limit(n)
    return top.select(F.coalesce("last_error", F.lit("unknown")).alias("error"), "count")


def queue_depth(events: DataFrame) -> DataFrame:
    """Backlog by lifecycle state, one row."""
    return events.agg(
        F.count_if(F.col("status") == "QUEUED").alias("waiting"),
        F.count_if(F.col("status") == "PROCESSING").alias("active"),
        F.count_if(F.col("status") == "FAILED").alias("delayed"),
        F.count_if(F.col("status") == "DEAD").alias("failed"),
    )


def metric_error_rate(events: DataFrame, as_of: Column | datetime, window_ms: int) -> DataFrame:
    counts = since(events, as_of, secs=window_ms / 1000).agg(_rows().alias("n"), F.count_if(_failed()).alias("f"))
    return counts.select(F.coalesce(F.try_divide("f", "n") * 100, F.lit(0.0)).alias("value"))


def metric_queue_size(events: DataFrame, as_of: Column | datetime | None = None, window_ms: int = 0) -> DataFrame:
    """Waiting depth now; a queue has no window."""
    return events.agg(F.count_if(F.col("status") == "QUEUED").cast("double").alias("value"))


def metric_dlq_size(events: DataFrame, as_of: Column | datetime | None = None, window_ms: int = 0) -> DataFrame:
    """All DEAD events, whatever their age."""
    return events.agg(F.count_if(F.col("status") == "DEAD").cast("double").alias("value"))


def metric_latency_p95(events: DataFrame, as_of: Column | datetime, window_ms: int, sample: int | None = None) -> DataFrame:
    """Latency at rank ``floor(n * 0.95)`` of the deliveries created in the window: all, or the newest ``sample``."""
    delivered = since(events, as_of, secs=window_ms / 1000).filter(_delivered())
    if sample is None:
        rows = delivered.select(latency_ms(F.col("created_at"), F.col("processed_at")).alias("ms"))
        ranks = {"value": lambda total: F.floor(total.cast("double") * F.lit(0.95))}
        return ranked_values(rows, "ms", ranks, []).select(F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    newest = delivered.orderBy(F.desc("processed_at"), "id").limit(sample)
    values = F.sort_array(F.collect_list(latency_ms(F.col("created_at"), F.col("processed_at"))))
    listed = newest.agg(values.alias("l"))
    return listed.select(F.coalesce(element_at_rank(F.col("l"), 0.95).cast("double"), F.lit(0.0)).alias("value"))


def metric_schema_drift(events: DataFrame, as_of: Column | datetime, window_ms: int) -> DataFrame:
    invalid = F.count_if(F.col("validation_status") == "INVALID").cast("double")
    return since(events, as_of, secs=window_ms / 1000).agg(invalid.alias("value"))


def status_share(events: DataFrame) -> DataFrame:
    """Per status count and percentage of all events (one decimal), largest first."""
    counts = status_counts(events).filter(F.col("count") > 0)
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", js_round(F.col("count") / total * 100, 1)).orderBy(F.desc("count"), "status")


def source_share(events: DataFrame) -> DataFrame:
    """Per source count as a percentage of the largest source, largest first."""
    counts = events.groupBy("source").agg(_rows().alias("count"))
    largest = F.max("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.col("count") / largest * 100).orderBy(F.desc("count"), "source")
