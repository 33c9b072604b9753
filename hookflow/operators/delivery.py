"""Delivery attempts: recording, folding into event status, and reporting."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.functions.scalars import delivery_ok, truncate_body
from hookflow.operators.metrics import ranked_values
from hookflow.session import instant

MAX_ATTEMPTS = 3
OUTCOME_FIELDS = ("response_code", "response_body", "duration_ms", "attempts", "last_error")
# Success share (%) and p95 (ms) a verdict requires, best first.
VERDICTS = (("EXCELLENT", 99.9, 1000), ("GOOD", 99.0, 2000), ("FAIR", 95.0, 5000))


def create_deliveries(intents: DataFrame, as_of: Column | datetime) -> DataFrame:
    """PENDING delivery rows for delivery intents."""
    return intents.select(
        F.col("delivery_id").alias("id"),
        "event_id",
        "route_id",
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("int").alias("response_code"),
        F.lit(None).cast("string").alias("response_body"),
        F.lit(None).cast("int").alias("duration_ms"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
        instant(as_of).alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


def append_deliveries(deliveries: DataFrame, outcomes: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Deliveries with their outcomes recorded; a non-PENDING status stamps ``completed_at``.

    Fields an outcome leaves null keep their stored value. Long response bodies are cut.
    """
    given = [name for name in OUTCOME_FIELDS if name in outcomes.columns]
    news = outcomes.select(
        "id", F.col("status").alias("_status"), *[F.col(name).alias(f"_{name}") for name in given]
    )
    joined = deliveries.join(news, "id", "left")
    changes = {name: F.coalesce(f"_{name}", name) for name in given}
    if "response_body" in given:
        changes["response_body"] = F.coalesce(truncate_body(F.col("_response_body")), F.col("response_body"))
    done = F.col("_status") != "PENDING"
    changes["completed_at"] = F.when(done, instant(as_of)).otherwise(F.col("completed_at"))
    changes["status"] = F.coalesce("_status", "status")
    return joined.withColumns(changes).select(*deliveries.columns)


def delivery_outcome(deliveries: DataFrame) -> DataFrame:
    """Per event and attempt: DELIVERED when every route succeeded, else the failure text.

    An attempt with a PENDING delivery has no outcome yet.
    """
    grouped = deliveries.groupBy("event_id", F.col("attempts").alias("attempt")).agg(
        F.count(F.lit(1)).alias("routes"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "PENDING").alias("open"),
        F.max("completed_at").alias("at"),
    )
    grouped = grouped.filter(F.col("open") == 0)
    text = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("routes").cast("string"))
    return grouped.select(
        "event_id",
        "attempt",
        F.when(F.col("failed") == 0, F.lit("DELIVERED")).otherwise(F.lit("FAILED")).alias("status"),
        F.when(F.col("failed") > 0, F.concat(text, F.lit(" deliveries failed"))).alias("error"),
        "at",
    )


def final_status(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Event status after its latest attempt; failures are DEAD once the attempts are used up."""
    latest = F.max(F.struct("attempt", "status", "error", "at")).alias("l")
    last = attempts.groupBy("event_id").agg(latest).select("event_id", "l.*")
    good = F.col("status") == "DELIVERED"
    status = (
        F.when(good, F.lit("DELIVERED"))
        .when(F.col("attempt") >= max_attempts, F.lit("DEAD"))
        .otherwise(F.lit("FAILED"))
    )
    return last.select(
        "event_id",
        status.alias("status"),
        F.col("attempt").alias("attempts"),
        F.when(~good, F.col("error")).alias("last_error"),
        F.when(~good, F.col("at")).alias("failed_at"),
        F.when(good, F.col("at")).alias("processed_at"),
    )


def _nearest(percent: float):
    """0-based nearest rank ``ceil(p/100 * n) - 1``, never below zero."""
    return lambda total: F.greatest(F.ceil(F.lit(percent / 100) * total.cast("double")) - 1, F.lit(0))


def delivery_report(deliveries: DataFrame) -> DataFrame:
    """One row: volume, success share, rate, latency order statistics and a verdict."""
    good = F.col("status") == "DELIVERED"
    span = (F.unix_millis(F.max("completed_at")) - F.unix_millis(F.min("created_at"))) / F.lit(1000.0)
    totals = deliveries.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), span.alias("duration_s")
    )
    ranks = {"min_ms": _nearest(0), "p50_ms": _nearest(50), "p95_ms": _nearest(95), "p99_ms": _nearest(99)}
    ranks["max_ms"] = _nearest(100)
    timed = deliveries.filter(F.col("duration_ms").isNotNull()).select(
        F.lit(1).alias("_one"), F.col("duration_ms").cast("bigint").alias("ms")
    )
    stats = ranked_values(timed, "ms", ranks, ["_one"])
    # Two one-row tables; an aggregate merges them where a join would have no key.
    both = totals.unionByName(stats.drop("_one"), allowMissingColumns=True)
    joined = both.agg(*[F.max(name).alias(name) for name in both.columns])
    zero = F.lit(0).cast("bigint")
    share = F.try_divide(F.col("success"), F.col("total")) * 100
    verdict = F.lit("POOR")
    for name, least, most in reversed(VERDICTS):
        verdict = F.when((share >= least) & (F.coalesce("p95_ms", zero) < most), F.lit(name)).otherwise(verdict)
    return joined.select(
        "total",
        "success",
        (F.col("total") - F.col("success")).alias("failed"),
        share.alias("success_pct"),
        F.try_divide(F.col("total"), F.col("duration_s")).alias("rps"),
        *[F.coalesce(name, zero).alias(name) for name in ranks],
        verdict.alias("verdict"),
    )


def delivery_errors(deliveries: DataFrame) -> DataFrame:
    """Failed deliveries per error key: the HTTP code when there is one, else the error text."""
    code = F.col("response_code")
    key = F.when(code.isNotNull(), F.concat(F.lit("HTTP_"), code.cast("string"))).otherwise(
        F.coalesce(F.nullif("last_error", F.lit("")), F.lit("UNKNOWN_ERROR"))
    )
    bad = (F.col("status") == "FAILED") & (code.isNull() | ~delivery_ok(code))
    return deliveries.filter(bad).groupBy(key.alias("error_key")).agg(F.count(F.lit(1)).alias("count"))
