"""Threshold alerts: metric values for all rules, cooldown and history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.functions.scalars import alert_message, parse_duration
from hookflow.model import ERROR_STATUSES
from hookflow.operators.ingest import event_id
from hookflow.operators.metrics import metric_latency_p95
from hookflow.session import config_rows, instant


def last_fired(rules: DataFrame, history: DataFrame) -> DataFrame:
    """Rules with the time, value and message of their newest alert."""
    newest = F.max_by(F.struct("fired_at", "metric_value", "message"), F.struct("fired_at", "id")).alias("_h")
    latest = history.groupBy(F.col("alert_rule_id").alias("id")).agg(newest)
    return rules.join(latest, "id", "left").select(
        *rules.columns,
        F.col("_h.fired_at").alias("last_fired_at"),
        F.col("_h.metric_value").alias("last_value"),
        F.col("_h.message").alias("last_message"),
    )


def rule_history(history: DataFrame, rule_id: Column | str, n: int | None = None) -> DataFrame:
    """Alerts of one rule, newest first: all, or the newest ``n``."""
    own = history.filter(F.col("alert_rule_id") == rule_id).orderBy(F.desc("fired_at"), "id")
    return own if n is None else own.limit(n)


def metric_values(
    events: DataFrame, rules: DataFrame, as_of: Column | datetime, latency_sample: int | None = None
) -> DataFrame:
    """(metric, window_ms, value) for every combination the active rules use.

    The counting metrics of all windows come from one pass over the events; a latency
    rule adds exact ranks per distinct window, or those of the newest ``latency_sample`` deliveries.
    """
    now = instant(as_of)
    used = rules.filter("active").select("metric", parse_duration(F.col("window")).alias("window_ms")).distinct()
    pairs = sorted((row.metric, row.window_ms) for row in config_rows(used))
    failed = F.col("status").isin(*ERROR_STATUSES)
    invalid = F.col("validation_status") == "INVALID"
    aggregates: list[Column] = []
    values: list[tuple[str, int, Column]] = []
    latency: list[int] = []
    for number, (metric, window_ms) in enumerate(pairs):
        inside = F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(window_ms / 1000))
        one, two = f"_a{number}", f"_b{number}"
        if metric == "ERROR_RATE":
            aggregates += [F.count_if(inside).alias(one), F.count_if(inside & failed).alias(two)]
            rate = F.coalesce(F.try_divide(two, one) * 100, F.lit(0.0))
            values.append((metric, window_ms, rate))
        elif metric == "LATENCY_P95":
            latency.append(window_ms)
        else:
            test = {
                "QUEUE_SIZE": F.col("status") == "QUEUED",
                "DLQ_SIZE": F.col("status") == "DEAD",
                "SCHEMA_DRIFT": inside & invalid,
            }.get(metric, F.lit(False))
            aggregates.append(F.count_if(test).alias(one))
            values.append((metric, window_ms, F.col(one)))

    def labelled(metric: str, window_ms: int, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(window_ms).cast("bigint").alias("window_ms"),
            value.cast("double").alias("value"),
        )

    parts: list[DataFrame] = []
    if aggregates:
        entries = F.explode(F.array(*[labelled(*v) for v in values]))
        parts.append(events.agg(*aggregates).select(entries.alias("m")).select("m.*"))
    for window_ms in latency:
        single = metric_latency_p95(events, as_of, window_ms, latency_sample)
        parts.append(single.select(labelled("LATENCY_P95", window_ms, F.col("value")).alias("m")).select("m.*"))
    if not parts:
        empty = F.explode(F.filter(F.array(labelled("", 0, F.lit(0.0))), lambda m: F.lit(False)))
        return events.limit(1).select(empty.alias("m")).select("m.*")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate_alerts(
    events: DataFrame, rules: DataFrame, history: DataFrame, as_of: Column | datetime, label: str = "Alert",
    latency_sample: int | None = None,
) -> DataFrame:
    """All active rules at ``as_of``: value, whether the threshold is passed, suppression and message.

    A rule fires when its value is strictly above the threshold and its last alert is
    at least one cooldown old.
    """
    now = instant(as_of)
    state = last_fired(rules.filter("active"), history).withColumn("window_ms", parse_duration(F.col("window")))
    joined = state.join(metric_values(events, rules, as_of, latency_sample), ["metric", "window_ms"], "left")
    value = F.coalesce("value", F.lit(0.0))
    above = value > F.col("threshold")
    elapsed = F.unix_micros(now) - F.unix_micros("last_fired_at")
    cooling = F.coalesce(elapsed < parse_duration(F.col("cooldown")) * 1000, F.lit(False))
    return joined.select(
        "id",
        "name",
        "metric",
        "threshold",
        value.alias("value"),
        above.alias("above"),
        (above & cooling).alias("suppressed"),
        (above & ~cooling).alias("fired"),
        alert_message(F.col("name"), F.col("metric"), value, F.col("threshold"), label).alias("message"),
        now.alias("evaluated_at"),
    )


def fired_rows(evaluated: DataFrame) -> DataFrame:
    """History rows for the alerts that fired."""
    return evaluated.filter("fired").select(
        event_id(F.col("id"), F.unix_micros("evaluated_at").cast("string")).alias("id"),
        F.col("id").alias("alert_rule_id"),
        F.col("value").alias("metric_value"),
        "message",
        F.col("evaluated_at").alias("fired_at"),
    )


def append_alert_history(history: DataFrame, evaluated: DataFrame) -> DataFrame:
    """History plus the alerts that fired; firing the same instant twice adds nothing."""
    fresh = fired_rows(evaluated).join(history.select("id"), "id", "left_anti")
    return history.unionByName(fresh)
