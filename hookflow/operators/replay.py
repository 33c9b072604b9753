"""Selecting stored events by filter and re-emitting them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.functions.scalars import js_round
from hookflow.operators.ingest import event_id
from hookflow.operators.lifecycle import status_rows
from hookflow.session import instant

IN_FLIGHT = ("QUEUED", "PROCESSING")


class NoEventsToReplayError(ValueError):
    """A replay request whose filter selects nothing."""


def replay_predicate(filters: Mapping[str, Any]) -> Column:
    """Conjunction of the given filters; ``from`` and ``to`` are both inclusive."""
    tests = {
        "source": lambda v: F.col("source") == v,
        "event_type": lambda v: F.col("event_type") == v,
        "status": lambda v: F.col("status") == v,
        "from": lambda v: F.col("created_at") >= instant(v),
        "to": lambda v: F.col("created_at") <= instant(v),
    }
    unknown = set(filters) - set(tests) - {"limit", "offset"}
    if unknown:
        raise ValueError(f"unknown replay filters {sorted(unknown)}")
    chosen = [test(filters[name]) for name, test in tests.items() if filters.get(name) is not None]
    return reduce(lambda a, b: a & b, chosen, F.lit(True))


def replay_select(events: DataFrame, filters: Mapping[str, Any], ordered: bool = True) -> DataFrame:
    """Events a filter selects, oldest first, optionally one page of them. An offset alone skips rows and keeps all others."""
    out = events.filter(replay_predicate(filters))
    paged = filters.get("limit") is not None or filters.get("offset") is not None
    if ordered or paged:
        out = out.orderBy("created_at", "id")
    if paged:
        out = out.offset(filters.get("offset") or 0)
        out = out if filters.get("limit") is None else out.limit(filters["limit"])
    return out


def replay_preview(events: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    return events.filter(replay_predicate(filters)).agg(F.count(F.lit(1)).alias("total_events"))


def replay_plan(events: DataFrame, filters: Mapping[str, Any], keep_event_type: bool = True) -> DataFrame:
    """Events to emit again: the selection without those still in flight.

    ``keep_event_type=False`` drops the type as the service does, so only wildcard
    routes and mappings apply to the replayed rows.
    """
    chosen = replay_select(events, filters, ordered=False).filter(~F.col("status").isin(*IN_FLIGHT))
    return chosen if keep_event_type else chosen.withColumn("event_type", F.lit(None).cast("string"))


def replay_progress(requests: DataFrame) -> DataFrame:
    share = js_round(F.try_divide("replayed_events", "total_events") * 100)
    return requests.withColumn("progress", F.coalesce(share, F.lit(0.0)).cast("int"))


def replay_request(
    events: DataFrame,
    filters: Mapping[str, Any],
    requested_by: str | None = None,
    check: bool = True,
    requested_at: Column | datetime | None = None,
) -> DataFrame:
    """One PENDING request row; a filter that selects nothing is an error.

    Its id names the filters, who asked and when, so the same filters asked for again are another request.
    """
    if check and events.filter(replay_predicate(filters)).isEmpty():
        raise NoEventsToReplayError("No events match the given filters")
    named = {name: filters.get(name) for name in ("source", "event_type", "status", "from", "to")}
    kinds = {"from": "timestamp", "to": "timestamp"}

    def literal(name: str) -> Column:
        value = named[name]
        column = value if isinstance(value, Column) else F.lit(value)
        return column.cast(kinds.get(name, "string")).alias(f"filter_{name}")

    columns = [literal(name) for name in named]
    asked = F.unix_micros(F.current_timestamp() if requested_at is None else instant(requested_at))
    return replay_preview(events, filters).select(
        event_id(
            *[F.coalesce(c.cast("string"), F.lit("")) for c in columns], F.lit(requested_by or ""), asked.cast("string")
        ).alias("id"),
        *columns,
        "total_events",
        F.lit(0).cast("bigint").alias("replayed_events"),
        F.lit("PENDING").alias("status"),
        F.lit(requested_by).cast("string").alias("requested_by"),
    )


def replay_execute(
    events: DataFrame,
    request: Mapping[str, Any],
    as_of: Column | datetime,
    keep_event_type: bool = True,
    cancelled: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(emitted events, QUEUED transitions, request counters) of one replay.

    The replay is one set-based job: rows it re-queues cannot shift a page boundary. A
    cancelled request emits nothing.
    """
    plan = replay_plan(events, request, keep_event_type)
    if cancelled:
        plan = plan.filter(F.lit(False))
    queued = status_rows(plan.select("id"), "QUEUED", as_of, queued_at=instant(as_of))
    counts = events.filter(replay_predicate(request)).agg(
        F.count(F.lit(1)).alias("total_events"),
        (F.lit(0) if cancelled else F.count_if(~F.col("status").isin(*IN_FLIGHT))).cast("bigint").alias("replayed_events"),
    )
    status = F.lit("CANCELLED" if cancelled else "COMPLETED")
    return plan, queued, counts.withColumns({"status": status, "completed_at": instant(as_of)})
