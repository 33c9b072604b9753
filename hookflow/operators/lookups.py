"""Look-ups over events and deliveries, as pages or as whole sets. Equal timestamps are ordered by id.

With ``n=None`` (or ``limit=None``) a look-up returns every row and sorts nothing: order is a matter of pages.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.model import ERROR_STATUSES
from hookflow.session import instant

STUCK_RECEIVED_SECONDS = 60
STUCK_QUEUED_SECONDS = 300


def _oldest(rows: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    return rows if n is None else rows.orderBy("created_at", "id").offset(offset).limit(n)


def _newest(rows: DataFrame, n: int | None) -> DataFrame:
    return rows if n is None else rows.orderBy(F.desc("created_at"), "id").limit(n)


def events_by_status(events: DataFrame, status: str, n: int | None = 100) -> DataFrame:
    """Events in a state: the oldest ``n``, or all."""
    return _oldest(events.filter(F.col("status") == status), n)


def newest_events(events: DataFrame, n: int = 500) -> DataFrame:
    """The newest ``n`` events, newest first."""
    return _newest(events, n)


def oldest_page(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the events, oldest first."""
    return _oldest(events, limit, offset)


def newest_per_source(events: DataFrame) -> DataFrame:
    """source, created_at and id of each source's newest event: an aggregate, so no source is gathered."""
    newest = F.max(F.struct("created_at", "id")).alias("n")
    return events.groupBy("source").agg(newest).select("source", "n.created_at", "n.id")


def stuck_received(events: DataFrame, as_of: Column | datetime, n: int | None = None) -> DataFrame:
    """RECEIVED events created before ``as_of`` minus one minute: all, or the oldest ``n``."""
    before = instant(as_of) - F.make_dt_interval(secs=F.lit(STUCK_RECEIVED_SECONDS))
    old = events.filter((F.col("status") == "RECEIVED") & (F.col("created_at") < before))
    return _oldest(old, n)


def stuck_queued(events: DataFrame, as_of: Column | datetime, n: int | None = None, limit_first: bool = False) -> DataFrame:
    """QUEUED events waiting for more than five minutes: all, or the oldest ``n``.

    ``limit_first=True`` takes the oldest ``n`` before the age test, as the service does; then
    young rows can hide old ones.
    """
    queued = events.filter(F.col("status") == "QUEUED")
    since = F.coalesce("queued_at", "created_at")
    waited = since < instant(as_of) - F.make_dt_interval(secs=F.lit(STUCK_QUEUED_SECONDS))
    if limit_first:
        return _oldest(queued, n).filter(waited)
    return _oldest(queued.filter(waited), n)


def _dead(events: DataFrame, source: str | None, event_type: str | None) -> DataFrame:
    out = events.filter(F.col("status") == "DEAD")
    if source:
        out = out.filter(F.col("source") == source)
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    return out


def dlq_list(
    events: DataFrame, source: str | None = None, event_type: str | None = None, limit: int | None = 50, offset: int = 0
) -> DataFrame:
    """A page of the dead-letter set, newest failure first (rows without a failure time lead); the whole set without a limit."""
    if limit is None:
        return _dead(events, source, event_type)
    if limit < 1:
        raise ValueError("limit must be at least 1")
    page = _dead(events, source, event_type).orderBy(F.desc_nulls_first("failed_at"), "id")
    return page.offset(offset).limit(limit)


def dlq_total(events: DataFrame, source: str | None = None, event_type: str | None = None) -> DataFrame:
    return _dead(events, source, event_type).agg(F.count(F.lit(1)).alias("total"))


def dlq_event(events: DataFrame, event_id: str) -> DataFrame:
    return _dead(events, None, None).filter(F.col("id") == event_id)


def recent_errors(events: DataFrame, n: int = 10) -> DataFrame:
    return (
        events.filter(F.col("status").isin(*ERROR_STATUSES))
        .orderBy(F.desc("created_at"), "id")
        .limit(n)
        .select("id", "source", "event_type", "last_error", "created_at", "failed_at")
    )


def deliveries_by_event(deliveries: DataFrame, event_id: Column | str) -> DataFrame:
    return deliveries.filter(F.col("event_id") == event_id).orderBy(F.desc("created_at"), "id")


def deliveries_by_route(deliveries: DataFrame, route_id: Column | str, n: int | None = 100) -> DataFrame:
    """Deliveries of a route: the newest ``n``, or all."""
    return _newest(deliveries.filter(F.col("route_id") == route_id), n)


def pending_deliveries(deliveries: DataFrame, n: int | None = 100) -> DataFrame:
    """Deliveries not made yet: the oldest ``n``, or all."""
    return _oldest(deliveries.filter(F.col("status") == "PENDING"), n)
