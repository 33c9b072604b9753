"""Event status as an append-only log with a latest-per-event view."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.model import EVENT_STATUS_LOG, EVENT_STATUSES, columns_of
from hookflow.session import instant

LOG_FIELDS = columns_of(EVENT_STATUS_LOG)
CARRIED = ("attempts", "last_error", "queued_at", "processed_at", "failed_at")
LIST_FIELDS = {"last_error", "queued_at"}


def status_rows(ids: DataFrame, status: str | Column, at: Column | datetime, **extra: Any) -> DataFrame:
    """Log rows for a set of event ids (column ``id``); ``extra`` holds values or columns."""
    unknown = set(extra) - set(CARRIED)
    if unknown:
        raise ValueError(f"unknown status fields {sorted(unknown)}")
    if isinstance(status, str) and status not in EVENT_STATUSES:
        raise ValueError(f"unknown status {status}")
    values = {
        "event_id": F.col("id"),
        "status": status if isinstance(status, Column) else F.lit(status),
        "at": instant(at),
    }
    values.update({k: v if isinstance(v, Column) else F.lit(v) for k, v in extra.items()})
    return ids.select(
        *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in LOG_FIELDS.items()]
    )


def append_status(
    log: DataFrame, ids: DataFrame, status: str, at: Column | datetime, batch: bool = False, **extra: Any
) -> DataFrame:
    """The log with one transition per id; the list form carries ``last_error`` and ``queued_at`` only."""
    if batch and set(extra) - LIST_FIELDS:
        raise ValueError("a list of ids can only carry last_error and queued_at")
    return log.unionByName(status_rows(ids, status, at, **extra))


def current_state(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events with the status of their newest transition.

    Each carried field holds the last value a transition gave it; transitions that do
    not mention a field leave it alone. Equal times are ordered by lifecycle position.
    """
    position = F.array_position(F.array(*[F.lit(s) for s in EVENT_STATUSES]), F.col("status"))
    order = F.struct("at", position)
    latest = [F.max_by("status", order).alias("_status")]
    latest += [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f"_{f}") for f in CARRIED]
    newest = log.groupBy(F.col("event_id").alias("id")).agg(*latest)
    joined = events.join(newest, "id", "left")
    changes = {
        name: F.coalesce(f"_{name}", name) if name in events.columns else F.col(f"_{name}")
        for name in ("status", *CARRIED)
    }
    return joined.withColumns(changes).drop(*[f"_{name}" for name in ("status", *CARRIED)])


def dlq_discard(events: DataFrame, ids: DataFrame, as_of: Column | datetime, strict: bool = True) -> DataFrame:
    """DISCARDED transitions for the given ids.

    ``strict`` admits DEAD events only; otherwise any known id is discarded unchecked.
    """
    known = events.filter(F.col("status") == "DEAD") if strict else events
    return status_rows(known.join(ids.select("id").distinct(), "id", "left_semi"), "DISCARDED", as_of)
