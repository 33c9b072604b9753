"""Landed snapshots of another system's events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.session import instant


def read_external_events(snapshot: DataFrame, start: Column | datetime, end: Column | datetime) -> DataFrame:
    """Rows of a snapshot (id, type, created in epoch seconds, payload) created in ``[start, end]``.

    Bounds are floored to whole seconds; the filter is a plain range on ``created``.
    """
    inside = F.col("created").between(F.unix_seconds(instant(start)), F.unix_seconds(instant(end)))
    extra = [c for c in ("source",) if c in snapshot.columns]
    return snapshot.filter(inside).select(
        *extra,
        F.col("id").alias("external_id"),
        F.col("type").alias("event_type"),
        "payload",
        F.timestamp_seconds("created").alias("occurred_at"),
    )
