"""Comparing stored events with another system's record of the same events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.operators.ingest import event_id
from hookflow.session import broadcast_if_small, instant

KEY = ["source", "external_id"]


def _known(external: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored keys that the external rows name. An external period is small against the store: its keys go to the store's
    scan, after a count, so the store is filtered where it is read and not shuffled."""
    keys = broadcast_if_small(external.select(*KEY).distinct())
    return stored.filter(F.col("external_id").isNotNull()).select(*KEY).join(keys, KEY, "left_semi")


def reconcile_missing(external: DataFrame, stored: DataFrame) -> DataFrame:
    """External events (with their source) that are not stored."""
    return external.join(_known(external, stored), KEY, "left_anti")


def reconcile_matched(external: DataFrame, stored: DataFrame) -> DataFrame:
    return external.join(_known(external, stored), KEY, "left_semi")


def reconcile_inject(missing: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Synthetic event rows for missing events; append them with the permanent dedup tier.

    A key listed several times yields one row, its earliest occurrence.
    """
    header = F.create_map(F.lit("x-reconciled"), F.lit("true"))
    earliest = F.min(F.struct("occurred_at", "event_type", "payload")).alias("e")
    return missing.groupBy(*KEY).agg(earliest).select(
        event_id(F.lit("reconciled"), F.col("source"), F.col("external_id")).alias("id"),
        "external_id",
        "source",
        "e.event_type",
        "e.payload",
        header.alias("headers"),
        F.lit("RECEIVED").alias("status"),
        F.lit("SKIPPED").alias("validation_status"),
        F.lit(0).alias("attempts"),
        "e.occurred_at",
        instant(as_of).alias("created_at"),
    )


def reconcile_summary(
    external: DataFrame,
    stored: DataFrame,
    start: Column | datetime | None = None,
    end: Column | datetime | None = None,
) -> DataFrame:
    """Per source: external, matched, missing and injected counts of a period.

    External rows are counted per key before the join, so a key repeated many times
    travels once.
    """
    counted = external.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    flagged = counted.join(_known(counted, stored).distinct().withColumn("_known", F.lit(True)), KEY, "left")
    missing = F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0))
    out = flagged.groupBy("source").agg(
        F.sum("n").alias("external_count"),
        F.sum(F.when(F.col("_known"), F.col("n")).otherwise(0)).alias("matched_count"),
        missing.alias("missing_count"),
        missing.alias("injected_count"),
    )
    if start is not None and end is not None:
        out = out.withColumns({"period_start": instant(start), "period_end": instant(end)})
    return out
