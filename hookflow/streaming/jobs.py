"""Continuous twins of the batch operators, on Structured Streaming.

Batch logic is reused inside ``foreachBatch``; the checkpoint is the write-ahead log,
and a micro-batch that is repeated writes over what it wrote before.
"""

from __future__ import annotations

import hashlib
import logging
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hookflow.functions.scalars import js_round, parse_window
from hookflow.model import ALERT_HISTORY, ERROR_STATUSES
from hookflow.operators.alerts import evaluate_alerts, fired_rows
from hookflow.operators.dedup import append_events
from hookflow.operators.ingest import ingest_events
from hookflow.operators.keyindex import BUCKETS, KeyIndex
from hookflow.operators.reconcile import reconcile_inject, reconcile_missing, reconcile_summary
from hookflow.operators.routing import plan_deliveries
from hookflow.session import cut_lineage

log = logging.getLogger(__name__)

Trigger = Mapping[str, object]
ONCE: Trigger = {"availableNow": True}
DATE_COLUMN = "created_date"
BATCH_COLUMN = "stored_by"


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: Trigger) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def append_to_store(rows: DataFrame, path: str, stored_by: str | None = None, buckets: int = BUCKETS) -> None:
    """Append a batch of events to the stored table, skipping conflicts, partitioned by creation day and batch.

    Conflicts are looked up in the key index beside the store. ``stored_by`` names the batch: run again under its name, it replaces what it
    stored before. The batch is kept for its several uses; lost blocks are recomputed from its source.
    """
    spark = rows.sparkSession
    stored_by = stored_by or f"load-{uuid.uuid4().hex}"
    index = KeyIndex(spark, path, buckets)
    rows = rows.persist()
    try:
        fresh = append_events(rows, index.known(rows, stored_by), small_batch=True)
        dated = fresh.withColumns({DATE_COLUMN: F.to_date("created_at"), BATCH_COLUMN: F.lit(stored_by)})
        rows.limit(0).withColumns({DATE_COLUMN: F.to_date("created_at"), BATCH_COLUMN: F.lit("")}).write.mode("ignore").parquet(path)
        # Rebalancing gives each day files of a sensible size and splits a day that holds most rows.
        writer = dated.hint("rebalance", DATE_COLUMN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(DATE_COLUMN, BATCH_COLUMN).parquet(path)
        own = spark.read.schema(dated.schema).parquet(path).filter(F.col(BATCH_COLUMN) == stored_by)
        index.add(own, stored_by)
    finally:
        rows.unpersist()


def batch_name(checkpoint: str, number: int) -> str:
    """A name for a micro-batch that is the same whenever it is run again, and no other's."""
    return f"batch-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{number}"


def stream_ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    sources: DataFrame,
    schemas: DataFrame,
    trigger: Trigger = ONCE,
    parity: bool = False,
) -> StreamingQuery:
    """Raw deliveries to the stored event table; offsets advance only after a durable write.

    Batch size follows the source's own limits (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """

    def each(batch: DataFrame, number: int) -> None:
        append_to_store(ingest_events(batch, sources, schemas, parity), path, batch_name(checkpoint, number))

    return _start(stream, each, checkpoint, trigger)


STATE = "keys array<string>, starts array<bigint>, ends array<bigint>, newest bigint"
BUCKETS = 1024


class _OpenWindows:
    """The greedy time-to-live rule for a bucket of keys. State is the accepted windows that a row may still fall into (microseconds)."""

    def __init__(self, late: int):
        self.late = late

    def __call__(self, _: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows: dict[str, list[tuple[int, int]]] = {}
        newest = -(1 << 62)
        if state.exists:
            *columns, newest = state.get
            for key, start, end in zip(*columns, strict=True):
                windows.setdefault(key, []).append((start, end))
        held = [frame for frame in frames if len(frame)]
        if held:
            rows = pd.concat(held, ignore_index=True).sort_values(["_at", "id"], kind="stable", ignore_index=True)
            kept = []
            for place, (key, at, ttl) in enumerate(zip(rows["_key"], rows["_at"].tolist(), rows["_ttl"].tolist(), strict=True)):
                own = windows.setdefault(key, [])
                before = bisect_right(own, (at, 1 << 62))
                if not before or at >= own[before - 1][1]:
                    own.insert(before, (at, at + ttl))
                    kept.append(place)
            newest = max(newest, int(rows["_at"].max()))
            if kept:
                yield rows.iloc[kept].drop(columns=["_ttl", "_key", "_bucket", "_at"])
        # Only windows that rows up to ``late`` behind may fall into are kept; a key without one is dropped.
        open_ = [(key, start, end) for key, own in windows.items() for start, end in own if end > newest - self.late]
        keys, starts, ends = map(list, zip(*open_, strict=True)) if open_ else ([], [], [])
        state.update((keys, starts, ends, newest))


def stream_dedup(
    stream: DataFrame, sources: DataFrame, late: timedelta = timedelta(minutes=10), buckets: int = BUCKETS
) -> DataFrame:
    """The time-to-live rule on a stream, with state per hash bucket of (source, external id).

    No row is lost for being late: a row inside a known window of its key is a repeat, any other is kept. Windows are known until the newest row of
    the bucket is ``late`` past their end. Rows of one micro-batch are taken in order of time, then id, so a stream in order gives what
    the batch rule gives.

    Buckets spread the call and state cost over many keys, as a call for each key costs more than its work; choose them as a multiple of the cluster's cores
    (a later change needs a new checkpoint). No clock drops state, as a replayed stream may run at any pace: each batch drops the windows
    that its rows have passed. Rows that take no part in deduplication bypass the stateful step. The rows of one bucket in
    one micro-batch meet in one task, so the source's trigger limit bounds that group.
    """
    ttl = parse_window(F.coalesce("dedup_window", F.lit("72h")))
    settings = sources.filter(F.nullif("dedup_field", F.lit("")).isNotNull()).select(
        F.col("name").alias("source"), (ttl * 1_000_000).cast("bigint").alias("_ttl")
    )
    maps = {f.name: f.dataType for f in stream.schema if isinstance(f.dataType, T.MapType)}
    flat = stream.withColumns({name: F.to_json(name) for name in maps}) if maps else stream
    marked = flat.join(settings.filter("_ttl > 0"), "source", "left").select(*flat.columns, "_ttl")
    takes_part = F.col("_ttl").isNotNull() & F.col("external_id").isNotNull()
    keyed = marked.filter(takes_part).withColumns(
        {
            "_key": F.concat_ws("\u001f", "source", "external_id"),
            "_bucket": F.pmod(F.hash("source", "external_id"), F.lit(buckets)),
            "_at": F.unix_micros("created_at"),
        }
    )
    rule = _OpenWindows(int(late.total_seconds() * 1_000_000))
    kept = keyed.groupBy("_bucket").applyInPandasWithState(
        rule.__call__, flat.schema, STATE, "append", GroupStateTimeout.NoTimeout
    )
    out = kept.unionByName(marked.filter(~takes_part).drop("_ttl"))
    return out.withColumns({name: F.from_json(name, kind) for name, kind in maps.items()}) if maps else out


def rolling_throughput(
    stream: DataFrame, minutes: int = 60, slide: str = "10 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Rate and error share per source over sliding windows; works on streams and tables."""
    span = F.window("created_at", f"{minutes} minutes", slide)
    failed = F.count_if(F.col("status").isin(*ERROR_STATUSES))
    total = F.count(F.lit(1))
    return (
        stream.withWatermark("created_at", late)
        .groupBy(span.alias("w"), "source")
        .agg(total.alias("total"), failed.alias("failed"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "source",
            "total",
            "failed",
            js_round(F.col("total") / F.lit(minutes * 60), 2).alias("per_second"),
            js_round(F.col("failed") / F.col("total") * 100, 2).alias("error_rate"),
        )
    )


def stream_alerts(
    ticks: DataFrame,
    read_events: Callable[[], DataFrame],
    rules: DataFrame,
    history_path: str,
    checkpoint: str,
    trigger: Trigger = ONCE,
    clock: Callable[[DataFrame], Column | datetime] | None = None,
    latency_sample: int | None = None,
) -> StreamingQuery:
    """Evaluate all active rules on every trigger and append what fired to the history table.

    ``clock`` turns a tick batch into ``as_of``; by default it is the current time.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        as_of = clock(batch) if clock else F.current_timestamp()
        spark.createDataFrame([], ALERT_HISTORY).write.mode("ignore").parquet(history_path)
        history = spark.read.schema(ALERT_HISTORY).parquet(history_path)
        fired = fired_rows(evaluate_alerts(read_events(), rules, history, as_of, latency_sample=latency_sample))
        fired.join(history.select("id"), "id", "left_anti").coalesce(1).write.mode("append").parquet(history_path)

    return _start(ticks, each, checkpoint, trigger)


def reconcile_sources(
    readers: Mapping[str, Callable[[datetime, datetime], DataFrame]],
    read_stored: Callable[[], DataFrame],
    inject: Callable[[DataFrame], None],
    as_of: datetime,
    minutes: int = 30,
) -> tuple[list[DataFrame], dict[str, str]]:
    """Reconcile every source over the trailing window; (summaries, failures by source).

    A source that fails is reported and skipped. Overlapping windows are harmless:
    injected rows are stored rows in the next run.
    """
    summaries, failures = [], {}
    start = as_of - timedelta(minutes=minutes)
    for name, read in readers.items():
        try:
            external = read(start, as_of).withColumn("source", F.lit(name))
            stored = read_stored()
            summary = cut_lineage(reconcile_summary(external, stored, start, as_of))
            inject(reconcile_inject(reconcile_missing(external, stored), as_of))
            summaries.append(summary)
        except Exception as error:  # one failing source must not stop the others
            log.warning("reconciliation of %s failed: %s", name, error)
            failures[name] = str(error)
    return summaries, failures


def stream_reconcile(
    external: DataFrame,
    path: str,
    checkpoint: str,
    trigger: Trigger = ONCE,
) -> StreamingQuery:
    """Inject the external events of each micro-batch that the stored table lacks.

    ``external`` carries source, external_id, event_type, payload and occurred_at.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, batch_name(checkpoint, number)
        names = [c for c in spark.read.parquet(path).columns if c not in (DATE_COLUMN, BATCH_COLUMN)]
        known = KeyIndex(spark, path).known(batch.withColumn("id", F.lit(None).cast("string")), name)
        rows = reconcile_inject(reconcile_missing(batch, known), F.current_timestamp())
        rows = rows.withColumn("created_at", F.col("occurred_at")).drop("occurred_at")
        append_to_store(rows.select(*[c for c in names if c in rows.columns]), path, name)

    return _start(external, each, checkpoint, trigger)


def stream_refine(
    stream: DataFrame, routes: DataFrame, transforms: DataFrame, as_of: Column | datetime | None = None
) -> DataFrame:
    """Streaming delivery plan: reshaping, stream-static route join, one row per intent."""
    return plan_deliveries(stream, routes, transforms, F.current_timestamp() if as_of is None else as_of)
