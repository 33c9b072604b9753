from hookflow.streaming.jobs import (
    rolling_throughput,
    stream_alerts,
    stream_dedup,
    stream_ingest,
    stream_reconcile,
    stream_refine,
)

__all__ = [
    "rolling_throughput",
    "stream_alerts",
    "stream_dedup",
    "stream_ingest",
    "stream_reconcile",
    "stream_refine",
]
