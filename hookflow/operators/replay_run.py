"""Replays that can be cancelled, fail, and go on: a ledger of chunks beside the emitted events.

Submitting a request fixes its chunks: ranges of (created_at, id) with about equally many of the selected events, so chunks run oldest first.
Each chunk is emitted into a folder of its own, which a second attempt writes over, and then committed to the ledger as one row.
A request that is run again skips what is committed. Progress is what the ledger says at any time: a cancelled request keeps what it has done, a
failure puts the request back to PENDING with its counter, and running it again emits no event twice.

The ledger and the requests are small files in a folder that driver and executors share; one runner per request is assumed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookflow.operators.lifecycle import status_rows
from hookflow.operators.replay import NoEventsToReplayError, replay_plan, replay_request
from hookflow.session import instant

CHUNK_EVENTS = 100_000
# Chunks of one request, each two bounds; more events make larger chunks.
MAX_CHUNKS = 1000
PLAN = "request string, chunk int, after_at bigint, after_id string, until_at bigint, until_id string"
LEDGER = "request string, chunk int, events bigint"
STATES = "request string, number int, status string, at timestamp, requested_by string, total_events bigint"


class ReplayRunner:
    def __init__(self, spark: SparkSession, path: str, chunk_events: int = CHUNK_EVENTS):
        self.spark, self.path, self.chunk_events = spark, path.rstrip("/"), chunk_events

    def _table(self, name: str, layout: str) -> DataFrame:
        self.spark.createDataFrame([], layout).write.mode("ignore").parquet(f"{self.path}/{name}/none")
        return self.spark.read.schema(layout).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def _put(self, name: str, place: str, layout: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, layout).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/{place}")

    def submit(self, events: DataFrame, filters: Mapping[str, Any], requested_at: datetime, requested_by: str | None = None) -> str:
        """Notes a PENDING request and its chunks; returns its id, which names the filters, the time and who asked."""
        request = replay_request(events, filters, requested_by, requested_at=requested_at).first()
        chosen = replay_plan(events, filters).select(F.unix_micros("created_at").alias("at"), F.col("id").alias("id"))
        count = chosen.count()
        if not count:
            raise NoEventsToReplayError("No events match the given filters")
        chunks = min(MAX_CHUNKS, -(-count // self.chunk_events))
        # Bounds only have to part the events: every event lies in one range, whatever the sample says.
        shares = [i / chunks for i in range(1, chunks)]
        bounds: list[tuple[int, str] | None] = []
        if shares:
            found = chosen.agg(F.percentile_approx("at", shares, 10_000).alias("at")).first()
            bounds = [(at, "") for at in sorted(set(found["at"]))]
        edges = [None, *bounds, None]
        rows = [(request.id, i, *(edges[i] or (None, None)), *(edges[i + 1] or (None, None))) for i in range(len(edges) - 1)]
        self._put("plans", request.id, PLAN, rows)
        self._put("states", f"{request.id}-0", STATES, [(request.id, 0, "PENDING", requested_at, requested_by, request.total_events)])
        return request.id

    def run(
        self,
        events: DataFrame,
        filters: Mapping[str, Any],
        request: str,
        as_of: datetime,
        cancelled: Callable[[], bool] = lambda: False,
        keep_event_type: bool = True,
        each: Callable[[DataFrame], None] | None = None,
    ) -> str:
        """Emits the chunks that are not committed yet; returns the status.

        ``cancelled`` is asked before every chunk. ``each`` may hand a chunk on, with events in it that an attempt before handed on too.
        ``events`` are the events as stored when the request was submitted: what the replay itself changes is the status log.
        """
        self._note(request, "IN_PROGRESS", as_of)
        committed = {r.chunk for r in self.ledger(request).select("chunk").collect()}
        plan = replay_plan(events, filters, keep_event_type)
        place = F.struct(F.unix_micros("created_at"), F.col("id"))
        try:
            for row in sorted(self._table("plans", PLAN).filter(F.col("request") == request).collect(), key=lambda r: r.chunk):
                if row.chunk in committed:
                    continue
                if cancelled():
                    return self._note(request, "CANCELLED", as_of)
                chunk = plan
                if row.after_at is not None:
                    chunk = chunk.filter(place >= F.struct(F.lit(row.after_at), F.lit(row.after_id)))
                if row.until_at is not None:
                    chunk = chunk.filter(place < F.struct(F.lit(row.until_at), F.lit(row.until_id)))
                folder = f"{self.path}/emitted/{request}/{row.chunk}"
                chunk.write.mode("overwrite").parquet(folder)
                emitted = self.spark.read.schema(chunk.schema).parquet(folder)
                if each:
                    each(emitted)
                self._put("ledger", f"{request}-{row.chunk}", LEDGER, [(request, row.chunk, emitted.count())])
        except Exception:
            self._note(request, "PENDING", as_of)
            raise
        return self._note(request, "COMPLETED", as_of)

    def _note(self, request: str, status: str, at: datetime) -> str:
        last = self._table("states", STATES).filter(F.col("request") == request).orderBy(F.desc("number")).first()
        self._put("states", f"{request}-{last.number + 1}", STATES, [(request, last.number + 1, status, at, last.requested_by, last.total_events)])
        return status

    def ledger(self, request: str) -> DataFrame:
        return self._table("ledger", LEDGER).filter(F.col("request") == request)

    def requests(self) -> DataFrame:
        """id, status, total_events, replayed_events, requested_by of every request as it stands."""
        latest = F.max_by(F.struct("status", "total_events", "requested_by"), "number").alias("s")
        states = self._table("states", STATES).groupBy("request").agg(latest)
        done = self._table("ledger", LEDGER).groupBy("request").agg(F.sum("events").alias("n"))
        joined = states.join(done, "request", "left")
        return joined.select(
            F.col("request").alias("id"), "s.status", "s.total_events", F.coalesce("n", F.lit(0)).alias("replayed_events"), "s.requested_by"
        )

    def emitted(self, request: str, layout: str) -> DataFrame:
        """Events of the committed chunks."""
        folders = [f"{self.path}/emitted/{request}/{r.chunk}" for r in self.ledger(request).select("chunk").collect()]
        if not folders:
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).parquet(*folders)

    def queued(self, request: str, as_of: Column | datetime) -> DataFrame:
        """QUEUED transitions of the events of the committed chunks."""
        ids = self.emitted(request, "id string")
        return status_rows(ids, "QUEUED", as_of, queued_at=instant(as_of))
