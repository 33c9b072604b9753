"""Streams over split files, compared with their batch twins."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hookflow.operators import dedup
from hookflow.session import scratch_path
from hookflow.streaming import jobs

T0 = datetime(2024, 1, 1)
LAYOUT = "id string, source string, external_id string, status string, created_at timestamp"


@pytest.fixture
def folder(spark):
    return lambda label: scratch_path(spark, label)


def split_files(spark, rows, layout, path, files=3):
    """One file per slice, written in order, so that each is a micro-batch of its own."""
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], layout).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def drain(spark, df, path, mode="append"):
    query = df.writeStream.format("parquet").option("checkpointLocation", path + "-log").outputMode(mode)
    query.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def sample(n=200, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["a", "b", "c", None])
        rows.append((f"{i:04d}", rng.choice(["s", "open"]), key, rng.choice(["DEAD", "DELIVERED"]), T0 + timedelta(seconds=i * 7)))
    return rows


SOURCES = "name string, dedup_field string, dedup_window string"


@pytest.mark.parametrize("files", [1, 5])
def test_stream_dedup_equals_batch(spark, table, folder, files):
    rows = sample()
    sources = table([("s", "id", "60s"), ("open", None, None)], SOURCES)
    stream = split_files(spark, rows, LAYOUT, folder("in"), files)
    got = drain(spark, jobs.stream_dedup(stream, sources), folder("out"))
    want = dedup.dedup_ttl(table(rows, LAYOUT), sources)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_late_rows_are_held_against_windows_and_never_lost(spark, table, folder):
    """Five micro-batches; the later ones hold rows long before what was seen."""
    at = [1000, 1030, 5000, 10, 4990, 1059, 1060, 20, 900, 5059]
    keys = ["k", "k", "k", "new", "k", "k", "k", "new", "k", "k"]
    rows = [(str(i), "s", key, "DEAD", T0 + timedelta(seconds=t)) for i, (t, key) in enumerate(zip(at, keys, strict=True))]
    sources = table([("s", "id", "60s")], SOURCES)
    stream = split_files(spark, rows, LAYOUT, folder("in"), files=5)
    got = drain(spark, jobs.stream_dedup(stream, sources, late=timedelta(days=1)), folder("out"))
    # 1: inside 1000's window; 5: too, though 5000 came since; 7: inside 10's; 9: inside 5000's. 4 and 8 come before the windows near them.
    assert sorted(r.id for r in got.collect()) == ["0", "2", "3", "4", "6", "8"]
    short = drain(spark, jobs.stream_dedup(stream, sources, late=timedelta(0)), folder("out2"))
    # With no lateness only windows are known that the newest row has not passed, and what they do not cover is kept.
    assert {"0", "2", "4", "5", "6", "8"} <= {r.id for r in short.collect()} and "9" not in {r.id for r in short.collect()}


def test_state_holds_open_windows_only():
    import pandas as pd

    class State:
        def __init__(self):
            self.get, self.exists = None, False

        def update(self, value):
            self.get, self.exists = value, True

    rule, state = jobs._OpenWindows(0), State()
    frame = lambda *rows: pd.DataFrame([(f"{i}", k, at, 60, 0) for i, (k, at) in enumerate(rows)], columns=["id", "_key", "_at", "_ttl", "_bucket"])
    (out,) = rule((0,), iter([frame(("a", 0), ("a", 59), ("a", 60), ("b", 30)), frame()]), state)
    assert out["id"].tolist() == ["0", "3", "2"] and state.get == (["a", "b"], [60, 30], [120, 90], 60)
    assert not list(rule((0,), iter([frame(("a", 119))]), state)) and state.get == (["a"], [60], [120], 119)


def test_stream_dedup_keeps_maps(spark, table, folder):
    layout = "id string, source string, external_id string, headers map<string,string>, created_at timestamp"
    rows = [("1", "s", "k", {"a": "b"}, T0), ("2", "s", "k", {"a": "c"}, T0), ("3", "s", None, {"a": "d"}, T0)]
    sources = table([("s", "id", "60s")], "name string, dedup_field string, dedup_window string")
    stream = split_files(spark, rows, layout, folder("in"), files=1)
    got = drain(spark, jobs.stream_dedup(stream, sources), folder("out")).collect()
    assert {r.id: r.headers for r in got} == {"1": {"a": "b"}, "3": {"a": "d"}}


def test_rolling_windows_equal_batch(spark, table, folder):
    rows = sample()
    stream = split_files(spark, rows, LAYOUT, folder("in"))
    path = folder("out")
    live = drain(spark, jobs.rolling_throughput(stream, minutes=10, slide="5 minutes", late="0 seconds"), path)
    batch = jobs.rolling_throughput(table(rows, LAYOUT), minutes=10, slide="5 minutes")
    want = {tuple(r) for r in batch.collect()}
    got = {tuple(r) for r in live.collect()}
    last = rows[-1][4]
    assert got <= want and got >= {w for w in want if w[1] <= last - timedelta(minutes=10)}


def test_stream_ingest_is_idempotent(spark, table, folder):
    layout = "source string, payload string, received_at timestamp"
    body = '{{"type":"t","id":"{0}"}}'
    rows = [("s", body.format(i % 6), T0 + timedelta(minutes=i)) for i in range(20)] + [("s", "not json", T0)]
    sources = table([("s", "id", "5m")], "name string, dedup_field string, dedup_window string")
    schemas = table([], "source string, event_type string, version int, schema string, reject_on_fail boolean, active boolean")
    stream = split_files(spark, rows, layout, folder("in"))
    path = folder("stored")
    for run in ("one", "two"):  # a new checkpoint replays everything; nothing may be stored twice
        jobs.stream_ingest(stream, path, path + run, sources, schemas).awaitTermination()
    got = spark.read.parquet(path)
    assert sorted(r.external_id for r in got.collect()) == [str(i) for i in range(6)]
    assert got.select("event_type", "validation_status").distinct().first() == ("t", "NO_SCHEMA")
    assert "created_date" in got.columns


def test_a_repeated_batch_stores_nothing_twice(spark, table, folder, monkeypatch):
    """Run again after it was done, after its rows were stored but not indexed, and beside another batch with the same keys."""
    layout = "id string, source string, external_id string, created_at timestamp"
    rows = table([("1", "s", "a", T0), ("2", "s", "b", T0), ("3", "s", None, T0), ("2", "s", "b", T0)], layout)
    path = folder("store")
    stored = lambda: sorted((r.id, r.external_id) for r in spark.read.parquet(path).collect())
    want = [("1", "a"), ("2", "b"), ("3", None)]
    jobs.append_to_store(rows, path, "batch-x-0")
    assert stored() == want
    jobs.append_to_store(rows, path, "batch-x-0")
    assert stored() == want
    jobs.append_to_store(rows, path, "batch-y-0")
    assert stored() == want
    more = table([("4", "s", "a", T0), ("5", "s", "c", T0), ("1", "s", "d", T0)], layout)
    with monkeypatch.context() as lost:
        lost.setattr(jobs.KeyIndex, "add", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.append_to_store(more, path, "batch-x-1")
    assert stored() == sorted([*want, ("5", "c")], key=lambda r: r[0])
    jobs.append_to_store(more, path, "batch-x-1")
    assert stored() == sorted([*want, ("5", "c")], key=lambda r: r[0])
    index = jobs.KeyIndex(spark, path)
    before = {tuple(r) for r in index.read().collect()}
    index.rebuild(spark.read.parquet(path))
    assert {tuple(r) for r in index.read().collect()} == before


def test_stream_alerts_respect_cooldown(spark, table, folder):
    events = table([("1", "DEAD", "VALID", T0, None), ("2", "DEAD", "VALID", T0, None)],
                   "id string, status string, validation_status string, created_at timestamp, processed_at timestamp")
    rules = table([("r", "dead", "DLQ_SIZE", 1.0, "1m", "10m", True)],
                  "id string, name string, metric string, threshold double, window string, cooldown string, active boolean")
    ticks = split_files(spark, [(T0 + timedelta(minutes=m),) for m in (0, 5, 12)], "created_at timestamp", folder("ticks"))
    path = folder("history")
    job = jobs.stream_alerts(
        ticks, lambda: events, rules, path, path + "-log", clock=lambda batch: batch.select(F.max("created_at")).scalar()
    )
    job.awaitTermination()
    assert sorted(r.fired_at for r in spark.read.parquet(path).collect()) == [T0, T0 + timedelta(minutes=12)]


def test_reconcile_sources_isolate_failures(spark, table):
    stored = table([("s", "a")], "source string, external_id string")
    external = table([("a", "t", "{}", T0), ("b", "t", "{}", T0)], "external_id string, event_type string, payload string, occurred_at timestamp")
    injected = []

    def broken(start, end):
        raise RuntimeError("unreachable")

    summaries, failures = jobs.reconcile_sources(
        {"bad": broken, "s": lambda start, end: external}, lambda: stored, lambda df: injected.extend(df.collect()), T0
    )
    assert failures == {"bad": "unreachable"}
    row = summaries[0].first()
    assert (row.external_count, row.missing_count, row.period_start) == (2, 1, T0 - timedelta(minutes=30))
    assert [r.external_id for r in injected] == ["b"]
