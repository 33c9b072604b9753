from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hookflow.operators import dedup, ingest

START = datetime(2024, 1, 1)
EVENT = "id string, source string, external_id string, created_at timestamp"
SOURCE = "name string, dedup_field string, dedup_window string"


def events(table, times, key="k", source="s"):
    return table([(f"{i:06d}", source, key, START + timedelta(seconds=t)) for i, t in enumerate(times)], EVENT)


def greedy(rows, ttl):
    """Reference fold over (time, id) pairs of one key."""
    kept, until = [], None
    for at, name in sorted(rows):
        if until is None or at >= until:
            kept.append(name)
            until = at + timedelta(seconds=ttl)
    return kept


@pytest.mark.parametrize("limit", [4096, 1])
def test_window_counts_from_the_accepted_row(table, limit):
    rows = events(table, [0, 50, 90, 110, 150, 200, 215])
    sources = table([("s", "id", "100s")], SOURCE)
    kept = dedup.dedup_ttl(rows, sources, fold_limit=limit).orderBy("created_at").collect()
    assert [(r.created_at - START).seconds for r in kept] == [0, 110, 215]


@pytest.mark.parametrize("limit", [4096, 20])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_paths_equal_the_fold(table, limit, seed):
    rng = random.Random(seed)
    rows = []
    for key, size in (("hot", 600), ("warm", 30), ("cold", 5)):
        for i in range(size):
            at = START + timedelta(milliseconds=rng.randrange(0, 400_000, rng.choice([1, 250, 1000])))
            rows.append((f"{key}-{i:04d}", "s", key, at))
    rows.append(("none", "s", None, START))
    frame = table(rows, EVENT)
    sources = table([("s", "id", f"{rng.choice([1, 7, 60])}s")], SOURCE)
    ttl = int(sources.first().dedup_window[:-1])
    want = {"none"}
    for key in ("hot", "warm", "cold"):
        want.update(greedy([(r[3], r[0]) for r in rows if r[2] == key], ttl))
    assert {r.id for r in dedup.dedup_ttl(frame, sources, fold_limit=limit).collect()} == want


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("block", "chained"), [(7, 1 << 20), (64, 1 << 20), (1 << 17, 1 << 20), (7, 0)])
def test_time_blocks_equal_the_fold(table, monkeypatch, seed, block, chained):
    """Dense and sparse keys, windows longer and shorter than blocks, and the way by pointers alone."""
    monkeypatch.setattr(dedup, "BLOCK_INSTANTS", block)
    monkeypatch.setattr(dedup, "MAX_CHAINED", chained)
    rng = random.Random(seed)
    rows = []
    for key, size, span in (("dense", 900, 900), ("sparse", 300, 90_000), ("bursts", 300, 20_000)):
        for i in range(size):
            at = rng.randrange(span) if key != "bursts" else rng.randrange(8) * 2500 + rng.randrange(40)
            rows.append((f"{key}-{i:04d}", "s", key, START + timedelta(seconds=at)))
    ttl = rng.choice([1, 10, 300, 5000])
    sources = table([("s", "id", f"{ttl}s")], SOURCE)
    want = set()
    for key in ("dense", "sparse", "bursts"):
        want.update(greedy([(r[3], r[0]) for r in rows if r[2] == key], ttl))
    assert {r.id for r in dedup.dedup_ttl(table(rows, EVENT), sources, fold_limit=2).collect()} == want
    labels = dedup.dedup_hot_cold(table(rows, EVENT), table([], EVENT), sources, fold_limit=2).collect()
    assert {r.id for r in labels if r.outcome != "duplicate_hot"} == want
    assert sum(r.outcome == "accepted" for r in labels) == 3


def test_ways_through_a_block():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        at = np.unique(rng.integers(0, 200, size=rng.integers(1, 60)))
        ttl = int(rng.integers(1, 80))
        entries, exits = dedup._ways(at, ttl)
        for due in range(int(at[0]) - 3, int(at[0]) + ttl):
            last, until = None, due
            for instant in at:
                if instant >= until:
                    last, until = instant, instant + ttl
            way = np.searchsorted(entries, due)
            assert (way == len(entries)) == (last is None)
            assert last is None or exits[way] == until


def test_repeated_ids_and_rows_without_one(table):
    """A record delivered twice, and rows without id or source, on the way by row numbers."""
    at = [START + timedelta(seconds=t) for t in (0, 5, 20, 40)]
    rows = table(
        [("a", "s", "k", at[1]), ("a", "s", "k", at[0]), ("b", "s", "k", at[2]), (None, "s", "k", at[3]), (None, "s", "k", at[3]),
         ("c", None, "k", at[0]), ("c", None, "k", at[0])],
        EVENT,
    )
    sources = table([("s", "id", "10s")], SOURCE)
    kept = dedup.dedup_ttl(rows, sources).collect()
    assert sorted((r.id or "", r.source or "", (r.created_at - START).seconds) for r in kept) == [
        ("", "s", 40), ("a", "s", 0), ("b", "s", 20), ("c", "", 0), ("c", "", 0),
    ]


def test_sources_without_dedup_pass(table):
    rows = events(table, [0, 1], source="open").unionByName(events(table, [0, 1], source="unknown"))
    sources = table([("open", None, "72h")], SOURCE)
    assert dedup.dedup_ttl(rows, sources).count() == 4


def test_hot_and_cold_tiers(table):
    rows = table(
        [("a", "s", "k", START), ("b", "s", "k", START + timedelta(seconds=5)), ("c", "s", "k", START + timedelta(seconds=20)),
         ("d", "s", "old", START), ("e", "s", None, START), ("f", "x", "k", START)],
        EVENT,
    )
    stored = table([("z", "s", "old", START)], EVENT)
    sources = table([("s", "id", "10s")], SOURCE)
    got = {r.id: r.outcome for r in dedup.dedup_hot_cold(rows, stored, sources).collect()}
    assert got == {
        "a": "accepted", "b": "duplicate_hot", "c": "duplicate_cold", "d": "duplicate_cold", "e": "accepted", "f": "accepted",
    }


def test_append_is_idempotent_and_first_wins(table):
    rows = table(
        [("a", "s", "k", START + timedelta(seconds=1)), ("b", "s", "k", START), ("c", "s", None, START), ("d", "s", None, START),
         ("c", "s", None, START)],
        EVENT,
    )
    empty = rows.limit(0)
    once = dedup.append_events(rows, empty)
    assert sorted(r.id for r in once.collect()) == ["b", "c", "d"]
    assert dedup.append_events(rows, once).count() == 0


def test_source_settings(table):
    rows = events(table, [0]).unionByName(events(table, [0], source="odd")).unionByName(events(table, [0], source="none"))
    sources = table(
        [("s", "id", "2h", 1, 1000), ("odd", "id", "soon", 1, 1000)],
        "name string, dedup_field string, dedup_window string, rate_limit_max int, rate_limit_window int",
    )
    got = {r.source: r.dedup_seconds for r in ingest.source_config(rows, sources).collect()}
    assert got == {"s": 7200, "odd": 259200, "none": None}


def test_type_detection(spark):
    from hookflow.functions import jsonvalue as J

    cases = {
        '{"type":"a","event":"b"}': "a", '{"type":1,"event":"b"}': "b", '{"event_type":"c"}': "c", '{"type":""}': "",
        '[{"type":"a"}]': None, '"type"': None, '{"type":null}': None, "7": None,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.t for r in df.select("p", ingest.detect_event_type(J.parse(F.col("p"))).alias("t")).collect()}
    assert got == cases


def test_external_id_text(spark):
    from hookflow.functions import jsonvalue as J

    cases = {
        '{"d":{"id":"x"}}': "x", '{"d":{"id":0}}': "0", '{"d":{"id":false}}': "false", '{"d":{"id":""}}': None,
        '{"d":{"id":null}}': None, '{"d":5}': None, '{"d":{"id":1.50}}': "1.5", '{"d":{"id":[1,2]}}': "1,2",
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.t for r in df.select("p", ingest.extract_external_id(J.parse(F.col("p")), "d.id").alias("t")).collect()}
    assert got == cases


def test_rejected_payload_and_its_retry(table):
    """A rejected payload must not block its corrected retry, unless the service's own order is asked for."""
    bad, good = '{"type":"t","id":"k"}', '{"type":"t","id":"k","n":1}'
    raw = table(
        [("1", "s", bad, START), ("2", "s", good, START + timedelta(seconds=1)), ("3", "s", "{broken", START)],
        "id string, source string, payload string, received_at timestamp",
    )
    sources = table([("s", "id", "1h")], SOURCE)
    schemas = table(
        [("s", "t", 1, '{"required":["n"]}', True, True)],
        "source string, event_type string, version int, schema string, reject_on_fail boolean, active boolean",
    )
    assert [r.id for r in ingest.ingest_events(raw, sources, schemas).collect()] == ["2"]
    assert ingest.ingest_events(raw, sources, schemas, parity=True).count() == 0


@pytest.mark.parametrize("limit", [4096, 1])
def test_repeated_ids_keep_one_row_on_both_paths(table, limit):
    rng = random.Random(7)
    once = [(f"{i:03d}", "s", rng.choice(["hot", "hot", "b"]), START + timedelta(seconds=rng.randrange(300))) for i in range(120)]
    once += [("none", "s", None, START), ("open", "unknown", "k", START)]
    again = [(i, s, k, at + timedelta(seconds=rng.choice([0, 0, 1, 500]))) for i, s, k, at in once]
    sources = table([("s", "id", "20s")], SOURCE)
    want = {"none", "open"}
    for key in ("hot", "b"):
        want.update(greedy([(r[3], r[0]) for r in once if r[2] == key], 20))
    rows = table(once + again + once, EVENT)
    assert sorted(r.id for r in dedup.dedup_ttl(rows, sources, fold_limit=limit).collect()) == sorted(want)
    labels = dedup.dedup_hot_cold(rows, table([], EVENT), sources, fold_limit=limit).collect()
    assert len(labels) == 3 * len(once)
    accepted = [r.id for r in labels if r.outcome == "accepted"]
    assert len(accepted) == len(set(accepted)) and {"none", "open"} <= set(accepted)
    assert sum(r.outcome == "duplicate_id" for r in labels) == 2 * len(once)


@pytest.mark.parametrize("parity", [False, True])
def test_every_delivery_has_an_outcome(table, parity):
    good, bad = '{"type":"t","id":"k","n":1}', '{"type":"t","id":"j"}'
    raw = table(
        [("s", good, START), ("s", good, START), ("s", good, START + timedelta(seconds=1)), ("s", bad, START), ("s", "{broken", START),
         ("s", None, START), ("x" * 101, good, START), ("", good, START), (None, good, START), ("other", "7", START)],
        "source string, payload string, received_at timestamp",
    )
    sources = table([("s", "id", "1h")], SOURCE)
    schemas = table(
        [("s", "t", 1, '{"required":["n"]}', True, True)],
        "source string, event_type string, version int, schema string, reject_on_fail boolean, active boolean",
    )
    got = ingest.ingest_outcomes(raw, sources, schemas, parity).collect()
    counts = {name: sum(r.outcome == name for r in got) for name in {r.outcome for r in got}}
    assert counts == {"accepted": 2, "duplicate": 2, "rejected": 1, "unreadable": 2, "bad_source": 3}
    assert all((r.validation_errors is not None) == (r.outcome == "rejected") for r in got)
