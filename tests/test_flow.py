"""Routing, delivery, lifecycle, replay, reconcile, alert and configuration operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hookflow.operators import alerts, config, delivery, lifecycle, lookups, metrics, reconcile, replay, routing, transform
from hookflow.operators.ingest import rate_limit_breaches
from hookflow.operators.replay_run import ReplayRunner
from hookflow.session import scratch_path

T0 = datetime(2024, 1, 1)
ROUTE = (
    "id string, source string, event_type string, target_url string, target_name string, method string, timeout int,"
    " priority string, headers map<string,string>, active boolean, created_at timestamp"
)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def routes(table):
    def row(name, source, kind, priority, active=True, headers=None, second=0):
        return (name, source, kind, f"https://{name}", name, "POST", 5000, priority, headers, active, at(second))

    return table(
        [
            row("exact", "s", "a", "CRITICAL", headers={"X-K": "1", "Content-Type": "text/plain"}),
            row("low", "s", "a", "LOW"),
            row("any", "s", "*", "NORMAL"),
            row("any_newer", "s", "*", "NORMAL", second=9),
            row("off", "s", "a", "HIGH", active=False),
            row("other", "x", "b", "HIGH"),
        ],
        ROUTE,
    )


@pytest.fixture
def events(table):
    rows = [("1", "s", "a"), ("2", "s", "z"), ("3", "s", None), ("4", "x", "b"), ("5", "x", None), ("6", "u", "a"), ("7", "s", "*")]
    return table([(*r, '{"v":5}') for r in rows], "id string, source string, event_type string, payload string")


def test_fanout(events, routes):
    fan = routing.route_fanout(events, routes)
    got = {}
    for r in fan.orderBy("id", "priority_rank", F.desc("route_created_at")).collect():
        got.setdefault(r.id, []).append(r.route_id)
    wild = ["any_newer", "any"]
    assert got == {"1": ["exact", *wild, "low"], "2": wild, "3": wild, "4": ["other"], "7": wild}
    assert sorted(r.id for r in routing.unrouted_events(events, routes).collect()) == ["5", "6"]
    assert [r.id for r in routing.by_priority(routes).collect()] == ["exact", "off", "other", "any_newer", "any", "low"]


def test_small_routes_broadcast_and_large_ones_do_not(spark, events):
    from hookflow.plans.tables import Tables

    small = Tables(spark, "/root/testdata/sf0.001").routes
    plan = routing.route_fanout(events, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = routing.route_fanout(events, small)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mapping_choice_and_plan(table, events, routes):
    transforms = table(
        [("s", "a", {"n": "v | multiply(2)"}, True), ("s", "*", {"w": "@event_type"}, True), ("x", "b", {"n": None}, True),
         ("x", "*", {"w": "@id"}, False)],
        "source string, event_type string, mapping map<string,string>, active boolean",
    )
    out = {r.id: (r.transformed, r.has_transform) for r in transform.apply_mapping(events, transforms, T0).collect()}
    raw = '{"v":5}'
    assert out == {
        "1": ('{"n":10}', True), "2": ('{"w":"z"}', True), "3": ('{"w":"*"}', True), "4": (raw, True), "5": (raw, False),
        "6": (raw, False), "7": ('{"w":"*"}', True),
    }
    kinds = {r.id: r.transform_type for r in routing.resolve_transform(events, transforms).collect()}
    assert kinds == {"1": "a", "2": "*", "3": "*", "4": "b", "5": None, "6": None, "7": "*"}
    plan = routing.plan_deliveries(events, routes, transforms, T0)
    row = plan.filter("event_id = '1' and route_id = 'exact'").first()
    assert (row.body, row.headers) == ('{"n":10}', {"X-K": "1", "Content-Type": "text/plain"})
    assert plan.filter("route_id = 'low'").first().headers == {"Content-Type": "application/json"}
    pending = delivery.create_deliveries(plan, T0)
    outcome = pending.limit(1).select("id", F.lit("FAILED").alias("status"), F.repeat(F.lit("x"), 1500).alias("response_body"))
    recorded = delivery.append_deliveries(pending, outcome, at(5))
    done = recorded.filter("status = 'FAILED'").first()
    assert (len(done.response_body), done.completed_at) == (1003, at(5))
    assert recorded.filter("completed_at is not null").count() == 1


DELIVERY = (
    "id string, event_id string, route_id string, status string, response_code int, duration_ms int, attempts int,"
    " last_error string, created_at timestamp, completed_at timestamp"
)


def deliveries(table, rows):
    return table(
        [(str(i), e, f"r{i}", s, c, ms, n, err, T0, at(ms / 1000 if ms else 0)) for i, (e, s, c, ms, n, err) in enumerate(rows)],
        DELIVERY,
    )


def test_outcomes_and_final_status(table):
    rows = [
        ("ok", "DELIVERED", 200, 5, 1, None), ("ok", "DELIVERED", 200, 5, 1, None),
        ("bad", "DELIVERED", 200, 5, 1, None), ("bad", "FAILED", 500, 5, 1, "x"),
        ("dead", "FAILED", 500, 5, 2, "x"), ("dead", "FAILED", 500, 5, 3, "x"),
        ("fixed", "FAILED", 500, 5, 1, "x"), ("fixed", "DELIVERED", 200, 5, 2, None),
        ("open", "FAILED", 500, 5, 1, "x"), ("open", "PENDING", None, None, 1, None),
    ]
    outcome = delivery.delivery_outcome(deliveries(table, rows))
    texts = {(r.event_id, r.attempt): r.error for r in outcome.collect()}
    assert texts[("bad", 1)] == "1 of 2 deliveries failed" and texts[("ok", 1)] is None and ("open", 1) not in texts
    final = {r.event_id: (r.status, r.attempts) for r in delivery.final_status(outcome).collect()}
    assert final == {"ok": ("DELIVERED", 1), "bad": ("FAILED", 1), "dead": ("DEAD", 3), "fixed": ("DELIVERED", 2)}


@pytest.mark.parametrize("n", [1, 2, 20, 100])
def test_rank_rules(table, n):
    values = [i * 700 for i in range(n)]
    rows = deliveries(table, [("e", "DELIVERED", 200, v, 1, None) for v in values])
    report = delivery.delivery_report(rows).first()
    nearest = lambda p: values[max(0, -(-p * n // 100) - 1)]
    assert [report[c] for c in ("min_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")] == [nearest(p) for p in (0, 50, 95, 99, 100)]
    frame = table(
        [(str(i), "s", "DELIVERED", T0, T0 + timedelta(milliseconds=v)) for i, v in enumerate(values)],
        "id string, source string, status string, created_at timestamp, processed_at timestamp",
    )
    want = [values[min(n - 1, int(n * p))] for p in (0.5, 0.95, 0.99)]
    for sample in (1000, None):
        row = metrics.latency_by_source(frame, sample).first()
        assert [row.p50_ms, row.p95_ms, row.p99_ms] == want and row["count"] == n


def test_verdicts_and_error_keys(table):
    rows = [("e", "DELIVERED", 200, 10, 1, None)] * 99 + [("e", "FAILED", None, 10, 1, "ECONNRESET")]
    assert delivery.delivery_report(deliveries(table, rows)).first().verdict == "GOOD"
    assert delivery.delivery_report(deliveries(table, rows[:99])).first().verdict == "EXCELLENT"
    bad = [("e", "FAILED", 503, 10, 1, "HTTP 503"), ("e", "FAILED", None, 10, 1, None), rows[-1]]
    got = {r.error_key: r["count"] for r in delivery.delivery_errors(deliveries(table, bad)).collect()}
    assert got == {"HTTP_503": 1, "UNKNOWN_ERROR": 1, "ECONNRESET": 1}
    assert delivery.delivery_report(deliveries(table, [])).first().total == 0


STATE = "id string, source string, event_type string, status string, last_error string, created_at timestamp, queued_at timestamp, failed_at timestamp, processed_at timestamp, validation_status string"


def state(table, rows):
    full = [(r[0], r[1], "t", r[2], r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else T0, None, None, None, "VALID") for r in rows]
    return table(full, STATE)


def test_null_errors_sort_last(table):
    rows = [(str(i), "s", "DEAD", None) for i in range(5)] + [("8", "s", "DEAD", "b"), ("9", "s", "DEAD", "a")]
    got = [(r.error, r["count"]) for r in metrics.dlq_by_error(state(table, rows)).collect()]
    assert got == [("a", 1), ("b", 1), ("unknown", 5)]


def test_empty_tables(table):
    empty = state(table, [])
    assert metrics.error_stats(empty, T0).first().error_rate == 0
    assert metrics.metric_error_rate(empty, T0, 1000).first().value == 0
    assert metrics.metric_latency_p95(empty, T0, 1000).first().value == 0
    assert metrics.throughput_overview(empty, T0).first().total == 0


def test_windows_include_their_start(table):
    rows = state(table, [("1", "s", "DEAD", None, at(0)), ("2", "s", "DELIVERED", None, at(-0.001)), ("3", "s", "DELIVERED", None, at(900))])
    row = metrics.error_stats(rows, at(3600)).first()
    assert (row.total, row.failed, row.error_rate) == (2, 1, 50.0)


def test_stuck_events(table):
    rows = state(table, [("1", "s", "RECEIVED", None, at(0)), ("2", "s", "RECEIVED", None, at(1)), ("3", "s", "QUEUED", None, at(0))])
    assert [r.id for r in lookups.stuck_received(rows, at(61)).collect()] == ["1"]
    assert lookups.stuck_queued(rows, at(300)).count() == 0
    assert lookups.stuck_queued(rows, at(300.001)).count() == 1


def test_current_state_folds_transitions(table):
    events = table([("1", "RECEIVED"), ("2", "RECEIVED")], "id string, status string")
    log = table([], "event_id string, status string, at timestamp, attempts int, last_error string, queued_at timestamp, processed_at timestamp, failed_at timestamp")
    one = events.filter("id = '1'")
    log = lifecycle.append_status(log, one, "QUEUED", at(1), queued_at=at(1))
    log = lifecycle.append_status(log, one, "PROCESSING", at(1), attempts=1)
    log = lifecycle.append_status(log, one, "FAILED", at(2), last_error="boom", failed_at=at(2))
    log = lifecycle.append_status(log, one, "QUEUED", at(3), batch=True, queued_at=at(3))
    got = {r.id: r for r in lifecycle.current_state(events, log).collect()}
    row = got["1"]
    assert (row.status, row.attempts, row.last_error, row.queued_at, row.failed_at) == ("QUEUED", 1, "boom", at(3), at(2))
    assert (got["2"].status, got["2"].attempts) == ("RECEIVED", None)
    with pytest.raises(ValueError):
        lifecycle.append_status(log, one, "QUEUED", at(3), batch=True, attempts=2)
    with pytest.raises(ValueError):
        lifecycle.append_status(log, one, "LOST", at(3))


def test_discard(table):
    rows = state(table, [("1", "s", "DEAD"), ("2", "s", "FAILED")])
    ids = table([("1",), ("2",), ("9",)], "id string")
    assert [r.event_id for r in lifecycle.dlq_discard(rows, ids, T0).collect()] == ["1"]
    assert lifecycle.dlq_discard(rows, ids, T0, strict=False).count() == 2


def test_replay_resumes(table, spark):
    """Cancelled, failed and resumed: progress is kept, nothing is emitted twice, the counters follow the ledger."""
    layout = "id string, source string, event_type string, status string, created_at timestamp"
    rows = [(f"{i:03d}", "s", "t", "QUEUED" if i % 7 == 0 else "FAILED", T0 + timedelta(minutes=i // 3)) for i in range(60)]
    events = table(rows, layout)
    want = [r[0] for r in rows if r[3] == "FAILED"]
    runner = ReplayRunner(spark, scratch_path(spark, "replay"), 10)
    request = runner.submit(events, {"source": "s"}, T0, "me")
    assert runner.submit(events, {"source": "s"}, T0, "you") != request != runner.submit(events, {"source": "s"}, T0 + timedelta(1), "me")
    state = lambda: next((r.status, r.replayed_events, r.total_events) for r in runner.requests().collect() if r.id == request)
    assert state() == ("PENDING", 0, 60)
    asked = iter([False, True])
    assert runner.run(events, {"source": "s"}, request, T0, cancelled=lambda: next(asked)) == "CANCELLED"
    status, first, _ = state()
    assert status == "CANCELLED" and 0 < first < len(want)
    handed = []

    def each(chunk):
        handed.append(sorted(r.id for r in chunk.collect()))
        if len(handed) == 2:
            raise ConnectionError

    with pytest.raises(ConnectionError):
        runner.run(events, {"source": "s"}, request, T0, each=each)
    status, second, _ = state()
    assert status == "PENDING" and first < second < len(want)
    emitted = lambda: sorted(r.id for r in runner.emitted(request, "id string").collect())
    assert emitted() == want[:second]
    assert runner.run(events, {"source": "s"}, request, T0, each=each) == "COMPLETED"
    assert handed[1] == handed[2] and state() == ("COMPLETED", len(want), 60) and emitted() == want
    assert runner.run(events, {"source": "s"}, request, T0, each=each) == "COMPLETED" and emitted() == want
    assert sorted(r.event_id for r in runner.queued(request, T0).collect()) == want
    with pytest.raises(replay.NoEventsToReplayError):
        runner.submit(events, {"source": "none"}, T0)


def test_replay(table):
    rows = state(table, [("1", "s", "FAILED", None, at(0)), ("2", "s", "QUEUED", None, at(5)), ("3", "s", "DEAD", None, at(10)), ("4", "x", "DEAD", None, at(10))])
    window = {"source": "s", "from": at(0), "to": at(10)}
    assert [r.id for r in replay.replay_select(rows, window).collect()] == ["1", "2", "3"]
    assert [r.id for r in replay.replay_select(rows, {**window, "limit": 1, "offset": 1}).collect()] == ["2"]
    plan, queued, counters = replay.replay_execute(rows, window, T0, keep_event_type=False)
    assert sorted((r.id, r.event_type) for r in plan.collect()) == [("1", None), ("3", None)]
    assert sorted(r.event_id for r in queued.collect()) == ["1", "3"]
    assert counters.first()[:3] == (3, 2, "COMPLETED")
    _, queued, counters = replay.replay_execute(rows, window, T0, cancelled=True)
    assert queued.count() == 0 and counters.first()[:3] == (3, 0, "CANCELLED")
    assert replay.replay_request(rows, window, "me").first().total_events == 3
    with pytest.raises(replay.NoEventsToReplayError):
        replay.replay_request(rows, {"source": "none"})
    with pytest.raises(ValueError):
        replay.replay_select(rows, {"colour": "red"})
    progress = table([(3, 2), (0, 0), (200, 1)], "total_events bigint, replayed_events bigint")
    assert [r.progress for r in replay.replay_progress(progress).collect()] == [67, 0, 1]


def test_reconcile_partitions_the_input(table):
    layout = "source string, external_id string, event_type string, payload string, occurred_at timestamp"
    external = table([("s", "a", "t", "{}", at(1)), ("s", "b", "t", "{}", at(3)), ("s", "b", "t", "{}", at(2)), ("x", "a", "t", "{}", at(1))], layout)
    stored = table([("s", "a"), ("s", None)], "source string, external_id string")
    missing, matched = reconcile.reconcile_missing(external, stored), reconcile.reconcile_matched(external, stored)
    assert (missing.count(), matched.count()) == (3, 1)
    injected = reconcile.reconcile_inject(missing, T0).collect()
    assert sorted((r.source, r.external_id, r.occurred_at) for r in injected) == [("s", "b", at(2)), ("x", "a", at(1))]
    assert injected[0].headers == {"x-reconciled": "true"}
    got = {r.source: tuple(r)[1:] for r in reconcile.reconcile_summary(external, stored).collect()}
    assert got == {"s": (3, 1, 2, 2), "x": (1, 0, 1, 1)}


RULE = "id string, name string, metric string, threshold double, window string, cooldown string, active boolean"
HISTORY = "id string, alert_rule_id string, metric_value double, message string, fired_at timestamp"


def test_alerts(table):
    rows = state(table, [("1", "s", "DEAD"), ("2", "s", "QUEUED"), ("3", "s", "DEAD"), ("4", "s", "DELIVERED")])
    rules = table(
        [("inside", "in", "DLQ_SIZE", 1.0, "1m", "30m", True), ("edge", "ed", "DLQ_SIZE", 1.0, "1m", "30m", True),
         ("equal", "eq", "DLQ_SIZE", 2.0, "1m", "30m", True), ("rate", "ra", "ERROR_RATE", 10.5, "1h", "bad", True),
         ("off", "of", "DLQ_SIZE", 0.0, "1m", "1m", False)],
        RULE,
    )
    history = table([("h1", "inside", 1.0, "m", at(-1799)), ("h0", "inside", 1.0, "m", at(-9999)), ("h2", "edge", 1.0, "m", at(-1800))], HISTORY)
    out = alerts.evaluate_alerts(rows, rules, history, T0)
    got = {r.id: (r.value, r.fired, r.suppressed) for r in out.collect()}
    assert got == {"inside": (2.0, False, True), "edge": (2.0, True, False), "equal": (2.0, False, False), "rate": (50.0, True, False)}
    message = out.filter("id = 'rate'").first().message
    assert message == "[Alert] ra: ERROR_RATE = 50 (threshold: 10.5)"
    grown = alerts.append_alert_history(history, out)
    assert grown.count() == 5
    assert alerts.append_alert_history(grown, out).count() == 5


def test_alert_counts_come_from_one_scan(spark):
    from hookflow.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    rules = t.rules.filter("metric <> 'LATENCY_P95'")
    plan = alerts.metric_values(t.env, rules, T0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_configuration(table):
    schemas = table([("s", "t", 1, "{}", True, False), ("s", "t", 2, "{}", True, True), ("x", "t", 1, "{}", False, True)],
                    "source string, event_type string, version int, schema string, reject_on_fail boolean, active boolean")
    new = table([("s", "t", '{"type":"object"}'), ("n", "t", '{"type":"array"}')], "source string, event_type string, schema string")
    got = sorted((r.source, r.version, r.active) for r in config.publish_schema(schemas, new).collect())
    assert got == [("n", 1, True), ("s", 1, False), ("s", 2, False), ("s", 3, True), ("x", 1, True)]
    transforms = table([("s", "t", {"a": "b"}, False), ("x", "t", {"a": "b"}, True)], "source string, event_type string, mapping map<string,string>, active boolean")
    update = table([("s", "t", {"c": "d"})], "source string, event_type string, mapping map<string,string>")
    merged = {r.source: (r.mapping, r.active) for r in config.upsert_transforms(transforms, update).collect()}
    assert merged == {"s": ({"c": "d"}, True), "x": ({"a": "b"}, True)}


def test_rate_limits(table):
    rows = table([("s", at(i)) for i in (0, 1, 2, 60, 61)], "source string, created_at timestamp")
    sources = table([("s", 2, 60000)], "name string, rate_limit_max int, rate_limit_window int")
    got = rate_limit_breaches(rows, sources).collect()
    assert [(r.total, r.window_start_ms) for r in got] == [(3, int(T0.timestamp() * 1000))]

