"""Work sets and alert metrics take every row."""

from __future__ import annotations

from datetime import datetime, timedelta

from hookflow.operators import lookups, metrics

NOW = datetime(2024, 1, 2)


def test_every_row_counts(table):
    ago = lambda **t: NOW - timedelta(**t)
    rows = [(f"r{i}", "RECEIVED", ago(minutes=9), None, None) for i in range(150)]
    rows += [(f"y{i}", "QUEUED", ago(hours=9), ago(minutes=1), None) for i in range(100)] + [(f"q{i}", "QUEUED", ago(hours=1), None, None) for i in range(120)]
    rows += [(f"d{i}", "DELIVERED", ago(minutes=40), None, ago(minutes=40) + timedelta(milliseconds=i)) for i in range(1000)]
    events = table(rows, "id string, status string, created_at timestamp, queued_at timestamp, processed_at timestamp")
    assert lookups.stuck_received(events, NOW).count() == 150
    assert {r["id"] for r in lookups.stuck_queued(events, NOW).collect()} == {f"q{i}" for i in range(120)}
    assert metrics.metric_latency_p95(events, NOW, 3_600_000).first()["value"] == 950.0
    assert metrics.metric_latency_p95(events.limit(0), NOW, 3_600_000).first()["value"] == 0.0


def test_pages_have_an_unlimited_form(table):
    at = NOW - timedelta(hours=1)
    events = table([(f"e{i:03d}", "s", "t", "DEAD", "x", at, at) for i in range(250)],
                   "id string, source string, event_type string, status string, last_error string, created_at timestamp, failed_at timestamp")
    assert (lookups.events_by_status(events, "DEAD").count(), lookups.events_by_status(events, "DEAD", None).count()) == (100, 250)
    assert (lookups.dlq_list(events).count(), lookups.dlq_list(events, limit=200).count(), lookups.dlq_list(events, limit=None).count()) == (50, 200, 250)
    deliveries = table([(f"d{i}", "r", "PENDING", at) for i in range(150)], "id string, route_id string, status string, created_at timestamp")
    assert (lookups.deliveries_by_route(deliveries, "r").count(), lookups.deliveries_by_route(deliveries, "r", None).count()) == (100, 150)
    assert (lookups.pending_deliveries(deliveries).count(), lookups.pending_deliveries(deliveries, None).count()) == (100, 150)
    assert [r.id for r in lookups.oldest_page(events, 2, 3).collect()] == ["e003", "e004"]
    errors = table([(f"{i}", "DEAD", f"m{i}") for i in range(30)], "id string, status string, last_error string")
    assert (metrics.dlq_by_error(errors).count(), metrics.dlq_by_error(errors, None).count()) == (10, 30)
