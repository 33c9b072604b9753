"""Physical plans the operators must keep: what reaches the scan, what is shuffled, what is broadcast."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from hookflow.operators import dedup, keyindex, lookups, metrics, reconcile, replay, transform
from hookflow.plans.tables import Tables
from hookflow.session import scratch_path

AS_OF = "2024-01-30 00:00:00"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


def test_time_filters_reach_the_scan(t):
    for df in (metrics.error_stats(t.env, AS_OF), metrics.throughput_by_source(t.env, AS_OF),
               replay.replay_preview(t.env, {"from": AS_OF})):
        assert "GreaterThanOrEqual(ts," in plan(df)


def test_only_needed_columns_are_read(t):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(metrics.throughput_by_source(t.env, AS_OF))).group(1)
    assert set(c.split(":")[0] for c in read.split(",")) == {"ts", "user_id"}


def test_top_k_does_not_sort_everything(t):
    for df in (lookups.events_by_status(t.env, "FAILED"), lookups.recent_errors(t.env)):
        assert "TakeOrderedAndProject" in plan(df)


def test_counts_are_pre_aggregated(t):
    text = plan(metrics.status_counts(t.env))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_mapping_is_one_narrow_stage(t):
    text = plan(transform.apply_mapping(t.env, t.transforms, AS_OF))
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


def test_first_row_per_key_uses_no_window(t):
    assert "Window" not in plan(dedup.append_events(t.env, t.stored))


def test_hot_keys_are_never_gathered(t):
    """With every key over the folding limit no row list is built for those keys."""
    one_key = t.env.withColumn("external_id", F.col("source"))
    sources = t.sources.withColumns({"dedup_field": F.lit("source"), "dedup_window": F.lit("1d")})
    keyed = dedup._keyed(dedup.one_per_id(dedup.numbered(one_key)), sources)
    text = plan(dedup._jump_large(keyed))
    assert "collect_list" not in text
    instants = keyed.groupBy(*dedup.KEY, "ttl", "at").agg(F.min(dedup.ROW).alias(dedup.ROW))
    assert "collect_list" not in plan(dedup._accepted_by_jumps(instants))
    pointers = plan(dedup._next_instants(instants))
    windows = [line for line in pointers.splitlines() if " Window " in line]
    assert windows and all("cell" in line for line in windows)


def shuffled_scans(text: str) -> list[str]:
    """Lines of scans that stand under an exchange with nothing but projections and filters between."""
    lines, found = text.splitlines(), []
    for i, line in enumerate(lines):
        if "FileScan" in line:
            above = next((x for x in reversed(lines[:i]) if not re.search("Project|Filter|ColumnarToRow|InputAdapter", x)), "")
            if "Exchange hashpartitioning" in above:
                found.append(line)
    return found


def test_a_short_reconciliation_does_not_shuffle_the_store(t, spark):
    external = spark.createDataFrame([("harbor", f"x{i}", "t", "{}") for i in range(50)], "source string, external_id string, event_type string, payload string")
    for df in (reconcile.reconcile_missing(external, t.stored), reconcile.reconcile_matched(external, t.stored), reconcile.reconcile_summary(external, t.stored)):
        text = plan(df)
        assert "BroadcastHashJoin" in text and not shuffled_scans(text)


def test_a_batch_reads_its_buckets_of_the_index_only(t, spark):
    index = keyindex.KeyIndex(spark, scratch_path(spark, "store"), buckets=16)
    index.add(t.stored, "load")
    assert len({r.bucket for r in index.read().select("bucket").distinct().collect()}) == 16
    batch = t.stored.limit(2)
    known = index.known(batch)
    text = plan(known)
    listed = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", text)
    assert listed and len(listed.group(1).split(",")) <= 4 and not shuffled_scans(text)
    assert known.filter("external_id is not null").distinct().count() == batch.select("source", "external_id").distinct().count()


def test_percentiles_collect_nothing(t):
    text = plan(metrics.latency_by_source(t.env, sample=None))
    assert "collect_list" not in text and "percentile" not in text


def test_no_query_needs_a_cross_join(t, spark):
    import __spark_entry__ as entry_points

    for name in ("route_fanout", "unrouted_events", "evaluate_alerts", "delivery_report", "rate_limit_breaches", "dlq_list"):
        text = plan(entry_points.queries()[name](spark, t.sf_dir))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_registered_checks_are_plain_json_friendly():
    import __spark_entry__ as entry_points

    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    json.dumps(entry_points.oracle_sql())
