"""Joins between events and configuration: routes, transforms, and the delivery plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.functions.scalars import priority_rank
from hookflow.model import WILDCARD
from hookflow.operators.ingest import event_id
from hookflow.operators.transform import apply_mapping
from hookflow.session import instant


def by_priority(routes: DataFrame) -> DataFrame:
    """Routes in declared priority order, newest first inside a priority."""
    return routes.orderBy(priority_rank(F.col("priority")), F.desc("created_at"), "id")


def route_fanout(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Each event with every active route of its source for its exact type or the wildcard.

    An event is looked up under its type and under ``*``, which makes the join a plain
    equality on (source, type): hashable, broadcast by the planner while the routes are
    small and shuffled otherwise. An event without a type meets wildcard routes only.
    """
    active = routes.filter("active").select(
        "source",
        F.col("event_type").alias("_lookup"),
        F.col("id").alias("route_id"),
        "target_url",
        "target_name",
        "method",
        "timeout",
        "priority",
        priority_rank(F.col("priority")).alias("priority_rank"),
        F.col("headers").alias("route_headers"),
        F.col("created_at").alias("route_created_at"),
    )
    kind = F.coalesce("event_type", F.lit(WILDCARD))
    keys = F.array_distinct(F.array(kind, F.lit(WILDCARD)))
    return events.withColumn("_lookup", F.explode(keys)).join(active, ["source", "_lookup"]).drop("_lookup")


def unrouted_events(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events that match no route; they are final as DELIVERED."""
    active = routes.filter("active")
    open_sources = active.filter(F.col("event_type") == WILDCARD).select("source").distinct()
    exact = active.select("source", "event_type").distinct()
    left = events.join(open_sources, "source", "left_anti").join(exact, ["source", "event_type"], "left_anti")
    return left.withColumn("status", F.lit("DELIVERED"))


def resolve_transform(events: DataFrame, transforms: DataFrame) -> DataFrame:
    """Attach ``transform_type`` (exact type, ``*`` or null) and ``mapping`` of the active transform."""
    active = transforms.filter("active")
    exact = active.filter(F.col("event_type") != WILDCARD).select(
        "source", "event_type", F.col("mapping").alias("_exact")
    )
    wild = active.filter(F.col("event_type") == WILDCARD).select("source", F.col("mapping").alias("_wild"))
    joined = events.join(exact, ["source", "event_type"], "left").join(wild, "source", "left")
    kind = F.when(F.col("_exact").isNotNull(), F.col("event_type")).when(
        F.col("_wild").isNotNull(), F.lit(WILDCARD)
    )
    return joined.withColumns({"transform_type": kind, "mapping": F.coalesce("_exact", "_wild")}).drop(
        "_exact", "_wild"
    )


def event_deliveries(events: DataFrame, deliveries: DataFrame, routes: DataFrame) -> DataFrame:
    """Events with their delivery attempts and the route of each attempt."""
    attempts = deliveries.select(
        F.col("id").alias("delivery_id"),
        F.col("event_id").alias("id"),
        "route_id",
        F.col("status").alias("delivery_status"),
        "response_code",
        "duration_ms",
    )
    targets = routes.select(F.col("id").alias("route_id"), "target_name", "target_url")
    return events.join(attempts, "id").join(targets, "route_id")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str, deleted_key: str = "id") -> DataFrame:
    """Child rows whose parent was not deleted."""
    return child.join(deleted.select(F.col(deleted_key).alias(key)), key, "left_anti")


def delivery_headers(route_headers: Column) -> Column:
    """JSON content type, overridden by a route header of exactly that name."""
    base = F.create_map(F.lit("Content-Type"), F.lit("application/json"))
    own = F.coalesce(route_headers, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda key, _: ~F.array_contains(F.map_keys(own), key)), own)


def plan_deliveries(
    events: DataFrame, routes: DataFrame, transforms: DataFrame, as_of: Column | datetime
) -> DataFrame:
    """Delivery intents: one row per event and route with the reshaped body.

    The body is computed per event, before the fan-out multiplies rows.
    """
    shaped = apply_mapping(events, transforms, as_of)
    return route_fanout(shaped, routes).select(
        event_id(F.col("id"), F.col("route_id")).alias("delivery_id"),
        F.col("id").alias("event_id"),
        "route_id",
        "method",
        F.col("target_url").alias("url"),
        delivery_headers(F.col("route_headers")).alias("headers"),
        F.col("transformed").alias("body"),
        "timeout",
        "priority",
        "priority_rank",
        F.lit("PENDING").alias("status"),
        instant(as_of).alias("created_at"),
    )
