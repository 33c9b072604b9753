"""Payload validation against versioned schemas, and reports over the stored errors."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J
from hookflow.functions.schema_rules import ERROR_TYPE, schema_errors, unsupported
from hookflow.operators.config import Dispatch, rules_in_use
from hookflow.session import instant

UNSUPPORTED = {"path": "/", "message": "schema is not supported", "keyword": "$schema"}


def active_schemas(schemas: DataFrame) -> DataFrame:
    """The active schema of the highest version per (source, event_type)."""
    latest = F.max_by(F.struct("version", "schema", "reject_on_fail"), "version").alias("_s")
    return (
        schemas.filter("active")
        .groupBy("source", "event_type")
        .agg(latest)
        .select("source", "event_type", "_s.version", "_s.schema", "_s.reject_on_fail")
    )


def resolve_schema(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """Attach ``schema_version``, ``schema`` and ``reject_on_fail``; exact type only, no wildcard."""
    config = active_schemas(schemas).withColumnRenamed("version", "schema_version")
    return events.join(config, ["source", "event_type"], "left")


def errors_json(errors: Column) -> Column:
    """Stored form of an error array: JSON text, null when there is no error."""
    shaped = F.transform(
        errors,
        lambda e: F.struct(
            e["path"].alias("path"),
            e["message"].alias("message"),
            e["keyword"].alias("keyword"),
            F.parse_json(e["params"]).alias("params"),
        ),
    )
    return F.when(F.size(errors) > 0, F.to_json(shaped))


def validate_events(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``validation_status``, ``validation_errors`` and ``reject_on_fail``.

    The schemas in force are compiled into one projection, equal ones once, so validation reads each
    event once and shuffles nothing. A parsed payload in ``_body`` is used as it is. A schema that cannot be compiled touches only
    the events it is for: they are INVALID with one error that says so, and are not rejected.
    """
    in_force: dict[tuple[str, str], Row] = {}
    for row in rules_in_use(schemas.filter("active"), events):
        key = (row.source, row.event_type)
        if key not in in_force or row.version > in_force[key].version:
            in_force[key] = row
    dispatch = Dispatch()
    for (source, kind), row in in_force.items():
        dispatch.add(source, kind, (row.schema, bool(row.reject_on_fail)))
    broken = {text: reason for text, _ in dispatch.numbers if (reason := unsupported(text))}

    def compiled(rule: tuple[str, bool]) -> Column:
        text, _ = rule
        if text not in broken:
            return schema_errors(json.loads(text), F.col("_body"))
        return F.from_json(F.lit(json.dumps([{**UNSUPPORTED, "params": json.dumps({"reason": broken[text]})}])), ERROR_TYPE)

    rejecting = [n for (text, reject), n in dispatch.numbers.items() if reject and text not in broken]
    kind = F.col("event_type")
    none = F.lit(None).cast(ERROR_TYPE)
    # The explode of one element keeps the rule columns in one place: a filter on the
    # status is not pushed below it, which would evaluate every rule a second time.
    parsed = events if "_body" in events.columns else events.withColumn("_body", J.parse(F.col("payload")))
    number = dispatch.number(F.col("source"), kind)
    found = F.explode(F.array(F.struct(dispatch.pick(F.col("_rule"), compiled, none).alias("errors"))))
    checked = parsed.withColumn("_rule", number).withColumn("_checked", found).withColumn("_errors", F.col("_checked.errors"))
    status = (
        F.when(kind.isNull() | (kind == ""), F.lit("SKIPPED"))
        .when(F.col("_errors").isNull(), F.lit("NO_SCHEMA"))
        .when(F.size("_errors") > 0, F.lit("INVALID"))
        .otherwise(F.lit("VALID"))
    )
    return checked.withColumns(
        {
            "validation_status": status,
            "validation_errors": errors_json(F.col("_errors")),
            "reject_on_fail": F.coalesce(F.col("_rule").isin(rejecting), F.lit(False)),
        }
    ).drop("_body", "_rule", "_checked", "_errors")


def validation_errors(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per violation: id, path, message, keyword, params (JSON text)."""
    shape = "array<struct<path:string,message:string,keyword:string,params:variant>>"
    found = validate_events(events, schemas).filter("validation_status = 'INVALID'")
    exploded = found.select("id", F.explode(F.from_json("validation_errors", shape)).alias("e"))
    return exploded.select("id", "e.path", "e.message", "e.keyword", F.to_json("e.params").alias("params"))


def is_rejected() -> Column:
    """INVALID rows whose schema says to reject."""
    return (F.col("validation_status") == "INVALID") & F.coalesce("reject_on_fail", F.lit(False))


def reject_split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected are INVALID rows whose schema says to reject."""
    rejected = is_rejected()
    return validated.filter(~rejected), validated.filter(rejected)


def drift_report(validated: DataFrame, as_of: Column | datetime, minutes: int = 60) -> DataFrame:
    """INVALID counts of the window by source, type, keyword and path."""
    recent = validated.filter(
        (F.col("validation_status") == "INVALID")
        & (F.col("created_at") >= instant(as_of) - F.make_dt_interval(mins=F.lit(minutes)))
    )
    errors = F.from_json("validation_errors", "array<struct<path:string,keyword:string>>")
    return (
        recent.select("source", "event_type", F.explode(errors).alias("e"))
        .groupBy("source", "event_type", F.col("e.keyword").alias("keyword"), F.col("e.path").alias("path"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )
