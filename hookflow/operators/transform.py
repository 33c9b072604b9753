"""Payload reshaping with the field-mapping language."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J
from hookflow.functions.mapping import Context, compile_mapping
from hookflow.model import WILDCARD
from hookflow.operators.config import Dispatch, rules_in_use
from hookflow.session import instant


def apply_mapping(events: DataFrame, transforms: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Add ``transformed`` and ``has_transform``.

    The exact mapping of the type wins over the wildcard of the source. Without a
    mapping, or with one that cannot be evaluated, the raw payload stands. Mappings are
    compiled into one projection, equal ones once; events are neither joined nor shuffled.
    """
    context = Context(F.col("id"), F.col("source"), F.col("event_type"), instant(as_of))
    dispatch = Dispatch()
    for row in rules_in_use(transforms.filter("active"), events, [WILDCARD]):
        rule = tuple((row.mapping or {}).items())
        dispatch.add(row.source, None if row.event_type == WILDCARD else row.event_type, rule)

    def compiled(rule: tuple) -> Column:
        output = compile_mapping(dict(rule), F.col("_body"), context)
        return F.lit(None).cast("string") if output is None else output

    number = F.col("_rule")
    output = dispatch.pick(number, compiled, F.lit(None).cast("string"))
    ruled = events.withColumns({"_body": J.parse(F.col("payload")), "_rule": dispatch.number(F.col("source"), F.col("event_type"))})
    shaped = ruled.withColumns({"transformed": F.coalesce(output, F.col("payload")), "has_transform": number.isNotNull()})
    return shaped.drop("_body", "_rule")


def transform_preview(events: DataFrame, transforms: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Original and reshaped payload side by side, nothing stored."""
    return apply_mapping(events, transforms, as_of).select(
        "id", F.col("payload").alias("original"), "transformed", "has_transform"
    )
