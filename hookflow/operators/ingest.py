"""From raw deliveries to event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.functions import jsonvalue as J
from hookflow.functions.scalars import bind, parse_window
from hookflow.model import WILDCARD
from hookflow.operators.config import Dispatch, rules_in_use
from hookflow.operators.dedup import ROW, numbered, ttl_repeats
from hookflow.operators.validation import is_rejected, validate_events

TYPE_FIELDS = ("type", "event", "event_type")
MAX_SOURCE_LENGTH = 100


def detect_event_type(payload: Column, explicit: Column | None = None) -> Column:
    """Explicit type, else the first string-typed of ``type``, ``event``, ``event_type``."""
    found = [explicit] if explicit is not None else []
    for name in TYPE_FIELDS:
        value = J.field(payload, name)
        found.append(F.when(J.is_kind(payload, "object") & J.is_kind(value, "string"), J.as_string(value)))
    return F.coalesce(*found)


def extract_external_id(payload: Column, path: str) -> Column:
    """Value at a dot path as text; missing, null and empty text give null (no deduplication)."""
    value = J.field(payload, path)
    return F.nullif(F.when(~J.is_nullish(value), J.text(value)), F.lit(""))


def source_config(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach per-source settings; an unknown source gets nulls, which means no deduplication.

    The size of ``sources`` is left to the planner: it broadcasts below its own
    threshold and shuffles otherwise.
    """
    settings = sources.select(
        F.col("name").alias("source"),
        "dedup_field",
        "dedup_window",
        F.when(F.nullif("dedup_field", F.lit("")).isNotNull(), parse_window(F.coalesce("dedup_window", F.lit("72h"))))
        .alias("dedup_seconds"),
        "rate_limit_max",
        "rate_limit_window",
    )
    return events.join(settings, "source", "left")


def external_id_by_source(events: DataFrame, sources: DataFrame, payload: Column) -> Column:
    """External id of each row by the path its source configures, as one projection (no join)."""
    fields = sources.filter(F.nullif("dedup_field", F.lit("")).isNotNull())
    dispatch = Dispatch()
    for row in rules_in_use(fields.select(F.col("name").alias("source"), F.lit(WILDCARD).alias("event_type"), "dedup_field"), events, [WILDCARD]):
        dispatch.add(row.source, None, row.dedup_field)
    number = dispatch.number(F.col("source"), F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    return bind(F.coalesce(number, F.lit(-1)), lambda n: dispatch.pick(n, lambda path: extract_external_id(payload, path), none))


def event_id(*parts: Column) -> Column:
    """Deterministic id, so that a retried task writes the same row again."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def ingest_outcomes(raw: DataFrame, sources: DataFrame, schemas: DataFrame, parity: bool = False) -> DataFrame:
    """One row per raw delivery (source, payload, headers, received_at and optionally id, event_type): the event and its ``outcome``.

    accepted; duplicate (repeats an id, or a key inside its window); rejected, with ``validation_errors``; unreadable
    (the payload is null or no JSON); bad_source (null, empty or over 100 characters). By default a payload is validated before
    it may claim its deduplication key; ``parity=True`` deduplicates first, so that a rejected payload blocks its
    corrected retry. The envelope is parsed and validated once and written; decisions read narrow columns of it.
    """
    explicit = F.col("event_type") if "event_type" in raw.columns else None
    headers = F.col("headers") if "headers" in raw.columns else F.create_map().cast("map<string,string>")
    # The explode of one element parses once; an expression on the parsed value would be
    # merged with others and parse again.
    typed = raw.withColumn("_body", F.explode(F.array(J.parse(F.col("payload")))))
    made_id = F.col("id") if "id" in raw.columns else event_id(
        F.col("source"), F.unix_micros("received_at").cast("string"), F.col("payload")
    )
    sourced = F.coalesce(F.length("source").between(1, MAX_SOURCE_LENGTH), F.lit(False))
    refused = F.when(~sourced, F.lit("bad_source")).when(F.col("_body").isNull(), F.lit("unreadable"))
    rows = typed.select(
        made_id.alias("id"),
        external_id_by_source(raw, sources, F.col("_body")).alias("external_id"),
        "source",
        detect_event_type(F.col("_body"), explicit).alias("event_type"),
        "payload",
        headers.alias("headers"),
        F.try_element_at(headers, F.lit("x-webhook-signature")).alias("signature"),
        F.lit("RECEIVED").alias("status"),
        F.lit(0).alias("attempts"),
        F.col("received_at").alias("created_at"),
        refused.alias("_refused"),
        "_body",
    )
    checked = validate_events(rows, schemas)
    unread = F.col("_refused").isNotNull()
    for name in ("validation_status", "validation_errors"):
        checked = checked.withColumn(name, F.when(~unread, F.col(name)))
    envelope = numbered(checked.withColumn("_rejected", ~unread & F.coalesce(is_rejected(), F.lit(False))).drop("reject_on_fail"))
    candidates = envelope.filter("_refused is null") if parity else envelope.filter("_refused is null and not _rejected")
    repeats = ttl_repeats(candidates, sources).withColumn("_repeat", F.lit("duplicate"))
    outcome = F.coalesce("_refused", "_repeat", F.when(F.col("_rejected"), F.lit("rejected")), F.lit("accepted"))
    judged = envelope.join(repeats, ROW, "left").withColumn("outcome", outcome)
    return judged.drop(ROW, "_refused", "_rejected", "_repeat")


def ingest_events(raw: DataFrame, sources: DataFrame, schemas: DataFrame, parity: bool = False) -> DataFrame:
    """The accepted events of ``ingest_outcomes``."""
    return ingest_outcomes(raw, sources, schemas, parity).filter("outcome = 'accepted'").drop("outcome")


def rate_limit_breaches(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Windows in which a source sent more events than its configured limit."""
    limits = sources.filter("rate_limit_max is not null and rate_limit_window > 0").select(
        F.col("name").alias("source"), F.col("rate_limit_window").cast("bigint").alias("_width"), "rate_limit_max"
    )
    start = F.floor(F.unix_millis("created_at") / F.col("_width")) * F.col("_width")
    counted = (
        events.join(limits, "source")
        .groupBy("source", start.alias("window_start_ms"), "rate_limit_max")
        .agg(F.count(F.lit(1)).alias("total"))
    )
    return counted.filter(F.col("total") > F.col("rate_limit_max"))
