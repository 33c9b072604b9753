"""Table layouts. Payloads are JSON text at rest; VARIANT only exists inside a query."""

from __future__ import annotations

# Lifecycle and enum members.
EVENT_STATUSES = ("RECEIVED", "QUEUED", "PROCESSING", "DELIVERED", "FAILED", "DEAD", "DISCARDED")
VALIDATION_STATUSES = ("VALID", "INVALID", "NO_SCHEMA", "SKIPPED")
REPLAY_STATUSES = ("PENDING", "IN_PROGRESS", "COMPLETED", "CANCELLED")
DELIVERY_STATUSES = ("PENDING", "DELIVERED", "FAILED")
ROUTE_PRIORITIES = ("CRITICAL", "HIGH", "NORMAL", "LOW")  # declared order is the sort order
ALERT_METRICS = ("ERROR_RATE", "QUEUE_SIZE", "DLQ_SIZE", "LATENCY_P95", "SCHEMA_DRIFT")
ERROR_STATUSES = ("FAILED", "DEAD")
WILDCARD = "*"


# Layouts are DDL text, which every reader and createDataFrame accepts.
EVENTS = (
    "id string, external_id string, source string, event_type string, payload string,"
    " headers map<string,string>, signature string, status string, validation_status string,"
    " validation_errors string, attempts int, last_error string, created_at timestamp,"
    " queued_at timestamp, processed_at timestamp, failed_at timestamp"
)
EVENT_STATUS_LOG = (
    "event_id string, status string, at timestamp, attempts int, last_error string,"
    " queued_at timestamp, processed_at timestamp, failed_at timestamp"
)
RAW_EVENTS = (
    "source string, event_type string, payload string, headers map<string,string>, received_at timestamp"
)
SCHEMA_DEFINITIONS = (
    "source string, event_type string, version int, schema string, reject_on_fail boolean, active boolean"
)
ROUTES = (
    "id string, source string, event_type string, target_url string, target_name string, method string,"
    " timeout int, retry_count int, retry_backoff string, priority string, headers map<string,string>,"
    " active boolean, created_at timestamp"
)
DELIVERIES = (
    "id string, event_id string, route_id string, status string, response_code int, response_body string,"
    " duration_ms int, attempts int, last_error string, created_at timestamp, completed_at timestamp"
)
TRANSFORMS = ("source string, event_type string, mapping map<string,string>, active boolean")
SOURCES = (
    "name string, signature_header string, signature_secret string, signature_algorithm string,"
    " dedup_field string, dedup_window string, rate_limit_max int, rate_limit_window int, active boolean"
)
ALERT_RULES = (
    "id string, name string, metric string, threshold double, window string, target_url string,"
    " cooldown string, active boolean"
)
ALERT_HISTORY = ("id string, alert_rule_id string, metric_value double, message string, fired_at timestamp")
REPLAY_REQUESTS = (
    "id string, filter_source string, filter_event_type string, filter_status string, filter_from timestamp,"
    " filter_to timestamp, total_events bigint, replayed_events bigint, status string, requested_by string"
)
EXTERNAL_EVENTS = ("external_id string, event_type string, payload string, occurred_at timestamp")


def columns_of(layout: str) -> dict[str, str]:
    """Column names and types of a layout without nested commas at top level."""
    parts, depth, part = [], 0, ""
    for char in layout + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(part.strip().split(" ", 1))
            part = ""
        else:
            part += char
    return {name: kind.strip() for name, kind in parts}
