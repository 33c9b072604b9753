from hookflow.functions.scalars import (
    alert_message,
    delivery_error,
    delivery_ok,
    iso_millis,
    js_number_text,
    js_round,
    latency_ms,
    parse_duration,
    parse_window,
    priority_rank,
    truncate_body,
)

__all__ = [
    "alert_message",
    "delivery_error",
    "delivery_ok",
    "iso_millis",
    "js_number_text",
    "js_round",
    "latency_ms",
    "parse_duration",
    "parse_window",
    "priority_rank",
    "truncate_body",
]
