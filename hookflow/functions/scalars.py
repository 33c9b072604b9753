"""Scalar column functions, all JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hookflow.model import ROUTE_PRIORITIES

# Seconds per unit letter and the fallbacks for unreadable durations.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
DEFAULT_WINDOW_SECONDS = 259200
DEFAULT_DURATION_MS = 300000
# Doubles below this have fewer bits.
SMALLEST_NORMAL = 2.2250738585072014e-308


def _duration(text: Column, per_unit: dict[str, int], default: int) -> Column:
    shape = r"^([0-9]+)([smhd])\z"
    unit = F.regexp_extract(text, shape, 2)
    amount = F.regexp_extract(text, shape, 1).try_cast("bigint")
    scaled = F.lit(None).cast("bigint")
    for letter, size in per_unit.items():
        scaled = F.when(unit == letter, amount * F.lit(size).cast("bigint")).otherwise(scaled)
    return F.coalesce(scaled, F.lit(default).cast("bigint"))


def parse_window(text: Column) -> Column:
    """``72h`` style text to seconds; 72 hours when unreadable or null."""
    return _duration(text, UNIT_SECONDS, DEFAULT_WINDOW_SECONDS)


def parse_duration(text: Column) -> Column:
    """``5m`` style text to milliseconds; 5 minutes when unreadable or null."""
    return _duration(text, {u: s * 1000 for u, s in UNIT_SECONDS.items()}, DEFAULT_DURATION_MS)


def js_round(value: Column, digits: int = 0) -> Column:
    """Round half towards +infinity (not away from zero as SQL ``round`` does)."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decimal_parts(size: Column) -> Column:
    """(digits, point) of a positive double: it is 0.digits times ten to the power of point, digits without zeros at the ends."""

    def split(shown: Column) -> Column:
        mantissa = F.substring_index(shown, "E", 1)
        whole, fraction = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
        power = F.when(F.contains(shown, F.lit("E")), F.substring_index(shown, "E", -1).cast("int")).otherwise(0)
        digits = F.concat(whole, fraction)
        significant = F.ltrim(digits, F.lit("0"))
        point = F.length(whole) + power - (F.length(digits) - F.length(significant))
        return F.struct(F.rtrim(significant, F.lit("0")).alias("digits"), point.alias("point"))

    return bind(size.cast("string"), split)


def _rounded(parts: Column, places: int) -> Column:
    """The digits to so many places, as a whole number (which a carry makes one place longer)."""
    kept, rest = F.left(parts["digits"], F.lit(places)).cast("bigint"), F.substring(parts["digits"], F.lit(places + 1), F.lit(1))
    return kept + F.when(rest >= "5", 1).otherwise(0)


def _shortest(size: Column, parts: Column) -> Column:
    """The fewest digits that read as the same double. The platform's text may have 16 to 18 where fewer do, and for the
    smallest doubles any number; what it rounds to is tried, fewest places first."""

    def tried(places: int, other: Column) -> Column:
        def use(number: Column) -> Column:
            same = F.concat(number.cast("string"), F.lit("E"), (parts["point"] - places).cast("string")).cast("double") == size
            digits = number.cast("string")
            point = parts["point"] + F.length(digits) - places
            return F.when(same, F.struct(F.rtrim(digits, F.lit("0")).alias("digits"), point.alias("point"))).otherwise(other)

        return bind(_rounded(parts, places), use)

    def first(places: range) -> Column:
        found = parts
        for n in reversed(places):
            found = tried(n, found)
        return found

    count = F.length(parts["digits"])
    return F.when(size < SMALLEST_NORMAL, first(range(1, 18))).when(count < 16, parts).otherwise(first(range(15, 18)))


def _placed(parts: Column) -> Column:
    """Digits with the point where JavaScript puts it: plain from 1e-6 up to 1e21, with an exponent beyond."""
    digits, point = parts["digits"], parts["point"]
    count = F.length(digits)
    tail = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise("")
    sign = F.when(point > 0, "e+").otherwise("e-")
    return (
        F.when((point >= count) & (point <= 21), F.rpad(digits, point, F.lit("0")))
        .when(point.between(1, 21), F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, count)))
        .when(point.between(-5, 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(F.concat(F.left(digits, F.lit(1)), tail, sign, F.abs(point - 1).cast("string")))
    )


def js_number_text(value: Column) -> Column:
    """A double as JavaScript prints it: the fewest digits that read as the same number, placed by its rules for exponents."""

    def text(d: Column) -> Column:
        size = F.abs(d)
        placed = bind(_decimal_parts(size), lambda parts: bind(_shortest(size, parts), _placed))
        return (
            F.when(F.isnan(d), F.lit("NaN"))
            .when(size == F.lit(float("inf")), F.when(d > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
            .when((d == F.rint(d)) & (size < F.lit(9.0e15)), d.try_cast("bigint").cast("string"))
            .when(d.isNotNull(), F.concat(F.when(d < 0, "-").otherwise(""), placed))
        )

    return bind(value.cast("double"), text)


def iso_millis(at: Column) -> Column:
    """ISO-8601 UTC text with milliseconds (session time zone is UTC)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def truncate_body(body: Column, limit: int = 1000) -> Column:
    """First ``limit`` characters and an ellipsis when longer."""
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("..."))).otherwise(body)


def alert_message(name: Column, metric: Column, value: Column, threshold: Column, label: str = "Alert") -> Column:
    return F.concat(
        F.lit(f"[{label}] "),
        name,
        F.lit(": "),
        metric,
        F.lit(" = "),
        js_number_text(value),
        F.lit(" (threshold: "),
        js_number_text(threshold),
        F.lit(")"),
    )


def delivery_ok(code: Column) -> Column:
    """True for a 2xx response, false for anything else including no response."""
    return F.coalesce(code.between(200, 299), F.lit(False))


def delivery_error(code: Column, status_text: Column) -> Column:
    """``HTTP <code>: <text>`` for a failed response, null for a good one."""
    return F.when(~delivery_ok(code), F.concat(F.lit("HTTP "), code.cast("string"), F.lit(": "), status_text))


def latency_ms(created: Column, processed: Column) -> Column:
    """Whole milliseconds between two millisecond clocks."""
    return F.unix_millis(processed) - F.unix_millis(created)


def priority_rank(priority: Column) -> Column:
    """Position in the declared priority order (text order would put HIGH after CRITICAL by luck only)."""
    rank = F.lit(len(ROUTE_PRIORITIES))
    for position, name in enumerate(ROUTE_PRIORITIES):
        rank = F.when(priority == name, F.lit(position)).otherwise(rank)
    return rank
