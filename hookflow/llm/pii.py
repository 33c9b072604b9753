"""Personal data by regular expressions, checksums and context words; native columns only.

Every kind has a pattern that proposes spans, leftmost and without overlaps. Validators confirm or reject them: Luhn for cards, mod 97 for
account numbers, number ranges for addresses and social security numbers. A span's score is that of its proposal, plus what its validator
and a context word close before it add. Spans of the base rules (email, ip, card, phone) stay whatever their score; further spans are added
from ``THRESHOLD`` on: cards of 13 to 15 digits and local phone numbers near a context word, account numbers with a right checksum, social
security numbers near a context word.

Spark has no function for the places of matches. The matches and the gaps between them alternate, so the places are running sums of their
lengths, taken block by block, which keeps texts with very many matches near linear. Patterns are possessive where a group repeats: Java's
matcher recurses for every repetition it may have to take back, and would overflow on long runs. A run of characters that was tried from its
first one isn't tried again from each of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"[0-9(][\x20().0-9-]{5,22}[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# What a text must hold to have a match at all; a search for one character is much cheaper than a pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT_CHARS = 40  # before a span, back to the proposal of the same pattern before it
# Matched in the lower-cased (A-Z) context.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|amex|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobil|handy|móvil|appel",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
# Per cent: of a proposal, of a passed validator, of a context word.
SCORES = {"email": (60, 20, 20), "ip": (50, 30, 20), "card": (30, 30, 30), "phone": (50, 30, 20), "local": (30, 20, 30), "iban": (40, 40, 20), "ssn": (30, 30, 30)}
THRESHOLD = 80
_BLOCK = 128
_EDGE = "[0-9A-Za-z+@._%-]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "struct<kind:string,start:bigint,end:bigint,score:int,base:boolean,value:string>"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(numbers: Column) -> Column:
    """Running sums of an array of longs: sums of whole blocks before, and inside the block."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda b: F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, _sum)
    inside = F.transform(
        F.arrays_zip(blocks.alias("x"), F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b))).alias("base")),
        lambda z: F.transform(z["x"], lambda _, i: z["base"] + _sum(F.slice(z["x"], F.lit(1), i + 1))),
    )
    return F.when(F.size(numbers) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))


def _widths(matches: Column, gaps: Column) -> Column:
    """Code points of each match and the gap before it."""
    return F.transform(matches, lambda m, i: (F.char_length(m) + F.char_length(F.element_at(gaps, i + 1))).cast("long"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*(F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(doubled, c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, spaces aside, leaves 1 when its first four characters go to the end and letters count from 10 on."""
    bare = F.replace(account, F.lit(" "))
    moved = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789" + _UPPER), c) - 1
    left = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return left == 1


def _valid(pattern: str, value: Column) -> Column:
    """The validator of a pattern."""
    count = F.length(digits(value))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    if pattern == "email":
        return value.rlike(r"\.[A-Za-z]{2,}$")
    if pattern == "ip":
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if pattern == "card":
        # Counted before the checksum, whose steps grow with the digits.
        return F.when(count.between(13, 19), luhn(digits(value))).otherwise(False)
    if pattern == "phone":
        return count.between(8, 15)
    if pattern == "local":
        return count.between(7, 12) & ~value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    if pattern == "iban":
        return F.length(F.replace(value, F.lit(" "))).between(15, 34) & mod97(value)
    return ~value.rlike("^(?:000|666|9)|-00-|0000$")


def _in_base(pattern: str, value: Column, valid: Column) -> Column:
    """Whether the base rules hold the span."""
    if pattern == "email":
        return F.lit(True)
    if pattern in ("ip", "phone"):
        return valid
    if pattern == "card":
        return valid & F.length(digits(value)).between(16, 19)
    return F.lit(False)


def _spans(pattern: str, matches: Column, gaps: Column, ends: Column) -> Column:
    """The spans of a pattern's matches that stay."""
    kind = "phone" if pattern == "local" else pattern
    proposal, checked, near = SCORES[pattern]

    def span(value: Column, i: Column) -> Column:
        gap = F.element_at(gaps, i + 1)
        after = F.left(F.concat(F.element_at(gaps, i + 2), F.coalesce(F.get(matches, i + 1), F.lit(""))), F.lit(1))
        before = F.when((gap == "") & (i > 0), "0").otherwise(F.right(gap, F.lit(1)))
        alone = ~before.rlike(_EDGE) & ~after.rlike("[0-9A-Za-z@]")
        valid = _valid(pattern, value)
        context = F.translate(F.right(gap, F.lit(CONTEXT_CHARS)), _UPPER, _LOWER).rlike(CONTEXT[kind])
        base = _in_base(pattern, value, valid)
        score = F.when(valid & (base | alone), proposal + checked + F.when(context, near).otherwise(0)).otherwise(F.when(base, proposal).otherwise(0))
        end = F.element_at(ends, i + 1)
        return F.struct(
            F.lit(kind).alias("kind"), (end - F.char_length(value)).alias("start"), end.alias("end"), score.cast("int").alias("score"), base.alias("base"), value.alias("value")
        )

    return F.filter(F.transform(matches, span), lambda s: s["base"] | (s["score"] >= THRESHOLD))


def with_spans(docs: DataFrame, text: str = "text", into: str = "__pii") -> DataFrame:
    """``docs`` with a column ``into``: the spans found in the whole text, an array of (kind, start, end, score, base, value).

    Offsets are in code points, the end exclusive; spans are ordered by kind (as in ``KINDS``), then by start. Those of one pattern don't overlap,
    those of different ones may. A null or empty text has none (an empty array). Rows and all other columns come back as they are, repeated rows
    too; a column named ``into``, or like one of the scratch columns (``into`` with an ending), is refused. No shuffle.
    """
    scratch = {p: tuple(f"{into}_{p}_{x}" for x in ("matches", "gaps", "ends", "spans")) for p in PATTERNS}
    taken = {into, *(c for names in scratch.values() for c in names)} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used here")
    body = F.col(f"`{text}`")
    none = F.array().cast("array<string>")
    found = docs
    steps: list[dict[str, Column]] = [{}, {}, {}, {}]
    for pattern, regex in PATTERNS.items():
        matches, gaps, ends, spans = scratch[pattern]
        held = F.contains(body, F.lit(_NEEDS[pattern])) if pattern in _NEEDS else body.isNotNull()
        steps[0][matches] = F.when(held, F.regexp_extract_all(body, F.lit(regex), F.lit(0))).otherwise(none)
        some = F.size(matches) > 0
        steps[1][gaps] = F.when(some, F.split(body, regex, -1)).otherwise(none)
        steps[2][ends] = F.when(some, _running(_widths(F.col(matches), F.col(gaps)))).otherwise(F.array().cast("array<bigint>"))
        steps[3][spans] = F.when(some, _spans(pattern, F.col(matches), F.col(gaps), F.col(ends))).otherwise(F.array().cast(f"array<{SPAN}>"))
    for step in steps:
        found = found.withColumns(step)
    of = {pattern: F.col(names[3]) for pattern, names in scratch.items()}
    # Phone numbers come from two patterns: put in order by start.
    phones = F.array_sort(F.concat(of["phone"], of["local"]))
    ordered = F.concat(of["email"], of["ip"], of["card"], phones, of["iban"], of["ssn"])
    return found.withColumn(into, ordered).select(*(F.col(f"`{c}`") for c in docs.columns), into)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def named(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, score, base, value: a row for every span of every row of ``docs``."""
    found = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return found.select("doc_id", F.explode("__pii").alias("s")).select("doc_id", "s.*")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (spans of the base rules), base_sha256, spans (all) for every row of ``docs``.

    Reads doc_id and text only; a null text counts as empty, a null doc_id is kept, repeated rows each have their own; an empty table gives no rows.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = found.withColumn("__base", F.filter("__pii", lambda s: s["base"]))
    counts = (_count(F.col("__base"), k).alias(f"n_{k}") for k in BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(named(F.col("__base")), 256).alias("base_sha256"), named(F.col("__pii")).alias("spans"))
