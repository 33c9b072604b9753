"""Personal data: base spans, added spans and checksums against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hookflow.llm import pii

LAYOUT = "doc_id long, text string, kind string, spans string, start long"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"[0-9(][\x20().0-9-]{5,22}[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|(\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def numerals(value):
    return re.sub("[^0-9]", "", value)


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def valid(pattern, value):
    n = len(numerals(value))
    if pattern == "email":
        return bool(re.search(r"\.[A-Za-z]{2,}\Z", value))
    if pattern == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if pattern == "card":
        return 13 <= n <= 19 and luhn(numerals(value))
    if pattern == "phone":
        return 8 <= n <= 15
    if pattern == "local":
        return 7 <= n <= 12 and not re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value)
    if pattern == "iban":
        bare = value.replace(" ", "")
        return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    return not re.search("^(000|666|9)|-00-|0000$", value)


def by_hand(text):
    found = []
    for pattern, regex in PATTERNS.items():
        kind, last = ("phone" if pattern == "local" else pattern), 0
        for m in re.finditer(regex, text):
            value, gap = m[0], text[last : m.start()]
            before = "0" if not gap and last else gap[-1:]
            alone = not re.match(r"[0-9A-Za-z+@._%-]", before) and not re.match("[0-9A-Za-z@]", text[m.end() : m.end() + 1])
            last = m.end()
            ok = valid(pattern, value)
            base = pattern == "email" or (pattern in ("ip", "phone") and ok) or (pattern == "card" and ok and len(numerals(value)) >= 16)
            near = "".join(c.lower() if c.isascii() else c for c in gap[-40:])
            proposal, checked, context = pii.SCORES[pattern]
            score = proposal + checked + (context if re.search(pii.CONTEXT[kind], near) else 0) if ok and (base or alone) else proposal if base else 0
            if base or score >= 80:
                found.append((kind, m.start(), m.end(), score, base, value))
    return sorted(found, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


def card_number(rng, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def account(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int(body + "131400") % 97
    return f"DE{check:02d}{body}"


def texts():
    rng = random.Random(5)
    seeds = [
        "a@b.c", "x.y%z+1@mail-3.example.com", "@b.c", "a@b", "a@b..c", "a@b.c_d@e.f", "a@b.c.@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "1.2.3",
        "12 34-56", "1 - 2", "+1 (555) 123-4567", "+12", "+1((((", "+49 30 1234567 8901234567", "é中\U0001f600", " ", "\n", "call ", "Tel. ", "card: ", "my VISA ", "IBAN ",
        "social security 123-45-6789", "SSN 000-12-3456", "123-45-6789", "(555) 123-4567", "555 123 4567", "token=\"254a3ed1\"", "f.24@mail4.example.com", ".", ",", "x", "0",
    ]
    made = ["".join(rng.choice(seeds) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    for n in (13, 14, 15, 16, 18, 19):
        number = card_number(rng, n)
        made += [number, "card " + number, "card no " + "-".join(number[i : i + 4] for i in range(0, n, 4)), "xx" + number + "1"]
    for _ in range(5):
        number = account(rng)
        made += [number, f"to {' '.join(number[i : i + 4] for i in range(0, 22, 4))} today", number[:-1] + "0", f"Konto {number}."]
    made.append("GB82 WEST 1234 5698 7654 32")
    return made


def test_spans_match_plain_python(spark):
    made = texts()
    rows = [(i, t, "k", "s", 1) for i, t in enumerate(made)]
    got = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in pii.with_spans(spark.createDataFrame(rows, LAYOUT), into="found").collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(made)}
    assert {s[0] for spans in got.values() for s in spans} == set(pii.KINDS)
    listed = pii.findings(spark.createDataFrame(rows, LAYOUT)).collect()
    assert sorted(tuple(r) for r in listed) == sorted((i, *s) for i, spans in got.items() for s in spans)


def test_summary_and_odd_rows(spark):
    long_run = "a" * 300_000 + " " + "1" * 200_000 + " " + "+1" + "(" * 200_000 + " " + "a@" * 50_000 + " x@y.de"
    many = "a@b.cd 1.2.3.4 " * 3000
    rows = [(None, None, "k", "s", 1), (1, None, "k", "s", 1), (2, "", "k", "s", 1), (3, "a@b.cd", "k", "s", 1), (3, "a@b.cd", "k", "s", 1), (4, long_run, "k", "s", 1), (5, many, "k", "s", 1)]
    got = pii.summary(spark.createDataFrame(rows, LAYOUT)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (None, 1, 2):
        assert (by_id[i]["n_email"], by_id[i]["base_sha256"], by_id[i]["spans"]) == (0, nothing, "")
    assert [r["spans"] for r in got if r["doc_id"] == 3] == ["email:0:6", "email:0:6"]
    assert by_id[4]["spans"] == f"email:{len(long_run) - 6}:{len(long_run)}"
    want = ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in by_hand(many))
    assert by_id[5]["n_email"] == by_id[5]["n_ip"] == 3000 and by_id[5]["spans"] == want
    assert by_id[5]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert pii.summary(spark.createDataFrame([], LAYOUT)).count() == 0
    with pytest.raises(ValueError):
        pii.with_spans(spark.createDataFrame(rows, LAYOUT), into="kind")


def test_no_python_worker_and_no_shuffle(spark):
    plan = pii.summary(spark.createDataFrame([(1, "x", "k", "s", 1)], LAYOUT))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan.replace("PythonRDD", ""))


def test_long_running_sums(spark):
    numbers = spark.range(3).select(F.expr("sequence(1L, array(1L, 128L, 1000L)[int(id)])").alias("a"))
    got = [r["s"] for r in numbers.select(pii._running(F.col("a")).alias("s")).collect()]
    assert [g[-1] for g in got] == [1, 128 * 129 // 2, 1000 * 1001 // 2] and got[2][500] == 501 * 502 // 2
