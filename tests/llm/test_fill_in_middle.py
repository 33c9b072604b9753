"""Fill-in-middle: the rank index against all boundaries, cuts against slices of Python strings, outputs restored."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from hookflow.llm import fill_in_middle as fim

LAYOUT = "doc_id long, text string, n long, form string, output string"


def by_hand(doc_id, text):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_index_is_exact():
    rng = random.Random(2)
    alphabets = ["abc", "abé", "中文", "aé中\U0001f600"]
    for _ in range(60):
        text = "".join(rng.choice(rng.choice(alphabets)) * rng.randint(1, 400) for _ in range(rng.randint(0, 40))).encode()
        found = fim.boundaries(text)
        index = fim.RankIndex(found)
        ranks = np.arange(len(found))
        assert np.array_equal(index.offsets(ranks), found)
        assert np.abs(index.residuals.astype(int)).max() <= fim.BOUND + 1
    mixed = ("a" * 5000 + "中" * 5000 + "\U0001f600" * 5000).encode()
    assert 3 <= len(fim.RankIndex(fim.boundaries(mixed)).starts) <= 6
    assert len(fim.RankIndex(fim.boundaries(b"x" * 100_000)).starts) == 1
    assert len(fim.RankIndex(fim.boundaries(b"")).starts) == 1


def test_long_texts_need_several_segments(monkeypatch):
    monkeypatch.setattr(fim, "_LONGEST", 1000)
    found = fim.boundaries(("aé" * 5000).encode())
    index = fim.RankIndex(found)
    assert len(index.starts) >= 10 and np.array_equal(index.offsets(np.arange(len(found))), found)


def test_transform_matches_slices(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \né中\U0001f600<PSM>") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, None, 1, "x", "y"), (None, "no id", 1, "x", "y"), (7, "again", 1, "x", "y"), (7, "again", 1, "x", "y"), (-5, "minus", 1, "x", "y"), (900, None, 1, "x", "y")]
    rows += [(901, "has <M> inside", 1, "x", "y"), (902, "é中" * 300_000, 1, "x", "y"), (903, "<", 1, "x", "y"), (904, "a<P", 1, "x", "y")]
    out = fim.fill_in_middle(spark.createDataFrame(rows, LAYOUT))
    got = out.select("*", fim.restored("output", "form").alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, *by_hand(i, t), t or "") for i, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], LAYOUT)).count() == 0


def test_shares(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"))
    found = {r["form"]: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(found["plain"] / 5000 - 0.1) < 0.02 and abs(found["spm"] / 5000 - 0.18) < 0.02
    everything = fim.fill_in_middle(docs, plain=0, spm=100).groupBy("form").count().collect()
    assert [(r["form"], r["count"]) for r in everything] == [("spm", 5000)]
