"""Collocations: counts, scores and order against plain Python; the trie against a plain counter."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from hookflow.llm import collocations

LAYOUT = "doc_id long, text string, lang string, phrase string, n long, bucket string"


def by_hand(rows, least=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        n = totals[lang]
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        ranked = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = ["the", "The", "of", "New", "new", "york", "city", "é", "É", "x.y", "a-b", "token", "rare", "中文"]
    phrases = ["New York City", "new york", "of the", "stock, exchange", "one two three four five", "a b a b a b", "tick\ttock  tick", "line\x0bend", "sep\x1cword"]
    rows = []
    for i in range(260):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) + (str(rng.randrange(400)) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 60))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", ". ", "\n", "; "]) for p in parts), rng.choice(["en", "en", "en", "de", None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, "x", 1, "y") for i, (text, lang) in enumerate(rows)], LAYOUT)


def test_matches_brute_force(spark):
    rows = corpus() + [(None, "en"), ("", "de"), (". . .", None), ("New York City", "fr"), ("New York City", "fr")] + [(" ".join(["again"] * 40_000), "es")]
    want = by_hand(rows)
    assert {w[0] for w in want} >= {"en", "es"} and len(want) > 15
    assert sorted(tuple(r) for r in collocations.mine(frame(spark, rows)).collect()) == want
    assert sorted(tuple(r) for r in collocations.mine(frame(spark, rows), least=20, n=5).collect()) == by_hand(rows, 20, 5)
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [("only a few words", "en")])).count() == 0


def test_spills_bursts_and_new_word_ids_change_nothing(spark, monkeypatch):
    rows = corpus()[:80]
    whole = collocations.chunks(frame(spark, rows).coalesce(1))
    plain = {(r["lang"], r["phrase"]): r["n"] for r in collocations.counts(whole, (1, 2, 3)).collect()}
    alone = {(r["lang"], r["phrase"]): r["n"] for r in collocations.counts(whole, (1,)).collect()}
    assert alone == {key: n for key, n in plain.items() if " " not in key[1]}
    batch = pa.RecordBatch.from_pydict({"lang": [lang or "und" for _, lang in rows], "text": [t for t, _ in rows]})
    for name, value in (("TRIE_ENTRIES", 64), ("CHUNK_WORDS", 50), ("WORDS_KNOWN", 120)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.HatTrie.__init__, "__defaults__", (8,))
    small = collocations._Counting((1, 2, 3), None, None)
    got, runs = Counter(), 0
    for out in small.batches(collocations._split(iter([batch]))):
        runs += 1
        found = out.to_pydict()
        for lang, phrase, n in zip(found["lang"], found["phrase"], found["n"], strict=True):
            got[lang, phrase] += n
    assert dict(got) == plain and runs > 10


def test_sieves_let_every_frequent_phrase_through(spark, monkeypatch):
    """However few bits they have."""
    rows = corpus()
    want = by_hand(rows, 40)
    for bits in (1 << 16, 1 << 20):
        monkeypatch.setattr(collocations, "PAIR_BITS", bits)
        monkeypatch.setattr(collocations, "CELLS_AT_ONCE", 500)
        assert sorted(tuple(r) for r in collocations.mine(frame(spark, rows), least=40).collect()) == want


def test_trie_counts_like_a_counter():
    rng = np.random.default_rng(0)
    trie, want = collocations.HatTrie(2, burst=16), Counter()
    for _ in range(30):
        keys = rng.zipf(1.4, (200, 4)).clip(0, 300).astype(">u4")
        trie.add(keys)
        want.update(map(tuple, keys.tolist()))
        short = keys[:, :3].copy()
        trie.add(short[:100])
        trie.add(short[100:], np.ones(100, np.int64))
        want.update(map(tuple, short.tolist()))
    assert trie.entries == len(want)
    got = Counter()
    for keep in (len(want) // 2, 0):
        for path, container in trie.spill(keep):
            for key, n in container.items():
                got[path + tuple(np.frombuffer(key, ">u4").tolist())] += n
        assert trie.entries <= keep
    assert got == want


def test_exact_beyond_a_long(spark):
    big = 9 * 10**12
    frequent = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)], "lang string, words int, phrase string, n long")
    totals = spark.createDataFrame([("en", 10**14 + 7)], "lang string, total long")
    (row,) = collocations.scored(frequent, totals).collect()
    assert row["score"] == 1000 * (big - 2) * (10**14 + 7) // (big * (big - 1))
