"""The operators of hookflow.llm against brute-force versions, and on odd input."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from hookflow.llm import common, compression_bands, impact_topk, language_ppm, line_alignment, mixing, ngram_jaccard, packing, queries, repeats, url_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Clashing names: columns that operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls long, size long, token string, spans string"


def rows_of(pairs, lang="en", source="s"):
    return [(i, t, lang, source, len(t or ""), 1, 2, "x", "y") for i, t in pairs]


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_documents():
    rng = random.Random(7)
    base = prose(rng, 120)
    return rows_of(
        [(None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, base), (6, base), (7, base), (8, base + " extra"), (9, "\u00e9\u4e2d " * 3000)]
    )


@pytest.fixture(scope="module")
def corpus():
    """Documents with exact copies, near copies at all distances, and passages that many share."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    for _ in range(60):
        words = rng.choice(texts[:40]).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(words))
    texts += [prose(rng, rng.randint(5, 60)) + " " + passage + " " + prose(rng, rng.randint(0, 60)) for _ in range(40)]
    texts += ["Same TEXT here", "same text here", "a b c d e f", "A b c d e f", "a b c d e f g"]
    return list(enumerate(texts))


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    parent = list(range(600))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in used}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard_by_hand(docs):
    sets = {}
    for i, t in docs:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(t or "")]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    low = {i: i for i in sets}

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_links_match_brute_force(spark, corpus):
    links, members = ngram_jaccard.jaccard_links(spark.createDataFrame(rows_of(corpus), DOCS))
    rows = {r["doc_id"]: r for r in members.collect()}
    classes = {}
    for i, t in corpus:
        words = "".join(c.lower() if c.isascii() else c for c in t).split()
        classes.setdefault(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None, []).append(i)
    for members_of in classes.values():
        assert len({rows[i]["cls"] for i in members_of}) == 1
    name = {c: rows[m[0]]["cls"] for c, m in classes.items()}
    want = {tuple(sorted((name[a], name[b]))) for a in classes for b in classes if a and b and a != b and 100 * len(a & b) >= 75 * len(a | b)}
    got = [tuple(sorted((r["a"], r["b"]))) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    assert all(rows[m[0]]["links"] == sum(name[c] in pair for pair in want) for c, m in classes.items())


def test_one_of_each_group_by_row(spark):
    """Two texts of one doc_id are two documents; of a group without ids one row stays; blank rows stay."""
    rng = random.Random(20)
    first, other, third = (prose(rng, 80) for _ in range(3))
    near = first + " more"
    rows = rows_of([(1, first), (7, near), (7, other), (None, third), (None, third + " x"), (None, third), (9, ""), (8, None), (3, first)])
    left = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert len(left) == 5 and {(r["doc_id"], r["text"]) for r in left if r["doc_id"] is not None} == {(1, first), (7, other), (9, ""), (8, None)}
    assert [r["text"] for r in left if r["doc_id"] is None][0] in (third, third + " x")


def test_jaccard_matches_brute_force(spark, corpus):
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows_of(corpus), DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_by_hand(corpus)


def test_jaccard_in_a_large_group_of_variants(spark):
    rng = random.Random(11)
    base = prose(rng, 150, [f"v{i}" for i in range(3000)]).split()
    passage = prose(rng, 50, [f"p{i}" for i in range(3000)])
    docs = []
    for i in range(260):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(0, 9)):
            words[at] = rng.choice(["other", f"own{i}"])
        docs.append((i, " ".join(words)))
    docs += [(300 + i, prose(rng, rng.randint(1, 12)) + " " + passage) for i in range(120)]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows_of(docs), DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_by_hand(docs)


def test_jaccard_moves_only_texts_that_may_link(spark, monkeypatch):
    frames, written = [], ngram_jaccard.written

    def noted(df, label):
        stored = written(df, label)
        frames.append((set(stored.columns), stored.count()))
        return stored

    monkeypatch.setattr(ngram_jaccard, "written", noted)
    rng = random.Random(31)
    texts = [prose(rng, 60) for _ in range(50)]
    texts += [texts[3] + " more", texts[3] + " other"]
    docs = list(enumerate(texts))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows_of(docs), DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_by_hand(docs)
    whole = [n for columns, n in frames if columns & {"text", "bits", "other", "halves"}]
    assert whole and max(whole) <= 3


def test_sieve_keeps_all_that_is_wanted(spark):
    rng = random.Random(32)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(4000)] + [0, -1, 63, 64, -64, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, i long")
    left = {r["key"] for r in common.sieved(rows, rows.where("i % 3 = 0"), "key").collect()}
    assert set(keys[::3]) <= left and len(left) < len(keys) / 3 + 50
    assert common.sieved(rows, rows.where("false"), "key").count() == 0


def test_pieces_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["a" * 5, None, "b" * 30, "", "c" * 8])], ["doc_id", "text"])
    for limit in (1, 10, 100):
        assert pa.Table.from_batches(common.pieces([batch], limit)).to_pylist() == batch.to_pylist()
    assert [p.num_rows for p in common.pieces([batch.slice(0, 0)], 1)] == [0]


def test_jaccard_on_odd_rows(spark):
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(odd_documents(), DOCS)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter(
        [(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 6), (8, 6), (9, 9)]
    )
    assert ngram_jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_bitmap_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n, m, both in [(5, 7, 3), (100, 130, 90), (1, 500, 0), (64, 65, 64)]:
        pool = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : n + m - both])))
        assert ngram_jaccard.least_difference(ngram_jaccard.bitmap(x), ngram_jaccard.bitmap(y)) <= n + m - 2 * both


def repeats_by_hand(texts):
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_GROUP, 2])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_GROUP", hot)
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (34, 50, 120)]
    texts = [prose(rng, rng.randint(0, 90)) for _ in range(20)]
    texts += [t[: rng.randrange(len(t) or 1)] + rng.choice(shared)[rng.randrange(20) :] + t[:50] for t in texts]
    texts += ["x" * 700, "ab" * 300, shared[2], shared[2], "é" * 150, None, "", texts[0] + "\n" + shared[1] + "\n" + shared[1]]
    got = repeats.without_repeats(spark.createDataFrame(rows_of(enumerate(texts)), DOCS)).withColumn("k", F.sha2("kept", 256)).collect()
    by_id = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["k"]) for r in got}
    assert by_id == dict(enumerate(repeats_by_hand([(t or "").encode() for t in texts])))


def test_repeats_on_odd_rows(spark):
    got = repeats.without_repeats(spark.createDataFrame(odd_documents(), DOCS)).collect()
    assert len(got) == 11 and all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] in (6, 7))
    assert repeats.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(2)
    text = prose(rng, 3000).encode()
    whole = repeats.Anchors()(text)
    monkeypatch.setattr(repeats, "_BLOCK", 1000)
    parts = repeats.Anchors()(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_intervals_are_those_of_the_suffix_tree():
    words = sorted(b[i:] for b in [b"banana$1", b"ananas$2"] for i in range(len(b)))
    lcp = [0, *(repeats.agreement(a, b) for a, b in zip(words, words[1:], strict=False))]
    got = {(d, f, e) for d, f, e in repeats.intervals(lcp) if d}
    want = set()
    for f in range(len(words)):
        for e in range(f + 1, len(words)):
            d = min(lcp[f + 1 : e + 1])
            if d and (f == 0 or lcp[f] < d) and (e + 1 == len(words) or lcp[e + 1] < d):
                want.add((d, f, e))
    assert got == want


def test_patience_aligns_in_order():
    a, b = [1, 2, 3, 4, 5, 3, 9], [7, 2, 3, 8, 4, 3, 9]
    pairs = line_alignment.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert line_alignment.patience(a, a) == [(i, i) for i in range(7)]
    assert line_alignment.patience([], a) == []


def test_line_dedup_keeps_one_copy_of_every_line(spark):
    rng = random.Random(4)
    lines = [prose(rng, rng.randint(20, 40)) for _ in range(60)]
    texts = ["\n".join(rng.sample(lines, rng.randint(1, 6))) for _ in range(50)] + ["\n".join(lines[:10])] * 2
    got = {r["doc_id"]: r for r in line_alignment.dedup_lines(spark.createDataFrame(rows_of(enumerate(texts)), DOCS)).collect()}
    seen = set()
    for i, text in enumerate(texts):
        kept = (got[i]["__kept"] or "").split("\n")
        for line in text.split("\n"):
            # A single shared line long enough is a block, and the first holder keeps it.
            assert (line in kept) or line in seen
        seen.update(text.split("\n"))
    assert got[51]["__kept"] == "" and got[51]["__removed"] == 10
    assert got[0]["cls"] == 1 and got[0]["spans"] == "y"


def naive_patience(a, b):
    """Pairs of equal lines: equal heads and tails, then the longest chain of lines unique on both sides, and the same between them."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    unique = [(i, b.index(x)) for i, x in enumerate(a) if x and a.count(x) == 1 and b.count(x) == 1]
    if not unique:
        return sorted(pairs)
    length, parent = [], []
    for k, (_, p) in enumerate(unique):
        before = [j for j in range(k) if unique[j][1] < p]
        length.append(1 + max((length[j] for j in before), default=0))
        parent.append(max((j for j in range(k) if length[j] == length[k] - 1), default=None))
    k = max(k for k in range(len(unique)) if length[k] == max(length))
    chain = []
    while k is not None:
        chain.append(unique[k])
        k = parent[k]
    chain.reverse()
    for (p, q), (p_end, q_end) in zip([(-1, -1), *chain], [*chain, (len(a), len(b))], strict=True):
        pairs += [(head + p + 1 + i, head + q + 1 + j) for i, j in naive_patience(a[p + 1 : p_end], b[q + 1 : q_end])]
    return sorted(pairs + [(head + p, head + q) for p, q in chain])


def lines_by_hand(rows):
    """Kept lines of each (place, text): aligned with the first holder of each line, of each shortest run of 100 bytes, and of all lines."""
    docs = {(i is None, i or 0, tie): text for i, tie, text in rows if text is not None}
    stripped = {place: [line.strip(" \t\r\x0b\x0c") for line in text.split("\n")] for place, text in docs.items()}
    first = {}

    def keys(lines):
        held = [x for x in lines if x]
        found = {("line", x) for x in held} | {("whole", tuple(held))}
        size = lambda b, e: sum(len(x.encode()) for x in held[b:e])
        for i in range(len(held)):
            found |= {("run", tuple(held[i:e])) for e in [next((e for e in range(i + 1, len(held) + 1) if size(i, e) >= 100), None)] if e}
            found |= {("run", tuple(held[b : i + 1])) for b in [next((b for b in range(i, -1, -1) if size(b, i + 1) >= 100), None)] if b is not None}
        return {(kind if kind == "whole" or len(x) > 1 and kind == "run" else "line", x if kind != "run" or len(x) > 1 else x[0]) for kind, x in found if x}

    for place in sorted(stripped):
        for key in keys(stripped[place]):
            first.setdefault(key, place)
    out = {}
    for place, lines in stripped.items():
        gone = set()
        for other in {first[key] for key in keys(lines)} - {place}:
            block = []
            for i, j in [*naive_patience(lines, stripped[other]), (None, None)]:
                if block and (i is None or (i, j) != (block[-1][0] + 1, block[-1][1] + 1)):
                    if sum(len(lines[k].encode()) for k, _ in block) >= 100:
                        gone |= {k for k, _ in block}
                    block = []
                block.append((i, j))
        out[place] = "\n".join(x for k, x in enumerate(docs[place].split("\n")) if k not in gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_matches_brute_force(spark, seed):
    """Shared lines of all lengths, blank lines, null and repeated ids, copies."""
    rng = random.Random(seed)
    pool = [prose(rng, n) for n in (1, 2, 3, 5, 8, 12, 20, 30) for _ in range(4)] + ["", " ", "\t"]
    texts = ["\n".join(" " * rng.randrange(2) + rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(70)]
    for _ in range(15):
        lines = rng.choice(texts).split("\n")
        lines[rng.randrange(len(lines))] = rng.choice(pool)
        texts.append("\n".join(lines))
    ids = [rng.choice([i, i, i, None, 7]) for i in range(len(texts))]
    frame = spark.createDataFrame(rows_of([*zip(ids, texts, strict=True), (500, None), (3, texts[0])]), DOCS)
    ties = {r["text"]: r["tie"] for r in frame.select("text", F.xxhash64("text").alias("tie")).collect()}
    want = lines_by_hand([(i, ties[t], t) for i, t in [*zip(ids, texts, strict=True), (3, texts[0])]])
    got = line_alignment.dedup_lines(frame.withColumn("whole", F.col("text"))).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["whole"] is not None:
            assert r["__kept"] == want[r["doc_id"] is None, r["doc_id"] or 0, ties[r["whole"]]]
    assert sum(r["__removed"] for r in got) > 50


def test_results_refuse_columns_of_their_names_and_bear_all_others(spark):
    names = "row doc tie text_ spans whole part n size source_ taken __doc __tie __text __spans __id __size __source __n __taken __words cls a_b"
    layout = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in [*names.split(), "a.b", "c`d".replace("`", "``")])
    rows = [(i, "one two three " * 20, "en", "s", *[f"{k}" for k in range(len(names.split()) + 2)]) for i in range(3)]
    docs = spark.createDataFrame(rows, layout)
    extra = docs.columns[4:]
    for out in (line_alignment.dedup_lines(docs), mixing.mixed(docs), language_ppm.predict(docs, language_ppm.fit(docs))):
        assert {tuple(r[c] for c in extra) for r in out.collect()} == {tuple(f"{k}" for k in range(len(extra)))}
    for clash, call in (("__KEPT", line_alignment.dedup_lines), ("__score", lambda d: language_ppm.predict(d, ([], [])))):
        with pytest.raises(ValueError, match="named like results"):
            call(docs.withColumn(clash, F.lit(1)))


def test_line_dedup_cuts_a_frequent_passage_beside_rare_lines(spark):
    rng = random.Random(14)
    frequent = [prose(rng, 60) for _ in range(6)]
    rare = [prose(rng, 30) for _ in range(4)]
    texts = [(i, "\n".join([f"own {i}", *frequent])) for i in range(80)] + [(90, "\n".join(rare)), (91, "\n".join([*rare, "own 91", frequent[0]]))]
    got = {r["doc_id"]: r["__kept"] for r in line_alignment.dedup_lines(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert got == {**{i: f"own {i}" for i in range(80)}, 0: texts[0][1], 90: texts[80][1], 91: "own 91"}


def test_runs_cover_every_block():
    rng = random.Random(15)
    for _ in range(300):
        sizes = [rng.choice([0, 5, 30, 60, 99, 100, 130]) for _ in range(rng.randint(0, 9))]
        hashes = [rng.randrange(1, 10**6) if n else 0 for n in sizes]
        block = [h for h in hashes if h]
        wanted = {h for h, n in zip(hashes, sizes, strict=True) if n >= 100} if sum(sizes) >= 100 else set(block)
        found = set(line_alignment.runs(hashes, sizes))
        for b in range(len(block)):
            for e in range(b + 2, len(block) + 1):
                if line_alignment.whole(block[b:e]) in found:
                    wanted |= set(block[b:e])
        assert wanted == set(block) and len(found) <= 2 * len(block) and (sum(sizes) >= 100 or not found)


def test_line_dedup_finds_blocks_of_lines_that_others_hold_first(spark):
    a, b, c = "a " * 28, "b " * 25 + "b", "c " * 28
    texts = [(1, f"own 1\n{a}\nx"), (2, f"own 2\n{b}\ny"), (3, f"own 3\n{c}\nz"), (4, f"own 4\n{a}\n{b}\n{c}"), (5, f"own 5\n{b}\nu\n{a}"), (6, f"own 6\n{a}\nv\n{b}"), (7, f"own 7\n{a}\n{b}\nw")]
    texts += [(100 + i, f"own {100 + i}\n{a}\n-{i}\n{b}") for i in range(70)] + [(200, f"own 200\n{a}\n{b}\nw 200")]
    got = {r["doc_id"]: r["__kept"] for r in line_alignment.dedup_lines(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert got == {**dict(texts), 7: "own 7\nw", 200: "own 200\nw 200"}


def test_line_dedup_on_odd_rows(spark):
    got = {(r["doc_id"], r["__kept"]) for r in line_alignment.dedup_lines(spark.createDataFrame(odd_documents(), DOCS)).collect()}
    assert (1, None) in got and (2, "") in got and (None, None) in got and (7, "") in got
    assert line_alignment.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_takes_each_budget(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 50)), "en", rng.choice(["b", "a", "é", None]), 0, 1, 2, "x", "y") for i in range(300)] + [(900, None, "en", "a", 0, 1, 2, "x", "y")] * 2
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    source = {r[0]: r[3] for r in rows}
    taken, sizes, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        sizes[s] += r["size"]
        target[s] = r["target"]
    wanted = mixing.targets(list(sizes.items()))
    assert all(taken[s] == int(wanted[s]) and target[s] == float(wanted[s]) for s in sizes)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    mixed = mixing.mixed(frame).collect()
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(taken.values())
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_targets_share_out_what_a_source_cannot_take():
    got = mixing.targets([("a", 10), ("b", 100), ("c", 100)])
    assert got["a"] == 20 and sum(got.values()) == 315 and got["b"] == 2 * got["c"] * 1 or got["b"] == 200


def test_archives_round_trip(spark):
    pages = [(1, "http://a.b/x\r\ny", "<p>same"), (5, None, "<p>same"), (3, "u", None), (2, "v", ""), (None, "w", "<p>same"), (8, "z", "é" * 50_000), (8, "z", "é" * 50_000)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    digest = {r["page_id"]: r["payload_digest"] for r in got}
    import base64

    assert digest[1] == base64.b32encode(hashlib.sha1(b"<p>same").digest()).decode()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [
        (-1, 7, "revisit", 5), (1, 7, "revisit", 5), (2, 0, "revisit", 3), (3, 0, "response", None), (5, 7, "response", None), (8, 100_000, "response", None), (8, 100_000, "response", None),
    ]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_use_their_dictionary():
    records = [warc.record(i, f"http://h/{i}", f"<html><body>page {i} of the same site</body></html>".encode() * 3, None, False) for i in range(300)]
    data = warc.archive(records)
    assert list(warc.read_archive(data))[1:] == records
    assert len(data) - warc.DICTIONARY_BYTES < sum(map(len, records)) / 4


def test_language_trees_code_exactly(spark):
    rng = random.Random(8)
    words = {"xx": ["der", "und", "haus", "strasse"], "yy": ["the", "and", "house", "street"], "zz": ["el", "casa", "y", "calle"]}
    rows = [(i, prose(rng, rng.randint(5, 60), words[lang]), lang, "s", 0, 1, 2, "x", "y") for i in range(150) for lang in [rng.choice(sorted(words))]]
    odd = [(1000, None, "xx", "s", 0, 1, 2, "x", "y"), (1001, "1234 !!", None, "s", 0, 1, 2, "x", "y"), (None, "the house", "yy", "s", 0, 1, 2, "x", "y")]
    got = language_ppm.identify(spark.createDataFrame(rows + odd, DOCS)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 10 and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["score"] == 0} == {1000: "und", 1001: "und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_ppm.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_rejects_unlearned_languages_and_junk(spark):
    rng = random.Random(17)
    letters = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(3, 9))) for _ in range(n))
    words = {lang: letters("etaoinshrdlucmf", 120).split() for lang in ("xx", "yy")}
    clean = [(i, prose(rng, rng.randint(3, 200), words[lang]), lang) for i in range(300) for lang in [rng.choice(sorted(words))]]
    clean += [(300, "A.", "xx"), (301, words["yy"][0], "yy")]
    junk = [letters("абвгдежзиклмн", 40), letters("abcdefghijklmnopqrstuvwxyz", 60), base64.b64encode(rng.randbytes(600)).decode(), " ".join(rng.randbytes(4).hex() for _ in range(50))]
    rows = [(i, t, lang, "s", 0, 1, 2, "x", "y") for i, t, lang in clean + [(1000 + k, t, None) for k, t in enumerate(junk)]]
    told = corpus_pipeline.known_language(spark, spark.createDataFrame(rows, DOCS), "").collect()
    scored = {r["doc_id"]: r["score"] for r in language_ppm.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert {r["doc_id"] for r in told} == {i for i, _, _ in clean if scored[i] >= 0.5}
    assert all(scored[1000 + k] >= 0.5 for k in range(len(junk)))


def test_code_lengths_match_a_plain_tree():
    samples = {"a": [b"abracadabra", b"abba"], "b": [b"banana band"]}
    scorer = language_ppm.Scorer(language_ppm.train(samples))
    counts = {n: defaultdict(Counter) for n in samples}
    for n, texts in samples.items():
        for t in texts:
            padded = b"\0\0\0" + t
            for i in range(3, len(padded)):
                for order in range(4):
                    counts[n][padded[i - order : i]][padded[i]] += 1

    def bits(n, context, byte):
        if len(context) == 0 and not counts[n][b""]:
            return 8.0
        seen = counts[n].get(context)
        shorter = (lambda: bits(n, context[1:], byte)) if context else (lambda: 8.0)
        if not seen:
            return shorter()
        total, kinds = sum(seen.values()), len(seen)
        if seen[byte]:
            return float(np.log2((total + kinds) / seen[byte]))
        return float(np.log2((total + kinds) / kinds)) + shorter()

    text = b"abandon zebra banana abra \xff" * 3
    padded = b"\0\0\0" + text
    want = [sum(bits(n, padded[i - 3 : i], padded[i]) for i in range(3, len(padded))) for n in ("a", "b")]
    assert np.allclose(scorer.totals([text, b""])[0], want)
    scorer.block = 7
    assert np.allclose(scorer.totals([text, b""])[0], want)


def quality_by_hand(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_counts_and_bands(spark, corpus):
    rng = random.Random(9)
    junk = "".join(chr(rng.randrange(33, 60_000)) + (" " if k % 6 == 0 else "") for k in range(4000)).encode("utf-8", "ignore").decode()
    docs = [*corpus, (900, "a # b\n\na # b\n \nc | d é 中"), (901, None), (902, ""), (903, junk), (904, "\n".join(prose(rng, 30) for _ in range(20)))]
    got = {r["doc_id"]: r for r in compression_bands.quality(spark.createDataFrame(rows_of(docs), DOCS)).collect()}
    for i, t in docs:
        r = got[i]
        want = quality_by_hand(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert got[904]["kept"] and not got[901]["kept"]
    assert compression_bands.quality(spark.createDataFrame([], DOCS)).count() == 0


def verdict_by_hand(text, bands):
    raw, press = text.encode(), lambda part: len(zstandard.compress(part, 3)) / len(part)
    n_words, *_, repeated = quality_by_hand(text)
    if n_words < 50 or 100 * repeated > 50 * n_words:
        return False

    def inside(part):
        start, low, high = max(b for b in bands if b[0] <= len(part))
        return low <= press(part) <= high

    bad = sum(len(part) for part in (raw[i : i + 4096] for i in range(0, len(raw), 4096)) if not inside(part))
    return inside(raw) and bad * 100 <= 5 * len(raw)


def test_quality_verdict_matches_brute_force(spark):
    """Prose, prose with garbage, tables of numbers and repeats of all lengths."""
    rng = random.Random(31)
    kinds = [lambda: rng.choice(["the", "and", "of"]), lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))), lambda: f"{rng.randrange(16**12):x}", lambda: rng.choice("éñü") * 4]
    texts = []
    for _ in range(250):
        parts = [kinds[rng.randrange(4)] for _ in range(rng.randint(1, 3))]
        texts.append(" ".join(part() for part in parts for _ in range(rng.choice([10, 60, 400, 3000]) // len(parts))))
    got = {r["doc_id"]: r["kept"] for r in compression_bands.quality(spark.createDataFrame(rows_of(enumerate(texts)), DOCS)).collect()}
    assert got == {i: verdict_by_hand(t, compression_bands.BANDS) for i, t in enumerate(texts)}
    assert 30 < sum(got.values()) < 220


def test_bands_can_be_fitted_to_another_script(spark):
    """Words of three bytes a character fall outside the given bands; bands fitted to such a corpus keep them and still reject garbage."""
    rng = random.Random(32)
    words = ["".join(chr(rng.randrange(0x4E00, 0x4E00 + 500)) for _ in range(rng.randint(1, 3))) for _ in range(2000)]
    clean = [prose(rng, rng.choice([60, 200, 800, 3000]), words) for _ in range(400)]
    junk = ["".join(chr(rng.randrange(0x4E00, 0x9000)) + (" " if k % 3 == 0 else "") for k in range(n)) for n in (300, 1500, 6000)]
    docs = spark.createDataFrame(rows_of(enumerate(clean)), DOCS)
    bands = compression_bands.fit_bands(docs, outside=0.0, least=20)
    assert [b[0] for b in bands] == [b[0] for b in compression_bands.BANDS] and bands != compression_bands.BANDS
    texts = clean + junk + [None, ""]
    got = [r["kept"] for r in compression_bands.quality(spark.createDataFrame(rows_of(enumerate(texts)), DOCS), bands).orderBy("doc_id").collect()]
    assert got == [True] * len(clean) + [False] * 5
    assert got[0] == verdict_by_hand(clean[0], bands)
    assert compression_bands.fit_bands(docs.limit(0)) == compression_bands.BANDS


def test_quality_rejects_half_garbage_and_hex(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    hexes = lambda n: " ".join(rng.randbytes(4).hex() for _ in range(n // 9 + 1))[:n]
    base64s = lambda n: " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(n // 9 + 1))[:n]
    text = lambda n: prose(rng, n // 3, words)[:n]
    bad = [hexes(80_000), hexes(9_000), base64s(8_000), "".join(text(4096) + base64s(4096) for _ in range(10)), text(4_000) + base64s(4_000)]
    bad += [text(4_000) + base64s(3_000), text(4096 * 20) + base64s(4096 * 2), text(4096 * 2) + base64s(1_500)]
    clean = [text(n) for n in (700, 1_500, 3_000, 6_000, 8_300, 20_000, 80_000)]
    got = {r["doc_id"]: r["kept"] for r in compression_bands.quality(spark.createDataFrame(rows_of(enumerate(bad + clean)), DOCS)).collect()}
    assert got == {i: i >= len(bad) for i in range(len(bad + clean))}


def test_packing_places_every_id_once(spark, corpus):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(10)
    docs = [*corpus, (900, None), (901, ""), (902, prose(rng, 3000)), (903, "It's\u00a0we'll\x1cx <|endoftext|>é\u0301 中文 İ 1234"), (None, "x")]
    got = packing.pack(spark.createDataFrame(rows_of(docs), DOCS), path).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in docs:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_shortest_pack_first_uses_the_whole_histogram():
    rng = random.Random(11)
    histogram = {rng.randint(1, 2048): rng.randint(1, 10**9) for _ in range(500)}
    patterns = packing.shortest_pack_first(histogram)
    placed = Counter()
    for count, contents in patterns:
        assert sum(length * times for length, times in contents) <= 2048
        for length, times in contents:
            placed[length] += count * times
    assert placed == Counter(histogram) and len(patterns) < 4096


def vectors(spark, rows):
    return impact_topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(impact_topk, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(impact_topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(impact_topk, "SAMPLE_VECTORS", 32)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 16))
    data = [(i, [float(x) for x in np.float32(centres[i % 5] + rng.normal(size=16) * 0.1)], 0) for i in range(400)]
    data += [(400 + i, data[0][1], 0) for i in range(8)] + [(50, data[50][1], 0), (50, data[51][1], 0)]
    odd = [(1000, None, 0), (1050, [1.0, None], 0), (1100, [float("nan")], 0), (1150, [float("inf")], 0), (None, [1.0], 0), (1200, [], 0), (1250, [0.5, -0.5], 0)]
    frame = vectors(spark, data + odd)
    got = impact_topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5).collect()
    whole = [(i, np.floor(256 * np.pad(np.array(np.float32(v), np.float64), (0, 16 - len(v)))).astype(np.int64)) for i, v, _ in data + odd[-2:]]
    want = Counter()
    for at, (q, query) in enumerate(whole):
        if q % 50 == 0:
            order = sorted((-int(v @ query), i) for other, (i, v) in enumerate(whole) if other != at)[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(order))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    nothing = vectors(spark, [])
    assert impact_topk.top_k(nothing, nothing, 5).count() == 0


def test_top_k_is_exact_at_any_component(spark, monkeypatch):
    """Components from 1e-3 to 1e7, vectors whose terms nearly cancel, and few distinct scores, against Python integers."""
    monkeypatch.setattr(impact_topk, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(impact_topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(impact_topk, "SAMPLE_VECTORS", 24)
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=12) * 10.0 ** rng.uniform(-3, 6, size=12)) for i in range(300)]
    for i in range(300, 600):  # x and -x against equal query components: large terms, tiny scores
        x = rng.normal(size=6) * 1e6
        data.append((i, np.concatenate((x, -x + rng.integers(-2, 3, size=6) / 256))))
    for i in range(600, 640, 1):
        data.append((i, np.full(12, 1e6) if i % 2 else np.ones(12)))
    data += [(700, [2e6] * 1), (750, [1.0]), (760, [3e6]), (770, [1e7]), (800, [-1e7] * 12)]
    frame = impact_topk.integer_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in data], "vec_id long, embedding array<double>"))
    got = impact_topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5).collect()
    whole = [(i, [int(np.floor(256 * float(x))) for x in v] + [0] * (12 - len(v))) for i, v in data]
    want = set()
    for q, query in whole:
        if q % 50 == 0:
            order = sorted((-sum(a * b for a, b in zip(v, query, strict=True)), i) for i, v in whole if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(order)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_top_k_refuses_what_a_long_does_not_hold(spark):
    beyond = spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        impact_topk.integer_vectors(beyond)
    big = impact_topk.integer_vectors(spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond a long"):
        impact_topk.top_k(big, big, 5).collect()


def test_blocks_end_early_on_proof():
    """On like vectors most blocks are skipped, and what is left is scored for few pairs."""
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=(2000, 64)) * 32).astype(np.int64)
    block = impact_topk.Block(np.arange(2000), np.arange(2000), values)
    queries = np.round(rng.normal(size=(20, 64)) * 32).astype(np.int64)
    scores = queries @ values.T
    bars = np.sort(scores, axis=1)[:, -6]
    of, rows, found = block.members(queries, np.full(20, -1), 5, bars)
    assert len(of) <= 20 * 2000 * impact_topk.POSSIBLE_SHARE and np.array_equal(found, scores[of, rows])
    assert {(q, r) for q, r in zip(of.tolist(), rows.tolist(), strict=True)} >= {(q, r) for q in range(20) for r in np.flatnonzero(scores[q] >= bars[q]).tolist()}
    assert len(block.members(queries, np.full(20, -1), 5, np.full(20, 10**7))[0]) == 0


def test_urls_and_rules(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q#f", "allow", "example.net/en/"), (2, "http://b.net/y", "block", "net/"), (3, "http://b.net", "allow", None), (4, None, "allow", None),
        (5, "no scheme", "allow", None), (6, "x://org/fr/", "allow", "org/fr/"), (7, "http://notexample.com/de/", "allow", None), (8, "", "allow", None), (1, "http://b.net/y", "block", "net/"),
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u, _, _ in urls], "page_id long, url string, html string")
    got = url_rules.judge(pages, url_rules.page_links(pages), url_rules.rule_table(spark)).collect()
    assert Counter((r["page_id"], r["verdict"], r["rule"]) for r in got) == Counter((i, v, r) for i, _, v, r in urls)
    assert {(r["host"], r["path"]) for r in got if r["page_id"] == 6} == {("org", "/fr/")}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.judge(empty, url_rules.page_links(empty), url_rules.rule_table(spark)).count() == 0


def test_blocks_spread_to_aliases_but_not_over_an_allow(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://bad.net/a", "<p>"), (2, "http://alias.io/b", '<head><link href="http://bad.net/a" rel="canonical">'), (3, "http://far.io/c?x=1", "<meta http-equiv='refresh' content='0; url=//alias.io/b'>"),
            (4, "http://example.net/en/d", '<LINK REL=canonical HREF=http://bad.net/a>'), (5, "http://free.io/", '<link rel="canonical" href="/e">'), (6, "http://free.io/e", None), (7, "https://far.io/c?x=1#top", "<p>"),
        ],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, url_rules.page_links(pages), url_rules.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_url_rules_run_without_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>")], "page_id long, url string, html string")
    plan = url_rules.judge(pages, url_rules.page_links(pages), url_rules.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_cuts_very_long_texts(spark):
    text = " \t" + "\n ".join(f"w{i}" for i in range(200_000)) + "  "
    rows = [(1, "a", text), (2, "b", text), (3, None, text)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    for doc_id, n in taken.items():
        texts = [r["text"] for r in got if r["doc_id"] == doc_id]
        assert sum(len(t.split()) for t in texts) == n and all(text.startswith(t) for t in texts)
    assert any(0 < n % 200_000 for n in taken.values())
