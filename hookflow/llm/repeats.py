"""Removal of repeated byte strings by a sparse enhanced suffix array.

Every window of 200 bytes has an anchor: the leftmost of its 64-byte strings with the smallest hash. Equal windows have equal
anchors at equal offsets, so only suffixes that start at an anchor need sorting, and of these only those whose anchor occurs
twice. Spark sorts them by anchor and by the bytes that follow (the suffix array); a scan with a stack walks the tree of
common-prefix intervals. Inside an interval, whose members agree for ``d`` bytes from their anchors on, members are ordered by
the bytes before the anchor: where those differ the repeat is maximal to the left, and each member's longest agreement ``l`` with a
neighbour gives the repeat it belongs to. A member loses ``l`` bytes before and ``d`` bytes from its anchor on if l + d >= 200. For any other
occurrence of a window the two meet in exactly one such interval, so the result is exact.

Equal texts are one class from the start. A group of very many equal anchors is not scanned by one task: its windows are
counted by their 128-bit hashes instead, combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookflow.llm.common import mix, utf8, written

LENGTH = 200
ANCHOR = 64
_SIDE = LENGTH - ANCHOR
_BLOCK = 1 << 20  # bytes of one text that are hashed at once
_BASE = 0x9E3779B97F4A7C15
HOT_GROUP = 100_000  # occurrences of one anchor (about 35 MB) beyond which its windows are counted instead of scanned


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    np.multiply.accumulate(np.full(count - 1, base & (2**64 - 1), np.uint64), out=out[1:])
    return out


class Anchors:
    """Positions and hashes of the anchors of a text."""

    def __init__(self):
        size = _BLOCK + LENGTH
        self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        self.index = np.arange(size, dtype=np.uint64)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = [self._block(text[s : s + _BLOCK + LENGTH - 1], s) for s in range(0, len(text) - LENGTH + 1, _BLOCK)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(found) == 1:
            return found[0]
        at, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        return at, np.concatenate([f[1] for f in found])[first]

    def _block(self, text: bytes, offset: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        count = n - ANCHOR + 1
        hashes = mix((sums[ANCHOR:] - sums[:count]) * self.down[:count])
        # The low bits hold the place, so that a minimum names it and the leftmost of equal strings wins.
        low = (hashes & ~np.uint64((1 << 21) - 1)) | self.index[:count]
        width, want = 1, _SIDE + 1
        while width * 2 <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
        at = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        return at + offset, hashes[at]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors()
    for batch in batches:
        shas, places, hashes = [], [], []
        for text in utf8(batch.column(1)):
            at, h = anchors(text or b"")
            shas.append(hashlib.sha256(text or b"").digest())
            places.append(at.astype(np.int32))
            hashes.append(h.view(np.int64))
        ends = pa.array(np.cumsum([0, *map(len, places)]).astype(np.int32))
        at, h = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((places, np.int32), (hashes, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(shas, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(h))],
            ["doc_id", "sha", "at", "anchor"],
        )


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each occurrence of a repeated anchor the bytes before it, reversed, and those from it on."""
    for batch in batches:
        rows = []
        for cls, text, hits in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for hit in hits:
                at = hit["at"]
                rows.append((hit["anchor"], hit["n"], cls, at, text[max(0, at - _SIDE) : at][::-1], text[at : at + LENGTH]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "n", "cls", "at", "before", "after"])


FRAGMENT_LAYOUT = "anchor long, n long, cls long, at long, before binary, after binary"


def agreement(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of suffixes in order; lcp[i] belongs to suffixes i - 1 and i, lcp[0] is not read."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeat_spans(members: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(cls, start, end) of the bytes that repeats of one anchor take. ``members``: (cls, at, before, after) sorted by ``after``; all
    spans of one member contain its anchor, so their union is one span."""
    if len(members) < 2:
        return
    lcp = [0, *(agreement(a[3], b[3]) for a, b in zip(members, members[1:], strict=False))]
    left, right = [0] * len(members), [0] * len(members)
    for depth, first, last in intervals(lcp):
        if depth + _SIDE < LENGTH:
            continue
        order = sorted(range(first, last + 1), key=lambda i: members[i][2])
        best = [0] * len(order)
        for k in range(1, len(order)):
            common = agreement(members[order[k - 1]][2], members[order[k]][2])
            best[k - 1], best[k] = max(best[k - 1], common), common
        for k, i in enumerate(order):
            if best[k] + depth >= LENGTH:
                left[i], right[i] = max(left[i], best[k]), max(right[i], depth)
    for i, (cls, at, _, _) in enumerate(members):
        if right[i]:
            yield cls, at - left[i], at + right[i]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, ``after`` and ``before``. A class and place that come twice, from a row that does, count once."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True)

    def packed(spans):
        columns = list(zip(*spans, strict=True)) if spans else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "start", "end"])

    out = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        members = {(r[1], r[2]): r[1:] for r in group}
        out.extend(repeat_spans(list(members.values())))
        if len(out) >= 10_000:
            yield packed(out)
            out = []
    yield packed(out)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows that hold the anchor of a hot group."""
    for batch in batches:
        seen, rows = set(), []
        for cls, at, before, after in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            if (cls, at) in seen:
                continue
            seen.add((cls, at))
            around, start = before[::-1] + after, at - len(before)
            for i in range(len(around) - LENGTH + 1):
                rows.append((xxhash.xxh3_128_digest(around[i : i + LENGTH]), cls, start + i))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["window", "cls", "start"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, copies, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            text = text or b""
            if len(text) >= LENGTH and (copies or 0) > 1:
                runs = [(0, len(text))]
            else:
                runs = merged([(s["start"], s["end"]) for s in spans or []])
            kept, at = [], 0
            for start, end in runs:
                kept.append(text[at:start])
                at = end
            kept.append(text[at:])
            rows.append((len(text), sum(e - s for s, e in runs), len(runs), b"".join(kept)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        numbers = [pa.array(c, pa.int64()) for c in columns[:3]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(columns[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes) for every row of ``docs``.

    A byte goes if a 200-byte string that covers it also starts anywhere else in the table, the same text included. Reads doc_id and
    text. A null text is empty; texts under 200 bytes keep everything. Repeated rows are copies of each other: each loses all of its text if
    that has 200 bytes. ``kept`` is bytes, as a cut may fall inside a character.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = rows.mapInArrow(_profile, "doc_id long, sha binary, at array<int>, anchor array<long>").where(F.size("at") > 0)
    grouped = profile.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("holder"), F.first("at").alias("at"), F.first("anchor").alias("anchor"))
    # The class number is fixed by being written.
    classes = written(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    entries = classes.select("cls", F.explode(F.arrays_zip("at", "anchor")).alias("e")).select("cls", "e.at", "e.anchor")
    counts = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = entries.join(counts, "anchor").groupBy("cls").agg(F.collect_list(F.struct("at", "anchor", "n")).alias("hits"))
    hits = written(hits.join(classes.select("cls", "sha", "holder"), "cls"), "hits")

    by_sha = rows.where(F.octet_length("text") >= LENGTH).withColumn("sha", F.unhex(F.sha2("text", 256)))
    # One row of each class gives its fragments; of rows that repeat it as they are the scan takes every place once.
    texts = by_sha.join(hits, "sha").where(F.col("doc_id").eqNullSafe(F.col("holder"))).select("cls", "text", "hits")
    fragments = texts.mapInArrow(_fragments, FRAGMENT_LAYOUT)
    scanned = fragments.where(F.col("n") <= HOT_GROUP).repartition("anchor").sortWithinPartitions("anchor", "after", "before")
    spans = scanned.mapInArrow(_scan, "cls long, start long, end long")
    hot = hits.select(F.explode("hits.n").alias("n")).where(F.col("n") > HOT_GROUP)
    if not hot.isEmpty():
        windows = fragments.where(F.col("n") > HOT_GROUP).mapInArrow(_window_rows, "window binary, cls long, start long").distinct()
        again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        spans = spans.unionByName(windows.join(again, "window").select("cls", "start", (F.col("start") + LENGTH).alias("end")))
    by_class = spans.groupBy("cls").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    told = written(classes.select("cls", "sha", "copies").join(by_class, "cls", "left").where("copies > 1 or spans is not null").drop("cls"), "spans")
    full = rows.withColumn("sha", F.unhex(F.sha2("text", 256))).join(told, "sha", "left")
    return full.select("doc_id", "text", "copies", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
