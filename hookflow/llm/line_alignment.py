"""Line dedup by pairwise alignment.

Documents overlap if they share lines. A document is paired with the first document that holds each of its lines, with the first holder of
each of its shortest runs of lines that are long enough to be cut, and with the first copy of itself as a whole. Every line of a block that an earlier
document holds lies in such a line or run, so the block has a pair; pairs are linear in the number of lines, however many copies there are. Each pair is aligned by patience diff over line hashes, and the aligned blocks go
from the later document. As the first holder of a line is never the later one of a pair, one copy of every line stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookflow.llm.common import discard, packed, refuse, unpacked, utf8, written

# An aligned block of fewer bytes stays.
MIN_BLOCK_BYTES = 100
_LAST = (1 << 63) - 1


def line_hashes(text: bytes) -> list[int]:
    """A hash of each line without the white space around it; 0 for a blank line."""
    return [xxhash.xxh3_64_intdigest(s) - (1 << 63) or 1 if (s := line.strip()) else 0 for line in text.split(b"\n")]


def whole(hashes: list[int]) -> int:
    """A hash that only texts of the same lines have, blank ones aside."""
    return xxhash.xxh3_64_intdigest(np.array([h for h in hashes if h], np.int64).tobytes()) - (1 << 63)


def runs(hashes: list[int], sizes: list[int], least: int = MIN_BLOCK_BYTES) -> list[int]:
    """Hashes of the runs of two or more lines, blank ones aside, of at least ``least`` bytes: from each line on the shortest, and up to each
    line the shortest. Together with the single lines of that size they cover every line of any block of so many bytes."""
    held = [(h, n) for h, n in zip(hashes, sizes, strict=True) if h]
    values, ends = np.array([h for h, _ in held], np.int64), np.cumsum([0, *(n for _, n in held)])
    at = np.arange(len(held))
    stop = np.searchsorted(ends, ends[:-1] + least)  # line i to line stop - 1
    start = np.searchsorted(ends, ends[1:] - least, "right") - 1  # line start to line i
    found = {(i, e) for i, e in zip(at.tolist(), stop.tolist()) if e <= len(held)} | {(b, i + 1) for i, b in zip(at.tolist(), start.tolist()) if b >= 0}
    return sorted({xxhash.xxh3_64_intdigest(values[b:e].tobytes()) - (1 << 63) for b, e in found if e - b > 1})


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b), ascending in both: equal ends, then lines unique on both sides in longest increasing order,
    then the same between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {h: k for k, h in enumerate(b[j:j_end], j) if h and in_b[h] == 1 and in_a.get(h) == 1}
        unique = [(k, place[h]) for k, h in enumerate(a[i:i_end], i) if h in place]
        if not unique:
            continue
        tails: list[int] = []
        last: list[int] = []
        parent = [-1] * len(unique)
        for k, (_, p) in enumerate(unique):
            at = bisect_left(tails, p)
            parent[k] = last[at - 1] if at else -1
            tails[at : at + 1], last[at : at + 1] = [p], [k]
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(unique[k])
            k = parent[k]
        chain.reverse()
        for (p, q), (p_end, q_end) in zip([(i, j), *((p + 1, q + 1) for p, q in chain)], [*chain, (i_end, j_end)], strict=True):
            todo.append((p, p_end, q, q_end))
        out.extend(chain)
    return sorted(out)


def common_blocks(later: list[int], sizes: list[int], earlier: list[int], least: int = MIN_BLOCK_BYTES) -> list[tuple[int, int]]:
    """[start, end) of the later text's lines in aligned blocks of at least ``least`` bytes; ``sizes`` are its lines' bytes."""
    blocks: list[list[int]] = []
    for i, j in patience(later, earlier):
        if blocks and blocks[-1][1] == i and blocks[-1][2] == j:
            blocks[-1][1:] = i + 1, j + 1
        else:
            blocks.append([i, i + 1, j + 1])
    return [(s, e) for s, e, _ in blocks if sum(sizes[s:e]) >= least]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in utf8(batch.column(2))]
        hashes = [line_hashes(t) for t in texts]
        sizes = [[len(s.strip()) for s in t.split(b"\n")] for t in texts]
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        longer = [runs(h, n) for h, n in zip(hashes, sizes, strict=True)]
        columns = [pa.array(hashes, longs), pa.array(sizes, ints), pa.array(longer, longs), pa.array(map(whole, hashes), pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc", "tie", "lines", "sizes", "runs", "whole"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, tie, lines, sizes, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            out.extend((doc, tie, s, e) for s, e in common_blocks(lines, sizes, first))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "tie", "start", "end"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, total, removed = [], [], []
        for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if text is None:
                kept.append(None)
                total.append(0)
                removed.append(0)
                continue
            lines = text.split(b"\n")
            gone = np.zeros(len(lines), bool)
            for span in spans or []:
                gone[span["start"] : span["end"]] = True
            kept.append(b"\n".join(line for line, g in zip(lines, gone, strict=True) if not g) if gone.any() else text)
            total.append(len(lines))
            removed.append(int(gone.sum()))
        found = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["row", "kept", "total", "removed"])


def dedup_lines(docs: DataFrame, kept: str = "__kept", total: str = "__total", removed: str = "__removed") -> DataFrame:
    """All columns of ``docs`` but text, and ``kept`` (the text without the blocks it shares with earlier documents), ``total`` and ``removed`` (lines).

    Documents are ordered by doc_id, a null one last, then by a hash of their text: different texts of one doc_id, or of none, are held
    against each other, repeated rows are one document and have the same result. Lines end at "\\n" and are compared without white space around them.
    A null text stays null, an empty one empty; a document whose lines are all shared is left with an empty text. Other columns may have any
    name but those of the results, which are refused. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "text"]
    refuse(others, kept, total, removed)
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    keyed = docs.select(packed(others).alias("row"), doc.alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    layout = "doc long, tie long, lines array<long>, sizes array<int>, runs array<long>, whole long"
    lines = written(keyed.where("text is not null").select("doc", "tie", "text").mapInArrow(_lines, layout), "lines")
    place = F.struct("doc", "tie")
    held = lines.select(place.alias("doc"), F.explode(F.array_distinct(F.concat("lines", "runs", F.array("whole")))).alias("line")).where("line <> 0")
    # A line held more than once; repeated rows are one place, so their lines have no other holder.
    shared = held.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    seeds = held.join(shared.select("line", "first"), "line").where("doc > first")
    pairs = written(seeds.select("doc", "first").distinct(), "pairs")
    one = lines.dropDuplicates(["doc", "tie"])
    firsts = one.select(place.alias("first"), F.col("lines").alias("first_lines"))
    later = one.select(place.alias("doc"), "lines", "sizes")
    meetings = pairs.join(later, "doc").join(firsts, "first").select("doc.*", "lines", "sizes", "first_lines")
    blocks = meetings.mapInArrow(_aligned, "doc long, tie long, start long, end long")
    spans = written(blocks.distinct().groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(lines, pairs)
    # The same plan at every size: texts move once.
    full = keyed.hint("merge").join(spans, ["doc", "tie"], "left").select("row", "text", "spans")
    kinds = [("kept", T.StringType()), ("total", T.LongType()), ("removed", T.LongType())]
    cut = full.mapInArrow(_cut, T.StructType([full.schema["row"], *(T.StructField(name, kind) for name, kind in kinds)]))
    return unpacked(cut, F.col("kept").alias(kept), F.col("total").alias(total), F.col("removed").alias(removed))
