"""Fill-in-middle transformation: texts are cut by a learned rank index over all their code-point boundaries.

The texts of a batch lie in one buffer. A code point's rank says nothing of its byte offset in UTF-8, so the offsets of all boundaries are
learned: a greedy cone fits straight segments that miss no boundary by more than ``BOUND`` bytes, and what is missed is stored, a byte for
each boundary. A cut is then predicted from its segment and corrected exactly by its residual, for all texts of the batch at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.llm.common import pieces, utf8

BOUND = 120  # bytes that a segment may miss a boundary by; a residual fits one byte
_LONGEST = 1 << 22  # boundaries in a segment, so that fixed-point products fit a long
_POINT = 32  # bits after the point of a slope
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
LAYOUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex:
    """Byte offsets of boundaries by their rank: straight segments of bounded error and a residual for each boundary."""

    def __init__(self, offsets: np.ndarray, bound: int = BOUND):
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            end, slope = _segment(offsets, at, bound)
            starts.append(at)
            slopes.append(round(slope * (1 << _POINT)))
            at = end
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes, np.int64)
        self.bases = offsets[self.starts] if len(offsets) else np.empty(0, np.int64)
        missed = offsets - self.predicted(np.arange(len(offsets)))
        self.residuals = missed.astype(np.int8)
        if not np.array_equal(self.residuals, missed):
            raise ValueError(f"a bound of {bound} bytes does not fit residuals of one byte")

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[segment] + ((ranks - self.starts[segment]) * self.slopes[segment] >> _POINT)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of the boundaries of these ranks."""
        return self.predicted(ranks) + self.residuals[ranks]


def _segment(offsets: np.ndarray, start: int, bound: int) -> tuple[int, float]:
    """End and slope of the longest segment from ``start`` on whose line through the first boundary misses none by more than the bound."""
    low, high, at, width = -np.inf, np.inf, start + 1, 1 << 12
    last = min(len(offsets), start + _LONGEST)
    while at < last:
        stop = min(last, at + width)
        run = np.arange(at - start, stop - start, dtype=np.float64)
        rise = (offsets[at:stop] - offsets[start]).astype(np.float64)
        lows = np.maximum(np.maximum.accumulate((rise - bound) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + bound) / run), high)
        closed = np.flatnonzero(lows > highs)
        if len(closed):
            if closed[0]:
                low, high = lows[closed[0] - 1], highs[closed[0] - 1]
            at += int(closed[0])
            break
        low, high, at, width = lows[-1], highs[-1], stop, width * 2
    return at, 1.0 if np.isinf(low) else (low + high) / 2


def boundaries(text: bytes) -> np.ndarray:
    """Offsets of all code points of UTF-8 text, and its end."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(text)).astype(np.int64)


def _draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _transformed(seed: int, plain: int, spm: int):
    prefix_mark, suffix_mark, middle_mark = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in utf8(batch.column(1))]
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            found = boundaries(b"".join(texts))
            index = RankIndex(found)
            first = np.searchsorted(found, np.concatenate((np.zeros(1, np.int64), ends)))  # rank of each text's start, and of the end
            draws = np.array([_draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            units = np.diff(first)
            cuts = np.sort(draws[:, :2] % (units + 1)[:, None], axis=1)
            places = index.offsets(first[:-1, None] + cuts) - (ends - [len(t) for t in texts])[:, None] if texts else cuts
            rows = []
            for doc_id, text, n, (h3, h4), (a, b), (x, y) in zip(
                ids, texts, units.tolist(), draws[:, 2:].tolist(), cuts.tolist(), places.tolist(), strict=True
            ):
                if not text or h3 % 100 >= 100 - plain or prefix_mark in text or suffix_mark in text or middle_mark in text:
                    rows.append((doc_id, n, "plain", None, None, text))
                    continue
                prefix, middle, suffix = text[:x], text[x:y], text[y:]
                if h4 % 100 < spm:
                    form, out = "spm", (suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)
                else:
                    form, out = "psm", (prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)
                rows.append((doc_id, n, form, a, b - a, b"".join(out)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[5], pa.binary()).view(pa.string())], [c.split()[0] for c in LAYOUT.split(", ")])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output (the transformed text) for every row of ``docs``.

    Reads doc_id and text only; no shuffle. A null text is empty; an empty text, and one that holds a sentinel, is plain, with null prefix_chars
    and middle_chars. Cuts are drawn from doc_id and ``seed`` alone, so repeated rows are cut alike and a null doc_id counts as an empty number.
    ``plain`` and ``spm`` are per cent of the texts. Texts are taken in pieces of 8 MB; a longer text makes a piece of its own. An empty table
    gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(_transformed(seed, plain, spm), LAYOUT)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of. Sentinels occur in no text that was cut, so they part the output exactly."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
