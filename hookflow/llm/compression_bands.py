"""Quality rules by compression: zstandard ratios of the whole text and of fixed chunks, held against limits for its length.

Text that repeats itself compresses too well, random strings compress too little. A text is rejected as a whole or for its bad chunks. How well ordinary prose compresses depends on
its length, so limits are given by bands of UTF-8 length. Very short texts say nothing and pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookflow.llm.common import utf8, window_hashes, word_hashes

LEVEL = 3
CHUNK_BYTES = 4096
# (from this many UTF-8 bytes on, lowest and highest compressed / raw ratio of ordinary prose). The highest are 3 to 5 per cent above those of
# all whole texts and chunks of the length in 0.6 GB of documents; under 64 bytes all is let through.
BANDS = (
    (0, 0.0, 9.0), (64, 0.0, 1.18), (128, 0.0, 1.07), (256, 0.20, 0.86), (512, 0.20, 0.745), (1024, 0.14, 0.645),
    (2048, 0.14, 0.58), (4096, 0.10, 0.54), (8192, 0.10, 0.49), (16384, 0.10, 0.465), (32768, 0.08, 0.455),
)
# Share of bytes, in per cent, that may lie in chunks outside the band of their length before the text is rejected.
MAX_BAD_BYTES = 5
_SYMBOLS = b"#*$%&|<>"
SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())]
)
LAYOUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


Bands = tuple[tuple[int, float, float], ...]
# Steps that a ratio of 1 is counted in when bands are fitted.
STEPS = 1000


def band(n_bytes: int, bands: Bands = BANDS) -> int:
    """The number of the band of this length."""
    return bisect_right([start for start, _, _ in bands], n_bytes) - 1


def within(ratio: float, n_bytes: int, bands: Bands = BANDS) -> bool:
    _, lo, hi = bands[band(n_bytes, bands)]
    return lo <= ratio <= hi


def _repeat_words(words: list[bytes]) -> int:
    """Words inside a three-word window that the text holds twice or more."""
    if len(words) < 4:
        return 0
    _, inverse, counts = np.unique(window_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
    marked = np.zeros(len(words), bool)
    again = counts[inverse] > 1
    for i in range(3):
        marked[i : i + len(again)] |= again
    return int(marked.sum())


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def ratios(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """The ratio of the whole text, and (bytes, ratio) of its chunks."""
    ratio = len(compressor.compress(text)) / len(text) if text else 0.0
    chunks = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
    if len(chunks) == 1:
        return ratio, [(len(text), ratio)]
    return ratio, [(len(c), len(compressor.compress(c)) / len(c)) for c in chunks]


def judge(text: bytes, compressor: zstandard.ZstdCompressor, bands: Bands = BANDS) -> tuple:
    """Everything but the doc_id of one row."""
    words = text.split()
    n_words, joined = len(words), b"".join(words)
    chars, symbols = len(joined.decode()), len(text) - len(text.translate(None, _SYMBOLS))
    repeated = _repeat_words(words)
    base_failed = n_words < 50 or 100 * repeated > 50 * n_words
    ratio, chunks = ratios(text, compressor)
    bad = [n for n, r in chunks if not within(r, n, bands)]
    passed = within(ratio, len(text), bands) and 100 * sum(bad) <= MAX_BAD_BYTES * len(text)
    return (n_words, chars, symbols, _dup_lines(text), repeated, base_failed, not base_failed and passed, ratio, len(chunks), len(bad))


def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)


def _judged(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor()
        for batch in batches:
            rows = [judge(t or b"", compressor, bands) for t in utf8(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * (len(SCHEMA) - 1)
            arrays = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

    return run


def quality(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, n_chunks, n_bad_chunks.

    One row for each row of ``docs``, of which doc_id and text are read; no shuffle. A null or empty text has no words, fails the base rules
    and is not kept. Chunks are of 4096 bytes; what remains at the end is one more, held against the band of its own length. ``bands`` may be those that
    ``fit_bands`` finds for a corpus.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judged(bands), LAYOUT)


def _counted(starts: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, counts = _compressor(), Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                ratio, chunks = ratios(text or b"", compressor)
                parts = chunks if len(chunks) < 2 else [(len(text), ratio), *chunks]
                counts.update((band(n, starts), int(r * STEPS)) for n, r in parts)
        rows = [(b, step, n) for (b, step), n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["band", "step", "n"])

    return run


def fit_bands(docs: DataFrame, outside: float = 0.001, margin: float = 0.04, least: int = 1000, bands: Bands = BANDS) -> Bands:
    """Bands for the corpus ``docs``: in each band of length the ratios of all texts and chunks but the share ``outside`` at either end, widened
    by ``margin``. A band with fewer than ``least`` texts and chunks keeps its limits of ``bands``.

    Ratios are counted in steps of a thousandth over the whole corpus, by band: exact quantiles of the steps, from at most a few thousand rows, whatever
    the input. Reads text only; null and empty texts say nothing.
    """
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_counted(bands), "band long, step long, n long")
    found: dict[int, list[tuple[int, int]]] = {}
    for row in counted.groupBy("band", "step").agg(F.sum("n").alias("n")).orderBy("band", "step").collect():
        found.setdefault(row["band"], []).append((row["step"], row["n"]))
    out = []
    for number, (start, lo, hi) in enumerate(bands):
        steps = found.get(number, [])
        total = sum(n for _, n in steps)
        if total >= max(1, least):
            seen, low, high = 0, None, None
            for step, n in steps:
                seen += n
                low = step if low is None and seen > outside * total else low
                high = step if high is None and seen >= (1 - outside) * total else high
            lo, hi = low / STEPS * (1 - margin), (high + 1) / STEPS * (1 + margin)
        out.append((start, lo, hi))
    return tuple(out)
