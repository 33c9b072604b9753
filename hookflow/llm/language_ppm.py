"""Language ID by prediction by partial matching: variable-order byte context trees, one per language.

A tree holds, for every context of up to three bytes seen in training, how often each byte followed. A byte's code length is that
of its longest seen context; where the context never saw it, the escape is paid and the next shorter context is asked, down to
uniform bytes. A context with ``total`` bytes of ``kinds`` different values codes a byte seen c times with c / (total + kinds) and escapes
with kinds / (total + kinds). Statistics are frozen after training, so the code length of a byte depends on the four bytes
that end in it only, and the trees become tables that all languages share: code lengths of seen windows and escapes of seen
contexts, looked up for whole batches of text at once. The language with the shortest exact code of the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookflow.llm.common import packed, refuse, utf8

ORDER = 3
# Bounds of the training sample: about so many documents of each language, chosen by hash, and so many characters of each.
TRAIN_DOCS, TRAIN_CHARS = 400, 20_000
UNDETERMINED = "und"
# A text is foreign to its winner if its code, but for the first bits, takes over MARGIN times as many bits a byte as all but LOOSE_SHARE of
# the rows labelled so; code lengths are counted in steps of 1/STEPS bit.
FREE_BITS, LOOSE_SHARE, MARGIN, STEPS = 32, 0.01, 2.0, 64
_BLOCK_CELLS = 1 << 22  # bytes scored at once, times languages
_SPREAD = np.uint32(0x9E3779B1)


class _Lookup:
    """Row numbers of uint32 keys by open addressing, for many keys at once; absent keys get row len(keys)."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.rows = np.full(size, len(keys), np.int32)
        self.keys = np.zeros(size, np.uint32)
        self.absent, self.steps = len(keys), 0
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = self._slot(keys[left])
            at = (at + self.steps) & (size - 1)
            free = self.rows[at] == self.absent
            self.rows[at[free]], self.keys[at[free]] = left[free], keys[left[free]]
            left = left[self.rows[at] != left]
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint32(32 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.rows[slot], self.absent)
        for step in range(1, self.steps):
            left = np.flatnonzero(found == self.absent)
            if not len(left):
                break
            at = (slot[left] + step) & (len(self.rows) - 1)
            found[left] = np.where(self.keys[at] == keys[left], self.rows[at], self.absent)
        return found


def windows(text: bytes, order: int = ORDER) -> np.ndarray:
    """The uint32 of each byte and the ``order`` bytes before it; the text is taken to follow zero bytes."""
    b = np.frombuffer(b"\0" * order + text, np.uint8).astype(np.uint32)
    w = np.zeros(len(text), np.uint32)
    for i in range(order + 1):
        w = (w << np.uint32(8)) | b[i : i + len(text)]
    return w


def train(samples: dict[str, list[bytes]]) -> tuple:
    """Tables of all languages' trees: names, then for each order its window keys with code lengths in bits and its context keys with
    escape bits, a column per language. A missing window means the context's escape plus the next shorter order."""
    names = sorted(samples)
    grams = {}
    for name in names:
        every = np.concatenate([windows(t) for t in samples[name]] or [np.empty(0, np.uint32)])
        grams[name] = np.unique(every, return_counts=True)
    previous = np.full((1, len(names)), 8.0)  # uniform bytes
    tables = []
    lookup_previous = None
    for order in range(ORDER + 1):
        mask = np.uint32((1 << (8 * (order + 1))) - 1)
        per = {}
        for name in names:
            keys, counts = grams[name]
            short, inverse = np.unique(keys & mask, return_inverse=True)
            totals = np.bincount(inverse, counts, len(short)) if len(keys) else np.empty(0)
            context, where = np.unique(short >> np.uint32(8) if order == ORDER else _context(short, order), return_inverse=True)
            total, kinds = np.bincount(where, totals, len(context)), np.bincount(where, minlength=len(context))
            per[name] = short, totals, context, where, total, kinds
        keys = np.unique(np.concatenate([per[n][0] for n in names] or [np.empty(0, np.uint32)]))
        contexts = np.unique(np.concatenate([per[n][2] for n in names] or [np.empty(0, np.uint32)]))
        escape = np.zeros((len(contexts) + 1, len(names)))
        bits = np.empty((len(keys), len(names)))
        shorter = keys & np.uint32((1 << (8 * order)) - 1) if order else keys
        base = previous[lookup_previous(shorter)] if order else np.repeat(previous, len(keys), 0)
        if order:
            # A shorter window that no language saw has its own escapes below it; windows seen at this order always have theirs.
            assert not len(keys) or not np.isnan(base).any()
        for j, name in enumerate(names):
            short, totals, context, where, total, kinds = per[name]
            escape[np.searchsorted(contexts, context), j] = np.log2((total + kinds) / kinds) if len(context) else 0
            ctx = np.searchsorted(contexts, _context(keys, order))
            bits[:, j] = base[:, j] + escape[np.minimum(ctx, len(contexts)), j]
            bits[np.searchsorted(keys, short), j] = np.log2((total + kinds)[where] / totals) if len(short) else 0
        tables.append((keys, bits, contexts, escape))
        previous, lookup_previous = np.vstack([bits, np.full((1, len(names)), np.nan)]), _Lookup(keys)
    return names, tables


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    return keys >> np.uint32(8) if order else np.zeros_like(keys)


class Scorer:
    def __init__(self, model: tuple):
        self.names, tables = model
        self.block = max(1 << 14, _BLOCK_CELLS // max(1, len(self.names)))
        self.levels = [(_Lookup(k), np.vstack([b, np.zeros((1, len(self.names)))]), _Lookup(c), e) for k, b, c, e in tables]

    def bits(self, w: np.ndarray) -> np.ndarray:
        """Code lengths of windows, a column per language."""
        out = np.zeros((len(w), len(self.names)))
        left = np.arange(len(w))
        for order in range(ORDER, -1, -1):
            keys = w[left] if order == ORDER else w[left] & np.uint32((1 << (8 * (order + 1))) - 1)
            lookup, bits, contexts, escape = self.levels[order]
            row = lookup(keys)
            if order == ORDER:
                out = bits[row]
            else:
                out[left] += bits[row]
            missing = np.flatnonzero(row == lookup.absent)
            if not len(missing):
                return out
            out[left[missing]] += escape[contexts(_context(keys[missing], order))]
            left = left[missing]
        out[left] += 8.0
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text, a column per language; whole texts, a bounded block at a time."""
        totals = np.zeros((len(texts), len(self.names)))
        pending, size = [], 0
        for i, text in enumerate(texts):
            # A block may start inside a text: its windows are cut from the text with the bytes before it.
            for start in range(0, len(text), self.block):
                pending.append((i, windows(text[max(0, start - ORDER) : start + self.block])[min(start, ORDER) :]))
                size += len(pending[-1][1])
                if size >= self.block:
                    self._add(totals, pending)
                    pending, size = [], 0
        self._add(totals, pending)
        return totals

    def _add(self, totals: np.ndarray, pending: list) -> None:
        if pending:
            starts = np.cumsum([0, *(len(w) for _, w in pending[:-1])])
            np.add.at(totals, [i for i, _ in pending], np.add.reduceat(self.bits(np.concatenate([w for _, w in pending])), starts, axis=0))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = utf8(batch.column(1))
            speaks = [t is not None and any(map(str.isalpha, t.decode())) for t in texts]
            langs, scores, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if scorer.names and any(speaks):
                at = [i for i, s in enumerate(speaks) if s]
                totals = scorer.totals([texts[i] for i in at])
                best = totals.argmin(axis=1)
                weight = np.exp2(np.maximum(totals.min(axis=1, keepdims=True) - totals, -1000)).sum(axis=1)
                for i, b, w, total in zip(at, best, weight, totals.min(axis=1), strict=True):
                    langs[i], scores[i], bits[i] = scorer.names[b], float(1 / w), max(0.0, float(total) - FREE_BITS) / len(texts[i])
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "lang_pred", "score", "bits"])

    return run


def held_out():
    """Whether a row is kept from training: crc32 of the doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def teaches():
    """Whether a row is labelled and not held out."""
    return F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()


def fit(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple:
    """Trees from a sample of the labelled rows that are not held out; rows without doc_id, text or lang teach nothing.

    The sample is bounded: about ``docs_per_language`` rows of each language by a hash of the row, four times as many over all at most,
    ``chars`` characters of each.
    """
    labelled = docs.where(teaches())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_language / n))))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(chance < F.try_element_at(shares, F.col("lang"))).select("lang", F.substring("text", 1, chars).alias("text"))
    samples: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for row in sample.limit(4 * docs_per_language * len(counts)).toLocalIterator():
        samples[row["lang"]].append(row["text"].encode())
    return train({k: v for k, v in samples.items() if any(v)})


def predict(docs: DataFrame, model: tuple, lang: str = "__lang_pred", score: str = "__score", bits: str = "__bits") -> DataFrame:
    """All columns of ``docs``, ``lang``, and ``score``: the winner's share when code lengths are turned back into
    probabilities. ``und`` with score 0 where the text is null or has no letter. Ties go to the first language by name. ``bits``: the winner's exact
    code length beyond the first FREE_BITS, a byte. Columns of docs may have any name but those of the results, which are refused."""
    refuse(docs.columns, lang, score, bits)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select((packed(others) if others else F.struct(F.lit(0))).alias("row"), F.col("text").cast("string").alias("text"))
    kinds = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_predict(shared), T.StructType([*rows.schema.fields, *(T.StructField(name, kind) for name, kind in kinds)]))
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns, F.col("lang_pred").alias(lang), F.col("score").alias(score), F.col("bits").alias(bits))


def limits(docs: DataFrame, model: tuple) -> dict[str, float]:
    """The most bits a byte (__bits of ``predict``) of a text of each language, from all labelled rows that are not held out and are predicted
    as labelled. Exact: code lengths are counted by step. A language without such a row has no limit."""
    found = predict(docs.where(teaches()).select("lang", "text"), model).where(F.col("lang") == F.col("__lang_pred"))
    counted: dict[str, list] = {}
    for row in found.groupBy("lang", F.ceil(F.col("__bits") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "step").collect():
        counted.setdefault(row["lang"], []).append((row["step"], row["n"]))
    out = {}
    for lang, steps in counted.items():
        above = sum(n for _, n in steps)
        allowed = LOOSE_SHARE * above
        for step, n in steps:
            above -= n
            if above <= allowed:
                out[lang] = MARGIN * step / STEPS
                break
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; trains on its labelled rows that are not held out.

    Reads doc_id, text and lang; only the text takes part in a prediction. Without any labelled row every prediction is ``und``. Rows with
    a null doc_id are not held out and teach nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    found = predict(rows.select("doc_id", "text"), fit(rows))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
