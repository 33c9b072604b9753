"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(256 x). The index holds them in blocks of like vectors (range-partitioned by the signs of their first components).
Inside a block the postings (row, dimension, value) are cut into segments of descending quantised impact, which here is the magnitude of a
value. Queries come in blocks too; a block of queries takes the segments of a block of vectors in turn, so the sums of all its pairs grow
together. After each segment every pair has an upper bound: its sum so far, plus the norm of the query times the norm of what is left of the vector.
A block ends early only on proof: no pair but the possible members can reach the query's bar, the best k-th score known so far. Possible
members are scored again exactly, in integers. A whole block is skipped if its largest and smallest values bound it below the bars.

Bars start from a bounded sample of vectors and rise from block to block in a task. Sums are floating point; every bound allows for the largest
error that they can have, which follows the norms, not the sum, so cancelling terms and large components cost time but never a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hookflow.llm.common import written

SCALE = 256
BLOCK_VECTORS = 4096
QUERY_BLOCK = 256
GROUP_VECTORS = 1 << 16  # vectors that meet all queries in one place; fewer where that leaves cores idle
IMPACT_SHARES = (0.6, 0.85)  # of a block's postings, by falling impact, in the first segment, in the first two; the rest is the last one
POSSIBLE_SHARE = 1 / 32  # of a block's pairs that may be scored exactly instead of taking the next segment
SAMPLE_VECTORS = 4096  # first bars come from; at most SAMPLE_BYTES of them
SAMPLE_BYTES = 16 << 20
SIGN_DIMS = 32
KEPT_QUERIES = 1 << 16  # whose best so far a task remembers
_PAIRS_AT_ONCE = 1 << 16
_LOWEST = -(1 << 63)


def _norms(values: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", values, values)) * (1 + 1e-12)


def _error(dims: int) -> float:
    """The most by which a floating-point sum of ``dims`` products, and of bounds on it, is off, for vectors of norm one. Twice what is proven."""
    return 4 * (dims + 8) * 2.0**-53


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, row by row, of integer vectors; in wide integers where a long might not hold them."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    largest = int(np.abs(a.astype(np.float64)).max() + 1) * int(np.abs(b.astype(np.float64)).max() + 1) * a.shape[1]
    if largest < 1 << 62:
        return np.einsum("ij,ij->i", a, b)
    scores = [sum(x * y for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    if any(not _LOWEST <= s < -_LOWEST for s in scores):
        raise OverflowError("a score is beyond a long")
    return np.array(scores, np.int64)


class Block:
    """Vectors with their postings in segments of falling impact."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.rows, self.ids, self.values = rows, ids, values
        floats = values.astype(np.float64)
        self.norms, self.high, self.low = _norms(floats), floats.max(axis=0, initial=-np.inf), floats.min(axis=0, initial=np.inf)
        impact = np.abs(floats)
        places = sorted({min(impact.size - 1, int(impact.size * (1 - share))) for share in IMPACT_SHARES}, reverse=True) if impact.size else []
        # Lowest impact of each segment but the last.
        self.bounds = [np.partition(impact, places, axis=None)[place] for place in places]
        self.segments, self.left = [], []
        for bound in (*self.bounds, 0.0):
            taken = impact >= bound
            self.segments.append(np.where(taken, floats, 0.0))
            floats = np.where(taken, 0.0, floats)
            impact = np.where(taken, -1.0, impact)
            self.left.append(_norms(floats))

    def members(self, queries: np.ndarray, query_rows: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, exact score) of pairs that include each query's ``k`` best of the block among those that reach its bar. Its own
        row, which may be in the block, is none of them."""
        nothing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        n, dims = self.values.shape
        floats = queries.astype(np.float64)
        norms = _norms(floats)
        off = _error(dims) * norms
        floor = bars.astype(np.float64) - np.abs(bars) * 2.0**-52 - 1
        reach = np.maximum(floats, 0) @ self.high + np.minimum(floats, 0) @ self.low + off * np.maximum(np.linalg.norm(self.high), np.linalg.norm(self.low)) if dims else norms
        asked = np.flatnonzero(np.minimum(reach, norms * self.norms.max(initial=0.0) * (1 + 1e-12)) >= floor)
        if not len(asked) or not n:
            return nothing
        floats, norms, off, floor = floats[asked], norms[asked], off[asked], floor[asked]
        total = np.zeros((len(asked), n))
        for segment, left in zip(self.segments, self.left, strict=True):
            total += floats @ segment.T
            margin = norms[:, None] * left + off[:, None] * self.norms
            possible = total + margin >= floor[:, None]
            if possible.mean() > POSSIBLE_SHARE and n > k + 1:
                lower = np.partition(total - margin, n - k - 1, axis=1)[:, n - k - 1]
                floor = np.maximum(floor, lower)
                possible = total + margin >= floor[:, None]
            if possible.mean() <= POSSIBLE_SHARE:
                break
        of, rows = np.nonzero(possible)
        other = self.rows[rows] != query_rows[asked[of]]
        of, rows = of[other], rows[other]
        scores = [
            exact(queries[asked[of[i : i + _PAIRS_AT_ONCE]]], self.values[rows[i : i + _PAIRS_AT_ONCE]]) for i in range(0, len(of), _PAIRS_AT_ONCE)
        ]
        return asked[of], rows, np.concatenate(scores) if scores else nothing[2]


def _first(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` highest scores, ties to the smaller id, in order."""
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == _LOWEST else -scores, of))
    starts = np.searchsorted(of[order], of[order])
    return order[np.arange(len(order)) - starts < k]


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _wide(values: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, dims - values.shape[1]))) if values.shape[1] < dims else values


_BLOCK_LAYOUT = "{0}_part long, {0}_number long, {0}_rows binary, {0}_ids binary, {0}_values binary, {0}_dims long, {0}_bars binary"


def _packed(prefix: str, size: int, sample: tuple | None = None, k: int = 0):
    """Rows (row, vec_id, v) of a partition gathered in blocks of ``size``; with a sample, each row's first bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _BLOCK_LAYOUT.format(prefix).split(", ")]
        part, number = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])

        def block(rows, ids, vectors) -> pa.RecordBatch:
            values = _matrix(vectors)
            bars = _bars(values, *sample.value, k) if sample is not None else np.empty(0, np.int64)
            cells = [part, number, np.array(rows, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), values.astype("<i8").tobytes(), values.shape[1], bars.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary() if isinstance(c, bytes) else pa.int64()) for c in cells], names)

        for batch in batches:
            for i in range(0, batch.num_rows, size):
                for column, more in zip(held, batch.slice(i, size).columns, strict=True):
                    column.extend(more.to_pylist())
                while len(held[0]) >= size:
                    yield block(*(column[:size] for column in held))
                    number += 1
                    held = tuple(column[size:] for column in held)
        if held[0]:
            yield block(*held)

    return run


def _bars(queries: np.ndarray, norms: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A bound below each query's k-th best score, from the sampled vectors; the query itself may be one of them."""
    if len(sample) <= k:
        return np.full(len(queries), _LOWEST, np.int64)
    dims = max(queries.shape[1], sample.shape[1])
    floats = _wide(queries, dims).astype(np.float64)
    lower = floats @ _wide(sample, dims).T - _error(dims) * _norms(floats)[:, None] * norms
    at = np.partition(lower, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
    at = at - np.abs(at) * 2.0**-50 - 1
    return np.where(at > -(2.0**62), np.floor(np.clip(at, -(2.0**62), 2.0**62)), float(_LOWEST)).astype(np.int64)


def _array(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), "<i8")


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[np.ndarray]] = {}  # of a block of queries: ids, (query number, vec_id, score) of its best so far, bars
        at, block = None, None

        def told(state) -> pa.RecordBatch:
            query_ids, query_rows, of, ids, scores, _ = state
            return pa.RecordBatch.from_arrays([pa.array(query_rows[of]), pa.array(query_ids[of]), pa.array(ids), pa.array(scores)], ["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            q_part, q_number, q_rows, q_ids, q_values, q_dims, q_bars, b_part, b_number, b_rows, b_ids, b_values, b_dims, _ = batch.columns
            for i in range(batch.num_rows):
                if (place := (b_part[i].as_py(), b_number[i].as_py())) != at:
                    rows = _array(b_rows, i)
                    at, block = place, Block(rows, _array(b_ids, i), _array(b_values, i).reshape(len(rows), b_dims[i].as_py()))
                name = (q_part[i].as_py(), q_number[i].as_py())
                if name not in kept:
                    while len(kept) * QUERY_BLOCK >= KEPT_QUERIES:
                        yield told(kept.pop(next(iter(kept))))
                    none = np.empty(0, np.int64)
                    kept[name] = [_array(q_ids, i), _array(q_rows, i), none, none, none, _array(q_bars, i)]
                query_ids, query_rows, of, ids, scores, bars = kept[name]
                queries = _array(q_values, i).reshape(len(query_rows), q_dims[i].as_py())
                dims = max(queries.shape[1], block.values.shape[1])
                if block.values.shape[1] < dims:
                    block = Block(block.rows, block.ids, _wide(block.values, dims))
                new_of, new_rows, new_scores = block.members(_wide(queries, dims), query_rows, k, bars)
                if not (reached := new_scores >= bars[new_of]).any():
                    continue
                of, ids = np.concatenate((of, new_of[reached])), np.concatenate((ids, block.ids[new_rows[reached]]))
                scores = np.concatenate((scores, new_scores[reached]))
                best = _first(of, ids, scores, k)
                of, ids, scores = of[best], ids[best], scores[best]
                # Entries are in order by query and falling score; the last one of a full k is the bar.
                full = np.flatnonzero(np.bincount(of, minlength=len(bars)) == k)
                bars = bars.copy()
                bars[full] = np.maximum(bars[full], scores[np.searchsorted(of, full, side="right") - 1])
                kept[name][2:] = [of, ids, scores, bars]
        for state in kept.values():
            yield told(state)

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """row, vec_id, v (array<long>): floor(256 x) of each component as double, written once with a number for each row.

    Rows without vec_id or vector, and those holding a null or non-finite component, are left out. Repeated rows, and several vectors of one
    vec_id, are rows of their own. A component beyond a long is an error.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(False)))

    def whole(x):
        scaled = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(x.cast("double")) < 2.0**55, scaled).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))

    found = usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))
    return written(found, "vectors")


def _signs() -> Column:
    """The signs of the first components as one number."""
    return F.aggregate(F.slice("v", 1, SIGN_DIMS), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x < 0, 0).otherwise(1))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k vectors of highest integer inner product, ties to the smaller vec_id, its own row aside.

    Both frames hold row, vec_id and an integer vector ``v`` as ``integer_vectors`` makes them; a query's own row is the one with its row number, so another
    row of the same vec_id is a candidate like any other. Vectors of different length are compared as if the shorter ended in zeros. No queries or no vectors:
    no rows. A score beyond a long is an error. Queries are joined with groups of vectors in blocks, and never pass through the driver.
    """
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    few = min(SAMPLE_VECTORS, max(k + 1, SAMPLE_BYTES // (8 * width)))
    sample = _matrix([r["v"] for r in vectors.orderBy(F.xxhash64("row")).limit(few).select("v").collect()])
    shared = spark.sparkContext.broadcast((_norms(sample.astype(np.float64)), sample.astype(np.float64)))
    count = vectors.count()
    groups = max(1, min(4 * cores, -(-count // 256)), -(-count // GROUP_VECTORS))
    like = vectors.withColumn("signs", _signs()).repartitionByRange(groups, "signs", "row").sortWithinPartitions("signs", "row")
    index = written(like.select("row", "vec_id", "v").mapInArrow(_packed("b", BLOCK_VECTORS), _BLOCK_LAYOUT.format("b")), "impact-index")
    spread = queries.select("row", "vec_id", "v").repartition(max(1, min(cores, -(-count // QUERY_BLOCK))), "row")
    asked = written(spread.mapInArrow(_packed("q", QUERY_BLOCK, shared, k), _BLOCK_LAYOUT.format("q")), "queries")
    everywhere = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = index.hint("merge").join(everywhere, F.col("b_part") == F.col("group"))
    columns = [c.split()[0] for prefix in "qb" for c in _BLOCK_LAYOUT.format(prefix).split(", ")]
    found = pairs.select(columns).mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
