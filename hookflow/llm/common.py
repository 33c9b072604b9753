"""What the operators of this subpackage share: written stages, word and shingle hashes, connected components.

Words everywhere are runs of ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` yields on UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookflow.session import scratch_path

SHINGLE_WORDS = 5
_WORD_CACHE_SIZE = 1 << 18
# Texts of so many bytes are held in a worker's memory at a time; one longer text makes a piece of its own.
PIECE_BYTES = 8 << 20
SIEVE_CELLS = 1 << 24
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, computed once: Parquet in the shared folder, so lost executors cost a re-read only."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._written_to = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Removes the files of ``written`` frames that nothing will read again: what was made of them is written itself."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each made longer until it is no column's; letter case does not tell columns apart."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def refuse(columns: list[str], *names: str) -> None:
    """An error where a column has a name that results need."""
    taken = {c.lower() for c in columns}
    if clash := [name for name in names if name.lower() in taken]:
        raise ValueError(f"the input has columns named like results: {clash}")


def packed(columns: list[str]) -> Column:
    """The columns as one struct, so that no name of theirs meets an internal one."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in columns))


def unpacked(rows: DataFrame, *columns: Column) -> DataFrame:
    """The columns of the struct ``row``, then others."""
    return rows.select("row.*", *columns)


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a long hash, may be one of the wanted frame's, before they are shuffled for a join that must follow: by a bitmap of keys
    in rows of 64 bits, at most ``SIEVE_CELLS / 64``, which goes to every task. The more is wanted, the more others pass."""
    cell = F.pmod(F.col(key), F.lit(SIEVE_CELLS))
    word, bit = F.floor(cell / 64).cast("long"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")
    bitmap = wanted.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    met = rows.withColumn("__word", word).join(F.broadcast(bitmap), "__word")
    return met.where(F.col("__bits").bitwiseAND(bit) != 0).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a decode."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts pass another ``limit`` bytes; nothing is copied."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        sizes = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in texts]
        held = np.cumsum(np.sum(sizes, axis=0, dtype=np.int64)) if sizes and batch.num_rows else np.empty(0, np.int64)
        if not len(held) or held[-1] <= limit:
            yield batch
            continue
        cuts = [0, *(np.flatnonzero(np.diff(held // limit)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; repeated words cost a dictionary look-up. The cache is bounded."""
    if len(_WORD_HASHES) > _WORD_CACHE_SIZE:
        _WORD_HASHES.clear()
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, in order."""
    count = len(hashes) - width + 1
    h = np.full(count, width, np.uint64)
    for i in range(width):
        h = (h ^ hashes[i : i + count]) * _ODD[0]
        h ^= h >> np.uint64(32)
    return mix(h)


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct word-shingle hashes of a text, ascending. A-Z are lower-cased; with fewer than five words
    the whole sequence is one shingle; without words the set is empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(SHINGLE_WORDS, len(words))))


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u long, v long): rows (id, component = smallest id).

    Large-star and small-star rounds: each node's smallest neighbour is a pre-aggregated minimum joined back to the
    edges, so a hub is split by the planner and never gathered; rounds grow with the logarithm of the longest path.
    Self-loops and repeated edges do no harm; ids in no edge do not appear.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "edges")
        discard(edges)
        low = _smallest(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        discard(large)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
