"""Mixing sources to target weights.

Each source's rows get hash-random keys, are range-sorted by (source, key), and prefix sums of their sizes are taken over all
ranges: a running sum inside each range, plus the sums of the ranges before it. Each source is then cut at its exact budget;
a budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookflow.llm.common import packed, written

WEIGHTS = (5, 2, 1)  # of sources by code point, null last; repeating
SHARE = Fraction(3, 2)  # of all sizes
MAX_EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MAX_EPOCHS) -> dict[str | None, Fraction]:
    """Words to take from each source: ``share`` of all words by weight, at most ``most`` times a source's own; what a source
    cannot take is shared out again by weight. ``sizes`` has one row per source; driver-side, as a mix names its sources."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(ordered)}
    limit = {name: most * size for name, size in ordered}
    left, found, open_ = share * sum(size for _, size in ordered), {}, [name for name, _ in ordered]
    while open_:
        total = sum(weight[n] for n in open_)
        full = [n for n in open_ if left * weight[n] > limit[n] * total]
        if not full:
            return found | {n: left * weight[n] / Fraction(total) for n in open_}
        found |= {n: Fraction(limit[n]) for n in full}
        left -= sum(limit[n] for n in full)
        open_ = [n for n in open_ if n not in found]
    return found


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and the sum of sizes of the same source before the row. Rows come sorted by source."""
    part, current, so_far = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        before = []
        for source, size in zip(batch.column("__source").to_pylist(), batch.column("__size").to_pylist(), strict=True):
            if current != (source,):
                current, so_far = (source,), 0
            before.append(so_far)
            so_far += size
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(before), pa.int64()), pa.array(before, pa.int64())], [*batch.schema.names, "__part", "__before"]
        )


def _taken(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with __source, __size and others; adds __source_size, __target and __taken."""
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", F.xxhash64(F.lit(seed), "__id", "__size", "__tie"))
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(ranges, "__source", "__key").sortWithinPartitions("__source", "__key", "__id")
    layout = T.StructType([*ordered.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__before", T.LongType())])
    running = written(ordered.mapInArrow(_running, layout), "running")
    sums = running.groupBy("__source", "__part").agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("__source").alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    sizes = [(r["__source"], r["n"]) for r in sums.groupBy("__source").agg(F.sum("__sum").alias("n")).collect()]
    wanted = targets(sizes)
    recipe = spark.createDataFrame(
        [(s, n, float(wanted[s]), int(wanted[s])) for s, n in sizes] or [], "__r string, __source_size long, __target double, __budget long"
    )
    joined = running.join(bases, F.col("__part").eqNullSafe(F.col("__p")) & F.col("__source").eqNullSafe(F.col("__s")))
    joined = joined.join(recipe, F.col("__source").eqNullSafe(F.col("__r")))
    size, total = F.col("__size"), F.col("__source_size")
    epochs = F.when(total > 0, F.expr("__budget div __source_size")).otherwise(F.lit(0))
    rest = F.col("__budget") - epochs * total - (F.col("__base") + F.col("__before"))
    return joined.withColumn("__taken", epochs * size + F.greatest(F.lit(0), F.least(size, rest)))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) for every row of ``docs``.

    Reads doc_id, source and text. A null text has size 0 and nothing is taken from it; a null source is a source of its own,
    last in order. Repeated rows are rows of their own; which of several equal rows is cut does not show. The last row inside a budget is
    taken in part, so a source gives its target, rounded down, to the word. Sources without words have target 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), *_measured())
    # Written first: the range sampler reads the rows too, and texts are counted once.
    rows = written(rows, "sizes")
    return _taken(rows, seed).select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
    )


def _measured() -> list[Column]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col("source").cast("string").alias("__source"), size.alias("__size"), F.xxhash64("text").alias("__tie")]


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, a row for each epoch it is taken in; the last one is cut to the words that fit its budget.

    All columns of ``docs`` come back as they are, whatever their names, but for the text of rows taken in part. Rows are written once with a number; only
    narrow rows are sorted, and texts are joined back by that number. Odd rows as in ``mix``; a row without words is never taken.
    """
    columns = docs.columns
    numbered = F.monotonically_increasing_id().alias("__n")
    rows = written(docs.select(numbered, packed(columns).alias("row"), F.col("doc_id").cast("long").alias("__id"), *_measured()), "rows")
    taken = _taken(rows.drop("row"), seed).where("__taken > 0").select("__n", "__size", "__taken")
    epochs = F.expr("sequence(1, int((__taken + __size - 1) div __size))")
    out = rows.select("__n", "row").join(taken, "__n").withColumn("__epoch", F.explode(epochs))
    out = out.withColumn("__words", F.least(F.col("__size"), F.expr("__taken - (__epoch - 1) * __size")))
    # Words are matched one by one: a pattern that repeats a group once for each word recurses in the matcher and overflows on long texts.
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("__words").cast("int")), "")
    whole = F.col("__words") == F.col("__size")
    text = F.when(whole, F.col("row.text")).otherwise(cut)
    return out.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns))
