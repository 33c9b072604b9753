"""CSV batches: strict reading and fixed-size chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hookflow.session import broadcast_if_small, cut_lineage, stored_once

CHUNK_SIZE = 500
POSITION = ["_file", "_block", "_row"]
_PARTITION_BITS = 33  # rows of a partition number upwards from partition << 33


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line that is not a comment."""
    options = {"header": "false", "comment": "#", "columnPruning": "false", "escape": '"'}
    first = spark.read.options(**options).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"no header line in {path}")
    return [str(name) for name in first[0]]


def ingest_csv(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    row_transform: Callable[[DataFrame], DataFrame] | None = None,
    position: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Strict CSV: header line, ``#`` comments skipped, every value a string.

    A row with more or fewer values than the header fails the whole read. Column pruning
    is off in the parser, because a pruned parser does not notice ragged rows.
    ``position`` adds columns that keep file order across input splits.
    """
    names = columns or csv_header(spark, path)
    reader = spark.read.schema(T.StructType([T.StructField(name, T.StringType()) for name in names])).options(
        header="true",
        comment="#",
        mode="FAILFAST",
        columnPruning="false",
        escape='"',
        multiLine=str(multi_line).lower(),
    )
    # The parser gives null for an empty value; a missing value has already failed the read.
    values = [F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) for name in names]
    places = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]
    rows = reader.csv(path).select(*values, *(places if position else []))
    return row_transform(rows) if row_transform else rows


def with_row_number(rows: DataFrame, order_by: list[str | Column], name: str = "row_number") -> DataFrame:
    """0-based position in a total order, without a single-partition window over rows.

    The sorted rows are materialised in the shared folder, which pins their partitions.
    Partition sizes give the rows before each partition; that table has one row per
    partition, so it can be ranked by one task and broadcast whatever the data size.
    """
    ordered = cut_lineage(rows.orderBy(*order_by))
    marked = ordered.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    offset = F.col("_m").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    numbered = marked.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + offset)
    return numbered.drop("_p", "_m", "_start")


def numbered_in_place(rows: DataFrame, name: str = "row_number") -> DataFrame:
    """0-based position of rows in file order (``POSITION``), without a sort.

    A split of a file is read by one task in order, so its rows carry consecutive numbers; they are written once, which pins
    them. What is summed over splits is one row for each. Only where rows were dropped after the numbering, which leaves gaps,
    are the rows of each split counted anew, split by split.
    """
    rows = stored_once(rows, "csv")
    split = ["_file", "_block"]
    sizes = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    sizes = stored_once(sizes, "splits")
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*split, "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    if not sizes.filter("_last - _first + 1 <> n").isEmpty():
        inside = Window.partitionBy(*split).orderBy("_row")
        rows = rows.withColumn("_row", F.row_number().over(inside))
        starts = starts.withColumn("_first", F.lit(1))
    joined = rows.join(broadcast_if_small(starts), split)
    return joined.withColumn(name, F.col("_start") + F.col("_row") - F.col("_first")).drop("_start", "_first")


def csv_chunks(rows: DataFrame, order_by: list[str | Column], size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of ``size`` rows in order: ``chunk_index`` (0-based), ``rows`` and ``total_rows``.

    Every row is a map from column name to text. In file order (``POSITION``) rows are numbered in place, in any other by a sort.
    """
    names = [c for c in rows.columns if c not in POSITION]
    pairs = [part for c in names for part in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    row = F.struct(F.col("row_number").alias("n"), F.create_map(*pairs).alias("row"))
    # Ordered by number, which no two rows share, so the maps are never compared.
    gathered = F.array_sort(
        F.collect_list(row), lambda a, b: (a["n"] - b["n"]).cast("int")
    )
    numbered = numbered_in_place(rows) if order_by == POSITION else with_row_number(rows, order_by)
    return (
        numbered
        .groupBy(F.floor(F.col("row_number") / size).alias("chunk_index"))
        .agg(F.transform(gathered, lambda r: r["row"]).alias("rows"), F.count(F.lit(1)).alias("total_rows"))
    )


def csv_batch_stats(rows: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Row count of a batch and the number of chunks it makes."""
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total_rows"), F.ceil(total / size).alias("chunks_queued"))
