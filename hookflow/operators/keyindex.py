"""An index of the keys and ids that a stored event table holds.

It lies beside the store as Parquet, bucketed by a hash: a row for each stored (source, external id), in the bucket of that key, and one for each
id, in the bucket of the id. A batch reads the buckets of its own keys and ids only, and of those the rows that it names, so neither the
store nor the index is shuffled. Choose the number of buckets so that a bucket is a few files; it is part of the path.

Every row names the batch that stored it. A batch that is run again, because its writer was lost, doesn't take its own rows for conflicts; it
writes its part of the store over, and rows that come twice in the index do no harm. Rows are stored before they are indexed: should both the
writer and its checkpoint be lost in between, ``rebuild`` takes the index from the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hookflow.session import broadcast_if_small

BUCKETS = 64
LAYOUT = "source string, external_id string, id string, stored_by string, bucket int"


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, f"{path.rstrip('/')}-keys-{buckets}", buckets

    def _bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int").alias("bucket")

    def _entries(self, rows: DataFrame, stored_by: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        keys = F.when(F.col("external_id").isNotNull(), F.struct("source", "external_id", none.alias("id"), self._bucket("source", "external_id")))
        ids = F.when(F.col("id").isNotNull(), F.struct(none.alias("source"), none.alias("external_id"), F.col("id").cast("string").alias("id"), self._bucket("id")))
        both = rows.select(stored_by.alias("stored_by"), F.explode(F.array_compact(F.array(keys, ids))).alias("e"))
        return both.select("e.source", "e.external_id", "e.id", "stored_by", "e.bucket")

    def add(self, rows: DataFrame, stored_by: Column | str) -> None:
        """Indexes stored rows (source, external_id, id)."""
        by = F.lit(stored_by) if isinstance(stored_by, str) else stored_by
        # A task for each bucket, split where one is large.
        self._entries(rows, by).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        self.spark.createDataFrame([], LAYOUT).write.mode("ignore").partitionBy("bucket").parquet(self.path)
        index = self.spark.read.schema(LAYOUT).parquet(self.path)
        return index if buckets is None else index.filter(F.col("bucket").isin(buckets))

    def known(self, rows: DataFrame, stored_by: str | None = None) -> DataFrame:
        """Index rows (source, external_id, id) that the rows' keys or ids meet; those of the batch ``stored_by`` are left out."""
        wanted = self._entries(rows, F.lit(None).cast("string")).drop("stored_by").distinct()
        # At most one row for each bucket.
        buckets = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())
        index = self.read(buckets)
        if stored_by is not None:
            index = index.filter(F.col("stored_by") != stored_by)
        wanted = broadcast_if_small(wanted)
        same = [F.col(f"i.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("bucket", "source", "external_id", "id")]
        met = index.alias("i").join(wanted.alias("w"), same, "left_semi")
        return met.select("source", "external_id", "id")

    def rebuild(self, stored: DataFrame) -> None:
        """The index anew from the store, whose rows name the batch that stored them."""
        entries = self._entries(stored, F.col("stored_by"))
        entries.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)
