"""Session settings and the small amount of driver-side plumbing operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Driver-side reads of configuration tables stop here; event-sized data never goes this way.
MAX_CONFIG_ROWS = 10_000
# Narrow key rows (tens of bytes each) that may be sent to every executor.
MAX_BROADCAST_ROWS = 200_000


def build_session(app: str = "hookflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC clock, adaptive plans)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Materialised intermediate results go once nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Call-site capture costs a round trip per column expression; compiled rules have many.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only where driver and executors are one process, as in tests, a temporary folder stands in for it. On a cluster
    without the setting there is no folder that all could read, and that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hookflow-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder, so lost executors cost a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_once(df: DataFrame, label: str) -> DataFrame:
    """Compute a frame once, as Parquet in the shared folder: later passes read only the columns they need."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def config_rows(df: DataFrame, limit: int = MAX_CONFIG_ROWS) -> list[Row]:
    """Rows of a configuration table, refusing anything that is not configuration-sized."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"configuration table has more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table after counting it; beyond the limit the planner shuffles as usual.

    For tables whose size the planner cannot know, such as keys of a micro-batch.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def instant(value: Column | datetime | str) -> Column:
    """An ``as_of`` argument as a timestamp column (columns pass through)."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan, dealt out when it has fewer splits than the session has cores.

    For CPU-heavy work over few row groups; a large input has splits enough and is left
    alone. Give it a plain scan: asking a scan for its splits runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
