"""Registry of named queries: a Spark plan over ``Tables`` and, where it can be said in SQL, a check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hookflow.plans.tables import Tables, check_ctes


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    check: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, check: str | None = None, ctes: str = ""):
    """Register a builder. ``check`` is a SELECT that may use the shared CTEs and ``ctes``."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        sql = None
        if check is not None:
            extra = f", {ctes}" if ctes else ""
            sql = f"with recursive {check_ctes()}{extra} {check}"
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register
