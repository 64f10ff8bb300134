"""Catalog of registered queries: a name, a Spark plan, and the SQL that DuckDB compares it with."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self):
        self.queries: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable], Plan]:
        """Register ``plan(load)``; ``load(name)`` reads a table of the data folder."""

        def add(plan: Callable) -> Plan:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plan(Tables(spark, sf_dir))

            self.queries[plan.__name__] = run
            if sql:
                self.sql[plan.__name__] = sql
            return run

        return add


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where only ``sys.path`` of the driver knows it.

    On a cluster the package is shipped with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


class Tables:
    """Reads tables by name, as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
