"""The registry: a query is a function of the tables plus its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partwise.functions.guards import tidy


class Tables:
    """The driver's parquet tables by attribute, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, keys: str, nums: str = "", sql: str | None = None):
    """Register ``fn(tables)``; ``nums`` are doubles, reported to six decimals."""
    ks, ns = keys.split(), nums.split()

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.select(*ks, *[tidy(n).alias(n) for n in ns])

        QUERIES[name] = run
        if sql is not None:
            shown = [*ks, *[
                f"CASE WHEN abs({n}) < 5e-7 THEN 0.0::DOUBLE ELSE round({n}::DOUBLE, 6) END AS {n}" for n in ns
            ]]
            ORACLES[name] = f"SELECT {', '.join(shown)} FROM ({sql}) AS q"
        return fn

    return deco
