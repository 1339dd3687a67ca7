"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): each vertex and the least of itself and its neighbours; ``edges`` is stored."""
    return stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")


def large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour to the least vertex of the neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).withColumnRenamed("u", "w")
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour, and the vertex itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down).withColumnRenamed("u", "w")
    return down.join(least, F.col("u") == F.col("w")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (u, v); component is the least vertex reached.

    Each round is written to the shared folder, so a lost executor costs one round.  The
    rounds grow with the logarithm of the longest chain; not to settle is an error.
    """
    now = stored(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(now)
    for _ in range(max_rounds):
        if before["n"]:
            now = stored(small_star(stored(large_star(now).distinct(), "large")).where(F.col("u") != F.col("v")).distinct(), "small")
        mark = _mark(now)
        if before == mark:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct().toDF("vertex", "component"))
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
