"""Ranks, bins, best rows and stability checks over result tables.

Result tables (methods, constraints, settings) are small by construction; where
a table of samples is ranked the split ranks of :mod:`partwise.operators.ranks`
are used instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions.guards import ratio
from partwise.operators.ranks import attach_rank
from partwise.operators.stats import bin_of, quantile_edges
from partwise.session import cut_lineage

#: Keys whose bin edges are sent to every task.
MOST_BROADCAST_KEYS = 100_000


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Bin number by exact quantile edges; equal values always share a bin."""
    edges = quantile_edges(df, keys, value, bins).drop("n_values")
    if keys:
        # Known before the join, so that the rows stay where they are.
        edges = cut_lineage(edges)
        joined = df.join(F.broadcast(edges) if edges.count() <= MOST_BROADCAST_KEYS else edges, list(keys))
    else:
        joined = df.withColumn("edges", edges.select("edges").scalar())
    return joined.withColumn("bin", bin_of(F.col(value), F.col("edges"))).drop("edges")


def rank_change(old: DataFrame, new: DataFrame, score: str = "score", key: str = "method") -> DataFrame:
    """Rank in two runs and the move; a method in only one run is 'n/c'."""
    side = lambda d, n: attach_rank(d, [], score, f"rank_{n}", "min", descending=True).select(
        key, F.col(score).alias(f"score_{n}"), f"rank_{n}")
    j = side(old, "old").join(side(new, "new"), key, "full")
    move = F.col("rank_old") - F.col("rank_new")
    status = F.when(move.isNull(), "n/c").when(move == 0, "same").otherwise("moved")
    return j.select(key, "rank_old", "rank_new", move.alias("change"), (F.col("score_new") - F.col("score_old")).alias("delta"),
                    status.alias("status"))


def best_and_delta(df: DataFrame, score: str, key: str) -> DataFrame:
    """Each row's distance to the lowest score, and who holds it."""
    best = df.agg(F.min(F.struct(F.col(score).alias("s"), F.col(key).alias("k")))).scalar()
    return df.withColumn("_b", best).select(*df.columns, F.col("_b.k").alias("best"), (F.col(score) - F.col("_b.s")).alias("delta"))


def ordered(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Sort by several (column, descending) keys with missing values last."""
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]
    return df.orderBy(*order)


def top_variance(expr: DataFrame, libraries: DataFrame, n: int) -> DataFrame:
    """The n features with the largest variance of log1p CPM."""
    lcpm = F.log1p(ratio("value", "library") * 1e6)
    v = expr.join(libraries, "sample").groupBy("feature").agg(F.var_samp(lcpm).alias("variance"))
    return v.orderBy(F.desc("variance"), "feature").limit(n)


def top_contributions(df: DataFrame, ident: str, value: str, k: int) -> DataFrame:
    """The k largest contributions with their share of the positive total."""
    positive = df.agg(F.sum(F.greatest(F.col(value), F.lit(0.0)))).scalar()
    top = df.orderBy(F.desc(value), ident).limit(k)
    return top.withColumn("share", ratio(F.col(value), positive))


def chain_increases(means: DataFrame, chain: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Whether every step of an ordered label chain rises; chains with a gap are left out."""
    pos = F.array_position(F.array(*[F.lit(s) for s in chain]), F.col("structure"))
    rows = means.where(F.col("structure").isin(list(chain)) & F.col("v").isNotNull()).withColumn("pos", pos)
    w = Window.partitionBy(*keys).orderBy("pos")  # at most one row per label
    step = rows.withColumn("up", F.lead("v").over(w) > F.col("v"))
    got = step.groupBy(*keys).agg(F.count("*").alias("_n"), F.bool_and("up").alias("increasing"))
    return got.where(F.col("_n") == len(chain)).drop("_n")


def leave_one_out(weights: DataFrame, unit: str, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Score without each unit, from totals: (all - own) per unit, no rows are repeated.

    ``weights`` is (keys, unit, num, den).
    """
    keys = list(keys)
    total = weights.groupBy(*keys).agg(F.sum("num").alias("_n"), F.sum("den").alias("_d"))
    own = weights.groupBy(*keys, unit).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    # The methods are a roster; the units are not, so the grid grows from the units.
    every = total.agg(F.collect_list(F.struct(*total.columns))).scalar()
    grid = weights.select(unit).distinct().withColumn("_k", F.explode(every)).select(unit, "_k.*")
    j = grid.join(own, [*keys, unit], "left").na.fill(0.0, ["num", "den"])
    return j.select(*keys, F.col(unit).cast("string").alias("left_out"),
                    ratio(F.col("_n") - F.col("num"), F.col("_d") - F.col("den")).alias("score"),
                    ratio("_n", "_d").alias("full_score"))


def seed_stability(df: DataFrame, keys: Sequence[str], result: str, n_seeds: int) -> DataFrame:
    """stable / unstable / blocked by whether every seed gave the same result."""
    got = df.groupBy(*keys).agg(F.count_distinct(result).alias("n_results"), F.count(result).alias("n_present"))
    status = (F.when(F.col("n_present") < n_seeds, "blocked").when(F.col("n_results") == 1, "stable").otherwise("unstable"))
    return got.select(*keys, "n_results", status.alias("status"))


def panel_percentile(expr: DataFrame, panels: DataFrame, sample: str = "sample") -> DataFrame:
    """Within-sample percentile of each feature (average rank / n), averaged per panel."""
    ranked = attach_rank(expr, [sample], "value", "pct", "pct")
    return ranked.join(panels, "feature").groupBy(sample, "panel").agg(F.avg("pct").alias("score"))


def contrast(df: DataFrame, better: Column) -> DataFrame:
    """Count outcomes that improve."""
    return df.agg(F.count("*").alias("n"), F.count_if(better).alias("n_better"))
