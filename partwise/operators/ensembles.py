"""Ensembles of methods and bootstraps of unit statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions.draws import hash32, with_draws
from partwise.functions.guards import ratio
from partwise.operators.permute import resampled_sums, roster
from partwise.operators.resample import permutation_spearman
from partwise.operators.stats import method_pair_correlation, spearman
from partwise.session import cut_lineage


def pair_picks(est: DataFrame, methods: Sequence[str], unit: Sequence[str], n_draws: int, seed: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, draw, method, w): draw 0 takes the two best-correlated pairs of a key, the others two random pairs."""
    keys = list(keys)
    r = method_pair_correlation(est, methods, [*keys, *unit], keys)
    # One row per key and pair of the method roster.
    best = r.where("r IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("r"), "m1", "m2")))
    top = best.where("k <= 2").select(*keys, F.lit(0).alias("draw"), "m1", "m2")
    shuffled = with_draws(best.select(*keys, "m1", "m2"), n_draws).withColumn(
        "k", F.row_number().over(Window.partitionBy(*keys, "draw").orderBy(hash32(F.lit(seed), "draw", "m1", "m2"), "m1", "m2")))
    picks = top.unionByName(shuffled.where("k <= 2").select(*keys, "draw", "m1", "m2"))
    return picks.select(*keys, "draw", F.explode(F.array("m1", "m2")).alias("method")).groupBy(*keys, "draw", "method").agg(
        (F.count("*") * F.lit(0.25)).alias("w"))


def random_pair_null(cells: DataFrame, methods: Sequence[str], unit: Sequence[str], n_draws: int, seed: str,
                     keys: Sequence[str]) -> DataFrame:
    """Per key: Spearman of the agreement-chosen ensemble with the truth, against random pairs and against a shuffled truth.

    The truth is shuffled across units by one set of moves for all keys of a size.
    """
    keys = list(keys)
    w = pair_picks(cells, methods, unit, n_draws, seed, keys)
    ens = cut_lineage(cells.join(w, [*keys, "method"]).groupBy(*keys, "draw", *unit).agg(
        F.round(F.sum(F.col("w") * F.col("value")), 9).alias("ens"), F.round(F.max("t"), 9).alias("t")))
    rho = cut_lineage(spearman(ens, [*keys, "draw"], "ens", "t"))
    first = F.col("draw") == 0
    observed = rho.where(first).select(*keys, F.col("rho").alias("observed"))
    null = rho.where(~first & F.col("rho").isNotNull()).join(observed, keys)
    out = null.groupBy(*keys).agg(F.count("*").alias("n_draws"), F.max("observed").alias("observed"),
                                  F.percentile("rho", F.lit(0.5)).alias("null_median"),
                                  F.avg((F.col("rho") < F.col("observed") - 1e-12).cast("double")).alias("null_percentile"))
    chosen = ens.where(first).select(*keys, F.concat_ws("#", *unit).alias("_unit"), "ens", "t")
    shuffled = permutation_spearman(chosen, keys, "_unit", "ens", "t", n_draws, seed).select(*keys, F.col("p_value").alias("p_shuffled"))
    return out.join(shuffled, keys).withColumn("beats_median", F.col("observed") > F.col("null_median"))


def centrality_vs_truth(cells: DataFrame, methods: Sequence[str], unit: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per key: rank correlation of a method's mean agreement with the others and its own truth correlation."""
    keys = list(keys)
    pairs = method_pair_correlation(cells, methods, [*keys, *unit], keys)
    both = pairs.select(*keys, F.col("m1").alias("method"), "r").unionByName(pairs.select(*keys, F.col("m2").alias("method"), "r"))
    central = both.groupBy(*keys, "method").agg(F.round(F.avg("r"), 9).alias("centrality"))
    own = spearman(cells, [*keys, "method"], "value", "t", name="truth_rho").drop("n")
    own = own.withColumn("truth_rho", F.round("truth_rho", 9))
    return spearman(central.join(own, [*keys, "method"]), keys, "centrality", "truth_rho", 4)


def row_bootstrap(rows: DataFrame, unit: Sequence[str], ident: str, x: str, y: str, n_draws: int, seed: str) -> DataFrame:
    """Per draw: rank correlation over units of (their Pearson r) with (their mean x)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = cut_lineage(rows.select(*unit, ident, x, y))
    sums = resampled_sums(rows, unit, roster(rows, unit), ident, [F.lit(1.0), a, b, a * a, b * b, a * b], n_draws, seed, shared=True)
    s = sums.select("draw", *unit, *[F.get("sums", F.lit(i)).alias(c) for i, c in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))]).where("n > 0")
    n = F.col("n")
    r = ratio(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt(
        (F.col("sxx") - F.col("sx") ** 2 / n) * (F.col("syy") - F.col("sy") ** 2 / n)))
    units = s.select("draw", F.round(r, 9).alias("r"), F.round(F.col("sx") / n, 9).alias("level"))
    return spearman(units, ["draw"], "r", "level")
