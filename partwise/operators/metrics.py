"""Accuracy of estimates against a truth, and the tables built on it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.functions.guards import both, pearson, ratio
from partwise.operators.ranks import quantiles, value_ranks
from partwise.operators.stats import bin_of, quantile_edges, spearman

ABSENT = 1e-6  # below this true share a part counts as absent


def group_equal(df: DataFrame, keys: Sequence[str], group: str, values: dict[str, Column]) -> DataFrame:
    """Mean over groups of the group mean: every group counts once.

    Two aggregates; the first one combines map-side, so a hot group costs no more
    than any other.
    """
    one = df.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(*[F.avg(c).alias(n) for n, c in values.items()])
    return one.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in values], F.count("*").alias("n_groups"))


def per_type(et: DataFrame, keys: Sequence[str] = ("method", "part"), group: str = "group") -> DataFrame:
    """n, group-equal MAE / RMSE / bias, correlations where present, absence metrics."""
    keys = list(keys)
    rows = et.where(both(F.col("e"), F.col("t")))
    err = F.col("e") - F.col("t")
    main = group_equal(rows, keys, group, {"mae": F.abs(err), "mse": err * err, "bias": err})
    present = F.col("t") > ABSENT
    flat = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~present).alias("n_absent"),
        F.avg(F.when(~present, F.col("e"))).alias("false_positive"),
        pearson("e", "t", present, 3).alias("pearson_r"))
    rho = spearman(rows.where(present), keys, "e", "t", 3, "spearman_rho").drop("n")
    return main.join(flat, keys).join(rho, keys, "left").withColumn("rmse", F.sqrt("mse")).drop("mse")


def per_sample(et: DataFrame, primary: Sequence[str], keys: Sequence[str] = ("method", "sample", "group")) -> DataFrame:
    """One row per sample: mean absolute and squared error over parts, correlation, failure flag."""
    e, t = F.col("e"), F.col("t")
    main = F.col("part").isin(list(primary))
    r = F.when(F.count_if(e.isNull()) == 0, pearson("e", "t"))
    return et.groupBy(*keys).agg(
        F.avg(F.abs(e - t)).alias("mae_all"), F.avg(F.when(main, F.abs(e - t))).alias("mae_primary"),
        F.avg(F.when(main, (e - t) ** 2)).alias("mse_primary"), r.alias("r"),
        (F.count_if(e.isNull()) > 0).alias("failed"), F.count_distinct("part").alias("n_parts"))


def overall(et: DataFrame, primary: Sequence[str], n_roster: int, by: Sequence[str] = ("method",)) -> DataFrame:
    """One row per method: group-equal errors, mean correlation, failures, comparable flag."""
    by = list(by)
    s = per_sample(et, primary, [*by, "sample", "group"])
    means = group_equal(s, by, "group", {
        "mae_all": F.col("mae_all"), "mae_primary": F.col("mae_primary"), "mse": F.col("mse_primary"), "mean_r": F.col("r")})
    counts = s.groupBy(*by).agg(F.count("*").alias("n_samples"), F.count_if("failed").alias("n_failed"),
                                F.max("n_parts").alias("n_parts"))
    return means.join(counts, by).withColumn("rmse_primary", F.sqrt("mse")).drop("mse").withColumn(
        "comparable", F.col("n_parts") >= n_roster)


def sliced(et: DataFrame, slice_col: str, min_samples: int = 5) -> DataFrame:
    """The same error per slice and overall, from one grouping-sets aggregate."""
    s = et.groupBy("method", "sample", slice_col).agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("mae"))
    out = s.groupingSets([["method"], ["method", slice_col]], "method", slice_col).agg(
        F.count("*").alias("n"), F.avg("mae").alias("mae"), F.grouping(slice_col).alias("_all"))
    return out.where((F.col("_all") == 1) | (F.col("n") >= min_samples)).withColumn(
        slice_col, F.when(F.col("_all") == 1, "(all)").otherwise(F.col(slice_col))).drop("_all")


def detection_limit(et: DataFrame, keys: Sequence[str], bins: int = 8) -> DataFrame:
    """Left edge of the lowest truth bin whose mean estimate clears the noise of absent samples."""
    keys = list(keys)
    present = F.col("t") > ABSENT
    noise = et.groupBy(*keys).agg(
        F.count_if(~present).alias("_na"), F.count_if(present).alias("_np"),
        F.avg(F.when(~present, F.col("e"))).alias("_mu"), F.stddev_samp(F.when(~present, F.col("e"))).alias("_sd"))
    seen = et.where(present)
    edges = quantile_edges(seen, keys, "t", bins).drop("n_values")
    binned = seen.join(edges, keys).withColumn("_bin", bin_of(F.col("t"), F.col("edges")))
    per = binned.groupBy(*keys, "_bin").agg(
        F.count("*").alias("_n"), F.avg("e").alias("_m"), F.max(F.get("edges", F.col("_bin"))).alias("_left"))
    bar = F.col("_mu") + F.when(F.coalesce(F.col("_sd"), F.lit(0.0)) > 0, F.col("_sd")).otherwise(1e-9)
    ok = (F.col("_na") >= 3) & (F.col("_np") >= bins) & (F.col("_n") >= 2) & (F.col("_m") > bar)
    return noise.join(per, keys, "left").groupBy(*keys).agg(F.min(F.when(ok, F.col("_left"))).alias("limit"))


def levels(et: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean estimate, mean truth, mean difference and ratio of means."""
    return et.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("e").alias("mean_e"), F.avg("t").alias("mean_t"),
        F.avg(F.col("e") - F.col("t")).alias("bias")).withColumn("ratio", ratio("mean_e", "mean_t"))


def recovery_slope(et: DataFrame, keys: Sequence[str], min_n: int = 50) -> DataFrame:
    """1 + slope of the error on the truth."""
    err = F.col("e") - F.col("t")
    ok = both(F.col("e"), F.col("t"))
    slope = F.try_divide(F.covar_pop(err, F.col("t")), F.var_pop(F.when(ok, F.col("t"))))
    return et.groupBy(*keys).agg(F.count_if(ok).alias("n"), (1 + slope).alias("recovery")).where(F.col("n") >= min_n)


def coverage(intervals: DataFrame, methods: DataFrame, nominal: float = 0.95) -> DataFrame:
    """Share of truths inside the interval, width and interval score; methods without intervals stay."""
    lo, hi, y = F.col("lo"), F.col("hi"), F.col("t")
    rows = intervals.where(lo.isNotNull() & hi.isNotNull() & y.isNotNull())
    below, above = F.greatest(lo - y, F.lit(0.0)), F.greatest(y - hi, F.lit(0.0))
    got = rows.groupBy("method").agg(
        F.count("*").alias("n_intervals"), F.avg(((y >= lo) & (y <= hi)).cast("double")).alias("coverage"),
        F.avg(hi - lo).alias("width"), F.avg(hi - lo + F.lit(2.0 / (1 - nominal)) * (below + above)).alias("interval_score"))
    out = methods.join(got, "method", "left")
    return out.withColumn("gap", F.col("coverage") - nominal).withColumn("reported", F.col("n_intervals").isNotNull())


def conformal(resid: DataFrame, keys: Sequence[str], flag: str, value: str, alpha: float) -> DataFrame:
    """Split-conformal half-width from calibration rows and its coverage on the others.

    q is the k-th smallest residual, k = ceil((n + 1)(1 - alpha)); when k > n the
    level cannot be certified and q is missing.
    """
    keys = list(keys)
    facts = value_ranks(resid.where(F.col(flag)), keys, value)
    k = F.ceil((F.col("total") + 1) * F.lit(1 - alpha))
    hit = (F.col("before") < k) & (k <= F.col("before") + F.col("n"))
    q = facts.groupBy(*keys).agg(F.max("total").alias("n_calibration"), F.max(F.when(hit, F.col(value))).alias("q"))
    held = resid.where(~F.col(flag)).join(q, keys)
    cov = held.groupBy(*keys).agg(F.avg(F.when(F.col("q").isNotNull(), (F.col(value) <= F.col("q")).cast("double"))).alias(
        "coverage"))
    return q.join(cov, keys, "left")


def model_fit(observed: DataFrame, fitted: DataFrame) -> DataFrame:
    """1 - SSE/SST per sample; samples without signal skipped."""
    j = observed.join(fitted, ["feature", "sample"], "left")
    res = F.col("value") - F.coalesce("fitted", F.lit(0.0))
    got = j.groupBy("sample").agg(F.sum(res * res).alias("sse"), (F.var_pop("value") * F.count("value")).alias("sst"),
                                  F.sum("value").alias("total"))
    return got.where("total > 0").select("sample", (1 - ratio("sse", "sst")).alias("r2"))


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """2 x 2 counts of two flags, empty cells 0, with odds ratio and exact two-sided p."""
    r, c = F.col(row), F.col(column)
    got = df.agg(F.count_if(r & c).alias("a"), F.count_if(r & ~c).alias("b"), F.count_if(~r & c).alias("c"),
                 F.count_if(~r & ~c).alias("d"))
    return got.withColumn("odds_ratio", ratio(F.col("a") * F.col("d"), F.col("b") * F.col("c"))).withColumn(
        "p_value", fisher("a", "b", "c", "d"))


def fisher(a: str, b: str, c: str, d: str) -> Column:
    """Exact two-sided p of a 2 x 2 table: tables no likelier than the observed one."""
    return _fisher(F.col(a), F.col(b), F.col(c), F.col(d))


@F.pandas_udf(T.DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One definition at every size: both tails of the hypergeometric law, each summed away from the mode until its terms vanish."""
    return pd.Series([_both_tails(int(w), int(w + x), int(w + y), int(w + x + y + z)) for w, x, y, z in zip(a, b, c, d)], dtype="float64")


def _both_tails(seen: int, row: int, column: int, n: int) -> float:
    lo, hi = max(0, row + column - n), min(row, column)

    def log_p(k):
        pick = lambda m, j: math.lgamma(m + 1.0) - math.lgamma(j + 1.0) - math.lgamma(m - j + 1.0)
        return pick(row, k) + pick(n - row, column - k) - pick(n, column)

    def tail(k, step):
        total = 0.0
        while lo <= k <= hi:
            term = math.exp(log_p(k))
            total += term
            if term <= 1e-17 * total:
                break
            k += step
        return total

    mode = min(max((row + 1) * (column + 1) // (n + 2), lo), hi)
    limit = log_p(seen) + 1e-7
    if log_p(mode) <= limit:
        return 1.0
    # Off the mode the chances fall on both sides; the first cell within the limit is found by halving.
    left, right = lo - 1, mode
    while right - left > 1:
        mid = (left + right) // 2
        left, right = (mid, right) if log_p(mid) <= limit else (left, mid)
    below = tail(left, -1)
    left, right = mode, hi + 1
    while right - left > 1:
        mid = (left + right) // 2
        left, right = (left, mid) if log_p(mid) <= limit else (mid, right)
    return min(1.0, below + tail(right, 1))


def label_shares(df: DataFrame, sample: str, label: str) -> DataFrame:
    """Count per (sample, label) over the sample's total."""
    n = df.groupBy(sample, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(sample))  # one row per label of the roster
    return n.withColumn("share", ratio("n", total))


def first_share(shares: DataFrame, key: str, ordering: str, part: str, sep: str = ">") -> DataFrame:
    """(key, first_share): how often the named part comes first, from counted orderings."""
    first = F.substring_index(ordering, sep, 1) == part
    return shares.groupBy(key).agg(ratio(F.sum(F.when(first, F.col("n")).otherwise(0)), F.sum("n")).alias("first_share"))


def gate(df: DataFrame, flag: str) -> DataFrame:
    """Add ``all_pass``: whether every row passes; a missing flag does not."""
    return df.withColumn("all_pass", df.agg(F.bool_and(F.coalesce(flag, F.lit(False)))).scalar())


def most_common(df: DataFrame, sample: str, label: str) -> DataFrame:
    """Most frequent label, the smaller one on a tie."""
    n = df.groupBy(sample, label).agg(F.count("*").alias("n"))
    best = F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label)))
    return n.groupBy(sample).agg(best.alias("mode"), F.max("n").alias("n_mode"), F.sum("n").alias("n_cells"))


def mapping_coverage(df: DataFrame, label: str, mapped: Column, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cells kept and dropped by a label mapping, and the labels that lose most."""
    per = df.groupBy(label, mapped.alias("mapped")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("n_cells"), F.coalesce(F.sum(F.when(F.col("mapped"), F.col("n"))), F.lit(0)).alias("n_kept"),
                    F.coalesce(F.sum(F.when(~F.col("mapped"), F.col("n"))), F.lit(0)).alias("n_dropped"))
    total = total.withColumn("fraction_dropped", ratio("n_dropped", "n_cells"))
    return total, per.where(~F.col("mapped")).orderBy(F.desc("n"), label).limit(top)


def concentration(cells: DataFrame) -> DataFrame:
    """Cells, donors and the share of the largest donor per part."""
    n = cells.groupBy("part", "donor").agg(F.count("*").alias("n"))
    return n.groupBy("part").agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_donors"),
                                 ratio(F.max("n"), F.sum("n")).alias("top_donor_share"))


def degenerate(est: DataFrame) -> DataFrame:
    """Per method: rows all in one part, uniform, all zero, with a missing value, or repeated."""
    v = F.col("value")
    packed = F.array_sort(F.collect_list(F.struct("part", "value")))  # roster-sized
    row = est.groupBy("method", "sample").agg(
        F.max(v).alias("hi"), F.min(v).alias("lo"), F.sum(v).alias("tot"), F.count_if(v.isNull()).alias("miss"),
        F.md5(F.to_json(packed)).alias("sig"))
    per = row.groupBy("method", "sig").agg(
        F.count("*").alias("n"), F.max("hi").alias("hi"), F.max("lo").alias("lo"), F.max("tot").alias("tot"),
        F.max("miss").alias("miss"))
    n = F.col("n")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return per.groupBy("method").agg(
        F.sum("n").alias("n_rows"), count(F.col("hi") > 0.99).alias("one_part"),
        count((F.col("hi") == F.col("lo")) & (F.col("tot") > 0)).alias("uniform"), count(F.col("tot") == 0).alias("all_zero"),
        count(F.col("miss") > 0).alias("non_finite"), F.sum(n - 1).alias("duplicate_rows"))


def misassignment(est: DataFrame, truth: DataFrame, a: str, b: str, parts: Sequence[str]) -> DataFrame:
    """Absence and misassignment apart: rows without signal, share a > b, share contradicting the truth."""
    wide = lambda d, keys, tag: d.where(F.col("part").isin(list(parts))).groupBy(*keys).agg(
        F.max(F.when(F.col("part") == a, F.col("value"))).alias(f"{tag}a"),
        F.max(F.when(F.col("part") == b, F.col("value"))).alias(f"{tag}b"), F.sum("value").alias(f"{tag}s"))
    j = wide(est, ["method", "sample"], "e").join(wide(truth, ["sample"], "t"), "sample")
    live = F.coalesce(F.col("es") > 0, F.lit(False))
    says, other = F.col("ea") > F.col("eb"), F.col("tb") > F.col("ta")
    out = j.groupBy("method").agg(
        F.count("*").alias("n"), F.count_if(~live).alias("n_empty"),
        F.avg(F.when(live, says.cast("double"))).alias("a_over_b"),
        F.avg(F.when(live, (says & other).cast("double"))).alias("discordant"))
    return out.withColumn("mostly_empty", F.col("n_empty") > 0.5 * F.col("n"))


def tie_groups(scores: DataFrame, value: str, ident: str = "method", digits: int = 12) -> DataFrame:
    """Methods with equal scores, listed together."""
    return scores.groupBy(F.round(value, digits).alias("score")).agg(
        F.count("*").alias("n"), F.expr(f"listagg({ident}, ',') WITHIN GROUP (ORDER BY {ident})").alias("members"))


def mark_comparable(board: DataFrame, control: Column, pairs: str = "n_pairs") -> DataFrame:
    """A row is comparable when it reaches the largest denominator of the real methods."""
    full = board.agg(F.max(F.when(~control, F.col(pairs)))).scalar()
    return board.withColumn("comparable", F.col(pairs) >= full)


def control_audit(board: DataFrame, control: Column, verdict: DataFrame | None = None, score: str = "score", alpha: float = 0.05) -> DataFrame:
    """The best control against the comparable real methods: one row.

    The board has one row per method with its score, null_mean, p_value and comparable;
    non-comparable methods are left out, since their scores have another denominator.
    ``verdict`` (method, id, weight, ok) adds the constraints that the best control
    satisfies in every group, and their share of the weight it could earn.  Ties go to the
    lower name; without a control its columns are missing and the lists are empty.
    """
    s, real = F.col(score), ~control & F.col("comparable")
    marked = board.withColumn("_best", board.agg(F.max(F.when(control, s))).scalar())
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("method")))), ",")
    got = marked.agg(
        F.min(F.when(control, F.struct((-s).alias("s"), "method"))).getField("method").alias("best_control"),
        F.max("_best").alias("best_control_score"),
        F.min(F.when(real, F.struct(s.alias("s"), "method"))).getField("method").alias("worst_real_method"),
        F.min(F.when(real, s)).alias("worst_real"), F.percentile(F.when(real, s), F.lit(0.5)).alias("median_real"),
        F.count_if(real & (s <= F.col("_best"))).alias("n_real_at_or_below"), names(real & (s <= F.col("_best"))).alias("real_at_or_below"),
        names(control & (F.col("p_value") < alpha) & (s > F.col("null_mean"))).alias("controls_above_null"))
    if verdict is None:
        return got
    best = board.where(control).agg(F.min(F.struct((-s).alias("s"), "method")).getField("method")).scalar()
    per = verdict.where(F.col("method") == best).groupBy("id").agg(
        (F.count("*") * F.max("weight")).alias("w"), F.bool_and("ok").alias("whole"))
    share = per.agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("id")))), ",").alias("perfect"),
                    ratio(F.sum(F.when(F.col("whole"), F.col("w")).otherwise(0.0)), F.sum("w")).alias("perfect_share"))
    return got.withColumn("_s", share.select(F.struct("perfect", "perfect_share")).scalar()).select(*got.columns, "_s.*")


def constraint_spread(per: DataFrame, control: Column) -> DataFrame:
    """Per constraint over methods: mean, range, control mean; unanimous ones flagged."""
    f = F.col("fraction")
    return per.groupBy("id").agg(
        F.avg(F.when(~control, f)).alias("mean"), F.min(F.when(~control, f)).alias("lowest"),
        F.max(F.when(~control, f)).alias("highest"), F.avg(F.when(control, f)).alias("control_mean"),
    ).withColumn("spread", F.col("highest") - F.col("lowest")).withColumn("unanimous", F.col("highest") == F.col("lowest"))


def resolution(verdict: DataFrame, board: DataFrame) -> DataFrame:
    """Smallest step the score can take and how many distinct scores there are."""
    step = verdict.groupBy("method").agg(ratio(F.min("weight"), F.sum("weight")).alias("step"))
    distinct = board.agg(F.count_distinct(F.round("score", 12))).scalar()
    return step.agg(F.min("step").alias("min_step"), F.max("step").alias("max_step")).withColumn("n_distinct", distinct)
