"""Correlations, rank tests and regressions per group, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.functions.guards import both, normal_tail, pearson, ratio
from partwise.operators.keys import method_grid
from partwise.operators.ranks import attach_rank, dominance, pair_counts, prefix_sums, quantiles, value_ranks
from partwise.operators.strips import STRIP, centred_ranks, numeric, rank_sums, unit_products
from partwise.session import cut_lineage, scratch


#: Pairs that a task ranks at once.
DENSE_POINTS = STRIP


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3, name: str = "rho",
             dense_points: int = DENSE_POINTS) -> DataFrame:
    """Average ranks, then Pearson; missing below ``min_n`` rows or without spread.

    Numbers are ranked in strips of about ``dense_points`` pairs of all keys, other values by running
    counts over value ranges.  Ranks are centred on their known mean (n + 1) / 2, so the sums do not cancel.
    """
    keys = list(keys)
    pairs = df.where(both(F.col(x), F.col(y))).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    with scratch(df.sparkSession) as keep:
        if numeric(pairs, "_x", "_y"):
            sums = cut_lineage(rank_sums(keep(pairs), keys, "_x", "_y", dense_points))
        else:
            sums = cut_lineage(_range_sums(keep(pairs.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("w"))), keys))
    rho = ratio("_xy", F.sqrt(F.col("_xx") * F.col("_yy")))
    return sums.select(*keys, "n", F.when(F.col("n") >= min_n, rho).alias(name))


def _range_sums(pts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, _xy, _xx, _yy): products of centred ranks of weighted points, for keys of any size."""
    centred = F.col("before") + (F.col("n") - F.col("total")) / F.lit(2.0)
    rx = value_ranks(pts, keys, "_x", "w").select(*keys, "_x", centred.alias("_rx"))
    ry = value_ranks(pts, keys, "_y", "w").select(*keys, "_y", centred.alias("_ry"))
    w, a, b = F.col("w"), F.col("_rx"), F.col("_ry")
    return pts.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"]).groupBy(*keys).agg(
        F.sum("w").alias("n"), F.sum(w * a * b).alias("_xy"), F.sum(w * a * a).alias("_xx"), F.sum(w * b * b).alias("_yy"))


def pearson_by(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 2, name: str = "r") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(both(F.col(x), F.col(y))).alias("n"),
                                 pearson(x, y, min_n=min_n).alias(name))


def partial_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str, min_n: int = 20) -> DataFrame:
    """Rank correlation of x and y with the ranks of z taken out."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*keys, x, y, z)
    for c in (x, y, z):
        full = attach_rank(full, keys, c, f"_r_{c}")
    rx, ry, rz = (f"_r_{c}" for c in (x, y, z))
    got = full.groupBy(*keys).agg(F.count("*").alias("n"), pearson(rx, ry).alias("_xy"),
                                  pearson(rx, rz).alias("_xz"), pearson(ry, rz).alias("_yz"))
    num = F.col("_xy") - F.col("_xz") * F.col("_yz")
    den = F.sqrt((1 - F.col("_xz") ** 2) * (1 - F.col("_yz") ** 2))
    return got.select(*keys, "n", F.when(F.col("n") >= min_n, ratio(num, den)).alias("partial_rho"))


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Tau-b from pair counts, without forming pairs."""
    p = pair_counts(df, keys, x, y)
    den = F.sqrt((F.col("pairs") - F.col("tied_x")) * (F.col("pairs") - F.col("tied_y")))
    return p.select(*keys, "n", ratio(F.col("concordant") - F.col("discordant"), den).alias("tau"))


def comparable_pairs(df: DataFrame, keys: Sequence[str], truth: str, estimate: str) -> DataFrame:
    """Pairs with different truth: how many, in the same order, tied in the estimate; Harrell's C."""
    p = pair_counts(df, keys, truth, estimate)
    comparable = F.col("pairs") - F.col("tied_x")
    tied = F.col("tied_y") - F.col("tied_xy")
    return p.select(*keys, "n", comparable.alias("comparable"), F.col("concordant"), tied.alias("tied")).withColumn(
        "c_index", ratio(F.col("concordant") + 0.5 * F.col("tied"), "comparable"))


def censored_concordance(df: DataFrame, keys: Sequence[str], time: str, event: str, risk: str) -> DataFrame:
    """Concordance of risk with follow-up: a pair counts when the earlier one is an event.

    At equal times an event comes before a censored patient; two events or two censored
    patients form no pair.
    """
    keys = list(keys)
    rows = df.where(F.col(time).isNotNull() & F.col(risk).isNotNull() & F.col(event).isNotNull()).select(
        *keys, time, risk, (F.col(event) == 1).cast("double").alias("_ev"), F.lit(1.0).alias("_all"))
    rows = rows.withColumn("_cen", F.col("_all") - F.col("_ev"))
    by_time = prefix_sums(rows, keys, time, ["_ev", "_cen", "_all"])
    comparable = by_time.groupBy(*keys).agg(F.sum(
        F.col("_ev") * (F.col("total__all") - F.col("before__all") - F.col("_all") + F.col("_cen"))).alias("comparable"))
    later = dominance(rows, keys, time, risk, "_ev", "_all")
    later = later.withColumn("level", F.lit(0.0))
    tied = prefix_sums(rows, [*keys, risk], time, ["_ev", "_all"]).groupBy(*keys).agg(
        F.lit(0.0).alias("crossed"), F.sum(F.col("_all") * F.col("before__ev")).alias("level"))
    level = prefix_sums(rows, [*keys, time], risk, ["_ev", "_cen"]).groupBy(*keys).agg(
        F.sum(F.col("_ev") * F.col("before__cen")).alias("crossed"), F.sum(F.col("_ev") * F.col("_cen")).alias("level"))
    cross = later.select(*keys, "crossed", "level").unionByName(tied).unionByName(level).groupBy(*keys).agg(
        F.sum("crossed").alias("crossed"), F.sum("level").alias("level"))
    if keys:
        joined = comparable.join(cross, keys)
    else:
        joined = comparable.withColumn("_x", cross.select(F.struct("crossed", "level")).scalar()).select("comparable", "_x.*")
    return joined.select(*keys, "comparable", F.col("crossed").alias("concordant"), F.col("level").alias("tied"),
                         ratio(F.col("crossed") + 0.5 * F.col("level"), "comparable").alias("c_index"))


def label_pair_counts(df: DataFrame, keys: Sequence[str], label: str, value: str, hi: str, lo: str) -> DataFrame:
    """Pairs (hi sample, lo sample) in one group: all, hi above lo, tied; from running counts."""
    sides = df.where(F.col(label).isin(hi, lo)).select(
        *keys, value, (F.col(label) == hi).cast("double").alias("hi"), (F.col(label) == lo).cast("double").alias("lo"))
    run = prefix_sums(sides, keys, value, ["hi", "lo"])
    out = run.groupBy(*keys).agg(
        (F.max("total_hi") * F.max("total_lo")).alias("n_pairs"),
        F.sum(F.col("hi") * F.col("before_lo")).alias("n_gt"), F.sum(F.col("hi") * F.col("lo")).alias("n_tie"))
    out = out.where("n_pairs > 0")
    return out.withColumn("auc", ratio(F.col("n_gt") + 0.5 * F.col("n_tie"), "n_pairs")).withColumn(
        "auc_strict", ratio("n_gt", "n_pairs")).withColumn("tie_share", ratio("n_tie", "n_pairs"))


def constraint_pairs(spark: SparkSession, constraints: Sequence[tuple]) -> DataFrame:
    """(id, weight, part, least, pair, structure, hi, lo): each side of each ordered pair that a constraint implies.

    Constraints are those of ``score.constraint_terms``; ``least`` is how many of the pairs a
    group must hold: the one of a pairwise, two of a maximum, all of a chain.
    """
    rows = []
    for ident, kind, part, structures, among, weight in constraints:
        if kind == "monotone":
            pairs = [(b, a) for a, b in zip(structures, structures[1:])]
        elif kind == "maximum":
            pairs = [(structures[0], s) for s in among if s != structures[0]]
        else:
            pairs = [(structures[0], structures[1])]
        least = 2 if kind == "maximum" else len(pairs)
        for i, (high, low) in enumerate(pairs):
            rows += [(ident, float(weight), part, least, i, high, 1.0, 0.0), (ident, float(weight), part, least, i, low, 0.0, 1.0)]
    return spark.createDataFrame(
        rows, "id STRING, weight DOUBLE, part STRING, least INT, pair INT, structure STRING, hi DOUBLE, lo DOUBLE")


def constraint_auc(rows: DataFrame, pairs: DataFrame, keys: Sequence[str], group: str = "tumour") -> DataFrame:
    """Graded twin of the constraint score: mean pair AUC per (constraint, group), weighted over both.

    ``rows`` is (keys, group, structure, part, value).  A row joins the sides it belongs to,
    a fixed few; pairs of samples are counted by running sums, never made.  The sides are sent
    to every task: dealt by part and structure, the rows would lie in as few tasks as there are of these.
    """
    keys = list(keys)
    sides = rows.where(F.col("value").isNotNull()).join(F.broadcast(pairs), ["part", "structure"])
    run = prefix_sums(sides, [*keys, group, "id", "weight", "least", "pair"], "value", ["hi", "lo"])
    per_pair = run.groupBy(*keys, group, "id", "weight", "least", "pair").agg(
        (F.max("total_hi") * F.max("total_lo")).alias("_n"),
        F.sum(F.col("hi") * F.col("before_lo")).alias("_gt"), F.sum(F.col("hi") * F.col("lo")).alias("_tie")).where("_n > 0")
    per = per_pair.groupBy(*keys, group, "id", "weight", "least").agg(
        F.count("*").alias("_k"), F.avg(F.col("_gt") / F.col("_n")).alias("_strict"), F.avg(F.col("_tie") / F.col("_n")).alias("_tied"))
    per = per.where(F.col("_k") >= F.col("least"))
    w = F.col("weight")
    mean = lambda c: ratio(F.sum(w * c), F.sum(w))
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), mean(F.col("_strict") + 0.5 * F.col("_tied")).alias("auc"), mean(F.col("_strict")).alias("auc_strict"),
        mean(F.col("_tied")).alias("tie_share"))


@F.pandas_udf(T.DoubleType())
def _exact_rank_sum(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact P(U >= u) of an untied rank-sum statistic, by counting the arrangements of the smaller side."""
    out = []
    for s, a, b in zip(u, n1, n2):
        a, b = int(a), int(b)
        few, many = min(a, b), max(a, b)
        ways = np.zeros((few + 1, a * b + 1))
        ways[0, 0] = 1.0
        for j in range(1, a + b + 1):
            for i in range(min(j, few), 0, -1):
                shift = j - i
                if shift <= many:
                    ways[i, shift:] += ways[i - 1, : a * b + 1 - shift]
        out.append(ways[few, int(np.ceil(s)):].sum() / ways[few].sum())
    return pd.Series(out, dtype="float64")


def rank_sum(df: DataFrame, keys: Sequence[str], flag: str, value: str, min_group: int = 1, exact_cells: int = 10_000) -> DataFrame:
    """Mann-Whitney U of flagged against unflagged rows: two-sided p, and p_greater for larger flagged values.

    Normal approximation with tie and continuity corrections.  Exact, and so said in the
    column ``exact``, when one side has at most eight rows, there are no ties and
    n1 * n2 is at most the parameter ``exact_cells``, the size of the exact table.
    """
    rows = df.where(F.col(flag).isNotNull()).select(
        *keys, value, F.col(flag).cast("bigint").alias("_a"), (1 - F.col(flag).cast("bigint")).alias("_b"))
    run = prefix_sums(rows, keys, value, ["_a", "_b"])
    n = (F.col("_a") + F.col("_b")).cast("double")
    got = run.groupBy(*keys).agg(
        F.max("total__a").alias("n1"), F.max("total__b").alias("n2"),
        F.sum(F.col("_a") * (F.col("before__b") + F.col("_b") / F.lit(2.0))).alias("u"), F.sum(n * n * n - n).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * (total + 1 - F.coalesce(ratio(F.col("_ties"), total * (total - 1)), F.lit(0.0))))
    off = F.col("u") - n1 * n2 / 2.0
    z = ratio(F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd)
    up = ratio(off - 0.5, sd)
    half = normal_tail(up) / 2.0
    small = (F.least(n1, n2) <= 8) & (F.col("_ties") == 0) & (n1 * n2 <= exact_cells)
    one = lambda u: (F.when(small, u).otherwise(0.0), F.when(small, n1).otherwise(1.0), F.when(small, n2).otherwise(1.0))
    far = _exact_rank_sum(*one(F.greatest(F.col("u"), n1 * n2 - F.col("u"))))
    enough = (n1 >= min_group) & (n2 >= min_group)
    two = F.when(small, F.least(F.lit(1.0), 2.0 * far)).otherwise(normal_tail(z))
    greater = F.when(small, _exact_rank_sum(*one(F.col("u")))).otherwise(F.when(up >= 0, half).otherwise(1.0 - half))
    return got.select(*keys, "n1", "n2", "u", F.when(enough, two).alias("p_value"), F.when(enough, greater).alias("p_greater"),
                      small.alias("exact"), ratio("u", n1 * n2).alias("auc"))


def mean_pairwise_rank_r(df: DataFrame, keys: Sequence[str], setting: str, unit: Sequence[str], value: str) -> DataFrame:
    """(keys, n_settings, n_units, stability): the mean rank correlation over all pairs of settings.

    No pair is a row: with ranks standardised inside a setting, the mean square of a
    unit's sum over R settings is R + R (R - 1) times the mean correlation.  Units that
    lack a value in one setting are left out; a constant setting has no correlation and
    does not count; fewer than two settings have no stability.
    """
    keys, unit = list(keys), list(unit)
    rows = df.where(reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, *unit], F.col(value).isNotNull()))
    # What is kept is one row per unit, the number of its values; few units lack one.
    known = cut_lineage(rows.groupBy(*keys, *unit).agg(F.count("*").alias("_v")))
    full = known.groupBy(*keys).agg(F.max("_v").alias("_full"))
    lacking = known.join(F.broadcast(full), keys).where("_v < _full").select(*keys, *unit) if keys else known.where(
        F.col("_v") < known.agg(F.max("_v")).scalar())
    whole = rows.where(F.col(setting).isNotNull()).select(*keys, *unit, setting, F.col(value).alias("_x"))
    if not lacking.isEmpty():
        whole = whole.join(lacking.select(*keys, *unit), [*keys, *unit], "left_anti")
    by = [*keys, setting]
    with scratch(df.sparkSession) as keep:
        whole = keep(whole)
        if numeric(whole, "_x"):
            ranked = centred_ranks(whole, by, "_x", "_r")
        else:
            centred = F.col("before") + (F.col("n") - F.col("total")) / F.lit(2.0)
            ranked = whole.join(value_ranks(whole, by, "_x").select(*by, "_x", centred.alias("_r")), [*by, "_x"]).drop("_x")
        got = cut_lineage(unit_products(ranked, keys, setting, unit, "_r", whole.count()))
    n = F.col("n_settings")
    return got.select(*keys, "n_settings", "n_units", ratio(F.col("_q") - n, n * (n - 1)).alias("stability"))


def method_pair_correlation(est: DataFrame, methods: Sequence[str], unit: Sequence[str], keys: Sequence[str],
                            value: str = "value") -> DataFrame:
    """Pearson r of every pair of methods on shared units.

    One wide row per unit (the roster of methods bounds it) and one aggregate
    expression per pair: no pair is ever a row.
    """
    wide = method_grid(est, methods, unit, value)
    cells = [
        F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"),
                 F.count_if(both(F.col(a), F.col(b))).alias("n"), pearson(a, b).alias("r"))
        for a, b in combinations(sorted(methods), 2)
    ]
    return wide.groupBy(*keys).agg(F.array(*cells).alias("_c")).select(*keys, F.explode("_c").alias("c")).select(*keys, "c.*")


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided sign-test p: a sum over the n + 1 outcomes of a fair coin.

    Terms are built by the ratio C(n, i+1) / C(n, i) from 2**-n; n is the number
    of methods or factors, tens at most.
    """
    m = F.least(k, n - k)
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(
        F.sequence(F.lit(0), F.greatest(m, F.lit(0)).cast("int")), start,
        lambda acc, i: F.struct((acc.term * (n - i) / (i + 1)).alias("term"), (acc.sum + acc.term).alias("sum")),
        lambda acc: acc.sum,
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * tail))


def sign_test(df: DataFrame, keys: Sequence[str], agrees: Column) -> DataFrame:
    """How many rows go the predicted way, and the two-sided exact p."""
    got = df.groupBy(*keys).agg(F.count(agrees).alias("n"), F.count_if(agrees).alias("k"))
    return got.withColumn("p_value", binomial_two_sided(F.col("k"), F.col("n")))


def holm(df: DataFrame, keys: Sequence[str], p: str, ident: str) -> DataFrame:
    """Step-down adjustment; a family is the handful of hypotheses tested together."""
    fam = Window.partitionBy(*keys)
    order = fam.orderBy(p, ident)
    kept = df.where(F.col(p).isNotNull())
    raw = (F.count("*").over(fam) - F.row_number().over(order) + 1) * F.col(p)
    step = kept.withColumn("_step", F.least(raw, F.lit(1.0)))
    return step.withColumn("holm_p", F.max("_step").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def error_arms(et: DataFrame, covariates: DataFrame | None, names: Sequence[str]) -> DataFrame:
    """Which covariates explain absolute and signed error: ``regression`` per (method, part, arm).

    ``et`` is (method, sample, part, e, t), ``covariates`` has sample and ``names``; without it
    ``et`` has them itself, one value per sample, and nothing is joined.  The
    part ``all`` is the mean absolute error over a sample's parts; it has no signed arm,
    since differences of compositions sum to zero.
    """
    d = F.col("e") - F.col("t")
    names = list(names)
    if covariates is not None:
        et = et.join(covariates.select("sample", *names), "sample")
    rows = et.where(d.isNotNull())
    total = rows.groupBy("method", "sample").agg(F.avg(F.abs(d)).alias("err"), *[F.max(c).alias(c) for c in names]).select(
        "method", F.lit("all").alias("part"), F.lit("absolute").alias("arm"), "err", *names)
    arms = F.array(F.struct(F.lit("absolute").alias("arm"), F.abs(d).alias("err")), F.struct(F.lit("signed").alias("arm"), d.alias("err")))
    each = rows.select("method", "part", F.inline(arms), *names).select("method", "part", "arm", "err", *names)
    return regression(total.unionByName(each), ["method", "part", "arm"], names, "err")


def regression(df: DataFrame, keys: Sequence[str], covariates: Sequence[str], outcome: str) -> DataFrame:
    """Least squares on standardised covariates (population sd, zero sd -> 1) per group.

    Spark reduces each group to its cross-moments; only one small system per
    group is solved in Python.
    """
    import numpy as np

    cov, p = list(covariates), len(covariates)
    full = F.col(outcome).isNotNull()
    for c in cov:
        full = full & F.col(c).isNotNull()
    xs = [F.col(c) for c in cov]
    moments = [F.covar_pop(xs[i], xs[j]) for i in range(p) for j in range(p)]
    got = df.where(full).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(outcome).alias("intercept"), F.array(*moments).alias("xx"),
        F.array(*[F.covar_pop(x, F.col(outcome)) for x in xs]).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xx, xy):
            a = np.asarray(a, dtype="float64").reshape(p, p)
            sd = np.sqrt(np.diag(a))
            sd = np.where(sd > 0, sd, 1.0)
            beta, *_ = np.linalg.lstsq(a / np.outer(sd, sd), np.asarray(b, dtype="float64") / sd, rcond=None)
            out.append(beta.tolist())
        return pd.Series(out)

    names = F.array(*[F.lit(c) for c in cov])
    solved = got.withColumn("_b", solve("xx", "xy"))
    return solved.select(*keys, "n", "intercept", F.explode(F.arrays_zip(names.alias("factor"), F.col("_b").alias("beta"))).alias(
        "z")).select(*keys, "n", "intercept", "z.factor", "z.beta")


def quantile_edges(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """(keys, edges): sorted distinct quantile edges."""
    probs = [i / bins for i in range(bins + 1)]
    names = [f"_q{i}" for i in range(bins + 1)]
    q = quantiles(df, keys, value, probs, names)
    return q.select(*keys, "n_values", F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """0-based bin of a value: (e0, e1], (e1, e2], ...; the lowest value is in the first bin."""
    above = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNotNull(), F.greatest(above - 1, F.lit(0)))
