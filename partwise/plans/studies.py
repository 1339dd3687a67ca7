"""Named compositions: each takes long tables and returns one result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.guards import pearson, ratio
from partwise.operators import compose as C
from partwise.operators import diff as D
from partwise.operators import fit as FT
from partwise.operators import keys as K
from partwise.operators import ledgers as L
from partwise.operators import metrics as M
from partwise.operators import profiles as P
from partwise.operators import resample as RS
from partwise.operators import score as S
from partwise.operators import stats as ST
from partwise.operators import windows as W
from partwise.session import cut_lineage, scratch


def constraint_leaderboard(est: DataFrame, samples: DataFrame, terms: DataFrame, controls: Sequence[str],
                           n_permutations: int = 10_000, n_boot: int = 2_000, seed: str = "board",
                           digits: int | None = None, who: Sequence[tuple] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Score, interval, null p, tie size and comparable flag of every method, best first.

    ``who`` lists the methods, each as a tuple, and ``table`` has the verdicts per method and tumour, if they are known.
    """
    if table is None:
        table = cut_lineage(S.verdicts(S.group_means(est, samples, digits=digits), terms, ["method", "tumour"]))
    board = S.score(table).withColumn("score", F.round("score", 12))
    ci = RS.cluster_bootstrap(S.weigh(table, ["method", "tumour"]), ["method"], "tumour", n_boot, seed + "-boot")
    p = RS.null_p(RS.scores_by_draw(est, samples, terms, n_permutations, seed + "-perm", digits, who=who), ["method"], "score").select(
        "method", "null_mean", "p_value")
    ties = M.tie_groups(board, "score").select("score", F.col("n").alias("tie_size"))
    out = M.mark_comparable(board, F.col("method").isin(list(controls))).join(ci.select("method", "ci_low", "ci_high"), "method")
    out = out.join(p, "method", "left").join(ties, "score", "left")
    return W.ordered(out, ("comparable", True), ("score", True), ("method", False))


def accuracy_benchmark(expr: DataFrame, cells: DataFrame, targets: DataFrame, parts: Sequence[str], n_features: int,
                       seed: str, n_boot: int = 200) -> DataFrame:
    """Held-out mixtures, profiles from the training donors, every method, errors and ties.

    Methods: plain least squares, the same with an extra part, and the two controls.
    """
    test = cut_lineage(P.donor_split(cells, fraction=0.25, seed=seed))
    train_cells = K.holdout(cells, test, test=False)
    mix, truth = RS.mixtures(expr, K.holdout(cells, test, test=True), targets, seed)
    profile = cut_lineage(P.profile_and_variance(expr, train_cells))
    chosen = P.top_features(profile, n_features).select("feature")
    sig = cut_lineage(profile.join(chosen, "feature", "left_semi").select("feature", "part", "mean"))
    bulk = cut_lineage(mix.join(chosen, "feature", "left_semi").withColumnRenamed("mixture", "sample"))
    shuffled = cut_lineage(FT.shuffled_signature(sig, seed))
    fits = K.stack({
        "nnls": FT.nnls(sig, bulk, parts), "nnls_other": FT.nnls(FT.with_extra_part(sig, len(parts)), bulk, [*parts, "~other"]).where("part <> '~other'"),
        "shuffled": FT.nnls(shuffled, bulk, parts), "random": FT.random_shares(bulk.select("sample").distinct(), parts, seed)})
    closed = C.simplex_close(fits)
    donor_of = targets.select(F.col("mixture").alias("sample"), F.col("donor").alias("group")).distinct()
    grid = truth.select(F.col("mixture").alias("sample")).distinct().withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts])))
    full = grid.join(truth.select(F.col("mixture").alias("sample"), "part", F.col("share").alias("t")), ["sample", "part"], "left").na.fill(0.0, ["t"])
    et = cut_lineage(closed.withColumnRenamed("value", "e").join(full, ["sample", "part"]).join(donor_of, "sample"))
    board = M.overall(et, parts, len(parts))
    err = M.per_sample(et, parts).groupBy("method", "group").agg(F.avg("mae_primary").alias("mae"))
    ties = RS.paired_ties(cut_lineage(err), n_boot, seed).select("method", "delta", "ci_low", "ci_high", "tied")
    return W.ordered(board.join(ties, "method"), ("comparable", True), ("mae_primary", False))


def ranking_agreement(a: DataFrame, truths: DataFrame, directions: DataFrame, controls: Sequence[str], n_boot: int = 5_000,
                      seed: str = "agree", min_methods: int = 8, bar: float = 0.7) -> DataFrame:
    """Does ranking a track each yardstick: rho, interval, verdict; yardsticks without data stay as rows.

    ``a`` is (method, score); ``truths`` is (yardstick, method, score).
    """
    aligned = C.sign_align(truths, directions)
    j = aligned.where(F.col("aligned").isNotNull() & ~F.col("method").isin(list(controls))).join(
        a.where(F.col("score").isNotNull()).select("method", F.col("score").alias("a")), "method")
    j = cut_lineage(j.select("yardstick", "method", F.round("a", 12).alias("a"), F.round("aligned", 12).alias("t")))
    rho = ST.spearman(j, ["yardstick"], "a", "t", 3)
    distinct = j.groupBy("yardstick").agg(F.count_distinct("a", "t").alias("n_distinct"))
    ci = RS.bootstrap_rho(j, ["yardstick"], "method", "a", "t", n_boot, seed).select("yardstick", "ci_low", "ci_high")
    out = directions.select("yardstick").join(rho, "yardstick", "left").join(distinct, "yardstick", "left").join(ci, "yardstick", "left")
    verdict = F.when(F.col("n").isNull(), "UNAVAILABLE").otherwise(
        C.agreement_verdict(F.col("rho"), F.col("ci_low"), F.col("n_distinct"), min_methods, bar))
    return out.withColumn("verdict", verdict)


def purity_samples(fits: DataFrame, barcodes: DataFrame, truth: DataFrame, part: str) -> DataFrame:
    """(method, sample, e, t, error): one part of every sample beside its truth, missing where the sample has none."""
    joined = K.tiered_join(barcodes, truth, "strict", "loose", "alt", F.col("standard"), "purity", "pos")
    return fits.where(F.col("part") == part).join(joined, "sample").select(
        "method", "sample", F.col("value").alias("e"), F.col("corrected").alias("t")).withColumn("error", F.col("e") - F.col("t"))


def purity_yardstick(samples: DataFrame) -> DataFrame:
    """``purity_samples`` per method: levels and correlations with the truth where both are known."""
    rows = cut_lineage(samples.where("t IS NOT NULL AND e IS NOT NULL").select("method", "e", "t"))
    return M.levels(rows, ["method"]).join(ST.spearman(rows, ["method"], "e", "t").drop("n"), "method").join(
        rows.groupBy("method").agg(pearson("e", "t").alias("r")), "method")


def truth_ordering(est: DataFrame, truth: DataFrame, parts: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean ordering inside a subset against the truth's, and per-sample disagreement."""
    k = len(parts)
    mean = lambda d, keys: d.groupBy(*keys, "part").agg(F.round(F.avg("share"), 10).alias("v"))
    e = C.ordering(mean(C.renormalise_within(est, parts), ["method"]), ["method"], "v", k)
    t = truth.withColumn("method", F.lit("truth"))
    to = C.ordering(mean(C.renormalise_within(t, parts), ["method"]), ["method"], "v", k).select("ordering").scalar()
    per = M.misassignment(est, truth, a, b, parts)
    return e.join(per, "method").withColumn("truth_ordering", to).withColumn("matches", F.col("ordering") == F.col("truth_ordering"))


def tracking(rows: DataFrame, n_draws: int, seed: str, strata: int = 3) -> tuple[DataFrame, DataFrame]:
    """Permutation Spearman per method and part, and the same correlation inside truth strata.

    ``rows`` is (method, part, unit, e, t).
    """
    with scratch(rows.sparkSession) as keep:
        rows = keep(rows)
        whole = RS.permutation_spearman(rows, ["method", "part"], "unit", "e", "t", n_draws, seed, stored=True)
        binned = W.quantile_bins(rows, ["method", "part"], "t", strata)
        return whole, ST.spearman(binned, ["method", "part", "bin"], "e", "t")


def evaluation_grid(et: DataFrame, roster: DataFrame, truths: DataFrame, reasons: DataFrame, min_n: int = 10) -> DataFrame:
    """Spearman of every method against every truth, with a reason for each empty cell."""
    rho = ST.spearman(et, ["method", "truth"], "e", "t", min_n, "value")
    return L.gaps(roster, truths, rho, reasons)


def error_factors(rows: DataFrame, covariates: Sequence[str], outcome: str) -> DataFrame:
    """Which covariates explain error in cohort 0, with Holm over factors, and do they replicate in cohort 1."""
    beta = ST.regression(rows, ["cohort", "method"], covariates, outcome)
    mid = beta.groupBy("cohort", "factor").agg(
        F.percentile("beta", F.lit(0.5)).alias("beta"), F.count("*").alias("n_methods"), F.count_if(F.col("beta") > 0).alias("n_up"))
    mid = mid.withColumn("n_agree", F.greatest("n_up", F.col("n_methods") - F.col("n_up"))).withColumn(
        "p", ST.binomial_two_sided(F.col("n_up"), F.col("n_methods")))
    adj = cut_lineage(ST.holm(mid, ["cohort"], "p", "factor"))
    first = adj.where("cohort = 0").select("factor", "beta", (F.col("n_agree") >= 0.75 * F.col("n_methods")).alias("supported"))
    second = adj.where("cohort = 1").select("factor", "beta", "n_agree", "n_methods", F.col("holm_p").alias("p"))
    return L.replication(first, second)


def group_score_factors(est: DataFrame, samples: DataFrame, terms: DataFrame, properties: DataFrame, n_draws: int, seed: str,
                        digits: int | None = None, who: Sequence[tuple] | None = None) -> DataFrame:
    """Per-tumour score minus its own shuffled mean, correlated with a tumour property."""
    draws = RS.scores_by_draw(est, samples, terms, n_draws, seed, digits, per_group=True, who=who)
    first = F.col("draw") == 0
    both = cut_lineage(draws.groupBy("method", "tumour").agg(
        F.max(F.when(first, F.col("score"))).alias("score"), F.avg(F.when(~first, F.col("score"))).alias("null_mean")))
    excess = both.where("score IS NOT NULL AND null_mean IS NOT NULL").join(properties, "tumour").withColumn(
        "excess", F.round(F.col("score") - F.col("null_mean"), 9))
    out = RS.permutation_spearman(cut_lineage(excess), ["method"], "tumour", "excess", "property", n_draws, seed)
    return ST.holm(out.withColumn("family", F.lit(1)), ["family"], "p_value", "method").drop("family")


def marker_check(measured: DataFrame, samples: DataFrame, terms: DataFrame, n_draws: int, seed: str, digits: int | None = None) -> DataFrame:
    """The constraints on a measured table: share of tumours that satisfy each, with a shuffled null."""
    table = RS.score_draws(measured, samples, terms, n_draws, seed, digits, keys=(), min_others=1, by_id=True)
    return RS.null_p(table.groupBy("id", "draw").agg(F.avg(ratio("num", "den")).alias("rate")), ["id"], "rate")


def identifiability(est: DataFrame, truth: DataFrame, methods: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per part: mean agreement between methods and median correlation with the truth; and their exact rank p."""
    agree = ST.method_pair_correlation(est, methods, ["sample", "part"], ["part"]).groupBy("part").agg(F.avg("r").alias("agreement"))
    et = K.align(est, truth, by="sample")
    rho = ST.spearman(et, ["method", "part"], "e", "t").groupBy("part").agg(F.percentile("rho", F.lit(0.5)).alias("truth_rho"))
    units = cut_lineage(agree.join(rho, "part").withColumns({c: F.round(c, 9) for c in ("agreement", "truth_rho")}))
    test = RS.exact_permutation(units.withColumn("k", F.lit(1)), ["k"], "part", "agreement", "truth_rho", 8).drop("k")
    return units, test


def setting_stability(rows: DataFrame, setting: str, unit: Sequence[str], value: str) -> DataFrame:
    """(part, n_settings, n_units, stability) over the settings with different output; of equal ones the least counts."""
    kept = D.distinct_settings(rows.withColumn("_pos", F.col(setting)), setting, "_pos", [*unit, "part", value]).select(F.col("kept").alias(setting))
    return ST.mean_pairwise_rank_r(rows.join(F.broadcast(cut_lineage(kept)), setting, "left_semi"), ["part"], setting, unit, value)


def reference_sensitivity(bulk: DataFrame, sig_a: DataFrame, sig_b: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The same data under two references on their shared features: rank of each part's mean and its move."""
    shared = K.shared_features(bulk.select("feature").distinct().withColumn("pos", F.col("feature")), [sig_a, sig_b], "feature", "pos").select("feature")
    keep = lambda d: d.join(shared, "feature", "left_semi")
    level = lambda s: C.simplex_close(FT.nnls(keep(s), keep(bulk), parts), ["sample"]).groupBy(F.col("part").alias("method")).agg(
        F.round(F.avg("value"), 9).alias("score"))
    return W.rank_change(cut_lineage(level(sig_a)), cut_lineage(level(sig_b)))


def atlas_counts(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Cells of two parts pooled and per donor: direction, sign-test p and a reading."""
    n = cells.groupBy("donor").agg(F.count_if(F.col("part") == a).alias("na"), F.count_if(F.col("part") == b).alias("nb"))
    untied = F.col("na") != F.col("nb")
    got = n.agg(F.sum("na").alias("pooled_a"), F.sum("nb").alias("pooled_b"), F.count_if(untied).alias("n_donors"),
                F.count_if(F.col("na") > F.col("nb")).alias("n_a_over_b"))
    got = got.withColumn("p_value", ST.binomial_two_sided(F.col("n_a_over_b"), F.col("n_donors")))
    pooled, most = F.col("pooled_a") > F.col("pooled_b"), F.col("n_a_over_b") * 2 > F.col("n_donors")
    return got.withColumn("reading", F.when(pooled & most, "CONFIRMED").when(~pooled & ~most, "NOT CONFIRMED").otherwise("INCONCLUSIVE"))


def method_comparability(roster: DataFrame, requirements: DataFrame, degenerate: DataFrame, failed: DataFrame) -> DataFrame:
    """Every method with its reason for exclusion, if any."""
    out = L.non_comparable(requirements, degenerate, failed)
    return roster.select("method").distinct().join(out, "method", "left").withColumn("comparable", F.col("reason").isNull())
