"""Tables about the run itself: power, gaps, tiers, contrasts and replication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.guards import ratio

MIN_EVENTS = 80  # fixed value: fewer events cannot rank methods


def power_contract(people: DataFrame, n_covariates: int, keys: Sequence[str] = ()) -> DataFrame:
    """Patients, events, events per covariate, detectable difference and a verdict."""
    e = F.count_if(F.col("event") == 1)
    got = people.groupBy(*keys).agg(F.count("*").alias("n"), e.alias("events"))
    ev = F.col("events")
    return got.select(
        *keys, "n", "events", (F.col("n") - ev).alias("censored"), (ev / F.lit(float(max(n_covariates, 1)))).alias("per_covariate"),
        F.when(ev > 1, 1.96 * F.sqrt(ratio(F.lit(2.0), ev))).alias("detectable"), (ev >= MIN_EVENTS).alias("powered"),
        F.when(ev == 0, "BLOCKED").when(ev >= MIN_EVENTS, "ADEQUATE").otherwise("UNDERPOWERED").alias("verdict"))


def rank_with_refusal(scores: DataFrame, contract: DataFrame, score: str = "score") -> DataFrame:
    """Gap to the best; without power every row is inconclusive."""
    best = scores.agg(F.max(score)).scalar()
    c = contract.select(F.struct("powered", "detectable")).scalar()
    gap = F.col("best") - F.col(score)
    j = scores.withColumn("best", best).withColumn("_c", c)
    reading = (F.when(~F.col("_c.powered"), "INCONCLUSIVE").when(gap <= F.col("_c.detectable"), "tied with best")
               .otherwise("worse than best"))
    return j.select(*scores.columns, gap.alias("gap"), reading.alias("interpretation"))


def paired_contrast(results: DataFrame, pairs: DataFrame, directions: DataFrame) -> DataFrame:
    """Named method pairs (a, b) over outcomes: difference and whether b improves on a."""
    a = results.select(F.col("method").alias("a"), "outcome", F.col("value").alias("value_a"))
    b = results.select(F.col("method").alias("b"), "outcome", F.col("value").alias("value_b"))
    j = pairs.join(a, "a").join(b, ["b", "outcome"]).join(directions, "outcome")
    d = F.col("value_b") - F.col("value_a")
    better = F.when(F.col("higher_is_better"), d > 0).otherwise(d < 0)
    return j.groupBy("a", "b").agg(F.count("*").alias("n_outcomes"), F.count_if(better).alias("n_improved"), F.avg(d).alias("mean_change"))


def with_and_without(results: DataFrame, attributes: DataFrame, flag: str) -> DataFrame:
    """Mean outcome of methods with an attribute and without it."""
    v = F.col("value")
    return results.join(attributes, "method").groupBy("outcome").agg(
        F.avg(F.when(F.col(flag), v)).alias("with_it"), F.avg(F.when(~F.col(flag), v)).alias("without_it"))


def replication(first: DataFrame, second: DataFrame, share: float = 0.75, alpha: float = 0.05) -> DataFrame:
    """The same factor in two cohorts.

    ``first`` is (factor, beta, supported); ``second`` is (factor, beta, n_agree,
    n_methods, p).  Direction first, then consistency, then significance.
    """
    a = first.select("factor", F.col("beta").alias("beta_1"), "supported")
    b = second.select("factor", F.col("beta").alias("beta_2"), "n_agree", "n_methods", "p")
    j = a.join(b, "factor", "full")
    same = (F.signum("beta_1") == F.signum("beta_2")) & (F.signum("beta_1") != 0)
    steady = F.col("n_agree") >= share * F.col("n_methods")
    sig = F.coalesce(F.col("p") < alpha, F.lit(False))
    verdict = (
        F.when(F.col("beta_1").isNull() | F.col("beta_2").isNull(), "NOT TESTABLE")
        .when(F.col("supported") & same & steady & sig, "REPLICATED")
        .when(F.col("supported") & same & steady, "direction agrees, not significant")
        .when(F.col("supported") & same, "direction agrees, inconsistent")
        .when(F.col("supported"), "REVERSED").when(sig & steady, "null first, SUPPORTED second").otherwise("null in both"))
    return j.withColumn("same_direction", same).withColumn("verdict", verdict)


def gaps(roster: DataFrame, truths: DataFrame, measured: DataFrame, reasons: DataFrame) -> DataFrame:
    """Every method x truth cell: measured, or missing with the stated reason."""
    names = truths.agg(F.array_sort(F.collect_set("truth"))).scalar()
    grid = roster.select("method").distinct().withColumn("truth", F.explode(names))
    j = grid.join(measured.select("method", "truth", "n", "value"), ["method", "truth"], "left").join(reasons, ["method", "truth"], "left")
    return j.withColumn("status", F.when(F.col("value").isNotNull(), "measured").when(F.col("reason").isNotNull(), "explained").otherwise("GAP"))


def tiers(methods: DataFrame, rules: Mapping[str, Column], default: str = "other") -> DataFrame:
    """First matching rule names the tier."""
    tier: Column | None = None
    for name, cond in rules.items():
        tier = F.when(cond, name) if tier is None else tier.when(cond, name)
    return methods.withColumn("tier", tier.otherwise(default) if tier is not None else F.lit(default))


def non_comparable(requirements: DataFrame, degenerate: DataFrame, failed: DataFrame) -> DataFrame:
    """Excluded methods with one reason each: stated requirement, then degenerate, then failed."""
    stack = (requirements.select("method", F.lit(0).alias("_o"), "reason")
             .unionByName(degenerate.select("method", F.lit(1).alias("_o"), F.lit("observed degenerate in this run").alias("reason")))
             .unionByName(failed.select("method", F.lit(2).alias("_o"), F.lit("failed in this run").alias("reason"))))
    return stack.groupBy("method").agg(F.min_by("reason", "_o").alias("reason"))


def reproduction(diff: DataFrame, explanations: DataFrame, artefact: str = "artefact") -> DataFrame:
    """Rows per artefact and status, with an explanation when a pattern covers the artefact."""
    per = diff.groupBy(artefact, "status").agg(F.count("*").alias("n"))
    pats = explanations.agg(F.collect_list(F.struct("pattern", "why"))).scalar()
    hit = F.filter("_p", lambda p: F.regexp_like(F.col(artefact), p.pattern))
    j = per.withColumn("_p", pats)
    why = F.get(hit, F.lit(0)).getField("why")
    quiet = F.col("status").isin("reproduced", "noise")
    return j.select(artefact, "status", "n", F.when(~quiet, why).alias("why"), (quiet | why.isNotNull()).alias("accounted"))


