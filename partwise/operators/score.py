"""Ordinal constraints: group means, verdicts, weighted scores and their breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions.guards import ratio


def group_means(est: DataFrame, manifest: DataFrame | None, keys: Sequence[str] = ("method", "tumour", "structure", "part"),
                value: str = "value", digits: int | None = None) -> DataFrame:
    """Mean per group and structure, missing skipped: one value per group however many samples.

    Without a manifest ``est`` has the samples' columns already, so that no join sorts its rows.
    """
    mean = F.avg(value)
    if digits is not None:
        mean = F.round(mean, digits)
    rows = est if manifest is None else est.join(manifest, "sample")
    return rows.groupBy(*keys).agg(mean.alias("v"))


def constraint_terms(spark: SparkSession, constraints: Sequence[tuple]) -> DataFrame:
    """One row per (constraint, structure it looks at).

    Constraints are (id, kind, part, structures, among, weight): a fixed, small
    table written by hand, so it is a local relation.
    """
    rows = []
    for ident, kind, part, structures, among, weight in constraints:
        if kind not in ("pairwise", "maximum", "monotone"):
            raise ValueError(f"unknown constraint kind {kind!r}")
        chain = list(structures)
        if kind == "maximum":
            chain = [structures[0], *[s for s in among if s != structures[0]]]
        rows += [(ident, kind, part, float(weight), len(chain), s, i) for i, s in enumerate(chain)]
    return spark.createDataFrame(
        rows, "id STRING, kind STRING, part STRING, weight DOUBLE, n_terms INT, structure STRING, pos INT")


def verdicts(means: DataFrame, terms: DataFrame, keys: Sequence[str], value: str = "v", min_others: int = 2) -> DataFrame:
    """(keys, id, weight, ok) for every constraint the group can evaluate.

    An equi-join on (part, structure) and one aggregate.  Pairwise needs both
    structures, a maximum the target and ``min_others`` others, a chain all of its links; a
    tie is a violation.  What cannot be evaluated leaves no row.
    """
    v = F.col(value)
    joined = means.where(v.isNotNull()).join(terms, ["part", "structure"])
    steps = F.array_sort(F.collect_list(F.struct("pos", v.alias("v"))))
    got = joined.groupBy(*keys, "id", "kind", "weight", "n_terms").agg(
        F.max(F.when(F.col("pos") == 0, v)).alias("first"),
        F.max(F.when(F.col("pos") > 0, v)).alias("rest"),
        F.count_if(F.col("pos") > 0).alias("n_rest"),
        F.when(F.col("kind") == "monotone", steps).alias("steps"),
    )
    pair = F.when((F.col("n_rest") == 1), F.col("first") > F.col("rest"))
    top = F.when(F.col("n_rest") >= min_others, F.col("first") > F.col("rest"))
    links = F.transform(
        F.slice("steps", 1, F.col("n_terms") - 1),
        lambda s, i: s.v < F.get(F.col("steps"), i + 1).v,
    )
    chain = F.when(F.size("steps") == F.col("n_terms"), F.forall(links, lambda x: x))
    ok = F.when(F.col("kind") == "pairwise", pair).when(F.col("kind") == "maximum", top).otherwise(chain)
    return got.select(*keys, "id", "weight", ok.alias("ok")).where("ok IS NOT NULL")


def weigh(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Satisfied and evaluable weight per key: what resampling works on."""
    w = F.col("weight")
    return table.groupBy(*keys).agg(
        F.sum(F.when(F.col("ok"), w).otherwise(0.0)).alias("num"), F.sum(w).alias("den"),
        F.count("*").alias("n_pairs"))


def score(table: DataFrame, keys: Sequence[str] = ("method",), group: str = "tumour") -> DataFrame:
    """Weighted share of satisfied (constraint, group) pairs."""
    w = F.col("weight")
    return table.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.count_distinct(group).alias("n_tumours"),
        F.sum(w).alias("weight_evaluated"),
        F.sum(F.when(F.col("ok"), w).otherwise(0.0)).alias("weight_satisfied"),
    ).withColumn("score", ratio("weight_satisfied", "weight_evaluated"))


def per_group(table: DataFrame, keys: Sequence[str] = ("method", "tumour")) -> DataFrame:
    """Per group: counts, weights, score and the ids on each side."""
    w = F.col("weight")
    ids = lambda cond: F.coalesce(
        F.expr(f"listagg(CASE WHEN {cond} THEN id END, ',') WITHIN GROUP (ORDER BY CASE WHEN {cond} THEN id END)"), F.lit(""))
    return table.groupBy(*keys).agg(
        F.count("*").alias("n_evaluable"), F.count_if("ok").alias("n_satisfied"),
        F.sum(w).alias("weight_evaluated"), F.sum(F.when(F.col("ok"), w).otherwise(0.0)).alias("weight_satisfied"),
        ids("ok").alias("satisfied"), ids("NOT ok").alias("violated"),
    ).withColumn("score", ratio("weight_satisfied", "weight_evaluated"))


def per_constraint(table: DataFrame, terms: DataFrame, methods: DataFrame) -> DataFrame:
    """Per method and constraint, keeping constraints nobody could evaluate."""
    ids = terms.select("id").distinct()
    got = table.groupBy("method", "id").agg(F.count("*").alias("n_evaluable"), F.count_if("ok").alias("n_satisfied"))
    every = methods.select("method").distinct().withColumn("id", F.explode(_id_array(ids)))
    out = every.join(got, ["method", "id"], "left").na.fill(0, ["n_evaluable", "n_satisfied"])
    return out.withColumn("fraction", ratio("n_satisfied", "n_evaluable"))


def _id_array(ids: DataFrame):
    return ids.agg(F.array_sort(F.collect_set("id"))).scalar()
