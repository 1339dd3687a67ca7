"""Part-of-whole arithmetic: closing, rescaling, converting and naming compositions.

Windows here run inside one sample, whose size is the roster of parts; the
sample is the shuffle key, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions.guards import col, ratio
from partwise.operators.ranks import prefix_sums

ROW = ("method", "sample")


def simplex_close(est: DataFrame, row: Sequence[str] = ROW, value: str = "value",
                  covered: str | None = None) -> DataFrame:
    """Clip at zero and divide by the row total.

    A missing entry or a total of zero makes the whole row missing, never
    uniform.  Where the boolean column ``covered`` is given and some part of the
    row is not covered, the row keeps its own scale and uncovered parts are
    missing.
    """
    w = Window.partitionBy(*row)
    inside = F.lit(True) if covered is None else F.coalesce(F.col(covered), F.lit(False))
    clipped = F.greatest(F.when(inside, F.col(value)), F.lit(0.0))
    clipped = F.when(inside & F.col(value).isNotNull(), clipped)
    broken = F.max((inside & F.col(value).isNull()).cast("int")).over(w) == 1
    partial = F.max((~inside).cast("int")).over(w) == 1
    total = F.sum(clipped).over(w)
    closed = F.when(broken | (F.coalesce(total, F.lit(0.0)) <= 0), None).when(partial, clipped).otherwise(
        ratio(clipped, total))
    return est.withColumn("_closed", closed).withColumn(value, F.col("_closed")).drop("_closed")


def to_cell_fractions(est: DataFrame, sizes: DataFrame, row: Sequence[str] = ROW, value: str = "value",
                      skip: str | None = None) -> DataFrame:
    """Divide by the part's size and close again; rows flagged ``skip`` pass unchanged."""
    sized = est.join(sizes.select("part", F.col("size").alias("_size")), "part", "left")
    w = Window.partitionBy(*row)
    per = ratio(value, "_size")
    total = F.sum(per).over(w)
    new = ratio(per, F.when(total > 0, total))
    if skip is not None:
        new = F.when(F.col(skip), F.col(value)).otherwise(new)
    return sized.withColumn("_new", new).withColumn(value, F.col("_new")).drop("_new", "_size")


def renormalise_within(est: DataFrame, parts: Sequence[str], row: Sequence[str] = ROW,
                       value: str = "value") -> DataFrame:
    """Shares inside a subset of parts; an empty subset is missing, not zero."""
    sub = est.where(F.col("part").isin(list(parts)))
    total = F.sum(value).over(Window.partitionBy(*row))
    return sub.withColumn("share", ratio(value, total))


def ordering(est: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Parts by falling value joined with '>'; missing unless all ``k`` are present."""
    names = F.expr(f"listagg(part, '>') WITHIN GROUP (ORDER BY {value} DESC, part)")
    return est.groupBy(*keys).agg(F.when(F.count(value) >= k, names).alias("ordering"))


def compartments(est: DataFrame, members: DataFrame, keys: Sequence[str] = ROW, value: str = "value",
                 complete: bool = True) -> DataFrame:
    """Sum parts into compartments given (compartment, part); with ``complete`` any missing part blanks the sum."""
    need = members.groupBy("compartment").agg(F.count("*").alias("_need"))
    got = est.join(members, "part").groupBy(*keys, "compartment").agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = F.when(F.col("_n") >= F.col("_need"), F.col("_s")) if complete else F.col("_s")
    return got.join(need, "compartment").select(*keys, "compartment", total.alias("total"))


def total_rescale(expr: DataFrame, sample: str = "sample", value: str = "value", scale: float = 1e6) -> DataFrame:
    """Each sample to a fixed total; an empty sample stays at zero.

    Totals are pre-aggregated and joined, so a sample with many features is not
    gathered in one task.
    """
    totals = expr.groupBy(sample).agg(F.sum(value).alias("_total"))
    out = expr.join(totals, sample)
    scaled = F.coalesce(ratio(value, "_total") * scale, F.lit(0.0))
    return out.withColumn("scaled", scaled).drop("_total")


def unit_share_log(expr: DataFrame, libraries: DataFrame, value: str = "value") -> DataFrame:
    """log1p of the count per million of the cell's library."""
    joined = expr.join(libraries.select("cell", "library"), "cell")
    return joined.withColumn("lcpm", F.log1p(ratio(value, "library") * 1e6)).drop("library")


def invert_log(value: str | Column, kind: str) -> Column:
    """Back from log2(x+1), log1p or log2(x/10+1) to x; never negative."""
    v = col(value)
    raw = {"log2p1": F.pow(F.lit(2.0), v) - 1, "log1p": F.expm1(v), "log2_tenth": (F.pow(F.lit(2.0), v) - 1) * 10}[kind]
    return F.greatest(raw, F.lit(0.0))


def grid_share(value: str | Column, step: float, below: float) -> Column:
    """Aggregate: share of small values lying on a grid."""
    x = col(value) / F.lit(step)
    on = (F.abs(x - F.bround(x)) < 1e-6).cast("double")
    return F.avg(F.when(col(value) < below, on))


def log_contrast(hi: str | Column, lo: str | Column) -> Column:
    """Aggregate: mean log2 ratio with a pseudo-count."""
    return F.avg(F.log2(col(hi) + 1) - F.log2(col(lo) + 1))


def mass_share(flag: Column, value: str | Column) -> Column:
    """Aggregate: share of the total carried by flagged rows."""
    return ratio(F.sum(F.when(flag, col(value)).otherwise(0.0)), F.sum(col(value)))


def presence_mask(parts: Sequence[str], value: str | Column = "value") -> Column:
    return F.when(F.col("part").isin(list(parts)), col(value))


def unique_names(df: DataFrame, name: str, pos: str) -> DataFrame:
    """Repeated names get .1, .2, ... in file order; the first keeps its name."""
    seen = prefix_sums(df.select(name, pos, F.lit(1).alias("_one")), [name], pos, ["_one"])
    nth = F.col("before__one")
    return df.join(seen.select(name, pos, nth.alias("_nth")), [name, pos]).withColumn(
        "unique_name", F.when(F.col("_nth") == 0, F.col(name)).otherwise(
            F.concat_ws(".", F.col(name), F.col("_nth").cast("string")))
    ).drop("_nth")


def sign_align(scores: DataFrame, directions: DataFrame, key: str = "yardstick", value: str = "score") -> DataFrame:
    """Flip scores so that more is better; a score without a declared direction is an error."""
    d = directions.select(key, "higher_is_better")
    v = F.when(F.col("higher_is_better"), F.col(value)).when(~F.col("higher_is_better"), -F.col(value))
    undeclared = F.raise_error(F.concat(F.lit("no declared direction for "), F.col(key)))
    return scores.join(d, key, "left").withColumn(
        "aligned", F.when(F.col("higher_is_better").isNull(), undeclared).otherwise(v)).drop("higher_is_better")


def roster_map(df: DataFrame, label: str, mapping: Mapping[str, str], name: str = "part") -> DataFrame:
    """Fine labels onto the roster; labels outside it are dropped."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(label))).where(F.col(name).isNotNull())


def coverage_verdict(coverage: str | Column, nominal: float = 0.95) -> Column:
    gap = col(coverage) - nominal
    return (F.when(gap < -0.25, "SEVERELY OVERCONFIDENT").when(gap < -0.10, "OVERCONFIDENT")
            .when(gap > 0.04, "CONSERVATIVE").when(gap.isNotNull(), "WELL CALIBRATED"))


def agreement_verdict(rho: Column, ci_low: Column, n: Column, min_n: int = 8, bar: float = 0.7) -> Column:
    return (F.when(n < min_n, "NOT INTERPRETABLE").when(rho.isNull(), "NOT COMPUTABLE")
            .when((rho >= bar) & (F.coalesce(ci_low, F.lit(-1.0)) > 0), "HEADLINE")
            .when(rho >= bar, "BELOW BAR").otherwise("NULL RESULT"))
