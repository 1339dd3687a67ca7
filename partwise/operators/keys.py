"""Joins that repair keys, align tables and report what did not match."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.guards import col


def keep_first(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """First row per key in the order of ``pos``; combines map-side, so no key is gathered."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(pos)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def manifest_join(matrix: DataFrame, manifest: DataFrame, key: str = "sample") -> DataFrame:
    """Rows whose sample is in both tables; no overlap is an error with example ids."""
    out = matrix.join(manifest, key)
    if out.isEmpty():
        some = lambda d: [r[0] for r in d.select(key).limit(3).collect()]
        raise ValueError(f"no shared {key}: {some(matrix)} vs {some(manifest)}")
    return out


def id_to_symbol(rows: DataFrame, names: DataFrame, ident: str, symbol: str = "symbol") -> DataFrame:
    """Translate ids, dropping blank symbols; duplicates are left to a collapse."""
    good = names.where(F.col(symbol).isNotNull() & ~F.lower(F.trim(F.col(symbol))).isin("", "nan"))
    return rows.join(good.select(ident, symbol), ident)


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs; a value with two partners on either side is an error."""
    d = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    for side, other in ((left, right), (right, left)):
        clash = d.groupBy(side).agg(F.count(other).alias("n")).where("n > 1").limit(3).collect()
        if clash:
            raise ValueError(f"{side} maps to several {other}: {[r[0] for r in clash]}")
    return d


def rekey(rows: DataFrame, bridge: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rows under the new key, and the old ids without one."""
    return rows.join(bridge, old), rows.join(bridge, old, "left_anti").select(old).distinct()


def tiered_join(left: DataFrame, right: DataFrame, strict: str, loose: str, alt: str,
                standard: Column, value: str, pos: str) -> DataFrame:
    """Three join policies side by side.

    strict: standard rows by ``strict``; corrected: strict, else the foreign rows
    by ``alt`` against the left ``loose`` key; loose: every row by ``alt``.
    Duplicate right keys keep the first by ``pos``.
    """
    def side(rows: DataFrame, key: str, name: str, on: str) -> DataFrame:
        one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(on)).agg(
            F.min_by(value, pos).alias(name), F.lit(True).alias(f"_has_{name}"))
        return one
    flag = F.coalesce(standard, F.lit(False))
    a = side(right.where(flag), strict, "_strict", strict)
    b = side(right.where(~flag), alt, "_foreign", loose)
    c = side(right, alt, "_any", loose)
    out = left.join(a, strict, "left").join(b, loose, "left").join(c, loose, "left")
    return out.select(
        *left.columns, F.col("_strict").alias("registered"),
        F.when(F.col("_has__strict"), F.col("_strict")).otherwise(F.col("_foreign")).alias("corrected"),
        F.col("_any").alias("vial_insensitive"),
    )


def two_way_anti(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """Per key: only in a, only in b, agreeing or disagreeing on ``flag``."""
    left = a.select(key, F.col(flag).alias("_fa"), F.lit(True).alias("_a"))
    right = b.select(key, F.col(flag).alias("_fb"), F.lit(True).alias("_b"))
    cls = (F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right")
           .when(F.col("_fa").eqNullSafe(F.col("_fb")), "agree").otherwise("disagree"))
    return left.join(right, key, "full").select(key, F.coalesce("_fa", "_fb").alias(flag), cls.alias("status"))


def all_agree(classes: DataFrame):
    """Scalar: whether no key is on one side only or disagrees."""
    return classes.agg(F.bool_and(F.col("status") == "agree")).scalar()


def align(estimate: DataFrame, truth: DataFrame, on: Sequence[str] = ("sample", "part"), at_least: int = 0, by: str | None = None) -> DataFrame:
    """Estimate (e) and truth (t) on shared samples and parts; with ``at_least``, fewer shared rows are an error.

    With ``by``, one of ``on`` that has few rows per value, both meet by it alone, the truth as one row per value: tables
    that were made by grouping on it are not dealt again.
    """
    e, t = estimate.withColumnRenamed("value", "e"), truth.withColumnRenamed("value", "t")
    if by is None:
        out = e.join(t, list(on))
    else:
        there = t.groupBy(by).agg(F.collect_list(F.struct(*[c for c in t.columns if c != by])).alias("_t"))
        same = lambda x: reduce(lambda a, c: a & (x[c] == F.col(c)), [c for c in on if c != by], F.lit(True))
        met = e.join(there, by).withColumn("_t", F.explode(F.filter("_t", same)))
        out = met.select(*on, *[c for c in e.columns if c not in on], *[F.col("_t")[c].alias(c) for c in t.columns if c not in on])
    if at_least and out.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} rows in common")
    return out


def shared_features(ordered: DataFrame, others: Sequence[DataFrame], key: str, pos: str, at_least: int = 0) -> DataFrame:
    """Keys of the ordered list present in every other table, list order kept in ``pos``.

    With ``at_least``, fewer shared keys are an error.
    """
    out = reduce(lambda d, o: d.join(o.select(key).distinct(), key, "left_semi"), others, ordered).select(key, pos)
    if at_least and out.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} shared {key}s")
    return out


def holdout(cells: DataFrame, donors: DataFrame, test: bool) -> DataFrame:
    """Cells of the test donors, or of all the others."""
    return cells.join(donors.select("donor"), "donor", "left_semi" if test else "left_anti")


def provenance(rows: DataFrame, listing: DataFrame, key: str, pos: str, first: Sequence[str],
               means: Sequence[str]) -> DataFrame:
    """One covariate row per key: text from the first listing row, numbers averaged."""
    one = listing.groupBy(key).agg(*[F.min_by(c, pos).alias(c) for c in first],
                                   *[F.avg(c).alias(f"mean_{c}") for c in means])
    return rows.join(one, key, "left")


def stack(frames: dict[str, DataFrame], name: str = "method") -> DataFrame:
    """Union of per-method frames with the method as a column."""
    tagged = [df.withColumn(name, F.lit(m)) for m, df in frames.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Names on one side only."""
    left = a.select(key).distinct().exceptAll(b.select(key).distinct()).withColumn("side", F.lit("left_only"))
    right = b.select(key).distinct().exceptAll(a.select(key).distinct()).withColumn("side", F.lit("right_only"))
    return left.unionByName(right)


def shared_methods(a: DataFrame, b: DataFrame, controls: Sequence[str], key: str = "method") -> DataFrame:
    """Methods scored by both sources, controls and missing scores removed."""
    ok = lambda d: d.where(F.col("score").isNotNull() & ~F.col(key).isin(list(controls)))
    return ok(a).withColumnRenamed("score", "score_a").join(ok(b).withColumnRenamed("score", "score_b"), key)


def method_grid(est: DataFrame, methods: Sequence[str], keys: Sequence[str], value: str = "value") -> DataFrame:
    """One row per key with a column per method: the roster of methods bounds the width."""
    return est.groupBy(*keys).agg(*[F.first(F.when(F.col("method") == m, F.col(value)), ignorenulls=True).alias(m) for m in methods])


def matrix_product(sig: DataFrame, shares: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """sum over parts of signature(feature, part) * share(keys, part).

    The shares of one key are put in one row, which meets the signature's features, sent to every task as one
    row per feature.  No row is ever dealt by its part: there are few parts, so a task would hold a
    large share of the table.
    """
    profile = sig.where(F.col("part").isNotNull()).groupBy("feature", "part").agg(F.sum("mean").alias("_m")).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "_m"))).alias("_s"))
    cells = shares.where(F.col("part").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.col("part").alias("p"), F.col(value).alias("v"))).alias("_p"))
    met = cells.crossJoin(F.broadcast(profile)).where(F.arrays_overlap(F.transform("_p", lambda x: x.p), F.map_keys("_s")))
    products = F.filter(F.transform("_p", lambda x: x.v * F.try_element_at("_s", x.p)), lambda x: x.isNotNull())
    return met.withColumn("_x", products).select(
        "feature", *keys, F.when(F.size("_x") > 0, F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + x)).alias("fitted"))


def version_changes(old: DataFrame, new: DataFrame, reasons: DataFrame, key: str, mark: str) -> DataFrame:
    """added / removed / changed keys with the stated reason; ``explained`` says if there is one."""
    o = old.select(key, F.col(mark).alias("_o"), F.lit(True).alias("_in_o"))
    n = new.select(key, F.col(mark).alias("_n"), F.lit(True).alias("_in_n"))
    kind = (F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed")
            .when(~F.col("_o").eqNullSafe(F.col("_n")), "changed"))
    diff = o.join(n, key, "full").select(key, kind.alias("change")).where("change IS NOT NULL")
    return diff.join(reasons.select(key, "reason"), key, "left").withColumn("explained", F.col("reason").isNotNull())
