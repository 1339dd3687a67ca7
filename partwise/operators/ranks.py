"""Ranks, quantiles and pair counts that never put a whole group in one task.

Everything here rests on one routine, :func:`prefix_sums`: rows are first
collapsed per (group, value), each group is cut into value ranges of about equal
size, running sums are taken inside a range, and the (few) range totals are
cumulated separately and joined back.  A group holding a third of the table is
spread over a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions.draws import SPAN, hash32
from partwise.functions.guards import ratio
from partwise.operators import strips
from partwise.session import cut_lineage, parallelism


def _range_index(bounds: Column, value: Column, width: int) -> Column:
    """How many of the sorted bounds are <= value, by bisection."""
    steps, s = [], 1
    while s <= width:
        steps.append(s)
        s *= 2
    found = F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= F.size(bounds)) & (F.get(bounds, at + s - 1) <= value), at + s
        ).otherwise(at),
    )
    return F.when(bounds.isNull(), 0).otherwise(found)


def _cumulate(placed: DataFrame, keys: list[str], order: list[Column], weights: Sequence[str],
              grain: list[str]) -> DataFrame:
    """Exclusive running sums of ``weights``, given a ``_range`` column monotone in order."""
    chunk = [*keys, "_range"]
    inside = Window.partitionBy(*chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = placed.groupBy(*chunk).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    offsets = totals.select(
        *chunk,
        *[F.coalesce(F.sum(f"_t_{w}").over(upto), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"total_{w}") for w in weights],
    )
    running = placed.select(
        *grain, "_range", *weights,
        *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_i_{w}") for w in weights],
    )
    return running.join(offsets, chunk).select(
        *grain, *weights,
        *[(F.col(f"_i_{w}") + F.col(f"_o_{w}")).alias(f"before_{w}") for w in weights],
        *[f"total_{w}" for w in weights],
    )


#: Rows looked at for each cut between ranges of text.
SAMPLED = 64


def _is_text(df: DataFrame, value: str) -> bool:
    return df.schema[value].dataType.simpleString() == "string"


def range_bounds(tally: DataFrame, value: str, weights: Sequence[str]) -> Column:
    """Scalar subquery: cut points that split the values into equal ranges.

    The cuts come from all groups together, so a group's share of the ranges is
    its share of the table.  Numbers are cut by approximate quantiles; text has none, so
    it is cut at the quantiles of the rows that hash lowest, compared as whole texts.
    Cuts only place the rows; results do not depend on them.  Summing the weights keeps
    them in this plan, which makes the tally here the same exchange as the caller's: one
    scan, not two.
    """
    width = parallelism(tally.sparkSession)
    if _is_text(tally, value):
        rows = tally.orderBy(F.xxhash64(*[c for c in tally.columns if c not in weights])).limit(SAMPLED * width)
        every = F.array_sort(F.collect_list(value))
        return rows.agg(every.alias("_e"), *[F.sum(w).alias(w) for w in weights]).select(
            F.struct(F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(width - 1, 1))), lambda i: F.get(
                "_e", F.floor(i * F.size("_e") / width).cast("int"))), lambda x: x.isNotNull()).alias("cuts"), *weights)).scalar()
    cuts = [i / width for i in range(1, width)]
    return tally.select(
        F.struct(F.percentile_approx(F.col(value), cuts, 10 * width).alias("cuts"),
                 *[F.sum(w).alias(w) for w in weights])
    ).scalar()


def prefix_sums(df: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str],
                bounds: Column | None = None) -> DataFrame:
    """Per (keys, value): each weight's sum at the value, below it, and over the group.

    ``df`` may repeat (keys, value); weights are summed first (map-side).
    Rows with a missing key or value are dropped.
    """
    keys = list(keys)
    width = parallelism(df.sparkSession)
    present = F.col(value).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    tally = df.where(present).groupBy(*keys, value).agg(*[F.sum(w).alias(w) for w in weights])
    if bounds is None:
        bounds = range_bounds(tally, value, weights)
    placed = tally.withColumn("_bounds", bounds.getField("cuts"))
    at = F.coalesce(_range_index(F.col("_bounds"), F.col(value), width), F.lit(0))
    placed = placed.withColumn("_range", at).drop("_bounds")
    return _cumulate(placed, keys, [F.col(value)], weights, [*keys, value])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, n, before, total): the rank facts of every distinct value."""
    src = df.select(*keys, value, (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_n"))
    out = prefix_sums(src, keys, value, ["_n"])
    facts = [F.col("_n").alias("n"), F.col("before__n").alias("before"), F.col("total__n").alias("total")]
    return out.select(*keys, value, *facts)


def average_rank(descending: bool = False) -> Column:
    """Rank with ties averaged, from the columns of :func:`value_ranks`."""
    n, before, total = F.col("n"), F.col("before"), F.col("total")
    start = (total - before - n) if descending else before
    return start + (n + 1) / F.lit(2.0)


def min_rank(descending: bool = False) -> Column:
    n, before, total = F.col("n"), F.col("before"), F.col("total")
    return ((total - before - n) if descending else before) + 1


def attach_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank",
                kind: str = "average", descending: bool = False) -> DataFrame:
    """Join the rank of each row's value back to the rows; missing values get no rank.

    The join is on (keys, value) against one row per distinct value, so a hot
    value only makes the row side uneven, which adaptive skew splitting handles.
    """
    make = {"average": average_rank, "min": min_rank}
    if kind == "pct":
        expr = ratio(average_rank(descending), F.col("total"))
    else:
        expr = make[kind](descending)
    ranks = value_ranks(df, keys, value).select(*keys, value, expr.alias(name))
    return df.join(ranks, [*keys, value], "left")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group."""
    facts = value_ranks(df, keys, value)
    picks = []
    for p, name in zip(probs, names):
        at = (F.col("total") - 1) * F.lit(float(p))
        for edge, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{edge}_{name}"))
    got = facts.groupBy(*keys).agg(F.max("total").alias("n_values"), *picks)
    done = []
    for p, name in zip(probs, names):
        at = (F.col("n_values") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        done.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return got.select(*keys, "n_values", *done)


def hash_positions(df: DataFrame, keys: Sequence[str], ident: str, hashed: Column,
                   size: str, name: str = "pos", chunk: int = 1_000_000) -> DataFrame:
    """Row number 1.. within keys in the order of a 32-bit hash, then ``ident``.

    ``size`` is a column with (about) the group's row count: groups above
    ``chunk`` rows are cut into equal hash ranges, which are balanced by nature.
    """
    keys = list(keys)
    pieces = F.ceil(F.col(size) / F.lit(float(chunk)))
    h = df.withColumn("_h", hashed)
    h = h.withColumn("_range", F.floor(F.col("_h") * pieces / F.lit(SPAN)).cast("int"))
    h = h.withColumn("_one", F.lit(1))
    grain = [c for c in df.columns]
    out = _cumulate(h, keys, [F.col("_h"), F.col(ident)], ["_one"], grain)
    return out.select(*grain, (F.col("before__one") + 1).alias(name))


def group_positions(df: DataFrame, keys: Sequence[str], ident: str, *seed: str | Column,
                    size: str, name: str = "pos") -> DataFrame:
    """:func:`hash_positions` with the order given by a seeded hash of ``ident``."""
    return hash_positions(df, keys, ident, hash32(*seed, ident), size, name)


def dominance(df: DataFrame, keys: Sequence[str], x: str, y: str, wa: str, wb: str, rows: int = strips.STRIP) -> DataFrame:
    """Weighted pair counts without pairs.

    Per keys: ``crossed`` = sum of wa_i * wb_j over x_i < x_j and y_i > y_j, in strips of about ``rows`` points;
    what is no number, and more cells of strips than that, is counted by bits.
    """
    keys = list(keys)
    pts = cut_lineage(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, x, y).agg(F.sum(wa).cast("double").alias("wa"), F.sum(wb).cast("double").alias("wb"))
    )
    if strips.numeric(pts, x, y):
        return strips.crossed(pts, keys, x, y, rows, _dominance_by_bits)
    return _dominance_by_bits(pts, keys, x, y)


def _dominance_by_bits(pts: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The same for distinct points of any type; ``pts`` is stored and has the weights wa and wb.

    The values of y are replaced by integer
    codes; two codes a > b differ first at exactly one bit, so each row is counted
    once per bit among the rows sharing its higher bits, using running sums over x.
    """
    keys = list(keys)
    codes = value_ranks(pts, keys, y).select(*keys, y, F.col("before").alias("_code"), F.col("total").alias("_m"))
    coded = pts.join(codes, [*keys, y])
    bits = F.ceil(F.log2(F.col("_m") + 1)).cast("int")
    spread = coded.select(
        *keys, x, "wa", "wb", "_code", F.explode(F.sequence(F.lit(0), bits)).alias("_bit")
    )
    shift = F.col("_bit") + 1
    head = F.call_function("shiftright", F.col("_code"), shift)
    one = (F.call_function("shiftright", F.col("_code"), F.col("_bit")) % 2) == 1
    sides = spread.select(
        *keys, "_bit", head.alias("_head"), x,
        F.when(one, F.col("wa")).otherwise(0.0).alias("up"),
        F.when(~one, F.col("wb")).otherwise(0.0).alias("down"),
    )
    run = prefix_sums(sides, [*keys, "_bit", "_head"], x, ["up", "down"], range_bounds(pts, x, ["wa", "wb"]))
    return run.groupBy(*keys).agg(F.sum(F.col("down") * F.col("before_up")).alias("crossed"))


def pair_counts(df: DataFrame, keys: Sequence[str], x: str, y: str, rows: int = strips.STRIP) -> DataFrame:
    """n, pairs, concordant, discordant and the three kinds of tied pairs per group."""
    keys = list(keys)
    pts = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, x, y).agg(F.count("*").alias("w"))
    )
    pts = cut_lineage(pts)
    choose2 = lambda c: F.sum(c.cast("double") * (c - 1) / 2)
    tx = pts.groupBy(*keys, x).agg(F.sum("w").alias("w")).groupBy(*keys).agg(choose2(F.col("w")).alias("tied_x"))
    ty = pts.groupBy(*keys, y).agg(F.sum("w").alias("w")).groupBy(*keys).agg(choose2(F.col("w")).alias("tied_y"))
    txy = pts.groupBy(*keys).agg(F.sum("w").alias("n"), choose2(F.col("w")).alias("tied_xy"))
    cross = dominance(pts, keys, x, y, "w", "w", rows).select(*keys, F.col("crossed").alias("discordant"))
    out = txy.join(tx, keys).join(ty, keys).join(cross, keys)
    pairs = F.col("n") * (F.col("n") - 1) / F.lit(2.0)
    return out.withColumn("pairs", pairs).withColumn(
        "concordant",
        F.col("pairs") - F.col("tied_x") - F.col("tied_y") + F.col("tied_xy") - F.col("discordant"),
    )
