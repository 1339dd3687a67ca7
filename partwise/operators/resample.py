"""Permutation and bootstrap nulls as ordinary joins on a table of draws.

A draw is a number; what it picks is a hash of (seed, draw, key).  Labels are moved by a
keyed bijection, and the nulls that need only sums per label are summed for all draws
inside the tasks (``permute``).  Picks are made once per draw and shared by every method
and part, and scores are reduced to per-unit sums before they meet the draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from partwise.functions.draws import hash32, pick, unit, with_draws
from partwise.functions.guards import ratio
from partwise.operators.permute import (DENSE_UNITS, MOVED_BYTES, PICKED_UNITS, TABLE_BYTES, array_products, draw_keys, flipped_means, null_p, permute_labels, permuted_means,
                                        permuted_sums, place, rank_arrays, resampled_means, resampled_sums, roster, row_products, score_draws,
                                        widened)
from partwise.operators.ranks import attach_rank, hash_positions, prefix_sums
from partwise.operators.stats import spearman
from partwise.session import cut_lineage, parallelism, scratch


def p_value(null: DataFrame, observed: DataFrame, keys: Sequence[str], stat: str, tol: float = 1e-9,
            plus_one: bool = True, two_sided: bool = False) -> DataFrame:
    """Share of draws at least as large as the observed value, (hits + 1) / (n + 1)."""
    obs = observed.select(*keys, F.col(stat).alias("observed"))
    j = null.join(obs, list(keys)) if keys else null.withColumn("observed", obs.scalar())
    a, b = F.col(stat), F.col("observed")
    if two_sided:
        a, b = F.abs(a), F.abs(b)
    add = 1 if plus_one else 0
    ok = F.col(stat).isNotNull()
    return j.groupBy(*keys, "observed").agg(
        F.count_if(ok).alias("n_draws"), F.avg(stat).alias("null_mean"),
        ratio(F.count_if(ok & (a >= b - tol)) + add, F.count_if(ok) + add).alias("p_value"))


def scores_by_draw(est: DataFrame, samples: DataFrame, terms: DataFrame, n_draws: int, seed: str,
                   digits: int | None = None, keys: Sequence[str] = ("method",), per_group: bool = False,
                   who: Sequence[tuple] | None = None) -> DataFrame:
    """Constraint score of every method under each shuffle of structures inside tumours; draw 0 is the observed one.

    Only parts some constraint reads take part.
    """
    by = [*keys, "draw", "tumour"] if per_group else [*keys, "draw"]
    return score_draws(est, samples, terms, n_draws, seed, digits, keys, who=who).groupBy(*by).agg(
        ratio(F.sum("num"), F.sum("den")).alias("score"))


def score_null(est: DataFrame, samples: DataFrame, terms: DataFrame, n_draws: int, seed: str,
               digits: int | None = None, keys: Sequence[str] = ("method",), per_group: bool = False) -> DataFrame:
    """The scores of the shuffles alone."""
    return scores_by_draw(est, samples, terms, n_draws, seed, digits, keys, per_group).where("draw > 0")


def resampled_units(units: DataFrame, keys: Sequence[str], ident: str, n_draws: int, seed: str) -> DataFrame:
    """(keys, draw, ident, times): units drawn with replacement, as many as there are.

    Units are numbered in the order of a hash of their id.  Slot i of draw d takes unit hash(seed, d, i) mod n, so keys with the same
    units get the same picks (paired draws).
    """
    keys = list(keys)
    distinct = units.select(*keys, ident).distinct()
    size = distinct.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = distinct.join(size, keys) if keys else distinct.withColumn("_n", size.scalar())
    index = hash_positions(sized, keys, ident, hash32(F.lit("index"), ident), "_n", "_p").select(
        *keys, ident, (F.col("_p") - 1).alias("_i"), "_n")
    slots = with_draws(index.select(*keys, "_i", "_n"), n_draws)
    got = slots.select(*keys, "draw", pick("_n", F.lit(seed), "draw", "_i").alias("_i")).groupBy(*keys, "draw", "_i").agg(
        F.count("*").alias("times"))
    return got.join(index.select(*keys, ident, "_i"), [*keys, "_i"]).select(*keys, "draw", ident, "times")


def interval(draws: DataFrame, keys: Sequence[str], stat: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over draws: a group is the number of draws, which the caller sets."""
    a = (1 - level) / 2
    q = F.percentile(stat, F.array(F.lit(a), F.lit(0.5), F.lit(1 - a)))
    return draws.where(F.col(stat).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_usable"), F.avg(stat).alias("mean"), q.alias("_q")).select(
        *keys, "n_usable", "mean", F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("median"),
        F.get("_q", F.lit(2)).alias("ci_high"))


def cluster_bootstrap(weights: DataFrame, keys: Sequence[str], ident: str, n_draws: int, seed: str) -> DataFrame:
    """Interval of num / den over resampled units; fewer than two units give a missing interval."""
    keys = list(keys)
    times = resampled_units(weights, keys, ident, n_draws, seed)
    draw = weights.join(times, [*keys, ident]).groupBy(*keys, "draw").agg(
        ratio(F.sum(F.col("num") * F.col("times")), F.sum(F.col("den") * F.col("times"))).alias("score"))
    ci = interval(draw, keys, "score")
    n = weights.groupBy(*keys).agg(F.count_distinct(ident).alias("n_units"))
    out = ci.join(n, keys)
    few = F.col("n_units") < 2
    return out.withColumns({c: F.when(~few, F.col(c)) for c in ("ci_low", "ci_high")})


def bootstrap_rho(scores: DataFrame, keys: Sequence[str], ident: str, x: str, y: str, n_draws: int, seed: str,
                  min_usable: int = 100) -> DataFrame:
    """Interval of Spearman over resampled methods; draws without spread are skipped."""
    keys = list(keys)
    times = resampled_units(scores, keys, ident, n_draws, seed)
    rows = scores.join(times, [*keys, ident]).withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rho = spearman(rows, [*keys, "draw"], x, y, 2)
    ci = interval(rho, keys, "rho")
    enough = F.col("n_usable") >= min_usable
    return ci.withColumns({c: F.when(enough, F.col(c)) for c in ("ci_low", "median", "ci_high")})


def paired_ties(errors: DataFrame, n_draws: int, seed: str) -> DataFrame:
    """Each method's error minus the best method's over resampled groups.

    ``errors`` is (method, group, mae).  A group drawn twice counts once, as group
    means are averaged over distinct groups.  Fewer than three groups: all tied.
    """
    per = errors.groupBy("method").agg(F.avg("mae").alias("mae"))
    best = per.agg(F.min(F.struct("mae", "method"))).scalar()
    times = resampled_units(errors.select("group").distinct(), [], "group", n_draws, seed)
    draw = errors.join(times, "group").groupBy("draw", "method").agg(F.avg("mae").alias("m"))
    ref = draw.withColumn("_b", best).where(F.col("method") == F.col("_b.method")).select("draw", F.col("m").alias("_m"))
    delta = draw.join(ref, "draw").withColumn("delta", F.col("m") - F.col("_m"))
    ci = interval(delta, ["method"], "delta").select("method", "ci_low", "ci_high")
    n_groups = errors.agg(F.count_distinct("group")).scalar()
    out = per.join(ci, "method").withColumn("_b", best).withColumn("n_groups", n_groups)
    few = F.col("n_groups") < 3
    return out.select(
        "method", "mae", (F.col("mae") - F.col("_b.mae")).alias("delta"), F.when(~few, F.col("ci_low")).alias("ci_low"),
        F.when(~few, F.col("ci_high")).alias("ci_high"),
        (few | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))).alias("tied"))


def permutation_spearman(df: DataFrame, keys: Sequence[str], ident: str, x: str, y: str, n_draws: int, seed: str,
                         dense_units: int = DENSE_UNITS, stored: bool = False) -> DataFrame:
    """Two-sided permutation p of Spearman: ranks are made once, then moved by a keyed bijection.

    A key of at most ``dense_units`` units is one array of ranks; a larger one stays rows,
    ranked in value ranges and joined by moved position.  Both give the same result.  With ``stored`` the
    rows are read from files, so they are not written again.
    """
    keys = list(keys)
    with scratch(df.sparkSession) as keep:
        full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, ident, x, y)
        full = full if stored else keep(full)
        size = cut_lineage(full.groupBy(*keys).agg(F.count("*").alias("_size")))
        big = size.where(F.col("_size") > dense_units)
        some_big = not big.isEmpty()
        few = full.join(big, keys, "left_anti") if some_big else full
        held = size.where(F.col("_size") <= dense_units).agg(F.sum("_size")).first()[0] or 0
        arrays = cut_lineage(rank_arrays(few, keys, ident, x, y, seed).repartition(
            ceil(held * 8 / MOVED_BYTES) or 1, *keys).sortWithinPartitions("_size"))
        if some_big:
            rows = full.join(big, keys)
            r = attach_rank(attach_rank(rows, keys, x, "_rx"), keys, y, "_ry")
            mid = (F.col("_size") + 1) / F.lit(2.0)
            r = cut_lineage(r.select(*keys, ident, "_size", (F.col("_rx") - mid).alias("_rx"), (F.col("_ry") - mid).alias("_ry")))
    products = array_products(arrays, keys, n_draws, seed)
    norm = arrays.select(*keys, F.col("_size").alias("n"), "_norm", "_s")
    if some_big:
        products = products.union(row_products(r, keys, ident, n_draws, seed))
        norm = norm.union(r.groupBy(*keys).agg(
            F.count("*").alias("n"), F.sqrt(F.sum(F.col("_rx") ** 2) * F.sum(F.col("_ry") ** 2)).alias("_norm"),
            F.sum(F.col("_rx") * F.col("_ry")).alias("_s")))
    j = products.join(norm, keys)
    hit = F.abs(F.col("p")) >= F.abs(F.col("_s")) - 1e-9 * F.col("_norm")
    return j.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max(ratio("_s", "_norm")).alias("rho"), ratio(F.count_if(hit) + 1, F.count("*") + 1).alias("p_value"))


def exact_permutation(df: DataFrame, keys: Sequence[str], ident: str, x: str, y: str, max_n: int = 9) -> DataFrame:
    """Exact p of Spearman over all orderings of at most ``max_n`` units.

    Orderings grow by exploding the unused positions, n times: n! rows per key.
    """
    keys = list(keys)
    ranked = attach_rank(attach_rank(df, keys, x, "_rx"), keys, y, "_ry")
    arr = ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(ident).alias("i"), F.col("_rx").alias("a"), F.col("_ry").alias("b")))).alias("_u"))
    n = F.size("_u")
    rows = arr.withColumn("_left", F.when(n <= max_n, F.sequence(F.lit(1), n)).otherwise(
        F.raise_error(F.lit("too many units for exact enumeration")))).withColumn("_at", F.array().cast("array<int>"))
    for _ in range(max_n):
        # A finished ordering passes through with a single null pick.
        rows = rows.withColumn("_p", F.explode_outer("_left")).withColumn(
            "_at", F.when(F.col("_p").isNull(), F.col("_at")).otherwise(F.array_append("_at", F.col("_p")))).withColumn(
            "_left", F.array_remove("_left", F.coalesce("_p", F.lit(-1)))).drop("_p")
    dot = lambda order: F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0.0),
        lambda acc, i: acc + F.element_at("_u", i).a * F.element_at("_u", order(i)).b)
    null = rows.select(*keys, dot(lambda i: F.element_at("_at", i)).alias("_d"), dot(lambda i: i).alias("_o"),
                       F.aggregate("_u", F.lit(0.0), lambda acc, u: acc + u.a).alias("_s"), n.alias("n"))
    centre = F.col("_s") * F.col("_s") / F.col("n")
    d, o = F.col("_d") - centre, F.col("_o") - centre
    return null.groupBy(*keys).agg(
        F.max("n").alias("n"), F.count("*").alias("n_orderings"), F.avg((d >= o - 1e-9).cast("double")).alias("p_one_sided"),
        F.avg((F.abs(d) >= F.abs(o) - 1e-9).cast("double")).alias("p_two_sided"))


def mean_difference_null(df: DataFrame, groups: Sequence[str], flag: str, ident: str, value: str, n_draws: int, seed: str,
                         keys: Sequence[str] = ()) -> DataFrame:
    """One-sided p of mean(flagged) - mean(others) under shuffles of the flag inside groups."""
    groups, keys = list(groups), list(keys)
    columns = roster(df, keys)
    placed = place(df.select(*groups, flag, ident).distinct(), groups, flag, ident, seed)
    sums = permuted_sums(placed.join(widened(df, keys, columns, ident, value), ident), groups, len(columns), n_draws, seed)
    means = permuted_means(sums, groups, keys, columns, [df.schema[k].dataType for k in keys])
    side = lambda on: ratio(F.sum(F.when(on, F.col("v") * F.col("n"))), F.sum(F.when(on, F.col("n"))))
    return null_p(means.groupBy(*keys, "draw").agg((side(F.col("label")) - side(~F.col("label"))).alias("stat")), keys, "stat")


def sign_flip(df: DataFrame, keys: Sequence[str], ident: str, value: str, n_draws: int, seed: str) -> DataFrame:
    """One-sided p of a paired mean difference by random signs on its size; all keys share a unit's signs.

    There are no rows per draw; more keys than ``permute.MOST_COLUMNS`` are an error.
    """
    observed = df.groupBy(*keys).agg(F.avg(value).alias("stat"))
    null = flipped_means(df, keys, roster(df, keys), ident, value, n_draws, seed)
    return p_value(null, observed, keys, "stat", plus_one=False)


def argmax_null(means: DataFrame, keys: Sequence[str], group: str, label: str, value: str, n_draws: int, seed: str) -> DataFrame:
    """How often each label has the largest mean when values are shuffled inside groups."""
    keys = list(keys)
    present = means.where(F.col(value).isNotNull())
    ident = F.concat_ws("#", group, label)
    cells = present.withColumn("_cell", ident)
    labels = cells.select(group, label, "_cell").distinct()
    shuffled = permute_labels(labels, [group], label, "_cell", n_draws, seed).drop(group)
    moved = cells.drop(label).join(shuffled, "_cell").groupBy(*keys, "draw", label).agg(F.round(F.avg(value), 10).alias("m"))
    top = moved.groupBy(*keys, "draw").agg(F.min(F.struct((-F.col("m")).alias("m"), label)).getField(label).alias(label))
    hits = top.groupBy(*keys, label).agg(F.count("*").alias("n_max"))
    seen = present.groupBy(*keys, label).agg(F.avg(value).alias("observed"))
    return seen.join(hits, [*keys, label], "left").na.fill(0, ["n_max"]).withColumn("share", F.col("n_max") / F.lit(float(n_draws)))


def paired_difference(df: DataFrame, keys: Sequence[str], ident: str, value: str, n_draws: int, seed: str,
                      dense_units: int = PICKED_UNITS) -> DataFrame:
    """Interval and two-sided p of a mean paired difference over resampled units, one row per key and unit.

    A key of at most ``dense_units`` units is one array; the larger ones share counts of their picks.
    """
    keys = list(keys)
    rows = cut_lineage(df.select(*keys, ident, value))
    big = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > dense_units))
    if big.isEmpty():
        draw = resampled_means(rows, keys, ident, value, n_draws, seed)
    else:
        many = rows.join(big.select(*keys), keys, "left_semi")
        sums = resampled_sums(many, keys, roster(big, keys), ident, [F.col(value)], n_draws, seed)
        draw = resampled_means(rows.join(big.select(*keys), keys, "left_anti"), keys, ident, value, n_draws, seed).unionByName(
            sums.select(*keys, "draw", ratio(F.get("sums", F.lit(0)), "size").alias("stat")))
    draw = cut_lineage(draw)
    ci = interval(draw, keys, "stat").select(*keys, "ci_low", "ci_high")
    p = draw.groupBy(*keys).agg((2 * F.least(F.avg((F.col("stat") <= 0).cast("double")), F.avg((F.col("stat") >= 0).cast("double")))).alias("p_value"))
    seen = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return seen.join(ci, keys).join(p, keys)


#: Shares of a control from hash-uniform numbers: name -> weight of a part, before closing.
GENERATORS = {"uniform": lambda u: u, "dirichlet": lambda u: -np.log(u), "spiked": lambda u: u * u * u * u}
#: Multipliers and shifts of the generators' integer mixing; products stay below 2^62 in both engines.
CONTROL_MIX = [(16, 73244475), (15, 1103515245), (16, 12820163)]
CONTROL_STEP = 668265263


def control_means(manifest: DataFrame, parts: Sequence[str], shown: Sequence[str], n_draws: int, seed: str,
                  generators: Sequence[str] = tuple(GENERATORS), digits: int | None = None) -> DataFrame:
    """(generator, draw, tumour, structure, part, v): group means of controls that ignore the data.

    Every generator reads the same numbers.  A sample's draws are made and summed in its
    task, as arrays over draws: what is shuffled is one row per (draw, tumour, structure)
    and task, whatever the number of samples.
    """
    word = 2147483647
    keys = manifest.select("tumour", "structure", hash32(F.lit(seed), "sample").bitwiseAND(word).alias("_k"))
    # A row is work for all draws, however few bytes it has: dealt to all tasks, not by size.
    keys = keys.repartition(parallelism(keys.sparkSession), "_k")
    own = [keys.schema["tumour"], keys.schema["structure"]]
    parts, generators = list(parts), list(generators)
    at = [parts.index(p) for p in shown]
    schema = StructType([*own, StructField("draw", IntegerType()), StructField("_n", LongType()), StructField("_s", ArrayType(DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (draw_keys(f"{seed}|{c}", None, range(1, n_draws + 1)) & word for c in "ab")
        a = a % (word - 1) + 1
        held: dict = {}
        for batch in batches:
            codes = [batch.column(f.name).dictionary_encode() for f in own]
            groups = codes[0].indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) << 32
            groups = groups + codes[1].indices.fill_null(-1).to_numpy(zero_copy_only=False)
            k = batch.column("_k").to_numpy()
            for group in np.unique(groups):
                rows = np.flatnonzero(groups == group)
                name = tuple(batch.column(f.name)[int(rows[0])].as_py() for f in own)
                if name not in held:
                    if len(held) * n_draws * len(generators) * len(shown) * 8 > TABLE_BYTES:
                        yield from control_rows(held)
                        held.clear()
                    held[name] = [0, np.zeros((len(generators), len(shown), n_draws))]
                held[name][0] += len(rows)
                for lo in range(0, len(rows), 4):
                    base = k[rows[lo:lo + 4], None] * a % word + b
                    held[name][1] += control_sums(base, len(parts), at, generators)
        yield from control_rows(held)

    def control_rows(held: dict) -> Iterator[pa.RecordBatch]:
        for name, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v] * n_draws, kind) for v, kind in zip(name, kinds)], pa.array(np.arange(1, n_draws + 1), pa.int32()),
                 pa.array(np.full(n_draws, n)), pa.array(list(sums.reshape(-1, n_draws).T), pa.list_(pa.float64()))], names=schema.names)

    kinds = [to_arrow_type(f.dataType) for f in own]
    sums = keys.mapInArrow(work, schema)
    cells = [(g, p) for g in generators for p in shown]
    mean = lambda i: ratio(F.sum(F.get("_s", F.lit(i))), F.sum("_n"))
    got = sums.groupBy("draw", "tumour", "structure").agg(*[
        (mean(i) if digits is None else F.round(mean(i), digits)).alias(f"m{i}") for i in range(len(cells))])
    flat = F.array(*[F.struct(F.lit(g).alias("generator"), F.lit(p).alias("part"), F.col(f"m{i}").alias("v")) for i, (g, p) in enumerate(cells)])
    return got.select(F.col("draw").cast("bigint").alias("draw"), "tumour", "structure", F.inline(flat)).select(
        "generator", "draw", "tumour", "structure", "part", "v")


def control_sums(base: np.ndarray, n_parts: int, shown: Sequence[int], generators: Sequence[str]) -> np.ndarray:
    """Summed over samples, the shares of the shown parts: generators x shown x draws.  ``base`` is samples x draws."""
    word = np.uint32(2147483647)
    weights = {g: [] for g in generators}
    # Only the lowest 31 bits count, so words of 32 bits may wrap.
    base = base.astype(np.uint32)
    for place in range(n_parts):
        x = base + np.uint32(place * CONTROL_STEP % 2**32) & word
        for shift, times in CONTROL_MIX:
            x = (x ^ x >> np.uint32(shift)) * np.uint32(times) & word
        u = ((x ^ x >> np.uint32(16)) + np.uint32(1)) / 2147483648.0
        for g in generators:
            weights[g].append(GENERATORS[g](u))
    out = np.empty((len(generators), len(shown), base.shape[1]))
    for i, g in enumerate(generators):
        total = sum(weights[g][1:], weights[g][0])
        # A total of zero (every number is one) gives no share; it has a chance of 2^-31 to the power of the parts.
        scale = np.divide(1.0, total, out=np.zeros_like(total), where=total != 0)
        for j, place in enumerate(shown):
            out[i, j] = (weights[g][place] * scale).sum(axis=0)
    return out


def hardest_control(bands: DataFrame, digits: int = 12) -> DataFrame:
    """``bands`` (generator, method, ...) with ``hardest``: the highest p95, then the highest mean, then the last name."""
    rank = F.struct(F.round("p95", digits), F.round("mean", digits), F.col("generator"))
    return bands.withColumn("hardest", F.col("generator") == bands.agg(F.max(rank).getField("generator")).scalar())


def control_band(control_scores: DataFrame, board: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sd, 5-95% of the control's draws and each method's percentile among them."""
    s = F.col("score")
    band = control_scores.groupBy(*keys).agg(
        F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.percentile(s, F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    band = band.select(*keys, "mean", "sd", F.get("_q", F.lit(0)).alias("p05"), F.get("_q", F.lit(1)).alias("p95"))
    ms = board.select("method", F.col("score").alias("observed"))
    rows = control_scores.withColumn("_m", F.explode(ms.agg(F.collect_list(F.struct("method", "observed"))).scalar()))
    place = rows.groupBy(*keys, "_m.method", "_m.observed").agg(F.avg((s <= F.col("_m.observed") + 1e-12).cast("double")).alias("percentile"))
    j = place.join(band, list(keys)) if keys else place.withColumn("_b", band.select(F.struct("*")).scalar()).select(
        *place.columns, "_b.*")
    return j.withColumn("indistinguishable", F.col("observed") <= F.col("p95"))


def mixtures(expr: DataFrame, cells: DataFrame, targets: DataFrame, seed: str, scale: float = 1e6,
             totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mixtures of known composition: (mixture, feature, value) and (mixture, part, share).

    ``targets`` is (mixture, donor, part, n): how many cells to draw with
    replacement from each pool.  Slot i of a mixture takes pool cell
    hash(seed, mixture, part, i) mod pool size.  Realised counts are the truth;
    a pool the donor lacks contributes nothing.  ``totals`` (cell, total), the cells' own
    amounts before any scaling, add a second truth, ``amount_share``: a part's share of the
    amount, not of the cells.  A cell without a total adds none; without any the share is 0.
    """
    index = prefix_sums(cells.select("donor", "part", "cell", F.lit(1).alias("_one")), ["donor", "part"], "cell", ["_one"]).select(
        "donor", "part", "cell", F.col("before__one").alias("_i"), F.col("total__one").alias("_n"))
    pools = index.groupBy("donor", "part").agg(F.max("_n").alias("_n"))
    slots = targets.join(pools, ["donor", "part"]).where("n > 0").withColumn(
        "slot", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    taken = slots.select("mixture", "donor", "part", pick("_n", F.lit(seed), "mixture", "part", "slot").alias("_i")).groupBy(
        "mixture", "donor", "part", "_i").agg(F.count("*").alias("times"))
    chosen = taken.join(index, ["donor", "part", "_i"]).select("mixture", "part", "cell", "times")
    counts = chosen.groupBy("mixture", "part").agg(F.sum("times").alias("_k"))
    total = counts.groupBy("mixture").agg(F.sum("_k").alias("_t"))
    truth = counts.join(total, "mixture").select("mixture", "part", ratio("_k", "_t").alias("share"))
    if totals is not None:
        weighed = chosen.join(totals, "cell", "left").groupBy("mixture", "part").agg(
            F.coalesce(F.sum(F.col("total") * F.col("times")), F.lit(0.0)).alias("_a"))
        whole = weighed.groupBy("mixture").agg(F.sum("_a").alias("_w"))
        weighed = weighed.join(whole, "mixture").select("mixture", "part", F.coalesce(ratio("_a", "_w"), F.lit(0.0)).alias("amount_share"))
        truth = truth.join(weighed, ["mixture", "part"])
    raw = expr.join(chosen, "cell").groupBy("mixture", "feature").agg(F.sum(F.col("value") * F.col("times")).alias("_v"))
    lib = raw.groupBy("mixture").agg(F.sum("_v").alias("_l"))
    mix = raw.join(lib, "mixture").select(
        "mixture", "feature", F.when(F.col("_l") > 0, F.col("_v") / F.col("_l") * scale).otherwise(F.col("_v")).alias("value"))
    return mix, truth


def random_halves(features: DataFrame, n_draws: int, seed: str) -> DataFrame:
    """(draw, feature): a random half of the features per draw."""
    f = features.select("feature").distinct()
    n = f.count()
    placed = hash_positions(with_draws(f.withColumn("_size", F.lit(n)), n_draws), ["draw"], "feature",
                            hash32(F.lit(seed), "draw", "feature"), "_size")
    return placed.where(F.col("pos") <= n // 2).select("draw", "feature")


def random_removals(pool: DataFrame, k: int, n_draws: int, seed: str) -> DataFrame:
    """(draw, feature): k features of the pool to leave out per draw."""
    f = pool.select("feature").distinct()
    n = f.count()
    placed = hash_positions(with_draws(f.withColumn("_size", F.lit(n)), n_draws), ["draw"], "feature",
                            hash32(F.lit(seed), "draw", "feature"), "_size")
    return placed.where(F.col("pos") <= k).select("draw", "feature")
