"""Reference profiles from cells: balanced picks, means, variances, signatures, splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.functions.draws import hash32
from partwise.functions.guards import pearson, ratio
from partwise.operators.ranks import hash_positions, prefix_sums


def collapse(df: DataFrame, keys: Sequence[str], value: str, how: str, pos: str | None = None) -> DataFrame:
    """Rows of one key become one: 'sum' (all missing -> 0), 'mean' or 'first' by ``pos``."""
    agg = {"sum": F.coalesce(F.sum(value), F.lit(0.0)), "mean": F.avg(value),
           "first": F.min_by(value, pos) if pos else None}[how]
    return df.groupBy(*keys).agg(agg.alias(value))


def donor_profiles(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(donor, part, feature, mean): mean over the donor's cells, absent entries counting as 0.

    The number of cells comes from the cell table, so sparse input needs no zeros.
    """
    n = cells.groupBy("donor", "part").agg(F.count("*").alias("_n"))
    sums = expr.join(cells.select("cell", "donor", "part"), "cell").groupBy("donor", "part", "feature").agg(
        F.sum("value").alias("_s"))
    return sums.join(n, ["donor", "part"]).select("donor", "part", "feature", ratio("_s", "_n").alias("mean"))


def profile_and_variance(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Per (part, feature): mean and sample variance over the donors that have the part."""
    d = donor_profiles(expr, cells)
    donors = cells.select("donor", "part").distinct().groupBy("part").agg(F.count("*").alias("_d"))
    s = d.groupBy("part", "feature").agg(F.sum("mean").alias("_s"), F.var_pop("mean").alias("_v"), F.count("*").alias("_k"),
                                         F.avg("mean").alias("_m"))
    k, big, m = F.col("_k"), F.col("_d"), F.col("_m")
    # Donors without the feature are zeros: fold them into the moments.
    mean = ratio("_s", big)
    ss = k * F.col("_v") + k * (m - mean) ** 2 + (big - k) * mean**2
    return s.join(donors, "part").select(
        "part", "feature", mean.alias("mean"),
        F.when(big > 1, F.coalesce(ratio(ss, big - 1), F.lit(0.0))).otherwise(0.0).alias("var"), big.alias("n_donors"))


def pooled_profile(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Per (part, feature): mean and population variance over cells, zeros implicit."""
    n = cells.groupBy("part").agg(F.count("*").alias("_n"))
    x = F.col("value")
    s = expr.join(cells.select("cell", "part"), "cell").groupBy("part", "feature").agg(
        F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    mu = ratio("_s", "_n")
    return s.join(n, "part").select("part", "feature", mu.alias("mean"),
                                    F.greatest(ratio("_q", "_n") - mu * mu, F.lit(0.0)).alias("var"))


def size_factors(cells: DataFrame, roster: DataFrame) -> DataFrame:
    """Mean library per part; a part without cells takes the others' median, a zero the positives' median."""
    got = roster.join(cells.groupBy("part").agg(F.avg("library").alias("size")), "part", "left")
    fill = got.agg(F.percentile("size", F.lit(0.5))).scalar()
    filled = got.withColumn("size", F.coalesce("size", fill))
    positive = filled.agg(F.percentile(F.when(F.col("size") > 0, F.col("size")), F.lit(0.5))).scalar()
    return filled.withColumn("size", F.when(F.col("size") == 0, positive).otherwise(F.col("size")))


def specificity(profile: DataFrame) -> DataFrame:
    """A part's mean over (the mean of the other parts + 1), per feature."""
    per = profile.groupBy("feature").agg(F.sum("mean").alias("_s"), F.count("*").alias("_k"))
    rest = ratio(F.col("_s") - F.col("mean"), F.col("_k") - 1)
    return profile.join(per, "feature").select("part", "feature", "mean", ratio("mean", rest + 1).alias("score"))


def top_features(profile: DataFrame, n: int, markers: DataFrame | None = None) -> DataFrame:
    """The n most specific features of each part, plus any markers present.

    The filter on the row number lets Spark keep only n rows per part before the shuffle.
    """
    ranked = specificity(profile).withColumn(
        "rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "feature"))).where(F.col("rank") <= n)
    chosen = ranked.groupBy("feature").agg(F.min_by(F.col("part"), F.struct("part", "rank")).alias("part"),
                                           F.min(F.struct("part", "rank")).getField("rank").alias("rank"))
    if markers is None:
        return chosen
    extra = markers.select("feature").distinct().join(profile.select("feature").distinct(), "feature", "left_semi")
    extra = extra.join(chosen, "feature", "left_anti")
    return chosen.unionByName(extra.withColumn("part", F.lit("~marker")).withColumn("rank", F.lit(0)))


def balanced_sample(cells: DataFrame, cap: int, target: int, seed: str, floor: int = 25) -> DataFrame:
    """Cap cells per (donor, part), then trim each part in proportion, never below ``floor``.

    The cap keeps the smallest seeded hashes, so at most ``cap`` rows per key and
    task are shuffled; the trim numbers each part in hash ranges.
    """
    h = hash32(F.lit(seed), "cell")
    first = cells.withColumn("_seeded", h).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("donor", "part").orderBy("_seeded", "cell"))).where(
        F.col("_rn") <= cap).drop("_rn", "_seeded")
    sizes = first.groupBy("part").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    keep = F.when(total <= target, F.col("_n")).otherwise(
        F.greatest(F.bround(F.col("_n") * F.lit(float(target)) / total).cast("bigint"), F.least(F.col("_n"), F.lit(floor))))
    quota = sizes.select("part", "_n", keep.alias("_keep"))
    sized = first.join(quota, "part")
    ranked = hash_positions(sized, ["part"], "cell", hash32(F.lit(seed + "2"), "cell"), "_n", "_rn")
    return ranked.where(F.col("_rn") <= F.col("_keep")).drop("_rn", "_keep", "_n")


def donor_split(cells: DataFrame, n_test: int | None = None, fraction: float = 0.25, seed: str = "split") -> DataFrame:
    """Seeded test donors: at least one on each side; fewer than two donors is an error."""
    donors = cells.select("donor").distinct()
    n = F.col("_n")
    k = F.lit(n_test) if n_test is not None else F.bround(n * F.lit(fraction))
    k = F.when(n < 2, F.raise_error(F.lit("a donor split needs two donors"))).otherwise(
        F.least(F.greatest(k, F.lit(1)), n - 1))
    placed = hash_positions(donors.withColumn("_n", donors.agg(F.count("*")).scalar()), [], "donor",
                            hash32(F.lit(seed), "donor"), "_n")
    return placed.where(F.col("pos") <= k).select("donor")


def eligible_donors(cells: DataFrame, min_cells: int, min_per_part: int, sizes: Sequence[int], seed: str) -> DataFrame:
    """Smallest seeded draw of eligible donors that gives every part enough cells."""
    per = cells.groupBy("donor", "part").agg(F.count("*").alias("n"))
    ok = per.groupBy("donor").agg(F.sum("n").alias("total")).where(F.col("total") > min_cells)
    # Only the first max(sizes) donors can ever be drawn, so the numbering sees no more.
    first = ok.withColumn("_s", hash32(F.lit(seed), "donor")).orderBy("_s", "donor").limit(max(sizes))
    order = first.withColumn("rank", F.row_number().over(Window.orderBy("_s", "donor"))).drop("_s")
    n_parts = cells.agg(F.count_distinct("part")).scalar()
    per_rank = per.join(order.select("donor", "rank"), "donor")
    trial = per_rank.select("donor", "part", "n", "rank", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).where(
        F.col("rank") <= F.col("size"))
    filled = trial.groupBy("size", "part").agg(F.sum("n").alias("n")).groupBy("size").agg(
        F.min("n").alias("least"), F.count("*").alias("parts"))
    best = filled.where((F.col("least") > min_per_part) & (F.col("parts") == n_parts)).agg(F.min("size")).scalar()
    return order.where(F.col("rank") <= best).select("donor", "rank", "total")


def nth_fill(loads: np.ndarray, size: int, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold that takes the nth (from 0) of many equal patients, each going to the lightest fold, and the load it finds.

    Fold f is chosen at the loads loads[f] + i * size in turn, so the nth choice is the nth
    smallest of these numbers, ties to the first fold; the number is found by halving.
    """
    taken = lambda v: np.maximum((v[:, None] - loads) // size + 1, 0).sum(axis=1)
    low = np.full(len(nth), loads.min(), np.int64)
    high = low + (nth + 1) * size
    while (low < high).any():
        mid = (low + high) // 2
        enough = taken(mid) > nth
        high = np.where(enough, mid, high)
        low = np.where(enough, low, mid + 1)
    here = (low[:, None] >= loads) & ((low[:, None] - loads) % size == 0)
    order = np.cumsum(here, axis=1) - 1
    want = nth - taken(low - 1)
    return np.argmax(here & (order == want[:, None]), axis=1), low


def fold_loads(classes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """(size, loads of the folds before its class) for (size, number of patients) in falling size."""
    loads, out = np.zeros(k, np.int64), []
    for size, count in classes:
        out.append((size, [int(x) for x in loads]))
        if size > 0:
            fold, found = nth_fill(loads, size, np.array([count - 1]))
            full = np.maximum((found[0] - 1 - loads) // size + 1, 0)
            tied = (found[0] >= loads) & ((found[0] - loads) % size == 0) & (np.arange(k) <= fold[0])
            loads = loads + size * (full + tied)
    return out


def assign_folds(sizes: DataFrame, k: int, seed: str) -> DataFrame:
    """Whole patients to k folds: the largest first, each to the lightest fold, seeded within a size.

    Patients of one size are interchangeable for the loads, so the rule runs one step per
    distinct size (few, as n samples have at most sqrt(2 n) of them); a patient then finds
    its fold from its place inside its size and the loads before it.
    """
    counts = sizes.groupBy("n").agg(F.count("*").alias("_c"))
    classes = [(int(r["n"]), int(r["_c"])) for r in counts.orderBy(F.desc("n")).collect()]
    before = sizes.sparkSession.createDataFrame(fold_loads(classes, k), "n long, _loads array<long>")
    placed = hash_positions(sizes.join(counts, "n"), ["n"], "patient", hash32(F.lit(seed), "patient"), "_c", "_nth").drop("_c")
    rows = placed.join(before, "n").select(*[F.col(f"`{c}`") for c in sizes.columns], (F.col("_nth") - 1).alias("_nth"), "_loads")
    names = sizes.columns
    schema = T.StructType([*sizes.schema.fields, T.StructField("fold", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nth = batch.column("n").to_numpy(), batch.column("_nth").to_numpy()
            fold = np.zeros(batch.num_rows, np.int32)
            for size in np.unique(n):
                at = np.flatnonzero(n == size)
                if size > 0:
                    fold[at] = nth_fill(np.array(batch.column("_loads")[int(at[0])].as_py()), int(size), nth[at])[0]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(fold)], names=schema.names)

    return rows.mapInArrow(work, schema)


def label_by_profile(estimated: DataFrame, reference: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Pearson of log1p profiles against every reference part; the label is the best one."""
    wide = reference.groupBy("feature").pivot("part", list(parts)).agg(F.first("mean"))
    joined = estimated.join(wide, "feature")
    cells = [F.struct(pearson(F.log1p("mean"), F.log1p(F.col(p))).alias("r"), F.lit(p).alias("label")) for p in parts]
    best = F.array_max(F.filter(F.array(*cells), lambda c: c.r.isNotNull()))
    return joined.groupBy(F.col("component")).agg(best.alias("b")).select("component", "b.label", "b.r")


def panel_labels(scores: DataFrame, margin: float) -> DataFrame:
    """Label of a cluster: its top panel when it beats the second by a margin, else 'near_tie'."""
    ranked = scores.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "panel")))
    got = ranked.where("rn <= 2").groupBy("cluster").agg(
        F.max(F.when(F.col("rn") == 1, F.struct("score", "panel"))).alias("a"),
        F.max(F.when(F.col("rn") == 2, F.struct("score", "panel"))).alias("b"))
    gap = F.col("a.score") - F.col("b.score")
    return got.select("cluster", F.when(gap >= margin, F.col("a.panel")).otherwise("near_tie").alias("label"),
                      F.col("a.panel").alias("first"), F.col("b.panel").alias("second"), gap.alias("gap"))


def split_near_ties(cell_scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of a near-tied cluster take whichever of its two panels scores higher in the cell."""
    own = cell_scores.join(labels, "cluster").where(
        (F.col("panel") == F.col("first")) | (F.col("panel") == F.col("second")))
    best = F.max(F.struct("score", (F.col("panel") == F.col("first")).alias("_f"), "panel")).getField("panel")
    return own.groupBy("cluster", "cell").agg(F.max("label").alias("_l"), best.alias("_b")).select(
        "cluster", "cell", F.when(F.col("_l") == "near_tie", F.col("_b")).otherwise(F.col("_l")).alias("label"))


def to_roster(est: DataFrame, labels: DataFrame, roster: DataFrame, samples: DataFrame) -> DataFrame:
    """Sum components into roster parts; a part nobody claimed is missing, not zero."""
    got = est.join(labels.select("component", F.col("label").alias("part")), "component").groupBy("sample", "part").agg(
        F.sum("value").alias("value"))
    grid = samples.select("sample").distinct().withColumn(
        "part", F.explode(roster.agg(F.array_sort(F.collect_set("part"))).scalar()))
    return grid.join(got, ["sample", "part"], "left")


def count_units(expr: DataFrame) -> DataFrame:
    """Per cell: the smallest expm1 value is one count; library, worst distance to an integer, total."""
    e = expr.where("value > 0").select("cell", F.expm1("value").alias("e"))
    unit = e.groupBy("cell").agg(F.min("e").alias("unit"))
    c = e.join(unit, "cell").withColumn("count", ratio("e", "unit"))
    return c.groupBy("cell").agg(
        F.max("unit").alias("unit"), F.max(ratio(F.lit(1e4), "unit")).alias("library"),
        F.max(F.abs(F.col("count") - F.bround("count"))).alias("worst"), F.sum("count").alias("total"))


