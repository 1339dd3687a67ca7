"""Window functions, sorts and top-k on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.aggregates import verdict_table
from partwise.catalog.columns import TRIO, aligned
from partwise.catalog.registry import register
from partwise.catalog.roles import h32, q
from partwise.catalog.statistics import corr_sql, ranks_sql
from partwise.functions.draws import hash32
from partwise.operators import compose as C
from partwise.operators import profiles as P
from partwise.operators import ranks as K
from partwise.operators import score as S
from partwise.operators import stats as ST
from partwise.operators import windows as W
from partwise.session import cut_lineage

SPEC_SQL = """spec AS (SELECT part, feature, mean / nullif((sum(mean) OVER (PARTITION BY feature) - mean) / (count(*) OVER (PARTITION BY feature) - 1) + 1, 0) AS score FROM prof),
    rk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, feature) AS rn FROM spec)"""


@register("win01_top_n_per_group", "feature part rank", "", q("expr cells", f"""
    WITH x AS (SELECT cell, feature, round(value, 6) AS value FROM expr), n AS (SELECT part, count(*) AS n FROM cells GROUP BY 1),
    prof AS (SELECT part, feature, round(sum(value) / any_value(n), 9) AS mean FROM x JOIN cells USING (cell) JOIN n USING (part) GROUP BY ALL), {SPEC_SQL}
    SELECT feature, part, rn AS rank FROM rk WHERE rn <= 5 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY part, rn) = 1"""))
def _(t):
    prof = P.pooled_profile(R.cell_expr(t), R.cells(t)).withColumn("mean", F.round("mean", 9))
    return P.top_features(prof, 5)


@register("win02_average_rank", "sample", "rank", q("", f"""
    SELECT o_orderkey AS sample, r_v AS rank FROM {ranks_sql("(SELECT o_orderkey, o_custkey % 25 AS g, floor(o_totalprice / 1000) AS v FROM orders)", "g", "v")}"""))
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 25).alias("g"),
                           F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return K.attach_rank(rows, ["g"], "v")


@register("win03_min_rank", "sample rank", "", """SELECT o_orderkey AS sample,
    rank() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 1000) DESC) AS rank FROM orders""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("sample"), "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return K.attach_rank(rows, ["o_orderpriority"], "v", "rank", "min", descending=True)


@register("win04_percent_rank_within", "sample panel", "score", q("expr", f"""
    SELECT cell AS sample, 'p' || (feature % 4) AS panel, avg(r_value / n) AS score FROM
    (SELECT *, count(*) OVER (PARTITION BY cell) AS n FROM {ranks_sql('expr', 'cell', 'value')}) GROUP BY 1, 2"""))
def _(t):
    x = R.cell_expr(t)
    panels = x.select("feature").distinct().withColumn("panel", F.concat(F.lit("p"), (F.col("feature") % 4).cast("string")))
    return W.panel_percentile(x, panels, "cell").withColumnRenamed("cell", "sample")


@register("win05_balanced_sample", "cell donor part", "", q("cells", f"""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY donor, part ORDER BY {h32("'bal'", "cell")}, cell) AS rn FROM cells),
    b AS (SELECT * FROM a WHERE rn <= 6), s AS (SELECT part, count(*) AS n, sum(count(*)) OVER () AS tot FROM b GROUP BY 1),
    k AS (SELECT part, CASE WHEN tot <= 300 THEN n ELSE greatest(CAST(round_even(n * 300.0::DOUBLE / tot, 0) AS BIGINT), least(n, 25)) END AS keep FROM s),
    c AS (SELECT b.*, keep, row_number() OVER (PARTITION BY b.part ORDER BY {h32("'bal2'", "cell")}, cell) AS r2 FROM b JOIN k USING (part))
    SELECT cell, donor, part FROM c WHERE r2 <= keep"""))
def _(t):
    return P.balanced_sample(R.cells(t), 6, 300, "bal")


@register("win06_quantile_bins", "method bin n", "r", q("et", f"""
    WITH x AS (SELECT method, e, t FROM et WHERE part = 'LARGE' AND t > 0), q AS (SELECT method, list_sort(list_distinct(quantile_cont(t, [0, 1/3.0, 2/3.0, 1]))) AS edges FROM x GROUP BY 1),
    b AS (SELECT *, CAST(greatest(len(list_filter(edges, lambda y: y < t)) - 1, 0) AS INTEGER) AS bin FROM x JOIN q USING (method))
    SELECT method, bin, count(*) AS n, {corr_sql('e', 't')} AS r FROM b GROUP BY 1, 2"""))
def _(t):
    x = aligned(t).where("part = 'LARGE' AND t > 0")
    return ST.pearson_by(W.quantile_bins(x, ["method"], "t", 3), ["method", "bin"], "e", "t")


TWO_RUNS = """a AS (SELECT method || part AS method, round(avg(value), 9) AS score FROM est GROUP BY ALL),
    b AS (SELECT method || part AS method, round(avg(value), 9) AS score FROM est WHERE sample % 2 = 0 AND NOT (method = 'net' AND part = 'SMALL') GROUP BY method, part)"""


def two_runs(t):
    mean = lambda d: d.groupBy(F.concat("method", "part").alias("method")).agg(F.round(F.avg("value"), 9).alias("score"))
    est = R.estimates(t)
    return mean(est), mean(est.where("sample % 2 = 0 AND NOT (method = 'net' AND part = 'SMALL')"))


@register("win07_rank_change", "method rank_old rank_new change status", "delta", q("est", f"""
    WITH {TWO_RUNS}, ra AS (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM a), rb AS (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM b)
    SELECT coalesce(ra.method, rb.method) AS method, ra.r AS rank_old, rb.r AS rank_new, ra.r - rb.r AS change,
    CASE WHEN ra.r - rb.r IS NULL THEN 'n/c' WHEN ra.r = rb.r THEN 'same' ELSE 'moved' END AS status, rb.score - ra.score AS delta
    FROM ra FULL JOIN rb ON ra.method = rb.method"""))
def _(t):
    return W.rank_change(*two_runs(t))


MAE_SQL = "mae AS (SELECT method, avg(abs(e - t)) AS mae FROM et GROUP BY 1)"


def mae(t):
    return aligned(t).groupBy("method").agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("mae"))


@register("win08_best_and_delta", "method best", "mae delta", q("et", f"""
    WITH {MAE_SQL} SELECT method, (SELECT arg_min(method, mae) FROM mae) AS best, mae, mae - (SELECT min(mae) FROM mae) AS delta FROM mae"""))
def _(t):
    return W.best_and_delta(mae(t), "mae", "method")


@register("win09_multi_key_sort", "place method part", "score", q("est", """
    WITH s AS (SELECT method, part, CASE WHEN part = 'SMALL' THEN NULL ELSE round(avg(value), 9) END AS score FROM est GROUP BY method, part)
    SELECT row_number() OVER (ORDER BY (method <> 'control') DESC NULLS LAST, score ASC NULLS LAST, method, part) AS place, method, part, score FROM s"""))
def _(t):
    from pyspark.sql import Window

    s = R.estimates(t).groupBy("method", "part").agg(F.round(F.avg("value"), 9).alias("score")).withColumn(
        "score", F.when(F.col("part") != "SMALL", F.col("score"))).withColumn("real", F.col("method") != "control")
    out = W.ordered(s, ("real", True), ("score", False), ("method", False), ("part", False))
    # The place is a running number over one row per method and part.
    order = Window.orderBy(F.desc_nulls_last("real"), F.asc_nulls_last("score"), "method", "part")
    return out.withColumn("place", F.row_number().over(order).cast("bigint"))


@register("win10_top_variance", "feature", "variance", q("matrix", """
    SELECT feature, var_samp(ln(1 + value / library * 1e6)) AS variance FROM matrix JOIN (SELECT sample, sum(value) AS library FROM matrix GROUP BY 1) USING (sample)
    GROUP BY 1 ORDER BY variance DESC, feature LIMIT 10"""))
def _(t):
    m = R.matrix(t)
    return W.top_variance(m, m.groupBy("sample").agg(F.sum("value").alias("library")), 10)


@register("win11_top_k_contribution", "feature", "contribution share", q("matrix", """
    WITH c AS (SELECT feature, sum(value) - 25.0 * count(*) AS contribution FROM matrix GROUP BY 1), d AS (SELECT feature, contribution - (SELECT avg(contribution) FROM c) AS contribution FROM c)
    SELECT feature, contribution, contribution / nullif((SELECT sum(greatest(contribution, 0)) FROM d), 0) AS share FROM d ORDER BY contribution DESC, feature LIMIT 5"""))
def _(t):
    c = R.matrix(t).groupBy("feature").agg((F.sum("value") - 25.0 * F.count("*")).alias("contribution"))
    d = c.withColumn("contribution", F.col("contribution") - c.agg(F.avg("contribution")).scalar())
    return W.top_contributions(d, "feature", "contribution", 5)


@register("win12_eligible_donor_pick", "donor rank total", "", q("cells", f"""
    WITH p AS (SELECT donor, part, count(*) AS n FROM cells GROUP BY 1, 2), o AS (SELECT donor, CAST(sum(n) AS BIGINT) AS total FROM p GROUP BY 1 HAVING sum(n) > 50),
    r AS (SELECT *, row_number() OVER (ORDER BY {h32("'elig'", "donor")}, donor) AS rank FROM o),
    f AS (SELECT s, part, sum(n) AS n FROM (SELECT unnest([2, 4, 6, 8]) AS s) JOIN r ON r.rank <= s JOIN p USING (donor) GROUP BY 1, 2),
    g AS (SELECT s FROM f GROUP BY 1 HAVING min(n) > 15 AND count(*) = (SELECT count(DISTINCT part) FROM cells))
    SELECT donor, rank, total FROM r WHERE rank <= (SELECT min(s) FROM g)"""))
def _(t):
    return P.eligible_donors(R.cells(t), 50, 15, [2, 4, 6, 8], "elig")


@register("win13_fold_assignment", "patient n fold", "", f"WITH RECURSIVE " + q("smp", f"""
    WITH s AS (SELECT patient, count(*) AS n FROM smp GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, {h32("'fold'", "patient")}, patient) AS i FROM s),
    g AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS fold
      UNION ALL SELECT i, [CASE WHEN j = f THEN loads[j] + n ELSE loads[j] END for j in range(1, 6)], f::INTEGER
      FROM (SELECT r.i, r.n, g.loads, list_position(g.loads, list_min(g.loads)) AS f FROM g JOIN r ON r.i = g.i + 1))
    SELECT patient, n, fold - 1 AS fold FROM r JOIN g USING (i)""").removeprefix("WITH "))
def _(t):
    return P.assign_folds(R.samples(t).groupBy("patient").agg(F.count("*").alias("n")), 5, "fold")


@register("win14_donor_split", "donor", "", q("cells", f"""
    SELECT donor FROM (SELECT DISTINCT donor FROM cells) ORDER BY {h32("'split'", "donor")}, donor LIMIT 2"""))
def _(t):
    return P.donor_split(R.cells(t), fraction=0.25, seed="split")


@register("win15_consecutive_compare", "method tumour part increasing", "", q("m", """
    WITH ww AS (SELECT method, tumour, part, max(v) FILTER (structure = '5-LOW') AS a, max(v) FILTER (structure = '2-HIGH') AS b, max(v) FILTER (structure = '1-URGENT') AS c FROM m GROUP BY ALL)
    SELECT method, tumour, part, a < b AND b < c AS increasing FROM ww WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""))
def _(t):
    means = S.group_means(R.estimates(t), R.samples(t), digits=10)
    return W.chain_increases(means, ["5-LOW", "2-HIGH", "1-URGENT"], ["method", "tumour", "part"])


@register("win16_leave_one_out", "kind left_out moved top full_top", "rho", q("verdict", f"""
    WITH u AS (SELECT method, 'constraint' AS kind, id AS unit, sum(CASE WHEN ok THEN weight ELSE 0 END) AS num, sum(weight) AS den FROM verdict GROUP BY ALL
      UNION ALL SELECT method, 'tumour', CAST(tumour AS VARCHAR), sum(CASE WHEN ok THEN weight ELSE 0 END), sum(weight) FROM verdict GROUP BY 1, 2, 3),
    f AS (SELECT method, kind, sum(num) AS n, sum(den) AS d FROM u GROUP BY ALL),
    g AS (SELECT f.method, f.kind, u.unit, round((f.n - coalesce(o.num, 0)) / nullif(f.d - coalesce(o.den, 0), 0), 9) AS score, round(f.n / f.d, 9) AS full_score
      FROM f JOIN (SELECT DISTINCT kind, unit FROM u) u ON u.kind = f.kind LEFT JOIN u o ON o.method = f.method AND o.kind = f.kind AND o.unit = u.unit),
    r AS {ranks_sql('g', 'kind, unit', 'score full_score')}
    SELECT kind, unit AS left_out, count(*) FILTER (r_score <> r_full_score) AS moved,
      first(method ORDER BY score DESC NULLS LAST, method) AS top, first(method ORDER BY full_score DESC NULLS LAST, method) AS full_top, {corr_sql('r_score', 'r_full_score')} AS rho FROM r GROUP BY 1, 2"""))
def _(t):
    v = cut_lineage(verdict_table(t))
    out = None
    for kind, unit in (("constraint", "id"), ("tumour", "tumour")):
        loo = W.leave_one_out(S.weigh(v, ["method", unit]), unit).withColumn("kind", F.lit(kind))
        out = loo if out is None else out.unionByName(loo)
    out = cut_lineage(out.withColumns({"score": F.round("score", 9), "full_score": F.round("full_score", 9)}))
    ranked = K.attach_rank(K.attach_rank(out, ["kind", "left_out"], "score", "r1"), ["kind", "left_out"], "full_score", "r2")
    from partwise.functions.guards import pearson

    best = lambda c: F.min_by("method", F.struct(F.col(c).isNull(), -F.col(c), F.col("method")))
    return ranked.groupBy("kind", "left_out").agg(F.count_if(F.col("r1") != F.col("r2")).alias("moved"), pearson("r1", "r2").alias("rho"),
                                                  best("score").alias("top"), best("full_score").alias("full_top"))


@register("win17_seed_stability", "method tumour n_results status", "", q("est smp", f"""
    WITH x AS (SELECT method, tumour, {h32("'seed'", "sample")} % 4 AS seed, part, round(avg(value), 9) AS v FROM est JOIN smp USING (sample)
      WHERE part IN ('SMALL', 'LARGE', 'PROMO') GROUP BY ALL),
    o AS (SELECT method, tumour, seed, string_agg(part, '>' ORDER BY v DESC, part) AS ordering FROM x GROUP BY ALL)
    SELECT method, tumour, count(DISTINCT ordering) AS n_results, CASE WHEN count(ordering) < 4 THEN 'blocked' WHEN count(DISTINCT ordering) = 1 THEN 'stable' ELSE 'unstable' END AS status
    FROM o GROUP BY 1, 2"""))
def _(t):
    x = R.estimates(t).where(F.col("part").isin(TRIO)).join(R.samples(t), "sample").groupBy(
        "method", "tumour", (hash32(F.lit("seed"), "sample") % 4).alias("seed"), "part").agg(F.round(F.avg("value"), 9).alias("v"))
    return W.seed_stability(C.ordering(x, ["method", "tumour", "seed"], "v", 3), ["method", "tumour"], "ordering", 4)



