"""Aggregations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.columns import TRIO, aligned
from partwise.catalog.registry import register
from partwise.catalog.roles import q
from partwise.functions.guards import ratio
from partwise.operators import compose as C
from partwise.operators import keys as K
from partwise.operators import metrics as M
from partwise.operators import profiles as P
from partwise.operators import score as S
from partwise.session import cut_lineage

PRIMARY = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
PRIMARY_SQL = "part <> 'STANDARD'"


def scored(t, *methods):
    """et rows with the sample's tumour as group."""
    return aligned(t, *methods, beside=R.samples(t).select("sample", F.col("tumour").alias("group"), "structure"))


def verdict_table(t, *methods):
    est = R.estimates(t, *methods, beside=R.samples(t).select("sample", "tumour", "structure"))
    means = S.group_means(est, None, digits=10)
    return S.verdicts(means, S.constraint_terms(t.spark, R.CONSTRAINTS), ["method", "tumour"])


GT = "et smp"


@register("agg01_duplicate_collapse", "feature", "total average first_value", """
    SELECT p_name AS feature, coalesce(sum(v), 0) AS total, avg(v) AS average, arg_min(v, p_partkey) AS first_value
    FROM (SELECT *, CASE WHEN p_size < 40 THEN p_retailprice END AS v, p_retailprice AS w FROM part) GROUP BY 1""".replace(
        "arg_min(v, p_partkey)", "arg_min(w, p_partkey)"))
def _(t):
    p = t.part.withColumn("v", F.when(F.col("p_size") < 40, F.col("p_retailprice")))
    s = P.collapse(p, ["p_name"], "v", "sum").withColumnRenamed("v", "total")
    m = P.collapse(p, ["p_name"], "v", "mean").withColumnRenamed("v", "average")
    f = P.collapse(p, ["p_name"], "p_retailprice", "first", "p_partkey").withColumnRenamed("p_retailprice", "first_value")
    return s.join(m, "p_name").join(f, "p_name").withColumnRenamed("p_name", "feature")


@register("agg02_total_rescale", "feature sample", "scaled", q("matrix", """
    SELECT feature, sample, coalesce(value / nullif(sum(value) OVER (PARTITION BY sample), 0) * 1e6, 0) AS scaled FROM matrix"""))
def _(t):
    return C.total_rescale(R.matrix(t))


@register("agg03_group_mean_skip_missing", "method tumour structure part", "v", q("est smp", """
    SELECT method, tumour, structure, part, avg(CASE WHEN sample % 13 <> 0 THEN value END) AS v
    FROM est JOIN smp USING (sample) GROUP BY ALL"""))
def _(t):
    est = R.estimates(t).withColumn("value", F.when(F.col("sample") % 13 != 0, F.col("value")))
    return S.group_means(est, R.samples(t))


@register("agg04_group_equal_mean", "method part n_groups", "mae bias", q(GT, """
    SELECT method, part, avg(a) AS mae, avg(b) AS bias, count(*) AS n_groups FROM (SELECT method, part, tumour, avg(abs(e - t)) AS a,
    avg(e - t) AS b FROM et JOIN smp USING (sample) GROUP BY ALL) GROUP BY ALL"""))
def _(t):
    err = F.col("e") - F.col("t")
    return M.group_equal(scored(t), ["method", "part"], "group", {"mae": F.abs(err), "bias": err})


@register("agg05_cohort_profile", "n_samples n_patients n_structures least most structure_sets", "middle", q("smp", """
    WITH p AS (SELECT patient, count(*) AS n, list_sort(list(DISTINCT structure)) AS ss FROM smp GROUP BY 1)
    SELECT (SELECT count(*) FROM smp) AS n_samples, count(*) AS n_patients, (SELECT count(DISTINCT structure) FROM smp) AS n_structures,
    min(n) AS least, max(n) AS most, quantile_cont(n, 0.5) AS middle, count(DISTINCT array_to_string(ss, ',')) AS structure_sets FROM p"""))
def _(t):
    from partwise.operators.ranks import quantiles

    s = R.samples(t)
    per = s.groupBy("patient").agg(F.count("*").alias("k"), F.array_sort(F.collect_set("structure")).alias("ss"))
    mid = quantiles(per, [], "k", [0.5], ["m"]).select("m").scalar()
    n_str = s.agg(F.count_distinct("structure")).scalar()
    return per.agg(F.sum("k").alias("n_samples"), F.count("*").alias("n_patients"), F.min("k").alias("least"),
                   F.max("k").alias("most"), F.count_distinct(F.array_join("ss", ",")).alias("structure_sets")).withColumn(
        "middle", mid.cast("double")).withColumn("n_structures", n_str)


@register("agg06_constraint_score", "method n_pairs n_tumours", "weight_evaluated weight_satisfied score", q("verdict", """
    SELECT method, count(*) AS n_pairs, count(DISTINCT tumour) AS n_tumours, sum(weight) AS weight_evaluated,
    sum(CASE WHEN ok THEN weight ELSE 0 END) AS weight_satisfied, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS score
    FROM verdict GROUP BY 1"""))
def _(t):
    return S.score(verdict_table(t))


@register("agg07_per_group_breakdown", "method tumour n_evaluable n_satisfied satisfied violated", "score", q("verdict", """
    SELECT method, tumour, count(*) AS n_evaluable, count(*) FILTER (ok) AS n_satisfied,
    coalesce(string_agg(id, ',' ORDER BY id) FILTER (ok), '') AS satisfied,
    coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT ok), '') AS violated,
    sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS score FROM verdict GROUP BY 1, 2"""))
def _(t):
    return S.per_group(verdict_table(t))


@register("agg08_per_constraint_breakdown", "method id n_evaluable n_satisfied", "fraction", q("verdict", """
    SELECT m.method, c.id, count(v.id) AS n_evaluable, count(*) FILTER (v.ok) AS n_satisfied,
    count(*) FILTER (v.ok) / nullif(count(v.id), 0)::DOUBLE AS fraction
    FROM (SELECT unnest(['price', 'lines', 'net', 'control']) AS method) m CROSS JOIN con c
    LEFT JOIN verdict v ON v.method = m.method AND v.id = c.id GROUP BY 1, 2"""))
def _(t):
    v = cut_lineage(verdict_table(t))
    return S.per_constraint(v, S.constraint_terms(t.spark, R.CONSTRAINTS), v)


PROFILE_SQL = """d AS (SELECT donor, part, feature, sum(value) AS s FROM x JOIN cells USING (cell) GROUP BY ALL),
    n AS (SELECT donor, part, count(*) AS n FROM cells GROUP BY ALL), g AS (SELECT DISTINCT part, feature FROM d),
    full_d AS (SELECT n.donor, n.part, g.feature, coalesce(d.s, 0) / n.n AS mean FROM n JOIN g ON g.part = n.part
      LEFT JOIN d ON d.donor = n.donor AND d.part = n.part AND d.feature = g.feature),
    prof AS (SELECT part, feature, avg(mean) AS mean, coalesce(var_samp(mean), 0) AS var, count(*) AS n_donors FROM full_d GROUP BY ALL)"""
SPARSE = "x AS (SELECT cell, feature, value - 1.05 AS value FROM expr WHERE value > 1.05)"


def sparse_expr(t):
    return R.cell_expr(t).where("value > 1.05").withColumn("value", F.col("value") - 1.05)


@register("agg09_profile_and_variance", "part feature n_donors", "mean var", q("expr cells", f"""
    WITH {SPARSE}, {PROFILE_SQL} SELECT part, feature, n_donors, mean, var FROM prof"""))
def _(t):
    return P.profile_and_variance(sparse_expr(t), R.cells(t))


@register("agg10_profile_and_variance_pooled", "part feature", "mean var", q("expr cells", f"""
    WITH {SPARSE}, n AS (SELECT part, count(*) AS n FROM cells GROUP BY 1)
    SELECT part, feature, sum(value) / any_value(n) AS mean,
    greatest(sum(value * value) / any_value(n) - pow(sum(value) / any_value(n), 2), 0) AS var
    FROM x JOIN cells USING (cell) JOIN n USING (part) GROUP BY ALL"""))
def _(t):
    return P.pooled_profile(sparse_expr(t), R.cells(t))


@register("agg11_size_factor", "part", "size", q("cells expr", """
    WITH lib AS (SELECT cell, CASE WHEN part = 'L3' THEN 0 ELSE sum(value) END AS library, part FROM expr JOIN cells USING (cell) GROUP BY cell, part),
    s AS (SELECT r.part, avg(library) AS size FROM (SELECT DISTINCT part FROM cells UNION SELECT 'L99') r LEFT JOIN lib USING (part) GROUP BY 1),
    f AS (SELECT part, coalesce(size, (SELECT median(size) FROM s)) AS size FROM s)
    SELECT part, CASE WHEN size = 0 THEN (SELECT median(size) FROM f WHERE size > 0) ELSE size END AS size FROM f"""))
def _(t):
    lib = R.cell_expr(t).groupBy("cell").agg(F.sum("value").alias("library")).join(R.cells(t), "cell").withColumn(
        "library", F.when(F.col("part") == "L3", 0.0).otherwise(F.col("library")))
    names = R.cells(t).select("part").distinct()
    roster = names.unionByName(names.agg(F.lit("L99").alias("part")))
    return P.size_factors(lib, roster)


@register("agg12_per_type_metrics", "method part n n_groups n_absent", "mae rmse bias pearson_r spearman_rho false_positive", q(GT, """
    WITH x AS (SELECT method, part, tumour, e, t, t > 1e-6 AS present FROM et JOIN smp USING (sample)),
    g AS (SELECT method, part, avg(a) AS mae, sqrt(avg(s)) AS rmse, avg(b) AS bias, count(*) AS n_groups FROM
      (SELECT method, part, tumour, avg(abs(e - t)) AS a, avg((e - t) ** 2) AS s, avg(e - t) AS b FROM x GROUP BY ALL) GROUP BY ALL),
    f AS (SELECT method, part, count(*) AS n, count(*) FILTER (NOT present) AS n_absent, avg(e) FILTER (NOT present) AS false_positive,
      covar_pop(e, t) FILTER (present) / nullif(stddev_pop(e) FILTER (present) * stddev_pop(t) FILTER (present), 0) AS pearson_r FROM x GROUP BY ALL),
    k AS (SELECT method, part, rank() OVER (PARTITION BY method, part ORDER BY e) + (count(*) OVER (PARTITION BY method, part, e) - 1) / 2.0 AS re,
      rank() OVER (PARTITION BY method, part ORDER BY t) + (count(*) OVER (PARTITION BY method, part, t) - 1) / 2.0 AS rt FROM x WHERE present),
    s AS (SELECT method, part, covar_pop(re, rt) / nullif(stddev_pop(re) * stddev_pop(rt), 0) AS spearman_rho FROM k GROUP BY ALL)
    SELECT * FROM g JOIN f USING (method, part) LEFT JOIN s USING (method, part)"""))
def _(t):
    return M.per_type(cut_lineage(scored(t)))


OVERALL_SQL = f"""ps AS (SELECT method, sample, tumour, avg(abs(e - t)) AS mae_all, avg(abs(e - t)) FILTER ({PRIMARY_SQL}) AS mae_primary,
      avg((e - t) ** 2) FILTER ({PRIMARY_SQL}) AS mse, covar_pop(e, t) / nullif(stddev_pop(e) * stddev_pop(t), 0) AS r,
      count(DISTINCT part) AS n_parts FROM et JOIN smp USING (sample) GROUP BY ALL)"""


@register("agg13_overall_metrics", "method n_samples n_groups n_failed n_parts comparable", "mae_all mae_primary rmse_primary mean_r", q(GT, f"""
    WITH {OVERALL_SQL}, g AS (SELECT method, tumour, avg(mae_all) AS a, avg(mae_primary) AS b, avg(mse) AS c, avg(r) AS d FROM ps GROUP BY ALL),
    n AS (SELECT method, count(*) AS n_samples, max(n_parts) AS n_parts FROM ps GROUP BY 1)
    SELECT method, n_samples, count(*) AS n_groups, CAST(0 AS BIGINT) AS n_failed, n_parts, n_parts >= 6 AS comparable, avg(a) AS mae_all,
    avg(b) AS mae_primary, sqrt(avg(c)) AS rmse_primary, avg(d) AS mean_r FROM g JOIN n USING (method) GROUP BY method, n_samples, n_parts"""))
def _(t):
    return M.overall(scored(t), PRIMARY, 6)


@register("agg14_per_slice_metrics", "method structure n", "mae", q(GT, """
    WITH s AS (SELECT method, sample, structure, avg(abs(e - t)) AS mae FROM et JOIN smp USING (sample) GROUP BY ALL)
    SELECT method, coalesce(structure, '(all)') AS structure, count(*) AS n, avg(mae) AS mae FROM s
    GROUP BY GROUPING SETS ((method), (method, structure)) HAVING grouping(structure) = 1 OR count(*) >= 5"""))
def _(t):
    return M.sliced(scored(t), "structure")


@register("agg15_detection_limit", "method part", "limit_", q("et", """
    WITH n AS (SELECT method, part, count(*) FILTER (t <= 1e-6) AS na, count(*) FILTER (t > 1e-6) AS np,
      avg(e) FILTER (t <= 1e-6) AS mu, stddev_samp(e) FILTER (t <= 1e-6) AS sd FROM et GROUP BY ALL),
    q AS (SELECT method, part, list_sort(list_distinct(quantile_cont(t, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS edges
      FROM et WHERE t > 1e-6 GROUP BY ALL),
    b AS (SELECT method, part, e, edges, greatest(len(list_filter(edges, lambda x: x < t)), 1) AS bin FROM et JOIN q USING (method, part) WHERE t > 1e-6),
    a AS (SELECT method, part, bin, count(*) AS n, avg(e) AS m, any_value(edges[bin]) AS lft FROM b GROUP BY ALL)
    SELECT method, part, min(lft) FILTER (na >= 3 AND np >= 8 AND n >= 2 AND m > mu + CASE WHEN coalesce(sd, 0) > 0 THEN sd ELSE 1e-9 END) AS limit_
    FROM n LEFT JOIN a USING (method, part) GROUP BY ALL"""))
def _(t):
    return M.detection_limit(cut_lineage(aligned(t)), ["method", "part"]).withColumnRenamed("limit", "limit_")


@register("agg16_row_pearson", "method sample", "r", q("et", """
    SELECT method, sample, covar_pop(e, t) / nullif(stddev_pop(e) * stddev_pop(t), 0) AS r FROM et GROUP BY ALL"""))
def _(t):
    from partwise.operators.stats import pearson_by

    return pearson_by(aligned(t), ["method", "sample"], "e", "t")


@register("agg20_bias_and_levels", "method part n", "mean_e mean_t bias ratio", q("et", """
    SELECT method, part, count(*) AS n, avg(e) AS mean_e, avg(t) AS mean_t, avg(e - t) AS bias, avg(e) / nullif(avg(t), 0) AS ratio
    FROM et GROUP BY ALL"""))
def _(t):
    return M.levels(aligned(t), ["method", "part"])


@register("agg21_recovery_slope", "method part n", "recovery", q("et", """
    SELECT method, part, count(*) AS n, 1 + covar_pop(e - t, t) / nullif(var_pop(t), 0) AS recovery FROM et GROUP BY ALL HAVING count(*) >= 50"""))
def _(t):
    return M.recovery_slope(aligned(t), ["method", "part"])


INTERVALS = """SELECT method, t, e - 0.05 - e * 0.1 AS lo, e + 0.05 + e * 0.1 AS hi FROM et WHERE method <> 'control'"""


def intervals(t):
    e = F.col("e")
    return aligned(t, "price", "lines", "net").select("method", "sample", "part", "t", (e - 0.05 - e * 0.1).alias("lo"),
                                                      (e + 0.05 + e * 0.1).alias("hi"))


@register("agg29_interval_coverage", "method n_intervals reported", "coverage gap width interval_score", q("et", f"""
    SELECT m.method, n_intervals, n_intervals IS NOT NULL AS reported, coverage, coverage - 0.95 AS gap, width, interval_score
    FROM (SELECT unnest(['price', 'lines', 'net', 'control']) AS method) m LEFT JOIN (
    SELECT method, count(*) AS n_intervals, avg(CASE WHEN t >= lo AND t <= hi THEN 1.0 ELSE 0.0 END) AS coverage, avg(hi - lo) AS width,
    avg(hi - lo + 2 / (1 - 0.95) * (greatest(lo - t, 0) + greatest(t - hi, 0))) AS interval_score FROM ({INTERVALS}) GROUP BY 1) USING (method)"""))
def _(t):
    methods = R.estimates(t).select("method").distinct()
    return M.coverage(intervals(t), methods)


@register("agg30_conformal_quantile", "method part n_calibration", "q coverage", q("et smp", """
    WITH r AS (SELECT method, part, abs(e - t) AS r, patient % 2 = 0 AS cal FROM et JOIN smp USING (sample)),
    k AS (SELECT method, part, r, row_number() OVER (PARTITION BY method, part ORDER BY r) AS rn, count(*) OVER (PARTITION BY method, part) AS n FROM r WHERE cal),
    q AS (SELECT method, part, max(n) AS n_calibration, max(r) FILTER (rn = ceil((n + 1) * (1 - 0.1::DOUBLE))) AS q FROM k GROUP BY ALL)
    SELECT method, part, n_calibration, q, (SELECT avg(CASE WHEN r.r <= q.q THEN 1.0 ELSE 0.0 END) FROM r
      WHERE r.method = q.method AND r.part = q.part AND NOT cal) AS coverage FROM q"""))
def _(t):
    rows = aligned(t).join(R.samples(t).select("sample", "patient"), "sample").select(
        "method", "part", F.abs(F.col("e") - F.col("t")).alias("r"), (F.col("patient") % 2 == 0).alias("cal"))
    return M.conformal(cut_lineage(rows), ["method", "part"], "cal", "r", 0.1)


@register("agg31_model_fit_r2", "n_values", "q1 median q3", q("sig est smp", """
    WITH p AS (SELECT tumour AS sample, part, avg(value) AS v FROM est JOIN smp USING (sample) WHERE method = 'price' GROUP BY 1, 2),
    fit AS (SELECT feature, sample, sum(mean * v) AS fitted FROM sig JOIN p USING (part) GROUP BY 1, 2),
    obs AS (SELECT p_brand AS feature, c_nationkey AS sample, avg(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    r AS (SELECT sample, 1 - sum((value - coalesce(fitted, 0)) ** 2) / nullif(var_pop(value) * count(*), 0) AS r2 FROM obs LEFT JOIN fit USING (feature, sample) GROUP BY 1)
    SELECT count(*) AS n_values, quantile_cont(r2, 0.25) AS q1, quantile_cont(r2, 0.5) AS median, quantile_cont(r2, 0.75) AS q3 FROM r"""))
def _(t):
    smp = R.samples(t)
    shares = R.estimates(t, "price").join(smp, "sample").groupBy(F.col("tumour").alias("sample"), "part").agg(F.avg("value").alias("value"))
    fit = K.matrix_product(R.signature(t), shares, ["sample"])
    obs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        smp.withColumnRenamed("sample", "o"), F.col("l_orderkey") == F.col("o")).groupBy(
        F.col("p_brand").alias("feature"), F.col("tumour").alias("sample")).agg(F.avg("l_quantity").alias("value"))
    return M.quartiles(M.model_fit(obs, fit), [], "r2")


@register("agg32_crosstab_2x2", "a b c d", "odds_ratio p_value", """
    WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b,
      count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels),
    k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM n),
    f AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
      - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lp FROM k),
    o AS (SELECT lp AS seen FROM f WHERE k = a)
    SELECT a, b, c, d, a * d / nullif(b * c, 0)::DOUBLE AS odds_ratio, least(1, sum(exp(lp)) FILTER (lp <= seen + 1e-7)) AS p_value
    FROM f, o GROUP BY a, b, c, d""")
def _(t):
    flags = t.labels.select((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("x"))
    return M.crosstab(flags, "q", "x")


@register("agg33_composition_share", "nation mode n_mode n_cells", "largest_share", """
    WITH n AS (SELECT c_nationkey AS nation, o_orderpriority AS label, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT nation, arg_min(label, (-n, label)) AS mode, max(n) AS n_mode, CAST(sum(n) AS BIGINT) AS n_cells, max(n) / sum(n) AS largest_share FROM n GROUP BY 1""".replace(
        "arg_min(label, (-n, label))", "first(label ORDER BY n DESC, label)"))
def _(t):
    rows = R.samples(t).select(F.col("tumour").alias("nation"), F.col("structure").alias("label"))
    top = M.label_shares(rows, "nation", "label").groupBy("nation").agg(F.max("share").alias("largest_share"))
    return M.most_common(rows, "nation", "label").join(top, "nation")


@register("agg34_coverage_of_mapping", "n_cells n_kept n_dropped top_dropped n_top", "fraction_dropped", """
    SELECT count(*) AS n_cells, count(*) FILTER (event_type IN ('click', 'view')) AS n_kept, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_dropped,
    count(*) FILTER (event_type NOT IN ('click', 'view')) / count(*)::DOUBLE AS fraction_dropped,
    (SELECT event_type FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_dropped,
    (SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1) AS n_top FROM events""")
def _(t):
    total, dropped = M.mapping_coverage(t.events, "event_type", F.col("event_type").isin("click", "view"), top=1)
    return total.withColumn("top_dropped", dropped.select("event_type").scalar()).withColumn("n_top", dropped.select("n").scalar())


@register("agg35_donor_concentration", "part n_cells n_donors", "top_donor_share", q("cells", """
    SELECT part, CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS n_donors, max(n) / sum(n) AS top_donor_share
    FROM (SELECT part, donor, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1"""))
def _(t):
    return M.concentration(R.cells(t))


@register("agg36_degenerate_solves", "method n_rows one_part uniform all_zero non_finite duplicate_rows", "", q("est", """
    WITH r AS (SELECT method, sample, max(value) AS hi, min(value) AS lo, sum(value) AS tot, string_agg(value, ',' ORDER BY part) AS sig FROM est GROUP BY 1, 2)
    SELECT method, count(*) AS n_rows, count(*) FILTER (hi > 0.99) AS one_part, count(*) FILTER (hi = lo) AS uniform, count(*) FILTER (tot = 0) AS all_zero,
    CAST(0 AS BIGINT) AS non_finite, count(*) - count(DISTINCT sig) AS duplicate_rows FROM r GROUP BY 1"""))
def _(t):
    return M.degenerate(R.estimates(t))


@register("agg37_absence_vs_misassignment", "method n n_empty mostly_empty", "a_over_b discordant", q("est truth", """
    WITH e AS (SELECT method, sample, max(value) FILTER (part = 'LARGE') AS a, max(value) FILTER (part = 'SMALL') AS b, sum(value) AS s
      FROM est WHERE part IN ('SMALL', 'LARGE', 'PROMO') GROUP BY 1, 2),
    t AS (SELECT sample, max(value) FILTER (part = 'LARGE') AS a, max(value) FILTER (part = 'SMALL') AS b FROM truth GROUP BY 1)
    SELECT method, count(*) AS n, count(*) FILTER (s <= 0) AS n_empty, count(*) FILTER (s <= 0) > 0.5 * count(*) AS mostly_empty,
    avg(CASE WHEN e.a > e.b THEN 1.0 ELSE 0.0 END) FILTER (s > 0) AS a_over_b,
    avg(CASE WHEN e.a > e.b AND t.b > t.a THEN 1.0 ELSE 0.0 END) FILTER (s > 0) AS discordant FROM e JOIN t USING (sample) GROUP BY 1"""))
def _(t):
    return M.misassignment(R.estimates(t), R.truth(t), "LARGE", "SMALL", TRIO)


@register("agg38_ordering_frequency", "method ordering n", "share small_first", q("est", """
    WITH o AS (SELECT method, sample, string_agg(part, '>' ORDER BY value DESC, part) AS ordering FROM est WHERE part IN ('SMALL', 'LARGE', 'PROMO')
      GROUP BY 1, 2 HAVING sum(value) > 0)
    SELECT method, ordering, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY method) AS share,
      (SELECT avg((split_part(x.ordering, '>', 1) = 'SMALL')::INT) FROM o x WHERE x.method = o.method) AS small_first FROM o GROUP BY 1, 2"""))
def _(t):
    live = C.renormalise_within(R.estimates(t), TRIO).where("share IS NOT NULL")
    shares = M.label_shares(C.ordering(live, ["method", "sample"], "share", 3), "method", "ordering")
    return shares.join(M.first_share(shares, "method", "ordering", "SMALL").withColumnRenamed("first_share", "small_first"), "method")


@register("agg39_l1_to_prior", "method", "l1_all l1_within", q("est", """
    WITH m AS (SELECT method, part, avg(value) AS v FROM est GROUP BY 1, 2), p AS (SELECT p_type AS part, count(*) / sum(count(*)) OVER () AS prior FROM part GROUP BY 1)
    SELECT method, sum(abs(v - prior)) AS l1_all, sum(CASE WHEN part IN ('SMALL', 'LARGE', 'PROMO') THEN abs(v - prior) ELSE 0 END) AS l1_within FROM m JOIN p USING (part) GROUP BY 1"""))
def _(t):
    n = t.part.groupBy(F.col("p_type").alias("part")).agg(F.count("*").alias("n"))
    prior = n.select("part", ratio("n", n.agg(F.sum("n")).scalar()).alias("prior"))
    gap = F.abs(F.col("v") - F.col("prior"))
    return R.estimates(t).groupBy("method", "part").agg(F.avg("value").alias("v")).join(prior, "part").groupBy("method").agg(
        F.sum(gap).alias("l1_all"), F.sum(F.when(F.col("part").isin(TRIO), gap).otherwise(0.0)).alias("l1_within"))


@register("agg40_profile_correlation_label", "component label", "r", q("expr cells", """
    WITH ref AS (SELECT part, feature, avg(value) AS m FROM expr JOIN cells USING (cell) GROUP BY 1, 2),
    est AS (SELECT donor AS component, feature, avg(value) AS m FROM expr JOIN cells USING (cell) WHERE part IN ('L1', 'L4', 'L7') GROUP BY 1, 2),
    c AS (SELECT component, part, covar_pop(ln(1 + est.m), ln(1 + ref.m)) / nullif(stddev_pop(ln(1 + est.m)) * stddev_pop(ln(1 + ref.m)), 0) AS r
      FROM est JOIN ref USING (feature) GROUP BY 1, 2)
    SELECT component, arg_max(part, r) AS label, max(r) AS r FROM c GROUP BY 1"""))
def _(t):
    x = R.cell_expr(t).join(R.cells(t), "cell")
    ref = x.groupBy("part", "feature").agg(F.avg("value").alias("mean"))
    est = x.where(F.col("part").isin("L1", "L4", "L7")).groupBy(F.col("donor").alias("component"), "feature").agg(F.avg("value").alias("mean"))
    return P.label_by_profile(est, ref, [f"L{i}" for i in range(10)])


PANEL = """SELECT cell, part AS cluster, 'p' || (feature % 3) AS panel, avg(value) AS score FROM expr JOIN cells USING (cell) GROUP BY ALL"""


@register("agg41_panel_score_label", "cluster label n_cells", "", q("expr cells", f"""
    WITH cs AS ({PANEL}), k AS (SELECT cluster, panel, avg(score) AS s FROM cs GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, panel) AS rn FROM k),
    l AS (SELECT a.cluster, a.panel AS p1, b.panel AS p2, a.s - b.s AS gap FROM r a JOIN r b ON a.cluster = b.cluster AND a.rn = 1 AND b.rn = 2),
    w AS (SELECT l.cluster, a.cell, CASE WHEN gap >= 0.01 THEN p1 WHEN a.score >= b.score THEN p1 ELSE p2 END AS label
      FROM l JOIN cs a ON a.cluster = l.cluster AND a.panel = p1 JOIN cs b ON b.cell = a.cell AND b.panel = p2)
    SELECT cluster, label, count(*) AS n_cells FROM w GROUP BY 1, 2"""))
def _(t):
    cs = R.cell_expr(t).join(R.cells(t), "cell").groupBy("cell", F.col("part").alias("cluster"),
                                                        F.concat(F.lit("p"), (F.col("feature") % 3).cast("string")).alias("panel")).agg(
        F.avg("value").alias("score"))
    labels = P.panel_labels(cs.groupBy("cluster", "panel").agg(F.avg("score").alias("score")), 0.01)
    return P.split_near_ties(cs, labels).groupBy("cluster", "label").agg(F.count("*").alias("n_cells"))


@register("agg42_cells_to_roster", "sample part", "value", q("est smp", """
    WITH c AS (SELECT tumour AS sample, part AS component, avg(value) AS value FROM est JOIN smp USING (sample) WHERE method = 'price' GROUP BY 1, 2),
    m AS (SELECT sample, CASE WHEN component IN ('SMALL', 'ECONOMY') THEN 'little' WHEN component = 'LARGE' THEN 'big' END AS part, sum(value) AS value FROM c GROUP BY 1, 2)
    SELECT s.sample, r.part, m.value FROM (SELECT DISTINCT sample FROM c) s CROSS JOIN (SELECT unnest(['little', 'big', 'unclaimed']) AS part) r
    LEFT JOIN m ON m.sample = s.sample AND m.part = r.part"""))
def _(t):
    c = R.estimates(t, "price").join(R.samples(t), "sample").groupBy(
        F.col("tumour").alias("sample"), F.col("part").alias("component")).agg(F.avg("value").alias("value"))
    names = t.part.select(F.col("p_type").alias("component")).distinct()
    lab = F.when(F.col("component").isin("SMALL", "ECONOMY"), "little").when(F.col("component") == "LARGE", "big")
    labels = names.select("component", lab.alias("label")).where("label IS NOT NULL")
    roster = labels.select(F.col("label").alias("part")).union(labels.select(F.lit("unclaimed")))
    return P.to_roster(c, labels, roster, c)


@register("agg43_count_unit_recovery", "cell", "unit library total", """
    WITH e AS (SELECT l_suppkey AS cell, l_quantity * (1 + l_suppkey % 3) AS e FROM lineitem), u AS (SELECT cell, min(e) AS unit FROM e GROUP BY 1)
    SELECT cell, max(unit) AS unit, max(1e4 / unit) AS library, sum(e / unit) AS total FROM e JOIN u USING (cell) GROUP BY 1""")
def _(t):
    e = F.log1p(F.col("l_quantity") * (1 + F.col("l_suppkey") % 3))
    return P.count_units(t.lineitem.select(F.col("l_suppkey").alias("cell"), e.alias("value")))


@register("agg44_scale_factor_gate", "suppkey passes all_pass", "r cv", """
    WITH x AS (SELECT l_suppkey AS s, l_quantity AS raw, l_quantity * 3.5 + CASE WHEN l_suppkey % 10 = 0 THEN l_tax ELSE 0 END AS pub FROM lineitem WHERE l_quantity > 1),
    g AS (SELECT s AS suppkey, covar_pop(raw, pub) / nullif(stddev_pop(raw) * stddev_pop(pub), 0) AS r, stddev_pop(pub / raw) / nullif(avg(pub / raw), 0) AS cv FROM x GROUP BY 1)
    SELECT suppkey, r, cv, abs(r - 1) < 1e-9 AND cv <= 1e-6 AS passes,
      (SELECT bool_and(coalesce(abs(r - 1) < 1e-9 AND cv <= 1e-6, false)) FROM g) AS all_pass FROM g""")
def _(t):
    from partwise.functions.guards import pearson

    raw = F.col("l_quantity")
    pub = raw * 3.5 + F.when(F.col("l_suppkey") % 10 == 0, F.col("l_tax")).otherwise(0.0)
    x = t.lineitem.where("l_quantity > 1").select(F.col("l_suppkey").alias("suppkey"), raw.alias("raw"), pub.alias("pub"))
    k = ratio("pub", "raw")
    g = x.groupBy("suppkey").agg(pearson("raw", "pub").alias("r"), ratio(F.stddev_pop(k), F.avg(k)).alias("cv"))
    return M.gate(g.withColumn("passes", (F.abs(F.col("r") - 1) < 1e-9) & (F.col("cv") <= 1e-6)), "passes")


BOARD_SQL = """board AS (SELECT method, count(*) AS n_pairs, round(sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight), 12) AS score FROM verdict GROUP BY 1)"""


def board(t):
    return cut_lineage(S.score(verdict_table(t)).withColumn("score", F.round("score", 12)))


def is_control():
    return F.col("method") == "control"


@register("agg45_tie_groups", "n members", "score", q("verdict", f"""
    WITH {BOARD_SQL} SELECT count(*) AS n, string_agg(method, ',' ORDER BY method) AS members, score FROM board GROUP BY score"""))
def _(t):
    return M.tie_groups(board(t), "score")


@register("agg46_coverage_comparable", "method n_pairs comparable", "score", q("verdict", f"""
    WITH {BOARD_SQL} SELECT *, n_pairs >= (SELECT max(n_pairs) FROM board WHERE method <> 'control') AS comparable FROM board"""))
def _(t):
    return M.mark_comparable(board(t), is_control())


@register("agg48_constraint_spread", "id unanimous", "mean lowest highest control_mean spread", q("verdict", """
    WITH p AS (SELECT method, id, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS f FROM verdict GROUP BY 1, 2)
    SELECT id, avg(f) FILTER (method <> 'control') AS mean, min(f) FILTER (method <> 'control') AS lowest, max(f) FILTER (method <> 'control') AS highest,
    avg(f) FILTER (method = 'control') AS control_mean, max(f) FILTER (method <> 'control') - min(f) FILTER (method <> 'control') AS spread,
    max(f) FILTER (method <> 'control') = min(f) FILTER (method <> 'control') AS unanimous FROM p GROUP BY 1"""))
def _(t):
    v = cut_lineage(verdict_table(t))
    return M.constraint_spread(S.per_constraint(v, S.constraint_terms(t.spark, R.CONSTRAINTS), v), is_control())


@register("agg49_score_resolution", "n_distinct", "min_step max_step", q("verdict", f"""
    WITH {BOARD_SQL}, s AS (SELECT method, min(weight) / sum(weight) AS step FROM verdict GROUP BY 1)
    SELECT (SELECT count(DISTINCT score) FROM board) AS n_distinct, min(step) AS min_step, max(step) AS max_step FROM s"""))
def _(t):
    v = cut_lineage(verdict_table(t))
    return M.resolution(v, S.score(v))

