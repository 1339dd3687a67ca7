"""The named compositions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.aggregates import BOARD_SQL, verdict_table
from partwise.catalog.columns import TRIO, aligned
from partwise.catalog.fits import SIG_B, fit_sql, nnls_ctes, problem, second_reference
from partwise.catalog.joins import NEW_ORDERS, new_orders
from partwise.catalog.registry import register
from partwise.catalog.resampling import DRAWS, OBS, WHO, boot_sql, perm_spearman_sql, perm_sql
from partwise.catalog.roles import PARTS, h32, q, verdict_sql
from partwise.catalog.statistics import beta_sql, corr_sql, ranks_sql
from partwise.functions.draws import hash32
from partwise.operators import diff as D
from partwise.operators import fit as FT
from partwise.operators import ledgers as L
from partwise.operators import metrics as M
from partwise.operators import score as S
from partwise.plans import studies as P
from partwise.session import cut_lineage, scratch


def terms(t):
    return S.constraint_terms(t.spark, R.CONSTRAINTS)


def null_sql(draws: int, seed: str, by: str) -> str:
    return f"""pm AS (SELECT method, draw, p.tumour, p.structure, part, round(avg(value), 10) AS v FROM est JOIN {perm_sql('smp', 'tumour', 'structure', 'sample', draws, seed)} p USING (sample)
      GROUP BY ALL), nv AS ({verdict_sql('pm', 'method, draw, tumour')}),
    ns AS (SELECT {by}, draw, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS s FROM nv WHERE ok IS NOT NULL GROUP BY ALL)"""


LEAD_SQL = f"""{BOARD_SQL}, {OBS}, u AS (SELECT method, tumour, sum(CASE WHEN ok THEN weight ELSE 0 END) AS num, sum(weight) AS den FROM verdict GROUP BY 1, 2),
    b AS {boot_sql('u', 'tumour', DRAWS, 'board-boot')}, bs AS (SELECT method, draw, sum(num * times) / sum(den * times) AS s FROM u JOIN b USING (tumour) GROUP BY 1, 2),
    ci AS (SELECT method, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high FROM bs GROUP BY 1),
    {null_sql(DRAWS, 'board-perm', 'method')},
    pv AS (SELECT method, avg(ns.s) AS null_mean, (count(*) FILTER (ns.s >= obs.s - 1e-9) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM ns JOIN obs USING (method) GROUP BY 1),
    lead AS (SELECT method, n_pairs, n_pairs >= (SELECT max(n_pairs) FROM board WHERE method <> 'control') AS comparable, count(*) OVER (PARTITION BY score) AS tie_size, score, ci_low, ci_high, null_mean, p_value
    FROM board JOIN ci USING (method) JOIN pv USING (method))"""


@register("qry01_constraint_leaderboard", "method n_pairs comparable tie_size", "score ci_low ci_high null_mean p_value", q("verdict", f"""
    WITH {LEAD_SQL}
    SELECT * FROM lead"""))
def _(t):
    return P.constraint_leaderboard(R.estimates(t), R.samples(t), terms(t), ["control"], DRAWS, DRAWS, "board", digits=10, who=WHO,
                                    table=cut_lineage(verdict_table(t)))


@register("agg47_control_audit", "best_control worst_real_method n_real_at_or_below real_at_or_below controls_above_null perfect", "best_control_score worst_real median_real perfect_share", q("verdict", f"""
    WITH {LEAD_SQL}, rl AS (SELECT * FROM lead WHERE method <> 'control' AND comparable), bc AS (SELECT method AS bm, score AS bs FROM lead WHERE method = 'control'),
    pc AS (SELECT id, count(*) * max(weight) AS w, bool_and(ok) AS whole FROM verdict JOIN bc ON method = bm GROUP BY 1)
    SELECT bm AS best_control, bs AS best_control_score, (SELECT method FROM rl ORDER BY score, method LIMIT 1) AS worst_real_method, (SELECT min(score) FROM rl) AS worst_real,
    (SELECT quantile_cont(score, 0.5) FROM rl) AS median_real, (SELECT count(*) FROM rl WHERE score <= bs) AS n_real_at_or_below,
    coalesce((SELECT string_agg(method, ',' ORDER BY method) FROM rl WHERE score <= bs), '') AS real_at_or_below,
    coalesce((SELECT string_agg(method, ',' ORDER BY method) FROM lead WHERE method = 'control' AND p_value < 0.05 AND score > null_mean), '') AS controls_above_null,
    coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM pc WHERE whole), '') AS perfect, (SELECT coalesce(sum(w) FILTER (whole), 0) / sum(w) FROM pc) AS perfect_share FROM bc"""))
def _(t):
    verdict = cut_lineage(verdict_table(t))
    lead = P.constraint_leaderboard(R.estimates(t), R.samples(t), terms(t), ["control"], DRAWS, DRAWS, "board", digits=10, who=WHO, table=verdict)
    return M.control_audit(cut_lineage(lead), F.col("method") == "control", verdict=verdict)


@register("qry02_accuracy_benchmark", "method n_samples n_groups comparable tied", "mae_primary rmse_primary mean_r delta ci_low ci_high")
def _(t):
    x, c = cut_lineage(R.cell_expr(t).where("value > 1.05").withColumn("value", F.col("value") - 1.05)), R.cells(t)
    parts = [f"L{i}" for i in range(10)]
    mixes = t.embeddings.select(F.floor(F.col("vec_id") / 5).alias("mixture")).distinct()
    targets = mixes.withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts]))).select(
        "mixture", (F.col("mixture") % 8).alias("donor"), "part", (hash32(F.lit("tgt"), "mixture", "part") % 9).alias("n"))
    return P.accuracy_benchmark(x, c, targets, parts, 6, "split")


AGREE = """sa AS (SELECT method || part AS method, round(1 - avg(abs(e - t)), 12) AS a FROM et WHERE method <> 'control' OR part <> 'SMALL' GROUP BY method, part),
    sy AS (SELECT 'mae' AS yardstick, method || part AS method, round(-avg((e - t) ** 2), 12) AS t FROM et GROUP BY method, part
      UNION ALL SELECT 'level', method || part, round(avg(t * e), 12) FROM et GROUP BY method, part),
    j AS (SELECT yardstick, method, a, t FROM sy JOIN sa USING (method) WHERE method <> 'controlLARGE')"""


@register("qry03_ranking_agreement", "yardstick n n_distinct verdict", "rho ci_low ci_high", q("et", f"""
    WITH {AGREE}, b AS {boot_sql('j', 'method', DRAWS, 'agree')}, x AS (SELECT yardstick, draw, a, t FROM j JOIN b USING (method), unnest(range(times)) AS _u(k)),
    r AS (SELECT yardstick, draw, {corr_sql('r_a', 'r_t')} AS rho FROM {ranks_sql('x', 'yardstick, draw', 'a t')} GROUP BY 1, 2),
    ci AS (SELECT yardstick, quantile_cont(rho, 0.025) AS ci_low, quantile_cont(rho, 0.975) AS ci_high FROM r GROUP BY 1),
    o AS (SELECT yardstick, count(*) AS n, count(DISTINCT (a, t)) AS n_distinct, {corr_sql('r_a', 'r_t')} AS rho FROM {ranks_sql('j', 'yardstick', 'a t')} GROUP BY 1)
    SELECT y.yardstick, n, n_distinct, CASE WHEN n IS NULL THEN 'UNAVAILABLE' WHEN n_distinct < 8 THEN 'NOT INTERPRETABLE' WHEN rho IS NULL THEN 'NOT COMPUTABLE'
      WHEN rho >= 0.7 AND ci_low > 0 THEN 'HEADLINE' WHEN rho >= 0.7 THEN 'BELOW BAR' ELSE 'NULL RESULT' END AS verdict, rho, ci_low, ci_high
    FROM (SELECT unnest(['mae', 'level', 'absent']) AS yardstick) y LEFT JOIN o USING (yardstick) LEFT JOIN ci USING (yardstick)"""))
def _(t):
    et = aligned(t).withColumn("m", F.concat("method", "part"))
    err = F.col("e") - F.col("t")
    a = et.where("method <> 'control' OR part <> 'SMALL'").groupBy(F.col("m").alias("method")).agg((1 - F.avg(F.abs(err))).alias("score"))
    y = et.groupBy(F.col("m").alias("method")).agg(F.avg(err * err).alias("mae"), F.avg(F.col("t") * F.col("e")).alias("level")).unpivot(
        ["method"], ["mae", "level"], "yardstick", "score")
    d = t.spark.createDataFrame([("mae", False), ("level", True), ("absent", True)], "yardstick STRING, higher_is_better BOOLEAN")
    return P.ranking_agreement(cut_lineage(a), cut_lineage(y), d, ["controlLARGE"], DRAWS, "agree")


@register("qry04_purity_yardstick", "method sample n", "mean_e mean_t bias ratio rho r", fit_sql("fsig bulk truth", f"""
    WITH {nnls_ctes('fx', 'fsig', 'bulk', 6)}, cl AS (SELECT sample, part, value / nullif(sum(value) OVER (PARTITION BY sample), 0) AS value FROM fx),
    tr AS (SELECT patient, CASE WHEN patient % 10 <> 3 THEN avg(value) END AS p FROM truth JOIN smp USING (sample) WHERE part = 'PROMO' GROUP BY 1),
    ps AS (SELECT method, sample, round(value, 11) AS e, round(p, 11) AS t FROM (SELECT 'raw' AS method, * FROM fx UNION ALL SELECT 'closed', * FROM cl) JOIN tr ON sample = patient WHERE part = 'PROMO'), j AS (SELECT * FROM ps WHERE e IS NOT NULL AND t IS NOT NULL)
    SELECT method, sample, NULL AS n, e AS mean_e, t AS mean_t, e - t AS bias, NULL::DOUBLE AS ratio, NULL::DOUBLE AS rho, NULL::DOUBLE AS r FROM ps UNION ALL
    SELECT method, NULL, count(*) AS n, avg(e) AS mean_e, avg(t) AS mean_t, avg(e - t) AS bias, avg(e) / avg(t) AS ratio, {corr_sql('r_e', 'r_t')} AS rho, {corr_sql('e', 't')} AS r FROM {ranks_sql('j', 'method', 'e t')} GROUP BY 1"""))
def _(t):
    from partwise.operators import compose as C
    from partwise.operators import keys as K

    sig, bulk = problem(t)
    raw = cut_lineage(FT.nnls(sig, bulk, PARTS))
    fits = K.stack({"raw": raw, "closed": C.simplex_close(raw, ["sample"])}).withColumn("value", F.round("value", 11))
    code = lambda c, tail: F.concat_ws("-", F.lit("S"), c, F.lit(tail))
    codes = bulk.select("sample").distinct().select("sample", code("sample", "01A").alias("strict"), code("sample", "01").alias("loose"))
    k = F.col("patient")
    tr = R.truth(t).where("part = 'PROMO'").join(R.samples(t).select("sample", "patient"), "sample").groupBy("patient").agg(
        F.when(k % 10 != 3, F.round(F.avg("value"), 11)).alias("purity"))
    std = k % 4 != 0
    right = tr.select(k.alias("pos"), "purity", std.alias("standard"), F.when(std, code("patient", "01A")).otherwise(F.concat(F.lit("F"), k)).alias("strict"),
                      code("patient", "01").alias("alt"))
    rows = cut_lineage(P.purity_samples(fits, codes, cut_lineage(right), "PROMO"))
    each = rows.select("method", "sample", F.col("e").alias("mean_e"), F.col("t").alias("mean_t"), F.col("error").alias("bias"))
    return P.purity_yardstick(rows).unionByName(each, allowMissingColumns=True)


ORDER_SQL = """string_agg(part, '>' ORDER BY v DESC, part)"""


@register("qry05_truth_ordering", "method ordering truth_ordering matches n n_empty", "a_over_b discordant", q("est truth", f"""
    WITH es AS (SELECT method, part, value / nullif(sum(value) OVER (PARTITION BY method, sample), 0) AS s FROM est WHERE part IN ('SMALL', 'LARGE', 'PROMO')),
    ts AS (SELECT part, value / nullif(sum(value) OVER (PARTITION BY sample), 0) AS s FROM truth WHERE part IN ('SMALL', 'LARGE', 'PROMO')),
    eo AS (SELECT method, {ORDER_SQL} AS ordering FROM (SELECT method, part, round(avg(s), 10) AS v FROM es GROUP BY 1, 2) GROUP BY 1),
    tt AS (SELECT {ORDER_SQL} AS truth_ordering FROM (SELECT part, round(avg(s), 10) AS v FROM ts GROUP BY 1)),
    e AS (SELECT method, sample, max(value) FILTER (part = 'LARGE') AS a, max(value) FILTER (part = 'SMALL') AS b, sum(value) AS s FROM est WHERE part IN ('SMALL', 'LARGE', 'PROMO') GROUP BY 1, 2),
    t AS (SELECT sample, max(value) FILTER (part = 'LARGE') AS a, max(value) FILTER (part = 'SMALL') AS b FROM truth GROUP BY 1),
    p AS (SELECT method, count(*) AS n, count(*) FILTER (s <= 0) AS n_empty, avg(CASE WHEN e.a > e.b THEN 1.0 ELSE 0 END) FILTER (s > 0) AS a_over_b,
      avg(CASE WHEN e.a > e.b AND t.b > t.a THEN 1.0 ELSE 0 END) FILTER (s > 0) AS discordant FROM e JOIN t USING (sample) GROUP BY 1)
    SELECT method, ordering, truth_ordering, ordering = truth_ordering AS matches, n, n_empty, a_over_b, discordant FROM eo JOIN p USING (method), tt"""))
def _(t):
    return P.truth_ordering(R.estimates(t), R.truth(t), TRIO, "LARGE", "SMALL")


TRACK = """rw AS (SELECT method, part, patient, round(avg(e), 9) AS e, round(avg(t), 9) AS t FROM et JOIN smp USING (sample) GROUP BY 1, 2, 3)"""


@register("qry06_tracking", "method part n", "rho p_value low_rho high_rho", q("et smp", f"""
    WITH {TRACK}, g AS (SELECT *, concat(method, part) AS mp FROM rw), gx AS (SELECT mp, patient, e AS x, t AS y FROM g),
    {perm_spearman_sql('gx', 'mp', 'patient', DRAWS, 'trk')}, mp AS (SELECT DISTINCT mp, method, part FROM g),
    pv AS (SELECT mp, (count(*) FILTER (abs(p) >= abs(s) - 1e-9 * norm) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM z JOIN o USING (mp) GROUP BY 1),
    ed AS (SELECT mp, list_sort(list_distinct(quantile_cont(t, [0, 1/3.0, 2/3.0, 1]))) AS edges FROM g GROUP BY 1),
    bn AS (SELECT g.mp, e, t, greatest(len(list_filter(edges, lambda y: y < t)) - 1, 0) AS bin FROM g JOIN ed USING (mp)),
    st AS (SELECT mp, bin, {corr_sql('r_e', 'r_t')} AS rho FROM {ranks_sql('bn', 'mp, bin', 'e t')} GROUP BY 1, 2)
    SELECT method, part, n, s / norm AS rho, p_value, (SELECT rho FROM st WHERE st.mp = o.mp AND bin = 0) AS low_rho,
    (SELECT arg_max(rho, bin) FROM st WHERE st.mp = o.mp) AS high_rho FROM o JOIN pv USING (mp) JOIN mp USING (mp)"""))
def _(t):
    rows = aligned(t, beside=R.samples(t).select("sample", F.col("patient").alias("unit")), dealt="unit")
    rows = rows.groupBy("method", "part", "unit").agg(F.round(F.avg("e"), 9).alias("e"), F.round(F.avg("t"), 9).alias("t"))
    whole, strata = P.tracking(rows, DRAWS, "trk")
    ends = strata.groupBy("method", "part").agg(F.max(F.when(F.col("bin") == 0, F.col("rho"))).alias("low_rho"),
                                                F.max_by("rho", "bin").alias("high_rho"))
    return whole.join(ends, ["method", "part"])


@register("qry07_evaluation_grid", "method truth n status", "value", q("et smp", f"""
    WITH x AS (SELECT method, structure AS truth, round(e, 9) AS e, t FROM et JOIN smp USING (sample) WHERE part = 'LARGE' AND NOT (method = 'net' AND structure = '5-LOW') AND NOT (method = 'control' AND structure = '2-HIGH')),
    r AS (SELECT method, truth, count(*) AS n, CASE WHEN count(*) >= 10 THEN {corr_sql('r_e', 'r_t')} END AS value FROM {ranks_sql('x', 'method, truth', 'e t')} GROUP BY 1, 2)
    SELECT m.method, s.truth, n, CASE WHEN value IS NOT NULL THEN 'measured' WHEN m.method = 'control' THEN 'explained' ELSE 'GAP' END AS status, value
    FROM (SELECT unnest(['price', 'lines', 'net', 'control']) AS method) m CROSS JOIN (SELECT DISTINCT structure AS truth FROM smp) s LEFT JOIN r ON r.method = m.method AND r.truth = s.truth"""))
def _(t):
    skip = ((F.col("method") == "net") & (F.col("truth") == "5-LOW")) | ((F.col("method") == "control") & (F.col("truth") == "2-HIGH"))
    et = aligned(t).where("part = 'LARGE'").join(R.samples(t).select("sample", F.col("structure").alias("truth")), "sample").where(~skip).withColumn("e", F.round("e", 9))
    truths = R.samples(t).select(F.col("structure").alias("truth")).distinct()
    reasons = truths.withColumn("method", F.lit("control")).withColumn("reason", F.lit("control"))
    return P.evaluation_grid(cut_lineage(et), R.estimates(t).select("method").distinct(), truths, reasons)


FACT = """y AS (SELECT method, sample, avg(abs(e - t)) AS err FROM et GROUP BY 1, 2),
    j AS (SELECT method, o_custkey % 2 AS cohort, err, o_totalprice AS total, CAST(date_diff('day', DATE '1995-01-01', o_orderdate) AS DOUBLE) AS age FROM y JOIN orders ON o_orderkey = sample)"""


@register("qry08_error_factors", "factor same_direction verdict", "beta_1 beta_2 p", q("et", f"""
    WITH {FACT}, b AS (SELECT cohort, method, 'total' AS factor, {beta_sql('total', 'age', 'err')} AS beta FROM j GROUP BY 1, 2 UNION ALL SELECT cohort, method, 'age', {beta_sql('age', 'total', 'err')} FROM j GROUP BY 1, 2),
    m AS (SELECT cohort, factor, quantile_cont(beta, 0.5) AS beta, count(*) AS nm, count(*) FILTER (beta > 0) AS up FROM b GROUP BY 1, 2),
    p AS (SELECT *, greatest(up, nm - up) AS na, least(1, 2 * CASE least(up, nm - up) WHEN 0 THEN 1 / 16.0 WHEN 1 THEN 5 / 16.0 ELSE 11 / 16.0 END) AS p FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p, factor) AS i, count(*) OVER (PARTITION BY cohort) AS k FROM p),
    h AS (SELECT *, max(least(1, (k - i + 1) * p)) OVER (PARTITION BY cohort ORDER BY i ROWS UNBOUNDED PRECEDING) AS hp FROM r)
    SELECT a.factor, sign(a.beta) = sign(c.beta) AND sign(a.beta) <> 0 AS same_direction, a.beta AS beta_1, c.beta AS beta_2, c.hp AS p, CASE WHEN a.na >= 0.75 * a.nm THEN CASE WHEN sign(a.beta) = sign(c.beta) THEN
      CASE WHEN c.na >= 0.75 * c.nm AND c.hp < 0.05 THEN 'REPLICATED' WHEN c.na >= 0.75 * c.nm THEN 'direction agrees, not significant' ELSE 'direction agrees, inconsistent' END ELSE 'REVERSED' END
      WHEN c.hp < 0.05 AND c.na >= 0.75 * c.nm THEN 'null first, SUPPORTED second' ELSE 'null in both' END AS verdict
    FROM h a JOIN h c ON a.factor = c.factor AND a.cohort = 0 AND c.cohort = 1"""))
def _(t):
    y = aligned(t).groupBy("method", "sample").agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("err"))
    f = t.orders.select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 2).alias("cohort"), F.col("o_totalprice").alias("total"),
                        F.date_diff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("age"))
    return P.error_factors(y.join(f, "sample"), ["total", "age"], "err")


@register("qry09_group_score_factors", "method n", "rho p_value holm_p", q("verdict", f"""
    WITH ow AS (SELECT method, tumour, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS s FROM verdict GROUP BY 1, 2),
    {null_sql(DRAWS, 'grp', 'method, tumour')}, nm AS (SELECT method, tumour, avg(s) AS nu FROM ns GROUP BY 1, 2),
    pr AS (SELECT c_nationkey AS tumour, round(avg(c_acctbal), 6) AS prop FROM customer GROUP BY 1),
    pm2 AS (SELECT method, tumour, round(s - nu, 9) AS x, prop AS y FROM ow JOIN nm USING (method, tumour) JOIN pr USING (tumour)),
    {perm_spearman_sql('pm2', 'method', 'tumour', DRAWS, 'grp')},
    f AS (SELECT method, max(o.n) AS n, max(s / norm) AS rho, (count(*) FILTER (abs(p) >= abs(s) - 1e-9 * norm) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM z JOIN o USING (method) GROUP BY 1),
    h AS (SELECT *, row_number() OVER (ORDER BY p_value, method) AS i, count(*) OVER () AS k FROM f)
    SELECT method, n, rho, p_value, max(least(1, (k - i + 1) * p_value)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS holm_p FROM h"""))
def _(t):
    prop = t.customer.groupBy(F.col("c_nationkey").alias("tumour")).agg(F.round(F.avg("c_acctbal"), 6).alias("property"))
    return P.group_score_factors(R.estimates(t), R.samples(t), terms(t), prop, DRAWS, "grp", digits=10, who=WHO)


@register("qry10_marker_constraint_check", "id n_draws", "observed null_mean p_value", q("truth smp con", f"""
    WITH m0 AS (SELECT 0 AS draw, tumour, structure, part, round(avg(value), 10) AS v FROM truth JOIN smp USING (sample) GROUP BY ALL
      UNION ALL SELECT draw, p.tumour, p.structure, part, round(avg(value), 10) FROM truth JOIN {perm_sql('smp', 'tumour', 'structure', 'sample', DRAWS, 'ish')} p USING (sample) GROUP BY 1, 2, 3, 4),
    v AS ({verdict_sql('m0', 'draw, tumour')}), r AS (SELECT draw, id, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS rate FROM v WHERE ok IS NOT NULL GROUP BY 1, 2)
    SELECT a.id, count(*) AS n_draws, max(o.rate) AS observed, avg(a.rate) AS null_mean, (count(*) FILTER (a.rate >= o.rate - 1e-9) + 1) / (count(*) + 1)::DOUBLE AS p_value
    FROM r a JOIN r o ON o.id = a.id AND o.draw = 0 AND a.draw > 0 GROUP BY 1"""))
def _(t):
    return P.marker_check(R.truth(t), R.samples(t), terms(t), DRAWS, "ish", digits=10)


SETTINGS = """sv AS (SELECT part, sample, CASE method WHEN 'price' THEN 0 WHEN 'lines' THEN 1 ELSE 2 END AS setting, e AS v FROM et WHERE method <> 'control'
      UNION ALL SELECT part, sample, 3, floor(e * 20) FROM et WHERE method = 'price' UNION ALL SELECT part, sample, 4, e FROM et WHERE method = 'price'
      UNION ALL SELECT part, sample, 5, CASE WHEN part = 'SMALL' THEN 0 ELSE e END FROM et WHERE method = 'control'),
    tw AS (SELECT a.setting, min(b.setting) AS twin FROM (SELECT setting, list(v ORDER BY part, sample) AS l FROM sv GROUP BY 1) a
      JOIN (SELECT setting, list(v ORDER BY part, sample) AS l FROM sv GROUP BY 1) b ON a.l = b.l GROUP BY 1),
    sk AS MATERIALIZED (SELECT part, setting, sample, rank() OVER (PARTITION BY part, setting ORDER BY v) + (count(*) OVER (PARTITION BY part, setting, v) - 1) / 2.0 AS r
      FROM sv JOIN tw USING (setting) WHERE setting = twin AND v IS NOT NULL),
    sc AS (SELECT a.part, a.setting AS s1, b.setting AS s2, count(*) AS n, covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0) AS rho
      FROM sk a JOIN sk b ON a.part = b.part AND a.sample = b.sample AND a.setting < b.setting GROUP BY ALL),
    st AS (SELECT part, len(list_distinct(flatten(list([s1, s2]) FILTER (rho IS NOT NULL)))) AS n_settings, avg(rho) AS stability FROM sc GROUP BY 1)"""


@register("qry11_identifiability", "part n_orderings n_settings", "agreement truth_rho p_one_sided stability", q("et", f"""
    WITH {SETTINGS}, pr AS (SELECT a.part, {corr_sql('a.e', 'b.e')} AS r FROM et a JOIN et b ON a.sample = b.sample AND a.part = b.part AND a.method < b.method GROUP BY a.part, a.method, b.method),
    ag AS (SELECT part, round(avg(r), 9) AS agreement FROM pr GROUP BY 1),
    tr AS (SELECT part, round(quantile_cont(rho, 0.5), 9) AS truth_rho FROM (SELECT method, part, {corr_sql('r_e', 'r_t')} AS rho FROM {ranks_sql('et', 'method, part', 'e t')} GROUP BY 1, 2) GROUP BY 1),
    un AS (SELECT 1 AS k, * FROM ag JOIN tr USING (part)), rk AS {ranks_sql('un', 'k', 'agreement truth_rho')},
    l AS (SELECT list(r_agreement::DOUBLE - 3.5 ORDER BY part) AS a, list(r_truth_rho::DOUBLE - 3.5 ORDER BY part) AS b FROM rk),
    pe AS (SELECT [a, b, c, d, e, f] AS p FROM range(1, 7) ta(a), range(1, 7) tb(b), range(1, 7) tc(c), range(1, 7) td(d), range(1, 7) te(e), range(1, 7) tf(f) WHERE len(list_distinct([a, b, c, d, e, f])) = 6),
    z AS (SELECT count(*) AS n_orderings, avg(CASE WHEN list_dot_product(a, [b[i] for i in p]) >= list_dot_product(a, b) - 1e-9 THEN 1.0 ELSE 0 END) AS p_one_sided FROM l, pe)
    SELECT part, n_orderings, n_settings, agreement, truth_rho, p_one_sided, stability FROM un JOIN st USING (part), z"""))
def _(t):
    """Agreement of methods and stability of six settings (one repeats another, one is constant in a part) beside the truth."""
    v = F.col("value")
    one = lambda i, m, c: F.when(F.col("method") == m, F.struct(F.lit(i).alias("setting"), c.alias("v")))
    settings = F.array(one(0, "price", v), one(1, "lines", v), one(2, "net", v), one(3, "price", F.floor(v * 20).cast("double")), one(4, "price", v),
                       one(5, "control", F.when(F.col("part") == "SMALL", 0.0).otherwise(v)))
    with scratch(t.spark) as keep:
        est = keep(R.estimates(t))
        stable = cut_lineage(P.setting_stability(est.select("part", "sample", F.inline(F.array_compact(settings))), "setting", ["sample"], "v"))
    # Made again, as the shares of a sample lie together then: neither their grid nor the truth's join deals them.
    units, test = P.identifiability(R.estimates(t), R.truth(t), R.METHODS)
    return units.withColumn("_t", test.select(F.struct("n_orderings", "p_one_sided")).scalar()).select("part", "agreement", "truth_rho", "_t.*").join(
        stable.select("part", "n_settings", "stability"), "part")


@register("qry12_reference_sensitivity", "part rank_old rank_new change status", "delta", fit_sql("fsig bulk", f"""
    WITH {SIG_B}, fa2 AS (SELECT * FROM fsig WHERE feature <> 'Brand#3'), fb2 AS (SELECT * FROM fb WHERE feature <> 'Brand#3'),
    {nnls_ctes('xa', 'fa2', 'bulk', 6)}, {nnls_ctes('xb', 'fb2', 'bulk', 6)},
    la AS (SELECT part, round(avg(v), 9) AS score FROM (SELECT part, value / nullif(sum(value) OVER (PARTITION BY sample), 0) AS v FROM xa) GROUP BY 1),
    lb AS (SELECT part, round(avg(v), 9) AS score FROM (SELECT part, value / nullif(sum(value) OVER (PARTITION BY sample), 0) AS v FROM xb) GROUP BY 1),
    ra AS (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM la), rb AS (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM lb)
    SELECT part, ra.r AS rank_old, rb.r AS rank_new, ra.r - rb.r AS change, CASE WHEN ra.r = rb.r THEN 'same' ELSE 'moved' END AS status, rb.score - ra.score AS delta FROM ra JOIN rb USING (part)"""))
def _(t):
    sig, bulk = problem(t)
    other = cut_lineage(second_reference(sig).where("feature <> 'Brand#3'"))
    return P.reference_sensitivity(bulk, sig, other, PARTS).withColumnRenamed("method", "part")


@register("qry13_atlas_counts", "pooled_a pooled_b n_donors n_a_over_b reading", "p_value", q("cells", """
    WITH n AS (SELECT donor, count(*) FILTER (part = 'L3') AS na, count(*) FILTER (part = 'L5') AS nb FROM cells GROUP BY 1),
    g AS (SELECT CAST(sum(na) AS BIGINT) AS pooled_a, CAST(sum(nb) AS BIGINT) AS pooled_b, count(*) FILTER (na <> nb) AS n_donors, count(*) FILTER (na > nb) AS n_a_over_b FROM n)
    SELECT *, CASE WHEN pooled_a > pooled_b AND n_a_over_b * 2 > n_donors THEN 'CONFIRMED' WHEN pooled_a <= pooled_b AND n_a_over_b * 2 <= n_donors THEN 'NOT CONFIRMED' ELSE 'INCONCLUSIVE' END AS reading,
    least(1, 2 * list_sum([CAST(factorial(CAST(n_donors AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n_donors - i AS INTEGER)) AS DOUBLE) / pow(2.0, n_donors)
      for i in range(0, least(n_a_over_b, n_donors - n_a_over_b) + 1)])) AS p_value FROM g"""))
def _(t):
    return P.atlas_counts(R.cells(t), "L3", "L5")


@register("qry14_reproduction_report", "artefact status n accounted", "", f"""
    WITH d AS (SELECT 'tab/' || coalesce(a.o_custkey, b.o_custkey) % 4 AS artefact, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'lost' WHEN a.o_totalprice = b.o_totalprice THEN 'reproduced'
      WHEN abs(a.o_totalprice - b.o_totalprice) / greatest(1, abs(a.o_totalprice)) <= 1e-9 THEN 'noise' ELSE 'changed' END AS status
      FROM orders a FULL JOIN ({NEW_ORDERS}) b ON a.o_orderkey = b.o_orderkey)
    SELECT artefact, status, count(*) AS n, status IN ('reproduced', 'noise') OR regexp_matches(artefact, '/[12]$') AS accounted FROM d GROUP BY 1, 2""")
def _(t):
    old = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    d = D.keyed_diff(old.select("o_orderkey", "o_custkey", "o_totalprice"), new_orders(t), ["o_orderkey"], ["o_totalprice"], 1e-9)
    cust = old.select("o_orderkey", "o_custkey").unionByName(new_orders(t).select("o_orderkey", "o_custkey")).distinct()
    d = d.join(cust, "o_orderkey").withColumn("artefact", F.concat(F.lit("tab/"), (F.col("o_custkey") % 4).cast("string")))
    why = t.spark.createDataFrame([("/[12]$", "prices were revised")], "pattern STRING, why STRING")
    return L.reproduction(d, why)


@register("qry16_method_comparability", "method reason comparable", "", q("est", """
    WITH m AS (SELECT DISTINCT method || part AS method, method AS m, part FROM est), dg AS (SELECT method || part AS method FROM est WHERE value > 0.999 GROUP BY method, part HAVING count(*) > 60)
    SELECT m.method, CASE WHEN m = 'control' THEN 'requires a real estimate' WHEN dg.method IS NOT NULL THEN 'observed degenerate in this run' WHEN part = 'SMALL' THEN 'failed in this run' END AS reason,
    NOT (m = 'control' OR dg.method IS NOT NULL OR part = 'SMALL') AS comparable FROM m LEFT JOIN dg USING (method)"""))
def _(t):
    est = R.estimates(t).select(F.concat("method", "part").alias("method"), F.col("method").alias("m"), "part", "value")
    roster = est.select("method", "m", "part").distinct()
    need = roster.where("m = 'control'").withColumn("reason", F.lit("requires a real estimate"))
    bad = est.where("value > 0.999").groupBy("method").agg(F.count("*").alias("k")).where("k > 60")
    return P.method_comparability(roster, need, bad, roster.where("part = 'SMALL'"))


