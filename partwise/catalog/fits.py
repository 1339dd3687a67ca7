"""Batch fits on the driver's tables.

Signature: mean quantity of a brand within a part type, scaled down, plus a
planted marker block (every brand marks one type).  Bulk: the signature times a
customer's mean price shares, times a small hash-made disturbance.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.columns import follow_up, valid_follow_up
from partwise.catalog.registry import register
from partwise.catalog.roles import PARTS, h32, q
from partwise.catalog.statistics import corr_sql, ranks_sql
from partwise.functions.draws import unit
from partwise.operators import fit as FT
from partwise.operators import keys as K
from partwise.operators import profiles as P
from partwise.operators import resample as RS
from partwise.operators import stats as ST
from partwise.operators import windows as W
from partwise.session import cut_lineage

MARK = "CASE WHEN CAST(regexp_extract(feature, '([0-9]+)', 1) AS INTEGER) % 6 = {i} THEN 10 ELSE 0 END"
_BLOCK = "CASE part " + " ".join(
    f"WHEN '{p}' THEN {MARK.format(i=i)}" for i, p in enumerate(PARTS)) + " END"
R.CTES["fsig"] = ("sig", f"SELECT feature, part, round(mean / 10 + {_BLOCK}, 6) AS mean FROM sig")
R.CTES["share"] = ("est smp", """SELECT patient AS sample, part, avg(value) AS value FROM est JOIN smp USING (sample)
    WHERE method = 'price' GROUP BY 1, 2""")
R.CTES["bulk"] = ("fsig share", f"""SELECT feature, sample, sum(mean * value) * (0.9 + 0.2 * ({h32("'noise'", "feature", "sample")} + 1) / 4294967296.0::DOUBLE) AS value
    FROM fsig JOIN share USING (part) GROUP BY feature, sample""")


def planted(t):
    n = F.regexp_extract("feature", r"([0-9]+)", 1).cast("int") % 6
    mark = F.lit(0)
    for i, p in enumerate(PARTS):
        mark = F.when((F.col("part") == p) & (n == i), 10).otherwise(mark)
    return R.signature(t).select("feature", "part", F.round(F.col("mean") / 10 + mark, 6).alias("mean"))


def shares(t):
    return R.estimates(t, "price", beside=R.samples(t).select("sample", "patient")).groupBy(
        F.col("patient").alias("sample"), "part").agg(F.avg("value").alias("value"))


def bulk_of(sig, share):
    raw = K.matrix_product(sig, share, ["sample"])
    noise = 0.9 + 0.2 * unit(F.lit("noise"), "feature", "sample")
    return raw.select("feature", "sample", (F.col("fitted") * noise).alias("value"))


def problem(t):
    """(signature, bulk), materialised once: every fit reads them several times."""
    sig = cut_lineage(planted(t))
    return sig, cut_lineage(bulk_of(sig, shares(t)))


def nnls_ctes(name: str, sig: str, bulk: str, k: int, sweeps: int = 60) -> str:
    """SQL: the same least squares by coordinate descent, one coordinate per recursive step."""
    return f"""{name}_p AS (SELECT part, row_number() OVER (ORDER BY part) AS j FROM (SELECT DISTINCT part FROM {sig})),
    {name}_g AS (SELECT list(r ORDER BY i) AS g FROM (SELECT pa.j AS i, list(v ORDER BY pb.j) AS r FROM (SELECT a.part AS p1, b.part AS p2, sum(a.mean * b.mean) AS v FROM {sig} a JOIN {sig} b USING (feature) GROUP BY 1, 2)
      JOIN {name}_p pa ON pa.part = p1 JOIN {name}_p pb ON pb.part = p2 GROUP BY 1)),
    {name}_b AS (SELECT sample, list(v ORDER BY j) AS b FROM (SELECT sample, part, sum(value * mean) AS v FROM {bulk} JOIN {sig} USING (feature) GROUP BY 1, 2) JOIN {name}_p USING (part) GROUP BY 1),
    {name}_cd AS (SELECT sample, b, g, [0.0::DOUBLE for i in range({k})] AS x, 0 AS it FROM {name}_b, {name}_g
      UNION ALL SELECT sample, b, g, [CASE WHEN j = it % {k} + 1 THEN greatest(0, x[j] + (b[j] - list_dot_product(g[j], x)) / g[j][j]) ELSE x[j] END for j in range(1, {k + 1})], it + 1
      FROM {name}_cd WHERE it < {k * sweeps}),
    {name} AS (SELECT sample, part, x[j] AS value FROM {name}_cd, {name}_p WHERE it = {k * sweeps})"""


def fit_sql(needs: str, body: str) -> str:
    return q(needs, body).replace("WITH ", "WITH RECURSIVE ", 1)


@register("fit01_nnls_batch", "sample part", "value", fit_sql("fsig bulk", f"""
    WITH {nnls_ctes('fx', 'fsig', 'bulk', 6)} SELECT sample, part, value FROM fx"""))
def _(t):
    sig, bulk = problem(t)
    return FT.nnls(sig, bulk, PARTS)


@register("fit02_reweighted_nnls", "rule sample part converged", "value")
def _(t):
    sig, bulk = problem(t)
    sig = sig.withColumn("var", F.col("mean") * 0.1)
    return FT.reweighted_fits(sig, bulk, PARTS, FT.REWEIGHTING, rounds=12)


DONOR_SQL = """db AS (SELECT feature, donor, sum(mean * (1 + donor * 0.05)) / 6 AS value FROM fsig, (SELECT unnest(range(8)) AS donor) GROUP BY 1, 2)"""


@register("fit03_assay_moment_match", "sample part", "value", fit_sql("fsig bulk", f"""
    WITH {DONOR_SQL}, r AS (SELECT feature, avg(value) AS rm, stddev_pop(value) AS rs FROM db GROUP BY 1), o AS (SELECT feature, avg(value) AS bm, stddev_pop(value) AS bs FROM bulk GROUP BY 1),
    mb AS (SELECT feature, sample, greatest((value - bm) * CASE WHEN bs > 1e-12 AND rs > 1e-12 THEN rs / bs ELSE 1 END + rm, 0) AS value FROM bulk JOIN o USING (feature) JOIN r USING (feature)),
    {nnls_ctes('fx', 'fsig', 'mb', 6)} SELECT sample, part, value FROM fx"""))
def _(t):
    sig, bulk = problem(t)
    donors = sig.withColumn("donor", F.explode(F.sequence(F.lit(0), F.lit(7)))).groupBy("feature", "donor").agg(
        (F.sum(F.col("mean") * (1 + F.col("donor") * 0.05)) / 6).alias("value"))
    return FT.nnls(sig, FT.moment_match(bulk, donors), PARTS)


@register("fit04_extra_part_column", "sample part", "value", fit_sql("fsig bulk", f"""
    WITH nb AS (SELECT feature, c_nationkey AS sample, avg(value) AS value FROM bulk JOIN customer ON c_custkey = sample GROUP BY 1, 2), ext AS (SELECT feature, part, mean FROM fsig WHERE part <> 'PROMO' UNION ALL SELECT feature, '~other', sum(mean) / 6 * 0.5 FROM fsig GROUP BY 1),
    {nnls_ctes('fx', 'ext', 'nb', 6, 2000)} SELECT sample, part, value FROM fx WHERE part <> '~other'"""))
def _(t):
    sig, bulk = problem(t)
    five = [p for p in PARTS if p != "PROMO"]
    ext = FT.drop_part(FT.with_extra_part(sig, 6, 0.5), "PROMO")
    nation = t.customer.select(F.col("c_custkey").alias("sample"), "c_nationkey")
    bulk = bulk.join(nation, "sample").groupBy("feature", F.col("c_nationkey").alias("sample")).agg(F.avg("value").alias("value"))
    return FT.nnls(ext, bulk, [*five, "~other"]).where("part <> '~other'")


@register("fit05_subset_parts_fit", "sample part", "value", fit_sql("fsig bulk", f"""
    WITH sub AS (SELECT * FROM fsig WHERE part IN ('SMALL', 'LARGE', 'PROMO')), {nnls_ctes('fx', 'sub', 'bulk', 3)}
    SELECT s.sample, r.part, fx.value FROM (SELECT DISTINCT sample FROM bulk) s CROSS JOIN roster r LEFT JOIN fx ON fx.sample = s.sample AND fx.part = r.part"""))
def _(t):
    sig, bulk = problem(t)
    return FT.subset_fit(sig, bulk, ["LARGE", "PROMO", "SMALL"], PARTS)


SIG_B = "fb AS (SELECT feature, part, mean * (0.7 + 0.6 * ({h} + 1) / 4294967296.0::DOUBLE) AS mean FROM fsig)".format(h=h32("'refb'", "feature", "part"))


def third_reference(sig):
    return sig.select("feature", "part", (F.col("mean") * (0.5 + unit(F.lit("refc"), "feature", "part"))).alias("mean"))


def second_reference(sig):
    return sig.withColumn("mean", F.col("mean") * (0.7 + 0.6 * unit(F.lit("refb"), "feature", "part")))


SIG_C = "fc AS (SELECT feature, part, mean * (0.5 + 1.0 * ({h} + 1) / 4294967296.0::DOUBLE) AS mean FROM fsig)".format(h=h32("'refc'", "feature", "part"))


@register("fit06_reference_ensemble", "sample part", "weight_a weight_b weight_c value", fit_sql("fsig bulk", f"""
    WITH {SIG_B}, {SIG_C}, {nnls_ctes('xa', 'fsig', 'bulk', 6)}, {nnls_ctes('xb', 'fb', 'bulk', 6)}, {nnls_ctes('xc', 'fc', 'bulk', 6)},
    ra AS (SELECT feature, sample, sum(mean * value) AS a FROM fsig JOIN xa USING (part) GROUP BY 1, 2), rb AS (SELECT feature, sample, sum(mean * value) AS b FROM fb JOIN xb USING (part) GROUP BY 1, 2),
    rc AS (SELECT feature, sample, sum(mean * value) AS c FROM fc JOIN xc USING (part) GROUP BY 1, 2),
    st AS (SELECT s, u FROM range(11) p(s), range(11) r(u) WHERE s + u <= 10),
    e AS (SELECT s, u, sample, sqrt(sum((value - s / 10.0 * a - u / 10.0 * b - (10 - s - u) / 10.0 * c) ** 2) / sum(value * value)) AS e
      FROM bulk JOIN ra USING (feature, sample) JOIN rb USING (feature, sample) JOIN rc USING (feature, sample), st GROUP BY 1, 2, 3),
    best AS (SELECT s / 10.0::DOUBLE AS wa, u / 10.0::DOUBLE AS wb, (10 - s - u) / 10.0::DOUBLE AS wc FROM (SELECT s, u, round(sum(e), 9) AS e FROM e GROUP BY 1, 2) ORDER BY e, s, u LIMIT 1)
    SELECT sample, part, wa AS weight_a, wb AS weight_b, wc AS weight_c, wa * xa.value + wb * xb.value + wc * xc.value AS value
    FROM xa JOIN xb USING (sample, part) JOIN xc USING (sample, part), best"""))
def _(t):
    sig, bulk = problem(t)
    refs = [sig, cut_lineage(second_reference(sig)), cut_lineage(third_reference(sig))]
    return FT.ensemble(bulk, refs, PARTS).select(
        "sample", "part", *[F.get("weights", F.lit(i)).alias(f"weight_{c}") for i, c in enumerate("abc")], "value")


@register("fit07_batch_adjust", "feature sample", "value", q("bulk", """
    WITH x AS (SELECT feature, sample, sample % 3 AS batch, value + (sample % 3) * 0.7 AS value FROM bulk),
    g AS (SELECT feature, avg(value) AS m, CASE WHEN coalesce(var_samp(value), 0) > 0 THEN var_samp(value) ELSE 1 END AS v FROM x GROUP BY 1),
    z AS (SELECT x.*, m, v, (value - m) / sqrt(v) AS z FROM x JOIN g USING (feature)),
    fb AS (SELECT feature, batch, count(*)::DOUBLE AS n, avg(z) AS gamma, CASE WHEN coalesce(var_samp(z), 0) > 0 THEN var_samp(z) ELSE 1 END AS delta FROM z GROUP BY 1, 2),
    hy AS (SELECT batch, avg(gamma) AS g_bar, var_samp(gamma) AS t2, avg(delta) AS d_bar, var_samp(delta) AS s2 FROM fb GROUP BY 1),
    h AS (SELECT feature, batch, (t2 * n * gamma + delta * g_bar) / (t2 * n + delta) AS gs, (0.5 * n * delta + d_bar * (2 * s2 / d_bar ** 2 + 1)) / (0.5 * n + 2 * s2 / d_bar ** 2 + 1) AS ds FROM fb JOIN hy USING (batch))
    SELECT feature, sample, (z - gs) / sqrt(ds) * sqrt(v) + m AS value FROM z JOIN h USING (feature, batch)"""))
def _(t):
    _, bulk = problem(t)
    x = bulk.withColumn("batch", F.col("sample") % 3).withColumn("value", F.col("value") + F.col("batch") * 0.7)
    return FT.batch_adjust(x)


@register("fit08_control_fits", "control sample part", "value", fit_sql("fsig bulk", f"""
    WITH a AS (SELECT feature, row_number() OVER (ORDER BY {h32("'ctl'", "'from'", "feature")}, feature) AS pos FROM (SELECT DISTINCT feature FROM fsig)),
    b AS (SELECT feature AS target, row_number() OVER (ORDER BY {h32("'ctl'", "'to'", "feature")}, feature) AS pos FROM (SELECT DISTINCT feature FROM fsig)),
    sh AS (SELECT target AS feature, part, mean FROM fsig JOIN a USING (feature) JOIN b USING (pos)), {nnls_ctes('fx', 'sh', 'bulk', 6)},
    u AS (SELECT sample, part, -ln(({h32("'rnd'", "sample", "part")} + 1) / 4294967296.0::DOUBLE) AS u FROM (SELECT DISTINCT sample FROM bulk), roster)
    SELECT 'shuffled' AS control, sample, part, value FROM fx UNION ALL SELECT 'random', sample, part, u / sum(u) OVER (PARTITION BY sample) FROM u"""))
def _(t):
    sig, bulk = problem(t)
    a = FT.nnls(cut_lineage(FT.shuffled_signature(sig, "ctl")), bulk, PARTS).withColumn("control", F.lit("shuffled"))
    b = FT.random_shares(bulk.select("sample").distinct(), PARTS, "rnd").withColumn("control", F.lit("random"))
    return a.unionByName(b)


@register("fit09_variant_reference", "variant part", "mean_value", fit_sql("fsig bulk", f"""
    WITH dp AS (SELECT * FROM fsig WHERE part <> 'SMALL'), mg AS (SELECT feature, part, mean FROM fsig WHERE part NOT IN ('SMALL', 'ECONOMY')
      UNION ALL SELECT feature, 'MERGED', sum(mean * CASE part WHEN 'SMALL' THEN 0.75::DOUBLE ELSE 0.25 END) FROM fsig WHERE part IN ('SMALL', 'ECONOMY') GROUP BY 1),
    {nnls_ctes('xd', 'dp', 'bulk', 5)}, {nnls_ctes('xm', 'mg', 'bulk', 5)}
    SELECT 'drop' AS variant, part, avg(value) AS mean_value FROM xd GROUP BY 2 UNION ALL SELECT 'merge', part, avg(value) FROM xm GROUP BY 2"""))
def _(t):
    sig, bulk = problem(t)
    five = [p for p in PARTS if p != "SMALL"]
    merged = [p for p in PARTS if p not in ("SMALL", "ECONOMY")] + ["MERGED"]
    a = FT.nnls(FT.drop_part(sig, "SMALL"), bulk, five).withColumn("variant", F.lit("drop"))
    b = FT.nnls(FT.merge_parts(sig, {"SMALL": 3.0, "ECONOMY": 1.0}, "MERGED"), bulk, merged).withColumn("variant", F.lit("merge"))
    return a.unionByName(b).groupBy("variant", "part").agg(F.avg("value").alias("mean_value"))


@register("fit10_residual_attribution", "feature", "contribution share", fit_sql("fsig bulk", f"""
    WITH os AS (SELECT * FROM fsig WHERE part NOT IN ('SMALL', 'LARGE')), {nnls_ctes('fx', 'os', 'bulk', 4)},
    ft AS (SELECT feature, sample, sum(mean * value) AS fitted FROM os JOIN fx USING (part) GROUP BY 1, 2),
    rs AS (SELECT feature, sum(greatest(value - coalesce(fitted, 0), 0)) AS r FROM bulk LEFT JOIN ft USING (feature, sample) GROUP BY 1),
    nm AS (SELECT part, sqrt(sum(mean * mean)) AS n FROM fsig GROUP BY 1),
    ln AS (SELECT feature, sum(CASE part WHEN 'SMALL' THEN mean / n ELSE -mean / n END) AS lean FROM fsig JOIN nm USING (part) WHERE part IN ('SMALL', 'LARGE') GROUP BY 1),
    c AS (SELECT feature, r * lean AS contribution FROM rs JOIN ln USING (feature))
    SELECT feature, contribution, contribution / nullif((SELECT sum(greatest(contribution, 0)) FROM c), 0) AS share FROM c ORDER BY contribution DESC, feature LIMIT 10"""))
def _(t):
    sig, bulk = problem(t)
    c = cut_lineage(FT.residual_drivers(sig, bulk, PARTS, "SMALL", "LARGE"))
    return W.top_contributions(c, "feature", "contribution", 10)


@register("fit11_scale_arm_compare", "arm part n", "rho", fit_sql("fsig bulk share", f"""
    WITH ls AS (SELECT feature, part, ln(1 + mean) AS mean FROM fsig), lb AS (SELECT feature, sample, ln(1 + value) AS value FROM bulk),
    {nnls_ctes('xa', 'fsig', 'bulk', 6)}, {nnls_ctes('xb', 'ls', 'lb', 6, 200)},
    j AS (SELECT 'linear' AS arm, part, round(xa.value, 7) AS e, round(share.value, 9) AS t FROM xa JOIN share USING (sample, part)
      UNION ALL SELECT 'log', part, round(xb.value, 7), round(share.value, 9) FROM xb JOIN share USING (sample, part))
    SELECT arm, part, count(*) AS n, {corr_sql('r_e', 'r_t')} AS rho FROM {ranks_sql('j', 'arm, part', 'e t')} GROUP BY 1, 2"""))
def _(t):
    sig, bulk = problem(t)
    truth = shares(t).select("sample", "part", F.round("value", 9).alias("t"))
    lin = FT.nnls(sig, bulk, PARTS).withColumn("arm", F.lit("linear"))
    log = FT.nnls(sig.withColumn("mean", F.log1p("mean")), bulk.withColumn("value", F.log1p("value")), PARTS).withColumn("arm", F.lit("log"))
    j = cut_lineage(lin.unionByName(log).join(truth, ["sample", "part"]).withColumn("e", F.round("value", 7)))
    return ST.spearman(j, ["arm", "part"], "e", "t")


@register("fit12_out_of_fold_risk", "arm n", "comparable c_index")
def _(t):
    people = valid_follow_up(follow_up(t)).join(
        t.customer.select(F.col("c_custkey").alias("patient"), F.col("c_acctbal").alias("balance")), "patient")
    comp = shares(t).where(F.col("part").isin("PROMO", "SMALL")).groupBy(F.col("sample").alias("patient")).pivot(
        "part", ["PROMO", "SMALL"]).agg(F.first("value"))
    folds = P.assign_folds(people.select("patient", F.lit(1).alias("n")), 3, "oof").select("patient", "fold")
    rows = cut_lineage(people.join(comp, "patient").join(folds, "patient").withColumn("balance", F.col("balance") / 1000))
    out = None
    for arm, cov in (("baseline", ["balance"]), ("with_parts", ["balance", "PROMO", "SMALL"])):
        risk = FT.out_of_fold_risk(rows, cov, 3).withColumn("arm", F.lit(arm)).withColumn("risk", F.round("risk", 6))
        out = risk if out is None else out.unionByName(risk)
    out = cut_lineage(out)
    c = ST.censored_concordance(out, ["arm"], "time", "event", "risk")
    return c.join(out.groupBy("arm").agg(F.count("*").alias("n")), "arm")


REMOVED = 3


@register("res15_matched_removal_null", "n_draws", "baseline flagged_removed null_median", fit_sql("fsig bulk", f"""
    WITH pool AS (SELECT DISTINCT feature FROM fsig WHERE feature NOT LIKE '%1%'), rm AS (SELECT draw, feature FROM (SELECT draw, feature,
      row_number() OVER (PARTITION BY draw ORDER BY {h32("'rem'", "draw", "feature")}, feature) AS k FROM pool, (SELECT unnest(range(1, 4)) AS draw)) WHERE k <= 3),
    s0 AS (SELECT * FROM fsig), s9 AS (SELECT * FROM fsig WHERE feature NOT IN ('Brand#1', 'Brand#10', 'Brand#11')),
    s1 AS (SELECT * FROM fsig WHERE feature NOT IN (SELECT feature FROM rm WHERE draw = 1)), s2 AS (SELECT * FROM fsig WHERE feature NOT IN (SELECT feature FROM rm WHERE draw = 2)),
    s3 AS (SELECT * FROM fsig WHERE feature NOT IN (SELECT feature FROM rm WHERE draw = 3)),
    {nnls_ctes('x0', 's0', 'bulk', 6)}, {nnls_ctes('x9', 's9', 'bulk', 6)}, {nnls_ctes('x1', 's1', 'bulk', 6)}, {nnls_ctes('x2', 's2', 'bulk', 6)}, {nnls_ctes('x3', 's3', 'bulk', 6)},
    f AS (SELECT d, avg(CASE WHEN b > a THEN 1.0 ELSE 0 END) AS r FROM (SELECT d, sample, max(round(value, 9)) FILTER (part = 'SMALL') AS a, max(round(value, 9)) FILTER (part = 'LARGE') AS b FROM
      (SELECT 0 AS d, * FROM x0 UNION ALL SELECT 9, * FROM x9 UNION ALL SELECT 1, * FROM x1 UNION ALL SELECT 2, * FROM x2 UNION ALL SELECT 3, * FROM x3) GROUP BY 1, 2) GROUP BY 1)
    SELECT CAST(3 AS BIGINT) AS n_draws, max(r) FILTER (d = 0) AS baseline, max(r) FILTER (d = 9) AS flagged_removed, quantile_cont(r, 0.5) FILTER (d IN (1, 2, 3)) AS null_median FROM f"""))
def _(t):
    sig, bulk = problem(t)
    flagged = sig.where(F.col("feature").isin("Brand#1", "Brand#10", "Brand#11")).select("feature").distinct()
    pool = sig.where(~F.col("feature").contains("1"))
    gone = RS.random_removals(pool, REMOVED, 3, "rem").unionByName(
        flagged.withColumn("draw", F.lit(9)).select("draw", "feature"))
    every = sig.withColumn("draw", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, 3, 9)])))
    sigs = cut_lineage(every.join(gone, ["draw", "feature"], "left_anti"))
    eq = FT.normal_equations(sigs, bulk, PARTS, ["draw", "sample"])
    fit = FT.solve(eq, PARTS, ["draw", "sample"])
    v = F.round("value", 9)
    per = fit.groupBy("draw", "sample").agg(F.max(F.when(F.col("part") == "SMALL", v)).alias("a"), F.max(F.when(F.col("part") == "LARGE", v)).alias("b"))
    rate = per.groupBy("draw").agg(F.avg((F.col("b") > F.col("a")).cast("double")).alias("r"))
    null = F.when(F.col("draw").between(1, 3), F.col("r"))
    return rate.agg(F.count(null).alias("n_draws"), F.max(F.when(F.col("draw") == 0, F.col("r"))).alias("baseline"),
                    F.max(F.when(F.col("draw") == 9, F.col("r"))).alias("flagged_removed"), F.percentile(null, F.lit(0.5)).alias("null_median"))


@register("res16_feature_half_stability", "part n_pairs", "stability", fit_sql("fsig bulk", f"""
    WITH hf AS (SELECT draw, feature FROM (SELECT draw, feature, row_number() OVER (PARTITION BY draw ORDER BY {h32("'half3'", "draw", "feature")}, feature) AS k, count(*) OVER (PARTITION BY draw) AS n
      FROM (SELECT DISTINCT feature FROM fsig), (SELECT unnest(range(1, 4)) AS draw)) WHERE k <= n // 2),
    s1 AS (SELECT * FROM fsig WHERE feature IN (SELECT feature FROM hf WHERE draw = 1)), s2 AS (SELECT * FROM fsig WHERE feature IN (SELECT feature FROM hf WHERE draw = 2)),
    s3 AS (SELECT * FROM fsig WHERE feature IN (SELECT feature FROM hf WHERE draw = 3)),
    {nnls_ctes('x1', 's1', 'bulk', 6, 300)}, {nnls_ctes('x2', 's2', 'bulk', 6, 300)}, {nnls_ctes('x3', 's3', 'bulk', 6, 300)},
    f AS (SELECT part, d, sample, round(value, 6) AS v FROM (SELECT 1 AS d, * FROM x1 UNION ALL SELECT 2, * FROM x2 UNION ALL SELECT 3, * FROM x3)),
    r AS {ranks_sql('f', 'part, d', 'v')}, c AS (SELECT a.part, a.d, b.d AS d2, {corr_sql('a.r_v', 'b.r_v')} AS c FROM r a JOIN r b ON a.part = b.part AND a.sample = b.sample AND a.d < b.d GROUP BY 1, 2, 3)
    SELECT part, count(c) AS n_pairs, avg(c) AS stability FROM c GROUP BY 1"""))
def _(t):
    from partwise.operators.ranks import attach_rank

    sig, bulk = problem(t)
    halves = RS.random_halves(sig, 3, "half3")
    sigs = cut_lineage(sig.join(halves, "feature"))
    fit = FT.solve(FT.normal_equations(sigs, bulk, PARTS, ["draw", "sample"]), PARTS, ["draw", "sample"])
    fit = cut_lineage(fit.withColumn("value", F.round("value", 6)))
    ranked = attach_rank(fit, ["part", "draw"], "value", "_r")
    pairs = ST.method_pair_correlation(ranked.select("part", "sample", F.col("draw").cast("string").alias("method"), F.col("_r").alias("value")),
                                       ["1", "2", "3"], ["part", "sample"], ["part"])
    return pairs.groupBy("part").agg(F.count("r").alias("n_pairs"), F.avg("r").alias("stability"))


