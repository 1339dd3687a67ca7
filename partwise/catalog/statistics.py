"""Correlations, rank tests and regressions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.aggregates import scored
from partwise.catalog.columns import SPAN, aligned, follow_up, valid_follow_up
from partwise.catalog.registry import register
from partwise.catalog.roles import q
from partwise.operators import stats as ST


def ranks_sql(rel: str, keys: str, cols: str) -> str:
    """A relation with average ranks r_<c> of the columns inside keys."""
    out = ", ".join(
        f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0 AS r_{c}"
        for c in cols.split())
    return f"(SELECT *, {out} FROM {rel})"


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def tail_sql(z: str) -> str:
    """The same two-sided normal tail as functions.guards.normal_tail."""
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2)))"
    poly = f"({coef[-1]}::DOUBLE)"
    for c in reversed(coef[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"least({t} * exp(-{z} * {z} / 2 + {poly}), 1)"


@register("agg17_spearman", "method part n", "rho", q("et", f"""
    SELECT method, part, count(*) AS n, CASE WHEN count(*) >= 50 THEN {corr_sql('r_e', 'r_t')} END AS rho
    FROM {ranks_sql('et', 'method, part', 'e t')} GROUP BY ALL"""))
def _(t):
    return ST.spearman(aligned(t), ["method", "part"], "e", "t", min_n=50)


@register("agg18_pearson", "method n", "r", q("et", f"SELECT method, count(*) AS n, {corr_sql('e', 't')} AS r FROM et GROUP BY 1"))
def _(t):
    return ST.pearson_by(aligned(t), ["method"], "e", "t")


@register("agg19_kendall_tau", "method n", "tau", q("et smp", """
    WITH g AS (SELECT method, tumour, structure, round(avg(e), 8) AS x, round(avg(t), 8) AS y FROM et JOIN smp USING (sample) WHERE part = 'PROMO' GROUP BY ALL),
    p AS (SELECT a.method, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (a.x <> b.x) AS nx, count(*) FILTER (a.y <> b.y) AS ny
      FROM g a JOIN g b ON a.method = b.method AND (a.tumour, a.structure) < (b.tumour, b.structure) GROUP BY 1)
    SELECT method, n, s / nullif(sqrt(nx) * sqrt(ny), 0) AS tau FROM p JOIN (SELECT method, count(*) AS n FROM g GROUP BY 1) USING (method)"""))
def _(t):
    means = scored(t).where("part = 'PROMO'").groupBy("method", "group", "structure").agg(
        F.round(F.avg("e"), 8).alias("x"), F.round(F.avg("t"), 8).alias("y"))
    return ST.kendall(means, ["method"], "x", "y")


FACTOR_SQL = """f AS (SELECT o_orderkey AS sample, o_totalprice AS total, CAST(date_diff('day', DATE '1995-01-01', o_orderdate) AS DOUBLE) AS age FROM orders),
    y AS (SELECT method, sample, avg(abs(e - t)) AS err FROM et GROUP BY ALL), j AS (SELECT * FROM y JOIN f USING (sample))"""


def error_factors(t):
    f = t.orders.select(F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("total"),
                        F.date_diff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("age"))
    y = aligned(t).groupBy("method", "sample").agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("err"))
    return y.join(f, "sample")


def beta_sql(a: str, b: str, y: str) -> str:
    """Standardised slope of y on a with b in the model (population sd)."""
    raw = (f"(covar_pop({a}, {y}) * var_pop({b}) - covar_pop({b}, {y}) * covar_pop({a}, {b})) / "
           f"(var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) ** 2)")
    return f"{raw} * stddev_pop({a})"


ARMS_SQL = """f AS (SELECT o_orderkey AS sample, o_totalprice AS total, CAST(date_diff('day', DATE '1995-01-01', o_orderdate) AS DOUBLE) AS age FROM orders),
    y AS (SELECT method, 'all' AS part, 'absolute' AS arm, sample, avg(abs(e - t)) AS err FROM et GROUP BY ALL
      UNION ALL SELECT method, part, 'absolute', sample, abs(e - t) FROM et UNION ALL SELECT method, part, 'signed', sample, e - t FROM et),
    j AS (SELECT * FROM y JOIN f USING (sample) WHERE err IS NOT NULL)"""


@register("agg22_multi_regression", "method part arm n factor", "intercept beta", q("et", f"""
    WITH {ARMS_SQL} SELECT method, part, arm, count(*) AS n, 'total' AS factor, avg(err) AS intercept, {beta_sql('total', 'age', 'err')} AS beta FROM j GROUP BY 1, 2, 3
    UNION ALL SELECT method, part, arm, count(*) AS n, 'age' AS factor, avg(err) AS intercept, {beta_sql('age', 'total', 'err')} AS beta FROM j GROUP BY 1, 2, 3"""))
def _(t):
    """Absolute error over all parts, and absolute and signed error of each part: over all parts the signed ones cancel."""
    f = t.orders.select(F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("total"),
                        F.date_diff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("age"))
    return ST.error_arms(aligned(t, beside=f), None, ["total", "age"])


SIGN_SQL = """s AS (SELECT part, tumour, avg(e) > avg(t) AS up FROM et JOIN smp USING (sample) WHERE method = 'price' GROUP BY 1, 2),
    k AS (SELECT part, count(*) AS n, count(*) FILTER (up) AS k FROM s GROUP BY 1)"""


@register("agg23_sign_test", "part n k", "p_value", q("et smp", f"""
    WITH {SIGN_SQL} SELECT part, n, k, least(1, 2 * list_sum([
      CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n - i AS INTEGER)) AS DOUBLE) / pow(2.0, n)
      for i in range(0, least(k, n - k) + 1)])) AS p_value FROM k"""))
def _(t):
    per = scored(t, "price").groupBy("part", "group").agg(F.avg("e").alias("e"), F.avg("t").alias("t"))
    return ST.sign_test(per, ["part"], F.col("e") > F.col("t"))


@register("agg24_holm_adjust", "part tumour", "p holm_p", q("truth smp", """
    WITH a AS (SELECT part, tumour, pow(avg(value), 2) AS p FROM truth JOIN smp USING (sample) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY p, tumour) AS i, count(*) OVER (PARTITION BY part) AS m FROM a)
    SELECT part, tumour, p, max(least(1, (m - i + 1) * p)) OVER (PARTITION BY part ORDER BY i ROWS UNBOUNDED PRECEDING) AS holm_p FROM r"""))
def _(t):
    a = R.truth(t).join(R.samples(t), "sample").groupBy("part", "tumour").agg(F.pow(F.avg("value"), 2).alias("p"))
    return ST.holm(a, ["part"], "p", "tumour")


@register("agg25_partial_spearman", "method n", "partial_rho", q("et", f"""
    WITH x AS (SELECT method, e, t, o_totalprice AS z FROM et JOIN orders ON o_orderkey = sample WHERE part = 'LARGE'),
    c AS (SELECT method, count(*) AS n, {corr_sql('r_e', 'r_t')} AS xy, {corr_sql('r_e', 'r_z')} AS xz, {corr_sql('r_t', 'r_z')} AS yz
      FROM {ranks_sql('x', 'method', 'e t z')} GROUP BY 1)
    SELECT method, n, (xy - xz * yz) / nullif(sqrt((1 - xz ** 2) * (1 - yz ** 2)), 0) AS partial_rho FROM c"""))
def _(t):
    z = t.orders.select(F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("z"))
    x = aligned(t).where("part = 'LARGE'").join(z, "sample")
    return ST.partial_spearman(x, ["method"], "e", "t", "z")


@register("agg26_rank_sum_test", "family n1 n2 exact", "u p_value p_greater auc", f"""
    WITH RECURSIVE d AS (SELECT quality, source, toxic = 1 AS g, n_chars AS v FROM labels JOIN documents USING (doc_id)),
    x AS (SELECT concat('quality ', quality) AS family, g, v FROM d UNION ALL SELECT concat('source ', source), g, v FROM d),
    r AS {ranks_sql('x', 'family', 'v')},
    s AS (SELECT family, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, coalesce(sum(r_v) FILTER (g), 0) AS rs FROM r GROUP BY 1),
    ties AS (SELECT family, sum(c * c * c - c) AS t FROM (SELECT family, v, count(*)::DOUBLE AS c FROM x GROUP BY 1, 2) GROUP BY 1),
    u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, least(n1, n2) <= 8 AND t = 0 AND n1 * n2 <= 10000 AS exact FROM s JOIN ties USING (family)),
    ways(n, m, i, c, s, w) AS (SELECT n1 + n2, least(n1, n2), 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::DOUBLE FROM u WHERE exact GROUP BY 1, 2
      UNION ALL SELECT n, m, i + 1, c + k, s + k * (i + 1), sum(w) FROM ways, (VALUES (0), (1)) AS k(k) WHERE i < n AND c + k <= m GROUP BY ALL),
    law AS (SELECT n, m, s - m * (m + 1) / 2 AS us, w / sum(w) OVER (PARTITION BY n, m) AS p FROM ways WHERE i = n AND c = m),
    pe AS (SELECT family, sum(p) FILTER (us >= greatest(u, n1 * n2 - u) - 1e-9) AS far, sum(p) FILTER (us >= u - 1e-9) AS up
      FROM u JOIN law ON exact AND n = n1 + n2 AND m = least(n1, n2) GROUP BY 1),
    z AS (SELECT *, u - n1 * n2 / 2.0 AS off, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)::DOUBLE))) AS sd FROM u LEFT JOIN pe USING (family)),
    zz AS (SELECT *, greatest(abs(off) - 0.5, 0) / nullif(sd, 0) AS z, (off - 0.5) / nullif(sd, 0) AS zu FROM z)
    SELECT family, n1, n2, exact, u, CASE WHEN n1 > 0 AND n2 > 0 THEN CASE WHEN exact THEN least(1, 2 * far) ELSE {tail_sql('z')} END END AS p_value,
    CASE WHEN n1 > 0 AND n2 > 0 THEN CASE WHEN exact THEN up WHEN zu >= 0 THEN {tail_sql('zu')} / 2 ELSE 1 - {tail_sql('zu')} / 2 END END AS p_greater,
    u / nullif(n1 * n2, 0)::DOUBLE AS auc FROM zz""")
def _(t):
    """Toxic against clean lengths per quality (large groups) and per source (small ones, exact if without ties)."""
    x = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    names = F.array(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.concat(F.lit("source "), F.col("source")))
    x = x.select(F.explode(names).alias("family"), (F.col("toxic") == 1).alias("g"), F.col("n_chars").alias("v"))
    return ST.rank_sum(x, ["family"], "g", "v")


def pair_values() -> str:
    """SQL rows (id, weight, part, least, pair, hi, lo) of the constraints, written out by kind."""
    out = []
    for ident, kind, part, structures, among, weight in R.CONSTRAINTS:
        others = [s for s in among if s != structures[0]]
        sides = {"pairwise": [structures[:2]], "maximum": [[structures[0], s] for s in others],
                 "monotone": [[structures[i + 1], structures[i]] for i in range(len(structures) - 1)]}[kind]
        need = {"pairwise": 1, "maximum": 2, "monotone": len(sides)}[kind]
        out += [f"('{ident}', {weight}::DOUBLE, '{part}', {need}, {i}, '{h}', '{lo}')" for i, (h, lo) in enumerate(sides)]
    return ", ".join(out)


@register("agg27_pair_auc", "method n_pairs", "auc auc_strict tie_share", q("est smp", f"""
    WITH c(id, weight, part, least, pair, hi, lo) AS (VALUES {pair_values()}), x AS (SELECT * FROM est JOIN smp USING (sample) WHERE value IS NOT NULL),
    p AS (SELECT h.method, h.tumour, id, weight, least, pair, avg((h.value > l.value)::INT) AS gt, avg((h.value = l.value)::INT) AS eq
      FROM c JOIN x h ON h.part = c.part AND h.structure = hi JOIN x l ON l.part = c.part AND l.structure = lo AND l.method = h.method AND l.tumour = h.tumour
      GROUP BY ALL),
    t AS (SELECT method, tumour, id, weight, avg(gt) AS gt, avg(eq) AS eq FROM p GROUP BY method, tumour, id, weight, least HAVING count(*) >= least)
    SELECT method, count(*) AS n_pairs, sum(weight * (gt + 0.5 * eq)) / sum(weight) AS auc, sum(weight * gt) / sum(weight) AS auc_strict,
      sum(weight * eq) / sum(weight) AS tie_share FROM t GROUP BY 1"""))
def _(t):
    rows = R.estimates(t, beside=R.samples(t).select("sample", "tumour", "structure")).select("method", "tumour", "structure", "part", "value")
    return ST.constraint_auc(rows, ST.constraint_pairs(t.spark, R.CONSTRAINTS), ["method"])


@register("agg28_concordance_index", "segment", "comparable concordant tied c_index", f"""
    WITH x AS (SELECT c_mktsegment AS segment, patient, time, event, round(c_acctbal, -2) AS risk FROM ({SPAN}) JOIN customer ON c_custkey = patient
      WHERE event IS NOT NULL AND time > 0)
    SELECT *, (concordant + 0.5 * tied) / nullif(comparable, 0)::DOUBLE AS c_index FROM (
    SELECT a.segment, count(*) AS comparable, count(*) FILTER (a.risk > b.risk) AS concordant, count(*) FILTER (a.risk = b.risk) AS tied
    FROM x a JOIN x b ON a.segment = b.segment AND a.event = 1 AND (a.time < b.time OR a.time = b.time AND b.event = 0) GROUP BY 1)""")
def _(t):
    x = valid_follow_up(follow_up(t)).join(t.customer, F.col("patient") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("segment"), "time", "event", F.round("c_acctbal", -2).alias("risk"))
    return ST.censored_concordance(x, ["segment"], "time", "event", "risk")
