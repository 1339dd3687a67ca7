"""Permutation and bootstrap jobs on the driver's tables; the SQL makes the same md5 draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.aggregates import scored, verdict_table
from partwise.catalog.columns import aligned
from partwise.catalog.registry import register
from partwise.catalog.roles import h32, q, verdict_sql
from partwise.catalog.statistics import corr_sql, pair_values, ranks_sql
from partwise.operators import auc_null as AN
from partwise.operators import permute as PM
from partwise.operators import resample as RS
from partwise.operators import score as S
from partwise.session import cut_lineage

DRAWS = 1000
WHO = [(m,) for m in R.METHODS]


def draws_sql(n: int) -> str:
    return f"(SELECT unnest(range(1, {n + 1})) AS draw)"


def moved_sql(rel: str) -> str:
    """``x`` of rel (x, size, key and more) moved by the keyed bijection of operators.permute, round by round."""
    p, word = PM.PRIME, PM.WORD
    for a, b in PM.round_numbers():
        sq = lambda c: f"((key * {c[0]} + {c[1]}) % {p}) * ((key * {c[0]} + {c[1]}) % {p}) % {p}"
        rel = f"""(SELECT * EXCLUDE (y, u) REPLACE (CASE WHEN ((xor(u, u >> 15) * {PM.MIX[1]}) & {word}) >> 31 = 1 THEN y ELSE x END AS x) FROM
          (SELECT *, (((greatest(x, y) + {sq((b, a))}) & {word}) * {PM.MIX[0]}) & {word} AS u FROM
            (SELECT *, ({sq((a, b))} % size - x + size) % size AS y FROM {rel})))"""
    return rel


def perm_sql(rel: str, groups: str, label: str, ident: str, n: int, seed: str) -> str:
    """(draw, ident, groups, label) with labels shuffled inside groups."""
    part = f"PARTITION BY {groups}" if groups else ""
    gcols = f"{groups}, " if groups else ""
    using = f"({groups}, x)" if groups else "(x)"
    key = h32(f"'{seed}'", "draw", *groups.split(", ")) if groups else h32(f"'{seed}'", "draw")
    rows = f"""(SELECT {gcols}{ident}, row_number() OVER ({part} ORDER BY {h32(f"'{seed}'", "'base'", ident)}, {ident}) - 1 AS x,
        count(*) OVER ({part}) AS size FROM {rel} WHERE {label} IS NOT NULL)"""
    keys = f"(SELECT *, {key} % {PM.PRIME} AS key FROM (SELECT DISTINCT {groups or '1 AS one'} FROM {rel}), {draws_sql(n)})"
    return f"""(SELECT draw, {gcols}{ident}, {label} FROM {moved_sql(f"(SELECT r.*, draw, key FROM {rows} r JOIN {keys} k {f'USING ({groups})' if groups else 'ON true'})")}
      JOIN (SELECT {gcols}{label}, row_number() OVER ({part} ORDER BY {label}) - 1 AS x FROM {rel} WHERE {label} IS NOT NULL) USING {using})"""


def boot_sql(rel: str, ident: str, n: int, seed: str) -> str:
    """(draw, ident, times): units of rel drawn with replacement."""
    return f"""(SELECT draw, {ident}, count(*) AS times FROM (SELECT d.draw, {h32(f"'{seed}'", 'd.draw', 'i')} % n AS i
      FROM (SELECT row_number() OVER (ORDER BY {h32("'index'", ident)}, {ident}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {ident} FROM {rel})) s, {draws_sql(n)} d) p
      JOIN (SELECT {ident}, row_number() OVER (ORDER BY {h32("'index'", ident)}, {ident}) - 1 AS i FROM (SELECT DISTINCT {ident} FROM {rel})) u USING (i) GROUP BY ALL)"""


OBS = """obs AS (SELECT method, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS s FROM verdict GROUP BY 1)"""


@register("res01_within_group_label_permutation", "method n_draws", "observed null_mean p_value", q("verdict", f"""
    WITH {OBS}, p AS {perm_sql('smp', 'tumour', 'structure', 'sample', DRAWS, 'perm')},
    pm AS (SELECT method, draw, p.tumour, p.structure, part, round(avg(value), 10) AS v FROM est JOIN p USING (sample) GROUP BY ALL),
    nv AS ({verdict_sql('pm', 'method, draw, tumour')}),
    ns AS (SELECT method, draw, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS s FROM nv WHERE ok IS NOT NULL GROUP BY 1, 2)
    SELECT method, count(*) AS n_draws, max(obs.s) AS observed, avg(ns.s) AS null_mean, (count(*) FILTER (ns.s >= obs.s - 1e-9) + 1) / (count(*) + 1)::DOUBLE AS p_value
    FROM ns JOIN obs USING (method) GROUP BY 1"""))
def _(t):
    terms = S.constraint_terms(t.spark, R.CONSTRAINTS)
    return PM.null_p(RS.scores_by_draw(R.estimates(t), R.samples(t), terms, DRAWS, "perm", digits=10, who=WHO), ["method"], "score")


@register("res02_cluster_bootstrap", "method n_units", "mean ci_low median ci_high", q("verdict", f"""
    WITH u AS (SELECT method, tumour, sum(CASE WHEN ok THEN weight ELSE 0 END) AS num, sum(weight) AS den FROM verdict GROUP BY 1, 2),
    b AS {boot_sql('u', 'tumour', 1000, 'boot')},
    s AS (SELECT method, draw, sum(num * times) / sum(den * times) AS s FROM u JOIN b USING (tumour) GROUP BY 1, 2)
    SELECT method, (SELECT count(DISTINCT tumour) FROM u) AS n_units, avg(s) AS mean, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.5) AS median,
    quantile_cont(s, 0.975) AS ci_high FROM s GROUP BY 1"""))
def _(t):
    w = cut_lineage(S.weigh(verdict_table(t), ["method", "tumour"]))
    return RS.cluster_bootstrap(w, ["method"], "tumour", 1000, "boot")


@register("res03_bootstrap_rho", "n_usable", "mean ci_low median ci_high", q("et", f"""
    WITH sc AS (SELECT method || part AS m, round(avg(abs(e - t)), 9) AS x, round(avg(e), 9) AS y FROM et GROUP BY ALL),
    b AS {boot_sql('sc', 'm', 2000, 'rho')}, j AS (SELECT draw, x, y FROM sc JOIN b USING (m), unnest(range(times)) AS _t(k)),
    r AS (SELECT draw, {corr_sql('r_x', 'r_y')} AS rho FROM {ranks_sql('j', 'draw', 'x y')} GROUP BY 1)
    SELECT count(rho) AS n_usable, avg(rho) AS mean, quantile_cont(rho, 0.025) AS ci_low, quantile_cont(rho, 0.5) AS median, quantile_cont(rho, 0.975) AS ci_high FROM r"""))
def _(t):
    err = F.abs(F.col("e") - F.col("t"))
    sc = aligned(t).groupBy(F.concat("method", "part").alias("m")).agg(F.round(F.avg(err), 9).alias("x"), F.round(F.avg("e"), 9).alias("y"))
    return RS.bootstrap_rho(cut_lineage(sc), [], "m", "x", "y", 2000, "rho")


@register("res04_paired_bootstrap_ties", "method tied", "mae delta ci_low ci_high", q("et smp", f"""
    WITH g AS (SELECT method, tumour AS grp, avg(abs(e - t)) AS mae FROM et JOIN smp USING (sample) GROUP BY 1, 2), p AS (SELECT method, avg(mae) AS mae FROM g GROUP BY 1),
    best AS (SELECT method AS bm, mae AS bmae FROM p ORDER BY mae, method LIMIT 1), b AS {boot_sql('g', 'grp', 2000, 'ties')},
    d AS (SELECT draw, method, avg(mae) AS m FROM g JOIN b USING (grp) GROUP BY 1, 2),
    x AS (SELECT d.method, d.m - r.m AS delta FROM d JOIN best ON true JOIN d r ON r.draw = d.draw AND r.method = bm),
    c AS (SELECT method, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high FROM x GROUP BY 1)
    SELECT method, ci_low <= 0 AND ci_high >= 0 AS tied, mae, mae - bmae AS delta, ci_low, ci_high FROM p JOIN c USING (method), best"""))
def _(t):
    err = scored(t).groupBy("method", "group").agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("mae"))
    return RS.paired_ties(cut_lineage(err), 2000, "ties")


PATIENT_MEANS = """pm AS (SELECT method, part, patient, round(avg(e), 9) AS x, round(avg(t), 9) AS y FROM et JOIN smp USING (sample) GROUP BY ALL)"""


def patient_means(t):
    rows = aligned(t, beside=R.samples(t).select("sample", "patient"), dealt="patient")
    return rows.groupBy("method", "part", "patient").agg(F.round(F.avg("e"), 9).alias("x"), F.round(F.avg("t"), 9).alias("y"))


def perm_spearman_sql(rel: str, keys: str, ident: str, draws: int, seed: str) -> str:
    """o (keys, n, norm, s) and z (keys, draw, p) of rel (keys, ident, x, y); keys of one size share their shuffles."""
    return f"""r AS {ranks_sql(rel, keys, 'x y')}, nn AS (SELECT {keys}, count(*) AS n FROM {rel} GROUP BY ALL),
    c AS (SELECT {keys}, n AS size, r_x - (n + 1) / 2.0 AS a, r_y - (n + 1) / 2.0 AS b,
      row_number() OVER (PARTITION BY {keys} ORDER BY {h32(f"'{seed}'", "'base'", ident)}, {ident}) - 1 AS x FROM r JOIN nn USING ({keys})),
    o AS (SELECT {keys}, count(*) AS n, sqrt(sum(a * a) * sum(b * b)) AS norm, sum(a * b) AS s FROM c GROUP BY {keys}),
    sh AS MATERIALIZED (SELECT draw, size, at0, x FROM {moved_sql(f"""(SELECT draw, size, at0, at0 AS x, {h32(f"'{seed}'", "draw")} % {PM.PRIME} AS key
      FROM (SELECT size, unnest(range(size)) AS at0 FROM (SELECT DISTINCT size FROM c)), {draws_sql(draws)})""")}),
    z AS (SELECT {keys}, draw, sum(c.a * d.b) AS p FROM c JOIN sh ON sh.size = c.size AND sh.at0 = c.x
      JOIN (SELECT {keys}, x, b FROM c) d USING ({keys}) WHERE d.x = sh.x GROUP BY ALL)"""


@register("res05_permutation_spearman", "method part n", "rho p_value", q("et smp", f"""
    WITH {PATIENT_MEANS}, {perm_spearman_sql('pm', 'method, part', 'patient', DRAWS, 'track')}
    SELECT method, part, max(n) AS n, max(s / norm) AS rho, (count(*) FILTER (abs(p) >= abs(s) - 1e-9 * norm) + 1) / (count(*) + 1)::DOUBLE AS p_value
    FROM z JOIN o USING (method, part) GROUP BY ALL"""))
def _(t):
    return RS.permutation_spearman(patient_means(t), ["method", "part"], "patient", "x", "y", DRAWS, "track")


PERMS6 = """pr AS (SELECT [a, b, c, d, e, f] AS p FROM range(1, 7) ta(a), range(1, 7) tb(b), range(1, 7) tc(c), range(1, 7) td(d), range(1, 7) te(e), range(1, 7) tf(f)
    WHERE len(list_distinct([a, b, c, d, e, f])) = 6)"""


@register("res06_exact_permutation", "method n n_orderings", "p_one_sided p_two_sided", q("et", f"""
    WITH x AS (SELECT method, part, round(avg(e), 9) AS x, round(avg(t), 9) AS y FROM et GROUP BY 1, 2), r AS {ranks_sql('x', 'method', 'x y')},
    u AS (SELECT method, list(r_x::DOUBLE - 3.5 ORDER BY part) AS a, list(r_y::DOUBLE - 3.5 ORDER BY part) AS b FROM r GROUP BY 1), {PERMS6},
    z AS (SELECT method, list_dot_product(a, b) AS o, list_dot_product(a, [b[i] for i in p]) AS d FROM u, pr)
    SELECT method, CAST(6 AS INTEGER) AS n, count(*) AS n_orderings, avg(CASE WHEN d >= o - 1e-9 THEN 1.0 ELSE 0 END) AS p_one_sided,
    avg(CASE WHEN abs(d) >= abs(o) - 1e-9 THEN 1.0 ELSE 0 END) AS p_two_sided FROM z GROUP BY 1"""))
def _(t):
    x = aligned(t).groupBy("method", "part").agg(F.round(F.avg("e"), 9).alias("x"), F.round(F.avg("t"), 9).alias("y"))
    return RS.exact_permutation(cut_lineage(x), ["method"], "part", "x", "y", 6)


@register("res07_auc_permutation", "method n_draws", "observed null_mean p_value", q("est smp", f"""
    WITH c0(id, weight, part, least, pair, hi, lo) AS (VALUES {pair_values()}), c AS (SELECT *, row_number() OVER () AS k FROM c0),
    p AS MATERIALIZED (SELECT draw, sample, structure FROM {perm_sql('smp', 'tumour', 'structure', 'sample', DRAWS, 'auc')} UNION ALL SELECT 0, sample, structure FROM smp),
    v AS MATERIALIZED (SELECT sample, part, ((CASE method {" ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(R.METHODS))} END * 64 + tumour)::BIGINT << 36)
      + dense_rank() OVER (PARTITION BY method, part, tumour ORDER BY value) AS code FROM est JOIN smp USING (sample) WHERE value IS NOT NULL),
    -- One number holds method, tumour, draw, pair and rank, as there is a row for each of them.
    g AS (SELECT ((code >> 36) << 36) + (draw::BIGINT << 24) + (k::BIGINT << 20) + (code & 1048575) AS spot, count(*) FILTER (structure = hi) AS h, count(*) FILTER (structure = lo) AS l
      FROM v JOIN p USING (sample) JOIN c ON c.part = v.part AND structure IN (hi, lo) GROUP BY 1),
    rw AS (SELECT spot >> 20 AS cell, h, l, sum(l) OVER (PARTITION BY spot >> 20 ORDER BY spot) - l AS below FROM g),
    a AS (SELECT cell, sum(h * (below + 0.5 * l)) / (sum(h) * sum(l)) AS auc FROM rw GROUP BY cell HAVING sum(h) > 0 AND sum(l) > 0),
    t AS (SELECT cell >> 22 AS m, (cell >> 4) & 4095 AS draw, weight, avg(auc) AS auc FROM a JOIN c ON k = cell & 15 GROUP BY cell >> 16, m, (cell >> 4) & 4095, id, weight, least HAVING count(*) >= least),
    s AS (SELECT CASE m {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(R.METHODS))} END AS method, draw, sum(weight * auc) / sum(weight) AS auc FROM t GROUP BY 1, 2)
    SELECT n.method, count(*) AS n_draws, max(o.auc) AS observed, avg(n.auc) AS null_mean, (count(*) FILTER (n.auc >= o.auc - 1e-9) + 1) / (count(*) + 1)::DOUBLE AS p_value
    FROM s n JOIN s o ON n.method = o.method AND o.draw = 0 AND n.draw > 0 GROUP BY 1"""))
def _(t):
    return PM.null_p(AN.auc_draws(R.estimates(t), R.samples(t), R.CONSTRAINTS, DRAWS, "auc"), ["method"], "stat")


@register("res08_block_label_permutation", "part n_draws n_labelled", "observed null_mean p_value", q("truth smp", f"""
    WITH bs AS (SELECT sample, tumour, concat(tumour, '#', patient % 2) AS tb, CASE WHEN sample % 10 <> 0 THEN structure END AS structure FROM smp WHERE sample IN (SELECT sample FROM truth)),
    p AS {perm_sql('bs', 'tb', 'structure', 'sample', DRAWS, 'block')},
    x AS (SELECT 0 AS draw, sample, tb, structure FROM bs WHERE structure IS NOT NULL UNION ALL SELECT draw, sample, tb, structure FROM p),
    m AS (SELECT draw, part, tb, round(avg(value) FILTER (structure = '3-MEDIUM'), 10) AS hi, round(avg(value) FILTER (structure = '1-URGENT'), 10) AS lo FROM x JOIN truth USING (sample) GROUP BY ALL),
    d AS (SELECT draw, part, split_part(tb, '#', 1) AS tumour, avg(CASE WHEN hi > lo THEN 1.0 ELSE 0 END) AS r FROM m WHERE hi IS NOT NULL AND lo IS NOT NULL GROUP BY ALL),
    s AS (SELECT draw, part, avg(r) AS r FROM d GROUP BY 1, 2)
    SELECT n.part, count(*) AS n_draws, (SELECT count(structure) FROM bs) AS n_labelled, max(o.r) AS observed, avg(n.r) AS null_mean, (count(*) FILTER (n.r >= o.r - 1e-9) + 1) / (count(*) + 1)::DOUBLE AS p_value
    FROM s n JOIN s o ON o.part = n.part AND o.draw = 0 AND n.draw > 0 GROUP BY 1"""))
def _(t):
    """Every tenth sample has no label: it takes no part, as in a study whose blocks are not all annotated."""
    smp = cut_lineage(R.samples(t).join(R.truth(t).select("sample").distinct(), "sample", "left_semi").select(
        "sample", F.concat_ws("#", "tumour", F.col("patient") % 2).alias("tb"), F.when(F.col("sample") % 10 != 0, F.col("structure")).alias("structure")))
    columns = [(p,) for p in R.PARTS]
    placed = PM.place(smp, ["tb"], "structure", "sample", "block")
    sums = PM.permuted_sums(placed.join(PM.widened(R.truth(t), ["part"], columns, "sample"), "sample"), ["tb"], len(columns), DRAWS, "block")
    means = PM.permuted_means(sums, ["tb"], ["part"], columns, ["string"], digits=10)
    of = lambda s: F.max(F.when(F.col("label") == s, F.col("v")))
    m = means.groupBy("part", "draw", "tb").agg(of("3-MEDIUM").alias("hi"), of("1-URGENT").alias("lo")).where("hi IS NOT NULL AND lo IS NOT NULL")
    donor = m.groupBy("part", "draw", F.substring_index("tb", "#", 1).alias("tumour")).agg(F.avg((F.col("hi") > F.col("lo")).cast("double")).alias("r"))
    null = PM.null_p(donor.groupBy("part", "draw").agg(F.avg("r").alias("stat")), ["part"], "stat")
    return null.withColumn("n_labelled", smp.agg(F.count("structure")).scalar())


@register("res09_two_sample_permutation", "part n_draws", "observed null_mean p_value", q("truth smp", f"""
    WITH b AS (SELECT sample, structure = '1-URGENT' AS flag FROM smp WHERE sample IN (SELECT sample FROM truth)), p AS {perm_sql('b', '', 'flag', 'sample', DRAWS, 'two')},
    x AS (SELECT 0 AS draw, part, flag, value FROM truth JOIN b USING (sample) UNION ALL SELECT draw, part, flag, value FROM truth JOIN p USING (sample)),
    s AS (SELECT draw, part, avg(value) FILTER (flag) - avg(value) FILTER (NOT flag) AS d FROM x GROUP BY 1, 2)
    SELECT n.part, count(*) AS n_draws, max(o.d) AS observed, avg(n.d) AS null_mean, (count(*) FILTER (n.d >= o.d - 1e-9) + 1) / (count(*) + 1)::DOUBLE AS p_value
    FROM s n JOIN s o ON o.part = n.part AND o.draw = 0 AND n.draw > 0 GROUP BY 1"""))
def _(t):
    rows = R.truth(t).join(R.samples(t).select("sample", (F.col("structure") == "1-URGENT").alias("flag")), "sample")
    return RS.mean_difference_null(rows, [], "flag", "sample", "value", DRAWS, "two", ["part"])


DIFF_SQL = """df AS (SELECT concat_ws('/', method, part) AS mp, patient, avg(e - t) AS d FROM et JOIN smp USING (sample) GROUP BY 1, 2)"""


def patient_differences(t):
    rows = aligned(t).join(R.samples(t).select("sample", "patient"), "sample")
    return rows.groupBy(F.concat_ws("/", "method", "part").alias("mp"), "patient").agg(F.avg(F.col("e") - F.col("t")).alias("d"))


@register("res10_sign_flip_test", "mp n_draws", "observed null_mean p_value", q("et smp", f"""
    WITH {DIFF_SQL}, o AS (SELECT mp, avg(d) AS s FROM df GROUP BY 1),
    n AS (SELECT mp, draw, avg(CASE WHEN {h32("'flip'", "draw", "patient")} % 2 = 0 THEN abs(d) ELSE -abs(d) END) AS s FROM df, {draws_sql(1000)} GROUP BY 1, 2)
    SELECT mp, count(*) AS n_draws, max(o.s) AS observed, avg(n.s) AS null_mean, count(*) FILTER (n.s >= o.s - 1e-9) / count(*)::DOUBLE AS p_value
    FROM n JOIN o USING (mp) GROUP BY 1"""))
def _(t):
    return RS.sign_flip(cut_lineage(patient_differences(t)), ["mp"], "patient", "d", 1000, "flip")


@register("res11_argmax_permutation", "method structure n_max", "observed share", q("m", f"""
    WITH c AS (SELECT method, tumour, structure, v, concat_ws('#', tumour, structure) AS cell FROM m WHERE part = 'LARGE'),
    l AS (SELECT DISTINCT tumour, structure, cell FROM c), p AS {perm_sql('l', 'tumour', 'structure', 'cell', 1000, 'arg')},
    x AS (SELECT method, draw, p.structure, round(avg(v), 10) AS a FROM c JOIN p USING (cell) GROUP BY ALL),
    top AS (SELECT method, draw, first(structure ORDER BY a DESC, structure) AS structure FROM x GROUP BY 1, 2)
    SELECT o.method, o.structure, count(top.draw) AS n_max, max(o.a) AS observed, count(top.draw) / 1000.0::DOUBLE AS share
    FROM (SELECT method, structure, avg(v) AS a FROM c GROUP BY 1, 2) o LEFT JOIN top ON top.method = o.method AND top.structure = o.structure GROUP BY 1, 2"""))
def _(t):
    means = S.group_means(R.estimates(t), R.samples(t), digits=10).where("part = 'LARGE'").drop("part")
    return RS.argmax_null(cut_lineage(means), ["method"], "tumour", "structure", "v", 1000, "arg")


@register("res12_paired_bootstrap_difference", "mp n", "mean ci_low ci_high p_value", q("et smp", f"""
    WITH {DIFF_SQL}, b AS {boot_sql('df', 'patient', DRAWS, 'diff')}, s AS (SELECT mp, draw, sum(d * times) / sum(times) AS s FROM df JOIN b USING (patient) GROUP BY 1, 2),
    c AS (SELECT mp, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high,
      2 * least(avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN s >= 0 THEN 1.0 ELSE 0 END)) AS p_value FROM s GROUP BY 1)
    SELECT mp, n, mean, ci_low, ci_high, p_value FROM c JOIN (SELECT mp, count(*) AS n, avg(d) AS mean FROM df GROUP BY 1) USING (mp)"""))
def _(t):
    return RS.paired_difference(cut_lineage(patient_differences(t)), ["mp"], "patient", "d", DRAWS, "diff")


def control_number_sql(place: int) -> str:
    x = f"(((k * a) % 2147483647 + b + {place * RS.CONTROL_STEP}) & 2147483647)"
    return f"({x})"


def control_sql() -> str:
    """cm(generator, draw, tumour, structure, part, v): the controls of resample.control_means."""
    n = len(R.PARTS)
    cols = lambda f: ", ".join(f(i) + f" AS x{i}" for i in range(n))
    rel = f"SELECT draw, tumour, structure, {cols(control_number_sql)} FROM ck, cd"
    for shift, times in RS.CONTROL_MIX:
        rel = f"SELECT draw, tumour, structure, {cols(lambda i: f'(xor(x{i}, x{i} >> {shift}) * {times}) & 2147483647')} FROM ({rel})"  # noqa: B023
    rel = f"SELECT draw, tumour, structure, {cols(lambda i: f'(xor(x{i}, x{i} >> 16) + 1) / 2147483648.0::DOUBLE')} FROM ({rel})"
    weights = {"uniform": "x{i}", "dirichlet": "-ln(x{i})", "spiked": "x{i} * x{i} * x{i} * x{i}"}
    total = lambda w: " + ".join(f"({w.format(i=i)})" for i in range(n))
    shown = [p for p in R.PARTS if any(c[2] == p for c in R.CONSTRAINTS)]
    sums = ", ".join(f"avg(({w.format(i=R.PARTS.index(p))}) / t_{g}) AS {g}_{p}" for g, w in weights.items() for p in shown)
    rel = f"SELECT draw, tumour, structure, {sums} FROM (SELECT *, {', '.join(f'{total(w)} AS t_{g}' for g, w in weights.items())} FROM ({rel})) GROUP BY ALL"
    flat = " UNION ALL ".join(f"SELECT '{g}' AS generator, draw, tumour, structure, '{p}' AS part, round({g}_{p}, 10) AS v FROM cw" for g in weights for p in shown)
    return f"""ck AS (SELECT tumour, structure, {h32("'band'", "sample")} & 2147483647 AS k FROM smp),
    cd AS (SELECT draw, ({h32("'band'", "'a'", "draw")} & 2147483647) % 2147483646 + 1 AS a, {h32("'band'", "'b'", "draw")} & 2147483647 AS b FROM {draws_sql(DRAWS)}),
    cw AS MATERIALIZED ({rel}), cm AS ({flat})"""


@register("res13_control_band", "generator method hardest indistinguishable", "observed percentile mean sd p05 p95", q("verdict", f"""
    WITH {OBS}, {control_sql()}, cv AS ({verdict_sql('cm', 'generator, draw, tumour')}),
    cs AS (SELECT generator, draw, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS s FROM cv WHERE ok IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT generator, avg(s) AS mean, stddev_samp(s) AS sd, quantile_cont(s, 0.05) AS p05, quantile_cont(s, 0.95) AS p95 FROM cs GROUP BY 1),
    hd AS (SELECT generator AS top FROM b ORDER BY round(p95, 12) DESC, round(mean, 12) DESC, generator DESC LIMIT 1),
    pl AS (SELECT generator, method, avg(CASE WHEN cs.s <= obs.s + 1e-12 THEN 1.0 ELSE 0 END) AS percentile FROM cs, obs GROUP BY 1, 2)
    SELECT generator, method, generator = top AS hardest, obs.s <= p95 AS indistinguishable, obs.s AS observed, percentile, mean, sd, p05, p95
    FROM b JOIN pl USING (generator) JOIN obs USING (method), hd"""))
def _(t):
    """Three generators on the same numbers; a method must clear the hardest of them."""
    terms = S.constraint_terms(t.spark, R.CONSTRAINTS)
    shown = [p for p in R.PARTS if any(c[2] == p for c in R.CONSTRAINTS)]
    means = RS.control_means(R.samples(t), R.PARTS, shown, DRAWS, "band", digits=10)
    scores = S.weigh(S.verdicts(means, terms, ["generator", "draw", "tumour"]), ["generator", "draw"]).selectExpr("generator", "draw", "num / den AS score")
    return RS.hardest_control(cut_lineage(RS.control_band(cut_lineage(scores), S.score(verdict_table(t)), ["generator"])))


ENS_SQL = f"""lv AS (SELECT method, part, tumour, structure, concat_ws('#', tumour, structure) AS unit, avg(e) AS v, avg(t) AS t FROM et JOIN smp USING (sample) GROUP BY ALL),
    cc AS (SELECT a.part, a.method AS m1, b.method AS m2, {corr_sql('a.v', 'b.v')} AS r FROM lv a JOIN lv b ON a.part = b.part AND a.unit = b.unit AND a.method < b.method GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY r DESC, m1, m2) AS best FROM cc WHERE r IS NOT NULL),
    pk AS (SELECT part, 0 AS draw, m1, m2 FROM rk WHERE best <= 2 UNION ALL SELECT part, draw, m1, m2 FROM (SELECT part, draw, m1, m2, row_number() OVER (PARTITION BY part, draw
      ORDER BY {h32("'ens'", "draw", "m1", "m2")}, m1, m2) AS k FROM rk, {draws_sql(DRAWS)}) WHERE k <= 2),
    wt AS (SELECT part, draw, method, 0.25 * count(*) AS w FROM (SELECT part, draw, m1 AS method FROM pk UNION ALL SELECT part, draw, m2 FROM pk) GROUP BY ALL),
    en AS (SELECT part, draw, unit, round(sum(w * v)::DOUBLE, 9) AS ens, round(max(t), 9) AS t FROM lv JOIN wt USING (part, method) GROUP BY ALL),
    rho AS (SELECT part, draw, {corr_sql('r_ens', 'r_t')} AS rho FROM {ranks_sql('en', 'part, draw', 'ens t')} GROUP BY ALL),
    chosen AS (SELECT part, unit, ens AS x, t AS y FROM en WHERE draw = 0),
    ce AS (SELECT part, method, round(avg(r), 9) AS c FROM (SELECT part, m1 AS method, r FROM cc UNION ALL SELECT part, m2, r FROM cc) GROUP BY ALL),
    ow AS (SELECT part, method, round({corr_sql('r_v', 'r_t')}, 9) AS o FROM {ranks_sql('lv', 'part, method', 'v t')} GROUP BY ALL),
    co AS (SELECT * FROM ce JOIN ow USING (part, method)),
    cr AS (SELECT part, {corr_sql('r_c', 'r_o')} AS centrality_rho FROM {ranks_sql('co', 'part', 'c o')} GROUP BY 1)"""


@register("res14_random_pair_null", "part n_draws beats_median", "observed null_median null_percentile p_shuffled centrality_rho", q("et smp", f"""
    WITH {ENS_SQL}, {perm_spearman_sql('chosen', 'part', 'unit', DRAWS, 'ens')}, ob AS (SELECT part, rho AS ob FROM rho WHERE draw = 0),
    nl AS (SELECT part, count(*) AS n_draws, max(ob) AS observed, quantile_cont(rho, 0.5) AS null_median, avg(CASE WHEN rho < ob - 1e-12 THEN 1.0 ELSE 0 END) AS null_percentile
      FROM rho JOIN ob USING (part) WHERE draw > 0 AND rho IS NOT NULL GROUP BY 1),
    sp AS (SELECT part, (count(*) FILTER (abs(p) >= abs(s) - 1e-9 * norm) + 1) / (count(*) + 1)::DOUBLE AS p_shuffled FROM z JOIN o USING (part) GROUP BY 1)
    SELECT part, n_draws, observed > null_median AS beats_median, observed, null_median, null_percentile, p_shuffled, centrality_rho FROM nl JOIN sp USING (part) JOIN cr USING (part)"""))
def _(t):
    from partwise.operators import ensembles as E

    cells = cut_lineage(scored(t).groupBy("method", "part", "group", "structure").agg(F.avg("e").alias("value"), F.avg("t").alias("t")))
    unit = ["group", "structure"]
    null = E.random_pair_null(cells, R.METHODS, unit, DRAWS, "ens", ["part"])
    return null.join(E.centrality_vs_truth(cells, R.METHODS, unit, ["part"]).select("part", F.col("rho").alias("centrality_rho")), "part")


@register("res17_mixture_from_cells", "mixture part feature", "share amount_share value", q("expr cells", f"""
    WITH tg AS (SELECT mixture, mixture % 8 AS donor, part, 1 + {h32("'tgt'", "mixture", "part")} % 5 AS n FROM (SELECT DISTINCT vec_id // 10 AS mixture FROM embeddings), (SELECT DISTINCT part FROM cells)),
    ix AS (SELECT donor, part, cell, row_number() OVER (PARTITION BY donor, part ORDER BY cell) - 1 AS i, count(*) OVER (PARTITION BY donor, part) AS pool FROM cells),
    sl AS (SELECT mixture, tg.donor, tg.part, {h32("'mix'", "mixture", "tg.part", "slot")} % pool AS i FROM tg JOIN (SELECT DISTINCT donor, part, pool FROM ix) p ON p.donor = tg.donor AND p.part = tg.part,
      unnest(range(1, n + 1)) AS _s(slot)),
    ch AS (SELECT mixture, part, cell FROM sl JOIN ix USING (donor, part, i)), c AS (SELECT mixture, part, count(*) AS k FROM ch GROUP BY 1, 2),
    mx AS (SELECT mixture, feature, sum(value) AS v FROM ch JOIN expr USING (cell) GROUP BY 1, 2), l AS (SELECT mixture, sum(v) AS l FROM mx GROUP BY 1)
    SELECT mixture, part, NULL::INT AS feature, k / sum(k) OVER (PARTITION BY mixture) AS share, a / sum(a) OVER (PARTITION BY mixture) AS amount_share, NULL::DOUBLE AS value
    FROM c JOIN (SELECT mixture, part, sum(total) AS a FROM ch JOIN (SELECT cell, sum(value) * (1 + cell % 3) AS total FROM expr GROUP BY cell) USING (cell) GROUP BY 1, 2) USING (mixture, part)
    UNION ALL SELECT mixture, NULL, feature, NULL, NULL, v / l * 1e6 FROM mx JOIN l USING (mixture)"""))
def _(t):
    """Both truths of every mixture, then all its features; the cells' amounts differ between cells of one part."""
    totals = R.cell_expr(t).groupBy("cell").agg((F.sum("value") * (1 + F.col("cell") % 3)).alias("total"))
    mix, truth = mixture_tables(t, totals)
    return truth.withColumn("feature", F.lit(None).cast("int")).unionByName(mix, allowMissingColumns=True)


def mixture_tables(t, totals=None):
    from partwise.functions.draws import hash32

    mixes = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("mixture")).distinct()
    parts = R.cells(t).agg(F.collect_set("part")).scalar()
    targets = mixes.withColumn("part", F.explode(parts)).select(
        "mixture", (F.col("mixture") % 8).alias("donor"), "part", (1 + hash32(F.lit("tgt"), "mixture", "part") % 5).alias("n"))
    return RS.mixtures(R.cell_expr(t), R.cells(t), targets, "mix", totals=totals)


@register("res18_row_bootstrap_units", "n_usable", "mean ci_low median ci_high", q("et smp", f"""
    WITH pm AS (SELECT method, part, patient, avg(e) AS x, avg(t) AS y FROM et JOIN smp USING (sample) GROUP BY ALL), b AS {boot_sql('pm', 'patient', 200, 'rows')},
    j AS (SELECT draw, method, part, sum(times) AS n, sum(times * x) AS sx, sum(times * y) AS sy, sum(times * x * x) AS sxx, sum(times * y * y) AS syy, sum(times * x * y) AS sxy
      FROM pm JOIN b USING (patient) GROUP BY ALL),
    u AS (SELECT draw, method || part AS u, round((sxy - sx * sy / n) / nullif(sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 0), 9) AS r, round(sx / n, 9) AS level FROM j),
    s AS (SELECT draw, {corr_sql('r_r', 'r_level')} AS rho FROM {ranks_sql('u', 'draw', 'r level')} GROUP BY 1)
    SELECT count(rho) AS n_usable, avg(rho) AS mean, quantile_cont(rho, 0.025) AS ci_low, quantile_cont(rho, 0.5) AS median, quantile_cont(rho, 0.975) AS ci_high FROM s"""))
def _(t):
    rows = aligned(t).join(R.samples(t).select("sample", "patient"), "sample").groupBy("method", "part", "patient").agg(
        F.avg("e").alias("x"), F.avg("t").alias("y"))
    from partwise.operators import ensembles as E

    return RS.interval(E.row_bootstrap(cut_lineage(rows), ["method", "part"], "patient", "x", "y", 200, "rows"), [], "rho")
