"""Certificates, diffs and tables about the run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.columns import SPAN, aligned, follow_up, valid_follow_up
from partwise.catalog.joins import NEW_ORDERS, new_orders
from partwise.catalog.registry import register
from partwise.catalog.roles import h32, q
from partwise.operators import diff as D
from partwise.operators import ledgers as L
from partwise.operators import stats as ST
from partwise.session import cut_lineage, scratch_dir
from partwise.sources import scans, sinks


@register("agg50_content_hash", "priority n_rows hash_hi hash_lo hash_xor hash_ordered", "", f"""
    SELECT priority, count(*) AS n_rows, CAST(sum(h >> 16) AS BIGINT) AS hash_hi, CAST(sum(h & 65535) AS BIGINT) AS hash_lo, bit_xor(h) AS hash_xor,
    CAST(list_reduce(list(h % {D.ORDER_PRIME} ORDER BY day, id), lambda a, x: (a * {D.ORDER_BASE} + x) % {D.ORDER_PRIME}) AS BIGINT) AS hash_ordered FROM
    (SELECT o_orderpriority AS priority, o_orderdate AS day, o_orderkey AS id, {h32("o_orderkey", "o_custkey", "o_orderstatus")} AS h FROM orders) GROUP BY 1""")
def _(t):
    rows, columns = t.orders.withColumnRenamed("o_orderpriority", "priority"), ["o_orderkey", "o_custkey", "o_orderstatus"]
    return D.content_hash(rows, ["priority"], columns).join(
        D.ordered_hash(rows, ["priority"], ["o_orderdate", "o_orderkey"], columns).drop("n_rows"), "priority")


@register("agg51_file_manifest", "file change", "", """
    SELECT 'n=' || n_nationkey AS file, CASE WHEN n_nationkey % 5 = 0 THEN 'gone' WHEN n_nationkey % 5 = 1 THEN 'changed' ELSE 'same' END AS change FROM nation
    UNION ALL SELECT 'n=' || (100 + n_nationkey), 'added' FROM nation WHERE n_nationkey % 5 = 2""")
def _(t):
    k = F.col("n_nationkey")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == k).groupBy("n_nationkey").agg(
        F.concat_ws(" ", F.count("*"), F.max("c_custkey")).alias("value"))
    rows = t.nation.select("n_nationkey").join(rows, "n_nationkey", "left").select(k.alias("n"), F.coalesce("value", F.lit("none")).alias("value"))

    def tree(df, name):
        path = scratch_dir(t.spark, name)
        df.repartition("n").write.partitionBy("n").text(path)
        h = sinks.file_hashes(t.spark, path)
        return h.select(F.regexp_extract("path", r"/(n=\d+)/", 1).alias("file"), "bytes", "sha256").where("file <> ''")

    old = tree(rows, "tree-old")
    n = F.col("n")
    changed = rows.where(n % 5 != 0).withColumn("value", F.when(n % 5 == 1, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    new = tree(changed.unionByName(rows.where(n % 5 == 2).select((n + 100).alias("n"), "value")), "tree-new")
    kind = (F.when(F.col("a.sha256").isNull(), "added").when(F.col("b.sha256").isNull(), "gone")
            .when(F.col("a.sha256") != F.col("b.sha256"), "changed").otherwise("same"))
    return old.alias("a").join(new.alias("b"), "file", "full").select("file", kind.alias("change"))


@register("agg52_byte_identical_pairs", "copies n_contents", "", """
    SELECT copies, count(*) AS n_contents FROM (SELECT text, 2 * count(*) AS copies FROM documents GROUP BY 1) GROUP BY 1""")
def _(t):
    """Each document once as it is and once gzipped; equal content is found in both."""
    plain = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    packed = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".gz")).alias("path"), sinks.gzipped("text").alias("content"))
    both = plain.unionByName(packed.select("path", sinks.gunzipped("content").alias("content")))
    hashes = both.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return sinks.identical_files(hashes).groupBy("copies").agg(F.count("*").alias("n_contents"))


CONTRACT = """ct AS (SELECT segment, count(*) AS n, count(*) FILTER (event = 1) AS events FROM (SELECT c_mktsegment AS segment, event FROM (SPAN_) JOIN customer ON c_custkey = patient
    WHERE event IS NOT NULL AND time > 0) GROUP BY 1)""".replace("SPAN_", SPAN)


def contract(t, keys):
    people = valid_follow_up(follow_up(t)).join(t.customer, F.col("patient") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "segment")
    return L.power_contract(people, 4, keys)


@register("agg53_power_contract", "segment n events censored powered verdict", "per_covariate detectable", f"""
    WITH {CONTRACT} SELECT segment, n, events, n - events AS censored, events >= 80 AS powered,
    CASE WHEN events = 0 THEN 'BLOCKED' WHEN events >= 80 THEN 'ADEQUATE' ELSE 'UNDERPOWERED' END AS verdict, events / 4.0 AS per_covariate, 1.96 * sqrt(2.0 / events) AS detectable FROM ct""")
def _(t):
    return contract(t, ["segment"])


@register("agg54_rank_with_refusal", "method interpretation", "score gap", q("et", f"""
    WITH {CONTRACT}, c AS (SELECT sum(events) AS e FROM ct), s AS (SELECT method, 1 - avg(abs(e - t)) AS score FROM et GROUP BY 1)
    SELECT method, CASE WHEN e < 80 THEN 'INCONCLUSIVE' WHEN (SELECT max(score) FROM s) - score <= 1.96 * sqrt(2.0 / e) THEN 'tied with best' ELSE 'worse than best' END AS interpretation,
    score, (SELECT max(score) FROM s) - score AS gap FROM s, c"""))
def _(t):
    s = aligned(t).groupBy("method").agg((1 - F.avg(F.abs(F.col("e") - F.col("t")))).alias("score"))
    return L.rank_with_refusal(s, contract(t, []))


OUTCOMES = """oc AS (SELECT method, part AS outcome, avg(abs(e - t)) AS value FROM et GROUP BY 1, 2)"""


def outcomes(t):
    return aligned(t).groupBy("method", F.col("part").alias("outcome")).agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("value"))


@register("agg55_design_contrast", "kind name outcome n_outcomes n_improved", "mean_change with_it without_it", q("et", f"""
    WITH {OUTCOMES}, p AS (SELECT * FROM (VALUES ('control', 'lines'), ('price', 'net'), ('price', 'lines')) AS p(a, b)),
    fl AS (SELECT * FROM (VALUES ('money', 'price', true), ('money', 'net', true), ('money', 'lines', false), ('money', 'control', false),
      ('data', 'price', true), ('data', 'net', true), ('data', 'lines', true), ('data', 'control', false)) AS f(name, method, flag))
    SELECT 'pair' AS kind, concat(p.a, ' to ', p.b) AS name, NULL AS outcome, count(*) AS n_outcomes,
      count(*) FILTER (CASE WHEN x.outcome = 'SMALL' THEN y.value > x.value ELSE y.value < x.value END) AS n_improved,
      avg(y.value - x.value) AS mean_change, NULL::DOUBLE AS with_it, NULL::DOUBLE AS without_it
    FROM p JOIN oc x ON x.method = p.a JOIN oc y ON y.method = p.b AND y.outcome = x.outcome GROUP BY 2
    UNION ALL SELECT 'attribute', name, outcome, NULL, NULL, NULL, avg(value) FILTER (flag), avg(value) FILTER (NOT flag) FROM oc JOIN fl USING (method) GROUP BY 2, 3"""))
def _(t):
    r = cut_lineage(outcomes(t))
    pairs = t.spark.createDataFrame([("control", "lines"), ("price", "net"), ("price", "lines")], "a STRING, b STRING")
    flags = t.spark.createDataFrame([("price", True, True), ("net", True, True), ("lines", False, True), ("control", False, False)],
                                    "method STRING, money BOOLEAN, data BOOLEAN")
    d = r.select("outcome").distinct().withColumn("higher_is_better", F.col("outcome") == "SMALL")
    one = L.paired_contrast(r, pairs, d).select(
        F.lit("pair").alias("kind"), F.concat_ws(" to ", "a", "b").alias("name"), "n_outcomes", "n_improved", "mean_change")
    for flag in ("money", "data"):
        two = L.with_and_without(r, flags, flag).select(F.lit("attribute").alias("kind"), F.lit(flag).alias("name"), "outcome", "with_it", "without_it")
        one = one.unionByName(two, allowMissingColumns=True)
    return one


COHORTS = """fc AS (SELECT method, part AS factor, patient % 2 AS cohort, avg(e - t) AS beta FROM et JOIN smp USING (sample) WHERE method <> 'control' GROUP BY ALL),
    f1 AS (SELECT factor, quantile_cont(beta, 0.5) AS beta, abs(quantile_cont(beta, 0.5)) > 2e-4 AS supported FROM fc WHERE cohort = 0 GROUP BY 1),
    f2 AS (SELECT factor, quantile_cont(beta, 0.5) AS beta, count(*) FILTER (beta > 0) AS n_agree, count(*) AS n_methods,
      least(1, 2 * list_sum([factorial(CAST(count(*) AS INTEGER))::DOUBLE / factorial(i::INTEGER)::DOUBLE / factorial(CAST(count(*) - i AS INTEGER))::DOUBLE / pow(2.0, count(*))
        for i in range(0, least(count(*) FILTER (beta > 0), count(*) FILTER (beta <= 0)) + 1)])) AS p FROM fc WHERE cohort = 1 AND factor <> 'LARGE' GROUP BY 1)"""


@register("agg56_cross_cohort_replication", "factor same_direction verdict", "beta_1 beta_2", q("et smp", f"""
    WITH {COHORTS}, j AS (SELECT coalesce(f1.factor, f2.factor) AS factor, f1.beta AS beta_1, f2.beta AS beta_2, supported, sign(f1.beta) = sign(f2.beta) AND sign(f1.beta) <> 0 AS same_direction,
      n_agree >= 0.75 * n_methods AS steady, coalesce(p < 0.3, false) AS sig FROM f1 FULL JOIN f2 ON f1.factor = f2.factor)
    SELECT factor, same_direction, beta_1, beta_2, CASE WHEN beta_1 IS NULL OR beta_2 IS NULL THEN 'NOT TESTABLE' WHEN supported AND same_direction AND steady AND sig THEN 'REPLICATED'
    WHEN supported AND same_direction AND steady THEN 'direction agrees, not significant' WHEN supported AND same_direction THEN 'direction agrees, inconsistent' WHEN supported THEN 'REVERSED' WHEN steady AND sig THEN 'null first, SUPPORTED second' ELSE 'null in both' END AS verdict FROM j"""))
def _(t):
    fc = aligned(t, "price", "lines", "net").join(R.samples(t).select("sample", (F.col("patient") % 2).alias("cohort")), "sample").groupBy(
        "method", F.col("part").alias("factor"), "cohort").agg(F.avg(F.col("e") - F.col("t")).alias("beta"))
    mid = F.percentile("beta", F.lit(0.5))  # over the roster of methods
    first = fc.where("cohort = 0").groupBy("factor").agg(mid.alias("beta")).withColumn("supported", F.abs("beta") > 2e-4)
    second = fc.where("cohort = 1 AND factor <> 'LARGE'").groupBy("factor").agg(
        mid.alias("beta"), F.count_if(F.col("beta") > 0).alias("n_agree"), F.count("*").alias("n_methods"))
    second = second.withColumn("p", ST.binomial_two_sided(F.col("n_agree"), F.col("n_methods")))
    return L.replication(first, second, alpha=0.3)  # three methods: the least p is 0.25


@register("agg57_ledger_gaps", "method truth status n", "value", q("et smp", """
    WITH g AS (SELECT unnest(['price', 'lines', 'net', 'control']) AS method), s AS (SELECT DISTINCT structure AS truth FROM smp),
    m AS (SELECT method, structure AS truth, count(*) AS n, avg(abs(e - t)) AS value FROM et JOIN smp USING (sample) WHERE NOT (method = 'control' AND structure >= '4') AND NOT (method = 'net' AND structure = '1-URGENT') GROUP BY 1, 2)
    SELECT g.method, s.truth, CASE WHEN value IS NOT NULL THEN 'measured' WHEN g.method = 'control' THEN 'explained' ELSE 'GAP' END AS status, n, value
    FROM g CROSS JOIN s LEFT JOIN m ON m.method = g.method AND m.truth = s.truth"""))
def _(t):
    rows = aligned(t).join(R.samples(t).select("sample", F.col("structure").alias("truth")), "sample")
    skip = ((F.col("method") == "control") & (F.col("truth") >= "4")) | ((F.col("method") == "net") & (F.col("truth") == "1-URGENT"))
    m = rows.where(~skip).groupBy("method", "truth").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("e") - F.col("t"))).alias("value"))
    truths = R.samples(t).select(F.col("structure").alias("truth")).distinct()
    reasons = truths.withColumn("method", F.lit("control")).withColumn("reason", F.lit("a control is not validated here"))
    return L.gaps(R.estimates(t).select("method").distinct(), truths, m, reasons)


@register("agg58_tier_classification", "tier n_methods", "", q("est", """
    WITH m AS (SELECT DISTINCT method || '/' || part AS method FROM est)
    SELECT CASE WHEN starts_with(method, 'control') THEN 'control' WHEN ends_with(method, 'LARGE') OR ends_with(method, 'SMALL') THEN 'published' WHEN method LIKE '%net%' THEN 'variant' ELSE 'rebuilt' END AS tier,
    count(*) AS n_methods FROM m GROUP BY 1"""))
def _(t):
    m = R.estimates(t).select(F.concat_ws("/", "method", "part").alias("method")).distinct()
    c = F.col("method")
    rules = {"control": c.startswith("control"), "published": c.endswith("LARGE") | c.endswith("SMALL"), "variant": c.contains("net")}
    return L.tiers(m, rules, "rebuilt").groupBy("tier").agg(F.count("*").alias("n_methods"))


@register("agg59_json_diff", "path status n", "", f"""
    SELECT path, status, count(*) AS n FROM (
    SELECT 'total' AS path, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' WHEN abs(a.o_totalprice - b.o_totalprice) <= 1e-6 * greatest(1, abs(a.o_totalprice)) THEN 'same' ELSE 'differs' END AS status
      FROM orders a FULL JOIN ({NEW_ORDERS}) b ON a.o_orderkey = b.o_orderkey
    UNION ALL SELECT 'ids.cust', CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'same' END FROM orders a FULL JOIN ({NEW_ORDERS}) b ON a.o_orderkey = b.o_orderkey) GROUP BY 1, 2""")
def _(t):
    doc = F.to_json(F.struct(F.struct(F.col("o_custkey").cast("string").alias("cust"), F.lit("x").alias("time")).alias("ids"),
                             F.col("o_totalprice").cast("string").alias("total")))
    side = lambda d: scans.json_leaves(d.select("o_orderkey", doc.alias("doc")), "o_orderkey", "doc", at_once=2)
    return D.leaf_diff(side(t.orders), side(new_orders(t)), ["o_orderkey"], 1e-6, "time$").groupBy("path", "status").agg(F.count("*").alias("n"))


@register("agg60_complete_case_and_coverage", "sample n", "mean_value coverage", q("expr", """
    WITH x AS (SELECT cell, feature, CASE WHEN (cell * 64 + feature) % 97 <> 5 OR feature < 32 THEN value END AS v FROM expr), ok AS (SELECT feature FROM x GROUP BY 1 HAVING count(v) = count(*)),
    a AS (SELECT cell AS sample, count(*) AS n, avg(v) AS mean_value FROM x WHERE feature IN (SELECT feature FROM ok) GROUP BY 1), b AS (SELECT cell AS sample, avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0 END) AS coverage FROM x GROUP BY 1)
    SELECT sample, n, mean_value, coverage FROM a JOIN b USING (sample) WHERE coverage >= 0.985"""))
def _(t):
    hole = ((F.col("cell") * 64 + F.col("feature")) % 97 == 5) & (F.col("feature") >= 32)
    x = R.cell_expr(t).withColumn("value", F.when(~hole, F.col("value")))
    a = D.complete_features(x, "feature", "value").groupBy("cell").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return a.join(D.covered_samples(x, "cell", "value", 0.985), "cell").withColumnRenamed("cell", "sample")


@register("agg61_distinct_settings", "kept n_settings n_rows", "", """
    WITH s AS (SELECT * FROM (VALUES (0, 10), (1, 20), (2, 10), (3, 30), (4, 10)) AS s(setting, cut)),
    l AS (SELECT setting, count(*) AS n_rows, list(p_size > cut ORDER BY p_partkey) AS flags FROM s, part GROUP BY 1)
    SELECT min(setting) AS kept, count(*) AS n_settings, max(n_rows) AS n_rows FROM l GROUP BY flags""")
def _(t):
    """Five settings of one threshold; 0, 2 and 4 give the same table."""
    s = t.part.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(4))))
    cut = F.element_at(F.array(F.lit(10), F.lit(20), F.lit(10), F.lit(30), F.lit(10)), F.col("setting") + 1)
    rows = s.select("setting", F.col("setting").alias("pos"), "p_partkey", (F.col("p_size") > cut).cast("int").alias("flag"))
    return D.distinct_settings(rows, "setting", "pos", ["p_partkey", "flag"]).select("kept", "n_settings", "n_rows")


