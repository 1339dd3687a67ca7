"""Joins and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.columns import aligned
from partwise.catalog.registry import register
from partwise.catalog.roles import h32, q
from partwise.functions import text as T
from partwise.functions.draws import hash32
from partwise.functions.guards import pearson
from partwise.operators import keys as K
from partwise.operators import score as S
from partwise.operators import stats as ST


@register("joi01_sample_manifest_join", "structure n_samples", "total", q("matrix", """
    SELECT CAST(s_nationkey AS VARCHAR) AS structure, count(*) AS n_samples, sum(value) AS total
    FROM matrix JOIN supplier ON sample = s_suppkey WHERE s_acctbal > 0 GROUP BY 1"""))
def _(t):
    manifest = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("sample"),
                                                        F.col("s_nationkey").cast("string").alias("structure"))
    return K.manifest_join(R.matrix(t), manifest).groupBy("structure").agg(
        F.count("*").alias("n_samples"), F.sum("value").alias("total"))


@register("joi02_reindex_left_join", "status n_rows n_missing", "", """
    SELECT o_orderstatus AS status, count(*) AS n_rows, count(*) FILTER (c_custkey IS NULL) AS n_missing FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 1000) ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    meta = t.customer.where("c_acctbal > 1000").select("c_custkey")
    return t.orders.join(meta, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(
        F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_rows"),
                                                    F.count_if(F.col("c_custkey").isNull()).alias("n_missing"))


@register("joi03_id_symbol_join", "symbol", "value", """
    SELECT symbol, sum(l_quantity) AS value FROM lineitem JOIN
    (SELECT p_partkey, CASE WHEN p_size < 5 THEN ' ' WHEN p_size < 8 THEN 'nan' ELSE p_name END AS symbol FROM part)
    ON l_partkey = p_partkey WHERE trim(symbol) NOT IN ('', 'nan') GROUP BY 1""")
def _(t):
    names = t.part.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") < 5, " ").when(
        F.col("p_size") < 8, "nan").otherwise(F.col("p_name")).alias("symbol"))
    return K.id_to_symbol(t.lineitem.select("l_partkey", "l_quantity"), names, "l_partkey").groupBy("symbol").agg(
        F.sum("l_quantity").alias("value"))


@register("joi04_one_to_one_bridge", "tumour n_rekeyed n_unmapped", "", """
    SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'T' || c_nationkey END AS tumour,
    count(*) FILTER (c_custkey % 9 <> 0) AS n_rekeyed, count(*) FILTER (c_custkey % 9 = 0) AS n_unmapped
    FROM customer GROUP BY 1""")
def _(t):
    pairs = t.customer.where("c_custkey % 9 <> 0").select(
        F.col("c_custkey").alias("donor"), F.concat_ws("-", F.lit("T"), "c_custkey").alias("tumour_id"))
    bridge = K.one_to_one(pairs, "donor", "tumour_id")
    rows = t.customer.select(F.col("c_custkey").alias("donor"), F.concat(F.lit("T"), "c_nationkey").alias("tumour"))
    mapped, missing = K.rekey(rows, bridge, "donor", "tumour_id")
    a = mapped.groupBy("tumour").agg(F.count("*").alias("n_rekeyed"), F.lit(0).cast("bigint").alias("n_unmapped"))
    b = missing.agg(F.lit(None).cast("string").alias("tumour"), F.lit(0).cast("bigint").alias("n_rekeyed"),
                    F.count("*").alias("n_unmapped"))
    return a.unionByName(b)


TIER_L = """SELECT c_custkey AS id, 'S-' || c_nationkey || '-' || c_custkey || '-01A' AS strict,
    'S-' || c_nationkey || '-' || c_custkey || '-01' AS loose FROM customer"""
TIER_R = """SELECT o_orderkey AS pos, o_totalprice AS purity,
    CASE WHEN o_orderkey % 4 = 0 THEN 'F-' || o_orderkey ELSE 'S-' || c_nationkey || '-' || c_custkey || '-01' ||
      CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END END AS strict,
    'S-' || c_nationkey || '-' || c_custkey || '-01' AS alt, o_orderkey % 4 <> 0 AS std
    FROM orders JOIN customer ON o_custkey = c_custkey"""


@register("joi05_tiered_key_join", "id", "registered corrected vial_insensitive", f"""
    WITH l AS ({TIER_L}), r AS ({TIER_R}),
    a AS (SELECT strict, arg_min(purity, pos) AS v FROM r WHERE std GROUP BY 1),
    b AS (SELECT alt, arg_min(purity, pos) AS v FROM r WHERE NOT std GROUP BY 1),
    c AS (SELECT alt, arg_min(purity, pos) AS v FROM r GROUP BY 1)
    SELECT id, a.v AS registered, coalesce(a.v, b.v) AS corrected, c.v AS vial_insensitive FROM l
    LEFT JOIN a ON a.strict = l.strict LEFT JOIN b ON b.alt = l.loose LEFT JOIN c ON c.alt = l.loose""")
def _(t):
    code = lambda tail: F.concat_ws("-", F.lit("S"), "c_nationkey", "c_custkey", tail)
    left = t.customer.select(F.col("c_custkey").alias("id"), code(F.lit("01A")).alias("strict"), code(F.lit("01")).alias("loose"))
    k = F.col("o_orderkey")
    right = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("pos"), F.col("o_totalprice").alias("purity"), (k % 4 != 0).alias("std"), code(F.lit("01")).alias("alt"),
        F.when(k % 4 == 0, F.concat(F.lit("F-"), k.cast("string"))).otherwise(
            code(F.when(k % 2 == 0, "01A").otherwise("01B"))).alias("strict"))
    return K.tiered_join(left, right, "strict", "loose", "alt", F.col("std"), "purity", "pos")


@register("joi06_two_way_anti", "structure status n same", "", """
    SELECT *, bool_and(status = 'agree') OVER () AS same FROM (SELECT coalesce(a.f, b.f) AS structure, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right'
    WHEN a.f = b.f THEN 'agree' ELSE 'disagree' END AS status, count(*) AS n
    FROM (SELECT o_orderkey AS k, o_orderpriority AS f FROM orders WHERE o_orderkey % 5 <> 0) a
    FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END AS f FROM orders
      WHERE o_orderkey % 7 <> 0) b ON a.k = b.k GROUP BY 1, 2)""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("structure"))
    k = F.col("sample")
    b = o.where(k % 7 != 0).withColumn("structure", F.when(k % 11 == 0, "X").otherwise(F.col("structure")))
    counts = K.two_way_anti(o.where(k % 5 != 0), b, "sample", "structure").groupBy("structure", "status").agg(F.count("*").alias("n"))
    return counts.withColumn("same", K.all_agree(counts))


@register("joi07_key_set_semi", "part n", "", """SELECT p_type AS part, count(*) AS n FROM part WHERE p_partkey IN
    (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1""")
def _(t):
    wanted = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(wanted, "p_partkey", "left_semi").groupBy(F.col("p_type").alias("part")).agg(F.count("*").alias("n"))


@register("joi08_estimate_truth_join", "method part n", "mean_e mean_t", q("et", """
    SELECT method, part, count(*) AS n, avg(e) AS mean_e, avg(t) AS mean_t FROM et GROUP BY ALL"""))
def _(t):
    return K.align(R.estimates(t), R.truth(t), at_least=1).groupBy("method", "part").agg(
        F.count("*").alias("n"), F.avg("e").alias("mean_e"), F.avg("t").alias("mean_t"))


@register("joi09_multi_set_intersection", "feature pos", "", """
    SELECT feature, pos FROM (SELECT DISTINCT p_name AS feature, min(p_partkey) AS pos FROM part GROUP BY 1)
    WHERE feature IN (SELECT p_name FROM part WHERE p_type = 'SMALL') AND feature IN (SELECT p_name FROM part WHERE p_size > 40)
    AND feature IN (SELECT p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))""")
def _(t):
    named = t.part.withColumnRenamed("p_name", "feature")
    ordered = named.groupBy("feature").agg(F.min("p_partkey").alias("pos"))
    others = [named.where("p_type = 'SMALL'"), named.where("p_size > 40"),
              named.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))]
    return K.shared_features(ordered, others, "feature", "pos")


PAIR_SQL = """SELECT h.method, h.tumour, h.part, count(*) AS n_pairs, count(*) FILTER (h.value > l.value) AS n_gt,
    count(*) FILTER (h.value = l.value) AS n_tie
    FROM (SELECT * FROM est JOIN smp USING (sample) WHERE structure = '1-URGENT') h
    JOIN (SELECT * FROM est JOIN smp USING (sample) WHERE structure = '5-LOW') l
    ON h.method = l.method AND h.tumour = l.tumour AND h.part = l.part GROUP BY 1, 2, 3"""


@register("joi10_within_group_pairs", "method tumour part n_pairs n_gt n_tie", "", q("est smp", PAIR_SQL))
def _(t):
    rows = R.estimates(t).join(R.samples(t), "sample")
    out = ST.label_pair_counts(rows, ["method", "tumour", "part"], "structure", "value", "1-URGENT", "5-LOW")
    return out.select("method", "tumour", "part", *[F.col(c).cast("bigint").alias(c) for c in ("n_pairs", "n_gt", "n_tie")])


@register("joi11_comparable_pair_theta", "method structure comparable concordant tied", "", q("est truth smp", """
    WITH x AS (SELECT method, structure, sample, e.value AS e, t.value AS t FROM est e JOIN truth t USING (sample, part)
      JOIN smp USING (sample) WHERE part = 'PROMO' AND method IN ('price', 'control'))
    SELECT a.method, a.structure, count(*) AS comparable,
    count(*) FILTER ((a.e < b.e AND a.t < b.t) OR (a.e > b.e AND a.t > b.t)) AS concordant, count(*) FILTER (a.e = b.e) AS tied
    FROM x a JOIN x b ON a.method = b.method AND a.structure = b.structure AND a.sample < b.sample AND a.t <> b.t GROUP BY 1, 2"""))
def _(t):
    rows = aligned(t, "price", "control").where("part = 'PROMO'").join(R.samples(t).select("sample", "structure"), "sample")
    out = ST.comparable_pairs(rows, ["method", "structure"], "t", "e")
    return out.select("method", "structure",
                      *[F.col(c).cast("bigint").alias(c) for c in ("comparable", "concordant", "tied")])


@register("joi12_method_pairs", "part m1 m2 n", "r", q("est", """
    SELECT a.part, a.method AS m1, b.method AS m2, count(*) AS n,
    covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r
    FROM est a JOIN est b ON a.sample = b.sample AND a.part = b.part AND a.method < b.method GROUP BY 1, 2, 3"""))
def _(t):
    return ST.method_pair_correlation(R.estimates(t), R.METHODS, ["sample", "part"], ["part"])


@register("joi13_constraint_cross_join", "method tumour id ok", "weight", q("verdict", """
    SELECT method, tumour, id, ok, weight FROM verdict"""))
def _(t):
    means = S.group_means(R.estimates(t), R.samples(t), digits=10)
    return S.verdicts(means, S.constraint_terms(t.spark, R.CONSTRAINTS), ["method", "tumour"])


NEW_ORDERS = f"""SELECT o_orderkey, o_custkey, CASE WHEN h % 100 = 1 THEN o_totalprice * 1.5 WHEN h % 100 = 2
    THEN o_totalprice * (1 + 1e-12) ELSE o_totalprice END AS o_totalprice FROM
    (SELECT *, {h32("'chg'", "o_orderkey")} AS h FROM orders) WHERE h % 100 <> 3
    UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice FROM orders WHERE {h32("'chg'", "o_orderkey")} % 100 = 4"""


def new_orders(t):
    """The orders table with a hash-chosen few changed, jittered, dropped and added."""
    h = hash32(F.lit("chg"), "o_orderkey") % 100
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", h.alias("h"))
    price = F.when(F.col("h") == 1, F.col("o_totalprice") * 1.5).when(
        F.col("h") == 2, F.col("o_totalprice") * (1 + 1e-12)).otherwise(F.col("o_totalprice"))
    kept = o.where("h <> 3").select("o_orderkey", "o_custkey", price.alias("o_totalprice"))
    added = o.where("h = 4").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", "o_totalprice")
    return kept.unionByName(added)


@register("joi14_keyed_full_outer_diff", "status n", "", f"""
    SELECT CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'lost'
    WHEN a.o_totalprice = b.o_totalprice THEN 'reproduced'
    WHEN abs(a.o_totalprice - b.o_totalprice) / greatest(1, abs(a.o_totalprice)) <= 1e-9 THEN 'noise' ELSE 'changed' END AS status,
    count(*) AS n FROM orders a FULL JOIN ({NEW_ORDERS}) b ON a.o_orderkey = b.o_orderkey GROUP BY 1""")
def _(t):
    from partwise.operators import diff as D

    old = t.orders.select("o_orderkey", "o_totalprice")
    return D.keyed_diff(old, new_orders(t), ["o_orderkey"], ["o_totalprice"], 1e-9).groupBy("status").agg(F.count("*").alias("n"))


@register("joi15_matrix_product_join", "feature sample", "fitted", q("sig est smp", """
    SELECT feature, tumour AS sample, sum(mean * v) AS fitted FROM sig JOIN (SELECT tumour, part, avg(value) AS v FROM est
    JOIN smp USING (sample) WHERE method = 'price' GROUP BY 1, 2) USING (part) GROUP BY 1, 2"""))
def _(t):
    shares = R.estimates(t, "price").join(R.samples(t), "sample").groupBy(F.col("tumour").alias("sample"), "part").agg(
        F.avg("value").alias("value"))
    return K.matrix_product(R.signature(t), shares, ["sample"])


TEST_DONORS = f"""SELECT donor FROM (SELECT donor, row_number() OVER (ORDER BY {h32("'split'", "donor")}, donor) AS rn
    FROM (SELECT DISTINCT donor FROM cells)) WHERE rn <= 3"""


@register("joi16_donor_holdout_filter", "side donor n", "", q("cells", f"""
    SELECT CASE WHEN donor IN ({TEST_DONORS}) THEN 'test' ELSE 'train' END AS side, donor, count(*) AS n FROM cells GROUP BY 1, 2"""))
def _(t):
    from partwise.operators import profiles as P

    c = R.cells(t)
    donors = P.donor_split(c, n_test=3, seed="split")
    side = lambda test, name: K.holdout(c, donors, test).withColumn("side", F.lit(name))
    return side(True, "test").unionByName(side(False, "train")).groupBy("side", "donor").agg(F.count("*").alias("n"))


@register("joi17_provenance_merge", "c_custkey priority", "mean_total", """
    SELECT c_custkey, p AS priority, m AS mean_total FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p,
    avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    listing = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"),
                              F.col("o_totalprice").alias("total"), "o_orderkey")
    return K.provenance(t.customer.select("c_custkey"), listing, "c_custkey", "o_orderkey", ["priority"], ["total"])


@register("set01_stack_methods", "method n", "total", q("est", """
    SELECT method, count(*) AS n, sum(value) AS total FROM est GROUP BY 1"""))
def _(t):
    frames = {m: R.estimates(t, m).drop("method") for m in R.METHODS}
    return K.stack(frames).groupBy("method").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@register("set02_set_difference_report", "side name n_side", "", """
    SELECT *, count(*) OVER (PARTITION BY side) AS n_side FROM (SELECT 'left_only' AS side, name FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 3
    EXCEPT SELECT p_name FROM part WHERE p_size > 47)
    UNION ALL SELECT 'right_only', name FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 47
    EXCEPT SELECT p_name FROM part WHERE p_size < 3))""")
def _(t):
    p = t.part.withColumnRenamed("p_name", "name")
    names = K.set_difference(p.where("p_size < 3"), p.where("p_size > 47"), "name")
    return names.join(names.groupBy("side").agg(F.count("*").alias("n_side")), "side")


@register("set03_intersect_methods", "method", "score_a score_b", q("et", """
    SELECT method, avg(abs(e - t)) AS score_a, avg(e * t) AS score_b FROM et WHERE method NOT IN ('control', 'net') GROUP BY 1"""))
def _(t):
    et = aligned(t)
    a = et.groupBy("method").agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("score"))
    b = et.where("method <> 'net'").groupBy("method").agg(F.avg(F.col("e") * F.col("t")).alias("score"))
    return K.shared_methods(a, b, ["control"])


@register("set05_version_changes", "o_orderkey change reason explained", "", f"""
    SELECT k AS o_orderkey, change, reason, reason IS NOT NULL AS explained FROM (
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, CASE WHEN a.o_orderkey IS NULL THEN 'added'
    WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice <> b.o_totalprice THEN 'changed' END AS change
    FROM orders a FULL JOIN ({NEW_ORDERS}) b ON a.o_orderkey = b.o_orderkey)
    LEFT JOIN (SELECT o_orderkey, 'promotion' AS reason FROM orders WHERE o_orderpriority = '1-URGENT') r ON r.o_orderkey = k
    WHERE change IS NOT NULL""")
def _(t):
    reasons = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("promotion").alias("reason"))
    return K.version_changes(t.orders, new_orders(t), reasons, "o_orderkey", "o_totalprice")
