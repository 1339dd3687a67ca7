"""Projections, filters and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.registry import register
from partwise.catalog.roles import q
from partwise.functions import text as T
from partwise.functions.guards import ratio
from partwise.operators import compose as C

RAW_LABEL = """SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || 'T-cd44'
    WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN ' CTp_an-reference-histology'
    WHEN o_orderstatus = 'F' THEN 'ct mvp-reference-histology' ELSE 'xX' || '-reference-histology' END AS raw FROM orders"""


def raw_labels(t):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    raw = (F.when(k % 3 == 0, F.concat(s, F.lit("T-cd44"))).when(k % 7 == 0, None)
           .when(s == "P", " CTp_an-reference-histology").when(s == "F", "ct mvp-reference-histology")
           .otherwise("xX-reference-histology"))
    return t.orders.select(k.alias("sample"), raw.alias("raw"))


@register("prj02_canonical_label", "sample label", "", f"""
    SELECT sample, CASE WHEN raw IS NULL THEN 'UNKNOWN' WHEN NOT ends_with(trim(raw), '-reference-histology') THEN trim(raw)
    ELSE coalesce(map_extract(MAP {{'CTPAN': 'PAN', 'CTMVP': 'MVP'}}, upper(translate(stem, '-_ ', '')))[1], stem) END AS label
    FROM (SELECT *, replace(trim(raw), '-reference-histology', '') AS stem FROM ({RAW_LABEL}))""")
def _(t):
    return raw_labels(t).select("sample", T.canonical_label("raw").alias("label"))


@register("prj03_suffix_predicate", "is_anatomic is_primary n", "", f"""
    SELECT is_anatomic, is_primary, count(*) AS n FROM (SELECT coalesce(ends_with(trim(raw), '-reference-histology'), false)
    AS is_anatomic, coalesce(ends_with(trim(raw), '-reference-histology'), false) AND (raw LIKE '%an%' OR raw LIKE '%mvp%')
    AS is_primary FROM (SELECT sample, CASE WHEN raw = 'xX-reference-histology' THEN 'xX-reference-histology' ELSE raw END
    AS raw FROM ({RAW_LABEL})) x(s, raw)) GROUP BY ALL""".replace("raw LIKE '%an%' OR raw LIKE '%mvp%'",
                                                                 "raw NOT LIKE 'xX%'"))
def _(t):
    flag = T.has_suffix("raw")
    primary = flag & T.canonical_label("raw").isin("LE", "IT", "CT", "MVP", "PAN")
    return raw_labels(t).select(flag.alias("is_anatomic"), primary.alias("is_primary")).groupBy(
        "is_anatomic", "is_primary").agg(F.count("*").alias("n"))


BARCODE = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat_ws('-', 'S', c_nationkey) ELSE
    concat_ws('-', 'S', c_nationkey, c_custkey, '01' || chr(CAST(65 + c_custkey % 3 AS INTEGER)), '11R') END AS code FROM customer"""


def barcodes(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    vial = F.concat(F.lit("01"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (k % 3 + 1).cast("int")))
    code = F.when(k % 5 == 0, F.concat_ws("-", F.lit("S"), n)).otherwise(
        F.concat_ws("-", F.lit("S"), n, k.cast("string"), vial, F.lit("11R")))
    return t.customer.select("c_custkey", code.alias("code"))


@register("prj04_barcode_keys", "c_custkey key3 key4 loose", "", f"""
    SELECT c_custkey, array_to_string(f[1:3], '-') AS key3, array_to_string(f[1:4], '-') AS key4,
    CASE WHEN len(f) > 3 THEN array_to_string(f[1:3], '-') || '-' || substr(f[4], 1, 2) ELSE code END AS loose
    FROM (SELECT *, string_split(code, '-') AS f FROM ({BARCODE}))""")
def _(t):
    return barcodes(t).select("c_custkey", T.barcode_prefix("code", 3).alias("key3"),
                              T.barcode_prefix("code", 4).alias("key4"), T.barcode_loose("code").alias("loose"))


ROSTER = {"ECONOMY": "Small", "SMALL": "Small", "MEDIUM": "Middle", "STANDARD": "Middle", "LARGE": "Large"}


@register("prj05_roster_map", "p_partkey part", "", """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Small'
    WHEN p_type IN ('MEDIUM', 'STANDARD') THEN 'Middle' ELSE 'Large' END AS part FROM part WHERE p_type <> 'PROMO'""")
def _(t):
    return C.roster_map(t.part, "p_type", ROSTER).select("p_partkey", "part")


STATUS = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' DEAD' WHEN 'O' THEN '0:LIVING' ELSE 'unknown' END AS raw FROM orders"""


@register("prj06_event_coercion", "o_orderkey", "event as_int as_double", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END AS event,
    o_orderkey % 2 AS as_int, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END AS as_double FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderstatus") == "F", " DEAD").when(F.col("o_orderstatus") == "O", "0:LIVING").otherwise("unknown")
    half = (F.col("o_orderkey") % 2).cast("int")
    number = F.when(F.col("o_orderkey") % 5 != 0, half.cast("double")).otherwise(F.lit(float("nan")))
    return t.orders.select("o_orderkey", T.event_flag(raw).alias("event"), T.event_flag(half).alias("as_int"),
                           T.event_flag(number).alias("as_double"))


@register("prj07_number_from_text", "doc_id", "first_number", """
    SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE) AS first_number FROM documents""")
def _(t):
    return t.documents.select("doc_id", T.number_in("text").alias("first_number"))


@register("prj08_unit_conversion", "o_orderkey", "days fraction", """
    SELECT o_orderkey, extract(month FROM o_orderdate) * 30.437 AS days, (o_orderkey % 100) / 100.0 AS fraction FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", T.months_to_days(F.month("o_orderdate")).alias("days"),
                           T.percent_to_fraction(F.col("o_orderkey") % 100).alias("fraction"))


SPAN = """SELECT o_custkey AS patient, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS DOUBLE) AS time,
    CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END AS event FROM orders GROUP BY 1"""


def follow_up(t):
    """patient, time in days, event (1, 0 or missing)."""
    last = F.max_by("o_orderstatus", "o_orderkey")
    return t.orders.groupBy(F.col("o_custkey").alias("patient")).agg(
        F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("time"),
        F.when(last == "F", 1.0).when(last == "O", 0.0).alias("event"))


def valid_follow_up(df):
    return df.where(F.col("time").isNotNull() & F.col("event").isNotNull() & (F.col("time") > 0))


@register("prj09_valid_row_filter", "n_rows n_no_event n_no_time n_kept", "", f"""
    SELECT count(*) AS n_rows, count(*) FILTER (event IS NULL) AS n_no_event, count(*) FILTER (time <= 0) AS n_no_time,
    count(*) FILTER (event IS NOT NULL AND time > 0) AS n_kept FROM ({SPAN})""")
def _(t):
    kept = F.col("event").isNotNull() & (F.col("time") > 0)
    return follow_up(t).agg(F.count("*").alias("n_rows"), F.count_if(F.col("event").isNull()).alias("n_no_event"),
                            F.count_if(F.col("time") <= 0).alias("n_no_time"), F.count_if(kept).alias("n_kept"))


@register("prj11_log_scale_inversion", "l_orderkey l_linenumber", "a b c", """
    SELECT l_orderkey, l_linenumber, greatest(pow(2.0, l_discount * 10) - 1, 0) AS a, greatest(exp(l_tax) - 1, 0) AS b,
    greatest((pow(2.0, l_tax - 0.02) - 1) * 10, 0) AS c FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", C.invert_log(F.col("l_discount") * 10, "log2p1").alias("a"),
        C.invert_log("l_tax", "log1p").alias("b"), C.invert_log(F.col("l_tax") - 0.02, "log2_tenth").alias("c"))


@register("prj12_scale_grid_gate", "suppkey passes", "on_grid", """
    SELECT *, on_grid >= 0.5 AS passes FROM (SELECT l_suppkey AS suppkey, avg(CASE WHEN l_quantity < 40 THEN
    CASE WHEN abs(l_quantity / 2.0 - round_even(l_quantity / 2.0, 0)) < 1e-6 THEN 1.0 ELSE 0.0 END END) AS on_grid
    FROM lineitem GROUP BY 1)""")
def _(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        C.grid_share("l_quantity", 2.0, 40.0).alias("on_grid")).withColumn("passes", F.col("on_grid") >= 0.5)


@register("prj13_regex_family_flag", "suppkey", "share", """
    SELECT l_suppkey AS suppkey, sum(CASE WHEN regexp_matches(p_name, '(ring|bolt)$') OR starts_with(p_name, 'red')
    OR p_name IN ('small widget') THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0) AS share
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    flag = T.family_flag("p_name", "(ring|bolt)$", prefixes=["red"], members=["small widget"])
    return rows.groupBy(F.col("l_suppkey").alias("suppkey")).agg(C.mass_share(flag, "l_quantity").alias("share"))


@register("prj14_text_covariates", "c_custkey", "flag", """
    SELECT c_custkey, CASE WHEN lower(c_mktsegment) LIKE 'auto%' OR lower(c_mktsegment) LIKE 'mach%' THEN 1.0
    WHEN lower(c_mktsegment) LIKE 'house%' THEN 0.0 END AS flag FROM customer""")
def _(t):
    return t.customer.select("c_custkey", T.three_valued("c_mktsegment", ["auto", "mach"], ["house"]).alias("flag"))


@register("prj15_compartment_sum", "method compartment sample", "total", q("est", """
    SELECT method, c.compartment, sample, sum(value) AS total FROM est
    JOIN (VALUES ('big', 'LARGE'), ('big', 'MEDIUM'), ('small', 'SMALL'), ('small', 'ECONOMY'), ('small', 'PROMO'))
    AS c(compartment, part) USING (part) GROUP BY ALL"""))
def _(t):
    members = t.part.select(F.col("p_type").alias("part")).distinct().select(
        "part", F.when(F.col("part").isin("LARGE", "MEDIUM"), "big")
        .when(F.col("part").isin("SMALL", "ECONOMY", "PROMO"), "small").alias("compartment")).where("compartment IS NOT NULL")
    return C.compartments(R.estimates(t), members)


RAW_EST = """SELECT method, sample, part, CASE WHEN sample % 50 = 0 AND part = 'SMALL' AND method <> 'control' THEN NULL
    WHEN sample % 50 = 1 THEN -value ELSE value - 0.1 END AS raw, NOT (method = 'control' AND part = 'PROMO') AS covered FROM est"""


def raw_estimates(t):
    s = F.col("sample") % 50
    raw = F.when((s == 0) & (F.col("part") == "SMALL") & (F.col("method") != "control"), None).when(
        s == 1, -F.col("value")).otherwise(F.col("value") - 0.1)
    return R.estimates(t).select("method", "sample", "part", raw.alias("value"),
                                 (~((F.col("method") == "control") & (F.col("part") == "PROMO"))).alias("covered"))


@register("prj16_simplex_close", "method sample part", "closed", q("est", f"""
    WITH r AS ({RAW_EST}), c AS (SELECT *, CASE WHEN covered THEN greatest(raw, 0 * raw) END AS clip FROM r),
    s AS (SELECT *, sum(clip) OVER w AS tot, bool_or(covered AND raw IS NULL) OVER w AS broken,
      bool_or(NOT covered) OVER w AS partial FROM c WINDOW w AS (PARTITION BY method, sample))
    SELECT method, sample, part, CASE WHEN broken OR coalesce(tot, 0) <= 0 THEN NULL WHEN partial THEN clip
      ELSE clip / tot END AS closed FROM s"""))
def _(t):
    return C.simplex_close(raw_estimates(t), covered="covered").withColumnRenamed("value", "closed")


SIZES_SQL = "SELECT p_type AS part, avg(p_retailprice) AS size FROM part GROUP BY 1"


def part_sizes(t):
    return t.part.groupBy(F.col("p_type").alias("part")).agg(F.avg("p_retailprice").alias("size"))


@register("prj17_part_size_conversion", "method sample part", "value", q("est", f"""
    SELECT method, sample, part, CASE WHEN method = 'control' THEN value ELSE
    (value / size) / nullif(sum(value / size) OVER (PARTITION BY method, sample), 0) END AS value
    FROM est JOIN ({SIZES_SQL}) USING (part)"""))
def _(t):
    est = R.estimates(t).withColumn("done", F.col("method") == "control")
    return C.to_cell_fractions(est, part_sizes(t), skip="done")


TRIO = ["SMALL", "LARGE", "PROMO"]
SHARE3 = """SELECT method, sample, part, value / nullif(sum(value) OVER (PARTITION BY method, sample), 0) AS share
    FROM est WHERE part IN ('SMALL', 'LARGE', 'PROMO')"""


@register("prj18_renormalise_within", "method sample part", "share", q("est", SHARE3))
def _(t):
    return C.renormalise_within(R.estimates(t), TRIO)


@register("prj19_ordering_string", "method sample ordering", "", q("est", f"""
    SELECT method, sample, CASE WHEN count(share) >= 3 THEN string_agg(part, '>' ORDER BY share DESC, part) END AS ordering
    FROM ({SHARE3}) GROUP BY 1, 2"""))
def _(t):
    return C.ordering(C.renormalise_within(R.estimates(t), TRIO), ["method", "sample"], "share", 3)


@register("prj21_verdict_rules", "part coverage_verdict agreement_verdict", "", q("truth", """
    WITH c AS (SELECT part, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS cov, avg(value) AS rho, count(*) AS n FROM truth GROUP BY 1)
    SELECT part, CASE WHEN cov - 0.95 < -0.25 THEN 'SEVERELY OVERCONFIDENT' WHEN cov - 0.95 < -0.10 THEN 'OVERCONFIDENT'
    WHEN cov - 0.95 > 0.04 THEN 'CONSERVATIVE' ELSE 'WELL CALIBRATED' END AS coverage_verdict,
    CASE WHEN n < 8 THEN 'NOT INTERPRETABLE' WHEN rho >= 0.166 THEN 'HEADLINE' ELSE 'NULL RESULT' END AS agreement_verdict FROM c"""))
def _(t):
    c = R.truth(t).groupBy("part").agg(F.avg((F.col("value") > 0).cast("double")).alias("cov"),
                                       F.avg("value").alias("rho"), F.count("*").alias("n"))
    return c.select("part", C.coverage_verdict("cov").alias("coverage_verdict"),
                    C.agreement_verdict(F.col("rho"), F.lit(0.1), F.col("n"), bar=0.166).alias("agreement_verdict"))


@register("prj22_unique_names", "p_partkey unique_name", "", """
    SELECT p_partkey, p_name || CASE WHEN rn > 1 THEN '.' || (rn - 1) ELSE '' END AS unique_name FROM
    (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)""")
def _(t):
    return C.unique_names(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey")


@register("prj23_sign_align", "yardstick method", "aligned", q("et", """
    SELECT 'mae' AS yardstick, method, -avg(abs(e - t)) AS aligned FROM et GROUP BY 2
    UNION ALL SELECT 'overlap', method, avg(least(e, t)) FROM et GROUP BY 2"""))
def _(t):
    et = aligned(t)
    scores = et.groupBy("method").agg(F.avg(F.abs(F.col("e") - F.col("t"))).alias("mae"),
                                      F.avg(F.least("e", "t")).alias("overlap"))
    long = scores.unpivot(["method"], ["mae", "overlap"], "yardstick", "score")
    rules = t.spark.createDataFrame([("mae", False), ("overlap", True)], "yardstick STRING, higher_is_better BOOLEAN")
    return C.sign_align(long, rules)


def aligned(t, *methods, beside=None, dealt=None):
    return R.paired(t, *methods, beside=beside, dealt=dealt)


@register("prj24_presence_mask", "method", "mae_masked n_masked", q("et", """
    SELECT method, avg(abs(CASE WHEN part IN ('SMALL', 'LARGE', 'PROMO') THEN e END - t)) AS mae_masked,
    count(CASE WHEN part IN ('SMALL', 'LARGE', 'PROMO') THEN e END) AS n_masked FROM et GROUP BY 1"""))
def _(t):
    e = C.presence_mask(TRIO, "e")
    return aligned(t).groupBy("method").agg(F.avg(F.abs(e - F.col("t"))).alias("mae_masked"), F.count(e).alias("n_masked"))


@register("prj25_log_contrast", "suppkey", "contrast", """
    SELECT l_suppkey AS suppkey, avg(log2(l_quantity + 1) - log2(l_tax + 1)) AS contrast FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("suppkey")).agg(C.log_contrast("l_quantity", "l_tax").alias("contrast"))


@register("prj26_unit_share_log", "cell feature", "lcpm", q("expr", """
    SELECT cell, feature, ln(1 + value / library * 1e6) AS lcpm FROM expr
    JOIN (SELECT cell, sum(value) AS library FROM expr GROUP BY 1) USING (cell)"""))
def _(t):
    x = R.cell_expr(t)
    return C.unit_share_log(x, x.groupBy("cell").agg(F.sum("value").alias("library")))
