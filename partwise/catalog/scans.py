"""Scans and sinks over files that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.catalog import roles as R
from partwise.catalog.registry import Tables, register
from partwise.catalog.roles import q
from partwise.functions.guards import ratio
from partwise.session import scratch_dir
from partwise.sources import scans, sinks

NATIONS = list(range(25))

BY_NATION = """SELECT p_brand AS feature, CAST(s_nationkey AS VARCHAR) AS sample, sum(l_quantity) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""


def by_nation(t: Tables):
    """brand x supplier nation, summed quantity: a matrix of bounded width."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("p_brand").alias("feature"), F.col("s_nationkey").cast("string").alias("sample")).agg(
        F.sum("l_quantity").alias("value"))


@register("src01_csv_matrix_scan", "feature sample", "value",
          f"""SELECT f.feature, n.sample, v.value FROM (SELECT DISTINCT p_brand AS feature FROM lineitem
          JOIN part ON l_partkey = p_partkey) f CROSS JOIN (SELECT CAST(unnest(range(25)) AS VARCHAR) AS sample) n
          LEFT JOIN ({BY_NATION}) v ON v.feature = f.feature AND v.sample = n.sample""")
def _(t):
    wide = by_nation(t).groupBy("feature").pivot("sample", [str(n) for n in NATIONS]).sum("value")
    path = sinks.write_table(wide, scratch_dir(t.spark, "matrix"), "csv", header=True)
    return scans.csv_matrix(t.spark, path)


@register("src02_tsv_reload_typed", "custkey segment", "acctbal",
          "SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer")
def _(t):
    src = t.customer.select(F.col("c_custkey").alias("custkey"), F.concat(F.lit(" "), "c_mktsegment").alias("segment"),
                            F.col("c_acctbal").alias("acctbal"))
    path = sinks.write_table(src, scratch_dir(t.spark, "tsv"), "csv", header=True, sep="\t")
    return scans.typed_reload(t.spark, path, ["custkey", "segment"], ["acctbal"])


@register("src03_gz_scan", "priority n_orders", "",
          "SELECT o_orderpriority AS priority, count(*) AS n_orders FROM orders GROUP BY 1")
def _(t):
    src = t.orders.select("o_orderkey", "o_orderpriority")
    open_ = F.col("o_orderkey") < 1000
    plain = sinks.write_table(src.where(open_), scratch_dir(t.spark, "plain"), "csv", header=True)
    packed = sinks.write_table(src.where(~open_), scratch_dir(t.spark, "gz"), "csv", header=True, compression="gzip")
    rows = scans.plain_or_gz(t.spark, [plain, packed], pieces=8)
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n_orders"))


@register("src04_many_files_one_table", "sample feature", "value",
          f"SELECT sample, feature, value FROM ({BY_NATION})")
def _(t):
    rows = by_nation(t)
    extra = rows.select("sample").distinct().select(F.lit("N_unmapped").alias("feature"), "sample",
                                                    F.lit(0.0).alias("value"))
    path = scratch_dir(t.spark, "files")
    rows.unionByName(extra).write.partitionBy("sample").csv(path, header=True, sep="\t")
    return scans.many_files(t.spark, path + "/*", r"sample=([^/]+)/", "feature STRING, value DOUBLE")


@register("src05_sparse_triplet_scan", "feature cell", "value",
          f"SELECT feature, sample AS cell, value FROM ({BY_NATION}) WHERE value > 0")
def _(t):
    rows = by_nation(t).where("value > 0")
    brands = t.part.select(F.col("p_brand").alias("name")).distinct().select(
        F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("index"), "name")
    nations = t.nation.select((F.col("n_nationkey") + 1).cast("bigint").alias("index"),
                              F.col("n_nationkey").cast("string").alias("name"))
    ij = rows.join(brands.select(F.col("name").alias("feature"), F.col("index").alias("i")), "feature").join(
        nations.select(F.col("name").alias("sample"), F.col("index").alias("j")), "sample")
    body = ij.select(F.lit(3).alias("o"), F.concat_ws(" ", "i", "j", "value").alias("value"))
    size = ij.agg(F.count("*").alias("n")).select(F.lit(2).alias("o"), F.concat(F.lit("25 25 "), "n").alias("value"))
    head = size.select(F.lit(1).alias("o"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value"))
    # One file, because the size line must come first; brands x nations bounds it.
    whole = head.unionByName(size).unionByName(body).coalesce(1).sortWithinPartitions("o").select("value")
    path = scratch_dir(t.spark, "triplets")
    whole.write.text(path)
    return scans.triplets(t.spark, path, brands, nations)


@register("src06_annotation_attribute_scan", "part symbol", "",
          """SELECT 'P' || p_partkey || '.' || (p_partkey % 3) AS part,
          CASE WHEN p_size > 5 THEN p_name END AS symbol FROM part""")
def _(t):
    line = F.concat_ws(
        "\t", F.lit("chr"), F.lit("src"), F.when(F.col("p_size") > 5, "gene").otherwise("exon"), F.lit("1"), F.lit("2"),
        F.lit("."), F.lit("+"), F.lit("."),
        F.concat(F.lit('gene_id "P'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "'), "p_name", F.lit('";')))
    path = scratch_dir(t.spark, "annotation")
    t.part.select(line.alias("value")).write.text(path)
    attrs = scans.annotation_attributes(t.spark, path)
    ids = t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("."),
                                 (F.col("p_partkey") % 3).cast("string")).alias("part"))
    return scans.symbol_lookup(ids, attrs, "part").select("part", "symbol")


@register("src07_headerless_table_scan", "user", "amount",
          """SELECT CAST(user_id AS VARCHAR) AS user, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS amount
          FROM events""")
def _(t):
    amount = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    src = t.events.select(F.col("user_id").cast("string").alias("user"), amount.alias("amount"))
    junk = src.groupBy().agg(F.lit("user id").alias("user"), F.lit("amount (units)").alias("amount"))
    path = sinks.write_table(src.unionByName(junk), scratch_dir(t.spark, "bare"), "csv", sep="\t")
    return scans.headerless(t.spark, path, "user STRING, amount STRING", junk="user id", number="amount")


@register("src08_json_leaf_scan", "event_id path scalar", "", """
    SELECT event_id, 'meta.pair.0' AS path, CAST(user_id AS VARCHAR) AS scalar FROM events
    UNION ALL SELECT event_id, 'meta.pair.1', event_type FROM events
    UNION ALL SELECT event_id, 'props.k', CAST(props->>'k' AS VARCHAR) FROM events""")
def _(t):
    doc = F.to_json(F.struct(
        F.struct(F.array(F.col("user_id").cast("string"), F.col("event_type")).alias("pair")).alias("meta"),
        F.from_json("props", "k BIGINT").alias("props")))
    return scans.json_leaves(t.events.select("event_id", doc.alias("doc")), "event_id", "doc")


@register("src09_csv_json_sinks", "method part", "mean_value",
          q("est", "SELECT method, part, avg(value) AS mean_value FROM est GROUP BY ALL"))
def _(t):
    table = R.estimates(t).groupBy("method", "part").agg(F.avg("value").alias("mean_value"))
    path = sinks.write_table(sinks.nested_report(table, ["method"], ["part", "mean_value"]),
                             scratch_dir(t.spark, "report"), "json")
    back = t.spark.read.schema("method STRING, report STRING").json(path)
    return back.select("method", F.from_json("report", "part STRING, mean_value DOUBLE").alias("r")).select(
        "method", "r.part", "r.mean_value")


@register("src10_gene_subset_export", "cell part n_features", "total", q("expr cells", """
    WITH part_expr AS (SELECT cell, feature, greatest(value - 1.2, 0) AS value FROM expr WHERE feature < 8),
    alive AS (SELECT cell FROM part_expr GROUP BY cell HAVING sum(value) > 0)
    SELECT c.cell, c.part, count(*) AS n_features, sum(p.value) AS total
    FROM part_expr p JOIN alive USING (cell) JOIN cells c USING (cell) GROUP BY ALL"""))
def _(t):
    counts = R.cell_expr(t).withColumn("value", F.greatest(F.col("value") - 1.2, F.lit(0.0)))
    wanted = t.region.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("feature")).distinct()
    part, meta = sinks.feature_subset(counts, R.cells(t), wanted)
    return part.join(meta, "cell").groupBy("cell", meta["part"]).agg(
        F.count("*").alias("n_features"), F.sum("value").alias("total"))


@register("src11_streaming_row_pick", "rows_seen rows_kept keys_found cells_missing", "", """
    SELECT count(*) AS rows_seen, CAST(sum(CASE WHEN p_size <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS rows_kept,
    count(DISTINCT CASE WHEN p_size <= 5 THEN l_partkey END) AS keys_found,
    CAST(sum(CASE WHEN p_size <= 5 AND l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cells_missing
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    wanted = t.part.where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    src = t.lineitem.withColumn("d", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return scans.pick_summary(src, wanted, "l_partkey", "d")


@register("src12_upsert_by_method", "method part", "score", q("est", """
    SELECT method, part, avg(value) * CASE WHEN method IN ('net', 'control') THEN 2 ELSE 1 END AS score
    FROM est GROUP BY method, part"""))
def _(t):
    mean = lambda ms: R.estimates(t, *ms).groupBy("method", "part").agg(F.avg("value").alias("score"))
    old = mean(["price", "lines", "net"])
    new = mean(["net", "control"]).withColumn("score", F.col("score") * 2)
    return sinks.upsert(old, new, "method")
