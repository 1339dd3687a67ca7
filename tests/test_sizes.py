"""One definition at every size: no caps, no switches, no hidden limits."""

import math

import pytest
from pyspark.sql import functions as F

from partwise.functions import text as T
from partwise.operators import metrics as M
from partwise.operators import ranks, stats
from partwise.sources import scans


def test_texts_behind_one_prefix_use_every_range(spark):
    rows = spark.range(200_000).select(F.lit("g").alias("k"), F.format_string("TCGA-02-%06d", F.col("id")).alias("v"))
    tally = rows.groupBy("k", "v").agg(F.count("*").alias("w"))
    placed = tally.withColumn("_b", ranks.range_bounds(tally, "v", ["w"]).getField("cuts"))
    sizes = [r["count"] for r in placed.groupBy(ranks._range_index(F.col("_b"), F.col("v"), 8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    got = ranks.value_ranks(rows, ["k"], "v")
    assert got.where(F.col("before") != F.substring("v", 9, 6).cast("int")).count() == 0


@pytest.mark.parametrize("cells", [(3, 1, 1, 3), (0, 5, 5, 0), (10, 2, 3, 15), (7, 7, 7, 7), (0, 0, 0, 4), (1, 900, 40, 20_000)])
def test_fisher_against_all_tables(spark, cells):
    a, b, c, d = cells
    n, r, k = a + b + c + d, a + b, a + c
    chance = {x: math.comb(r, x) * math.comb(n - r, k - x) for x in range(max(0, k - (n - r)), min(r, k) + 1)}
    want = sum(p for p in chance.values() if p <= chance[a] * (1 + 1e-7)) / math.comb(n, k)
    got = spark.createDataFrame([cells], "a long, b long, c long, d long").select(M.fisher("a", "b", "c", "d").alias("p")).first()[0]
    assert got == pytest.approx(want, rel=1e-6)


def test_fisher_of_a_very_large_table(spark):
    cells = (260_000, 250_000, 250_000, 259_000)
    got = spark.createDataFrame([cells], "a long, b long, c long, d long").select(M.fisher("a", "b", "c", "d").alias("p")).first()[0]
    a, b, c, d = cells
    chi = (a * d - b * c) ** 2 * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d))
    assert got == pytest.approx(math.erfc(math.sqrt(chi / 2)), rel=0.05, abs=1e-12)


def test_rank_sum_one_sided(spark):
    rows = [(True, 5.0), (True, 6.0), (True, 7.0), (False, 1.0), (False, 2.0), (False, 3.0), (False, 6.5)]
    row = stats.rank_sum(spark.createDataFrame(rows, "f boolean, v double"), [], "f", "v").first()
    assert row["exact"] and row["p_greater"] == pytest.approx(4 / 35) and row["p_value"] == pytest.approx(8 / 35)
    row = stats.rank_sum(spark.createDataFrame(rows, "f boolean, v double"), [], "f", "v", exact_cells=1).first()
    assert not row["exact"] and 0.08 < row["p_greater"] < 0.16


def test_concordance_with_equal_times(spark):
    rows = [("a", 1.0, 1, 3.0), ("a", 1.0, 0, 1.0), ("a", 2.0, 1, 2.0), ("a", 2.0, 1, 2.5), ("a", 2.0, 0, 2.0), ("a", 3.0, 0, 9.0)]
    def brute(rs):
        comparable = good = tied = 0
        for _, t1, e1, r1 in rs:
            for _, t2, e2, r2 in rs:
                if e1 == 1 and (t1 < t2 or (t1 == t2 and e2 == 0)):
                    comparable, good, tied = comparable + 1, good + (r1 > r2), tied + (r1 == r2)
        return comparable, good, tied
    df = spark.createDataFrame(rows, "k string, t double, e int, r double")
    for keys in (["k"], []):
        got = stats.censored_concordance(df, keys, "t", "e", "r").first()
        assert (got["comparable"], got["concordant"], got["tied"]) == brute(rows)


def test_event_codings(spark):
    number = spark.createDataFrame([(1.0,), (0.0,), (None,), (float("nan"),)], "e double")
    assert [r[0] for r in number.select(T.event_flag("e").alias("x")).collect()] == [1.0, 0.0, None, None]
    whole = spark.createDataFrame([(1,), (0,), (None,)], "e int")
    assert [r[0] for r in whole.select(T.event_flag("e").alias("x")).collect()] == [1.0, 0.0, None]
    words = spark.createDataFrame([("Dead",), ("alive",), ("1:DECEASED",), ("0:LIVING",), ("unknown",)], "e string")
    assert [r[0] for r in words.select(T.event_flag("e").alias("x")).collect()] == [1.0, 0.0, 1.0, 0.0, None]
    with pytest.raises(Exception, match="an event is 0 or 1"):
        spark.createDataFrame([(2.0,)], "e double").select(T.event_flag("e").alias("x")).collect()


def test_json_of_any_depth(spark):
    deep = "7"
    for i in range(11):
        deep = '{"k": %s}' % deep if i % 2 else "[%s]" % deep
    rows = spark.createDataFrame([(1, deep), (2, '{"a": [1, {"b": "x"}], "c": null}'), (3, "5")], "i int, t string")
    got = {(r["i"], r["path"]): r["scalar"] for r in scans.json_leaves(rows, "i", "t", at_once=2).collect()}
    assert got[1, "0.k.0.k.0.k.0.k.0.k.0"] == "7" and got[2, "a.1.b"] == "x" and got[2, "a.0"] == "1" and got[3, ""] == "5"


def test_very_wide_matrix(spark, tmp_path):
    names = [f"s{i}" for i in range(21_000)]
    (tmp_path / "wide.csv").write_text("gene," + ",".join(names) + "\ng1," + ",".join("1" for _ in names) + "\n")
    head = spark.read.csv(str(tmp_path / "wide.csv"), header=True, maxColumns=30_000)
    assert len(head.columns) == 21_001
    assert len(scans.csv_matrix.__defaults__) == 3 and scans.csv_matrix.__defaults__[-1] > 1_000_000
