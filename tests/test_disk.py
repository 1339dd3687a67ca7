"""What a step leaves in the shared folder and sends between tasks grows less than its rows."""

import os

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from partwise.operators import keys as K
from partwise.operators import packed
from partwise.operators import stats as ST


@pytest.fixture
def left_behind(spark):
    """MB that files in the checkpoint folder have grown by."""
    from partwise.session import cut_lineage

    cut_lineage(spark.range(1))
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def size():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(top) for f in files) / 1e6

    before = size()
    return lambda: size() - before


def test_columns_come_back_as_they_were_and_small():
    rng = np.random.default_rng(3)
    shares = np.round(np.where(rng.random(20_000) < 0.5, 0.0, rng.random(20_000)), 10)
    one = pa.table({"k": rng.choice(["a", "b", None], 20_000), "share": shares, "id": rng.integers(0, 1 << 40, 20_000),
                    "any": rng.normal(size=20_000), "some": [None if i % 7 == 0 else i * 1.5 for i in range(20_000)]})
    assert packed.unsqueezed(packed.squeezed(one), one.schema).equals(one)
    assert len(packed.squeezed(one.select(["share"]))) < 4 * 20_000
    odd = pa.table({"x": np.array([np.nan, np.inf, -np.inf, 0.1]), "y": np.array([1, -(2**63), 2**63 - 1, 0])})
    back = packed.unsqueezed(packed.squeezed(odd), odd.schema)
    assert np.array_equal(back["x"].to_numpy(), odd["x"].to_numpy(), equal_nan=True) and back["y"].equals(odd["y"])


def test_ranks_leave_no_rows_behind(spark, left_behind):
    frame = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    assert {r["n"] for r in ST.spearman(frame, ["g"], "x", "y").collect()} == {66_667, 66_666}
    assert left_behind() < 0.2


def test_stability_keeps_a_count_per_unit(spark, left_behind):
    rows = spark.range(60_000).select(F.lit("p").alias("part"), "id", F.explode(F.array(*[F.struct(
        F.lit(s).alias("s"), F.rand(s).alias("v")) for s in range(5)])).alias("z")).select("part", "id", "z.s", "z.v")
    got = ST.mean_pairwise_rank_r(rows, ["part"], "s", ["id"], "v").first()
    assert got["n_settings"] == 5 and got["n_units"] == 60_000 and abs(got["stability"]) < 0.02
    # Lists of the values took 16 bytes for each of 300,000 rows, and the ranked rows as much again.
    assert left_behind() < 2.5


def test_stability_in_several_strips_and_buckets(spark, monkeypatch):
    """Ties, a constant setting, a hot value, units twice and a unit without a setting."""
    from partwise.operators import strips

    monkeypatch.setattr(ST, "centred_ranks", lambda *given: strips.centred_ranks(*given, rows=37))
    monkeypatch.setattr(ST, "unit_products", lambda *given: strips.unit_products(*given, rows=23))
    rng = np.random.default_rng(4)
    values = {s: np.where(rng.random(150) < 0.4, 0.0, np.round(rng.random(150), 1 + s)) if s < 3 else np.ones(150) for s in range(4)}
    rows = [("p", s, f"u{u}", float(values[s][u])) for s in range(4) for u in range(150) if (s, u) != (1, 3)]
    rows += [("q", s, "one", 1.0) for s in range(2)]
    got = ST.mean_pairwise_rank_r(spark.createDataFrame(rows, "part string, s int, u string, v double").repartition(3), ["part"], "s", ["u"], "v").collect()
    from partwise.operators.permute import average_ranks

    whole = [u for u in range(150) if u != 3]
    r = [average_ranks(values[s][whole]) for s in range(3)]
    assert [(x["part"], x["n_settings"], x["n_units"]) for x in got] == [("p", 3, 149)]
    assert got[0]["stability"] == pytest.approx(np.mean([np.corrcoef(r[i], r[j])[0, 1] for i in range(3) for j in range(i)]))


def test_truth_meets_the_estimate_where_it_lies(spark):
    from partwise.catalog import roles as R
    from partwise.catalog.registry import Tables

    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0), (None, "a", 5.0), (1, None, 6.0)], "sample int, part string, value double")
    plain, met = (sorted(map(str, K.align(rows, rows, by=by).collect())) for by in (None, "sample"))
    assert plain == met and len(met) == 6
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = Tables(spark, SMALL)
        plan = K.align(R.estimates(t), R.truth(t), by="sample")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Lines and parts of both sides by part key, then once by order; no opened row is dealt.
    assert plan.count("Exchange hashpartitioning") == 6 and "hashpartitioning(sample" not in plan


def test_ranks_of_a_key_are_not_copied_for_each_block_of_draws(spark):
    from partwise.operators import permute as PM

    rows = [(k, i, float(i * p % 101), float(i * i % 97)) for k, p in (("a", 3), ("b", 7)) for i in range(90)]
    arrays = PM.rank_arrays(spark.createDataFrame(rows, "k STRING, i INT, x DOUBLE, y DOUBLE"), ["k"], "i", "x", "y", "s").coalesce(1).checkpoint()
    made = PM.array_products(arrays, ["k"], 120, "s")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan and made.rdd.getNumPartitions() == 3
    assert sorted(r["draw"] for r in made.where("k = 'a'").collect()) == list(range(1, 121))


def test_samples_of_a_patient_are_dealt_as_one_row(spark):
    from partwise.catalog.registry import Tables
    from partwise.catalog.resampling import patient_means

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = patient_means(Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = plan[:plan.index("Generate")]
    assert "Exchange" not in top and "Join" not in top


def test_tracking_leaves_no_rows_behind(spark, left_behind):
    from partwise.plans import studies

    frame = spark.range(60_000).select(F.lit("m").alias("method"), F.lit("p").alias("part"), F.col("id").alias("unit"), F.rand(1).alias("e"), F.rand(2).alias("t"))
    whole, strata = studies.tracking(frame, 50, "s")
    assert whole.first()["n"] == 60_000 and sorted(r["n"] for r in strata.collect()) == [20_000] * 3
    # What stays are two ranks of four bytes for each unit.
    assert left_behind() < 0.7


def test_columns_of_a_group_are_not_copied_for_each_block_of_draws(spark):
    from partwise.operators import auc_null as AN

    rng = np.random.default_rng(2)
    rows = [(i, "AB"[i % 2], "ab"[int(rng.integers(0, 2))]) for i in range(400)]
    cells = [("m", i, "p", float(rng.integers(0, 50))) for i in range(400)]
    made = AN.auc_draws(spark.createDataFrame(cells, "method STRING, sample INT, part STRING, value DOUBLE"),
                        spark.createDataFrame(rows, "sample INT, tumour STRING, structure STRING"), [("C", "pairwise", "p", ["a", "b"], [], 1.0)], 300, "s")
    plan = made._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("CartesianProduct"):]
    assert "Exchange" not in below and made.count() == 301


def test_ranks_keep_a_row_per_strip_not_per_cell(spark, monkeypatch):
    from partwise.operators import strips

    kept = []
    plain = strips.cut_lineage
    monkeypatch.setattr(strips, "cut_lineage", lambda df: kept.append(df.count()) or plain(df))
    rng = np.random.default_rng(6)
    x, y = rng.random((2, 6000))
    frame = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double").repartition(3).checkpoint()
    got = strips.rank_sums(frame, ["g"], "x", "y", 100).first()
    # 60 strips of x and of y have 3,600 cells; most of them held a row.
    assert max(kept) <= 2 * 2 * 61
    assert got["n"] == 6000 and got["_xy"] / got["_xx"] == pytest.approx(np.corrcoef(np.argsort(np.argsort(x)), np.argsort(np.argsort(y)))[0, 1])
