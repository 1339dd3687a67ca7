"""The split-rank routines against plain definitions, with ties, hot groups and tiny groups."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partwise.functions.draws import hash32
from partwise.operators import ranks as R
from partwise.operators import stats as ST


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    p = pd.DataFrame({
        "g": rng.choice(["hot", "mid", "tiny"], 240, p=[0.8, 0.17, 0.03]), "x": rng.integers(0, 25, 240).astype(float),
        "y": rng.integers(0, 25, 240).astype(float)})
    p["id"] = range(len(p))
    p["ev"] = (rng.random(240) < 0.6).astype(float)
    return p


def test_average_rank_and_percent(spark, table):
    df = spark.createDataFrame(table)
    got = R.attach_rank(R.attach_rank(df, ["g"], "x"), ["g"], "x", "pct", "pct").toPandas().set_index("id").sort_index()
    want = table.groupby("g").x
    assert np.allclose(got["rank"], want.rank())
    assert np.allclose(got["pct"], want.rank(pct=True))


def test_quantiles_interpolate(spark, table):
    got = R.quantiles(spark.createDataFrame(table), ["g"], "x", [0.1, 0.5, 0.9], ["a", "b", "c"]).toPandas().set_index("g").sort_index()
    want = table.groupby("g").x.quantile([0.1, 0.5, 0.9]).unstack().sort_index()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(float), want.to_numpy())


def test_one_group_of_equal_values(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 6, "x": [2.0] * 6, "id": range(6)}))
    assert {r["rank"] for r in R.attach_rank(df, ["g"], "x").collect()} == {3.5}


def test_missing_values_get_no_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "g STRING, x DOUBLE")
    got = {r["x"]: r["rank"] for r in R.attach_rank(df, ["g"], "x").collect()}
    assert got == {1.0: 1.0, 3.0: 2.0, None: None}


def test_text_values_rank_in_byte_order(spark):
    names = ["b", "a", "abcdefgh1", "abcdefgh2", "Z", "é"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING").withColumn("one", F.lit(1))
    got = {r["n"]: r["before_one"] for r in R.prefix_sums(df, [], "n", ["one"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(names, key=lambda s: s.encode())


def test_positions_are_a_permutation_when_a_group_is_cut(spark, table):
    df = spark.createDataFrame(table).withColumn("size", F.lit(240))
    got = R.hash_positions(df, ["g"], "id", hash32(F.lit("s"), "id"), "size", chunk=40).toPandas()
    for _, b in got.groupby("g"):
        assert sorted(b.pos) == list(range(1, len(b) + 1))


def test_pair_counts_match_all_pairs(spark, table):
    got = R.pair_counts(spark.createDataFrame(table), ["g"], "x", "y").toPandas().set_index("g")
    for g, b in table.groupby("g"):
        c = d = 0
        for i, j in combinations(range(len(b)), 2):
            s = np.sign(b.x.iloc[i] - b.x.iloc[j]) * np.sign(b.y.iloc[i] - b.y.iloc[j])
            c, d = c + (s > 0), d + (s < 0)
        assert (got.loc[g, "concordant"], got.loc[g, "discordant"]) == (c, d)


def test_censored_concordance_matches_all_pairs(spark, table):
    got = ST.censored_concordance(spark.createDataFrame(table), ["g"], "x", "ev", "y").toPandas().set_index("g")
    for g, b in table.groupby("g"):
        n = hit = tie = 0
        for i in range(len(b)):
            for j in range(len(b)):
                if b.ev.iloc[i] == 1 and (b.x.iloc[i] < b.x.iloc[j] or b.x.iloc[i] == b.x.iloc[j] and b.ev.iloc[j] == 0):
                    n += 1
                    hit += b.y.iloc[i] > b.y.iloc[j]
                    tie += b.y.iloc[i] == b.y.iloc[j]
        assert (got.loc[g, "comparable"], got.loc[g, "concordant"], got.loc[g, "tied"]) == (n, hit, tie)


def test_spearman_and_constant_input(spark, table):
    p = table.assign(c=1.0)
    got = ST.spearman(spark.createDataFrame(p), ["g"], "x", "y").toPandas().set_index("g")
    for g, b in p.groupby("g"):
        assert got.loc[g, "rho"] == pytest.approx(np.corrcoef(b.x.rank(), b.y.rank())[0, 1], abs=1e-12)
    flat = ST.spearman(spark.createDataFrame(p), ["g"], "x", "c").collect()
    assert all(r["rho"] is None for r in flat)


def test_exact_rank_sum_counts_orderings(spark):
    a, b = [1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0]
    df = spark.createDataFrame([(True, v) for v in a] + [(False, v) for v in b], "f BOOLEAN, v DOUBLE")
    row = ST.rank_sum(df, [], "f", "v").first()
    values = sorted(a + b)
    us = [sum(x > y for x in s for y in values if y not in s) for s in combinations(values, 3)]
    u = sum(x > y for x in a for y in b)
    tail = np.mean([min(x, 12 - x) <= min(u, 12 - u) for x in us])
    assert row["u"] == u and row["p_value"] == pytest.approx(min(1.0, tail), abs=1e-12)


def test_sign_test_is_the_binomial_sum(spark):
    from math import comb

    df = spark.createDataFrame([(i < 9,) for i in range(11)], "up BOOLEAN")
    row = ST.sign_test(df, [], F.col("up")).first()
    assert row["p_value"] == pytest.approx(2 * sum(comb(11, i) for i in range(3)) / 2**11)


def test_regression_matches_lstsq(spark, table):
    rng = np.random.default_rng(0)
    p = table.assign(z=0.3 * table.x - 0.1 * table.y + rng.normal(size=len(table)))
    got = ST.regression(spark.createDataFrame(p), ["g"], ["x", "y"], "z").toPandas()
    for g, b in p.groupby("g"):
        m = np.column_stack([np.ones(len(b)), (b.x - b.x.mean()) / b.x.std(ddof=0), (b.y - b.y.mean()) / b.y.std(ddof=0)])
        want = np.linalg.lstsq(m, b.z, rcond=None)[0]
        mine = got[got.g == g].set_index("factor").beta
        assert np.allclose([mine["x"], mine["y"]], want[1:])


def test_strips_match_all_pairs_and_plain_ranks(spark):
    """Hot values, ties, NaN, missing keys, whole numbers and groups of one row, in strips of a few rows."""
    from partwise.operators import strips

    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 300), (None, 120), ("b", 40), ("c", 1)):
        x = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.random(n), 2))
        rows += [(g, float(v), int(w)) for v, w in zip(x, np.where(rng.random(n) < 0.3, 5, rng.integers(0, 60, n)))]
    rows += [("a", float("nan"), 7), ("a", float("nan"), 70), ("a", 0.5, None)]
    frame = spark.createDataFrame(rows, "g string, x double, y long").repartition(3)
    whole = frame.where("y IS NOT NULL")
    for few in (7, 1000):
        got = {r["g"]: r["discordant"] for r in R.pair_counts(frame, ["g"], "x", "y", few).collect()}
        rho = {r["g"]: r for r in strips.rank_sums(whole, ["g"], "x", "y", few).collect()}
        assert set(got) == {"a", "b", "c"} and set(rho) == {"a", "b", "c", None}
        for g in rho:
            b = pd.DataFrame([(9.0 if np.isnan(x) else x, y) for k, x, y in rows if k == g and y is not None], columns=["x", "y"])
            d = np.sign(b.x.values[:, None] - b.x.values) * np.sign(b.y.values[:, None] - b.y.values)
            assert g is None or got[g] == (d < 0).sum() / 2
            p, q = (b[c].rank() - (len(b) + 1) / 2 for c in "xy")
            assert tuple(rho[g])[1:] == pytest.approx((len(b), (p * q).sum(), (p * p).sum(), (q * q).sum()), abs=1e-6)


def test_rows_of_a_task_and_rows_made_are_bounded(spark):
    """No row per bit of a rank, no value counted in a map of its own, no key as one list."""
    frame = spark.range(400).selectExpr("id % 3 AS g", "CAST(id * 37 % 101 AS double) AS x", "CAST(id * 53 % 211 AS double) AS y")
    text = R.pair_counts(frame, ["g"], "x", "y")._jdf.queryExecution().toString()
    assert "Generate" not in text and "explode" not in text
    text = ST.spearman(frame, ["g"], "x", "y")._jdf.queryExecution().toString()
    assert "collect_list" not in text
