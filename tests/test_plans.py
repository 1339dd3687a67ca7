"""Plans stay free of cross joins and scans stay narrow."""

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from partwise.operators import ensembles as E
from partwise.plans import studies


@pytest.mark.parametrize("name", ["joi13_constraint_cross_join", "agg07_per_group_breakdown", "agg17_spearman", "agg27_pair_auc",
                                  "res01_within_group_label_permutation", "joi12_method_pairs"])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_used_columns(spark):
    plan = entry.queries()["agg06_constraint_score"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_tax" not in plan


def test_central_method_tracks_truth_when_planted(spark):
    rng = np.random.default_rng(4)
    truth = rng.random(60)
    rows = [("k", m, i, float(truth[i] + s * rng.normal()), float(truth[i]))
            for m, s in (("a", 0.01), ("b", 0.1), ("c", 0.4), ("d", 3.0)) for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["key", "method", "unit", "value", "t"]))
    row = E.centrality_vs_truth(df, ["a", "b", "c", "d"], ["unit"], ["key"]).first()
    assert row["n"] == 4 and row["rho"] > 0.7


def test_stability_equals_the_mean_over_pairs(spark):
    """Five settings with ties, missing values, a constant and a repeated one."""
    rng = np.random.default_rng(4)
    rows, tables = [], {}
    for part in ("A", "B"):
        base = rng.normal(size=60)
        table = np.stack([base, np.round(base, 1), base + rng.normal(size=60), -base + rng.normal(size=60), np.ones(60) if part == "B" else rng.normal(size=60)])
        table[2, :5] = np.nan
        tables[part] = table
        for s, values in enumerate(np.concatenate([table, table[:1]])):
            rows += [(part, s, u, None if np.isnan(x) else float(x)) for u, x in enumerate(values)]
    df = spark.createDataFrame(rows, "part STRING, setting INT, unit INT, v DOUBLE")
    got = {r["part"]: r for r in studies.setting_stability(df, "setting", ["unit"], "v").collect()}
    for part, table in tables.items():
        whole = pd.DataFrame(table[:, 5:].T)
        whole = whole.loc[:, whole.nunique() > 1].rank()
        r = whole.corr().to_numpy()
        n = len(r)
        assert got[part]["n_settings"] == n and got[part]["n_units"] == 55
        assert abs(got[part]["stability"] - (r.sum() - n) / (n * (n - 1))) < 1e-9
