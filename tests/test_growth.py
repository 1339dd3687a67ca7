"""Steps whose cost grew faster than the input, or that dealt a table by a key of few values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.operators import fit as FT
from partwise.operators import keys as K


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_signature_products_never_deal_rows_by_part_or_feature(spark):
    sig = spark.createDataFrame([("f1", "A", 2.0), ("f1", "B", 3.0), ("f2", "A", 5.0), ("f2", "A", 1.0), ("f3", "C", 7.0), ("f4", "B", None)],
                                "feature STRING, part STRING, mean DOUBLE").checkpoint()
    shares = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.25), (2, "B", None), (2, "A", 1.0), (3, "Z", 9.0)], "sample INT, part STRING, value DOUBLE").checkpoint()
    made = K.matrix_product(sig, shares, ["sample"])
    assert {(r["feature"], r["sample"]): r["fitted"] for r in made.collect()} == {
        ("f1", 1): 1.75, ("f2", 1): 3.0, ("f4", 1): None, ("f1", 2): 2.0, ("f2", 2): 6.0, ("f4", 2): None}
    assert "hashpartitioning(part#" not in plan_of(made)
    bulk = spark.createDataFrame([("f1", 1, 1.0), ("f2", 1, 2.0)], "feature STRING, sample INT, value DOUBLE").checkpoint()
    eq = FT.normal_equations(sig, bulk, ["A", "B", "C"])
    assert eq.first()["rhs"] == [1.0 * 2 + 2.0 * 5, 3.0, 0.0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" not in plan_of(FT.normal_equations(sig, bulk, ["A", "B", "C"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def word(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_signs_are_made_once_for_all_keys(spark):
    from partwise.operators import resample as RS

    rng = np.random.default_rng(3)
    rows = [(k, i, None if (i + len(k)) % 7 == 0 else float(rng.normal())) for k in ("a", "bb") for i in range(40 if k == "a" else 25)]
    frame = spark.createDataFrame(rows, "k STRING, i INT, d DOUBLE")
    made = RS.sign_flip(frame, ["k"], "i", "d", 200, "s")
    assert "MapInArrow" in plan_of(made)
    for r in made.collect():
        own = [(i, d) for k, i, d in rows if k == r["k"] and d is not None]
        seen = np.mean([d for _, d in own])
        null = [np.mean([abs(d) if word(f"s|{draw}|{i}") % 2 == 0 else -abs(d) for i, d in own]) for draw in range(1, 201)]
        assert r["n_draws"] == 200 and r["observed"] == pytest.approx(seen) and r["null_mean"] == pytest.approx(np.mean(null))
        assert r["p_value"] == pytest.approx(np.mean([x >= seen - 1e-9 for x in null]))


@pytest.mark.parametrize("shared", [False, True])
def test_picks_are_counted_once_per_draw(spark, monkeypatch, shared):
    from partwise.operators import permute as PM

    monkeypatch.setattr(PM, "UNITS", 16)
    sizes = {"a": range(50), "b": range(50), "c": range(10, 50), "d": range(33)}
    rows = [(k, f"u{i}", float(i * len(sizes[k]) % 13), None if i % 9 == 4 else 1.0) for k in sizes for i in sizes[k]]
    frame = spark.createDataFrame(rows, "k STRING, i STRING, x DOUBLE, y DOUBLE")
    got = {(r["k"], r["draw"]): (r["size"], r["sums"]) for r in PM.resampled_sums(
        frame, ["k"], PM.roster(frame, ["k"]), "i", [F.lit(1.0), F.col("x"), F.col("x") * F.col("y")], 30, "s", shared=shared).collect()}
    assert len(got) == 4 * 30
    for k in sizes:
        units = sorted({f"u{i}" for i in (range(50) if shared else sizes[k])}, key=lambda u: (word(f"index|{u}"), u))
        own = {u: (1.0, x, x * (y or 0.0)) for kk, u, x, y in rows if kk == k}
        for draw in (1, 17, 30):
            taken = [units[word(f"s|{draw}|{slot}") % len(units)] for slot in range(len(units))]
            size, sums = got[k, draw]
            assert size == len(units)
            assert sums == pytest.approx(np.sum([own.get(u, (0.0, 0.0, 0.0)) for u in taken], axis=0))


def test_controls_are_summed_in_the_task(spark):
    from partwise.operators import resample as RS

    rows = [(i, i % 2, f"s{i % 3}") for i in range(60)]
    made = RS.control_means(spark.createDataFrame(rows, "sample INT, tumour INT, structure STRING"), ["A", "B", "C"], ["C", "A"], 12, "s")
    assert "MapInArrow" in plan_of(made)
    got = {tuple(r)[:5]: r["v"] for r in made.collect()}
    assert len(got) == 3 * 12 * 6 * 2
    weights = {"uniform": lambda u: u, "dirichlet": lambda u: -np.log(u), "spiked": lambda u: u**4}
    for draw in (1, 12):
        a, b = (word(f"s|a|{draw}") & 2147483647) % 2147483646 + 1, word(f"s|b|{draw}") & 2147483647
        shares = {g: {} for g in weights}
        for i, t, s in rows:
            u = []
            for place in range(3):
                x = ((word(f"s|{i}") & 2147483647) * a % 2147483647 + b + place * RS.CONTROL_STEP) & 2147483647
                for shift, times in RS.CONTROL_MIX:
                    x = (x ^ (x >> shift)) * times & 2147483647
                u.append(((x ^ (x >> 16)) + 1) / 2**31)
            for g, f in weights.items():
                w = [f(x) for x in u]
                shares[g].setdefault((t, s), []).append([x / sum(w) for x in w])
        for g in weights:
            for (t, s), all_shares in shares[g].items():
                for p, part in ((2, "C"), (0, "A")):
                    assert got[g, draw, t, s, part] == pytest.approx(np.mean([x[p] for x in all_shares]))


def test_keys_of_a_size_share_their_moves(spark, monkeypatch):
    from partwise.operators import permute as PM

    rows = [(k, i, float(i * p % 101), float(i * i % 97)) for k, p in (("a", 3), ("b", 7), ("c", 11)) for i in range(90)]
    frame = spark.createDataFrame(rows, "k STRING, i INT, x DOUBLE, y DOUBLE")
    arrays = PM.rank_arrays(frame, ["k"], "i", "x", "y", "s").toArrow()
    made = []
    plain = PM.permuted
    monkeypatch.setattr(PM, "permuted", lambda at, size, keys: made.append(len(at)) or plain(at, size, keys))
    # Rows too large to keep their moves: they are still made once for all three keys.
    monkeypatch.setattr(PM, "TABLE_BYTES", 1)
    batch = arrays.append_column("_first", [[1] * 3]).combine_chunks().to_batches()[0]
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

    schema = StructType().add("k", StringType()).add("draw", IntegerType()).add("p", DoubleType())
    got = [r for out in PM._products(["k"], schema, 50, "s")(iter([batch])) for r in out.to_pylist()]
    assert made == [90] and len(got) == 150
    moved = plain(np.arange(90), 90, PM.draw_keys("s", None, range(1, 51)))
    order = sorted(range(90), key=lambda i: (word(f"s|base|{i}"), i))
    for k, p in (("a", 3), ("b", 7), ("c", 11)):
        a, b = (PM.average_ranks(np.array([f(i) for i in order])) - 45.5 for f in (lambda i: i * p % 101, lambda i: i * i % 97))
        assert [r["p"] for r in got if r["k"] == k] == pytest.approx([a @ b[moved[:, d]] for d in range(50)])


def test_stability_keeps_one_row_per_unit(spark, monkeypatch):
    from partwise.operators import stats as ST
    from partwise.plans import studies

    kept = []
    for module in (ST, studies):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, plain=plain: kept.append((set(df.columns), df.count())) or plain(df))
    rng = np.random.default_rng(5)
    rows = [("p", s, u, float(rng.integers(0, 9)) + u) for u in range(40) for s in range(4) if not (s == 2 and u == 7)] + [("p", 0, None, 1.0)]
    got = studies.setting_stability(spark.createDataFrame(rows, "part STRING, s INT, u INT, v DOUBLE"), "s", ["u"], "v").first()
    assert got["n_settings"] == 4 and got["n_units"] == 39
    assert not any({"part", "s", "u", "v"} <= columns for columns, _ in kept) and ({"part", "u", "_v"}, 40) in kept
    by = [[v for _, s, u, v in rows if s == k and u not in (7, None)] for k in range(4)]
    from partwise.operators.permute import average_ranks

    r = [average_ranks(np.array(x)) for x in by]
    assert got["stability"] == pytest.approx(np.mean([np.corrcoef(r[i], r[j])[0, 1] for i in range(4) for j in range(i)]))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_columns_of_a_sample_are_joined_before_its_rows_are_opened(spark, no_broadcast):
    """Opened, a sample has a row for each part and method; a join by sample sorted them all."""
    from partwise.catalog import fits
    from partwise.catalog.aggregates import scored
    from partwise.catalog.registry import QUERIES, Tables
    SMALL = "/root/testdata/sf0.001"

    t = Tables(spark, SMALL)
    for df in (scored(t), fits.shares(t), QUERIES["agg22_multi_regression"](spark, SMALL)):
        lines = [(len(x) - len(x.lstrip(" :+-*(0123456789)")), x) for x in plan_of(df).split("\n")]
        for i, (depth, line) in enumerate(lines):
            below = next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))
            assert "SortMergeJoin" not in line or not any("Generate" in x for _, x in lines[i:below])


def test_sides_of_constraints_deal_no_rows_by_part_and_structure(spark, no_broadcast):
    from partwise.operators import stats as ST

    rows = spark.createDataFrame([("m", 1, "a", "P", 1.0), ("m", 1, "b", "P", 0.5), ("m", 1, "b", "P", 1.0)],
                                 "method STRING, tumour INT, structure STRING, part STRING, value DOUBLE").checkpoint()
    pairs = ST.constraint_pairs(spark, [("C", "pairwise", "P", ["a", "b"], [], 1.0)])
    got = ST.constraint_auc(rows, pairs, ["method"])
    assert "hashpartitioning(part#" not in plan_of(got) and got.first()["auc"] == 0.75


def test_a_grid_of_methods_holds_one_row_per_unit(spark):
    """The pivot held a row for each unit and method first."""
    est = spark.createDataFrame([("a", 1, "P", 1.0), ("b", 1, "P", 2.0), ("a", 1, "Q", None), ("a", 2, "P", 3.0)],
                                "method STRING, sample INT, part STRING, value DOUBLE")
    grid = K.method_grid(est, ["b", "a", "c"], ["sample", "part"])
    assert "method#" not in [x for x in plan_of(grid).split("\n") if "HashAggregate" in x][-1].split("functions")[0]
    assert sorted(map(tuple, grid.collect())) == [(1, "P", 2.0, 1.0, None), (1, "Q", None, None, None), (2, "P", None, 3.0, None)]


def test_audit_makes_its_verdicts_once_and_without_a_join_of_opened_rows(spark, monkeypatch):
    import __spark_entry__ as entry
    from conftest import SMALL
    from partwise.operators import score as S

    manifests = []
    usual = S.group_means
    monkeypatch.setattr(S, "group_means", lambda est, manifest, *rest, **more: manifests.append(manifest) or usual(est, manifest, *rest, **more))
    assert entry.queries()["agg47_control_audit"](spark, SMALL).count() == 1
    assert manifests == [None]
