"""The keyed bijection and the nulls built on it, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.operators import auc_null as AN
from partwise.operators import permute as PM
from partwise.operators import resample as RS
from partwise.operators import score as S

CONSTRAINTS = [("C1", "pairwise", "p", ["a", "b"], [], 1.0), ("C2", "maximum", "q", ["b"], ["a", "b", "c"], 2.0),
               ("C3", "monotone", "p", ["a", "b", "c"], [], 1.0), ("C4", "pairwise", "q", ["a", "z"], [], 1.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 4097])
def test_moves_are_one_to_one(n):
    keys = PM.draw_keys("seed", "group", range(1, 40))
    moved = PM.permuted(np.arange(n), n, keys)
    assert (np.sort(moved, axis=0) == np.arange(n)[:, None]).all()
    assert (PM.permuted(np.array([n - 1, 0]), n, keys) == moved[[n - 1, 0]]).all()


def test_both_word_sizes_agree():
    keys = PM.draw_keys("seed", None, range(1, 20))
    narrow = PM.permuted(np.arange(1000), 1000, keys)
    x = np.repeat(np.arange(1000)[:, None], len(keys), axis=1)
    k, rounds = keys % PM.PRIME, []
    for a, b in PM.round_numbers():
        turn, offset = (k * a + b) % PM.PRIME, (k * b + a) % PM.PRIME
        rounds.append((turn * turn % PM.PRIME % 1000, offset * offset % PM.PRIME))
    PM._wide(x, 1000, rounds)
    assert (x == narrow).all()
    far = PM.permuted(np.array([0, 2**31 + 5, 2**32 - 1]), 2**32, keys)
    assert ((0 <= far) & (far < 2**32)).all() and len(np.unique(far[:, 0])) == 3


def test_orders_are_even():
    """All 24 orders of four positions, and all pairs of places of 30, come up about equally often."""
    moved = PM.permuted(np.arange(4), 4, PM.draw_keys("even", None, range(48_000)))
    _, n = np.unique(moved.T, axis=0, return_counts=True)
    assert len(n) == 24 and ((n - 2000) ** 2 / 2000).sum() < 23 + 5 * math.sqrt(46)
    moved = PM.permuted(np.array([3, 17]), 30, PM.draw_keys("pairs", None, range(87_000)))
    _, n = np.unique(moved[0] * 30 + moved[1], return_counts=True)
    assert len(n) == 870 and abs(((n - 100) ** 2 / 100).sum() - 869) < 5 * math.sqrt(2 * 869)


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(4)
    samples = [(i, "big" if i % 3 else f"t{i % 4}", rng.choice(["a", "b", "c", None])) for i in range(240)]
    est = [(m, i, p, None if rng.random() < 0.1 else rng.choice([0.0, 0.25, round(rng.random(), 6)]))
           for m in ("m1", "m2") for i in range(0, 240) for p in ("p", "q") if rng.random() < 0.9]
    return (samples, est, spark.createDataFrame(samples, "sample long, tumour string, structure string").repartition(5),
            spark.createDataFrame(est, "method string, sample long, part string, value double").repartition(7))


def plain_labels(samples, seed, draws):
    """Labels of each draw by the bijection, group by group."""
    out = {0: {i: s for i, _, s in samples if s is not None}}
    groups = {}
    for i, t, s in samples:
        if s is not None:
            groups.setdefault(t, []).append((i, s))
    for t, rows in groups.items():
        rows.sort(key=lambda r: (int(PM.hashlib.md5(f"{seed}|base|{r[0]}".encode()).hexdigest()[:8], 16), r[0]))
        labels = sorted(s for _, s in rows)
        moved = PM.permuted(np.arange(len(rows)), len(rows), PM.draw_keys(seed, t, range(1, draws + 1)))
        for d in range(1, draws + 1):
            for k, (i, _) in enumerate(rows):
                out.setdefault(d, {})[i] = labels[moved[k, d - 1]]
    return out


def test_labels_keep_counts(study):
    samples, _, frame, _ = study
    got = {}
    for r in PM.permute_labels(frame, ["tumour"], "structure", "sample", 6, "s").collect():
        got.setdefault(r["draw"], {})[r["sample"]] = r["structure"]
    plain = plain_labels(samples, "s", 6)
    assert got == {d: plain[d] for d in range(1, 7)}
    tumour = {i: t for i, t, _ in samples}
    count = lambda d: sorted((tumour[i], s) for i, s in d.items())
    assert all(count(plain[0]) == count(d) for d in plain.values()) and plain[1] != plain[2]


def test_score_draws_equal_means_of_shuffled_labels(study, spark):
    samples, est, frame, values = study
    terms = S.constraint_terms(spark, CONSTRAINTS)
    got = {(r["tumour"], r["draw"], r["method"]): (r["num"], r["den"])
           for r in PM.score_draws(values, frame, terms, 5, "s", digits=9).collect()}
    plain = plain_labels(samples, "s", 5)
    manifest = spark.createDataFrame([(d, i, t, plain[d][i]) for d in plain for i, t, s in samples if s is not None],
                                     "draw int, sample long, tumour string, structure string")
    means = S.group_means(values, manifest, ["method", "draw", "tumour", "structure", "part"], digits=9)
    want = {(r["tumour"], r["draw"], r["method"]): (r["num"], r["den"])
            for r in S.weigh(S.verdicts(means, terms, ["method", "draw", "tumour"]), ["method", "draw", "tumour"]).collect()}
    assert got == want and len(want) > 50


def test_auc_draws_equal_all_pairs(study, spark):
    samples, est, frame, values = study
    got = {(r["method"], r["draw"]): r["stat"] for r in AN.auc_draws(values, frame, CONSTRAINTS, 4, "s", rows=7).collect()}
    plain = plain_labels(samples, "s", 4)
    tumour = {i: t for i, t, _ in samples}
    for m in ("m1", "m2"):
        for d in range(5):
            num = den = 0.0
            for _, weight, part, least, pairs in AN.sides_of(CONSTRAINTS):
                for t in sorted(set(tumour.values())):
                    side = lambda s: [v for a, i, p, v in est if a == m and p == part and v is not None and tumour[i] == t and plain[d].get(i) == s]
                    aucs = [np.mean([(h > lo) + 0.5 * (h == lo) for h in side(x) for lo in side(y)]) for x, y in pairs if side(x) and side(y)]
                    if len(aucs) >= least:
                        num, den = num + weight * np.mean(aucs), den + weight
            assert got[m, d] == pytest.approx(num / den, abs=1e-12)


def test_spearman_rows_and_arrays_agree(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.choice([1.0, 2.0, rng.random()]), rng.choice([0.5, rng.random()])) for k, n in (("u", 60), ("v", 60), ("w", 31)) for i in range(n)]
    frame = spark.createDataFrame(rows + [("u", 900, None, 1.0)], "k string, i long, x double, y double").repartition(3)
    arrays = {tuple(r)[:2]: (r["rho"], r["p_value"]) for r in RS.permutation_spearman(frame, ["k"], "i", "x", "y", 99, "s").collect()}
    mixed = {tuple(r)[:2]: (r["rho"], r["p_value"]) for r in RS.permutation_spearman(frame, ["k"], "i", "x", "y", 99, "s", dense_units=40).collect()}
    assert set(arrays) == {("u", 60), ("v", 60), ("w", 31)} == set(mixed)
    for k in arrays:
        assert arrays[k] == pytest.approx(mixed[k], abs=1e-12)
        x, y = zip(*[(PM.average_ranks(np.array([r[2] for r in rows if r[0] == k[0]]))[j], PM.average_ranks(np.array([r[3] for r in rows if r[0] == k[0]]))[j])
                     for j in range(k[1])])
        assert arrays[k][0] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


def test_a_planted_difference_is_found(spark):
    rows = [(i, f"g{i % 3}", i % 2 == 0, (1.0 if i % 2 == 0 else 0.0) + (i * 37 % 101) / 100, 5.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "i long, g string, flag boolean, v double, other double")
    long = frame.select("i", "g", "flag", F.explode(F.array(F.struct(F.lit("real").alias("c"), F.col("v").alias("x")), F.struct(F.lit("none").alias("c"), F.lit(1.0).alias("x")))).alias("e")).select("i", "g", "flag", "e.*")
    got = {r["c"]: r for r in RS.mean_difference_null(long, ["g"], "flag", "i", "x", 400, "s", ["c"]).collect()}
    assert got["real"]["p_value"] == pytest.approx(1 / 401) and abs(got["real"]["null_mean"]) < 0.05
    assert got["none"]["p_value"] == 1.0 and got["none"]["observed"] == 0


def test_ranks_in_arrays_and_in_ranges_agree(spark):
    from partwise.operators import stats as ST

    rng = random.Random(11)
    rows = [(k, rng.choice([0.0, 0.0, rng.random()]), rng.choice([1.0, rng.random()])) for k, n in (("u", 300), ("v", 40), (None, 9), ("w", 2)) for _ in range(n)]
    frame = spark.createDataFrame(rows + [("u", None, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0)], "k string, x double, y double").repartition(4)
    got = {r["k"]: (r["n"], r["rho"]) for r in ST.spearman(frame, ["k"], "x", "y").collect()}
    mixed = {r["k"]: (r["n"], r["rho"]) for r in ST.spearman(frame.where("k IS NOT NULL"), ["k"], "x", "y", dense_points=50).collect()}
    assert got["flat"] == (3, None) and got["w"] == (2, None) and got[None][0] == 9
    assert set(mixed) == {k for k in got if k is not None}
    assert all(mixed[k][0] == got[k][0] and mixed[k][1] == (got[k][1] if got[k][1] is None else pytest.approx(got[k][1], abs=1e-12)) for k in mixed)
    for k, n in (("u", 300), ("v", 40)):
        x, y = (PM.average_ranks(np.array([r[i] for r in rows if r[0] == k])) for i in (1, 2))
        assert got[k] == (n, pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12))


def test_resampled_means_of_rows_and_arrays_agree(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.gauss(0.4, 1)) for k, n in (("u", 50), ("v", 20), ("w", 50)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, i long, d double").repartition(3)
    got = {r["k"]: r.asDict() for r in RS.paired_difference(frame, ["k"], "i", "d", 120, "s").collect()}
    mixed = {r["k"]: r.asDict() for r in RS.paired_difference(frame, ["k"], "i", "d", 120, "s", dense_units=30).collect()}
    for k in "uvw":
        assert all(got[k][c] == pytest.approx(mixed[k][c], abs=1e-12) for c in ("mean", "n", "ci_low", "ci_high", "p_value"))
    for k, n in (("u", 50), ("v", 20)):
        order = sorted((int(PM.hashlib.md5(f"index|{i}".encode()).hexdigest()[:8], 16), i, d) for kk, i, d in rows if kk == k)
        stats = [np.mean([order[p][2] for p in PM.picked(n, "s", [d])[0]]) for d in range(1, 121)]
        assert got[k]["ci_low"] == pytest.approx(np.quantile(stats, 0.025), abs=1e-12)
        assert got[k]["p_value"] == pytest.approx(2 * min(np.mean(np.array(stats) <= 0), np.mean(np.array(stats) >= 0)))


def test_labels_are_looked_up_as_they_are_walked(spark, monkeypatch):
    """Columns with few, many and no ties, missing values, a structure that a group lacks, and values longer than a chunk."""
    rng = np.random.default_rng(8)
    rows = [(i, "A" if i < 2600 else "B", "abcde"[int(rng.integers(0, 5 if i < 2600 else 2))]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "sample INT, tumour STRING, structure STRING").checkpoint()
    pick = {"distinct": lambda: float(rng.random()), "some": lambda: float(rng.integers(0, 1500)), "heavy": lambda: float(max(0, rng.integers(-9, 5)))}
    cells = [(m, i, p, None if rng.random() < 0.05 else f()) for m, f in pick.items() for i in range(3000) for p in {c[2] for c in CONSTRAINTS}]
    values = spark.createDataFrame(cells, "method STRING, sample INT, part STRING, value DOUBLE").checkpoint()
    calls = []
    usual = AN._walked
    monkeypatch.setattr(AN, "_walked", lambda *given: calls.append(1) or usual(*given))
    got = {}
    for dense in (0, 1000, 10_000):
        made = AN.auc_draws(values, frame, CONSTRAINTS, 300, "s", dense_samples=dense)
        got[dense] = {(r["method"], r["draw"]): r["stat"] for r in made.collect()}
        assert len(calls) == (1 if dense == 0 else 2)
    assert len(got[0]) == 3 * 301
    for dense in (1000, 10_000):
        assert got[dense].keys() == got[0].keys()
        assert all(abs(got[dense][k] - got[0][k]) < 1e-12 for k in got[0])
