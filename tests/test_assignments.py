"""Folds, ordered certificates and blends of references against plain sequential versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from partwise.operators import diff as D
from partwise.operators import fit as FT
from partwise.operators import profiles as P


def h32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def plain_folds(sizes, k, seed):
    loads, out = [0] * k, {}
    for p, n in sorted(sizes.items(), key=lambda x: (-x[1], h32(seed, x[0]), x[0])):
        f = loads.index(min(loads))
        out[p], loads[f] = f, loads[f] + n
    return out, loads


@pytest.mark.parametrize("kind", ["skewed", "equal", "giant", "few"])
def test_lightest_fold(spark, kind):
    rng = random.Random(3)
    sizes = {"skewed": {i: int(rng.paretovariate(0.8)) for i in range(700)}, "equal": {i: 4 for i in range(103)},
             "giant": {0: 10_000, **{i: rng.randint(1, 3) for i in range(1, 400)}}, "few": {1: 7, 2: 7}}[kind]
    frame = spark.createDataFrame([(p, n, "x") for p, n in sizes.items()], "patient long, n long, note string").repartition(3)
    got = P.assign_folds(frame, 5, "s")
    assert got.columns == ["patient", "n", "note", "fold"]
    want, loads = plain_folds(sizes, 5, "s")
    rows = got.collect()
    assert {r["patient"]: r["fold"] for r in rows} == want
    assert sorted(sum(r["n"] for r in rows if r["fold"] == f) for f in range(5)) == sorted(loads)
    if kind == "giant":
        # Nothing joins the giant while other folds are lighter, so the others stay within the largest small patient.
        rest = sorted(loads)[:-1]
        assert rest[-1] - rest[0] <= 3


def test_ordered_hash(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", rng.randint(0, 50), i, 1 + rng.random()) for i in range(2000)]
    frame = lambda r, n: spark.createDataFrame(r, "k string, day int, id long, v double").repartition(n)
    cert = lambda d: {r["k"]: (r["n_rows"], r["hash_ordered"]) for r in D.ordered_hash(d, ["k"], ["day", "id"], ["id", "v"]).collect()}
    got = cert(frame(rows, 7))
    assert got == cert(frame(rows[::-1], 3)) and set(got) == {"a", "b", None, "hot"}
    for k in got:
        total = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            total = (total * D.ORDER_BASE + h32(r[2], repr(r[3])) % D.ORDER_PRIME) % D.ORDER_PRIME
        assert got[k] == (sum(r[0] == k for r in rows), total)
    # The same rows in another order, as told by the order columns, have another certificate.
    other = [(k, -day, i, v) for k, day, i, v in rows]
    assert all(a[0] == b[0] and a[1] != b[1] for a, b in zip(sorted(got.values()), sorted(cert(frame(other, 4)).values())))
    assert cert(spark.createDataFrame([], "k string, day int, id long, v double")) == {}


def test_chained_runs_may_be_cut_anywhere():
    rng = random.Random(1)
    h = [rng.randrange(D.ORDER_PRIME) for _ in range(40)]
    whole = (0, 0)
    for x in h:
        whole = D.chained(whole, (1, x))
    for cut in (1, 13, 39):
        a = b = (0, 0)
        for x in h[:cut]:
            a = D.chained(a, (1, x))
        for x in h[cut:]:
            b = D.chained(b, (1, x))
        assert D.chained(a, b) == whole


def test_lattice():
    assert FT.lattice(3, 2) == [p for p in itertools.product(range(3), repeat=3) if sum(p) == 2]
    with pytest.raises(ValueError):
        FT.lattice(12, 20)


@pytest.mark.parametrize("n_refs", [1, 2, 3])
def test_blend_equals_a_brute_force_grid(spark, n_refs):
    rng = np.random.default_rng(n_refs)
    parts, features, samples = ["x", "y"], range(8), range(5)
    base = rng.uniform(0, 3, (8, 2))
    sigs = [base * rng.uniform(0.3, 1.7, (8, 2)) for _ in range(n_refs)]
    bulk = rng.uniform(0, 3, (8, 5))
    bulk[:, 4] = 0.0
    long = lambda m, cols, name, value: spark.createDataFrame(
        [(f, c, float(m[f, j])) for f in features for j, c in enumerate(cols)], f"feature int, {name}, {value} double")
    got = FT.ensemble(long(bulk, samples, "sample int", "value"), [long(s, parts, "part string", "mean") for s in sigs], parts).collect()

    def solve(s, b):
        found = (float(b @ b), np.zeros(2))
        for on in ([0], [1], [0, 1]):
            x = np.zeros(2)
            x[on] = np.linalg.lstsq(s[:, on], b, rcond=None)[0]
            if (x >= -1e-12).all() and ((s @ x - b) ** 2).sum() < found[0] - 1e-12:
                found = (((s @ x - b) ** 2).sum(), x)
        return found[1]

    x = [np.stack([solve(s, bulk[:, j]) for j in samples]) for s in sigs]
    errors = []
    for w in FT.lattice(n_refs, 10):
        e = sum(np.linalg.norm(bulk[:, j] - sum(wi / 10 * (s @ xi[j]) for wi, s, xi in zip(w, sigs, x))) / np.linalg.norm(bulk[:, j]) for j in range(4))
        errors.append((round(e, 9), w))
    weights = min(errors)[1]
    assert len(got) == 10 and all([round(v * 10) for v in r["weights"]] == list(weights) and sum(r["weights"]) == pytest.approx(1) for r in got)
    for r in got:
        want = sum(w / 10 * xi[r["sample"], parts.index(r["part"])] for w, xi in zip(weights, x))
        assert r["value"] == pytest.approx(want, abs=1e-8)
