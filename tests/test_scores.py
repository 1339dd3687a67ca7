"""Planted truth is recovered, inverted truth is rejected, missing is not zero."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from partwise.functions import text as T
from partwise.functions.guards import pearson
from partwise.operators import compose as C
from partwise.operators import diff as D
from partwise.operators import keys as K
from partwise.operators import resample as RS
from partwise.operators import score as S

CONSTRAINTS = [
    ("C1", "pairwise", "Tumor", ["CT", "LE"], [], 1.0),
    ("C4", "maximum", "Endothelial", ["MVP"], ["LE", "IT", "CT", "MVP", "PAN"], 1.0),
    ("C7", "monotone", "Tumor", ["LE", "IT", "CT"], [], 2.0),
]
TUMOUR = {"LE": 0.2, "IT": 0.4, "CT": 0.7, "MVP": 0.5, "PAN": 0.6}
VESSEL = {"LE": 0.1, "IT": 0.1, "CT": 0.05, "MVP": 0.3, "PAN": 0.1}


def cohort(spark, sign=1, drop=(), flat=False, reps=2):
    est, man = [], []
    for g in range(4):
        for s in TUMOUR:
            if s in drop:
                continue
            for r in range(reps + g % 2):
                i = f"{g}-{s}-{r}"
                man.append((i, g, s))
                for part, table in (("Tumor", TUMOUR), ("Endothelial", VESSEL)):
                    v = 0.5 if flat else (table[s] if sign > 0 else 1 - table[s])
                    est.append(("m", i, part, v))
    return (spark.createDataFrame(est, "method STRING, sample STRING, part STRING, value DOUBLE"),
            spark.createDataFrame(man, "sample STRING, tumour INT, structure STRING"))


def run(spark, **kw):
    est, man = cohort(spark, **kw)
    return S.verdicts(S.group_means(est, man), S.constraint_terms(spark, CONSTRAINTS), ["method", "tumour"])


@pytest.mark.parametrize("kw,want", [({"sign": 1}, 1.0), ({"sign": -1}, 0.0), ({"flat": True}, 0.0)])
def test_score_of_planted_cohorts(spark, kw, want):
    assert S.score(run(spark, **kw)).first()["score"] == want


def test_missing_structure_leaves_both_sides(spark):
    row = S.score(run(spark, drop=("IT",))).first()
    assert row["score"] == 1.0 and row["n_pairs"] == 8  # the chain cannot be evaluated


def test_maximum_needs_two_others(spark):
    table = run(spark, drop=("IT", "CT", "PAN"))
    assert {r["id"] for r in table.collect()} == set()


def test_breakdowns_agree_with_the_score(spark):
    table = run(spark)
    g = S.per_group(table).toPandas()
    assert (g.satisfied == "C1,C4,C7").all() and (g.violated == "").all()
    est, _ = cohort(spark)
    per = S.per_constraint(table, S.constraint_terms(spark, CONSTRAINTS), est).toPandas()
    assert (per.fraction == 1).all() and len(per) == 3


def test_shuffled_labels_keep_groups_and_counts(spark):
    _, man = cohort(spark)
    sh = RS.permute_labels(man, ["tumour"], "structure", "sample", 3, "s")
    want = man.groupBy("tumour", "structure").count().toPandas().sort_values(["tumour", "structure"]).reset_index(drop=True)
    for d in (1, 2, 3):
        got = sh.where(F.col("draw") == d).groupBy("tumour", "structure").count().toPandas().sort_values(["tumour", "structure"]).reset_index(drop=True)
        assert got.equals(want)
    assert sh.where("draw = 1").join(man, ["sample", "structure"]).count() < man.count()


def test_planted_score_beats_its_null(spark):
    est, man = cohort(spark)
    terms = S.constraint_terms(spark, CONSTRAINTS)
    null = RS.score_null(est, man, terms, 19, "n")
    p = RS.p_value(null, S.score(run(spark)), ["method"], "score").first()
    assert p["p_value"] == pytest.approx(1 / 20) and p["null_mean"] < 0.8


def test_bootstrap_of_one_unit_is_missing(spark):
    w = spark.createDataFrame([("m", 1, 1.0, 2.0)], "method STRING, tumour INT, num DOUBLE, den DOUBLE")
    row = RS.cluster_bootstrap(w, ["method"], "tumour", 10, "b").first()
    assert row["ci_low"] is None and row["ci_high"] is None


def test_resampled_units_keep_the_size(spark):
    u = spark.createDataFrame([(i,) for i in range(30)], "u INT")
    got = RS.resampled_units(u, [], "u", 5, "r").groupBy("draw").agg(F.sum("times").alias("n")).collect()
    assert {r["n"] for r in got} == {30}


def test_closing_keeps_missing_apart_from_zero(spark):
    rows = [("a", "x", 1.0, True), ("a", "y", 3.0, True), ("b", "x", 0.0, True), ("b", "y", -1.0, True), ("c", "x", None, True),
            ("c", "y", 1.0, True), ("d", "x", 0.2, True), ("d", "y", None, False)]
    df = spark.createDataFrame([("m", *r) for r in rows], "method STRING, sample STRING, part STRING, value DOUBLE, covered BOOLEAN")
    got = {(r["sample"], r["part"]): r["value"] for r in C.simplex_close(df, covered="covered").collect()}
    assert got == {("a", "x"): 0.25, ("a", "y"): 0.75, ("b", "x"): None, ("b", "y"): None, ("c", "x"): None, ("c", "y"): None,
                   ("d", "x"): 0.2, ("d", "y"): None}


def test_empty_subset_is_missing_and_has_no_ordering(spark):
    df = spark.createDataFrame([("m", "s", "T", 0.0), ("m", "s", "B", 0.0), ("m", "r", "T", 1.0), ("m", "r", "B", 3.0)],
                               "method STRING, sample STRING, part STRING, value DOUBLE")
    share = C.renormalise_within(df, ["T", "B"])
    got = {r["sample"]: r["ordering"] for r in C.ordering(share, ["sample"], "share", 2).collect()}
    assert got == {"s": None, "r": "B>T"}


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x DOUBLE, y DOUBLE")
    assert df.agg(pearson("x", "y").alias("r")).first()["r"] is None


def test_event_words(spark):
    words = ["Dead", " alive", "1:DECEASED", "0:LIVING", "unknown", None]
    df = spark.createDataFrame([(w,) for w in words], "w STRING").select(T.event_flag("w").alias("e"))
    assert [r["e"] for r in df.collect()] == [1.0, 0.0, 1.0, 0.0, None, None]


def test_labels_of_the_other_study_stay(spark):
    raw = ["CTmvp-reference-histology", "CT-CD44", "odd-reference-histology", None]
    df = spark.createDataFrame([(w,) for w in raw], "w STRING").select(T.canonical_label("w").alias("e"))
    assert [r["e"] for r in df.collect()] == ["MVP", "CT-CD44", "odd", "UNKNOWN"]


def test_bridge_refuses_two_partners(spark):
    with pytest.raises(ValueError):
        K.one_to_one(spark.createDataFrame([("a", 1), ("a", 2)], "l STRING, r INT"), "l", "r")


def test_sign_align_needs_a_direction(spark):
    s = spark.createDataFrame([("new", "m", 1.0)], "yardstick STRING, method STRING, score DOUBLE")
    d = spark.createDataFrame([("mae", False)], "yardstick STRING, higher_is_better BOOLEAN")
    with pytest.raises(Exception, match="no declared direction"):
        C.sign_align(s, d).collect()


def test_diff_can_fail_and_tell_noise(spark):
    old = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 3, 4], "v": [1.0, 2.0, 3.0, 4.0]}))
    new = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 3, 5], "v": [1.0, 2.0 + 1e-12, 3.5, 5.0]}))
    got = {r["k"]: r["status"] for r in D.keyed_diff(old, new, ["k"], ["v"], 1e-9).collect()}
    assert got == {1: "reproduced", 2: "noise", 3: "changed", 4: "lost", 5: "new"}


def test_hash_sees_a_changed_cell_but_not_the_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k INT, v STRING")
    cert = lambda d: tuple(D.content_hash(d, [], ["k", "v"]).first())
    assert cert(df) == cert(df.orderBy(F.desc("k")))
    assert cert(df) != cert(df.withColumn("v", F.lit("a")))
