"""Very long runs of names, digits and dotted parts in decontamination; both forms of the patterns find the same."""

import random
import time

from partwise.llm import decontaminate as D
from pyspark.sql import functions as F


def test_long_runs_end(spark):
    long = {"names": "see " + "Anna Berta Carl " * 33_334, "dotted": "1" + ".1" * 100_000, "digits": "7" * 1_000_000,
            "spaced": "a " + "Ab " * 60_000 + "12 km " * 20_000}
    start = time.time()
    got = {r["k"]: r for r in D.canonical(spark.createDataFrame(list(long.items()), "k string, text string")).select(
        "k", F.size("words").alias("n"), "words", "values").collect()}
    assert time.time() - start < 60
    assert got["names"]["words"] == ["see", "⟨name⟩"] and len(got["names"]["values"]["v0"][0].split()) == 100_002
    assert got["dotted"]["words"] == ["⟨num⟩"] == got["digits"]["words"] and got["digits"]["values"]["v2"] == [long["digits"]]
    assert got["spaced"]["words"] == ["a", "⟨name⟩"] + ["⟨qty⟩"] * 20_000


def test_both_forms_find_the_same(spark, duck):
    """Random texts of the characters that the patterns turn on."""
    rng = random.Random(2)
    bits = ["1", "22", ".", ",", " ", "  ", "km", "m", "min", "%", "s", "A", "Ab", "Abc", "x", "é", "Éa", "!", "\n", "5 km", "3.4 m"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(6000)] + ["5 m12 km", "1..5 km", "5s1 km", "1.2,3 kmx 4"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for jvm, plain, to, group in ((D.JVM_NAME, D.NAME, "1⟨n⟩", 2), (D.JVM_QUANTITY, D.QUANTITY, "2⟨q⟩", 1), (D.JVM_NUMBER, D.NUMBER, "0⟨d⟩", 0)):
        got = [tuple(r) for r in frame.orderBy("k").select(
            F.regexp_replace("text", jvm, "$" + to), F.regexp_extract_all("text", F.lit(jvm), group)).collect()]
        want = duck.execute("SELECT regexp_replace(t, $p, $r, 'g'), regexp_extract_all(t, $p, $g) FROM (SELECT unnest($t) AS t)",
                            {"p": plain, "r": "\\" + to, "g": group, "t": texts}).fetchall()
        assert got == [tuple(r) for r in want]
