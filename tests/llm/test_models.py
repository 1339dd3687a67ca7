"""Held-out accuracy of the classifiers, and what they may not read."""

import pytest
from pyspark.sql import functions as F

from partwise.llm import classifiers, labelled

FOLDER = "/root/testdata/sf0.1"


def accuracy(spark, model, label, fold_count, held):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = model(docs, labels).cache()
    assert got.count() == docs.count()
    assert got.where(F.col("held_out") != (labelled.fold("doc_id", fold_count) == held)).count() == 0
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y")).collect()
    return [sum(r["predicted"] == r["y"] for r in rows if r["y"] == c) / sum(r["y"] == c for r in rows) for c in (0, 1)]


def test_toxicity(spark):
    clean, toxic = accuracy(spark, classifiers.toxicity, "toxic", 5, 0)
    assert clean > 0.95 and toxic > 0.55  # some 450 toxic texts to learn from, a sixth of them without a toxic word in English


def test_quality(spark):
    poor, good = accuracy(spark, classifiers.quality, "quality", 3, 1)
    assert poor > 0.85 and good > 0.98


@pytest.mark.parametrize("model", [classifiers.toxicity, classifiers.quality])
def test_only_the_text_counts(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    first = {r["doc_id"]: r["score"] for r in model(docs, labels).collect()}
    other = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    assert first == {r["doc_id"]: r["score"] for r in model(other, labels).collect()}
