"""Bounded, seeded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> F.Column:
    """crc32 of the key as text, modulo ``folds``; rows without a key have no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def label_sample(labels: DataFrame, label: str, key: str, folds: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(_key, label): at most ``per_class`` keys of each class outside the held-out fold, and the class sizes.

    Keys are taken in the order of a hash, so the sample is the same on every run and does
    not depend on how the rows are stored.  Its size is the only bound on the fit.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, folds) != held)).groupBy(
        F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("_key").cast("string"))
    picked = [known.where(F.col("label") == c).orderBy(order, "_key").limit(per_class) for c in (0, 1)]
    return picked[0].unionByName(picked[1]), sizes


def sampled_texts(docs: DataFrame, sample: DataFrame, key: str) -> list[tuple[str, int]]:
    """One text and the label of each key of a sample: of rows of one key, the text that hashes lowest.

    ``sample`` has a fixed bound, so it may be broadcast, and its texts collected.
    """
    small = F.broadcast(sample)
    rows = docs.select(F.col(key).alias("_doc"), F.coalesce("text", F.lit("")).alias("text")).join(
        small, F.col("_doc") == F.col("_key")).groupBy("_doc", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_m")).select("_doc", "label", "_m.text").collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (str(r["_doc"]), r["text"]))]
