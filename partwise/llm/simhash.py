"""Near duplicates by SimHash.

Defined results: a missing or empty text has the fingerprint zero and is linked like any
other; equal rows share a fingerprint and so a component; a row without a key takes
part, but a component is named by its smallest key, so one of rows without keys alone has
none; an empty table gives an empty table; only the key and the text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import per_text, stored, texts
from partwise.llm.components import components
from partwise.llm.hamming import links
from partwise.llm.simhash_bits import fingerprint


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``fp``, the 64 bits as a signed long."""

    def work(batch: list[str]) -> dict[str, list]:
        return {"fp": [int.from_bytes(fingerprint(t), "big", signed=True) for t in batch]}

    return per_text(texts(docs, *keep), work, "fp long")


def groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(_fp, root): the group of every distinct fingerprint, named by its least one.

    Copies collapse to one fingerprint before any probing; links join fingerprints, and
    components run on the linked ones alone.
    """
    distinct = stored(prints.select("fp").distinct(), "distinct")
    found = components(links(distinct, radius).toDF("u", "v"))
    return stored(distinct.join(found, F.col("fp") == F.col("vertex"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): one row per document, in the groups of linked fingerprints."""
    prints = stored(fingerprints(docs, key), "fingerprints")
    first = prints.groupBy(F.col("fp").alias("_f")).agg(F.min(key).alias("first_id"))
    labels = stored(groups(prints, radius).join(first, F.col("_fp") == F.col("_f")).drop("_f"), "labels")
    names = labels.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = stored(labels.join(names, F.col("root") == F.col("_root")).select("_fp", "component_id"), "names")
    return prints.join(named, F.col("fp") == F.col("_fp")).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
