"""Near copies by the Jaccard similarity of five-word shingles.

The groups of linked SimHash fingerprints (``simhash``, operator 2) and banded minima of shingle hashes
propose pairs, and the exact similarity of the shingle sets confirms them.  Fingerprints of three bits' distance find few
pairs near 0.8, minima the rest: two texts of similarity s share no band with a chance of (1 - s^ROWS)^BANDS,
7e-6 at 0.8, less above.  In each bucket, a band's or a fingerprint group's, all texts meet the least one first; then those that
are still in different groups meet each other, so one large group of copies costs few pairs.

Defined results: words are runs between white space, without regard to ASCII case; a text of
fewer than five words is one shingle; texts without a word are one group; equal rows are in
one group; a row without a key takes part; an empty table gives an empty table; only the key
and the text are read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm import simhash
from partwise.llm.common import per_text, stored, texts
from partwise.llm.components import components
from partwise.llm.simhash_bits import fingerprint
from partwise.session import scratch

WIDTH = 5
BANDS = 30
ROWS = 5
#: A table of keys with at most so many rows is sent to every executor (16 bytes a row); a larger one is joined by shuffle.
MOST_BROADCAST_ROWS = 2_000_000
#: Shingles whose minima are taken at once; bounds memory for very long texts.
BLOCK = 1 << 12

_ODD = np.random.default_rng(42).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """The hashes of the distinct shingles, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(h))
    sums = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        sums += h[i:len(h) - width + 1 + i] * _ODD[2, i]
    return np.unique(_mixed(sums))


def bands(grams: np.ndarray) -> list[int]:
    """One key per band; equal keys are a bucket.  None for an empty set."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), BLOCK):
        part = grams[at:at + BLOCK]
        for i in range(BANDS * ROWS):
            least[i] = min(least[i], (part * _ODD[0, i] + _ODD[1, i]).min())
    keys = (least * _ODD[2]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return _mixed(keys).view(np.int64).tolist()


def _prints(batch: list[str]) -> dict[str, list]:
    sets = [shingles(t) for t in batch]
    return {"fp": [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], "n_grams": [len(s) for s in sets],
            "bands": [bands(s) for s in sets], "sim": [int.from_bytes(fingerprint(t), "big", signed=True) for t in batch]}


def _grams(batch: list[str]) -> dict[str, list]:
    return {"grams": [shingles(t).view(np.int64) for t in batch]}


def _sent(df: DataFrame) -> DataFrame:
    """``df``, which is stored, marked for broadcasting if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_ROWS else df


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(docs[key].alias("_key"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_tk"), docs["text"].alias("text"))


def _fingerprint_spots(prints: DataFrame) -> DataFrame:
    """(fp, n_grams, band): every shingle set in the bucket of its texts' group of linked fingerprints."""
    linked = simhash.groups(prints.select(F.col("sim").alias("fp")))
    own = prints.where("n_grams > 0").select("fp", "n_grams", "sim").distinct()
    return own.join(linked, F.col("sim") == F.col("_fp")).select("fp", "n_grams", F.xxhash64(F.lit("sim"), "root").alias("band")).distinct()


def _similar(pairs: DataFrame, grams: DataFrame, share: float, keep) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the similarity ``share``."""
    one, two = grams.toDF("a", "ga"), grams.toDF("b", "gb")
    met = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("ga", "gb")))
    return keep(met.where(F.col("both") >= share * (F.size("ga") + F.size("gb") - F.col("both")) - 1e-9).select("a", "b"))


def groups(rows: DataFrame, prints: DataFrame, share: float) -> DataFrame:
    """(_fp, root): the group of every distinct shingle set, named by its least one.

    ``rows`` is (_key, _tk, text), ``prints`` is stored and has (_key, _tk, fp, n_grams, bands, sim).
    """
    with scratch(prints.sparkSession) as keep:
        return _groups(rows, prints, share, keep)


def _groups(rows: DataFrame, prints: DataFrame, share: float, keep) -> DataFrame:
    distinct = prints.dropDuplicates(["fp"])
    with scratch(prints.sparkSession) as keep_spots:
        spots = keep_spots(distinct.select("fp", "n_grams", F.explode("bands").alias("band")).unionByName(_fingerprint_spots(prints)))
        first = spots.groupBy("band").agg(F.min(F.struct("fp", "n_grams")).alias("_f"), F.count("*").alias("_n")).where("_n > 1")
        met = keep(spots.join(first.select(F.col("band").alias("_b"), "_f"), F.col("band") == F.col("_b")).select(
            "band", "fp", "n_grams", F.col("_f.fp").alias("first"), F.col("_f.n_grams").alias("n_first")))
    fits = F.least("n_grams", "n_first") >= share * F.greatest("n_grams", "n_first") - 1e-9
    pairs = keep(met.where(fits & (F.col("fp") != F.col("first"))).select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct())

    wanted = met.select(F.col("fp").alias("_fp")).distinct()
    some = keep(prints.join(wanted, F.col("fp") == F.col("_fp")).groupBy("fp").agg(
        F.min(F.struct(F.col("_key").isNull().alias("x"), "_key", "_tk")).alias("_m")).select(
        "fp", F.col("_m._key").alias("_mk"), F.col("_m._tk").alias("_mt")))
    chosen = rows.join(_sent(some), F.col("_key").eqNullSafe(F.col("_mk")) & (F.col("_tk") == F.col("_mt")))
    grams = keep(per_text(texts(chosen, "fp"), _grams, "grams array<long>").dropDuplicates(["fp"]))
    near = _similar(pairs, grams, share, keep)

    joined = keep(components(near.toDF("u", "v")))
    placed = keep(met.join(joined, F.col("fp") == F.col("vertex"), "left").select(
        "band", "fp", "n_grams", F.coalesce("component", "fp").alias("root")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select(
        F.col("band").alias("_b"))
    apart = keep(placed.join(mixed, F.col("band") == F.col("_b"), "left_semi"))
    kinds = apart.groupBy("band", "root").agg(F.min("n_grams").alias("_lo"), F.max("n_grams").alias("_hi")).toDF("_b", "_r", "_lo", "_hi")
    # Each member meets the other groups of its bucket, then the members of those; never its own group.
    other = apart.join(kinds, (F.col("band") == F.col("_b")) & (F.col("root") < F.col("_r"))
                       & (F.col("n_grams") >= share * F.col("_lo") - 1e-9) & (F.col("_hi") >= share * F.col("n_grams") - 1e-9)).select(
        "band", F.col("_r").alias("root"), F.col("fp").alias("a"), F.col("n_grams").alias("n_first"))
    more = other.join(apart, ["band", "root"]).where(fits).select("a", F.col("fp").alias("b")).distinct()
    more = keep(more.join(pairs.union(pairs.select("b", "a")), ["a", "b"], "left_anti"))
    found = components(near.union(_similar(more, grams, share, keep)).toDF("u", "v"))
    return stored(distinct.select(F.col("fp").alias("_fp")).join(found, F.col("_fp") == F.col("vertex"), "left").select(
        "_fp", F.coalesce("component", "_fp").alias("root")), "groups")


def keep_first(docs: DataFrame, key: str = "doc_id", share: float = 0.8) -> DataFrame:
    """One row of every group, with all its columns: the smallest key, a missing one last.

    Of rows with this key and different texts the text that hashes lowest stays.  The text
    meets only the table of the rows to drop, which is the smaller one in most corpora.
    """
    rows = _keyed(docs, key)
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    prints = stored(per_text(texts(rows, "_key", "_tk"), _prints, "fp long, n_grams long, bands array<long>, sim long"), "prints")
    labels = groups(rows, prints, share)
    placed = prints.join(labels, F.col("fp") == F.col("_fp")).groupBy("root", "_key", "_tk").agg(F.count("*").alias("_n"))
    placed = stored(placed.withColumn("_order", F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_tk"))), "placed")
    best = stored(placed.groupBy(F.col("root").alias("_root")).agg(F.min("_order").alias("_best")), "first")
    placed = placed.join(best, F.col("root") == F.col("_root"))
    stays = F.col("_order").eqNullSafe(F.col("_best"))
    again = stored(placed.where(stays & (F.col("_n") > 1)).select("_key", "_tk"), "again")
    gone = stored(placed.where(~stays).select("_key", "_tk").unionByName(again), "gone")

    def same(name: str):
        return docs[key].eqNullSafe(F.col(f"{name}._key")) & (text_hash == F.col(f"{name}._tk"))

    single = docs.join(_sent(gone).alias("m"), same("m"), "left_anti")
    return single.unionByName(docs.join(_sent(again).alias("g"), same("g"), "left_semi").dropDuplicates([key, "text"]))
