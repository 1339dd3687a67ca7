"""Removal of repeated passages by suffix trees over prefix groups.

Only suffixes at anchors whose ten-word prefix occurs twice are followed, so the rows that
move are a few hundredths of the words.  A prefix of at most ``tree_rows`` suffixes goes,
with others, to one task, which builds the trees of its suffixes and reads the repeats
off their deep nodes; copies of a suffix with its surroundings count once.  A more frequent prefix is lengthened to the whole window, where a
node is a group of equal windows and a plain aggregate counts it, however large it is; before,
it is lengthened to either half of the windows, which drops the suffixes that share neither.

Defined results: a missing or empty text, or one shorter than a window, loses nothing;
equal rows repeat each other, so all of them lose all windows; rows without a key are
documents like others; an empty table gives an empty table; only the key and the text are
read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm import suffixes
from partwise.llm.common import per_text, stored

KEY = ("k1", "k2")


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """(key, k1, k2, text): rows of the same key and text share (k1, k2)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col(key), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("k1"),
                       F.xxhash64(text).alias("k2"), text.alias("text"))


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _anchors(docs: DataFrame) -> DataFrame:
    """(k1, k2, place, prefix): ``place`` packs anchor, last and first window as distances."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, prefixes = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                a, first, last, prefix = suffixes.anchors(suffixes.word_hashes(_split(text)))
                at.append(np.full(len(a), i))
                places.append(a << 12 | (a - last) << 6 | (a - first))
                prefixes.append(prefix)
            if at:
                row = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(places)),
                     pa.array(np.concatenate(prefixes))], names=["k1", "k2", "place", "prefix"])

    return docs.select(*KEY, "text").mapInArrow(work, "k1 long, k2 long, place long, prefix long")


def _packed(docs: DataFrame, *keep: str) -> DataFrame:
    """Texts as compressed bytes, for the shuffles that carry them."""
    return per_text(docs.select(*keep, "text"), lambda batch: {"packed": [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch]},
                    "packed binary")


def _unpack(raw: bytes) -> list[bytes]:
    return zlib.decompress(raw).split()


def _contexts(rows: DataFrame) -> DataFrame:
    """(k1, k2, anchor, prefix, context, left, right) of the anchors whose prefix repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "anchor", "prefix", "context", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k1, k2, raw, places in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                words = _unpack(raw)
                for p in places:
                    anchor = p["place"] >> 12
                    left, right = suffixes.context(words, anchor, anchor - (p["place"] & 63), anchor - (p["place"] >> 6 & 63))
                    for column, value in zip(out, (k1, k2, anchor, p["prefix"], suffixes.digest(left, right), left, right)):
                        column.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds)], names=names)

    return rows.mapInArrow(
        work, "k1 long, k2 long, anchor long, prefix long, context binary, left binary, right binary")


def _by_tree(contexts: DataFrame, tree_rows: int) -> DataFrame:
    """(context, mask) of the contexts of ordinary prefixes; a task's prefixes share its trees."""
    groups = max(1, contexts.count() // tree_rows)

    def work(table: pa.Table) -> pa.Table:
        mask = suffixes.repeated_windows(table.column("left").to_pylist(), table.column("right").to_pylist(),
                                         table.column("n").to_numpy())
        return pa.table({"context": table.column("context"), "mask": pa.array(mask)})

    return contexts.withColumn("_g", F.pmod(F.xxhash64("prefix"), F.lit(groups))).groupBy("_g").applyInArrow(
        lambda table: work(table), "context binary, mask long")


def _by_window(contexts: DataFrame) -> DataFrame:
    """(context, mask) of the contexts of frequent prefixes, by counting whole windows.

    The windows of a half share its longer side, so only contexts that share one make windows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, half, key) for i, (left, right) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                    for half, key in suffixes.halves(left, right)]
            if made:
                at, half, key = zip(*made)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in batch.columns], pa.array(half, pa.int32()), pa.array(key, pa.binary())],
                                                 names=["context", "left", "right", "n", "half", "key"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(c, o, d, n) for c, left, right, n, half in zip(*[batch.column(i).to_pylist() for i in range(5)])
                    for o, d in suffixes.windows(left, right) if (o < suffixes.HALF) == half]
            for at in range(0, len(made), 50_000):
                c, o, d, n = zip(*made[at:at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=pa.binary()), pa.array(o, type=pa.int64()), pa.array(d, type=pa.binary()), pa.array(n, type=pa.int64())],
                    names=["context", "o", "window", "n"])

    parts = stored(contexts.select("context", "left", "right", "n").mapInArrow(
        split, "context binary, left binary, right binary, n long, half int, key binary"), "halves", compression="zstd")
    shared = parts.groupBy("half", "key").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select(F.col("half").alias("_half"), F.col("key").alias("_key"))
    open_parts = parts.join(shared, (F.col("half") == F.col("_half")) & (F.col("key") == F.col("_key")), "left_semi")
    rows = open_parts.select("context", "left", "right", "n", "half").mapInArrow(work, "context binary, o long, window binary, n long")
    twice = stored(rows.groupBy("window").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select(
        F.col("window").alias("_window")), "twice")
    return rows.join(twice, F.col("window") == F.col("_window"), "left_semi").groupBy("context").agg(
        F.expr("bit_or(shiftleft(1L, cast(o AS int)))").alias("mask"))


def _marks(docs: DataFrame, tree_rows: int) -> DataFrame:
    """(k1, k2, marks): the repeated windows of each document that has any."""
    prefixes = stored(_anchors(docs).groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
        F.col("prefix").alias("_prefix")), "prefixes")
    found = _anchors(docs)
    found = found.join(prefixes, found["prefix"] == prefixes["_prefix"]).groupBy(*KEY).agg(
        F.collect_set(F.struct("place", "prefix")).alias("places")).toDF("_k1", "_k2", "places")
    texts = _packed(docs, *KEY)
    contexts = stored(_contexts(texts.join(found, (texts["k1"] == found["_k1"]) & (texts["k2"] == found["_k2"])).select(
        *KEY, "packed", "places")), "contexts", compression="zstd")
    distinct = stored(contexts.groupBy("context", "prefix", "left", "right").agg(F.count("*").alias("n")), "suffixes",
                      compression="zstd")
    # Copies share a context, so a prefix is frequent by its different contexts.
    frequent = stored(distinct.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > tree_rows).select(
        F.col("prefix").alias("_prefix")), "frequent")
    hot = F.col("prefix") == F.col("_prefix")
    masks = _by_tree(distinct.join(frequent, hot, "left_anti"), tree_rows).union(_by_window(distinct.join(frequent, hot, "left_semi")))
    masks = stored(masks.where(F.col("mask") != 0).toDF("_context", "mask"), "masks")
    places = contexts.select(*KEY, "anchor", "context")
    return places.join(masks, places["context"] == masks["_context"]).groupBy(*KEY).agg(
        F.collect_set(F.struct("anchor", "mask")).alias("marks"))


def _cut(docs: DataFrame, key: str, tree_rows: int, fn, schema: str) -> DataFrame:
    """Apply ``fn(words, covered)`` to every document."""
    rows = _keyed(docs, key)
    marks = stored(_marks(rows, tree_rows), "marks").toDF("_k1", "_k2", "marks")
    texts = _packed(rows, key, *KEY)
    joined = texts.join(marks, (texts["k1"] == marks["_k1"]) & (texts["k2"] == marks["_k2"]), "left").select(
        key, F.struct("packed", "marks").alias("text"))

    def work(batch: list[dict]) -> dict[str, list]:
        made = []
        for row in batch:
            words = _unpack(row["packed"])
            made.append(fn(words, suffixes.covered(len(words), [(m["anchor"], m["mask"]) for m in row["marks"] or []])))
        return {name: [m[name] for m in made] for name in made[0]}

    return per_text(joined, work, schema)


def digests(docs: DataFrame, key: str = "doc_id", tree_rows: int = 1000) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256), one row per document."""

    def fn(words: list[bytes], gone: np.ndarray) -> dict:
        kept = [w for w, g in zip(words, gone) if not g]
        return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    return _cut(docs, key, tree_rows, fn, "n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", tree_rows: int = 1000) -> DataFrame:
    """(key, kept, removed): the words left, joined by spaces, and the removed word ranges, ends exclusive."""

    def fn(words: list[bytes], gone: np.ndarray) -> dict:
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
        return {"kept": kept.decode("utf-8", "surrogatepass"), "removed": [list(e) for e in zip(edges[::2], edges[1::2])]}

    return _cut(docs, key, tree_rows, fn, "kept string, removed array<array<long>>")
