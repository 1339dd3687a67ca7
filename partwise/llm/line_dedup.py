"""Line deduplication over a corpus with two Bloom filters.

A first pass marks the hash of each distinct line of a text in a filter of lines seen once;
a line that is in it already, or a filter bit that two tasks have set, also goes to the
filter of lines seen twice.  The second filter has no false negatives, so only lines that it
holds can occur in two documents.  A second pass picks these suspects, and they alone are
shuffled: equal lines meet in one aggregate with map-side combining, which tells real
repeats and the document that keeps them.  What each text loses returns to it as line numbers.

The filters are sized by the number of lines (16 bits each) up to ``filter_bytes``.  Beyond
that they fill up: more lines are suspects and the aggregate does more of the work, with the
same result.  Tasks hand on compressed pieces, which merge in two steps.

A line's key is the line without ASCII white space at both ends, A-Z in lower case.  Keys of
at least ``least`` code points found in two documents stay in the document with the smallest
id, all of its lines, and lose all others.

Defined results: a missing text is one empty line.  Rows with one id are one document; a row
without id counts as a document after all others, all such rows as one.  Rows whose id and
text are equal lose the same lines.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from partwise.llm.common import SLICE, stored
from partwise.session import parallelism

BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of a piece of a filter.
PIECE = 1 << 16
#: Pieces of tasks are merged by this many groups first.
LANES = 64
BITS_A_LINE = 16


def line_keys(text: str | None, least: int) -> dict[bytes, list[int]]:
    """The keys of at least ``least`` code points and the numbers of their lines."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode().split(b"\n")):
        key = line.strip(BLANK).lower()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            out.setdefault(key, []).append(i)
    return out


class Shape:
    """Size of a filter and the bits that a hash sets in it."""

    def __init__(self, lines: int, most_bytes: int):
        self.bits = 1 << max(16, min(int(most_bytes).bit_length() + 2, math.ceil(math.log2(max(1, lines) * BITS_A_LINE))))
        self.marks = max(1, min(4, round(0.69 * self.bits / max(1, lines))))

    def spots(self, hashes: np.ndarray) -> np.ndarray:
        """Bit numbers (hashes x marks)."""
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return (hashes[:, None] + step[:, None] * np.arange(self.marks, dtype=np.uint64)) & np.uint64(self.bits - 1)

    def empty(self) -> np.ndarray:
        return np.zeros(self.bits // 8, np.uint8)


def holds(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (bits[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def mark(bits: np.ndarray, spots: np.ndarray) -> None:
    np.bitwise_or.at(bits, spots.ravel() >> np.uint64(3), np.uint8(1) << (spots.ravel() & np.uint64(7)).astype(np.uint8))


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64)


def seen_twice(texts: DataFrame, shape: Shape, least: int) -> np.ndarray:
    """The filter of lines seen twice, merged over all tasks: at most ``filter_bytes``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = shape.empty(), shape.empty()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = [k for t in batch.column(0).slice(at, SLICE).to_pylist() for k in line_keys(t, least)]
                if found:
                    each, n = np.unique(_hashes(found), return_counts=True)
                    spots = shape.spots(each)
                    again = spots[(n > 1) | holds(once, spots)]
                    mark(once, spots)
                    mark(twice, again)
        lane = TaskContext.get().partitionId() % LANES
        for piece in range(-(-len(once) // PIECE)):
            cut = slice(piece * PIECE, (piece + 1) * PIECE)
            if once[cut].any():
                yield _piece(piece, lane, once[cut], twice[cut])

    def merge(table: pa.Table) -> pa.Table:
        once = twice = None
        for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist()):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        return pa.Table.from_batches([_piece(table.column("piece")[0].as_py(), table.column("lane")[0].as_py(), once, twice)])

    schema = "piece int, lane int, once binary, twice binary"
    merged = texts.mapInArrow(fill, schema).groupBy("piece", "lane").applyInArrow(merge, schema).groupBy("piece").applyInArrow(merge, schema)
    bits = shape.empty()
    for piece, twice in merged.select("piece", "twice").collect():
        got = np.frombuffer(zlib.decompress(bytes(twice)), np.uint8)
        bits[piece * PIECE:piece * PIECE + len(got)] = got
    return bits


def _piece(piece: int, lane: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice)]
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([lane], pa.int32()), *packed],
                                      names=["piece", "lane", "once", "twice"])


def suspects(rows: DataFrame, shape: Shape, bits: np.ndarray, least: int) -> DataFrame:
    """(id, tag, key, at): the lines of rows (id, tag, text) that the filter holds."""
    held = rows.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))
    schema = StructType([*[f for f in rows.schema.fields if f.name != "text"], StructField("key", StringType()),
                         StructField("at", ArrayType(IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(zlib.decompress(held.value), np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = [(i, k, at) for i, t in enumerate(part.column("text").to_pylist()) for k, at in line_keys(t, least).items()]
                if not found:
                    continue
                kept = [found[i] for i in np.flatnonzero(holds(twice, shape.spots(_hashes(k for _, k, _ in found))))]
                take = pa.array([i for i, _, _ in kept], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n).take(take) for n in schema.names[:-2]], pa.array([k.decode() for _, k, _ in kept], pa.string()),
                     pa.array([at for _, _, at in kept], pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(work, schema)


def losses(found: DataFrame) -> DataFrame:
    """(tag, lost): the line numbers that each text loses, from suspects (id, tag, key, at).

    A line that makes up a thousandth of all suspects or more (so there are a thousand at
    most) is joined on in as many parts as there are shuffle partitions.
    """
    spark = found.sparkSession
    homes = stored(found.groupBy("key").agg(
        F.min("id").alias("home"), F.max("id").alias("_last"), F.count_if(F.col("id").isNull()).alias("_none"), F.count("*").alias("n"),
    ).where((F.col("home") != F.col("_last")) | ((F.col("_none") > 0) & F.col("home").isNotNull())).select("key", "home", "n"), "line-homes")
    total = homes.agg(F.sum("n")).first()[0] or 0
    hot = [r["h"] for r in homes.where(F.col("n") * 1000 >= total).select(F.xxhash64("key").alias("h")).collect()]
    wide = parallelism(spark)
    is_hot = F.xxhash64("key").isin(hot) if hot else F.lit(False)
    spread = found.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64("tag"), F.lit(wide))).otherwise(F.lit(0)).cast("int"))
    copies = homes.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(wide - 1))).otherwise(F.array(F.lit(0)))))
    gone = spread.join(copies, ["key", "_part"]).where(~F.col("id").eqNullSafe(F.col("home")))
    return gone.groupBy("tag").agg(F.flatten(F.collect_set("at")).alias("lost"))


def kept_lines(docs: DataFrame, ident: str = "doc_id", least: int = 10, filter_bytes: int = 1 << 26) -> DataFrame:
    """(_row, text, n_lines, n_dropped): the other columns of every row as a struct, the text that stays, lines before and lost."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"), F.col(ident).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"))
    named = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-"))
    rows = rows.withColumn("tag", F.sha2(F.concat(named, F.lit("\n"), F.col("text")).cast("binary"), 256))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    shape = Shape(rows.agg(F.sum(breaks)).first()[0] or 0, filter_bytes)
    bits = seen_twice(rows.select("text"), shape, least)
    found = stored(suspects(rows.select("id", "tag", "text"), shape, bits, least), "suspects", "zstd")
    met = rows.select("_row", "tag", "text").join(losses(found), "tag", "left").select("_row", "lost", "text")
    schema = StructType([met.schema["_row"], *[StructField("text", StringType()), StructField("n_lines", LongType()),
                                               StructField("n_dropped", LongType())]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                out, n_lines, n_lost = [], [], []
                for text, lost in zip(part.column("text").to_pylist(), part.column("lost").to_pylist()):
                    lines = text.split("\n")
                    gone = set(lost or ())
                    out.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
                    n_lines.append(len(lines))
                    n_lost.append(len(gone))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_lost, pa.int64())],
                    names=schema.names)

    return met.mapInArrow(work, schema)


def dedup(docs: DataFrame, ident: str = "doc_id", least: int = 10, filter_bytes: int = 1 << 26) -> DataFrame:
    """The columns of ``docs`` with the lines of each text that stay; a missing text becomes empty."""
    kept = kept_lines(docs, ident, least, filter_bytes)
    return kept.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def digests(docs: DataFrame, ident: str = "doc_id", least: int = 10, filter_bytes: int = 1 << 26) -> DataFrame:
    """(ident, n_lines, n_dropped, kept_sha256) of every row."""
    kept = kept_lines(docs.select(ident, "text"), ident, least, filter_bytes)
    return kept.select(F.col("_row").getField(ident).alias(ident), "n_lines", "n_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
