"""Product codes of vectors; nearest codebook entries by Orchard's search.

A vector of integers floor(scale * x) is cut into equal consecutive parts, each with its own
codebook.  For every entry the other entries are kept in the order of their distance from it.
A search holds a current entry and walks down its list: an entry that is nearer to the query
becomes the current one and its list is walked from the top; entries already measured are
marked and skipped; the walk stops at a list distance beyond twice the current distance, as
by the triangle inequality nothing further can be nearer.  (Squares are compared: four times.)
Ties stay inside that bound, so the lower index of equal distances is found as well.

Rounds are passes over the rows; tasks hand on sums and counts per entry, at most
entries x dimensions numbers, which is also all that the driver sees.

Defined results: a vector that is null or holds a null or non-finite entry has no row.
Vectors are followed by zeros up to the longest one, and up to a multiple of the number of
parts.  Repeated rows count each; the first codebook takes rows by id, then by vector, a null
id last.  With fewer rows than entries a codebook has as many entries as there are rows.
Entries beyond 2^22 / scale are an error, as their sums would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import stored
from partwise.llm.vectors import finite_rows, grid, scaled, width_of

#: Rows searched at once.
BLOCK = 2000
MOST_ENTRY = 1 << 22


class Orchard:
    """Codebooks (parts x entries x dimensions of a part) with the sorted neighbours of each entry."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.parts, self.entries, self.depth = books.shape
        apart = ((books[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=-1)
        self.lists = np.argsort(apart, axis=-1, kind="stable")
        self.gaps = np.take_along_axis(apart, self.lists, axis=-1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance (rows x parts) of integer rows, all searches in step."""
        q = x.reshape(-1, self.depth)
        part = np.tile(np.arange(self.parts), len(x))
        now = np.zeros(len(q), np.int64)
        best = ((q - self.books[part, 0]) ** 2).sum(axis=1)
        at = np.zeros(len(q), np.int64)
        seen = np.zeros((len(q), self.entries), bool)
        seen[:, 0] = True
        live = np.arange(len(q))
        while True:
            live = live[at[live] < self.entries]
            live = live[self.gaps[part[live], now[live], at[live]] <= 4 * best[live]]
            if not len(live):
                return now.reshape(len(x), -1), best.reshape(len(x), -1)
            entry = self.lists[part[live], now[live], at[live]]
            at[live] += 1
            new = ~seen[live, entry]
            who, entry = live[new], entry[new]
            seen[who, entry] = True
            far = ((q[who] - self.books[part[who], entry]) ** 2).sum(axis=1)
            nearer = (far < best[who]) | ((far == best[who]) & (entry < now[who]))
            who, entry = who[nearer], entry[nearer]
            now[who], best[who], at[who] = entry, far[nearer], 0


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            yield piece, scaled(grid(piece.column("_vector"), width), scale, MOST_ENTRY)


def refined(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: each entry becomes the floor of the mean of the parts nearest to it; an unused one stays."""
    parts, entries, depth = books.shape
    width = parts * depth

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(books)
        sums = np.zeros((parts * entries, depth + 1), np.int64)
        for _, x in _blocks(batches, width, scale):
            slot = (search.nearest(x)[0] + np.arange(parts) * entries).ravel()
            np.add.at(sums, slot, np.column_stack([x.reshape(-1, depth), np.ones(len(slot), np.int64)]))
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, depth + 1), pa.int32()), pa.array(np.tile(np.arange(depth + 1), len(used)), pa.int32()),
             pa.array(sums[used].ravel())], names=["slot", "at", "v"])

    got = rows.select("_vector").mapInArrow(work, "slot int, at int, v bigint").groupBy("slot", "at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((parts * entries, depth + 1), object)
    for slot, at, v in got:
        sums[slot, at] = v
    out = books.reshape(-1, depth).copy()
    for slot in range(len(out)):
        if sums[slot, -1]:
            out[slot] = [int(v) // int(sums[slot, -1]) for v in sums[slot, :-1]]
    return out.reshape(books.shape)


def train(rows: DataFrame, ident: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray | None:
    """Codebooks (parts x entries x dimensions) of rows with ``_vector``; None without rows."""
    width = max(1, -(-width_of(rows) // parts)) * parts
    first = [r["_vector"] for r in rows.orderBy(F.col(ident).asc_nulls_last(), "_vector").limit(entries).collect()]
    if not first:
        return None
    x = scaled(grid(pa.array(first, pa.list_(pa.float64())), width), scale, MOST_ENTRY)
    books = np.ascontiguousarray(x.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(rows, books, scale)
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """The other columns of rows with ``_vector``, ``code`` (two hex digits a part) and ``error``."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    parts, _, depth = books.shape
    width = parts * depth
    keep = [f for f in rows.schema.fields if f.name != "_vector"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(books)
        for piece, x in _blocks(batches, width, scale):
            entry, error = search.nearest(x)
            codes = [c.tobytes().hex() for c in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(f.name) for f in keep], pa.array(codes, pa.string()), pa.array(error.sum(axis=1))],
                names=[*[f.name for f in keep], "code", "error"])

    return rows.mapInArrow(work, StructType([*keep, StructField("code", StringType()), StructField("error", LongType())]))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(ident, code, error, label_error, codebooks_sha256) of every usable row, at most 256 entries a part.

    Errors are added per label before they meet the rows again, so a label with most of the
    rows costs each task one number; the sums are stored, which gives Spark their size.
    """
    rows = finite_rows(vectors, vector, F.col(ident).alias("_ident"), F.col(label).alias("_label"))
    books = train(rows, "_ident", parts, entries, rounds, scale)
    if books is None:
        return vectors.where("false").select(ident, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string"))])
    coded = stored(encode(rows, books, scale), "codes")
    sums = stored(coded.groupBy(F.col("_label").alias("_by")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("_label").eqNullSafe(F.col("_by"))).select(
        F.col("_ident").alias(ident), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
