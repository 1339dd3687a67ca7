"""Whitening of vectors by exact integer covariances from bit planes.

An entry c becomes the integer x = floor(scale * c) + offset.  A block of rows is shifted by
its least x in each dimension, and each bit of the shifted numbers becomes a plane: one bit
a row, packed into 64-bit words.  The product sum of two dimensions is then the sum over
pairs of their planes of 2^(bit + bit) times the ones in the AND of both planes.  Blocks
shift back, and Spark adds the products as decimals, so the covariance is centred while it
is still an integer: n P - S S'.  Only the D x D result reaches the driver.

Defined results: a vector that is null or holds a null or non-finite entry has no row.
Vectors shorter than the longest one are followed by zeros.  Repeated rows count each.  A
direction without variance (an eigenvalue below D times the rounding of the largest) has
whitened null; with a single row, or no usable row at all, that is all of them, or no rows.
Entries beyond 2^40 / scale and more than MOST_DIMENSIONS entries are errors, as is a
deviation beyond a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.vectors import finite_rows, grid, scaled, width_of

#: Rows whose planes are held at once.
BLOCK = 4096
#: The driver holds a square of this size.
MOST_DIMENSIONS = 2048
#: Largest |floor(scale * c)|.
MOST_ENTRY = 1 << 40
EXACT = pa.decimal128(38, 0)


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (planes x words) of non-negative integers, the dimension and the bit of each, sorted by dimension."""
    depth = [max(1, int(m).bit_length()) for m in shifted.max(axis=0)]
    dim = np.repeat(np.arange(shifted.shape[1]), depth)
    bit = np.concatenate([np.arange(b) for b in depth])
    rows = -(-len(shifted) // 64) * 64
    packed = np.zeros((len(dim), rows // 8), np.uint8)
    for d in range(shifted.shape[1]):
        mine = np.flatnonzero(dim == d)
        ones = (shifted[:, d, None] >> bit[mine] & 1).astype(np.uint8)
        got = np.packbits(ones, axis=0).T
        packed[mine, :got.shape[1]] = got
    return packed.view(np.uint64), dim, bit


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and product sums over the rows of an integer grid, from AND-popcounts of its bit planes."""
    low = x.min(axis=0)
    shifted = x - low
    planes, dim, bit = bit_planes(shifted)
    both = np.zeros((len(planes), len(planes)), np.int64)
    for p, plane in enumerate(planes):
        both[p, p:] = np.bitwise_count(planes[p:] & plane).sum(axis=1, dtype=np.int64)
    both = both + np.triu(both, 1).T
    # Native words while every weighted sum fits, Python's integers beyond.
    wide = 2 * (int(bit.max()) + 1) + len(x).bit_length() > 62
    kind = object if wide else np.int64
    weight = np.array([1 << int(b) for b in bit], dtype=kind)
    starts = np.flatnonzero(np.diff(dim, prepend=-1))
    product = np.add.reduceat(np.add.reduceat(both.astype(kind) * weight * weight[:, None], starts, axis=0), starts, axis=1)
    sums = np.add.reduceat(np.diag(both).astype(kind) * weight, starts)
    low, sums, product = low.astype(object), sums.astype(object), product.astype(object)
    n = len(x)
    back = product + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, back


def integers(column: pa.ListArray, width: int, scale: int, offset: int) -> np.ndarray:
    return scaled(grid(column, width), scale, MOST_ENTRY) + offset


def _totals(rows: DataFrame, width: int, scale: int, offset: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and product sums of all rows; a task hands on one number per pair of dimensions."""
    upper = np.triu_indices(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, product = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = integers(batch.column("_vector").slice(at, BLOCK), width, scale, offset)
                s, p = cross_products(x)
                n, sums, product = n + len(x), sums + s, product + p
        if n:
            i = np.concatenate([[-1], np.full(width, -1), upper[0]])
            j = np.concatenate([[-1], np.arange(width), upper[1]])
            values = [n, *sums, *product[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array([Decimal(int(v)) for v in values], EXACT)], names=["i", "j", "v"])

    got = rows.select("_vector").mapInArrow(work, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n, sums, product = 0, [0] * width, np.zeros((width, width), object)
    for i, j, v in got:
        if v is None:
            raise OverflowError("the product sums exceed 38 digits")
        if i >= 0:
            product[i, j] = product[j, i] = int(v)
        elif j >= 0:
            sums[j] = int(v)
        else:
            n = int(v)
    return n, sums, product


@dataclass
class Whitening:
    """A fitted whitening of ``n`` rows: ``axes`` are columns, by falling ``values``; ``trace`` is that of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    scale: int
    offset: int

    @property
    def width(self) -> int:
        return len(self.sums)

    def scales(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """1 / sqrt(eigenvalue) of the first components, and which of them have variance."""
        e = self.values[:most]
        floor = self.width * np.finfo(float).eps * max(float(self.values[0]), 0.0) if self.width else 0.0
        full = e > floor
        return np.where(full, 1 / np.sqrt(np.where(full, e, 1.0)), np.nan), full


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Mean, covariance and its eigenvectors over all usable rows; None without any entry."""
    rows = finite_rows(vectors, vector)
    width = width_of(rows)
    if width == 0:
        return None
    if width > MOST_DIMENSIONS:
        raise ValueError(f"{width} dimensions; the square of at most {MOST_DIMENSIONS} is held by the driver")
    n, sums, product = _totals(rows, width, scale, offset)
    s = np.array(sums, object)
    centred = n * product - np.outer(s, s)
    cov = np.array([[int(v) / (n * n) for v in row] for row in centred])
    values, axes = np.linalg.eigh(cov)
    trace = sum(int(centred[i, i]) for i in range(width)) / (n * n)
    return Whitening(n, sums, values[::-1].copy(), axes[:, ::-1].copy(), trace, scale, offset)


def _deviations(model: Whitening, x: np.ndarray) -> np.ndarray:
    """n x - S, exact: native words while the squares of all dimensions fit together."""
    reach = model.n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in model.sums)
    if reach * reach * model.width < 1 << 62:
        return model.n * x - np.array(model.sums, np.int64)
    return model.n * x.astype(object) - np.array(model.sums, object)


def project(model: Whitening, column: pa.ListArray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitened coordinates of the first components (rows x components) and the integer square deviations."""
    x = integers(column, model.width, model.scale, model.offset)
    off = _deviations(model, x)
    inverse, _ = model.scales(most)
    centred = off.astype(np.float64) / model.n if off.dtype != object else np.array(off / model.n, np.float64)
    return centred @ model.axes[:, :most] * inverse, (off * off).sum(axis=1)


def identity_error(vectors: DataFrame, model: Whitening, most: int, vector: str = "embedding") -> float:
    """Largest |entry| of the whitened rows' own covariance minus the identity, from a pass over all rows."""
    _, full = model.scales(most)
    live = np.flatnonzero(full)
    if not len(live):
        return 0.0
    k = len(live)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = project(model, batch.column("_vector"), most)[0][:, live]
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    got = finite_rows(vectors, vector).mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((k + 1) * k)
    for at, v in got:
        flat[at] = v
    flat = flat.reshape(k + 1, k) / model.n
    return float(np.abs(flat[:k] - np.outer(flat[k], flat[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, ident: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(ident, component, deviation, whitened): a row per usable vector and component, numbered from 1."""
    count = min(most, model.width)
    rows = finite_rows(vectors, vector, F.col(ident).alias("_ident"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, square = project(model, batch.column("_vector"), count)
            each = np.repeat(np.arange(batch.num_rows), count)
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("_ident").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                pa.array([int(v) for v in square], pa.int64()).take(pa.array(each)),
                pa.array(flat, mask=np.isnan(flat)),
            ], names=["_ident", "component", "deviation", "whitened"])

    kind = rows.schema["_ident"].dataType.simpleString()
    return rows.mapInArrow(work, f"_ident {kind}, component int, deviation bigint, whitened double").withColumnRenamed("_ident", ident)


def report(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """Whitened components of every usable row with the share of variance each explains and the error of the whitening."""
    model = fit(vectors, vector)
    if model is None:
        return vectors.where("false").select(
            ident, *[F.lit(None).cast(t).alias(c) for c, t in (
                ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                ("explained", "double"), ("identity_error", "double"))])
    share = [float(e) / model.trace if model.trace > 0 else None for e in model.values[:most]]
    shares = F.array(*[F.lit(s).cast("double") for s in share])
    error = identity_error(vectors, model, most, vector)
    return whiten(vectors, model, ident, vector, most).select(
        ident, "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
