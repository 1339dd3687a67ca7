"""Comparing two versions of a table or document, and certifying content."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from partwise.functions.guards import ratio
from partwise.session import parallelism


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float) -> DataFrame:
    """Per key: reproduced, noise (within a relative tolerance), changed, new or lost."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_n"))
    same, near = F.lit(True), F.lit(True)
    for v in values:
        a, b = F.col(f"old_{v}"), F.col(f"new_{v}")
        same = same & a.eqNullSafe(b)
        gap = ratio(F.abs(a - b), F.greatest(F.lit(1.0), F.abs(a)))
        near = near & F.coalesce(gap <= tol, a.isNull() & b.isNull())
    status = (F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "lost").when(same, "reproduced")
              .when(near, "noise").otherwise("changed"))
    return o.join(n, list(keys), "full").withColumn("status", status).drop("_o", "_n")


def row_hash(columns: Sequence[str]):
    """32 bits of md5 over the row, missing marked."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def content_hash(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free certificate per key: row count, sums of the hash halves, and xor.

    The halves are summed apart so that a sum cannot overflow at any table size.
    Put the position among the columns to make it order-sensitive.  All three
    parts combine map-side, so a table of any size is certified without a sort.
    """
    h = row_hash(columns)
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(F.shiftright(h, 16)).alias("hash_hi"),
                                F.sum(h.bitwiseAND(F.lit(65535))).alias("hash_lo"), F.bit_xor(h).alias("hash_xor"))


#: Fixed values of the ordered hash: a prime modulus and a base below it.
ORDER_PRIME, ORDER_BASE = 2**31 - 1, 1_000_003


def chained(first: tuple[int, int], then: tuple[int, int]) -> tuple[int, int]:
    """(rows, hash) of one run of rows followed by another; associative, so runs may be cut anywhere."""
    return first[0] + then[0], (first[1] * pow(ORDER_BASE, then[0], ORDER_PRIME) + then[1]) % ORDER_PRIME


def ordered_hash(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n_rows, hash_ordered): a certificate of the rows in the order of ``order``, ties by their hash.

    Rows are dealt by ranges of (keys, order), so no task sorts them all; a task reduces the
    rows that it holds of a key to a length and a polynomial, and the few runs of a key are
    chained in order.
    """
    keys = list(keys)
    rows = df.select(*keys, F.struct(*order).alias("_o"), row_hash(columns).alias("_h"))
    ranged = rows.repartitionByRange(parallelism(df.sparkSession), *keys, "_o", "_h").sortWithinPartitions(*keys, "_o", "_h")
    own = [rows.schema[k] for k in keys]
    schema = T.StructType([*own, T.StructField("_part", T.IntegerType()), T.StructField("n_rows", T.LongType()), T.StructField("hash_ordered", T.LongType())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.ones(8192, np.int64)
        for i in range(1, len(powers)):
            powers[i] = powers[i - 1] * ORDER_BASE % ORDER_PRIME
        part = TaskContext.get().partitionId()
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            h = batch.column("_h").to_numpy() % ORDER_PRIME
            for run in np.split(np.arange(batch.num_rows), np.flatnonzero(change)):
                if not len(run):
                    continue
                name = tuple(batch.column(k)[int(run[0])].as_py() for k in keys)
                for lo in range(0, len(run), len(powers)):
                    piece = h[run[lo:lo + len(powers)]]
                    value = int((piece * powers[:len(piece)][::-1] % ORDER_PRIME).sum() % ORDER_PRIME)
                    held[name] = chained(held.get(name, (0, 0)), (len(piece), value))
            if len(held) > 10_000:
                # Sorted rows: only the last key can go on.
                last = list(held)[-1]
                yield out(part, {k: v for k, v in held.items() if k != last})
                held = {last: held[last]}
        if held:
            yield out(part, held)

    kinds = [to_arrow_type(f.dataType) for f in own]

    def out(part: int, held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k in held], kinds[i]) for i in range(len(keys))], pa.array([part] * len(held), pa.int32()),
             pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=schema.names)

    # One row per key and task; a run's place is its task's number, as tasks hold ascending ranges.
    runs = ranged.mapInArrow(reduce, schema)
    chain = T.StructType([*own, T.StructField("n_rows", T.LongType()), T.StructField("hash_ordered", T.LongType())])

    def join(table: pa.Table) -> pa.Table:
        total = (0, 0)
        for _, n, h in sorted(zip(*(table.column(c).to_pylist() for c in ("_part", "n_rows", "hash_ordered")))):
            total = chained(total, (n, h))
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "n_rows": pa.array([total[0]], pa.int64()),
                         "hash_ordered": pa.array([total[1]], pa.int64())})

    return runs.groupBy(*keys).applyInArrow(join, chain)


def distinct_settings(df: DataFrame, setting: str, pos: str, columns: Sequence[str]) -> DataFrame:
    """Settings with identical output collapse onto the first of them."""
    cert = content_hash(df, [setting, pos], columns)
    return cert.groupBy("n_rows", "hash_hi", "hash_lo", "hash_xor").agg(
        F.min_by(setting, pos).alias("kept"), F.count("*").alias("n_settings"))


def leaf_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], tol: float, ignore: str) -> DataFrame:
    """Compare (keys, path, scalar) leaves: missing, extra, differs; paths matching ``ignore`` left out."""
    side = lambda d, name: d.where(~F.col("path").rlike(ignore)).select(
        *keys, "path", F.col("scalar").alias(name), F.lit(True).alias(f"_{name}"))
    j = side(old, "old").join(side(new, "new"), [*keys, "path"], "full")
    a, b = F.expr("try_cast(old AS double)"), F.expr("try_cast(new AS double)")
    close = F.coalesce(F.abs(a - b) <= tol * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False))
    status = (F.when(F.col("_old").isNull(), "extra").when(F.col("_new").isNull(), "missing")
              .when(F.col("old").eqNullSafe(F.col("new")) | close, "same").otherwise("differs"))
    return j.withColumn("status", status).drop("_old", "_new")


def complete_features(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Rows of the features without any missing value."""
    whole = df.groupBy(feature).agg(F.count(value).alias("_v"), F.count("*").alias("_n")).where("_v = _n").select(feature)
    return df.join(whole, feature, "left_semi")


def covered_samples(df: DataFrame, sample: str, value: str, threshold: float) -> DataFrame:
    """Samples whose share of present values reaches the threshold."""
    got = df.groupBy(sample).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))
    return got.where(F.col("coverage") >= threshold)
