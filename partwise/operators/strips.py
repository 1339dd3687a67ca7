"""Ranks and pair counts of numbers in strips: a task takes a bounded range of values of all groups.

Cuts at approximate quantiles of all rows bound the rows of a strip, whatever the table's size.  A value that is
a cut makes a strip of its own; it may be hot, but has neither ranks nor pairs inside, so it is never gathered.
Cuts only place the rows; results do not depend on them.  NaN is one value, above all others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from partwise.operators.packed import per_group, pieces
from partwise.session import cut_lineage

#: Rows that a task ranks at once.
STRIP = 1 << 18
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def numeric(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[c].dataType, _NUMBERS) for c in columns)


def cut_points(df: DataFrame, columns: Sequence[str], rows: int) -> list[np.ndarray]:
    """For each column the values between strips of about ``rows`` rows; ``df`` is stored."""
    width = ceil(df.count() / rows)
    if width <= 1:
        return [np.zeros(0)] * len(columns)
    at = [i / width for i in range(1, width)]
    found = df.agg(*[F.percentile_approx(c, at, 10 * width).alias(c) for c in columns]).first()
    return [np.unique(np.array(v)) for v in found]


def place(df: DataFrame, strips: dict[str, tuple[str, np.ndarray]]) -> DataFrame:
    """``df`` with int columns of strips, named by ``strips``: even between two cuts, odd at a cut; rising with the value.

    ``_n`` numbers the rows of a task, to deal those of a hot value evenly.
    """
    out = T.StructType([*df.schema.fields, T.StructField("_n", T.LongType()), *[T.StructField(s, T.IntegerType()) for s in strips]])

    def work(batches):
        n = 0
        for batch in batches:
            made = [pa.array(np.arange(n, n + batch.num_rows))]
            n += batch.num_rows
            for column, cuts in strips.values():
                v = batch.column(column).to_numpy(zero_copy_only=False)
                made.append(pa.array((np.searchsorted(cuts, v, "right") + np.searchsorted(cuts, v, "left")).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=out.names)

    return df.mapInArrow(work, out)


def _key_codes(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0.. of the rows' keys, a missing one like any other, and a row of each code."""
    codes = np.zeros(table.num_rows, np.int64)
    for k in keys:
        one = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = _dense(codes * max(len(one.dictionary), 1) + one.indices.to_numpy(zero_copy_only=False))
    some = np.zeros(codes.max(initial=-1) + 1, np.int64)
    some[codes] = np.arange(len(codes))
    return codes, some


def _per_strip(df: DataFrame, strip: str, strips: int, work: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``work`` on the rows of each strip; there are as many tasks as strips."""
    return df.repartition(max(strips, 1), strip).groupBy(strip).applyInArrow(work, schema)


def _dense(*columns: np.ndarray) -> np.ndarray:
    """The rank of each row in the order of the columns, equal rows sharing one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns:
        now, last = c[order][1:], c[order][:-1]
        new |= (now != last) & ((now == now) | (last == last))
    codes = np.zeros(len(order), np.int64)
    codes[order[1:]] = np.cumsum(new)
    return codes


def sum_above(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row, the weights of earlier rows with a larger code: two codes differ first at one bit."""
    out, at = np.zeros(len(codes)), np.arange(len(codes))
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        head, one = codes[at] >> (bit + 1), (codes[at] >> bit) & 1 == 1
        upto = np.concatenate([[0.0], np.cumsum(np.where(one, weights[at], 0.0))])
        first = np.maximum.accumulate(np.where(np.append(True, head[1:] != head[:-1]), np.arange(len(at)), 0))
        out[at[~one]] += (upto[:-1] - upto[first])[~one]
        at = at[np.argsort(codes[at] >> bit, kind="stable")]
    return out


def _crossed(keys: list[str], schema: T.StructType, x: str, y: str) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        key, some = _key_codes(table, keys)
        a, b, wa, wb = (table.column(c).to_numpy() for c in (x, y, "wa", "wb"))
        codes = _dense(key, b)
        order = np.lexsort((codes, _dense(key, a)))
        pairs = wb[order] * sum_above(codes[order], wa[order])
        return pa.table([*[table.column(k).take(pa.array(some)) for k in keys],
                         pa.array(np.bincount(key[order], weights=pairs, minlength=len(some)))], names=schema.names)

    return work


def crossed(pts: DataFrame, keys: Sequence[str], x: str, y: str, rows: int = STRIP, grid: Callable | None = None) -> DataFrame:
    """(keys, crossed): per key the sum of wa_i * wb_j over x_i < x_j and y_i > y_j.

    ``pts`` is stored, with numbers x and y.  A pair shares a strip of x, or else one of y, or neither; the
    third kind is counted on the totals of cells, by ``grid`` if the cells are more than ``rows``.
    """
    keys = list(keys)
    cx, cy = cut_points(pts, [x, y], rows)
    schema = T.StructType([*[pts.schema[k] for k in keys], T.StructField("crossed", T.DoubleType())])
    placed = place(pts.select(*keys, x, y, "wa", "wb"), {"_sx": (x, cx), "_sy": (y, cy)})
    parts = [_per_strip(placed.where("_sx % 2 = 0"), "_sx", len(cx) + 1, _crossed(keys, schema, x, y), schema)]
    if len(cx):
        parts.append(_per_strip(placed.where("_sy % 2 = 0"), "_sy", len(cy) + 1, _crossed(keys, schema, "_sx", y), schema))
        cells = cut_lineage(placed.groupBy(*keys, "_sx", "_sy").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb")))
        if grid is not None and cells.count() > rows:
            parts.append(grid(cells, keys, "_sx", "_sy").select(*keys, "crossed"))
        else:
            parts.append(_per_strip(cells.withColumn("_all", F.lit(0)), "_all", 1, _crossed(keys, schema, "_sx", "_sy"), schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("crossed").alias("crossed"))


def _spread(tally: DataFrame, rows: int, cuts: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side the first group of a strip and its number of groups: one, or more for a hot value."""
    sizes = [np.zeros(2 * len(c) + 1, np.int64) for c in cuts]
    for side, strip, n in tally.groupBy("_side", "_s").agg(F.sum("_w")).collect():
        sizes[side][strip] = n
    out = []
    for size in sizes:
        shares = np.ones(len(size), np.int64)
        shares[1::2] = np.maximum(1, -(-size[1::2] // rows))
        out.append((np.cumsum(shares) - shares, shares))
    return out


def _places(tally: DataFrame, keys: list[str], side: int, first: np.ndarray, shares: np.ndarray) -> DataFrame:
    """(keys, _s, _o, _g): the mean rank of a strip, less that of its key, for each group of the strip."""
    own = tally.where(F.col("_side") == side)
    upto = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("_w").over(upto) - F.col("_w") / 2.0 - F.sum("_w").over(Window.partitionBy(*keys)) / 2.0
    spots = own.select(*keys, "_s", middle.alias("_o"))
    groups = own.sparkSession.createDataFrame([(s, int(a + i)) for s, (a, n) in enumerate(zip(first, shares)) for i in range(n)], "_s int, _g int")
    return spots.join(F.broadcast(groups), "_s").select(*keys, "_s", "_o", "_g")


def _ranked(keys: list[str], value: str, strip: str) -> Callable[[pa.Table, pa.Table], np.ndarray]:
    """The average ranks of the rows of one group, less their key's mean: the strip's place plus the place inside it."""

    def ranks(table: pa.Table, spots: pa.Table) -> np.ndarray:
        n = table.num_rows
        both = pa.concat_tables([table.select([*keys, strip]), spots.select([*keys, "_s"]).rename_columns([*keys, strip])], promote_options="permissive")
        key, _ = _key_codes(both, [*keys, strip])
        place_of = np.zeros(key.max(initial=-1) + 1)
        place_of[key[n:]] = spots.column("_o").to_numpy()
        key = key[:n]
        strips = table.column(strip).to_numpy()
        out = place_of[key]
        if strips[0] % 2 == 0:
            codes = _dense(key, table.column(value).to_numpy())
            there = np.bincount(codes)
            of = np.zeros(len(there), np.int64)
            of[codes] = key
            size = np.bincount(key)
            ends = np.cumsum(there)
            starts = np.cumsum(size) - size
            out = out + (ends - there / 2.0 - starts[of] - size[of] / 2.0)[codes]
        return out

    return ranks


def _tally(placed: DataFrame, keys: list[str], strips: Sequence[str]) -> DataFrame:
    """(keys, _side, _s, _w): how many rows of a key a strip has; stored."""
    sides = [placed.groupBy(*keys, F.lit(i).alias("_side"), F.col(s).alias("_s")).agg(F.count("*").alias("_w")) for i, s in enumerate(strips)]
    return cut_lineage(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]))


def centred_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, rows: int = STRIP) -> DataFrame:
    """``df`` with the average rank of a number inside keys, less its mean, in place of the value.  ``df`` is stored, without a missing value."""
    keys = list(keys)
    (cuts,) = cut_points(df, [value], rows)
    placed = place(df, {"_s": (value, cuts)}).drop("_n")
    tally = _tally(placed, keys, ["_s"])
    (spread,) = _spread(tally, rows, [cuts])
    rank = _ranked(keys, value, "_s")
    kept = [f for f in df.schema.fields if f.name != value]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def work(table: pa.Table, spots: pa.Table) -> pa.Table:
        return table.select([f.name for f in kept]).append_column(name, pa.array(rank(table, spots)))

    sent = pieces(placed, "_s", *spread, [*keys, value])
    return per_group(sent, placed.schema, int(spread[1].sum()), work, schema, _places(tally, keys, 0, *spread))


def rank_sums(pairs: DataFrame, keys: Sequence[str], x: str, y: str, rows: int = STRIP) -> DataFrame:
    """(keys, n, _xy, _xx, _yy): products of average ranks of x and y, less their mean, for keys of any size.

    ``pairs`` is stored, with numbers x and y.  Rows are dealt by strips of x, which gives their rank in x, and
    by strips of y, where their products are added: two moves of compressed rows, and a row per key and strip.
    """
    keys = list(keys)
    pairs = pairs.select(*keys, x, y)
    cx, cy = cut_points(pairs, [x, y], rows)
    placed = place(pairs, {"_sx": (x, cx), "_sy": (y, cy)}).drop("_n")
    tally = _tally(placed, keys, ["_sx", "_sy"])
    by_x, by_y = _spread(tally, rows, [cx, cy])
    rank_x, rank_y = _ranked(keys, x, "_sx"), _ranked(keys, y, "_sy")
    own = [pairs.schema[k] for k in keys]
    half = T.StructType([*own, pairs.schema[y], T.StructField("_sy", T.IntegerType()), T.StructField("_a", T.DoubleType())])
    names = ["n", "_xy", "_xx", "_yy"]
    sums = T.StructType([*own, *[T.StructField(c, T.DoubleType()) for c in names]])

    def first(table: pa.Table, spots: pa.Table) -> pa.Table:
        return table.select([*keys, y, "_sy"]).append_column("_a", pa.array(rank_x(table, spots)))

    def second(table: pa.Table, spots: pa.Table) -> pa.Table:
        a, b = table.column("_a").to_numpy(), rank_y(table, spots)
        key, some = _key_codes(table, keys)
        added = [np.bincount(key, weights=w, minlength=len(some)) for w in (None, a * b, a * a, b * b)]
        return pa.table([*[table.column(k).take(pa.array(some)) for k in keys], *[pa.array(s.astype(float)) for s in added]], names=sums.names)

    halves = per_group(pieces(placed, "_sx", *by_x, [*keys, x]), placed.schema, int(by_x[1].sum()), first, half, _places(tally, keys, 0, *by_x))
    done = per_group(pieces(halves, "_sy", *by_y, [*keys, y]), half, int(by_y[1].sum()), second, sums, _places(tally, keys, 1, *by_y))
    return done.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in names[1:]])


def unit_products(ranked: DataFrame, keys: Sequence[str], setting: str, unit: Sequence[str], rank: str, n_rows: int, rows: int = STRIP) -> DataFrame:
    """(keys, n_settings, n_units, _q): the mean over units of the square of a unit's sum of standardised ranks.

    ``ranked`` has ``n_rows`` rows with centred ranks.  Settings without spread do not count, nor units that have no
    other.  A task holds all rows of its units and hands on one table of products of settings per key.
    """
    keys, unit = list(keys), list(unit)
    buckets = max(1, ceil(n_rows / rows))
    dealt = ranked.select(*keys, *unit, setting, rank, F.pmod(F.xxhash64(*keys, *unit), F.lit(buckets)).cast("int").alias("_b"))
    own = [dealt.schema[k] for k in keys]
    numbers, counts = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
    part = T.StructType([*own, T.StructField("_names", T.ArrayType(dealt.schema[setting].dataType)), T.StructField("_gram", numbers),
                         T.StructField("_own", numbers), T.StructField("_rows", counts), T.StructField("_kinds", counts), T.StructField("_units", counts)])
    out = T.StructType([*own, T.StructField("n_settings", T.LongType()), T.StructField("n_units", T.LongType()), T.StructField("_q", T.DoubleType())])

    def work(table: pa.Table) -> pa.Table:
        which, at_unit = _key_codes(table, [*keys, *unit])
        key, some = _key_codes(table, keys)
        column, at_name = _key_codes(table, [setting])
        r = table.column(rank).to_numpy()
        width = len(at_name)
        spots = which * width + column
        total = np.bincount(spots, weights=r, minlength=len(at_unit) * width).reshape(-1, width)
        times = np.bincount(spots, minlength=len(at_unit) * width).reshape(-1, width)
        names = table.column(setting).take(pa.array(at_name)).to_pylist()
        made = []
        for k in range(len(some)):
            mine = key[at_unit] == k
            kinds, units = np.unique(times[mine], axis=0, return_counts=True)
            here = key == k
            made.append([(total[mine].T @ total[mine]).ravel().tolist(), np.bincount(column[here], weights=r[here] ** 2, minlength=width).tolist(),
                         times[mine].sum(axis=0).tolist(), kinds.ravel().tolist(), units.tolist()])
        return pa.table([*[table.column(c).take(pa.array(some)) for c in keys], *[
            pa.array(x, f.type) for x, f in zip([[names] * len(some), *zip(*made)], list(to_arrow_schema(part))[len(keys):])]], names=part.names)

    def merge(table: pa.Table) -> pa.Table:
        got = table.select(part.names[len(keys):]).to_pylist()
        names = {n: i for i, n in enumerate(dict.fromkeys(n for g in got for n in g["_names"]))}
        gram, square, n = np.zeros((len(names), len(names))), np.zeros(len(names)), np.zeros(len(names))
        for g in got:
            at = [names[x] for x in g["_names"]]
            gram[np.ix_(at, at)] += np.array(g["_gram"]).reshape(len(at), -1)
            square[at] += g["_own"]
            n[at] += g["_rows"]
        good = square > 0
        scale = np.where(good, np.sqrt(np.where(good, n, 0) / np.where(good, square, 1)), 0)
        settings = units = 0
        for g in got:
            valid = np.array([good[names[x]] for x in g["_names"]])
            for kind, times in zip(np.array(g["_kinds"]).reshape(-1, len(valid)), g["_units"]):
                own_rows = int(kind[valid].sum())
                settings, units = max(settings, own_rows), units + times * (own_rows > 0)
        rows_of = 0 if units == 0 else 1
        one = table.slice(0, rows_of)
        q = [scale @ gram @ scale / units] * rows_of
        return pa.table([*[one.column(k) for k in keys], pa.array([settings] * rows_of, pa.int64()), pa.array([units] * rows_of, pa.int64()),
                         pa.array(q, pa.float64())], names=out.names)

    sent = pieces(dealt, "_b", np.arange(buckets), np.ones(buckets, np.int64), [*keys, *unit])
    return per_group(sent, dealt.schema, buckets, work, part).groupBy(*keys).applyInArrow(merge, out)
