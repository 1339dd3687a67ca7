"""Shuffles without sorting: a keyed bijection of 0..n-1, and nulls summed in blocks of draws.

The bijection is the swap-or-not shuffle.  In each round a position x has the partner
(turn - x) mod n; both make the same bit from the larger of the two, and if it is set they
change places.  That is one to one for any n, needs no table, and any position can be moved
on its own, so no draw is ever sorted or joined and rows never multiply by draws: a task
turns its own rows into sums for all draws.

Rows of one group may lie in any number of tasks.  Each task hands on one array of sums per
group and block of draws; they are added in groups of at most as many arrays as there are
tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from partwise.functions.draws import hash32
from partwise.functions.guards import ratio
from partwise.operators.ranks import hash_positions
from partwise.session import cut_lineage, parallelism

#: The modulus 2^31 - 1 with two of its well known multipliers, rounds, and a published pair of multipliers
#: for mixing 32-bit words.
PRIME, FIRST, SECOND, ROUNDS, WORD, MIX = 2**31 - 1, 48271, 16807, 24, 2**32 - 1, (0x21F0AAAD, 0x735A2D97)

#: Numbers that are moved at once, so that they stay in cache.
CACHE = 16384
#: Draws of one block.
BLOCK = 50
#: Columns that a sample may have.
MOST_COLUMNS = 4096
#: Sums that a task keeps before it hands them on, and shuffled positions that it keeps for reuse, in bytes.
TABLE_BYTES = 1 << 26
#: Units whose ranks travel as one array, of 64 MB at most; more are joined by position.
DENSE_UNITS = 1 << 24
#: Bytes of ranks that a task holds to move them together.
HELD_BYTES = 1 << 30
#: Bytes of ranks that share a task's moves; a table of more is cut, so that a task reads no more.
MOVED_BYTES = 1 << 28
#: Units of a key whose picks a task makes for itself; picks of more are made once per draw and shared by tasks.
PICKED_UNITS = 1 << 14


def round_numbers() -> list[tuple[int, int]]:
    """Two multipliers for each round."""
    return [(pow(FIRST, r, PRIME), pow(SECOND, r, PRIME)) for r in range(1, ROUNDS + 1)]


def permuted(at: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Where each position of 0..size-1 goes under each key: positions x keys."""
    k = keys.astype(np.int64) % PRIME
    rounds = []
    for a, b in round_numbers():
        turn, offset = (k * a + b) % PRIME, (k * b + a) % PRIME
        rounds.append((turn * turn % PRIME % size, offset * offset % PRIME))
    move = _narrow if size < 1 << 31 else _wide
    kind = np.int32 if size < 1 << 31 else np.int64
    out = np.empty((len(at), len(keys)), kind)
    rounds = [(turn.astype(kind), offset.astype(kind)) for turn, offset in rounds]
    step = max(1, CACHE // max(1, len(keys)))
    for lo in range(0, len(at), step):
        x = np.repeat(at[lo:lo + step, None].astype(kind), len(keys), axis=1)
        move(x, size, rounds)
        out[lo:lo + step] = x
    return out


def _narrow(x: np.ndarray, size: int, rounds: list) -> None:
    """All rounds in place, in 32-bit words that wrap."""
    y, u = np.empty_like(x), np.empty_like(x)
    word = u.view(np.uint32)
    shifted = np.empty_like(word)
    for turn, offset in rounds:
        np.subtract(turn, x, out=y)
        np.right_shift(y, 31, out=u)
        np.bitwise_and(u, np.int32(size), out=u)
        np.add(y, u, out=y)
        np.maximum(x, y, out=u)
        np.add(word, offset.view(np.uint32), out=word)
        np.multiply(word, np.uint32(MIX[0]), out=word)
        np.right_shift(word, np.uint32(15), out=shifted)
        np.bitwise_xor(word, shifted, out=word)
        np.multiply(word, np.uint32(MIX[1]), out=word)
        # The top bit, as a mask of ones or zeros, decides.
        np.right_shift(u, 31, out=u)
        np.bitwise_xor(x, y, out=y)
        np.bitwise_and(y, u, out=y)
        np.bitwise_xor(x, y, out=x)


def _wide(x: np.ndarray, size: int, rounds: list) -> None:
    """The same for groups of 2^31 samples and more."""
    for turn, offset in rounds:
        y = (turn - x) % size
        u = (np.maximum(x, y) + offset & WORD) * MIX[0] & WORD
        u = (u ^ u >> 15) * MIX[1] & WORD
        x[...] = np.where(u >> 31 == 1, y, x)


def draw_keys(seed: str, group: str | None, draws: Sequence[int]) -> np.ndarray:
    """The first 32 bits of md5 over seed, draw and group: the key of a draw inside a group."""
    tail = "" if group is None else f"|{group}"
    return np.array([int(hashlib.md5(f"{seed}|{d}{tail}".encode()).hexdigest()[:8], 16) for d in draws], np.int64)


def _text(groups: Sequence[str]) -> Column:
    """The name of a group in the keys of its draws."""
    return F.concat_ws("|", *[F.col(g).cast("string") for g in groups]) if groups else F.lit(None).cast("string")


def sizes(samples: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    """groups, ``_size``, ``_cuts``, ``_labels``: one row per group of labelled samples, as in ``place``."""
    groups = list(groups)
    counts = samples.select(*groups, F.col(label).alias("_label")).where(F.col("_label").isNotNull()).groupBy(
        *groups, "_label").agg(F.count("*").alias("_n"))
    by = F.array_sort(F.collect_list(F.struct(F.col("_label").alias("label"), F.col("_n").alias("n"))))
    sized = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"), by.alias("_by"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("_by")), lambda i: F.aggregate(
        F.slice("_by", F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, x: acc + x.n))
    return sized.select(*groups, "_size", cuts.alias("_cuts"), F.transform("_by", lambda x: x.label).alias("_labels"))


def place(samples: DataFrame, groups: Sequence[str], label: str, ident: str, seed: str) -> DataFrame:
    """Labelled samples with their place: ident, groups, ``_group``, ``_own``, ``_at``, ``_size``, ``_cuts``, ``_labels``.

    ``_at`` numbers a group's samples from 0 by a hash of (seed, ident).  Position p holds the
    first label of ``_labels`` whose cumulated count in ``_cuts`` exceeds p; there is one
    entry per label of the roster.  ``_own`` is the number of the sample's own label.
    """
    groups = list(groups)
    thin = samples.select(*groups, F.col(label).alias("_label"), ident).where(F.col("_label").isNotNull())
    sized = sizes(samples, groups, label)
    if groups:
        rows = thin.join(sized, groups)
    else:
        rows = thin.withColumn("_one", sized.select(F.struct("*")).scalar()).select(ident, "_label", "_one.*")
    rows = rows.withColumn("_own", (F.array_position("_labels", F.col("_label")) - 1).cast("int")).drop("_label")
    placed = hash_positions(rows, groups, ident, hash32(F.lit(seed), F.lit("base"), ident), "_size", "_at")
    return placed.withColumn("_at", F.col("_at") - 1).withColumn("_group", _text(groups))


def permute_labels(samples: DataFrame, groups: Sequence[str], label: str, ident: str, n_draws: int, seed: str) -> DataFrame:
    """(draw, ident, groups, label): labels shuffled inside each group, once per draw.

    Group sizes and label counts are kept, as the shuffle is a bijection of positions.  For
    statistics that are sums per label, ``permuted_sums`` needs no row per draw.
    """
    groups = list(groups)
    placed = place(samples, groups, label, ident, seed).withColumnRenamed(ident, "_ident")
    kind = samples.schema[label]
    own = [f for f in placed.schema.fields if f.name in ("_ident", *groups)]
    schema = StructType([StructField("draw", IntegerType()), *own, StructField("_label", kind.dataType)])
    draws = range(1, n_draws + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 200_000 // n_draws)
        for batch in batches:
            for group, rows in _groups(batch):
                keys = draw_keys(seed, group, draws)
                for lo in range(0, len(rows), step):
                    some = pa.array(rows[lo:lo + step])
                    part = batch.take(some)
                    at, size, cuts, labels = _placing(part)
                    which = labels_at(permuted(at, size, keys), cuts).ravel()
                    each = pa.array(np.repeat(np.arange(len(at)), n_draws))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(1, n_draws + 1), len(at)), pa.int32()),
                         *[part.column(f.name).take(each) for f in own], labels.take(pa.array(which))], names=schema.names)

    out = placed.mapInArrow(work, schema)
    return out.select("draw", F.col("_ident").alias(ident), *groups, F.col("_label").alias(label))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray]]:
    """The groups of a batch and their row numbers, in order."""
    column = batch.column("_group")
    if batch.num_rows and column.null_count == batch.num_rows:
        yield None, np.arange(batch.num_rows)
        return
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(rows):
            yield coded.dictionary[int(codes[rows[0]])].as_py(), rows


def _placing(part: pa.RecordBatch) -> tuple[np.ndarray, int, np.ndarray, pa.Array]:
    """Positions, and the size, cuts and labels that all rows of one group share."""
    return (part.column("_at").to_numpy(), part.column("_size")[0].as_py(),
            np.array(part.column("_cuts")[0].as_py(), np.int64), part.column("_labels")[0].values)


def labels_at(moved: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The number of the label that each position holds."""
    if int(cuts[-1]) > TABLE_BYTES:
        return np.searchsorted(cuts, moved, side="right")
    return np.repeat(np.arange(len(cuts), dtype=np.int32), np.diff(cuts, prepend=0))[moved]


def roster(values: DataFrame, names: Sequence[str]) -> list[tuple]:
    """The distinct keys of a long table, sorted: the columns of the wide one.  More than MOST_COLUMNS are an error."""
    if not names:
        return [()]
    found = values.select(*names).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    return sorted((tuple(r) for r in found), key=lambda r: tuple(str(x) for x in r))


def widened(values: DataFrame, names: Sequence[str], columns: Sequence[tuple], ident: str, value: str = "value") -> DataFrame:
    """(ident, _cells): one row per sample with the (column number, value) pairs that are present."""
    present = values.where(F.col(value).isNotNull())
    if names:
        schema = StructType([*[values.schema[n] for n in names], StructField("_k", IntegerType())])
        numbered = values.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(columns)], schema)
        present = present.join(numbered, list(names))
    else:
        present = present.withColumn("_k", F.lit(0))
    return present.groupBy(ident).agg(F.collect_list(F.struct(F.col("_k").alias("k"), F.col(value).cast("double").alias("v"))).alias("_cells"))


def _dense(cells: pa.ListArray, width: int) -> np.ndarray:
    """Rows x columns, NaN where a value is absent."""
    out = np.full((len(cells), width), np.nan)
    flat = cells.flatten()
    rows = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    out[rows, flat.field("k").to_numpy(zero_copy_only=False)] = flat.field("v").to_numpy(zero_copy_only=False)
    return out


def permuted_sums(placed: DataFrame, groups: Sequence[str], width: int, n_draws: int, seed: str) -> DataFrame:
    """Sums and counts of every column per label, for all draws at once.

    ``placed`` is ``place(...)`` joined with ``_cells``.  A row of the result is (groups,
    ``_first``, ``_labels``, ``_sums``, ``_counts``): the last two are labels x draws x columns
    of the draws from ``_first`` on, as little-endian doubles.  Draw 0 holds the labels as they are.
    """
    groups = list(groups)
    own = [placed.schema[g] for g in groups]
    schema = StructType([*own, StructField("_first", IntegerType()), placed.schema["_labels"],
                         StructField("_sums", BinaryType()), StructField("_counts", BinaryType())])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for keys, labels, sums, counts in held.values():
            for lo in range(0, n_draws + 1, BLOCK):
                piece = [np.ascontiguousarray(x[:, lo:lo + BLOCK]).tobytes() for x in (sums, counts)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([k], keys_type) for k, keys_type in keys], pa.array([lo], pa.int32()),
                     pa.array([labels.to_pylist()], pa.list_(labels.type)), pa.array([piece[0]], pa.binary()), pa.array([piece[1]], pa.binary())],
                    names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for group, some in _groups(batch):
                part = batch.take(pa.array(some))
                at, size, cuts, labels = _placing(part)
                if group not in held:
                    # A task keeps a bounded number of sums; the rest goes on early.
                    if held and (len(held) + 1) * len(cuts) * (n_draws + 1) * width * 16 > TABLE_BYTES * 2:
                        yield from rows(held)
                        held.clear()
                    shape = (len(cuts), n_draws + 1, width)
                    keys = [(part.column(g)[0].as_py(), part.column(g).type) for g in groups]
                    held[group] = (keys, labels, np.zeros(shape), np.zeros(shape))
                _, _, sums, counts = held[group]
                dense = _dense(part.column("_cells"), width)
                for lo in range(0, len(at), 2048):
                    x = dense[lo:lo + 2048]
                    there = ~np.isnan(x)
                    whole = there.all()
                    x = np.where(there, x, 0.0)
                    for first in range(0, n_draws + 1, 256):
                        draws = range(first, min(first + 256, n_draws + 1))
                        moved = permuted(at[lo:lo + 2048], size, draw_keys(seed, group, draws))
                        which = labels_at(moved, cuts)
                        if first == 0:
                            which[:, 0] = part.column("_own").to_numpy()[lo:lo + 2048]
                        for s in range(len(cuts)):
                            hit = (which == s).astype(np.float64)
                            sums[s, first:first + 256] += hit.T @ x
                            counts[s, first:first + 256] += hit.sum(axis=0)[:, None] if whole else hit.T @ there
        yield from rows(held)

    def merge(table: pa.Table) -> pa.Table:
        if table.num_rows == 1:
            return table.select(schema.names)
        added = [sum(np.frombuffer(b.as_py()) for b in table.column(c)) for c in ("_sums", "_counts")]
        one = table.slice(0, 1).select(schema.names[:-2])
        for name, x in zip(("_sums", "_counts"), added):
            one = one.append_column(name, pa.array([x.tobytes()], pa.binary()))
        return one

    return placed.mapInArrow(work, schema).groupBy(*groups, "_first").applyInArrow(merge, schema)


def tables_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(row, first draw, labels, sums, counts) of rows of ``permuted_sums``; arrays are labels x draws x columns."""
    for i in range(batch.num_rows):
        labels = batch.column("_labels")[i].as_py()
        shape = (len(labels), -1, width)
        sums, counts = (np.frombuffer(batch.column(c)[i].as_py()).reshape(shape) for c in ("_sums", "_counts"))
        yield i, batch.column("_first")[i].as_py(), labels, sums, counts


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    return x if digits is None else np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


def permuted_means(sums: DataFrame, groups: Sequence[str], names: Sequence[str], columns: Sequence[tuple], value_kinds: Sequence,
                   digits: int | None = None) -> DataFrame:
    """(groups, draw, label, names, v, n): the means of ``permuted_sums`` as rows; draw 0 is the observed one."""
    groups = list(groups)
    own = [sums.schema[g] for g in groups]
    width = len(columns)
    label = sums.schema["_labels"].dataType.elementType
    schema = StructType([*own, StructField("draw", IntegerType()), StructField("label", label), StructField("_k", IntegerType()),
                         StructField("v", DoubleType()), StructField("n", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("_labels").type.value_type
            for i, first, labels, total, counts in tables_of(batch, width):
                s, d, k = np.nonzero(counts)
                n = counts[s, d, k]
                each = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(g).take(each) for g in groups], pa.array(d + first, pa.int32()),
                     pa.array(labels, kind).take(pa.array(s)), pa.array(k, pa.int32()),
                     pa.array(rounded(total[s, d, k] / n, digits)), pa.array(n.astype(np.int64))], names=schema.names)

    out = sums.mapInArrow(work, schema)
    for at, (name, kind) in enumerate(zip(names, value_kinds)):
        lookup = F.array(*[F.lit(c[at]).cast(kind) for c in columns])
        out = out.withColumn(name, F.get(lookup, F.col("_k")))
    return out.drop("_k")


def constraint_sides(terms: DataFrame) -> list[tuple[str, str, str, float, list[str]]]:
    """(id, kind, part, weight, structures in order) of a table of constraint terms, written by hand and small."""
    out: dict = {}
    for r in terms.orderBy("id", "pos").collect():
        out.setdefault(r["id"], (r["id"], r["kind"], r["part"], r["weight"], []))[4].append(r["structure"])
    return list(out.values())


def judged(kind: str, v: list[np.ndarray], min_others: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(satisfied, evaluable) of a constraint whose structures have the means ``v`` (NaN: absent), elementwise."""
    there = [~np.isnan(x) for x in v]
    with np.errstate(invalid="ignore"):
        if kind == "pairwise":
            can, ok = there[0] & there[1], v[0] > v[1]
        elif kind == "maximum":
            others = np.stack(v[1:])
            best = np.where(np.isnan(others), -np.inf, others).max(axis=0)
            can, ok = there[0] & (sum(t.astype(int) for t in there[1:]) >= min_others), v[0] > best
        else:
            can = np.logical_and.reduce(there)
            ok = np.logical_and.reduce([a < b for a, b in zip(v, v[1:])])
    return ok & can, can


def score_tables(sums: DataFrame, group: str, keys: Sequence[str], columns: Sequence[tuple], key_kinds: Sequence,
                 constraints: Sequence[tuple], digits: int | None = None, min_others: int = 2, by_id: bool = False) -> DataFrame:
    """(group, draw, keys, num, den): satisfied and evaluable weight per group; with ``by_id`` also per constraint.

    ``columns`` are (keys, part).  Draw 0 is the observed one.
    """
    keys = list(keys)
    width = len(columns)
    who = sorted({c[:-1] for c in columns}, key=lambda r: tuple(str(x) for x in r))
    at = {c: i for i, c in enumerate(columns)}
    schema = StructType([sums.schema[group], StructField("draw", IntegerType()), StructField("_m", IntegerType()), StructField("_c", IntegerType()),
                         StructField("num", DoubleType()), StructField("den", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first, labels, total, counts in tables_of(batch, width):
                with np.errstate(invalid="ignore"):
                    mean = rounded(np.where(counts > 0, total / counts, np.nan), digits)
                draws = mean.shape[1]
                mean = np.concatenate([mean, np.full((1, draws, width), np.nan)])
                mean = np.concatenate([mean, np.full((len(mean), draws, 1), np.nan)], axis=2)
                place = {s: j for j, s in enumerate(labels)}
                num = np.zeros((len(constraints) if by_id else 1, draws, len(who)))
                den = np.zeros_like(num)
                for c, (_, kind, part, weight, structures) in enumerate(constraints):
                    cols = [at.get((*w, part), width) for w in who]
                    ok, can = judged(kind, [mean[place.get(s, len(labels))][:, cols] for s in structures], min_others)
                    num[c if by_id else 0] += weight * ok
                    den[c if by_id else 0] += weight * can
                c, d, m = np.nonzero(den)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(group).take(pa.array(np.full(len(d), i))), pa.array(d + first, pa.int32()), pa.array(m, pa.int32()),
                     pa.array(c, pa.int32()), pa.array(num[c, d, m]), pa.array(den[c, d, m])], names=schema.names)

    out = sums.mapInArrow(work, schema)
    for j, (name, kind) in enumerate(zip(keys, key_kinds)):
        out = out.withColumn(name, F.get(F.array(*[F.lit(w[j]).cast(kind) for w in who]), F.col("_m")))
    if by_id:
        out = out.withColumn("id", F.get(F.array(*[F.lit(c[0]) for c in constraints]), F.col("_c")))
    return out.drop("_m", "_c")


def score_draws(est: DataFrame, samples: DataFrame, terms: DataFrame, n_draws: int, seed: str, digits: int | None = None,
                keys: Sequence[str] = ("method",), min_others: int = 2, by_id: bool = False, who: Sequence[tuple] | None = None) -> DataFrame:
    """(tumour, draw, keys, num, den) for the observed labels (draw 0) and every shuffle of structures inside tumours.

    ``who`` lists the values of ``keys`` if they are known, which saves a pass.
    """
    keys = list(keys)
    constraints = constraint_sides(terms)
    parts = sorted({c[2] for c in constraints})
    used = est.where(F.col("part").isin(parts))
    columns = roster(used, [*keys, "part"]) if who is None else [(*w, p) for w in who for p in parts]
    placed = place(samples, ["tumour"], "structure", "sample", seed)
    rows = placed.join(widened(used, [*keys, "part"], columns, "sample"), "sample")
    sums = permuted_sums(rows, ["tumour"], len(columns), n_draws, seed)
    return score_tables(sums, "tumour", keys, columns, [est.schema[k].dataType for k in keys], constraints, digits, min_others, by_id)


def null_p(draws: DataFrame, keys: Sequence[str], stat: str, tol: float = 1e-9) -> DataFrame:
    """(keys, observed, n_draws, null_mean, p_value): draw 0 against the others, (hits + 1) / (n + 1)."""
    seen = draws.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col(stat))).alias("observed"), F.array_agg(
        F.when(F.col("draw") > 0, F.col(stat))).alias("_null"))
    hits = F.size(F.filter("_null", lambda x: x >= F.col("observed") - tol))
    n = F.size("_null")
    mean = ratio(F.aggregate("_null", F.lit(0.0), lambda acc, x: acc + x), n)
    return seen.where(F.col("observed").isNotNull()).select(
        *keys, "observed", n.cast("bigint").alias("n_draws"), mean.alias("null_mean"), ratio(hits + 1, n + 1).alias("p_value"))


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(x[order])) + 1, len(x))
    starts = np.append(0, ends[:-1])
    out = np.empty(len(x))
    out[order] = np.repeat((starts + ends + 1) / 2, ends - starts)
    return out


def rank_arrays(df: DataFrame, keys: Sequence[str], ident: str, x: str, y: str, seed: str) -> DataFrame:
    """(keys, ``_size``, ``_a``, ``_b``, ``_norm``, ``_s``): twice the centred ranks of both columns, as 32-bit words, units in the order of a hash.

    For keys of at most DENSE_UNITS units.
    """
    keys = list(keys)
    rows = df.select(*keys, hash32(F.lit(seed), F.lit("base"), ident).alias("_h"), F.col(ident).alias("_i"), F.col(x).cast("double").alias("_x"),
                     F.col(y).cast("double").alias("_y"))
    own = [rows.schema[k] for k in keys]
    schema = StructType([*own, StructField("_size", LongType()), StructField("_a", BinaryType()), StructField("_b", BinaryType()),
                         StructField("_norm", DoubleType()), StructField("_s", DoubleType())])

    def work(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table.select(["_h", "_i"]), sort_keys=[("_h", "ascending"), ("_i", "ascending")]).to_numpy()
        a, b = (2 * average_ranks(table.column(c).to_numpy()[order]) - (len(order) + 1) for c in ("_x", "_y"))
        return pa.table([*[table.column(k).slice(0, 1) for k in keys], pa.array([len(a)], pa.int64()),
                         *[pa.array([v.astype("<i4").tobytes()], pa.binary()) for v in (a, b)],
                         pa.array([float(np.sqrt((a * a).sum() * (b * b).sum())) / 4]), pa.array([float(a @ b) / 4])], names=schema.names)

    return rows.groupBy(*keys).applyInArrow(work, schema)


def for_each_block(df: DataFrame, name: str, first: int, last: int, block: int) -> DataFrame:
    """The rows of ``df``, which is stored, with the first number of a block; a task has one partition of ``df`` and one block."""
    n = len(range(first, last + 1, block))
    starts = df.sparkSession.range(0, n, 1, max(1, n)).select((F.col("id") * block + first).cast("int").alias(name))
    return df.hint("shuffle_replicate_nl").crossJoin(starts)


def array_products(arrays: DataFrame, keys: Sequence[str], n_draws: int, seed: str) -> DataFrame:
    """(keys, draw, p): for every draw the sum of the ranks of ``_a`` times the shuffled ones of ``_b`` of ``rank_arrays``.

    Keys of one size share their shuffles, and a task makes them once for all of its keys.  ``arrays`` is stored, each
    of its partitions sorted by size; a task reads one of them for one block of draws, so no array is copied to a shuffle.
    """
    keys = list(keys)
    own = [arrays.schema[k] for k in keys]
    schema = StructType([*own, StructField("draw", IntegerType()), StructField("p", DoubleType())])
    spread = for_each_block(arrays.select(*keys, "_size", "_a", "_b"), "_first", 1, n_draws, BLOCK)
    return spread.mapInArrow(_products(keys, schema, n_draws, seed), schema)


def row_products(ranked: DataFrame, keys: Sequence[str], ident: str, n_draws: int, seed: str) -> DataFrame:
    """The same for keys of any size, from rows (keys, ident, ``_size``, ``_rx``, ``_ry``) joined by moved position."""
    keys = list(keys)
    placed = hash_positions(ranked, keys, ident, hash32(F.lit(seed), F.lit("base"), ident), "_size", "_at").select(
        *keys, (F.col("_at") - 1).alias("_at"), "_size", "_rx", "_ry")
    return _joined_products(cut_lineage(placed), keys, n_draws, seed)


def _products(keys: list[str], schema: StructType, n_draws: int, seed: str):
    def products(size: int, first: int, held: list) -> Iterator[pa.RecordBatch]:
        draws = range(first, min(first + BLOCK, n_draws + 1))
        numbers = draw_keys(seed, None, draws)
        total = np.zeros((len(held), len(draws)))
        for lo in range(0, size, 16384):
            some = slice(lo, min(lo + 16384, size))
            to = permuted(np.arange(some.start, some.stop), size, numbers)
            for sums, (_, a, b) in zip(total, held):
                sums += a[some].astype(np.float64) @ b[to].astype(np.float64)
        for sums, (names, _, _) in zip(total, held):
            yield pa.RecordBatch.from_arrays(
                [*[name.take(pa.array(np.zeros(len(draws), np.int64))) for name in names], pa.array(np.array(draws), pa.int32()), pa.array(sums / 4)],
                names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kept = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column("_size")[i].as_py(), batch.column("_first")[i].as_py())
                if held and (at != now or kept > HELD_BYTES):
                    yield from products(*now, held)
                    held, kept = [], 0
                now = at
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), "<i4") for c in ("_a", "_b"))
                kept += a.nbytes + b.nbytes
                held.append(([batch.column(k).slice(i, 1) for k in keys], a, b))
        if held:
            yield from products(*now, held)

    return work


def _joined_products(placed: DataFrame, keys: list[str], n_draws: int, seed: str) -> DataFrame:
    own = [placed.schema[k] for k in keys]
    schema = StructType([*own, StructField("draw", IntegerType()), StructField("_at", LongType()), StructField("_rx", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = draw_keys(seed, None, range(1, n_draws + 1))
        step = max(1, 200_000 // n_draws)
        for batch in batches:
            sizes = batch.column("_size").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for lo in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[lo:lo + step]))
                    each = pa.array(np.repeat(np.arange(part.num_rows), n_draws))
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(k).take(each) for k in keys], pa.array(np.tile(np.arange(1, n_draws + 1), part.num_rows), pa.int32()),
                         pa.array(permuted(part.column("_at").to_numpy(), int(size), numbers).ravel(), pa.int64()), part.column("_rx").take(each)],
                        names=schema.names)

    moved = placed.select(*keys, "_at", "_size", "_rx").mapInArrow(work, schema)
    return moved.join(placed.select(*keys, "_at", "_ry"), [*keys, "_at"]).groupBy(*keys, "draw").agg(
        F.sum(F.col("_rx") * F.col("_ry")).alias("p"))


def picked(size: int, seed: str, draws: Sequence[int]) -> np.ndarray:
    """Units drawn with replacement: draws x slots, slot i of a draw being a hash of (seed, draw, i) modulo the size."""
    out = np.empty((len(draws), size), np.int64)
    for row, d in zip(out, draws):
        head = f"{seed}|{d}|".encode()
        for lo in range(0, size, CACHE):
            words = b"".join([hashlib.md5(head + b"%d" % i).digest()[:4] for i in range(lo, min(lo + CACHE, size))])
            row[lo:lo + CACHE] = np.frombuffer(words, ">u4")
        row %= size
    return out


def resampled_means(df: DataFrame, keys: Sequence[str], ident: str, value: str, n_draws: int, seed: str) -> DataFrame:
    """(keys, draw, stat): the mean over units drawn with replacement, for keys of at most DENSE_UNITS units, one row per unit.

    Units are numbered in the order of a hash of their id.  Keys of one size have the same
    picks, made once by the task that holds a block of draws.  A missing value adds nothing.
    """
    keys = list(keys)
    unit = F.struct(hash32(F.lit("index"), ident).alias("h"), F.col(ident).alias("i"), F.col(value).cast("double").alias("v"))
    arrays = df.groupBy(*keys).agg(F.array_sort(F.collect_list(unit)).alias("_u")).select(
        *keys, F.size("_u").alias("_size"), F.transform("_u", lambda u: F.coalesce(u.v, F.lit(0.0))).alias("_v"))
    own = [arrays.schema[k] for k in keys]
    schema = StructType([*own, StructField("draw", IntegerType()), StructField("stat", DoubleType())])
    spread = arrays.withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(n_draws), F.lit(BLOCK)))).repartition(
        "_first", "_size").sortWithinPartitions("_first", "_size")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                size, first = batch.column("_size")[i].as_py(), batch.column("_first")[i].as_py()
                draws = range(first, min(first + BLOCK, n_draws + 1))
                v = batch.column("_v")[i].values.to_numpy()
                if size * len(draws) * 8 > TABLE_BYTES:
                    stat = np.array([v[picked(size, seed, [d])[0]].mean() for d in draws])
                else:
                    if kept[0] != (size, first):
                        kept = ((size, first), picked(size, seed, draws))
                    stat = v[kept[1]].mean(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(pa.array(np.full(len(draws), i))) for k in keys], pa.array(np.array(draws), pa.int32()), pa.array(stat)],
                    names=schema.names)

    return spread.mapInArrow(work, schema)


def flipped_means(df: DataFrame, keys: Sequence[str], columns: Sequence[tuple], ident: str, value: str, n_draws: int, seed: str) -> DataFrame:
    """(keys, draw, stat): the mean of the values' sizes with a random sign per (draw, unit), which all keys share.

    A task makes a unit's signs once for all keys and draws and hands on one array of sums per draw.
    """
    keys = list(keys)
    width = len(columns)
    size = F.abs(F.col(value).cast("double"))
    # A row is work for all draws, however few bytes it has: dealt to all tasks, not by size.
    dealt = df.select(*keys, ident, size.alias(value)).repartition(parallelism(df.sparkSession), ident)
    cells = widened(dealt, keys, columns, ident, value).select(
        F.concat_ws("|", F.col(ident).cast("string")).alias("_text"), F.col(ident).isNull().alias("_none"), "_cells")
    schema = StructType([StructField("draw", IntegerType()), StructField("_s", ArrayType(DoubleType())), StructField("_n", ArrayType(LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [f"{seed}|{d}".encode() for d in range(1, n_draws + 1)]
        total, there = np.zeros((n_draws, width)), np.zeros(width, np.int64)
        for batch in batches:
            tails = [b"" if none else b"|" + text.encode() for text, none in zip(batch.column("_text").to_pylist(), batch.column("_none").to_pylist())]
            lists = batch.column("_cells")
            flat, at = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            k = flat.field("k").to_numpy(zero_copy_only=False)
            x = np.zeros((len(lists), width))
            np.add.at(x, (at, k), flat.field("v").to_numpy(zero_copy_only=False))
            there += np.bincount(k, minlength=width)
            for lo in range(0, len(tails), 256):
                bits = np.frombuffer(b"".join([hashlib.md5(h + tail).digest()[3:4] for tail in tails[lo:lo + 256] for h in heads]), np.uint8) & 1
                total += (1.0 - 2.0 * bits.reshape(-1, n_draws)).T @ x[lo:lo + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(1, n_draws + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64())),
             pa.array([there] * n_draws, pa.list_(pa.int64()))], names=schema.names)

    sums = cells.mapInArrow(work, schema).select("draw", F.posexplode(F.arrays_zip("_s", "_n")).alias("_k", "_z")).groupBy("draw", "_k").agg(
        F.sum("_z._s").alias("_s"), F.sum("_z._n").alias("_n")).where("_n > 0")
    for at, name in enumerate(keys):
        sums = sums.withColumn(name, F.get(F.array(*[F.lit(c[at]).cast(df.schema[name].dataType) for c in columns]), F.col("_k")))
    return sums.select(*keys, "draw", ratio("_s", "_n").alias("stat"))


#: Units whose counts for all draws meet in one task.
UNITS = 1 << 15


def _draw_counts(sizes: DataFrame, n_draws: int, seed: str) -> DataFrame:
    """(_size, _block, draw, _times): how often each of a block's units is drawn, as 16-bit words, for every distinct ``_size``."""
    schema = StructType([StructField("_size", LongType()), StructField("_block", LongType()), StructField("draw", IntegerType()), StructField("_times", BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, draw in zip(batch.column("_size").to_pylist(), batch.column("draw").to_pylist()):
                times = np.bincount(picked(size, seed, [draw])[0], minlength=size).astype("<u2")
                starts = range(0, size, UNITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(starts), pa.int64()), pa.array([lo // UNITS for lo in starts], pa.int64()), pa.array([draw] * len(starts), pa.int32()),
                     pa.array([times[lo:lo + UNITS].tobytes() for lo in starts], pa.binary())], names=schema.names)

    # A draw is one row: so many tasks that each has a few.
    draws = sizes.sparkSession.range(1, n_draws + 1, 1, max(1, min(n_draws, 4 * parallelism(sizes.sparkSession)))).select(F.col("id").cast("int").alias("draw"))
    return draws.crossJoin(F.broadcast(sizes.select("_size").distinct())).mapInArrow(work, schema)


def resampled_sums(rows: DataFrame, keys: Sequence[str], columns: Sequence[tuple], ident: str, cells: Sequence[Column], n_draws: int, seed: str,
                   shared: bool = False) -> DataFrame:
    """(keys, draw, size, sums): sums of every cell over units drawn with replacement, for keys of any size, one row per unit.

    The picks are those of ``resample.resampled_units``: of the units of the key, or with ``shared`` of
    those of all keys.  A draw is made once, as counts of the units in order, and cut into blocks
    of units; a block's counts meet the block's values of all keys.  What is shuffled is two
    bytes per unit and draw, before compression, whatever the number of keys.
    """
    keys = list(keys)
    width, n_cells = len(columns), len(cells)
    numbered = F.array(*[F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, c)], F.lit(i).alias("_k")) for i, c in enumerate(columns)])
    roster_rows = rows.sparkSession.range(1).select(F.inline(numbered))
    values = F.struct("_k", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cells)])
    met = rows.join(F.broadcast(roster_rows), keys)
    # Keys with the same units are one class: their number, a sum and an xor of hashes.
    if shared:
        classes = rows.select(F.count_distinct(ident).alias("_size")).withColumn("_class", F.lit(0)).select("_class", "_size")
        met = met.withColumn("_class", F.lit(0))
    else:
        h = F.xxhash64(ident)
        sets = met.groupBy("_k").agg(F.count("*").alias("_size"), F.sum(h.bitwiseAND(2**31 - 1)).alias("_a"), F.bit_xor(h).alias("_b"))
        sets = cut_lineage(sets.withColumn("_class", F.min("_k").over(Window.partitionBy("_size", "_a", "_b"))))
        classes = sets.select("_class", "_size").distinct()
        met = met.join(F.broadcast(sets.select("_k", "_class")), "_k")
    classes = cut_lineage(classes)
    units = met.groupBy("_class", ident).agg(F.collect_list(values).alias("_v")).join(F.broadcast(classes), "_class")
    placed = hash_positions(units, ["_class"], ident, hash32(F.lit("index"), ident), "_size", "_at").select(
        "_class", F.floor((F.col("_at") - 1) / UNITS).alias("_block"), ((F.col("_at") - 1) % UNITS).cast("int").alias("_at"), "_v")
    counts = _draw_counts(classes, n_draws, seed).join(F.broadcast(classes), "_size").select("_class", "_block", "draw", "_times")
    schema = StructType([StructField("_class", IntegerType()), StructField("draw", IntegerType()), StructField("_s", ArrayType(DoubleType()))])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema_empty
        lists = left.column("_v").combine_chunks()
        flat = lists.flatten()
        at = np.repeat(left.column("_at").to_numpy(), np.diff(lists.offsets.to_numpy()))
        k = flat.field("_k").to_numpy(zero_copy_only=False)
        used, col = np.unique(k, return_inverse=True)
        n = len(np.frombuffer(right.column("_times")[0].as_py(), "<u2"))
        x = np.zeros((n, len(used), n_cells))
        for i in range(n_cells):
            np.add.at(x, (at, col, i), flat.field(f"c{i}").to_numpy(zero_copy_only=False))
        x = x.reshape(n, -1)
        draws = right.column("draw").to_numpy()
        out = np.zeros((len(draws), width, n_cells))
        for lo in range(0, len(draws), 32):
            times = np.stack([np.frombuffer(b.as_py(), "<u2") for b in right.column("_times").slice(lo, 32)])
            out[lo:lo + 32, used] = (times.astype(np.float64) @ x).reshape(len(times), len(used), n_cells)
        return pa.table({"_class": pa.array(np.full(len(draws), left.column("_class")[0].as_py()), pa.int32()), "draw": pa.array(draws, pa.int32()),
                         "_s": pa.array(list(out.reshape(len(draws), -1)), pa.list_(pa.float64()))})

    schema_empty = pa.table({"_class": pa.array([], pa.int32()), "draw": pa.array([], pa.int32()), "_s": pa.array([], pa.list_(pa.float64()))})
    part = placed.groupBy("_class", "_block").cogroup(counts.groupBy("_class", "_block")).applyInArrow(work, schema)
    each = part.select("_class", "draw", F.posexplode("_s").alias("_j", "_x")).groupBy("_class", "draw", "_j").agg(F.sum("_x").alias("_x"))
    sums = each.groupBy("_class", "draw", F.floor(F.col("_j") / n_cells).cast("int").alias("_k")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_j", "_x"))), lambda e: e._x).alias("sums"))
    if shared:
        own = sums.join(F.broadcast(met.select("_k").distinct()), "_k")
    else:
        own = sums.join(F.broadcast(sets.select("_k", "_class")), ["_k", "_class"])
    return own.join(F.broadcast(classes), "_class").join(F.broadcast(roster_rows), "_k").select(*keys, "draw", F.col("_size").alias("size"), "sums")
