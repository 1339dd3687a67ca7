"""Hamming-distance links by the generalised pigeonhole principle.

The 64 bits are grouped into parts so that correlated bits share a part.  If two words
differ in at most ``radius`` bits, then for thresholds e_1..e_m with
sum(e_i) = radius - m + 1 some part i differs in at most e_i bits (e_i = -1: the part is
not probed).  Thresholds are unequal: dynamic programming picks those with the least
estimated number of probes and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Most keys that one word may probe in one part; the keys are spelt out in the plan.
MOST_PROBES = 1000


def bit_counts(words: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """Number of words, and how often each pair of bits is set together (64 x 64), over all rows.

    Every task adds up its rows; only 4,097 sums reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = to_bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        where = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.append(both.ravel(), n))], names=["at", "n"])

    rows = words.select(column).mapInArrow(work, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def to_bits(words: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; column b is the bit of weight 2^b."""
    return np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Parts of near-equal size, each grown from its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = list(range(BITS)), []
    for i in range(m):
        want = (BITS - sum(map(len, parts)) + (m - i) - 1) // (m - i)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < want:
            nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.remove(nxt)
        parts.append(sorted(part))
    return parts


def close_share(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, .. ``most`` bits of a part.

    Two rows differ in bits a and b with chance 2 (p11 p00 + p10 p01), so the mean and the
    variance of the distance are known; a beta-binomial with these moments gives the shares.
    """
    n = max(n, 1)
    p11 = both[np.ix_(part, part)] / n
    p = np.diag(p11)
    p10 = p[:, None] - p11
    p01 = p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    joint = 2 * (p11 * p00 + p10 * p01)
    single = 2 * p * (1 - p)
    np.fill_diagonal(joint, single)
    w, mean = len(part), float(single.sum())
    var = float((joint - np.outer(single, single)).sum())
    q = min(max(mean / w, 1e-9), 1 - 1e-9)
    rho = (var / (w * q * (1 - q)) - 1) / max(w - 1, 1)
    rho = min(max(rho, 1e-6), 0.999)
    a, b = q * (1 - rho) / rho, (1 - q) * (1 - rho) / rho
    total, out = 0.0, []
    for k in range(most + 1):
        if k <= w:
            logp = (lgamma(w + 1) - lgamma(k + 1) - lgamma(w - k + 1) + lgamma(k + a) + lgamma(w - k + b)
                    - lgamma(w + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b))
            total += float(np.exp(logp))
        out.append(min(total, 1.0))
    return out


def probes(width: int, most: int) -> int:
    """Keys within ``most`` bits of a key."""
    return sum(comb(width, k) for k in range(most + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost; ``costs[i][e + 1]`` is the cost of part i at threshold e >= -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for at, extra in enumerate(part):
                key, value = used + at - 1, cost + extra
                if key not in step or value < step[key][0]:
                    step[key] = (value, [*chosen, at - 1])
        best = step
    return best[total]


def plan(n: int, both: np.ndarray, radius: int, row_cost: float = 4.0, pair_cost: float = 1.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed part: the cheapest over all numbers of parts up to radius + 2."""
    choices, rows = [], max(n, 1)
    for m in range(1, radius + 3):
        parts = group_bits(n, both, m)
        costs = []
        for part in parts:
            share = close_share(n, both, part, radius)
            costs.append([0.0] + [
                row_cost * rows * (probes(len(part), e) + (e > 0)) + pair_cost * share[e] * rows * rows / 2
                if probes(len(part), e) <= MOST_PROBES else float("inf") for e in range(radius + 1)])
        cost, chosen = allocate(costs, radius - m + 1)
        choices.append((cost, m, [(p, e) for p, e in zip(parts, chosen) if e >= 0]))
    return min(choices)[2]


def keys(column: str, parts: list[tuple[list[int], int]], probe: bool) -> F.Column:
    """Array of (part, key); with ``probe`` all keys within the part's threshold."""
    out = []
    for i, (bits, e) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        signed = mask - (1 << 64) if mask >> 63 else mask
        own = F.col(column).bitwiseAND(F.lit(signed))
        for k in range((e if probe else 0) + 1):
            for flip in combinations(bits, k):
                f = sum(1 << b for b in flip)
                out.append(F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(f - (1 << 64) if f >> 63 else f)).alias("key")))
    return F.array(*out)


def links(words: DataFrame, radius: int = 3, column: str = "fp") -> DataFrame:
    """(a, b), a < b: all pairs of distinct words within ``radius`` bits, each once or more.

    ``words`` holds each word once.  Candidates meet in a join on (part, key); the exact
    distance is part of the join condition, so candidates are never written out.  Large
    buckets are split by Spark's skew join.
    """
    n, both = bit_counts(words, column)
    parts = plan(n, both, radius)
    left = words.select(F.explode(keys(column, parts, True)).alias("_k"), F.col(column).alias("a")).select("_k.*", "a")
    right = words.select(F.explode(keys(column, parts, False)).alias("_k"), F.col(column).alias("b")).select(
        F.col("_k.part").alias("part2"), F.col("_k.key").alias("key2"), "b")
    hit = left.join(right, (left["part"] == right["part2"]) & (left["key"] == right["key2"])
                    & (left["a"] < right["b"]) & (F.bit_count(left["a"].bitwiseXOR(right["b"])) <= radius))
    return hit.select("a", "b")
