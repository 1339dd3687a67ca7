"""Hashed word n-gram logistic regression, fitted by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

from partwise.llm.common import Memo

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 18
#: Odd multipliers that mix two token hashes into one.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(token: str) -> int:
    return crc32(token.encode("utf-8", "surrogatepass"))


class Features:
    """Sparse vectors of unit length: token and token-pair counts, hashed.

    Hashing includes the shape of a pair: a token that repeats its neighbour gives the
    same feature whatever the token, and so does one in capitals.
    """

    def __init__(self):
        self.code = Memo(lambda t: _hash(t) << 2 | (t.isupper() and len(t) > 1) << 1 | t.isalnum(), 400_000)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.fromiter(map(self.code.__getitem__, TOKEN.findall(text)), dtype=np.uint64)
        if not len(codes):
            return np.zeros(1, dtype=np.int64), np.ones(1)
        shape = codes & np.uint64(3)
        left, right = codes[:-1], codes[1:]
        pairs = np.where(left == right, np.uint64(1), left * MIX_A + right * MIX_B)
        mixed = np.concatenate([codes * MIX_A, pairs * MIX_B + np.uint64(1), shape + np.uint64(11)])
        index = (mixed ^ mixed >> np.uint64(29)) * MIX_B >> np.uint64(46)
        where, n = np.unique(index.astype(np.int64), return_counts=True)
        value = np.log1p(n)
        return where, value / np.sqrt((value * value).sum())


def fit(rows: list[tuple[str, int]], sizes: dict[int, int], epochs: int = 4, alpha: float = 0.6, beta: float = 1.0,
        l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights of the buckets; the last entry is the offset.  Classes weigh as their true sizes do."""
    features = Features()
    made = [(*features.of(text), y) for text, y in rows]
    counts = {c: max(sum(y == c for _, y in rows), 1) for c in (0, 1)}
    share = {c: sizes.get(c, 0) / counts[c] for c in (0, 1)}
    most = max(share.values()) or 1.0
    z, n, w = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    order = np.argsort([crc32(t.encode("utf-8", "surrogatepass")) for t, _ in rows], kind="stable") if rows else []
    for _ in range(epochs):
        for i in order:
            where, value, y = made[i]
            at, x = np.append(where, BUCKETS), np.append(value, 1.0)
            w[at] = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35)))
            g = (p - y) * x * share[y] / most
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w[at]
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.features = weights, Features()

    def score(self, text: str) -> float:
        where, value = self.features.of(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[where] @ value + self.weights[-1], -35, 35))))
