"""Subword-bag embeddings averaged into a linear softmax, trained jointly."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain
from zlib import crc32

import numpy as np

from partwise.llm.common import Memo

WORD = re.compile(r"\w+")
BUCKETS = 1 << 16
WINDOW = 4
#: Words found in fewer texts of the sample get no vector of their own while fitting.
LEAST_TEXTS = 3
#: One text in so many serves the calibration and not the fit.
ASIDE = 4


def subwords(word: str, low: int = 3, high: int = 5) -> list[int]:
    """Hash buckets of a word and of its n-grams of UTF-8 bytes, with marks at both ends."""
    marked = b"<%b>" % word.encode("utf-8", "surrogatepass")
    size = len(marked)
    return [crc32(marked) % BUCKETS, *[crc32(marked[i:i + n]) % BUCKETS for n in range(low, high + 1) for i in range(size - n + 1)]]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class SubwordSoftmax:
    """Two classes.  A window's logit is the mean over its words of (mean subword vector) . (u1 - u0).

    A text is a bag of windows; while training, a window's share of its text's loss moves
    from equal shares to its most toxic window, so short insults count in long texts.
    Scoring takes the highest window and a logistic calibration with the classes' true sizes.
    """

    def __init__(self, dim: int = 8, epochs: int = 60, rate: float = 0.05, decay: float = 1e-3, seed: int = 7):
        self.dim, self.epochs, self.rate, self.decay, self.seed = dim, epochs, rate, decay, seed

    def fit(self, rows: list[tuple[str, int]], sizes: dict[int, int]) -> np.ndarray:
        """The score of every bucket, then scale and offset of the calibration."""
        aside = [crc32(t.encode("utf-8", "surrogatepass")) % ASIDE == 0 for t, _ in rows]
        learn = [r for r, a in zip(rows, aside) if not a]
        test = [r for r, a in zip(rows, aside) if a]
        if len({y for _, y in learn}) < 2 or len({y for _, y in test}) < 2:
            learn = test = rows
        if len({y for _, y in learn}) < 2:
            share = sum(y for _, y in rows) / len(rows) if rows else 0.5
            share = min(max(share, 0.01), 0.99)
            return np.append(np.zeros(BUCKETS), [0.0, np.log(share / (1 - share))])
        buckets = self._embed(learn)
        scorer = Scorer(np.append(buckets, [1.0, 0.0]))
        y = np.array([label for _, label in test])
        counts = np.bincount(y, minlength=2)
        true = np.where(y == 1, sizes[1] / counts[1], sizes[0] / counts[0])
        return np.append(buckets, calibrate(np.array([scorer.top(t) for t, _ in test]), y, true / true.mean()))

    def _embed(self, rows: list[tuple[str, int]]) -> np.ndarray:
        seen = Counter(chain.from_iterable(set(words(text)) for text, _ in rows))
        vocabulary = {w: i for i, w in enumerate(w for w, n in seen.items() if n >= LEAST_TEXTS)}
        vocabulary = vocabulary or {w: i for i, w in enumerate(seen)} or {"": 0}
        token, window, text_of = [], [], []
        for i, (text, _) in enumerate(rows):
            ws = words(text)
            for at in range(0, max(len(ws), 1), WINDOW):
                part = [vocabulary[w] for w in ws[at:at + WINDOW] if w in vocabulary]
                token += part
                window += [len(text_of)] * len(part)
                text_of.append(i)
        y = np.array([label for _, label in rows])
        token, window, text_of = (np.asarray(a, dtype=np.int64) for a in (token, window, text_of))
        subs = [subwords(w) for w in vocabulary]
        sizes_of = np.array([len(s) for s in subs])
        flat, owner = np.concatenate([np.array(s) for s in subs]), np.repeat(np.arange(len(subs)), sizes_of)
        n_windows, n_texts, n_words = len(text_of), len(y), len(subs)
        in_window = np.full(n_windows, float(WINDOW))
        counts = np.bincount(y, minlength=2)
        weight = np.where(y == 1, 0.5 / counts[1], 0.5 / counts[0])
        rng = np.random.default_rng(self.seed)
        table = rng.normal(0, 0.1, (BUCKETS, self.dim))
        out = rng.normal(0, 0.1, (2, self.dim))
        bias = np.zeros(2)
        moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (table, out, bias)]
        first = np.searchsorted(text_of, np.arange(n_texts))

        def logits() -> np.ndarray:
            per_word = np.bincount(owner, (table @ (out[1] - out[0]))[flat], n_words) / sizes_of
            return np.bincount(window, per_word[token], n_windows) / in_window + bias[1] - bias[0]

        for epoch in range(self.epochs):
            z = logits()
            sharp = 8.0 * epoch / self.epochs
            top = np.maximum.reduceat(z, first)
            share = np.exp(np.clip(sharp * (z - top[text_of]), -60, 0))
            share /= np.bincount(text_of, share, n_texts)[text_of]
            pooled = np.bincount(text_of, share * z, n_texts)
            error = (1 / (1 + np.exp(-np.clip(pooled, -40, 40))) - y) * weight
            per_window = error[text_of] * share / in_window
            per_word = np.bincount(token, per_window[window], n_words) / sizes_of
            per_bucket = np.bincount(flat, per_word[owner], BUCKETS)
            lean = per_bucket @ table
            grads = [np.outer(per_bucket, out[1] - out[0]) + self.decay * table / BUCKETS**0.5,
                     np.stack([-lean, lean]) + self.decay * out, np.array([-error.sum(), error.sum()])]
            for param, grad, (m, v) in zip((table, out, bias), grads, moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                step = epoch + 1
                param -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        return table @ (out[1] - out[0])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Scale and offset of a weighted logistic fit by Newton steps, with a little shrinkage."""
    spread = max(float(x.std()), 1e-9)
    design = np.stack([x / spread, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-4 * np.eye(2)
        move = np.linalg.solve(hess, design.T @ (weight * (p - y)) + 1e-4 * beta)
        beta -= np.clip(move, -2, 2)
    return float(beta[0] / spread), float(beta[1])


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.buckets, (self.scale, self.offset) = weights[:-2].tolist(), weights[-2:]
        self.word = Memo(self._word, 400_000)

    def _word(self, word: str) -> float:
        found = subwords(word)
        return sum(map(self.buckets.__getitem__, found)) / len(found)

    def top(self, text: str) -> float:
        """The highest window mean; a short last window counts as if filled with neutral words."""
        values = np.fromiter(map(self.word.__getitem__, words(text)), dtype=np.float64)
        return float((np.add.reduceat(values, np.arange(0, len(values), WINDOW)) / WINDOW).max()) if len(values) else 0.0

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.top(text) + self.offset, -40, 40))))
