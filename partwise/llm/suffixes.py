"""Anchored suffixes of word sequences and the trees over them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words of a window that must repeat, and of the shortest prefix that groups suffixes.
WINDOW, PREFIX = 35, 10
#: Prefixes in a window.
SPAN = WINDOW - PREFIX + 1
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_MULTIPLIER, i, 1 << 64) for i in range(PREFIX)], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, prefix hash): the windows that start at first..last have their anchor there.

    A window's anchor is the leftmost of its positions whose ten-word prefix hashes lowest,
    so equal windows have it in the same place and every window has one.
    """
    if len(hashes) < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    n = len(hashes) - PREFIX + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(PREFIX):
        rolled += hashes[i:i + n] * _POWERS[i]
    rolled = (rolled ^ rolled >> np.uint64(31)) * np.uint64(_MULTIPLIER)
    where = leftmost_lowest(rolled, SPAN)
    first = np.flatnonzero(np.append(True, np.diff(where) != 0))
    last = np.append(first[1:], len(where)) - 1
    at = where[first]
    return at, first, last, rolled[at].view(np.int64)


def leftmost_lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the place of its first lowest one, by windows of doubled width."""
    at = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


def context(words: list[bytes], anchor: int, first: int, last: int) -> tuple[bytes, bytes]:
    """The words left of an anchor and those from it on, as far as its windows reach."""
    return b" ".join(words[first:anchor]), b" ".join(words[anchor:last + WINDOW])


def digest(left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(left + b"\n" + right, digest_size=16).digest()


class SuffixTree:
    """Leaves in order and the depth, in words, at which each parts from the one before.

    The nodes of depth d or more are the runs of leaves not parted above d.
    """

    def __init__(self, suffixes: list[list[bytes]]):
        self.order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), dtype=np.int64)
        depth, before = [], []
        for i in self.order:
            now = suffixes[i]
            d = 0
            for a, b in zip(before, now):
                if a != b:
                    break
                d += 1
            depth.append(d)
            before = now
        self.depth = np.array(depth, dtype=np.int64)

    def nodes(self, depth: int) -> np.ndarray:
        """For every suffix, the number of the node of this depth above it."""
        at = np.arange(len(self.order))
        start = np.maximum.accumulate(np.where(self.depth < depth, at, 0))
        out = np.empty(len(at), dtype=np.int64)
        out[self.order] = start
        return out


def repeated_windows(lefts: list[bytes], rights: list[bytes], times: np.ndarray) -> np.ndarray:
    """Bit o of a row: the window that starts o words before its anchor occurs twice or more.

    The windows of an anchor's suffix end below nodes of the tree of right contexts at
    depth WINDOW - o and of the tree of reversed left contexts at depth o; rows under the
    same two nodes hold the same window.
    """
    right = [x.split() for x in rights]
    left = [x.split()[::-1] for x in lefts]
    most = np.array([len(x) for x in left])
    least = np.array([WINDOW - len(x) for x in right])
    onward, back = SuffixTree(right), SuffixTree(left)
    mask = np.zeros(len(right), dtype=np.int64)
    for o in range(SPAN):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if len(rows) == 0:
            continue
        pair = onward.nodes(WINDOW - o)[rows] * (len(right) + 1) + back.nodes(o)[rows]
        _, node = np.unique(pair, return_inverse=True)
        mask[rows] |= (np.bincount(node, times[rows])[node] >= 2).astype(np.int64) << o
    return mask


def windows(left: bytes, right: bytes) -> list[tuple[int, bytes]]:
    """(o, digest) of the whole windows of a context, for prefixes too frequent for one tree."""
    words = [*left.split(), *right.split()]
    before = len(left.split())
    return [(before - p, hashlib.blake2b(b" ".join(words[p:p + WINDOW]), digest_size=16).digest())
            for p in range(len(words) - WINDOW + 1)]


#: Windows that start so many words before their anchor, or more, are told apart by their left words first.
HALF = SPAN // 2


def halves(left: bytes, right: bytes) -> list[tuple[int, bytes]]:
    """(0, digest of what all windows that start HALF or more words before the anchor hold), (1, the same of the others)."""
    before, after = left.split(), right.split()
    out = []
    if len(before) >= HALF and len(after) >= PREFIX:
        out.append((0, before[-HALF:] + after[:PREFIX]))
    if len(after) >= WINDOW - HALF + 1 and len(before) + len(after) >= WINDOW:
        out.append((1, after[:WINDOW - HALF + 1]))
    return [(half, hashlib.blake2b(b" ".join(words), digest_size=16).digest()) for half, words in out]


def covered(n: int, marks: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words lie in a window named by (anchor, mask)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for anchor, mask in marks:
        for o in range(SPAN):
            if mask >> o & 1:
                edge[anchor - o] += 1
                edge[anchor - o + WINDOW] -= 1
    return np.cumsum(edge)[:n] > 0
