"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingles whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 15


def fingerprint(text: str, width: int = 3, seed: int = 42) -> bytes:
    """Eight bytes, most significant first; texts without a word have all bits zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(width)])))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), BLOCK):
        raw = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles[at:at + BLOCK]])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()
