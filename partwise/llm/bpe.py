"""Byte-level BPE encoding and decoding of whole texts.

Defined results: a missing text is the empty text and has no ids; ids of an equal text are
equal; an empty table gives an empty table; only the key and the text are read.  Encoding
needs no shuffle, so a hot key does no harm, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.bpe_machine import Transducer, Utf8Reader
from partwise.llm.common import per_text, texts

#: A vocabulary is sent to every executor; a larger file is an error.
MOST_VOCABULARY_BYTES = 64 << 20
#: Pieces that a codec keeps where its worker also holds what other stages left: a quarter of the usual number.
FEW_PIECES = 100_000


def read_ranks(path: str) -> bytes:
    """The rank file as it is: base64 token, space, rank on each line."""
    if os.path.getsize(path) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class Codec:
    def __init__(self, raw: bytes, pattern: str, most: int = 400_000):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        # White space is Unicode's property here, not Python's wider notion of it.
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.machine = Transducer(ranks, most)
        self.reader = Utf8Reader(self.machine.tokens)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.machine.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> str:
        return self.reader.text(ids)


@lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str, most: int = 400_000) -> Codec:
    return Codec(raw, pattern, most)


def encode(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """The kept columns and ``ids array<int>``."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batch: list[str]) -> dict[str, list]:
        codec = _codec(raw.value, pattern)
        return {"ids": [codec.encode(t) for t in batch]}

    return per_text(texts(docs, *keep), work, "ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """The kept columns and the text of ``ids``."""
    raw = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batch: list[list[int]]) -> dict[str, list]:
        codec = _codec(raw.value, pattern)
        return {"decoded": [codec.decode(i or []) for i in batch]}

    return per_text(rows.select(*keep, F.col("ids").alias("text")), work, "decoded string").withColumnRenamed("decoded", "text")


def encoded(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """The kept columns, ``ids``, their number, and whether decoding them gives the text again."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batch: list[str]) -> dict[str, list]:
        codec = _codec(raw.value, pattern, FEW_PIECES)
        ids = [codec.encode(t) for t in batch]
        return {"ids": ids, "n_tokens": list(map(len, ids)), "round_trip": [codec.decode(i) == t for i, t in zip(ids, batch)]}

    return per_text(texts(docs, *keep), work, "ids array<int>, n_tokens long, round_trip boolean")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass: counts and hashes of the ids and of the decoded bytes."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batch: list[str]) -> dict[str, list]:
        codec = _codec(raw.value, pattern)
        decimal = _decimals(raw.value)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch:
            ids = codec.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return out

    return per_text(texts(docs, key), work, "n_tokens long, ids_sha256 string, decoded_sha256 string")


@lru_cache(maxsize=2)
def _decimals(raw: bytes) -> dict[int, str]:
    return {int(x.split()[1]): x.split()[1].decode() for x in raw.splitlines()}
