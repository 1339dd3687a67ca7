"""Token counts by greedy longest match, in one pass and without making pieces.

Defined results: a missing or empty text has no words and no tokens; equal texts have equal
counts; a word with a byte outside the vocabulary counts as one unknown token; an empty
table gives an empty table; only the key and the text are read.  There is no shuffle.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame

from partwise.llm.bpe import read_ranks
from partwise.llm.common import Memo, per_text, texts


class LongestMatch:
    """Trie of the vocabulary with failure links.

    When no edge fits, the machine pops the greedy pieces of what it has read and goes on
    from the state of the rest; how many it pops is known beforehand, so counting needs
    one step per byte and a bounded number of pops.  ``start`` is the mark that opens a
    word; other tokens continue it.
    """

    def __init__(self, vocabulary: list[bytes], start: bytes = b" "):
        self.edges: list[dict[int, int]] = [{}]
        self.token, self.fail, self.pops = [False], [-1], [0]
        self.start = start
        for t in vocabulary:
            self._insert(t)
        self._link()

    def _insert(self, word: bytes) -> None:
        state = 0
        for byte in word:
            to = self.edges[state].get(byte)
            if to is None:
                to = self.edges[state][byte] = len(self.edges)
                self.edges.append({})
                self.token.append(False)
                self.fail.append(-1)
                self.pops.append(0)
            state = to
        self.token[state] = True

    def _link(self) -> None:
        """Breadth first: a token fails to the root with one piece popped, another node by way of its parent's links."""
        queue = [0]
        for state in queue:
            for byte, to in self.edges[state].items():
                queue.append(to)
                if self.token[to]:
                    self.fail[to], self.pops[to] = 0, 1
                    continue
                back, popped = self.fail[state], self.pops[state]
                while back >= 0 and byte not in self.edges[back]:
                    popped, back = popped + self.pops[back], self.fail[back]
                if back >= 0:
                    self.fail[to], self.pops[to] = self.edges[back][byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of one word, or -1 if greedy matching gets stuck."""
        state, total = 0, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for byte in self.start + word:
            while (to := edges[state].get(byte)) is None:
                if fail[state] < 0:
                    return -1
                total += pops[state]
                state = fail[state]
            state = to
        while state:
            if fail[state] < 0:
                return -1
            total += pops[state]
            state = fail[state]
        return total


@lru_cache(maxsize=2)
def machine(raw: bytes) -> tuple[LongestMatch, Memo]:
    made = LongestMatch([base64.b64decode(x.split()[0]) for x in raw.splitlines()])
    return made, Memo(made.count, 400_000)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown, longest): words stand between ASCII white space.

    ``longest`` is the most tokens that one word of the text takes.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(batch: list[str]) -> dict[str, list]:
        _, known = machine(raw.value)
        out: dict[str, list] = {"n_words": [], "n_tokens": [], "n_unknown": [], "longest": []}
        for text in batch:
            counts = list(map(known.__getitem__, text.encode("utf-8", "surrogatepass").split()))
            unknown = counts.count(-1)
            out["n_words"].append(len(counts))
            out["n_tokens"].append(sum(counts) + 2 * unknown)
            out["n_unknown"].append(unknown)
            out["longest"].append(max(map(abs, counts), default=0))
        return out

    return per_text(texts(docs, key), work, "n_words long, n_tokens long, n_unknown long, longest long")
