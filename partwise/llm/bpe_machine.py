"""Byte-pair merges as a lazily determinised transducer, and UTF-8 decoding as a state machine.

A sequence of tokens is what the merges give exactly if each token is itself a result of
merging its bytes and each neighbouring pair stays apart when its joined bytes are merged.
So a nondeterministic machine that reads bytes along the vocabulary's prefixes, may end a
token where the pair rule allows it, and starts the next, ends a token at every byte in
exactly one run.  All its runs at a byte read suffixes of the longest of them, so a state of
the determinised machine is that longest prefix; states and steps are built when first met
and there are no more of them than prefixes of the vocabulary.  The registers hold the last
token of the run that ends at each of the latest bytes.  A run lags behind by less than one
token, so tokens are certain, and emitted, after a lookahead of one longest token.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

from partwise.llm.common import Memo


def merge(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[int]:
    """The ids of a short byte string by repeated merging of its lowest-ranked neighbours, down to ``stop`` parts."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes byte strings.

    The pieces' table holds at most ``most`` entries of at most ``longest_kept`` characters,
    the pair tables together at most ``most_pairs``; full tables are emptied and filled again.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000, most_pairs: int = 600_000, longest_kept: int = 64):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ordered = sorted(ranks)
        self.proper = Memo(lambda t: merge(t, ranks) == [ranks[t]])
        self.halves = Memo(self._halves)
        self.pieces = Memo(lambda piece: self.encode_bytes(piece.encode()), most, longest_kept)
        #: The pair rule for single pairs, (left << 32 | right); encoding reads ``pairs``.
        self.apart = Memo(lambda pair: self._apart(pair >> 32, pair & 0xFFFFFFFF), most)
        self.most_pairs, self.n_pairs = most_pairs, 0
        self.pairs: dict[int, dict[int, bool]] = {}
        self.names, self.numbers = [b""], {b"": 0}
        self.ends: list[list[tuple[int, int, dict[int, bool]]]] = [[]]
        self.steps: dict[int, int] = {}

    def _opens(self, name: bytes) -> bool:
        """Whether a token starts with ``name``."""
        at = bisect_left(self.ordered, name)
        return at < len(self.ordered) and self.ordered[at].startswith(name)

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens of the last merge that makes a token; a single byte is its own half."""
        parts = merge(self.tokens[token], self.ranks, stop=2)
        return (parts[0], parts[-1])

    def _meet(self, left: int, right: int) -> bool:
        """``_apart``, kept in the table of the token on the right."""
        if self.n_pairs >= self.most_pairs:
            for kept in self.pairs.values():
                kept.clear()
                kept[-1] = True
            self.n_pairs = 0
        self.n_pairs += 1
        ok = self.pairs[right][left] = self._apart(left, right)
        return ok

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two tokens.

        Undo merges from the latest to the earliest: the two pieces that face each other
        must at no time have had a merge of their own that came before the one undone.
        """
        undone = 1 << 60
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < undone:
                return False
            inner, outer = self.halves[left][1], self.halves[right][0]
            if inner != left and (left > right or outer == right):
                undone, left = left, inner
            elif outer != right:
                undone, right = right + 1, outer
            else:
                return True

    def _step(self, key: int) -> int:
        """Determinise one step: the longest suffix that is a prefix of a token, and the tokens that end there."""
        name = self.names[key >> 8] + bytes([key & 0xFF])
        while not self._opens(name):
            name = name[1:]
        number = self.numbers.get(name)
        if number is None:
            number = self.numbers[name] = len(self.names)
            self.names.append(name)
            tails = [name[i:] for i in range(len(name))]
            found = [(self.ranks[t], len(t)) for t in tails if t in self.ranks and self.proper[t]]
            # Nothing comes before the first token, so the pair with -1 stands.
            self.ends.append([(i, n, self.pairs.setdefault(i, {-1: True})) for i, n in found])
        self.steps[key] = number
        return number

    def _last(self, state: int, at: int, last: list[int]) -> int:
        """The token that ends here in the one run that may end a token here."""
        for token, size, pairs in self.ends[state]:
            before = last[at - size]
            ok = pairs.get(before)
            if self._meet(before, token) if ok is None else ok:
                return token
        raise ValueError("no run ends here")

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece; a long one goes through ``stream``, which holds a bounded number of registers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 4 * self.longest:
            return tuple(self.stream(piece))
        state, last, steps, ends = 0, [-1], self.steps, self.ends
        at = 0
        for byte in piece:
            key = state << 8 | byte
            state = steps.get(key, -1)
            if state < 0:
                state = self._step(key)
            at += 1
            for token, size, pairs in ends[state]:
                before = last[at - size]
                ok = pairs.get(before)
                if ok is None:
                    ok = self._meet(before, token)
                if ok:
                    last.append(token)
                    break
        return tuple(self._path(last, at, 0))

    def _path(self, last: list[int], at: int, stop: int) -> list[int]:
        """The tokens of the run that ends at ``at``, back to ``stop``."""
        out = []
        while at > stop:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def stream(self, data: Iterable[int], every: int = 256) -> Iterator[int]:
        """Tokens of one byte stream as they become certain; holds ``every`` bytes and a few tokens' worth."""
        state, last, done = 0, [-1], 0
        for byte in data:
            key = state << 8 | byte
            state = self.steps[key] if key in self.steps else self._step(key)
            last.append(self._last(state, len(last), last))
            if len(last) > every + 2 * self.longest:
                paths = [self._path(last, at, done) for at in range(max(done, len(last) - self.longest), len(last))]
                shared = 0
                while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
                    shared += 1
                yield from paths[0][:shared]
                done += sum(len(self.tokens[t]) for t in paths[0][:shared])
                cut = max(0, done - self.longest)
                last, done = last[cut:], done - cut
        yield from self._path(last, len(last) - 1, done)


#: The byte ranges of well-formed UTF-8, as (state, first, last, next state).
#: The states are the start, one to three bytes to come, and four with a narrower second byte.
RANGES = [
    ("start", 0x00, 0x7F, "start"), ("start", 0xC2, 0xDF, "one"), ("start", 0xE0, 0xE0, "after_e0"),
    ("start", 0xE1, 0xEC, "two"), ("start", 0xED, 0xED, "after_ed"), ("start", 0xEE, 0xEF, "two"),
    ("start", 0xF0, 0xF0, "after_f0"), ("start", 0xF1, 0xF3, "three"), ("start", 0xF4, 0xF4, "after_f4"),
    ("one", 0x80, 0xBF, "start"), ("two", 0x80, 0xBF, "one"), ("three", 0x80, 0xBF, "two"),
    ("after_e0", 0xA0, 0xBF, "one"), ("after_ed", 0x80, 0x9F, "one"),
    ("after_f0", 0x90, 0xBF, "two"), ("after_f4", 0x80, 0x8F, "two"),
]


class Utf8Reader:
    """Text from tokens that may split a character; ill-formed bytes become U+FFFD.

    A state is (name, bytes held back); at most three bytes are held back.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.table = {(s, b): t for s, lo, hi, t in RANGES for b in range(lo, hi + 1)}
        self.start = ("start", b"")
        self.steps = Memo(lambda key: self.read(key[0], tokens[key[1]]))
        self.whole = Memo(lambda i: text if (got := self.read(self.start, tokens[i]))[1] == self.start and "�" not in (text := got[0])
                          else None)

    def read(self, state: tuple[str, bytes], chunk: bytes) -> tuple[str, tuple[str, bytes]]:
        name, held = state
        out = []
        for i in range(len(chunk)):
            byte = chunk[i]
            after = self.table.get((name, byte))
            if after is None and held:
                out.append("�")
                name, held = self.start
                after = self.table.get((name, byte))
            if after is None:
                out.append("�")
                continue
            held += chunk[i:i + 1]
            name = after
            if name == "start":
                out.append(held.decode())
                held = b""
        return "".join(out), (name, held)

    def stream(self, ids: Iterable[int]) -> Iterable[str]:
        """Text as it becomes certain, token by token; a cut-off end is one U+FFFD."""
        state = self.start
        for i in ids:
            text, state = self.steps[state, i]
            if text:
                yield text
        if state != self.start:
            yield "�"

    def text(self, ids: list[int]) -> str:
        parts = list(map(self.whole.__getitem__, ids))
        return "".join(self.stream(ids)) if None in parts else "".join(parts)
