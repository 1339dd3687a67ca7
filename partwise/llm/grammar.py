"""Probabilistic automata from examples: a counted prefix tree whose compatible states are merged."""

from __future__ import annotations

from math import log, log2, sqrt


def shape(text: str) -> str:
    """Characters by what matters in a format: digits, letters of hex and other letters in both cases, signs."""
    return text.translate(_SHAPES)


_SHAPES = ({ord(c): "0" for c in "0123456789"} | {ord(c): "a" for c in "abcdef"} | {ord(c): "A" for c in "ABCDEF"}
           | {ord(c): "z" for c in "ghijklmnopqrstuvwxyz"} | {ord(c): "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"})


class Automaton:
    """States hold arrivals, ends and, per symbol, the next state and how often it was taken."""

    def __init__(self, alpha: float = 0.01):
        self.factor = sqrt(0.5 * log(2 / alpha))
        self.arrivals, self.ends, self.next = [0], [0], [{}]

    def add(self, word: str, times: int = 1) -> None:
        state = 0
        for symbol in word:
            self.arrivals[state] += times
            step = self.next[state].get(symbol)
            if step is None:
                step = self.next[state][symbol] = [len(self.arrivals), 0]
                self.arrivals.append(0)
                self.ends.append(0)
                self.next.append({})
            step[1] += times
            state = step[0]
        self.arrivals[state] += times
        self.ends[state] += times

    def _differ(self, k1: int, n1: int, k2: int, n2: int) -> bool:
        """Whether two observed frequencies are apart by more than Hoeffding's bound."""
        if not n1 or not n2:
            return False
        return abs(k1 / n1 - k2 / n2) > self.factor * (1 / sqrt(n1) + 1 / sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        """Ends and steps of two states, and of the states they lead to, agree statistically."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.arrivals[a], self.arrivals[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for symbol in {*self.next[a], *self.next[b]}:
                sa, sb = self.next[a].get(symbol), self.next[b].get(symbol)
                if self._differ(sa[1] if sa else 0, na, sb[1] if sb else 0, nb):
                    return False
                if sa and sb:
                    todo.append((sa[0], sb[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrivals[a] += self.arrivals[b]
            self.ends[a] += self.ends[b]
            for symbol, (to, times) in self.next[b].items():
                own = self.next[a].get(symbol)
                if own is None:
                    self.next[a][symbol] = [to, times]
                else:
                    own[1] += times
                    todo.append((own[0], to))

    def generalise(self) -> Automaton:
        """Merge every state beside the settled ones into the first compatible one, else settle it."""
        settled, beside = [0], [(0, s) for s in sorted(self.next[0])]
        while beside:
            parent, symbol = max(beside, key=lambda e: self.arrivals[self.next[e[0]][e[1]][0]])
            state = self.next[parent][symbol][0]
            for s in settled:
                if self.compatible(s, state):
                    self.next[parent][symbol][0] = s
                    self._fold(s, state)
                    break
            else:
                settled.append(state)
            done = set(settled)
            beside = [(s, c) for s in settled for c in sorted(self.next[s]) if self.next[s][c][0] not in done]
        return self.compact(settled)

    def compact(self, keep: list[int]) -> Automaton:
        number = {s: i for i, s in enumerate(keep)}
        out = Automaton()
        out.arrivals = [self.arrivals[s] for s in keep]
        out.ends = [self.ends[s] for s in keep]
        out.next = [{c: [number[to], n] for c, (to, n) in self.next[s].items()} for s in keep]
        return out

    def rate(self, word: str) -> float:
        """Bits per symbol; an unknown step costs more than any seen one, and a word that may not end here is impossible."""
        state, total = 0, 0.0
        for symbol in word:
            step, n = self.next[state].get(symbol), self.arrivals[state]
            if step is None:
                total += log2(n + 2.0) + 4.0
            else:
                total -= log2(step[1] / (n + 1.0))
                state = step[0]
        return total / max(len(word), 1) if self.ends[state] else float("inf")


class Background:
    """First-order chain of the shapes of all candidates; ``counts`` maps pairs of symbols, ends as spaces."""

    def __init__(self, counts: dict[str, int]):
        self.pairs = counts
        self.left: dict[str, int] = {}
        for pair, n in counts.items():
            self.left[pair[0]] = self.left.get(pair[0], 0) + n

    def rate(self, word: str) -> float:
        """Bits per symbol."""
        marked = f" {word}"
        return -sum(log2((self.pairs.get(a + b, 0) + 0.5) / (self.left.get(a, 0) + 20.0))
                    for a, b in zip(marked, marked[1:])) / max(len(word), 1)
