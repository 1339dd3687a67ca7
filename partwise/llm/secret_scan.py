"""Secret scans: three fixed patterns, and formats learnt from what they find.

Defined results: a missing or empty text has no span; equal rows have equal spans; spans of
one kind never overlap, those of different kinds may; a text without any labelled
credential still gets the fixed patterns; an empty table gives an empty table; only the
key and the text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import SLICE, Memo, per_text, stored, texts
from partwise.llm.grammar import Automaton, Background, shape

#: The patterns and the least lengths.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Candidates of the learnt formats are all maximal runs of so many of these characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, by start and then kind."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def other_candidates(text: str, spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Maximal candidate runs that touch no fixed span."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if m.start() >= reach:
            out.append((m.start(), m.end(), m[0]))
    return out


def observations(docs: DataFrame) -> DataFrame:
    """(kind, value, n) over all texts: credentials of the fixed patterns, and shape pairs of all other candidates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                seen.update((kind, value) for _, _, kind, value in spans)
                for _, _, value in other_candidates(text, spans):
                    marked = f" {shape(value)} "
                    seen.update(("pair", marked[i:i + 2]) for i in range(len(marked) - 1))
            if seen:
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in seen]), pa.array([v for _, v in seen]), pa.array(list(seen.values()), type=pa.int64())],
                    names=["kind", "value", "n"])

    rows = texts(docs).mapInArrow(work, "kind string, value string, n long")
    return rows.groupBy("kind", "value").agg(F.sum("n").alias("n"))


class Formats:
    """One automaton for each kind of labelled credential, a background, and the rate that most labelled ones keep."""

    def __init__(self, labelled: dict[str, list[str]], pairs: dict[str, int], gain: float = 0.75, quantile: float = 0.95,
                 slack: float = 0.25):
        self.background = Background(pairs)
        self.kinds = {}
        for kind, values in labelled.items():
            tree = Automaton()
            for word, n in sorted(Counter(map(shape, values)).items()):
                tree.add(word, n)
            model = tree.generalise()
            rates = sorted(map(model.rate, map(shape, values)))
            self.kinds[kind] = (model, rates[int(quantile * (len(rates) - 1))] + slack)
        self.gain = gain
        self.known = Memo(self._likely, 200_000)

    def _likely(self, word: str) -> bool:
        """About as likely per character as the labelled ones, and likelier by ``gain`` bits than by the background."""
        other = self.background.rate(word)
        return any(rate <= most and other - rate >= self.gain for rate, most in ((m.rate(word), most) for m, most in self.kinds.values()))

    def spans(self, text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
        return [(s, e, "format") for s, e, value in other_candidates(text, base) if self.known[shape(value)]]


def learn(docs: DataFrame, per_kind: int = 2000, longest: int = 200) -> Formats:
    """Fit the formats to at most ``per_kind`` distinct credentials of each kind, of ``longest`` characters at most.

    They are taken in the order of a hash of the value.  The background counts all candidates.
    """
    seen = stored(observations(docs), "credentials")
    pairs = {r["value"]: r["n"] for r in seen.where(F.col("kind") == "pair").collect()}
    labelled = {}
    for kind in KINDS[:3]:
        rows = seen.where((F.col("kind") == kind) & (F.length("value") <= longest)).orderBy(F.xxhash64("value"), "value").limit(per_kind)
        values = sorted(r["value"] for r in rows.collect())
        if values:
            labelled[kind] = values
    return Formats(labelled, pairs)


def _listed(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find(docs: DataFrame, key: str = "doc_id", formats: Formats | None = None) -> DataFrame:
    """One row per document: counts and spans of all secrets, in code points, ends exclusive."""
    formats = learn(docs) if formats is None else formats
    shared = docs.sparkSession.sparkContext.broadcast((formats.kinds, formats.background.pairs, formats.gain))

    def work(batch: list[str]) -> dict[str, list]:
        model = rebuilt(shared.value)
        out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for text in batch:
            base = base_spans(text)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
            out["spans"].append(_listed([*base, *model.spans(text, base)]))
        return out

    return per_text(texts(docs, key), work, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def rebuilt(parts: tuple) -> Formats:
    kinds, pairs, gain = parts
    out = Formats({}, pairs, gain)
    out.kinds = kinds
    return out


def mask(docs: DataFrame, filler: str = "<secret>", formats: Formats | None = None) -> DataFrame:
    """The same rows and columns; every span of a secret in ``text`` gives way to ``filler``."""
    formats = learn(docs) if formats is None else formats
    shared = docs.sparkSession.sparkContext.broadcast((formats.kinds, formats.background.pairs, formats.gain))

    @F.arrow_udf("string")
    def cut(column: pa.Array) -> pa.Array:
        model = rebuilt(shared.value)
        done = [pa.array([None if t is None else masked(t, model, filler) for t in column.slice(i, SLICE).to_pylist()], pa.string())
                for i in range(0, len(column), SLICE)]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return docs.withColumn("text", cut("text"))


def masked(text: str, model: Formats, filler: str) -> str:
    base = base_spans(text)
    out, at = [], 0
    for start, end, *_ in sorted([*base, *model.spans(text, base)], key=lambda s: (s[0], -s[1])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], filler]
        at = end
    return "".join([*out, text[at:]])
