"""Document rules, host failure rates shrunk by an empirical beta prior, verdicts joined back.

Defined results: a missing text is the empty text and fails for want of words; a
document without a host is judged by its own rules alone; equal rows are judged alike
and all of them stay; an empty table gives an empty table; only the key, the text and
the host are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import per_text, stored, texts

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Fixed values of the base rules.
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that stands twice or more in the text."""
    grams = list(zip(*[words[i:] for i in range(width)]))
    if len(set(grams)) == len(grams):
        return 0
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = bytearray(len(words))
    for i, g in enumerate(grams):
        if g in twice:
            hit[i:i + width] = b"\x01" * width
    return sum(hit)


def measure(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(raw.translate(None, SPACES + CONTINUATION)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: the kept columns and the five counts."""

    def work(batch: list[str]) -> dict[str, list]:
        cols = list(zip(*map(measure, batch)))
        return dict(zip(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], cols))

    return per_text(texts(docs, *keep), work, MEASURES)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


#: A document's failures, by rule, for the host rates.
def rule_failures() -> dict[str, F.Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_words"),
    }


def shrunk_rates(failures: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """(host, rule, n, failed, rate): posterior mean failure rate.

    The prior of a rule is Beta(m s, (1 - m) s) with m the rate over all documents and
    s = max(m (1 - m) / v - 1, 1), v the variance of the raw rates between hosts.
    """
    counts = failures.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    rows = counts.select(host, "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in rules])).alias("_x")).select(host, "n", "_x.*")
    prior = rows.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("_m"), F.var_pop(F.col("failed") / F.col("n")).alias("_v"))
    prior = prior.select("rule", "_m", F.when(
        F.col("_v") > 0, F.greatest(F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1, F.lit(1.0))).otherwise(F.lit(1.0)).alias("_s"))
    return rows.join(prior, "rule").select(
        host, "rule", "n", "failed", ((F.col("failed") + F.col("_m") * F.col("_s")) / (F.col("n") + F.col("_s"))).alias("rate"))


def judge(measured: DataFrame, host: str = "source", reject_above: float = 0.8) -> DataFrame:
    """Add base_failed, host_rate and kept to rows of ``measures``.

    A host is rejected when the shrunk rate of any one rule is above ``reject_above``;
    its documents then go even where they pass the base rules.
    """
    rules = rule_failures()
    rates = shrunk_rates(measured.select(host, *[c.alias(n) for n, c in rules.items()]), host, list(rules))
    hosts = stored(rates.groupBy(F.col(host).alias("_host")).agg(F.max("rate").alias("host_rate")), "host-rates")
    return measured.join(hosts, measured[host] == hosts["_host"], "left").drop("_host").withColumn(
        "base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= reject_above))


def verdicts(docs: DataFrame, key: str = "doc_id", host: str = "source", reject_above: float = 0.8) -> DataFrame:
    """Counts and verdicts, one row per document."""
    return judge(stored(measures(docs, key, host), "measures"), host, reject_above)


def keep_good(docs: DataFrame, host: str = "source", reject_above: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep them, with their own columns only."""
    names = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[host].alias("_src"), docs["text"].alias("text"))
    narrow = stored(measures(docs.select(F.col(host).alias("_src"), "text"), "_src"), "measures")
    rules = rule_failures()
    rates = shrunk_rates(narrow.select("_src", *[c.alias(n) for n, c in rules.items()]), "_src", list(rules))
    bad = stored(rates.groupBy(F.col("_src").alias("_host")).agg(F.max("rate").alias("_rate")).where(
        F.col("_rate") > reject_above).select("_host"), "bad-hosts")
    good = whole.join(bad, whole["_src"] == bad["_host"], "left_anti")
    return measured_rows(good).where(~base_failed()).select("_row.*")


def measured_rows(whole: DataFrame) -> DataFrame:
    """(_row, the five counts); the row stays in the engine, Python sees the text alone."""
    @F.pandas_udf(MEASURES)
    def count(text: pd.Series) -> pd.DataFrame:
        rows = [measure(t) for t in text]
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return whole.select("_row", count(F.coalesce("text", F.lit(""))).alias("_m")).select("_row", "_m.*")
