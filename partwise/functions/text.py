"""Text columns to labels, keys, events, numbers and covariates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.guards import col

# Spellings of the two outcomes that the input files use.
EVENT_WORDS = ["1", "1:deceased", "dead", "death", "deceased", "event", "true", "yes"]
NO_EVENT_WORDS = ["0", "0:alive", "0:living", "alive", "censored", "false", "living", "no"]

# The study suffix and the spellings of the five regions.
STUDY_SUFFIX = "-reference-histology"
REGION_ALIASES = {
    "CT": "CT",
    "CTMVP": "MVP",
    "CTPAN": "PAN",
    "IT": "IT",
    "LE": "LE",
    "MVP": "MVP",
    "PAN": "PAN",
}

# Unit factors.
DAYS_PER_MONTH = 30.437


def lookup(pairs: Mapping[str, str]) -> Column:
    flat: list[Column] = []
    for k, v in pairs.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def has_suffix(raw: str | Column, suffix: str = STUDY_SUFFIX) -> Column:
    return F.coalesce(F.endswith(F.trim(col(raw)), F.lit(suffix)), F.lit(False))


def canonical_label(raw: str | Column, suffix: str = STUDY_SUFFIX,
                    aliases: Mapping[str, str] = REGION_ALIASES) -> Column:
    """Fold a label with the study suffix onto the roster; leave any other label alone."""
    text = F.trim(col(raw))
    stem = F.substring(text, F.lit(1), F.length(text) - len(suffix))
    key = F.upper(F.translate(stem, "-_ ", ""))
    folded = F.coalesce(F.try_element_at(lookup(aliases), key), stem)
    return F.when(text.isNull(), "UNKNOWN").when(has_suffix(raw, suffix), folded).otherwise(text)


def barcode_prefix(code: str | Column, parts: int) -> Column:
    """First ``parts`` dash-separated fields."""
    return F.array_join(F.slice(F.split(col(code), "-"), 1, parts), "-")


def barcode_loose(code: str | Column) -> Column:
    """Three fields plus two characters of the fourth; shorter codes unchanged."""
    f = F.split(col(code), "-")
    short = F.concat_ws("-", F.array_join(F.slice(f, 1, 3), "-"), F.substring(F.get(f, F.lit(3)), 1, 2))
    return F.when(F.size(f) > 3, short).otherwise(col(code))


def event_flag(raw: str | Column) -> Column:
    """1, 0 or missing.  An unknown word is missing, never 0; a number other than 0 and 1 is an error."""
    x = col(raw)
    word = F.lower(F.trim(x.cast("string")))
    number = F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))
    checked = F.when(number.isNull() | number.isin(0.0, 1.0), number).otherwise(
        F.raise_error(F.concat(F.lit("an event is 0 or 1, not "), x.cast("string"))).cast("double"))
    return F.when(F.typeof(x).isin("string", "boolean"), F.when(word.isin(EVENT_WORDS), 1.0).when(word.isin(NO_EVENT_WORDS), 0.0)).otherwise(checked)


def number_in(raw: str | Column) -> Column:
    """First number inside a text; missing when there is none."""
    return F.nullif(F.regexp_extract(col(raw), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def months_to_days(x: str | Column) -> Column:
    return col(x) * F.lit(DAYS_PER_MONTH)


def percent_to_fraction(x: str | Column) -> Column:
    return col(x) / F.lit(100.0)


def three_valued(raw: str | Column, yes_prefix: Sequence[str], no_prefix: Sequence[str]) -> Column:
    """1 / 0 by prefix, missing for blank, 'na' and anything else."""
    word = F.lower(F.trim(col(raw)))
    any_of = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.startswith(word, p))
    return F.when(any_of(yes_prefix), 1.0).when(any_of(no_prefix), 0.0)


def family_flag(name: str | Column, pattern: str, prefixes: Sequence[str] = (),
                members: Sequence[str] = ()) -> Column:
    hit = col(name).rlike(pattern)
    for p in prefixes:
        hit = hit | F.startswith(col(name), F.lit(p))
    if members:
        hit = hit | col(name).isin(list(members))
    return hit
