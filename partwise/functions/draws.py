"""Seeded draws as columns: every random choice is a hash of named keys.

A draw depends on its keys alone, so a lost task recomputes the same value and
any engine with md5 can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.guards import col

SPAN = float(2**32)


def hash32(*keys: str | Column) -> Column:
    """First 32 bits of md5 over the keys joined by '|'."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit(*keys: str | Column) -> Column:
    """Uniform in (0, 1]."""
    return (hash32(*keys) + F.lit(1)) / F.lit(SPAN)


def pick(n: str | Column, *keys: str | Column) -> Column:
    """Uniform index in 0..n-1 (bias below n / 2**32)."""
    return F.pmod(hash32(*keys), col(n).cast("bigint"))


def with_draws(df: DataFrame, n_draws: int, name: str = "draw") -> DataFrame:
    """One copy of each row per draw number 1..n_draws."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
