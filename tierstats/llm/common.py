"""Shared helpers: joins with a size check, word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstats.sources.shared import staged  # noqa: F401  (the operators take it from here)

#: Words are maximal runs of anything but these characters.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def is_small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = 100_000) -> DataFrame:
    """Join a staged lookup table: broadcast if it has at most ``max_rows`` rows, else a sort-merge join, in
    which Spark splits skewed partitions of the left side."""
    return left.join(F.broadcast(right) if is_small(right, max_rows) else right.hint("merge"), on, how)


def word_count(text: Column) -> Column:
    """Number of words, natively; null has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters left alone. ``lower`` does that for pure ASCII and is much faster there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
