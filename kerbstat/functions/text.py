"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that Unicode-aware stripping removes; F.trim alone removes blanks only.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def upper_strip(c: Column) -> Column:
    return strip(F.upper(c))


def has_word(c: Column, *words: str) -> Column:
    """1 if any of the words occurs as a whole word, else 0 (0 for null)."""
    pattern = r"\b(?:" + "|".join(words) + r")\b"
    return flag(c.rlike(pattern))


def flag(condition: Column) -> Column:
    """A condition as 0/1; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def non_blank(c: Column) -> Column:
    return F.length(F.trim(c)) > 0
