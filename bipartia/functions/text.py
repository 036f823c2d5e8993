"""Text folding shared by the operators; every function maps a Column to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(c: Column | str) -> Column:
    """Only letters and digits, in upper case; null becomes the empty string."""
    return F.upper(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[^\p{L}\p{N}]+", ""))


def is_blank(c: Column | str) -> Column:
    """True for null and for text without a visible character (spaces, controls, zero-width characters)."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[\s\p{Z}\p{C}]+", "") == ""


def word_bag(c: Column | str) -> Column:
    """The words (runs of letters and digits, upper case) in sorted order, joined by a space."""
    words = F.split(F.upper(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def squeezed(c: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
