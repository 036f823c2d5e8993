"""Vectors as arrays of doubles, and hash numbers that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(c: Column | str, n: int | Column) -> Column:
    """A number below ``n`` from the first 32 bits of the md5 of a text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % n


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by /."""
    return bucket(F.concat_ws("/", *parts), F.lit(2**32)) / F.lit(float(2**32))


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_added(a: Column, eps: float = 1e-8) -> Column:
    """x / (norm + eps), which leaves a zero vector zero."""
    return F.transform(a, lambda x: x / (norm(a) + F.lit(eps)))


def l2_floored(a: Column, eps: float = 1e-8) -> Column:
    """x / max(norm, eps)."""
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(eps)))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))


def scrubbed(v: Column) -> Column:
    """Numbers that are none (NaN), infinite or null become 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.transform(v, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x))


def asserted(v: Column, width: int) -> Column:
    """The vector itself; the query fails where it has another width or a number that is not finite."""
    wrong = v.isNull() | (F.size(v) != width) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~wrong, v).otherwise(F.raise_error(F.lit(f"not a finite vector of {width} numbers")).cast("array<double>"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
