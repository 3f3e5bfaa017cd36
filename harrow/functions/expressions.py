"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """A reproducible number in [0, 1) from the parts written as text: the first 32 bits of their md5."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """v at length 1; the zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def sigmoid(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return 1 / (1 + F.exp(-x))


def cosine(product, ss1, ss2) -> Column:
    """product / (sqrt(ss1) * sqrt(ss2)), 0 where any of them is 0."""
    product, ss1, ss2 = (F.col(c) if isinstance(c, str) else c for c in (product, ss1, ss2))
    return F.when((product == 0) | (ss1 == 0) | (ss2 == 0), 0.0).otherwise(product / (F.sqrt(ss1) * F.sqrt(ss2)))
