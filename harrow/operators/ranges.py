"""Running sums and places over a global order, range by range: nothing passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.sources.scratch import stored

_PLACES = (1 << 33) - 1


def ranged(df: DataFrame, by: str) -> DataFrame:
    """df in ranges of by, written, with __part (the range) and __place (the place in it, from 0)."""
    placed = stored(df.sort(by).withColumn("__m", F.monotonically_increasing_id()), "ranges")
    return placed.withColumns({"__part": F.shiftright("__m", 33), "__place": F.col("__m").bitwiseAND(F.lit(_PLACES))}).drop("__m")


def before_ranges(placed: DataFrame, **sums) -> DataFrame:
    """(__part, names...): the sums of the ranges before each one. A row per range; the driver never sees them."""
    order = Window.orderBy("__part")
    each = placed.groupBy("__part").agg(*(x.alias(name) for name, x in sums.items()))
    return each.select("__part", *((F.sum(name).over(order) - F.col(name)).alias(name) for name in sums))


def running_sums(df: DataFrame, by: str, *cols: str) -> DataFrame:
    """df with <col>_below for each of cols: its sum over all rows of smaller by. The values of by are distinct."""
    placed = ranged(df, by)
    below = before_ranges(placed, **{f"__{c}": F.sum(c) for c in cols})
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols}).join(F.broadcast(below), "__part")
    return out.withColumns({f"{c}_below": F.col(f"{c}_below") + F.col(f"__{c}") for c in cols}).drop("__part", "__place", *(f"__{c}" for c in cols))
