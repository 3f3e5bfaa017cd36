"""Train / eval / test splits over the fact table. Each gives a list of DataFrames, train first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.expressions import uniform
from harrow.sources.scratch import stored


def ratios(test_size: float | None, multi_ratios: list[float] | None) -> list[float]:
    """Normalised ratios; test_size wins over multi_ratios."""
    if test_size is not None:
        if not isinstance(test_size, float) or not 0.0 < test_size < 1.0:
            raise ValueError("test_size must be a float in (0, 1)")
        return [1 - test_size, test_size]
    if not multi_ratios or len(multi_ratios) < 2:
        raise ValueError("give test_size or at least two ratios")
    if min(multi_ratios) <= 0:
        raise ValueError("ratios must be positive")
    total = math.fsum(multi_ratios)
    return [r / total for r in multi_ratios]


def filter_unknown(parts: list[DataFrame], user_col: str = "user", item_col: str = "item") -> list[DataFrame]:
    """Later parts without the rows whose user or item train lacks."""
    train = parts[0]
    users, items = train.select(user_col).distinct(), train.select(item_col).distinct()
    return [train, *(p.join(users, user_col, "left_semi").join(items, item_col, "left_semi") for p in parts[1:])]


def pad_unknown(parts: list[DataFrame], pad, user_col: str = "user", item_col: str = "item") -> list[DataFrame]:
    """Later parts with pad (a value, or one for users and one for items) in place of what train lacks."""
    pads = pad if isinstance(pad, (tuple, list)) else (pad, pad)
    train = parts[0]
    out = [train]
    for p in parts[1:]:
        for col, value in zip((user_col, item_col), pads, strict=True):
            known = train.select(F.col(col).alias("__v")).distinct().withColumn("__known", F.lit(True))
            p = p.join(known, p[col] == F.col("__v"), "left").withColumn(col, F.when(F.col("__known"), F.col(col)).otherwise(F.lit(value))).drop("__v", "__known")
        out.append(p)
    return out


def _finished(parts, user_col, item_col, drop_unknown, pad, pad_val):
    if drop_unknown:
        return filter_unknown(parts, user_col, item_col)
    if pad:
        return pad_unknown(parts, pad_val, user_col, item_col)
    return parts


def _order(order_col: str, shuffle: bool, seed: int) -> list[Column]:
    if not shuffle:
        return [F.col(order_col)]
    return [uniform(seed, F.to_json(F.struct(order_col))), F.col(order_col)]


def sizes(n: int, shares: list[float]) -> list[int]:
    """Part sizes of a whole-table split: the last share is cut off rounded up, the rest again."""
    out, left = [], n
    shares = list(shares)
    while len(shares) > 1:
        last = shares.pop()
        cut = math.ceil(last * left - 1e-9)
        out.append(cut)
        left -= cut
        total = math.fsum(shares)
        shares = [s / total for s in shares]
    return [left, *reversed(out)]


def random_split(
    data: DataFrame, user_col: str = "user", item_col: str = "item", shuffle: bool = True, test_size: float | None = None,
    multi_ratios: list[float] | None = None, filter_unknown: bool = True, pad_unknown: bool = False, pad_val=None, seed: int = 42, order_col: str = "ord",
) -> list[DataFrame]:
    """Parts of exact sizes over a seeded order of all rows (shuffle) or over order_col, the tail last.

    The order is sorted in ranges and numbered within them; the cuts are places in it.
    """
    key = _order(order_col, shuffle, seed)
    placed = stored(data.sort(*key).withColumn("__m", F.monotonically_increasing_id()), "split")
    per = placed.groupBy(F.shiftright("__m", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    per = per.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    numbered = placed.withColumn("__part", F.shiftright("__m", 33)).join(F.broadcast(per), "__part")
    numbered = numbered.withColumn("__k", F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    parts, at = [], 0
    for n in sizes(placed.count(), ratios(test_size, multi_ratios)):
        parts.append(numbered.where((F.col("__k") >= at) & (F.col("__k") < at + n)).select(*data.columns))
        at += n
    return _finished(parts, user_col, item_col, filter_unknown, pad_unknown, pad_val)


def split_by_ratio(
    data: DataFrame, user_col: str = "user", item_col: str = "item", order: bool = True, shuffle: bool = False, test_size: float | None = None,
    multi_ratios: list[float] | None = None, filter_unknown: bool = True, pad_unknown: bool = False, pad_val=None, seed: int = 42, order_col: str = "ord",
) -> list[DataFrame]:
    """Per user by order_col, cut at round-half-even(cumulative ratio * rows); users of fewer than 3 rows train only."""
    shares = ratios(test_size, multi_ratios)
    by_user = Window.partitionBy(user_col)
    rows = data.withColumns({
        "__k": F.row_number().over(by_user.orderBy(*_order(order_col, shuffle, seed))), "__n": F.count(F.lit(1)).over(by_user)})
    part, cum = F.lit(0), 0.0
    for p, share in enumerate(shares[:-1]):
        cum += share
        part = F.when(F.col("__k") > F.rint(F.col("__n") * F.lit(cum)), p + 1).otherwise(part)
    part = F.when(F.col("__n") < 3, 0).otherwise(part)
    rows = stored(rows.withColumn("__p", part).drop("__k", "__n"), "split")  # all parts come from one pass
    parts = [rows.where(F.col("__p") == p).select(*data.columns) for p in range(len(shares))]
    return _finished(parts, user_col, item_col, filter_unknown, pad_unknown, pad_val)


def split_by_num(
    data: DataFrame, user_col: str = "user", item_col: str = "item", order: bool = True, shuffle: bool = False, test_size: int = 1,
    filter_unknown: bool = True, pad_unknown: bool = False, pad_val=None, seed: int = 42, order_col: str = "ord",
) -> list[DataFrame]:
    """Per user the last test_size rows test; of users with no more rows than that only the last, of those with fewer than 3 none."""
    if not isinstance(test_size, int) or test_size <= 0:
        raise ValueError("test_size must be a positive int")
    by_user = Window.partitionBy(user_col)
    rows = data.withColumns({
        "__k": F.row_number().over(by_user.orderBy(*_order(order_col, shuffle, seed))), "__n": F.count(F.lit(1)).over(by_user)})
    take = F.when(F.col("__n") < 3, 0).when(F.col("__n") <= test_size, 1).otherwise(test_size)
    rows = stored(rows.withColumn("__p", (F.col("__k") > F.col("__n") - take).cast("int")).drop("__k", "__n"), "split")
    parts = [rows.where(F.col("__p") == p).select(*data.columns) for p in (0, 1)]
    return _finished(parts, user_col, item_col, filter_unknown, pad_unknown, pad_val)


def _timed(data: DataFrame, order_col: str) -> DataFrame:
    if "time" not in data.columns:
        raise ValueError("a chronological split needs a column 'time'")
    return data.withColumn("__ord", F.struct("time", order_col))


def split_by_ratio_chrono(data: DataFrame, user_col: str = "user", item_col: str = "item", order_col: str = "ord", **options) -> list[DataFrame]:
    """split_by_ratio by time, then order_col; unknown users and items are always filtered."""
    return [p.drop("__ord") for p in split_by_ratio(_timed(data, order_col), user_col, item_col, order_col="__ord", **options)]


def split_by_num_chrono(data: DataFrame, user_col: str = "user", item_col: str = "item", order_col: str = "ord", **options) -> list[DataFrame]:
    return [p.drop("__ord") for p in split_by_num(_timed(data, order_col), user_col, item_col, order_col="__ord", **options)]
