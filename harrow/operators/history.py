"""What users consumed, in order: lists, popularity and fixed-length sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.expressions import uniform


def _list(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("ord", value)))
    return df.groupBy(key).agg(ordered.alias("l")).select(key, F.col(f"l.{value}").alias(name))


def consumed(enc: DataFrame, dedup: str = "consecutive", key: str = "u", value: str = "i", name: str = "items") -> DataFrame:
    """(key, name): each key's values by ord. dedup drops repeats in a row ('consecutive') or all after the first ('global')."""
    if dedup == "consecutive":
        before = F.lag(value).over(Window.partitionBy(key).orderBy("ord"))
        rows = enc.select(key, value, "ord").withColumn("b", before).where(F.col("b").isNull() | (F.col("b") != F.col(value)))
    elif dedup == "global":
        rows = enc.groupBy(key, value).agg(F.min("ord").alias("ord"))
    else:
        raise ValueError("dedup must be 'consecutive' or 'global'")
    return _list(rows, key, value, name)


def merge_consumed(old: DataFrame, new: DataFrame, key: str = "u", name: str = "items") -> DataFrame:
    """Old lists with the new ones behind; nothing is dropped where they meet."""
    none = F.array().cast(old.schema[name].dataType)
    a, b = old.select(key, F.col(name).alias("a")), new.select(key, F.col(name).alias("b"))
    return a.join(b, key, "full").select(key, F.concat(F.coalesce("a", none), F.coalesce("b", none)).alias(name))


def popular_items(data: DataFrame, n: int = 100, user_col: str = "user", item_col: str = "item") -> DataFrame:
    """(item, n_users, rank): the n items of most distinct users, smaller items first on ties."""
    counts = data.select(user_col, item_col).distinct().groupBy(item_col).agg(F.count(F.lit(1)).alias("n_users"))
    top = counts.orderBy(F.desc("n_users"), item_col).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_users"), item_col)))


def positive_consumed(enc: DataFrame, label: str = "label") -> DataFrame:
    """(u, items): eval ground truth, sorted. Rows with a label other than 0 count; all rows if there is none."""
    some = enc.agg(F.coalesce(F.max((F.col(label) != 0).cast("int")), F.lit(0)).alias("some"))
    rows = enc.crossJoin(F.broadcast(some)).where((F.col("some") == 0) | (F.col(label) != 0))
    return rows.groupBy("u").agg(F.sort_array(F.collect_set("i")).alias("items"))


def any_label(labels):
    """1.0 if any task's label is not 0."""
    return F.exists(labels, lambda x: x != 0).cast("double")


def _padded(items, length: int):
    items = F.coalesce(items, F.array().cast("array<int>"))
    return F.concat(items, F.array_repeat(F.lit(0), F.lit(length) - F.size(items)))


def recent_sequences(lists: DataFrame, length: int, key: str = "u") -> DataFrame:
    """(u, seq): each user's last items, padded with 0 behind; user 0 is all zero."""
    last = F.slice("items", F.greatest(F.lit(1), F.size("items") - length + 1), F.lit(length))
    zero = lists.sparkSession.range(1).select(F.lit(0).cast(lists.schema[key].dataType).alias(key), F.array_repeat(F.lit(0), length).alias("seq"))
    return lists.select(key, _padded(last, length).alias("seq")).unionByName(zero)


def interacted_sequences(rows: DataFrame, lists: DataFrame, length: int, seed: int = 42) -> DataFrame:
    """rows(u, i) with seq: the length items before the first time i is in u's list, padded behind.

    If i is not in the list (a negative) a place is drawn by hash.
    """
    joined = rows.join(lists, "u", "left")
    place = F.array_position("items", F.col("i")).cast("int")
    drawn = F.floor(uniform(seed, F.col("u"), F.col("i")) * F.size("items")).cast("int") + 1
    place = F.when(place > 0, place).otherwise(drawn)
    seq = F.slice("items", F.greatest(F.lit(1), place - length), F.least(F.lit(length), place - 1))
    return joined.withColumn("seq", _padded(F.when(F.col("items").isNotNull(), seq), length)).drop("items")


def build_sequence(raw: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """raw(key, values): caller-given item values to ids; the last length of them, padded."""
    each = raw.select("key", F.posexplode("values").alias("pos", "item")).join(items, "item", "left")
    ids = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("i", F.lit(0)).alias("i")))).alias("l"))
    seq = F.slice(F.col("l.i"), F.greatest(F.lit(1), F.size("l") - length + 1), F.lit(length))
    return ids.select("key", _padded(seq, length).alias("seq"))
