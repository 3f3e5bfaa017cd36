"""Raw values to dense ids from 1 (0 is unknown), and hashed ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.ranges import before_ranges, ranged
from harrow.sources.scratch import stored

OOV = 0
DEFAULT_BINS = 200_000


def make_id_mapping(data: DataFrame, col: str, id_col: str, start: int = 0) -> DataFrame:
    """(col, id_col): ranks of the sorted distinct values from start + 1; nulls get none.

    The values are sorted in ranges; an id is the place within the range plus what the
    ranges before hold, so nothing passes through one task.
    """
    placed = ranged(data.select(col).where(F.col(col).isNotNull()).distinct(), col)
    before = before_ranges(placed, before=F.count(F.lit(1)))
    return placed.join(F.broadcast(before), "__part").select(col, (F.col("before") + F.col("__place") + 1 + start).cast("int").alias(id_col))


def make_id_mappings(data: DataFrame, *columns: tuple[str, str]) -> list[DataFrame]:
    """make_id_mapping for several (col, id_col) of one type, their values found and sorted in one pass over data."""
    if len({data.schema[col].dataType for col, _ in columns}) > 1:
        return [make_id_mapping(data, col, id_col) for col, id_col in columns]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("__c"), F.col(col).alias("__v")) for n, (col, _) in enumerate(columns)))).alias("e")
    values = data.select(each).select("e.__c", "e.__v").where(F.col("__v").isNotNull()).distinct()
    placed = stored(values.sort("__c", "__v").withColumn("__m", F.monotonically_increasing_id()), "mapping")
    placed = placed.withColumn("__part", F.shiftright("__m", 33))
    # In the order of __m a value's id is how many of its column come up to it.
    parts = placed.groupBy("__c", "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("first"))
    parts = parts.select("__c", "__part", "first", (F.sum("n").over(Window.partitionBy("__c").orderBy("__part")) - F.col("n")).alias("before"))
    ids = placed.join(F.broadcast(parts), ["__c", "__part"]).withColumn("id", (F.col("before") + F.col("__m") - F.col("first") + 1).cast("int"))
    return [ids.where(F.col("__c") == n).select(F.col("__v").alias(col), F.col("id").alias(id_col)) for n, (col, id_col) in enumerate(columns)]


def extend_mapping(mapping: DataFrame, data: DataFrame, col: str, id_col: str) -> DataFrame:
    """mapping with the new values of data appended: sorted, from the largest id on."""
    new = data.select(col).distinct().join(mapping.select(col), col, "left_anti")
    top = mapping.agg(F.max(id_col)).first()[0] or 0
    return mapping.unionByName(make_id_mapping(new, col, id_col, top))


def update_mapping(old: DataFrame, new: DataFrame, col: str, id_col: str) -> DataFrame:
    """Union of two mappings, the newer entry of a value wins."""
    kept = old.join(new.select(col), col, "left_anti")
    return kept.unionByName(new)


def encode(data: DataFrame, users: DataFrame, items: DataFrame, user_col: str = "user", item_col: str = "item") -> DataFrame:
    """data with u and i, 0 for values that the mappings lack."""
    out = data.join(users, user_col, "left").join(items, item_col, "left")
    return out.withColumns({"u": F.coalesce("u", F.lit(OOV)), "i": F.coalesce("i", F.lit(OOV))})


def unknown(encoded: DataFrame) -> DataFrame:
    return encoded.where((F.col("u") == OOV) | (F.col("i") == OOV))


def decode(recs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """recs(u, i, ...) with the raw values user and item in place of the ids."""
    return recs.join(users, "u").join(items, "i").drop("u", "i")


def density(n_rows: int, n_users: int, n_items: int) -> float:
    return 100.0 * n_rows / (n_users * n_items) if n_users and n_items else 0.0


def hash_ids(feature: str, value: Column, n_bins: int = DEFAULT_BINS, seed: int = 42) -> Column:
    """1 + xxh3_64(feature_value, seed) mod n_bins; a number and its text hash alike."""

    @F.pandas_udf("int")
    def hashed(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda v: 1 + xxhash.xxh3_64_intdigest(f"{feature}_{v}", seed=seed) % n_bins, na_action="ignore")

    return hashed(value.cast("string"))


def hash_mapping(data: DataFrame, col: str, feature: str, n_bins: int = DEFAULT_BINS, seed: int = 42) -> DataFrame:
    """(col, id): the hashed id of every distinct value."""
    return data.select(col).where(F.col(col).isNotNull()).distinct().select(col, hash_ids(feature, F.col(col), n_bins, seed).alias("id"))


def reverse_hash_mapping(mapping: DataFrame, col: str) -> DataFrame:
    """(id, col): of colliding values the last in sorted order; collided counts the others."""
    return mapping.groupBy("id").agg(F.max(col).alias(col), (F.count(F.lit(1)) - 1).alias("collided"))
