"""Embedding tables joined to rows, and factors trained by alternating least squares."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_rows(rows: DataFrame, id_col: str, table: DataFrame, name: str) -> DataFrame:
    """rows with the vector of id_col from table(id, vec); unknown ids get the vector of id 0."""
    default = table.where("id = 0").select(F.col("vec").alias("__default"))
    out = rows.join(table.select(F.col("id").alias(id_col), F.col("vec").alias(name)), id_col, "left").crossJoin(F.broadcast(default))
    return out.withColumn(name, F.coalesce(name, "__default")).drop("__default")


def embed_bag(rows: DataFrame, key: str, ids_col: str, table: DataFrame, name: str, combiner: str = "sqrtn") -> DataFrame:
    """(key, name): sum, mean or sum / sqrt(n) of the vectors of an id array, id 0 left out."""
    each = rows.select(key, F.explode(ids_col).alias("id")).where("id <> 0").join(table, "id").select(key, F.posexplode("vec").alias("pos", "x"))
    scale = {"sum": F.lit(1.0), "mean": F.count(F.lit(1)), "sqrtn": F.sqrt(F.count(F.lit(1)))}[combiner]
    bag = each.groupBy(key, "pos").agg((F.sum("x") / scale).alias("x"))
    return bag.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("l")).select(key, F.col("l.x").alias(name))


def als_vectors(r: DataFrame, size: int = 16, rounds: int = 5, implicit: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of users and of items, trained on R(u, i, r) by alternating least squares."""
    model = ALS(rank=size, maxIter=rounds, userCol="u", itemCol="i", ratingCol="r", implicitPrefs=implicit, seed=seed, coldStartStrategy="drop").fit(r)
    pick = [F.col("id"), F.col("features").cast("array<double>").alias("vec")]
    return model.userFactors.select(*pick), model.itemFactors.select(*pick)
