"""Interaction and feature views over the star-schema tables.

A DataFrame has no row order, so every fact view carries `ord`, a struct of the columns
that order it: comparable, unique, and free of a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, label, time, ord): customers' order lines with their quantity."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("label"),
        F.col("o_orderdate").alias("time"), order.alias("ord"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, label, time, ord, event): the event stream, items from its properties; repeats are common."""
    item = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"), item.alias("item"), F.col("value").alias("label"), F.col("ts").alias("time"),
        F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("event"))


def clicks_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).withColumn("label", (F.col("event") == "purchase").cast("double"))


def clicks_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*((F.col("event") == e).cast("double") for e in ("click", "purchase", "signup")))
    return clicks(spark, sf_dir).withColumn("labels", labels)


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_mktsegment", "c_nationkey", "c_acctbal")


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part attributes; tag1 and tag2 are the words of the name, tag2 missing for every third part."""
    words = F.split("p_name", " ")
    tag2 = F.when(F.col("p_partkey") % 3 == 0, F.lit("missing")).otherwise(words[1])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), "p_brand", "p_type", "p_size", "p_retailprice", words[0].alias("tag1"), tag2.alias("tag2"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of users (even vec_id) and items (odd)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")
