"""Predictions, recommendations, cold start and top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.expressions import sigmoid, uniform
from harrow.operators import blocks
from harrow.sources.scratch import stored

#: A side of a join is broadcast up to so many rows of a few numbers.
BROADCAST_ROWS = 1_000_000
#: Scores are compared at this many digits, so ties do not hang on the order of sums.
DIGITS = 6


def predict(pairs: DataFrame, sims: DataFrame, r: DataFrame, target: str, k: int = 20, task: str = "ranking") -> DataFrame:
    """pairs(u, i) with pred from the first k neighbours of target ('u' or 'i') that meet the history.

    rating: sum(sim * r) / sum(sim), 0 if that sum is 0; ranking: sum(sim) / count. No
    neighbour met gives 0. The list is cut to k before it is met with the history.
    """
    if task not in ("ranking", "rating"):
        raise ValueError("task must be 'ranking' or 'rating'")
    pairs = pairs.select("u", "i").distinct()
    near = sims.where(F.col("rk") <= k).select(F.col("x").alias(target), "nb", "sim")
    other = "i" if target == "u" else "u"
    history = r.select(F.col(target).alias("nb"), F.col(other), "r")
    met = pairs.join(near, target).join(history, [other, "nb"]).groupBy("u", "i").agg(
        F.sum("sim").alias("s"), F.sum(F.col("sim") * F.col("r")).alias("sr"), F.count(F.lit(1)).alias("n"))
    value = F.col("s") / F.col("n") if task == "ranking" else F.when(F.col("s") == 0, 0.0).otherwise(F.col("sr") / F.col("s"))
    return pairs.join(met, ["u", "i"], "left").select("u", "i", F.coalesce(value, F.lit(0.0)).alias("pred"))


def top_n(scores: DataFrame, n: int, key: str = "u", item: str = "i", score: str = "score", random: bool = False, seed: int = 42) -> DataFrame:
    """The n best items per key with their rank rk; random draws n of them by hash where there are more."""
    by = Window.partitionBy(key)
    value = F.round(score, DIGITS)
    if random:
        order = [uniform(seed, F.col(key), F.col(item)), F.col(item)]
        few = F.count(F.lit(1)).over(by) <= n
        first = F.when(few, -value).otherwise(order[0])
        return scores.withColumn("__f", first).withColumn("rk", F.row_number().over(by.orderBy("__f", item))).where(F.col("rk") <= n).drop("__f")
    return scores.withColumn("rk", F.row_number().over(by.orderBy(value.desc(), item))).where(F.col("rk") <= n)


def recommend(r: DataFrame, sims: DataFrame, target: str, n: int = 10, k: int = 20, users: DataFrame | None = None, filter_consumed: bool = True, random: bool = False, seed: int = 42) -> DataFrame:
    """(u, i, score, rk): the n best items of every user.

    By items: score(j) = sum over the history of r(u, i) * sim(i, j), the k nearest j of
    each i. By users: sum over the k nearest v of sim(u, v) * r(v, i).
    """
    near = sims.where(F.col("rk") <= k)
    if target == "i":
        mine = r.join(users, "u", "left_semi") if users is not None else r
        left = mine.select(F.col("i").alias("pivot"), F.col("u").alias("row"), F.col("r").alias("value"))
        right = near.select(F.col("x").alias("pivot"), F.col("nb").alias("col"), F.col("sim").alias("value"))
    else:
        near = near.select(F.col("x").alias("u"), F.col("nb").alias("v"), "sim")
        near = near.join(users, "u", "left_semi") if users is not None else near
        left = near.select(F.col("v").alias("pivot"), F.col("u").alias("row"), F.col("sim").alias("value"))
        right = r.select(F.col("u").alias("pivot"), F.col("i").alias("col"), F.col("r").alias("value"))
    seen = None
    if filter_consumed:
        seen = (r.join(users, "u", "left_semi") if users is not None else r).select(F.col("u").alias("row"), F.col("i").alias("col"))
    if not random:
        left, right = stored(left, "recommend-left"), stored(right, "recommend-right")
        return blocks.top_sums(left, right, n, seen, DIGITS).select(F.col("row").alias("u"), F.col("col").alias("i"), "score", "rk")
    scored = left.select("pivot", F.col("row").alias("u"), F.col("value").alias("v")).join(right, "pivot").groupBy("u", F.col("col").alias("i")).agg(F.sum(F.col("v") * F.col("value")).alias("score"))
    if filter_consumed:
        scored = scored.join(r.select("u", "i"), ["u", "i"], "left_anti")
    return top_n(scored, n, random=True, seed=seed)


def deficit(recs: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """(u, missing) of the users with fewer than n recommendations."""
    have = recs.groupBy("u").agg(F.count(F.lit(1)).alias("have"))
    return users.select("u").distinct().join(have, "u", "left").select("u", (n - F.coalesce("have", F.lit(0))).cast("int").alias("missing")).where("missing > 0")


def backfill(recs: DataFrame, users: DataFrame, popular: DataFrame, n: int) -> DataFrame:
    """recs(u, i, rk) filled up to n per user with popular(i, rank) items that are not in the list yet."""
    short = deficit(recs, users, n)
    # Each short user needs at most n popular items beyond the own list: 2 n candidates do.
    candidates = short.crossJoin(F.broadcast(popular.where(F.col("rank") <= 2 * n).select("i", "rank")))
    candidates = candidates.join(recs.select("u", "i"), ["u", "i"], "left_anti")
    picked = candidates.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("rank"))).where("k <= missing")
    added = picked.select("u", "i", (F.lit(n) - F.col("missing") + F.col("k")).cast("int").alias("rk"))
    return recs.select("u", "i", F.col("rk").cast("int").alias("rk")).unionByName(added)


def cold_start(users: DataFrame, ranked_items: DataFrame, n: int, mode: str = "top", seed: int = 42) -> DataFrame:
    """(user, i, rk) for unknown users from ranked_items(i, rank): the top n, or n drawn with replacement ('sample').

    ranked_items are the popular items, or the default list of the mean-embedding user.
    """
    if mode == "top":
        return users.crossJoin(F.broadcast(ranked_items.where(F.col("rank") <= n))).select("user", "i", F.col("rank").cast("int").alias("rk"))
    if mode != "sample":
        raise ValueError("mode must be 'top' or 'sample'")
    size = ranked_items.count()
    draws = users.select("user", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rk"))
    draws = draws.withColumn("rank", (F.floor(uniform(seed, F.col("user"), F.col("rk")) * size) + 1).cast("int"))
    ranked = ranked_items.select("i", F.col("rank").cast("int").alias("rank"))
    return draws.join(F.broadcast(ranked) if size <= BROADCAST_ROWS else ranked, "rank").select("user", "i", "rk")


def normalize_prediction(preds: DataFrame, task: str, cold_start_mode: str = "average") -> DataFrame:
    """preds(u, i, pred): sigmoid for ranking; unknown pairs are 0 if cold start is by popularity."""
    value = sigmoid("pred") if task == "ranking" else F.col("pred")
    if cold_start_mode == "popular":
        value = F.when((F.col("u") == 0) | (F.col("i") == 0), 0.0).otherwise(value)
    return preds.withColumn("pred", value)


def top_items(scores: DataFrame, lists: DataFrame, n_items: int, n: int, filter_consumed: bool = True, random: bool = False, seed: int = 42) -> DataFrame:
    """Top n of scores(u, i, score) over all candidates.

    A user's consumed items are left out only if enough others stay: n plus the length
    of the list (repeats included) is at most n_items. random draws by softmax(score)^0.75.
    """
    if filter_consumed:
        gone = lists.where(F.size("items") + n <= n_items).select("u", F.explode("items").alias("i")).distinct()
        scores = scores.join(gone, ["u", "i"], "left_anti")
    if not random:
        return top_n(scores, n)
    by = Window.partitionBy("u")
    weight = F.pow(F.exp(F.col("score") - F.max("score").over(by)), 0.75)
    p = weight / F.sum(weight).over(by) + 1e-8
    draw = F.log(uniform(seed, F.col("u"), F.col("i")) + 1e-12) / p  # weighted sampling without replacement
    chosen = scores.withColumn("__d", draw).withColumn("__k", F.row_number().over(by.orderBy(F.desc("__d"), "i"))).where(F.col("__k") <= n)
    return top_n(chosen.drop("__d", "__k"), n)
