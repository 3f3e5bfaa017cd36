"""Serving and losses of embedding models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.expressions import dot, sigmoid, unit
from harrow.operators.serve import DIGITS, top_n


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """pairs(u, i) with score, the dot product of users(id, vec) and items(id, vec)."""
    out = pairs.join(users.select(F.col("id").alias("u"), F.col("vec").alias("a")), "u").join(items.select(F.col("id").alias("i"), F.col("vec").alias("b")), "i")
    return out.select("u", "i", dot("a", "b").alias("score"))


def top_items(
    users: DataFrame, items: DataFrame, n: int, user_block: int = 1024, item_block: int = 8192, forward: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda x, y: x @ y.T,
) -> DataFrame:
    """(u, i, score, rk): the n items of largest score per user; forward(user rows, item rows) gives all scores of two blocks, the dot product by default.

    Both sides are packed into blocks; a task multiplies one pair of blocks and keeps n
    per user and block, so what is shuffled grows with users * item blocks * n, not with
    users * items, and neither side has to fit anywhere as a whole. A column more of
    users says how many items a user gets beyond n.
    """
    more = "more" if "more" in users.columns else None

    def packed(df: DataFrame, block: int, name: str, columns: tuple[str, ...]) -> DataFrame:
        size = df.count()
        return df.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // block))))).groupBy("b").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("b")

    pairs = packed(users, user_block, "us", ("id", "vec", *((more,) if more else ()))).crossJoin(packed(items, item_block, "vs", ("id", "vec")))

    def unpacked(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        # Straight from the Arrow buffers: no Python object per number.
        ids, vecs, *rest = rows.flatten()
        return ids.to_numpy(), vecs.flatten().to_numpy().reshape(len(ids), -1), *(np.asarray(x) for x in rest)

    def run(batches):
        for b in batches:
            for us, vs in zip(b.column("us"), b.column("vs"), strict=True):
                (uid, x, *wanted), (iid, y) = (unpacked(side.values) for side in (us, vs))
                order = np.argsort(iid)
                s = forward(x, y[order])
                each = np.minimum(n + (wanted[0].astype(np.int64) if wanted else np.zeros(len(uid), np.int64)), s.shape[1])
                # Users who get the same number go together: one long list makes nobody else's longer.
                for k in np.unique(each):
                    mine = np.flatnonzero(each == k)
                    best = np.argsort(-np.round(s[mine], 6), axis=1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(uid[mine], k)), pa.array(iid[order][best].ravel()), pa.array(np.take_along_axis(s[mine], best, 1).ravel()), pa.array(np.full(best.size, n + (wanted[0][mine[0]] if wanted else 0), np.int64))],
                        names=["u", "i", "score", "n"])

    found = pairs.mapInArrow(run, "u long, i long, score double, n long")
    if not more:
        return top_n(found.drop("n"), n)
    by = Window.partitionBy("u").orderBy(F.round("score", DIGITS).desc(), "i")
    return found.withColumn("rk", F.row_number().over(by)).where("rk <= n").drop("n")


def mean_vector(vectors: DataFrame) -> DataFrame:
    """(vec): the mean of all vectors but id 0's, per place - the vector of unknown ids."""
    each = vectors.where("id <> 0").select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    return each.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("l")).select(F.col("l.x").alias("vec"))


def with_default(vectors: DataFrame) -> DataFrame:
    """vectors(id, vec) with the mean of the others under id 0."""
    mean = mean_vector(vectors).select(F.lit(0).cast(vectors.schema["id"].dataType).alias("id"), "vec")
    return vectors.where("id <> 0").unionByName(mean)


def default_items(users: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(i, rank): the n best items of the mean user, what unknown users get."""
    mean = mean_vector(users).select(F.lit(0).cast("long").alias("id"), "vec")
    return top_items(mean, items, n).select("i", F.col("rk").alias("rank"))


def pair_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """pairs(u, pos, neg, ...) with pos_score and neg_score, the dot products of the user with either item."""
    def side(name: str) -> DataFrame:
        return items.select(F.col("id").alias(name), F.col("vec").alias(f"__{name}"))

    out = pairs.join(users.select(F.col("id").alias("u"), F.col("vec").alias("__u")), "u").join(side("pos"), "pos").join(side("neg"), "neg")
    return out.select(*pairs.columns, dot("__u", "__pos").alias("pos_score"), dot("__u", "__neg").alias("neg_score"))


#: What takes the place of a masked logit: the least 32-bit float.
MASKED = -3.4028234663852886e38


def list_scores(rows: DataFrame, users: DataFrame, items: DataFrame, shares: DataFrame, temperature: float = 1.0, mask_equal: bool = False) -> DataFrame:
    """(u, i, logits, target) for rows(u, i, batch): a user's scores with all items of the batch, corrected by shares(i, share).

    A batch is a bounded list, in order of (u, i); target is the own item's place in it,
    from 0. mask_equal puts MASKED where another row of the batch has the same item: it
    would be a negative and is a positive.
    """
    each = rows.join(items.select(F.col("id").alias("i"), F.col("vec").alias("v")), "i").join(shares, "i")
    batch = each.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("u", "i", "v", "share"))).alias("all"))
    own = rows.join(users.select(F.col("id").alias("u"), F.col("vec").alias("a")), "u").join(batch, "batch")
    logits = F.transform("all", lambda x: dot("a", x["v"]))
    target = F.array_position(F.transform("all", lambda x: F.struct(x["u"], x["i"])), F.struct("u", "i")) - 1
    out = own.select("u", "i", "all", adjusted_logits(logits, F.transform("all", lambda x: x["share"]), temperature).alias("logits"), target.alias("target"))
    if mask_equal:
        other = lambda x, k: F.when((F.col("all")[k]["i"] == F.col("i")) & (k != F.col("target")), F.lit(MASKED)).otherwise(x)
        out = out.withColumn("logits", F.transform("logits", other))
    return out.drop("all")


def normalized(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", unit("vec").alias("vec"))


def fm_pairwise(field_vectors: Column) -> Column:
    """Half of (square of the sum - sum of the squares) per place, over an array of vectors."""
    zero = F.transform(field_vectors[0], lambda x: x * 0)
    total = F.aggregate(field_vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    squares = F.aggregate(field_vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b * b))
    return F.zip_with(total, squares, lambda a, b: (a * a - b) / 2)


def mse(logit, label) -> Column:
    return F.avg((F.col(logit) - F.col(label)) * (F.col(logit) - F.col(label)))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def binary_cross_entropy(logit, label) -> Column:
    return F.avg(_softplus(F.col(logit)) - F.col(logit) * F.col(label))


def focal(logit, label, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    x, y = F.col(logit), F.col(label)
    p = sigmoid(x)
    pt = p * y + (1 - p) * (1 - y)
    weight = alpha * y + (1 - alpha) * (1 - y)
    return F.avg(weight * F.pow(1 - pt, F.lit(gamma)) * (_softplus(x) - x * y))


def bpr(pos, neg) -> Column:
    return F.avg(_softplus(F.col(neg) - F.col(pos)))


def max_margin(pos, neg, margin: float = 1.0) -> Column:
    return F.avg(F.greatest(F.lit(0.0), margin - (F.col(pos) - F.col(neg))))


def softmax_cross_entropy(logits: Column, target: Column) -> Column:
    """Mean of log(sum(exp)) - the target's logit; target counts from 0."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.avg(top + F.log(total) - F.element_at(logits, (target + 1).cast("int")))


def adjusted_logits(logits: Column, shares: Column, temperature: float = 1.0) -> Column:
    """logits / temperature - log(share) of each item, for in-batch softmax."""
    return F.zip_with(logits, shares, lambda x, s: x / temperature - F.log(F.greatest(s, F.lit(1e-9))))
