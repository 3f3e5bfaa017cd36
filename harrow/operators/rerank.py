"""Diverse re-ranking by determinantal point processes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.expressions import dot, unit
from harrow.operators import embed, serve

STOP = 1e-10


def kernel_entries(candidates: DataFrame) -> DataFrame:
    """(u, a, b, value) of candidates(u, i, score, vec): score_a * score_b * (cosine + 1) / 2, vectors at unit length."""
    left = candidates.select("u", F.col("i").alias("a"), F.col("score").alias("qa"), F.col("vec").alias("va"))
    right = candidates.select("u", F.col("i").alias("b"), F.col("score").alias("qb"), F.col("vec").alias("vb"))
    return left.join(right, "u").select("u", "a", "b", (F.col("qa") * F.col("qb") * (dot("va", "vb") + 1) / 2).alias("value"))


def greedy_map(kernel: np.ndarray, n: int) -> list[int]:
    """Items that raise the log determinant most, one by one; ends where none adds more than STOP.

    Keeps, per item, its squared distance to the span of the chosen ones and its
    coordinates there (one row of the Cholesky factor per choice).
    """
    left = kernel.diagonal().copy()
    coords = np.zeros((0, len(kernel)))
    chosen: list[int] = []
    while len(chosen) < min(n, len(kernel)):
        best = int(np.argmax(left))
        if left[best] < STOP:
            break
        row = (kernel[best] - coords[:, best] @ coords) / np.sqrt(left[best])
        coords = np.vstack([coords, row])
        left = left - row * row
        chosen.append(best)
        left[chosen] = -np.inf
    return chosen


def rerank_kernel(kernel: np.ndarray, n: int) -> list[int]:
    """greedy_map, started anew on the rest until n items are chosen."""
    rest, out = list(range(len(kernel))), []
    while rest and len(out) < n:
        got = greedy_map(kernel[np.ix_(rest, rest)], n - len(out))
        if not got:
            out += rest[: n - len(out)]
            break
        out += [rest[g] for g in got]
        rest = [r for k, r in enumerate(rest) if k not in set(got)]
    return out


def candidates(users: DataFrame, items: DataFrame, n: int, n_candidates: int | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(u, i, score, vec) of each user's n_candidates best items by dot product, vectors at unit length.

    20 times n of them by default, as far as there are items; more than n and no more
    than the items there are. Items of lists(u, items) are left out where enough others stay.
    """
    n_items = items.count()
    n_candidates = n_candidates or min(20 * n, n_items)
    if not n < n_candidates <= n_items:
        raise ValueError(f"candidates must be more than {n} and at most {n_items}")
    if lists is None:
        best = embed.top_items(users, items, n_candidates).select("u", "i", "score")
    else:
        # A user's own list says how much more the user needs; where it is not taken out, nothing.
        size = F.when(F.col("size") + n_candidates <= n_items, F.col("size")).otherwise(0)
        sizes = lists.select(F.col("u").alias("id"), F.size("items").alias("size"))
        wanted = users.select("id", "vec").join(sizes, "id", "left").select("id", "vec", F.coalesce(size, F.lit(0)).alias("more"))
        best = serve.top_items(embed.top_items(wanted, items, n_candidates).select("u", "i", "score"), lists, n_items, n_candidates)
    return best.join(items.select(F.col("id").alias("i"), unit("vec").alias("vec")), "i").select("u", "i", "score", "vec")


def recommend(users: DataFrame, items: DataFrame, n: int, n_candidates: int | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(u, i, rk): n diverse items for each of users(id, vec) out of its candidates()."""
    return dpp_rerank(candidates(users, items, n, n_candidates, lists), n)


def dpp_rerank(candidates: DataFrame, n: int) -> DataFrame:
    """(u, i, rk): n diverse items of each user's candidates(u, i, score, vec), vectors at unit length.

    A user's candidates are a bounded list (n times a factor), so one task takes whole users.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "i"], ascending=[False, True])
        e, q = np.array(frame["vec"].tolist(), float), frame["score"].to_numpy(float)
        got = rerank_kernel((e @ e.T + 1) / 2 * np.outer(q, q), n)
        return pd.DataFrame({"u": frame["u"].iloc[0], "i": frame["i"].to_numpy()[got], "rk": np.arange(1, len(got) + 1)})

    return candidates.groupBy("u").applyInPandas(run, "u long, i long, rk int")
