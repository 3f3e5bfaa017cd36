"""Training rows: samples, negatives, features and sequences as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import features, history, sampling
from harrow.sources.scratch import stored

SAMPLERS = ("random", "popular", "unconsumed")


def negatives(rows: DataFrame, r: DataFrame, n_items: int, sampler: str = "random", num_neg: int = 1, seed: int = 42, temperature: float = 0.75) -> DataFrame:
    """(row, u, i, k, neg) for rows(row, u, i), by the sampler's rule over the interactions r."""
    if sampler == "random":
        return sampling.negatives_from_random(rows, n_items, num_neg, seed)
    if sampler == "popular":
        return sampling.negatives_from_popular(rows, stored(sampling.popularity(r, temperature), "popularity"), num_neg, seed)
    if sampler == "unconsumed":
        return sampling.negatives_from_unconsumed(rows, r, n_items, num_neg, seed)
    raise ValueError(f"sampler must be one of {SAMPLERS}")


def _listed(rows: DataFrame, r: DataFrame, n_items: int, sampler: str, num_neg: int, seed: int, temperature: float) -> DataFrame:
    """rows(row, u, i, ...) with negs, the negatives of a row as a list."""
    if sampler == "random":
        return sampling.random_lists(rows, n_items, num_neg, seed)
    if sampler == "unconsumed":
        return sampling.unconsumed_lists(rows, r, n_items, num_neg, seed)
    drawn = negatives(rows.select("row", "u", "i"), r, n_items, sampler, num_neg, seed, temperature)
    drawn = drawn.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "neg"))).alias("negs")).select("row", F.col("negs.neg").alias("negs"))
    return rows.join(drawn, "row", "left").withColumn("negs", F.coalesce("negs", F.array().cast("array<int>")))


def training_rows(
    rows: DataFrame, r: DataFrame, n_items: int, sampler: str | None = "random", num_neg: int = 1, pairwise: bool = False, labels: str | None = None,
    users: DataFrame | None = None, items: DataFrame | None = None, lists: DataFrame | None = None, length: int = 0, seed: int = 42, temperature: float = 0.75,
) -> DataFrame:
    """What a model learns from, out of rows(row, u, i, label or labels).

    Pointwise: (row, k, u, i, label), the row itself with k = 0 and its negatives with k
    from 1 and label 0; without a sampler the rows and labels as they are. A positive's
    label is 1, or its own array of labels if the column labels is named. Pairwise:
    (row, k, u, pos, neg).

    users(u, ...) and items(i, ...) add features, in pairs with the prefixes pos_ and
    neg_. lists(u, items) adds seq, the length items before the row's own one; a row's
    negatives share its sequence.
    """
    if pairwise and not sampler:
        raise ValueError("pairs need a sampler")
    if length and lists is None:
        raise ValueError("sequences need the users' lists")
    base = rows.select("row", "u", "i", *([F.col(labels).alias("labels")] if labels else [] if sampler else ["label"]))
    given = ["row", "u", "i"]
    # What a row's samples share is joined to the row, before they are drawn.
    if users is not None:
        base = features.inputs(base, users, "u", "u")
    if pairwise and items is not None:
        base = features.inputs(base, items, "i", "i", "pos_")
    if length:
        base = history.interacted_sequences(base, lists, length, seed)
    shared = [c for c in base.columns if c not in (*given, "labels", "label", "seq")]
    last = ["seq"] * bool(length)
    if not sampler:
        name = labels or "label"
        out, own = base.select("row", F.lit(0).alias("k"), "u", "i", F.col("labels" if labels else "label").alias(name), *shared, *last), ["row", "k", "u", "i", name]
    elif pairwise:
        out = _listed(base, r, n_items, sampler, num_neg, seed, temperature).select("row", "u", F.col("i").alias("pos"), *shared, *last, F.posexplode("negs").alias("k", "neg")).withColumn("k", F.col("k") + 1)
        own = ["row", "k", "u", "pos", "neg"]
    else:
        both = _listed(base, r, n_items, sampler, num_neg, seed, temperature)
        kept = [c for c in base.columns if c != "i"]
        out = both.select(*kept, F.posexplode(F.concat(F.array("i"), "negs")).alias("k", "i"))
        if labels:
            out, own = out.withColumn("labels", F.when(F.col("k") == 0, F.col("labels")).otherwise(F.transform("labels", lambda x: x * 0))), ["row", "k", "u", "i", "labels"]
        else:
            out, own = out.withColumn("label", F.when(F.col("k") == 0, 1.0).otherwise(0.0)), ["row", "k", "u", "i", "label"]
    if items is not None:
        key, prefix = ("neg", "neg_") if pairwise else ("i", "")
        before = out.columns
        out = features.inputs(out, items, key, "i", prefix)
        shared += [c for c in out.columns if c not in before]
    return out.select(*own, *shared, *last)
