"""Exact medians against sorting, and draws without replacement."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.operators import quantiles, sampling


def exact(values):
    v = sorted(x for x in values if x is not None)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None


CASES = {
    "odd": list(range(1001)), "even": list(range(1000)), "nulls": [None if i % 3 else float(i) for i in range(3000)], "none": [None] * 50, "one": [7.5] + [None] * 20,
    "ties": [5.0] * 700 + list(range(600)), "two_sides": [1.0] * 500 + [2.0] * 500, "three": [1.0] * 333 + [2.0] * 333 + [9.0] * 334, "skewed": [float(10.0 ** (i % 300)) for i in range(2000)],
    "negative": [-(i**2) / 7 for i in range(999)], "infinite": [float("-inf")] * 300 + [0.5] * 3 + [float("inf")] * 300,
}


@pytest.mark.parametrize("limit", [100_000, 40, 2])
def test_medians(spark, limit):
    size = max(map(len, CASES.values()))
    frame = pd.DataFrame({c: pd.Series(v + [None] * (size - len(v)), dtype="float64") for c, v in CASES.items()})
    rows = [tuple(None if x != x else x for x in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in CASES)).repartition(7).cache()
    got = quantiles.medians(df, list(CASES), limit)
    for c, v in CASES.items():
        assert got[c] == exact([None if x is None else float(x) for x in v]), c
    assert quantiles.medians(df, []) == {} and quantiles.medians(df.where("false"), ["odd"], limit) == {"odd": None}


def test_median_of_a_large_column_holds_few_values(spark, monkeypatch):
    """A million values and ties: only the last few are sorted in one place."""
    df = spark.range(1_000_000).select((F.pow(F.rand(3), 6) * 1000).alias("a"), F.floor(F.rand(4) * 50).alias("b"))
    df = df.cache()
    held = []
    sort = F.collect_list
    monkeypatch.setattr(quantiles.F, "collect_list", lambda c: held.append(c) or sort(c))
    got = quantiles.medians(df, ["a", "b"], 2000)
    want = df.agg(F.percentile("a", F.lit(0.5)), F.percentile("b", F.lit(0.5))).first()
    assert got == {"a": pytest.approx(want[0], abs=0), "b": want[1]} and len(held) == 1  # b ends in ties and is never sorted


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_permutation(spark, n):
    keys = F.array(*(F.struct(F.lit(17 * j + 3).cast("long").alias("a"), F.lit(991 * j + 1).cast("long").alias("b")) for j in range(sampling.ROUNDS)))
    got = [r[0] for r in spark.range(n).select(sampling.permuted(F.col("id"), n, keys)).collect()]
    assert sorted(got) == list(range(n))


def test_distinct_negatives(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, int(u), int(i)) for k, (u, i) in enumerate(zip(rng.integers(1, 50, 1000), rng.integers(1, 301, 1000), strict=True))], "row long, u int, i int")
    got = sampling.negatives_distinct(rows, 300, 3, batch_size=50).toPandas()
    assert len(got) == 3000 and got["neg"].between(1, 300).all() and (got["neg"] != got["i"]).all()
    assert got.groupby("batch").agg(n=("neg", "size"), m=("neg", "nunique")).eval("n == m").all()
    assert (got.groupby("row").size() == 3).all() and (got.groupby("batch")["row"].nunique() == 50).all()
    counts = got["neg"].value_counts().reindex(range(1, 301), fill_value=0)
    assert ((counts - 10) ** 2 / 10).sum() < 400  # chi-squared of 300 items
    again = sampling.negatives_distinct(rows.repartition(9), 300, 3, batch_size=50).toPandas()
    key = ["row", "k"]
    assert got.sort_values(key).values.tolist() == again.sort_values(key)[got.columns].values.tolist()
    # Nearly all items in one batch, and more than there are.
    tight = sampling.negatives_distinct(rows, 160, 3, batch_size=50).toPandas()
    assert tight.groupby("batch")["neg"].nunique().min() >= 145
    few = sampling.negatives_distinct(rows.withColumn("i", F.col("i") % 7 + 1), 7, 2, batch_size=50).toPandas()
    assert (few["neg"] != few["i"]).all() and few["neg"].between(1, 7).all()
    with pytest.raises(ValueError):
        sampling.negatives_distinct(rows, 1)
