"""Block-wise products: the rows that ranking all pairs gives, for blocks, lists and hot rows of any size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.operators import blocks, serve, similarity


@pytest.fixture(scope="module")
def r(spark):
    """A user with a third of all rows, an item of half the users, explicit zeros, id 0 and an entity of zeros only."""
    rng = np.random.default_rng(12)
    rows = {(int(u), int(i)): float(v) for u, i, v in zip(rng.zipf(1.3, 4000) % 150, rng.zipf(1.2, 4000) % 400, rng.integers(0, 6, 4000), strict=True)}
    rows |= {(7, i): float(i % 5) for i in range(390)} | {(u, 3): 2.0 for u in range(0, 150, 2)} | {(u, 399): 0.0 for u in range(5)}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "u int, i int, r double").repartition(6).cache()


def all_pairs(r, x, k, min_common):
    pivot = "u" if x == "i" else "i"
    return similarity.neighbors(similarity.cosine_pairs(similarity.pair_stats(r, x, pivot), similarity.sum_squares(r, x), min_common), k)


def found(df):
    return sorted((r["x"], r["nb"], round(r["sim"], 9), r["rk"]) for r in df.collect())


@pytest.mark.parametrize("x", ["u", "i"])
@pytest.mark.parametrize("k,min_common,work,heavy", [(20, 1, 2_000_000, 5000), (3, 2, 20_000, 50), (5, 1, 300, 7), (1000, 1, 5000, 1)])
def test_neighbors_as_from_all_pairs(r, x, k, min_common, work, heavy):
    got = blocks.top_neighbors(r, x, "u" if x == "i" else "i", k, min_common, work=work, heavy=heavy)
    assert found(got) == found(all_pairs(r, x, k, min_common))
    assert got.schema["x"].dataType == r.schema[x].dataType


def plain(left, right, n, seen):
    scored = left.select("pivot", "row", F.col("value").alias("v")).join(right, "pivot").groupBy("row", "col").agg(F.sum(F.col("v") * F.col("value")).alias("score"))
    if seen is not None:
        scored = scored.join(seen, ["row", "col"], "left_anti")
    by = Window.partitionBy("row").orderBy(F.round("score", 6).desc(), "col")
    return scored.withColumn("rk", F.row_number().over(by)).where(F.col("rk") <= n)


@pytest.mark.parametrize("work,heavy", [(2_000_000, 5000), (2000, 20), (60, 3)])
@pytest.mark.parametrize("with_seen", [True, False])
def test_sums_as_from_a_join(r, work, heavy, with_seen):
    left = r.select(F.col("i").alias("pivot"), F.col("u").alias("row"), F.col("r").alias("value"))
    right = all_pairs(r, "i", 10, 1).select(F.col("x").alias("pivot"), F.col("nb").alias("col"), F.col("sim").alias("value")).cache()
    seen = r.select(F.col("u").alias("row"), F.col("i").alias("col")) if with_seen else None
    key = lambda df: sorted((r["row"], r["col"], round(r["score"], 6) + 0.0, r["rk"]) for r in df.collect())
    assert key(blocks.top_sums(left, right, 7, seen, work=work, heavy=heavy)) == key(plain(left, right, 7, seen))


def test_nothing_gives_nothing(spark, r):
    none = r.where("u < 0")
    assert blocks.top_neighbors(none, "i", "u", 5).count() == 0
    assert serve.recommend(none, all_pairs(r, "i", 5, 1), "i").count() == 0
    alone = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (3, 0, 1.0), (1, 0, 1.0)], "u int, i int, r double")
    assert blocks.top_neighbors(alone, "i", "u", 5).count() == 0


def test_recommendations_for_some_users(spark, r):
    near = similarity.cosine_similarity(r, "i", k=10)
    some = spark.createDataFrame([(7,), (8,), (149,), (9999,)], "u int")
    whole = {(x["u"], x["i"], x["rk"]) for x in serve.recommend(r, near, "i", 5).where("u in (7, 8, 149)").collect()}
    assert {(x["u"], x["i"], x["rk"]) for x in serve.recommend(r, near, "i", 5, users=some).collect()} == whole and whole


def test_sums_stay_small():
    sums, rng = blocks.Sums(1), np.random.default_rng(1)
    want = {}
    for _ in range(30):
        keys = rng.integers(0, 50, 1000).astype(np.uint64)
        sums.add(keys, np.ones(1000))
        for x in keys.tolist():
            want[x] = want.get(x, 0) + 1
    keys, (counts,) = sums.close()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
    assert pd.Index(keys).is_monotonic_increasing


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.collect())


@pytest.mark.parametrize("x", ["u", "i"])
@pytest.mark.parametrize("work,heavy", [(4_000_000, 5000), (3000, 40), (400, 3)])
def test_pairs_as_from_a_join(r, x, work, heavy, monkeypatch):
    """Sums, similarities and number of all pairs, in blocks of any size, in rounds, with rows too long for a block."""
    monkeypatch.setattr(blocks, "ROUND", 5000)
    monkeypatch.setattr(blocks, "WORK", work)
    monkeypatch.setattr(blocks, "HEAVY", heavy)
    pivot = "u" if x == "i" else "i"
    plain = similarity._joined_stats(r, x, pivot).cache()
    assert rounded(similarity.pair_stats(r, x, pivot, heavy)) == rounded(plain)
    assert similarity.pair_stats(r, x, pivot).schema["x1"].dataType == r.schema[x].dataType
    for least in (1, 2):
        assert rounded(similarity.cosines(r, x, least)) == rounded(similarity.cosine_pairs(plain, similarity.sum_squares(r, x), least))
    assert similarity.pair_count(r, x).first()["n"] == plain.count()


@pytest.mark.parametrize("work", [4_000_000, 400])
def test_a_batch_as_from_kept_pairs(r, work, monkeypatch):
    monkeypatch.setattr(blocks, "WORK", work)
    old, new = r.where("(u + i) % 3 > 0"), r.where("(u + i) % 3 = 0 or i = 399")
    for x, pivot in (("i", "u"), ("u", "i")):
        ss, stats, fresh = similarity.sum_squares(old, x), similarity._joined_stats(old, x, pivot), similarity._joined_stats(new, x, pivot)
        want = similarity.update_cosine(similarity.cosine_pairs(stats, ss), similarity.update_pair_stats(stats, fresh), similarity.update_sum_squares(ss, new, x), fresh)
        assert rounded(similarity.incremental_cosines(old, new, x)) == rounded(want)


def test_values_and_ids_that_only_a_join_takes(spark, r):
    odd = r.unionByName(spark.createDataFrame([(3, 500, None), (4, 500, None), (4, 501, 2.0), (3, 501, 1.0)], "u int, i int, r double"))
    assert set(similarity.pair_stats(odd, "i", "u").collect()) == set(similarity._joined_stats(odd, "i", "u").collect())
    below = r.withColumn("i", F.col("i") - 5)
    assert rounded(similarity.pair_stats(below, "i", "u")) == rounded(similarity._joined_stats(below, "i", "u"))
    assert similarity.cosine_similarity(below, "i", k=3).count() > 0
    named = r.withColumn("i", F.concat(F.lit("i"), "i"))
    assert similarity.pair_count(named, "i").first()["n"] == similarity.pair_count(r, "i").first()["n"]


def test_numbers_travel_as_they_are():
    rng = np.random.default_rng(3)
    for a in (rng.integers(0, 7, 50).astype(float), rng.random(50), -rng.random(50), np.array([0.0, -0.0, np.nan, np.inf]), np.array([2.0**32]), rng.integers(0, 2**40, 9)):
        back = blocks._opened(blocks._squeezed(a)).astype(a.dtype)
        assert back.tobytes() == a.tobytes()
    ids = rng.integers(0, 2**32, 100)
    assert (blocks._opened(blocks._squeezed(ids, True), True) == ids).all()
    assert len(blocks._squeezed(np.full(10_000, 25.0))) < 200


def test_packs_are_smaller_than_the_products(spark):
    """What is sent for sparse pairs, at three numbers for a product, was more than the pairs themselves."""
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(u, int(i), float(i % 50)) for u in range(2000) for i in rng.choice(100_000, 20, replace=False)], "u int, i int, r double").cache()
    pairs = blocks.Pairs(cells, "i", "u", {"ss": "true"}, False, work=20_000)
    columns = ["x", "value", "ss"]
    lists = pairs.lists.select(*(F.col(f"l.{c}").alias(f"l_{c}") for c in [*columns, "block"]))
    sent = lists.mapInArrow(blocks._packs(0, pairs.n_blocks, columns, columns, False), blocks._PACKED).select(F.explode("parts").alias("p")).agg(F.sum(F.length("p"))).first()[0]
    assert pairs.n_blocks > 30 and sent < 12 * pairs.load


def test_rounds_give_all_rows(r):
    whole = found(blocks.top_neighbors(r, "i", "u", 5, work=2000))
    assert found(blocks.top_neighbors(r, "i", "u", 5, work=2000, size=3000)) == whole and whole


@pytest.mark.parametrize("work", [4_000_000, 500])
def test_common_items_in_rounds(r, work, monkeypatch):
    monkeypatch.setattr(blocks, "ROUND", 2000)
    monkeypatch.setattr(blocks, "WORK", work)
    cells = r.select("u", "i").where("u <> 7")
    items = cells.groupBy("u").agg(F.collect_list("i").alias("l")).collect()
    lists = {row["u"]: set(row["l"]) for row in items}
    want = {(u, v): sorted(lists[u] & lists[v]) for u in lists for v in lists if u < v and len(lists[u] & lists[v]) > 1}
    out = similarity.common_items(cells)
    assert {(row["u"], row["v"]): row["items"] for row in out.collect()} == want
    assert out.schema["items"].dataType.elementType == r.schema["i"].dataType
