"""Known results on small matrices, split edges and metric definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import embed, history, metrics, neural, rerank, serve, similarity, split, vocab

BASE = {1: {1: 1, 2: 1}, 2: {1: 2, 2: 1}, 3: {2: 1, 3: 1}, 4: {1: 2, 2: 1, 3: 1}, 5: {2: 1, 3: 2}}
BATCH_A = {2: {1: 3}, 3: {1: 5}, 6: {1: 2, 2: 2, 3: 1, 4: 2}}
BATCH_B = {1: {4: 3, 5: 2}, 4: {2: 1, 4: 4, 5: 3}}


def matrix(spark, cells, x="u", y="i"):
    return spark.createDataFrame([(a, b, float(r)) for a, row in cells.items() for b, r in row.items()], f"{x} int, {y} int, r double")


def lists(near):
    out = {}
    for r in near.orderBy("x", "rk").collect():
        out.setdefault(r["x"], []).append((r["nb"], round(r["sim"], 4)))
    return out


@pytest.mark.parametrize("x", ["u", "i"])
def test_cosine_and_its_increments(spark, x):
    y = "i" if x == "u" else "u"
    r = matrix(spark, BASE, x, y)
    stats, ss = similarity.pair_stats(r, x, y), similarity.sum_squares(r, x)
    sims = similarity.cosine_pairs(stats, ss)
    got = lists(similarity.neighbors(sims))
    assert got[1] == [(2, 0.9487), (4, 0.866), (3, 0.5), (5, 0.3162)]
    assert got[5] == [(3, 0.9487), (4, 0.5477), (1, 0.3162), (2, 0.2)]
    for batch, x1, want in ((BATCH_A, 3, [(5, 0.9487), (2, 0.823), (4, 0.5774), (6, 0.5338), (1, 0.5)]), (BATCH_B, 1, [(4, 0.9585), (2, 0.9487), (3, 0.5), (5, 0.3162)])):
        b = matrix(spark, batch, x, y)
        fresh = similarity.pair_stats(b, x, y)
        stats, ss = similarity.update_pair_stats(stats, fresh), similarity.update_sum_squares(ss, b, x)
        sims = similarity.update_cosine(sims, stats, ss, fresh)
        assert lists(similarity.neighbors(sims))[x1] == want


def test_heavy_pivots_are_sliced_without_loss(spark):
    r = matrix(spark, {1: dict.fromkeys(range(1, 30), 1), 2: {3: 2, 4: 1}})
    whole, cut = (similarity.pair_stats(r, "i", "u", heavy=h).orderBy("x1", "x2").collect() for h in (1000, 4))
    assert whole == cut and len(whole) == 29 * 28 // 2


def test_swing(spark):
    r = matrix(spark, {1: dict.fromkeys((1, 2, 3, 4), 1), 2: dict.fromkeys((1, 2, 4), 1), 3: dict.fromkeys((1, 3, 4, 5), 1)})
    near = similarity.swing_similarity(r, alpha=1.0).where("x = 1").orderBy("rk").collect()
    assert [x["nb"] for x in near] == [4, 2, 3]
    assert np.allclose([x["sim"] for x in near], [0.32390, 0.09623, 0.08333], atol=1e-5)


def test_overlay(spark):
    old, new = matrix(spark, {1: {1: 2}, 2: {3: 3}}), matrix(spark, {1: {1: 1}, 3: {2: 5}, 4: {1: 4, 3: 1}})
    got = {(r["u"], r["i"]): r["r"] for r in similarity.merge_interactions(old, new).collect()}
    assert got == {(1, 1): 1, (2, 3): 3, (3, 2): 5, (4, 1): 4, (4, 3): 1}


def test_predict_cuts_before_it_meets(spark):
    sims = spark.createDataFrame([(9, nb, s, k + 1) for k, (nb, s) in enumerate([(4, 0.8), (2, 0.6), (5, 0.5), (3, 0.3), (1, 0.1)])], "x int, nb int, sim double, rk int")
    r = matrix(spark, {7: {1: 2, 2: 4, 3: 1, 4: 3, 5: 5}})
    pair = spark.createDataFrame([(7, 9), (8, 9)], "u int, i int")
    for task, want in (("ranking", 0.7), ("rating", 4.8 / 1.4)):
        got = {x["u"]: x["pred"] for x in serve.predict(pair, sims, r, "i", 2, task).collect()}
        assert got[7] == pytest.approx(want) and got[8] == 0
    with pytest.raises(ValueError):
        serve.predict(pair, sims, r, "i", 2, "other")


def test_top_n_breaks_ties_by_id(spark):
    scores = spark.createDataFrame([(1, i, float(i)) for i in range(1, 6)] + [(1, 9, 5.0)], "u int, i int, score double")
    assert [x["i"] for x in serve.top_n(scores, 3).orderBy("rk").collect()] == [5, 9, 4]
    assert serve.top_n(scores, 3, random=True).count() == 3


def test_consecutive_and_global(spark):
    rows = spark.createDataFrame([(1, i, k) for k, i in enumerate([10, 10, 20, 10, 30, 30])], "u int, i int, ord int")
    assert history.consumed(rows).first()["items"] == [10, 20, 10, 30]
    assert history.consumed(rows, "global").first()["items"] == [10, 20, 30]
    with pytest.raises(ValueError):
        history.consumed(rows, "none")


def test_sequences(spark):
    lists_ = spark.createDataFrame([(1, [5, 6, 7])], "u int, items array<int>")
    got = {r["i"]: r["seq"] for r in history.interacted_sequences(spark.createDataFrame([(1, 5), (1, 7)], "u int, i int"), lists_, 2).collect()}
    assert got == {5: [0, 0], 7: [5, 6]}
    assert {r["u"]: r["seq"] for r in history.recent_sequences(lists_, 2).collect()} == {0: [0, 0], 1: [6, 7]}


def interactions(spark, sizes):
    return spark.createDataFrame([(u, i, 1.0, u * 100 + i) for u, n in sizes.items() for i in range(n)], "user long, item long, label double, ord long")


def test_split_edges(spark):
    data = interactions(spark, {1: 1, 2: 2, 3: 3, 4: 5})
    train, test = split.split_by_num(data, test_size=4, filter_unknown=False)
    assert {r["user"]: r["count"] for r in test.groupBy("user").count().collect()} == {3: 1, 4: 4}
    train, test = split.split_by_ratio(data, test_size=0.5, filter_unknown=False)  # 1.5 and 2.5 round half to even: 2 and 2
    assert {r["user"]: r["count"] for r in train.groupBy("user").count().collect()} == {1: 1, 2: 2, 3: 2, 4: 2}
    parts = split.random_split(data, multi_ratios=[0.6, 0.2, 0.2], filter_unknown=False)
    assert [p.count() for p in parts] == split.sizes(11, [0.6, 0.2, 0.2]) and sum(p.count() for p in parts) == 11
    with pytest.raises(ValueError):
        split.ratios(1, None)
    with pytest.raises(ValueError):
        split.split_by_ratio_chrono(data, test_size=0.5)


def test_pad_and_filter(spark):
    train, test = interactions(spark, {1: 2}), interactions(spark, {1: 3, 2: 1})
    assert split.filter_unknown([train, test])[1].count() == 2
    got = {(r["user"], r["item"]) for r in split.pad_unknown([train, test], (-1, -2))[1].collect()}
    assert got == {(1, 0), (1, 1), (1, -2), (-1, 0)}


def test_vocab(spark):
    data = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    first = vocab.make_id_mapping(data, "v", "id")
    assert {r["v"]: r["id"] for r in first.collect()} == {"a": 1, "b": 2}
    more = vocab.extend_mapping(first, spark.createDataFrame([("0",), ("c",), ("a",)], "v string"), "v", "id")
    assert {r["v"]: r["id"] for r in more.collect()} == {"a": 1, "b": 2, "0": 3, "c": 4}


def test_hash_values(spark):
    data = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    got = {r["v"]: r["id"] for r in vocab.hash_mapping(data, "v", "__users__").collect()}
    assert got == {1: 81063, 2: 45525, 3: 147675}
    reverse = vocab.reverse_hash_mapping(vocab.hash_mapping(data, "v", "__users__", 1), "v").first()
    assert (reverse["id"], reverse["v"], reverse["collided"]) == (1, 3, 2)


def test_map_and_ndcg(spark):
    recs = spark.createDataFrame([(1, i, k) for k, i in enumerate([11, 20, 21, 12, 22], 1)] + [(2, 20, 1)], "u int, i int, rk int")
    truth = spark.createDataFrame([(1, [11, 12, 13]), (2, [99])], "u int, items array<int>")
    got = metrics.listwise_metrics(recs, truth, 5).first()
    assert got["map"] == pytest.approx((0.75 + 0) / 2)
    dcg, ideal = 1 + 1 / math.log2(5), 1 + 1 / math.log2(3)
    assert got["ndcg"] == pytest.approx(dcg / ideal / 2)
    assert got["precision"] == pytest.approx(0.4 / 2) and got["recall"] == pytest.approx(2 / 3 / 2)


def test_auc_ties_and_single_classes(spark):
    preds = spark.createDataFrame([(1, 1.0, 0.5), (1, 0.0, 0.5), (2, 1.0, 0.9), (2, 1.0, 0.1)], "u int, label double, pred double")
    assert metrics.roc_gauc(preds).first()[0] == pytest.approx(0.5 * 2 / 4)
    assert metrics.roc_auc(preds).first()[0] == pytest.approx((0.5 + 1 + 0) / 3)


def test_positive_consumed_without_positives(spark):
    rows = spark.createDataFrame([(1, 5, 0.0), (1, 6, 0.0)], "u int, i int, label double")
    assert history.positive_consumed(rows).first()["items"] == [5, 6]


def test_dpp_prefers_the_different_one():
    e = np.array([[1, 0], [1, 0], [1, 0], [0, 1.0]])
    kernel = (e @ e.T + 1) / 2 * np.outer([0.9, 0.8, 0.7, 0.6], [0.9, 0.8, 0.7, 0.6])
    assert rerank.greedy_map(kernel, 2) == [0, 3]
    assert sorted(rerank.rerank_kernel(kernel, 4)) == [0, 1, 2, 3]


def test_greedy_map_against_determinants():
    x = np.random.default_rng(0).normal(size=(7, 7))
    kernel, chosen = x @ x.T, []
    for _ in range(4):
        chosen.append(max((i for i in range(7) if i not in chosen), key=lambda i: np.linalg.slogdet(kernel[np.ix_(chosen + [i], chosen + [i])])[1]))
    assert rerank.greedy_map(kernel, 4) == chosen


def test_embedding_top_items_in_blocks(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(30, 4)), rng.normal(size=(50, 4))
    frame = lambda m: spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(m)], "id long, vec array<double>")
    got = embed.top_items(frame(u), frame(v), 3, user_block=7, item_block=11)
    want = np.argsort(-(u @ v.T), axis=1)[:, :3]
    assert {(r["u"], r["rk"]): r["i"] for r in got.collect()} == {(k, j + 1): want[k, j] for k in range(30) for j in range(3)}


def test_trained_factors(spark):
    """Two groups of users with a group of items each: own items score higher, and top items follow."""
    r = spark.createDataFrame([(u, i, 1.0) for u in range(1, 9) for i in range(1, 9) if u % 2 == i % 2], "u int, i int, r double")
    users, items = neural.als_vectors(r, size=4, rounds=8)
    best = embed.top_items(users.withColumn("id", F.col("id").cast("long")), items.withColumn("id", F.col("id").cast("long")), 3)
    assert best.count() == 24 and best.where("u % 2 <> i % 2").isEmpty()


def test_bags(spark):
    table = spark.createDataFrame([(0, [9.0]), (1, [2.0]), (2, [4.0])], "id int, vec array<double>")
    rows = spark.createDataFrame([(7, [1, 2, 0]), (8, [2, 2, 2])], "k int, ids array<int>")
    for combiner, want in (("sum", 6.0), ("mean", 3.0), ("sqrtn", 6 / math.sqrt(2))):
        got = {r["k"]: r["v"][0] for r in neural.embed_bag(rows, "k", "ids", table, "v", combiner).collect()}
        assert got[7] == pytest.approx(want)
    assert neural.embed_rows(rows.select("k"), "k", table, "v").first()["v"] == [9.0]


def test_labels_of_several_tasks(spark):
    rows = spark.createDataFrame([([0.0, 2.0],), ([0.0, 0.0],)], "labels array<double>")
    assert sorted(r[0] for r in rows.select(history.any_label("labels")).collect()) == [0.0, 1.0]
    assert rows.select(F.size("labels")).count() == 2
