"""Diverse recommendations from vectors, restated user by user."""

import numpy as np
import pandas as pd

from harrow.operators import embed, rerank


def vectors(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "vec": x.tolist()}), "id long, vec array<double>")


def chosen(scores, unit, n):
    """Items by brute force: at every step the one that makes the kernel's determinant largest; anew when none adds to it."""
    kernel = np.outer(scores, scores) * (unit @ unit.T + 1) / 2
    rest, out = list(range(len(scores))), []
    while rest and len(out) < n:
        got = []
        while len(out) + len(got) < n and len(got) < len(rest):
            left = [j for j in rest if j not in got]
            before = np.linalg.det(kernel[np.ix_(got, got)]) if got else 1.0
            gains = [np.linalg.det(kernel[np.ix_([*got, j], [*got, j])]) / before for j in left]
            if max(gains) < 1e-9:
                break
            got.append(left[int(np.argmax(gains))])
        if not got:
            return out + rest[: n - len(out)]
        out, rest = out + got, [j for j in rest if j not in got]
    return out


def test_recommendations(spark):
    """A user with nearly all items, one with a long list, one with none: everyone's candidates are the own ones."""
    rng = np.random.default_rng(21)
    x, y = rng.normal(size=(6, 5)), rng.normal(size=(60, 5))
    lists = {0: list(range(100, 158)), 1: list(range(100, 140)), 2: [], 3: [101, 103], 4: [159]}
    n, n_candidates = 4, 12
    had = spark.createDataFrame(list(lists.items()), "u long, items array<long>")
    users, items = vectors(spark, range(6), x), vectors(spark, range(100, 160), y)
    got = {}
    for r in rerank.recommend(users, items, n, n_candidates, had).collect():
        got.setdefault(r["u"], {})[r["rk"]] = r["i"]
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    for u in range(6):
        s = y @ x[u]
        gone = lists.get(u, []) if len(lists.get(u, [])) + n_candidates <= 60 else []
        order = [i for i in sorted(range(60), key=lambda i: (-round(s[i], 6), i)) if i + 100 not in gone][:n_candidates]
        want = [order[j] + 100 for j in chosen(s[order], unit[order], n)]
        assert [got[u][k] for k in sorted(got[u])] == want


def test_one_long_list_makes_no_other_longer(spark):
    rng = np.random.default_rng(22)
    users = vectors(spark, range(30), rng.normal(size=(30, 4)))
    items = vectors(spark, range(500), rng.normal(size=(500, 4)))
    had = spark.createDataFrame([(0, list(range(400)))], "u long, items array<long>")
    wanted = users.join(had.selectExpr("u as id", "size(items) as more"), "id", "left").na.fill(0, ["more"])
    rows = embed.top_items(wanted, items, 10, user_block=7, item_block=50).groupBy("u").count().collect()
    assert {r["u"]: r["count"] for r in rows} == {u: 410 if u == 0 else 10 for u in range(30)}
    assert rerank.candidates(users, items, 5, 10, had).groupBy("u").count().where("count = 10").count() == 30
