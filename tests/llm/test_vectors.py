"""Near-duplicate vectors where windows, blocks and partitions are smaller than the groups."""

import numpy as np
import pandas as pd
import pytest

from harrow.llm import embed_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, parts=8):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 1})).repartition(parts)


def links(x, cosine=0.93):
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near


def smallest(near):
    low = np.arange(len(near))
    while True:
        new = np.array([min(low[i], low[near[i]].min()) if near[i].any() else low[i] for i in range(len(near))])
        if (new == low).all():
            return low
        low = new


@pytest.mark.parametrize("background", [0.0, 0.65])
def test_recall_of_a_large_label(spark, background):
    """10,000 vectors of one label, evenly spread or in a cone, half of them with a partner just above the threshold."""
    rng = np.random.default_rng(1)
    x = unit(np.sqrt(background) * unit(rng.normal(size=(1, 64))) + np.sqrt(1 - background) * unit(rng.normal(size=(5000, 64))))
    off = rng.normal(size=x.shape)
    off = unit(off - (off * x).sum(1, keepdims=True) * x)
    x = np.vstack([x, 0.935 * x + np.sqrt(1 - 0.935**2) * off])
    want = links(x).sum(1)
    got = embed_dedup.near_duplicate_vectors(spark, table(spark, x)).toPandas().set_index("vec_id").sort_index()
    assert (got["n_links"].to_numpy() <= want).all() and got["n_links"].sum() >= 0.999 * want.sum()


@pytest.mark.parametrize("partitions", [3, 90])
def test_groups_over_many_blocks_and_partitions(spark, partitions):
    """Tight groups (all pairs by their centres), loose ones and chains, in blocks of 16 and windows of 8, over more partitions than windows."""
    rng = np.random.default_rng(2)
    tight = unit(unit(rng.normal(size=(1, 32))) + 0.01 * rng.normal(size=(200, 32)))
    loose = unit(unit(rng.normal(size=(1, 32))) + 0.05 * rng.normal(size=(200, 32)))
    turn = np.arange(0, 3, 0.05)
    a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    chain = np.cos(turn)[:, None] * a + np.sin(turn)[:, None] * b
    x = np.vstack([tight, loose, chain, unit(rng.normal(size=(100, 32)))])
    x = x[rng.permutation(len(x))]
    near = links(x)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set(coalesce, "false")
        got = embed_dedup.near_duplicate_vectors(spark, table(spark, x), window=8, block=16).toPandas().set_index("vec_id").sort_index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(coalesce)
    assert (got["n_links"].to_numpy() == near.sum(1)).all()
    assert (got["component_id"].to_numpy() == smallest(near)).all()


def test_spanning_edges():
    rng = np.random.default_rng(7)
    for n, m in ((2, 1), (10, 12), (60, 90), (60, 1500)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        kept = embed_dedup._spanning(n, i, j)
        assert len(kept) < 2 * n
        assert (embed_dedup._forest(n, i[kept], j[kept]) == embed_dedup._forest(n, i, j)).all()


@pytest.mark.parametrize("most", [embed_dedup.FIRST_PASSES, 64])
def test_crowded_labels_lose_no_link(spark, monkeypatch, most):
    """A label beyond all passes is compared block by block: tight groups, loose ones, chains and a narrow cone beside an even label."""
    monkeypatch.setattr(embed_dedup, "MAX_PASSES", most)
    monkeypatch.setattr(embed_dedup, "CROWDED", 4)
    monkeypatch.setattr(embed_dedup, "TILE", 50)
    rng = np.random.default_rng(3)
    tight = unit(unit(rng.normal(size=(1, 32))) + 0.01 * rng.normal(size=(300, 32)))
    loose = unit(unit(rng.normal(size=(1, 32))) + 0.05 * rng.normal(size=(300, 32)))
    cone = unit(np.sqrt(0.87) * unit(rng.normal(size=(1, 32))) + np.sqrt(0.13) * unit(rng.normal(size=(900, 32))))
    x = np.vstack([tight, loose, cone])
    x = x[rng.permutation(len(x))]
    even = unit(rng.normal(size=(400, 32)))
    labels = np.concatenate([np.ones(len(x), int), np.full(400, 2)])
    both = np.vstack([x, even])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(both)), "embedding": both.tolist(), "label": labels})).repartition(6)
    near = links(both) & (labels[:, None] == labels[None, :])
    got = embed_dedup.near_duplicate_vectors(spark, df, window=8, block=32).toPandas().set_index("vec_id").sort_index()
    assert (got["n_links"].to_numpy() == near.sum(1)).all()
    assert (got["component_id"].to_numpy() == smallest(near)).all()
