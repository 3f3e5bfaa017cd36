"""Hard negatives: the SQL, trees of many leaves and blocks, ties, copies and awkward rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from harrow.llm import negatives
from harrow.llm.queries import OP11_SQL

SCHEMA = "vec_id long, label int, embedding array<float>"
KEY = ["anchor_id", "positive_id", "rank"]
#: The operator takes labels as they are, the query turns some.
PLAIN_SQL = OP11_SQL.replace("case when vec_id % 7 = 0 then (label + 1) % 10 else label end", "label")


def same(df, table: pd.DataFrame):
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, label int, embedding float[])")
    con.executemany("insert into embeddings values (?, ?, ?)", [(None if pd.isna(i) else int(i), None if pd.isna(n) else int(n), e) for i, n, e in table.itertuples(index=False)])
    want, got = con.execute(PLAIN_SQL).df(), df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x.sort_values(KEY).reset_index(drop=True)[sorted(want.columns)] for x in (got, want))
    assert got.values.tolist() == want.values.tolist()
    return got


def table(x, labels):
    return pd.DataFrame({"vec_id": np.arange(len(x)), "label": labels, "embedding": [[float(v) for v in r] for r in np.asarray(x, np.float32)]})


@pytest.mark.parametrize("leaves,block,bucket", [(None, 16_384, 128), (8, 40, 7), (64, 10, 1), (1, 5, 3)])
def test_same_as_sql(spark, leaves, block, bucket):
    """Clusters, a third of all rows equal, norms from nothing to large; trees of any shape give the same rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 12)) * rng.choice([0.05, 0.5], (900, 1))
    x[rng.random(900) < 0.33] = x[100]
    x *= rng.choice([0.1, 1, 3], (900, 1))
    x[200] = 0
    data = table(x, rng.integers(0, 4, 900))
    got = same(negatives.mine(spark, spark.createDataFrame(data, SCHEMA).repartition(6), leaves=leaves, block=block, bucket=bucket), data)
    assert len(got) > 100


def test_awkward_rows(spark):
    rng = np.random.default_rng(6)
    data = table(np.round(rng.normal(size=(260, 3)), 1), rng.integers(0, 2, 260))
    rows = [tuple(r) for r in data.itertuples(index=False)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, 1, None), (1100, None, [1.0, 0.0, 0.0]), (1200, 1, [1.0, nan, 0.0]), (1300, 0, [inf, 0.0, 0.0]), (1400, 1, [0.0, None, 0.0]), (None, 1, [1.0, 1.0, 1.0]), (-100, 5, [1.0, 0.5, 0.2]), (-200, 0, [-1.0, -0.5, 2.0])]
    df = spark.createDataFrame([(int(i), int(n), e) for i, n, e in rows] + odd, SCHEMA)
    clash = df.selectExpr("*", "1 as leaf", "'x' as chunk", "2 as q", "3 as kind", "4 as rank", "5 as id").unionByName(df.selectExpr("*", "1 as leaf", "'x' as chunk", "2 as q", "3 as kind", "4 as rank", "5 as id"))
    got = same(negatives.mine(spark, clash, leaves=4, block=50, bucket=8), pd.concat([data, pd.DataFrame(odd, columns=["vec_id", "label", "embedding"])]))
    assert not got["anchor_id"].isin([1000, 1100, 1200, 1300, 1400, -100]).any()


def test_short_and_empty_vectors_are_filled_with_zeros(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 1, [0.5, 0.5]), (3, 2, [0.6]), (4, 2, [0.3, 0.1]), (5, 2, [])]
    full = pd.DataFrame([(i, n, (e + [0.0, 0.0])[:2]) for i, n, e in rows], columns=["vec_id", "label", "embedding"])
    assert len(same(negatives.mine(spark, spark.createDataFrame(rows, SCHEMA)), full)) > 0


def test_large_components_and_empty_table(spark):
    big = 2.0**19
    rows = [(0, 1, [big, 3.0]), (1, 1, [big, 1.0]), (2, 2, [big / 2, 5.0]), (3, 2, [big / 2, 4.0]), (4, 2, [big / 2, 4.0])]
    same(negatives.mine(spark, spark.createDataFrame(rows, SCHEMA)), pd.DataFrame(rows, columns=["vec_id", "label", "embedding"]))
    assert negatives.mine(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark, spark.createDataFrame([(1, None, [1.0])], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(spark, spark.createDataFrame([(1, 1, [1e30])], SCHEMA))


def test_buckets_are_skipped(spark):
    """In clustered data most buckets are never compared, and what is found is the same."""
    rng = np.random.default_rng(8)
    space = negatives.Space(8, "<i2", 0)
    x = np.floor(256 * (3 * rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 8))))
    space = negatives.Space(8, "<i2", int((x * x).sum(1).max()))
    order, ends, rows, spans = negatives._grown(space, x, 32)
    assert sorted(order.tolist()) == list(range(4000)) and ends[-1] == 4000 and np.diff(ends, prepend=0).max() <= 32
    n = 50
    columns = {"anchor": np.arange(n), "number": np.zeros(n, int), "kind": np.zeros(n, int), "low": np.full(n, -(1 << 62)), "high": np.full(n, 1 << 62), "floor": np.full(n, negatives._NONE)}
    queries = negatives.Queries(space, columns, x[:n])
    compared = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                compared.append(at.stop - at.start)
            return np.asarray(self)[at]

    block = {"x": x[order].view(Counting), "ids": order, "kinds": np.zeros(4000, int), "ends": ends, "rows": rows, "spans": spans}
    who, ids, score = negatives._found(space, block, queries, True, 5)
    s = (x[:n] @ x.T).astype(int)
    for i in range(n):
        want = sorted((j for j in range(4000) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert ids[who == i].tolist() == want and score[who == i].tolist() == s[i, want].tolist()
    assert sum(compared) < 40 * 4000  # of each bucket's visit many queries take part; visits overall stay well below all pairs
