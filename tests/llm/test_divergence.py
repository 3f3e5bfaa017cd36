"""Source divergence: the SQL on awkward rows, and a sketch too small to tell terms apart."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import divergence
from harrow.llm.queries import OP12_SQL

KEY = ["lang", "source", "part", "rank"]


def corpus(spark, edges):
    """Words of very different frequency, a source with a third of all rows, one word in 29 and one in 30 documents, and the awkward rows."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)])
    texts = [(i, " ".join(words[(rng.pareto(1.0, 40) * 4).astype(int) % 300]), ("en", "de", None, "")[i % 4], "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None) for i in range(600)]
    texts += [(1000 + i, "rare twenty ÉTÉ été naïve_x", "fr", "a" if i % 2 else "b") for i in range(29)]
    texts += [(1100 + i, "Thirty ÜBER über x1y", "fr", "a") for i in range(30)] + [(1200, "!!! 12 [\\]^`{|}~", "fr", "empty"), (1201, None, "it", "only")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    return df.unionByName(edges.select("doc_id", "text", "lang", F.lit("edge").alias("source")))


def same(df, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    want, got = con.execute(OP12_SQL).df(), df.toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x.sort_values(KEY).reset_index(drop=True)[columns] for x in (got, want))
    assert got.values.tolist() == want.values.tolist()
    return got


@pytest.mark.parametrize("width", [None, divergence.SLAB])
def test_same_as_sql(spark, edges, width, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    docs = corpus(spark, edges).repartition(5)
    got = same(divergence.audit(spark, docs, width=width), docs)
    terms = set(got[got["lang"] == "fr"].query("part == 'term'")["item"])
    assert "thirty" in terms and "rare" not in terms
    assert not (got["source"] == "only").any()
    assert (got.query("part == 'pair' and lang == 'fr' and source == 'empty'")["value"] > 0).all()


def test_sketch_never_underestimates_and_discards(spark, edges):
    docs = corpus(spark, edges).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    exact = divergence.term_counts(spark, docs, min_docs=1).toPandas()
    kept = divergence.term_counts(spark, docs, min_docs=30, width=1 << 16).toPandas()
    df = exact[exact["term"] != ""].groupby(["lang", "term"])["df"].sum()
    found = kept[kept["term"] != ""].groupby(["lang", "term"])["df"].sum()
    assert set(df[df >= 30].index) <= set(found.index) and (df[found.index] == found).all()
    assert len(found) < len(df)


def test_clashing_names_and_empty_tables(spark, edges, empty):
    clash = edges.withColumn("source", F.lit("x")).withColumns({c: F.lit(1) for c in ("term", "p", "q", "slab", "total", "own", "part", "item", "value")})
    same(divergence.audit(spark, clash, min_docs=1), clash)
    assert divergence.audit(spark, empty.withColumn("source", F.lit("x"))).count() == 0


def test_counts_beyond_a_long_product(spark):
    """Shares stay exact where the scaled count no longer fits 64 bits."""
    n = 3 * 10**12
    got = spark.createDataFrame([(n, 7 * 10**12, 11)], "n long, total long, v long").select(divergence._share("n", "total", "v").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (7 * 10**12 + 55)
