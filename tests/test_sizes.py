"""Queries at ids and sizes that the small tables do not have."""

from pyspark.sql import functions as F

from harrow.operators import sampling, training
from harrow.plans import queries


def test_density_of_many_items(spark, monkeypatch):
    """The square of 100,001 ids is no int."""
    cells = spark.createDataFrame([(1, 1, 1.0), (1, 100_000, 2.0), (2, 100_000, 1.0)], "u int, i int, r double")
    monkeypatch.setattr(queries, "_r", lambda *_: cells)
    assert queries.sim_density(spark, "").first().asDict() == {"n": 2, "density": 200.0 / 100_001**2}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_random_negatives_are_drawn_in_place(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).cast("int").alias("u"), (F.col("id") % 3 + 1).cast("int").alias("i")).withColumnRenamed("id", "row")
    drawn = sampling.negatives_from_random(rows, 3, 2)
    probes = sampling._probes(rows, 2, sampling.PROBES, 3, 42)
    assert sorted(drawn.collect()) == sorted(sampling._first(probes, F.col("neg") == F.col("i")).select(*drawn.columns).collect())
    alone = rows.where("i = 1")
    assert sampling.negatives_from_random(alone, 1, 1).where("neg <> 1").isEmpty() and sampling.negatives_from_random(alone, 1, 1).count() == alone.count()
    assert exchanges(drawn) == 0
    assert exchanges(training.training_rows(rows, rows, 3)) == 0
