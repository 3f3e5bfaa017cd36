import pytest
from edges import CLASHING, EDGES
from pyspark.sql import functions as F


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def edges(spark):
    df = plain(spark, [*EDGES, EDGES[7]])
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return plain(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
