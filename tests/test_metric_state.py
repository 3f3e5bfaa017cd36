"""Accumulated metrics: batches in any order and cut give what one pass gives, streams included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import metrics
from harrow.operators.metric_state import Evaluation

POINTS = ["rmse", "mae", "r2", "log_loss", "balanced_accuracy", "roc_auc", "pr_auc", "roc_gauc"]
LISTS = ["precision", "recall", "map", "ndcg", "coverage"]


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(17)
    rows = [(int(u), float(y), float(np.round(np.clip(0.3 * y + rng.random() * 0.7, 0, 1), 2))) for u, y in zip(rng.integers(0, 25, 800), rng.integers(0, 2, 800), strict=True)]
    return spark.createDataFrame(rows, "u int, label double, pred double").withColumn("n", F.monotonically_increasing_id()).cache()


@pytest.fixture(scope="module")
def listed(spark):
    rng = np.random.default_rng(18)
    recs = [(u, int(i), k + 1) for u in range(40) for k, i in enumerate(rng.permutation(80)[:10])]
    truth = [(u, [int(i) for i in rng.permutation(80)[: 1 + u % 9]]) for u in range(45)]
    return spark.createDataFrame(recs, "u int, i int, rk int").cache(), spark.createDataFrame(truth, "u int, items array<int>").cache()


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def at_once(preds, listed):
    recs, truth = listed
    parts = [metrics.rating_metrics(preds), *(f(preds) for f in (metrics.log_loss, metrics.balanced_accuracy, metrics.roc_auc, metrics.pr_auc, metrics.roc_gauc))]
    parts += [metrics.listwise_metrics(recs, truth), metrics.coverage(recs, 80)]
    return {k: v for p in parts for k, v in values(metrics.long_form(p)).items()}


def test_batches_in_any_order(spark, preds, listed, tmp_path):
    recs, truth = listed
    want = at_once(preds, listed)
    for name, order in (("a", (0, 1, 2)), ("b", (2, 0, 1))):
        state = Evaluation(spark, f"file://{tmp_path}/{name}", 8)
        for n in order:
            users = F.col("u") % 3 == n
            assert state.add(preds.where(F.col("n") % 3 == n), recs.where(users), truth.where(users), log=["rmse", "ndcg"])
        got = values(state.metrics(POINTS + LISTS, 80))
        assert got == {m: pytest.approx(want[m], abs=1e-9) for m in POINTS + LISTS}
        lines = state.log().orderBy("batch").where("metric = 'rmse'").collect()
        assert [r["batch"] for r in lines] == [0, 1, 2] and lines[-1]["value"] == pytest.approx(want["rmse"])
    again = Evaluation(spark, f"file://{tmp_path}/a")
    assert values(again.metrics(["roc_auc"]))["roc_auc"] == pytest.approx(want["roc_auc"], abs=1e-9)
    assert not again.add(preds, batch=2) and again.batch == 2  # it is in
    with pytest.raises(ValueError):
        again.add(recs=recs, truth=truth, k=5)
    with pytest.raises(ValueError):
        again.add()
    with pytest.raises(ValueError):
        again.metrics(["coverage"])
    with pytest.raises(ValueError):
        again.metrics(["accuracy"])


def test_streamed_predictions(spark, preds, listed, tmp_path):
    """Every micro-batch is added once, also if the checkpoint hands it out again."""
    for n in range(3):
        preds.where(F.col("n") % 3 == n).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state = Evaluation(spark, f"file://{tmp_path}/state", 8)
    stream = spark.readStream.schema(preds.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def fold(batch, number):
        state.add(batch, batch=number)
        assert not Evaluation(spark, f"file://{tmp_path}/state").add(batch, batch=number)

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    want = at_once(preds, listed)
    assert state.batch == 2 and values(state.metrics(POINTS)) == {m: pytest.approx(want[m], abs=1e-9) for m in POINTS}
