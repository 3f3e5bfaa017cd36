"""Metrics that batches add up to: sums, score histograms and hit counts in a kept state, and a log.

A batch leaves rows (kind, key, sums): one for the plain sums, one for each distinct score
and for each score of a user (the histograms that areas under curves need, exactly), one
for the lists, one for each item listed. Rows of one key are added, so batches may come
in any order and any cut; the metrics of all of them follow from the state at any time.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import metrics
from harrow.operators.state import PARTS, PartitionedState
from harrow.sources.scratch import stored, temporary

#: What the columns s0 to s8 of a kind hold.
POINT_SUMS = ("n", "label", "label2", "error2", "error", "loss", "n_one", "hit_one", "hit_zero")
LIST_SUMS = ("precision", "recall", "map", "ndcg", "users")
_WIDTH = len(POINT_SUMS)
_SUMS = [f"s{n}" for n in range(_WIDTH)]
_KEYS = ["kind", "u", "score", "item"]


def _rows(df: DataFrame, kind: str, sums: list, u=None, score=None, item=None) -> DataFrame:
    none = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    padded = [*sums, *[F.lit(0.0)] * (_WIDTH - len(sums))]
    return df.select(
        F.lit(kind).alias("kind"), none(u, "long").alias("u"), none(score, "double").alias("score"), none(item, "long").alias("item"),
        *(F.coalesce(x.cast("double"), F.lit(0.0)).alias(s) for x, s in zip(padded, _SUMS, strict=True)))


def points(preds: DataFrame, threshold: float = 0.5, digits: int = 9) -> DataFrame:
    """The rows of a batch of preds(label, pred), with u for the metric by user."""
    error, one = F.col("label") - F.col("pred"), F.col("label") == 1
    p = F.greatest(F.lit(metrics._EPS), F.least(F.lit(1 - metrics._EPS), F.col("pred")))
    hit = F.col("pred") >= threshold
    plain = preds.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label"), F.sum(F.col("label") * F.col("label")).alias("label2"), F.sum(error * error).alias("error2"),
        F.sum(F.abs(error)).alias("error"), F.sum(-F.when(one, F.log(p)).otherwise(F.log(1 - p))).alias("loss"), F.count(F.when(one, 1)).alias("n_one"),
        F.count(F.when(one & hit, 1)).alias("hit_one"), F.count(F.when((F.col("label") == 0) & ~hit, 1)).alias("hit_zero"))
    out = _rows(plain, "points", [F.col(c) for c in POINT_SUMS])
    out = out.unionByName(_rows(metrics.by_score(preds, digits), "score", [F.col("p"), F.col("n")], score=F.col("pred")))
    if "u" in preds.columns:
        out = out.unionByName(_rows(metrics.by_score(preds, digits, "u"), "user_score", [F.col("p"), F.col("n")], u=F.col("u"), score=F.col("pred")))
    return out


def lists(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """The rows of a batch of users' recs(u, i, rk) with their truth(u, items); a user is in one batch."""
    out = _rows(metrics.listwise_sums(recs, truth, k), "lists", [F.col(c) for c in LIST_SUMS])
    return out.unionByName(_rows(recs.select("i").distinct(), "item", [F.lit(1.0)], item=F.col("i")))


def added(rows: DataFrame) -> DataFrame:
    """Rows of one key added up."""
    return rows.groupBy("key", *_KEYS).agg(*(F.sum(s).alias(s) for s in _SUMS))


class Evaluation:
    """A kept state of metrics. Batches that carry a number are added once, whatever is repeated after a failure."""

    def __init__(self, spark: SparkSession, path: str, n_parts: int = PARTS):
        self.spark, self.state = spark, PartitionedState(spark, path, n_parts)

    @property
    def batch(self) -> int:
        """The number of the last batch that is in."""
        return self.state.notes.get("batch", -1)

    def add(self, preds: DataFrame | None = None, recs: DataFrame | None = None, truth: DataFrame | None = None, k: int = 10, batch: int | None = None, log: list[str] | None = None, n_items: int | None = None) -> bool:
        """Add predictions, lists or both; False if this batch is in already. log names metrics that are written to the log as they now are.

        k is that of the first lists: others cannot be added to them.
        """
        batch = self.batch + 1 if batch is None else batch
        if batch <= self.batch:
            return False
        if recs is not None and self.state.notes.get("k", k) != k:
            raise ValueError(f"the lists of this state are of {self.state.notes['k']}")
        parts = [points(preds)] if preds is not None else []
        parts += [lists(recs, truth, k)] if recs is not None else []
        if not parts:
            raise ValueError("nothing to add")
        with temporary(self.spark):
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            key = F.concat_ws(":", "kind", F.col("u").cast("string"), F.col("score").cast("string"), F.col("item").cast("string"))
            rows = stored(rows.select(key.alias("key"), "*"), "metrics")
            if "metrics" in self.state.tables:
                self.state.merge("metrics", rows, lambda a, b: added(a.unionByName(b)))
            else:
                self.state.put("metrics", "key", added(rows))
            if log:
                lines = self.metrics(log, n_items).select(F.lit(batch).alias("batch"), F.lit(time.time()).alias("at"), "metric", "value")
                lines = stored(lines, "log")
                if "log" in self.state.tables:
                    self.state.merge("log", lines, lambda a, b: a.unionByName(b))
                else:
                    self.state.put("log", "metric", lines)
            self.state.commit(batch=batch, **({"k": k} if recs is not None or "k" in self.state.notes else {}))
        return True

    def log(self) -> DataFrame:
        """(batch, at, metric, value): what add() was asked to log."""
        return self.state.table("log")

    def metrics(self, wanted: list[str], n_items: int | None = None) -> DataFrame:
        """(metric, value) over everything added so far."""
        everything = {*metrics.RATING, *metrics.POINTWISE, *metrics.LISTWISE} - {"loss"}
        if bad := [m for m in wanted if m not in everything]:
            raise ValueError(f"no metrics: {bad}")
        if "coverage" in wanted and n_items is None:
            raise ValueError("coverage needs the number of items")
        rows = self.state.table("metrics")
        of = lambda kind, names: rows.where(F.col("kind") == kind).select("u", F.col("score").alias("pred"), "item", *(F.col(s).alias(c) for s, c in zip(_SUMS, names, strict=False)))
        n, zero = F.col("n"), F.col("n") - F.col("n_one")
        spread = F.col("label2") - F.col("label") * F.col("label") / n
        plain = {
            "rmse": F.sqrt(F.col("error2") / n), "mae": F.col("error") / n, "r2": 1 - F.col("error2") / spread, "log_loss": F.col("loss") / n,
            "balanced_accuracy": (F.col("hit_one") / F.col("n_one") + F.col("hit_zero") / zero) / 2}
        listed = {m: F.col(m) / F.col("users") for m in LIST_SUMS[:-1]}
        found = []
        for kind, names, values in (("points", POINT_SUMS, plain), ("lists", LIST_SUMS, listed)):
            if mine := [m for m in values if m in wanted]:
                found.append(metrics.long_form(of(kind, names).select(*(values[m].alias(m) for m in mine))))
        curves = {"roc_auc": ("score", metrics.roc_auc_of), "pr_auc": ("score", metrics.pr_auc_of), "roc_gauc": ("user_score", metrics.roc_gauc_of)}
        for m, (kind, f) in curves.items():
            if m in wanted:
                counts = of(kind, ("p", "n")).select("u", "pred", F.col("p").cast("long").alias("p"), F.col("n").cast("long").alias("n"))
                found.append(metrics.long_form(f(counts if kind == "user_score" else counts.drop("u"))))
        if "coverage" in wanted:
            found.append(metrics.long_form(of("item", ("times",)).agg((100.0 * F.count(F.lit(1)) / F.lit(n_items)).alias("coverage"))))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out
