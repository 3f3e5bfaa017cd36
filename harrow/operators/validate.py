"""Checks of columns, labels and options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_data_cols(data: DataFrame, user_col: str, item_col: str, label_col: str | None, multi_label_cols: list[str] | None) -> None:
    for c in (user_col, item_col):
        if c not in data.columns:
            raise ValueError(f"no column {c!r}")
    if not label_col and not multi_label_cols:
        raise ValueError("a label column or multi-label columns are needed")
    if label_col and label_col not in data.columns:
        raise ValueError(f"no column {label_col!r}")
    if multi_label_cols is not None:
        if not isinstance(multi_label_cols, list) or len(multi_label_cols) < 2:
            raise ValueError("multi-label columns must be a list of two or more")
        if missing := [c for c in multi_label_cols if c not in data.columns]:
            raise ValueError(f"no columns {missing}")


def check_ids(data: DataFrame, user_col: str, item_col: str) -> None:
    if not data.where(F.col(user_col).isNull() | F.col(item_col).isNull()).isEmpty():
        raise ValueError("null users or items")


def check_labels(data: DataFrame, task: str, neg_sampling: bool, label: str = "label") -> None:
    """Ranking without negative sampling needs the labels 0 and 1, both there."""
    if task == "ranking" and not neg_sampling:
        got = data.agg(F.count_distinct(label).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")).first()
        if (got["n"], got["lo"], got["hi"]) != (2, 0, 1):
            raise ValueError("ranking without negative sampling needs labels 0 and 1")


def check_multi_labels(data: DataFrame, task: str, neg_sampling: bool, labels: str = "labels") -> None:
    if task != "ranking":
        return
    all_binary = F.bool_and(F.forall(labels, lambda x: x.isin(0, 1)))
    some = F.bool_and(F.exists(labels, lambda x: x == 1))
    both = F.bool_or(F.exists(labels, lambda x: x == 0)) & F.bool_or(F.exists(labels, lambda x: x == 1))
    got = data.agg(all_binary.alias("binary"), some.alias("some"), both.alias("both")).first()
    if not got["binary"] or (neg_sampling and not got["some"]) or (not neg_sampling and not got["both"]):
        raise ValueError("multi-labels must be 0 or 1, with a positive in every row if negatives are sampled")


def check_feat_cols(user_col: str, item_col: str, *feature_cols) -> None:
    named = {c for cols in feature_cols if cols for c in cols}
    if clash := named & {user_col, item_col}:
        raise ValueError(f"id columns can't be features: {sorted(clash)}")


def check_feat_data(user_data, item_data, user_cols, item_cols) -> None:
    if (user_cols and user_data is None) or (item_cols and item_data is None):
        raise ValueError("feature columns without a feature table")


def check_lr_scheduler_config(scheduler: str | None, config: dict | None) -> None:
    needs = {"step": {"step_size"}, "exponential": {"gamma"}, "cosine": {"T_max"}, "plateau": set()}
    if scheduler is None:
        return
    if scheduler not in needs:
        raise ValueError(f"unknown scheduler {scheduler!r}")
    if missing := needs[scheduler] - set(config or {}):
        raise ValueError(f"{scheduler} needs {sorted(missing)}")
