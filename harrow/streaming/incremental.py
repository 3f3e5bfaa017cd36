"""Structured Streaming front of the incremental fit: every micro-batch is folded into a model."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from harrow.operators.models import CfModel, Dataset, ExtendableDataset
from harrow.sources.scratch import scratch_path, temporary


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """What tells a checkpoint from any other: batch numbers mean nothing without it."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def fit_stream(
    stream: DataFrame, model: CfModel, checkpoint: str, after: Callable[[CfModel, int], None] | None = None, saves: str | None = None,
    on_other_checkpoint: str = "error", **dataset_options,
) -> StreamingQuery:
    """Start a query over a stream of raw interactions. Each batch extends the ids and
    histories and updates the similarities, all of them in hash partitions in the shared
    folder saves: a batch writes the partitions that it touches, commits them together
    with its number, and leaves nothing else behind.

    After a restart go on with resumed(). The checkpoint may hand its last batch out
    again; a model that has it skips it. A model that holds batches of another checkpoint
    cannot tell what it has already: that is an error, or with on_other_checkpoint
    'refit' it starts anew from what the stream gives, 'fold' takes all of it as new.
    """
    if on_other_checkpoint not in ("error", "refit", "fold"):
        raise ValueError("on_other_checkpoint must be 'error', 'refit' or 'fold'")
    spark = stream.sparkSession
    if model.kept is None:
        model.keep(spark, saves or scratch_path(spark, "model"))
    elif saves and model.kept.path != saves.rstrip("/"):
        raise ValueError(f"the model is kept in {model.kept.path}")

    def fold(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        had, own = (model.stream, model.folded), checkpoint_id(spark, checkpoint)
        if model.stream == own and batch_id <= model.folded:
            return
        fresh = not model.is_fitted
        if model.stream not in (None, own):
            if on_other_checkpoint == "error":
                raise RuntimeError("the model holds batches of another checkpoint: refit it, or say that these are new")
            fresh |= on_other_checkpoint == "refit"
        with temporary(spark):
            state, info = model.state, model.info
            try:
                model.state = None if fresh else model.state
                data = Dataset(**dataset_options) if fresh else ExtendableDataset(model, **dataset_options)
                train = data.build_data(batch)[0]
                model.update_data_info(data.info)
                model.stream, model.folded = own, batch_id
                model.fit(train, neg_sampling=True)
            except BaseException:
                model.kept.discard()
                model.state, model.info, (model.stream, model.folded) = state, info, had
                raise
        if after:
            after(model, batch_id)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumed(spark: SparkSession, kind: type[CfModel], saves: str) -> CfModel | None:
    """The model as of the last batch that was committed to saves, or none."""
    return kind.of_kept(spark, saves)
