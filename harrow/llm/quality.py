"""Quality scores by Bradley-Terry ranking of preference pairs.

Each labelled pair (better, worse) says that one text should score above another.
The score is linear in features of the text; the weights minimise the logistic loss
on the feature differences of the pairs. A quantile of the scores of the labelled
texts is the threshold, and the score is shifted so that it lies at CUT.

All labelled texts teach. Texts of both labels are dealt into blocks, and a block's pairs
are all of its good texts with all of its bad ones: the pairs grow with the labels, not
with their square. Each step of the fit is a Spark job that sums over the blocks; what
comes to the driver is a gradient and a Hessian of each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import Words, crc_remainder, held, materialize, mix, rows_of_lists, slices, small, utf8_parts

#: Texts of the commoner label in a block, on average, and of the rarer one at least, if there are so many.
COMMONER, RARER = 1024, 128
#: What a task is handed of the blocks at once; cells of a score of one when the threshold is looked for.
BATCH, CELLS = "8m", 1024
CUT = 0.3

#: Features, in order.
NAMES = (
    "log_words", "word_length", "upper", "digit", "symbol", "pipe", "bang", "period", "comma", "other_punctuation", "non_ascii",
    "distinct_words", "distinct_pairs", "repeated_neighbours", "repeated_lines", "log_lines", "long_words", "short_words",
    "upper_words", "symbol_words", "no_lower", "top_word",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*@^~<>{}[]\\_=+`/", "pipe": b"|", "bang": b"!?",
    "period": b".", "comma": b",", "other_punctuation": b"-:;'\"()", "lower": b"abcdefghijklmnopqrstuvwxyz",
}


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def _distinct(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct keys each document's stretch has, and how often its commonest occurs."""
    kinds, top = np.zeros(len(start)), np.zeros(len(start))
    for d, (lo, hi) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        if hi > lo:
            k = np.sort(keys[lo:hi])
            new = np.flatnonzero(k[1:] != k[:-1])
            kinds[d] = len(new) + 1
            top[d] = np.diff(new, prepend=-1, append=hi - lo - 1).max()
    return kinds, top


def features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text; empty and null texts have a row of zeros."""
    raw, offsets = utf8_parts(texts)
    words = Words(texts)
    n, doc, first = len(texts), words.doc, words.first
    size = np.maximum(1.0, np.diff(offsets))
    count = np.diff(first).astype(float)
    per_word = np.maximum(1.0, count)
    f = {"log_words": np.log1p(count)}
    lengths = (words.end - words.start).astype(float)
    f["word_length"] = _sums(lengths, first) / per_word / 10
    table = np.zeros((len(_CLASSES), 256), bool)
    for row, (name, chars) in enumerate(_CLASSES.items()):
        table[row, list(chars)] = True
        marks = table[row][raw]
        f[name] = _sums(marks, offsets) / size
        if name in ("upper", "symbol", "lower"):
            total = np.concatenate([[0], np.cumsum(marks)])
            f[f"{name}_in"] = total[words.end] - total[words.start]
    f["non_ascii"] = _sums(raw > 127, offsets) / size
    upper, symbol, lower = f.pop("upper_in"), f.pop("symbol_in"), f.pop("lower_in")
    f["upper_words"] = _sums((upper > 1) & (lower == 0), first) / per_word
    f["symbol_words"] = _sums(symbol > 0, first) / per_word
    f["no_lower"] = _sums(lower == 0, first) / per_word
    f["long_words"] = _sums(lengths > 12, first) / per_word
    f["short_words"] = _sums(lengths < 4, first) / per_word
    kinds, top = _distinct(words.hash, first[:-1], first[1:])
    f["distinct_words"], f["top_word"] = kinds / per_word, top / per_word
    h = words.hash
    same_doc = doc[1:] == doc[:-1]
    kinds, _ = _distinct(mix(h[1:] * np.uint64(3) + h[:-1]), first[:-1], first[1:] - 1)
    f["distinct_pairs"] = kinds / np.maximum(1.0, count - 1)
    f["repeated_neighbours"] = np.bincount(doc[1:][same_doc & (h[1:] == h[:-1])], minlength=n) / per_word
    # Lines: runs of bytes between newlines, compared by the sum of their words' hashes.
    ends = np.concatenate([[0], np.cumsum(raw == 10)])
    line = ends[words.start]
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | ~same_doc])) if len(h) else np.zeros(0, int)
    if len(new):
        keys, of = np.add.reduceat(h, new), doc[new]
        lines = np.bincount(of, minlength=n).astype(float)
        edges = np.searchsorted(of, np.arange(n + 1))
        kinds, _ = _distinct(keys, edges[:-1], edges[1:])
        f["repeated_lines"] = (lines - kinds) / np.maximum(1.0, lines)
    else:
        lines = f["repeated_lines"] = np.zeros(n)
    f["log_lines"] = np.log1p(lines)
    out = np.stack([f[name] for name in NAMES], axis=1)
    out[count == 0] = 0
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, features): NAMES of every text."""

    def run(batches):
        held("features", tuple)  # keeps nothing, lets go of other stages' tables
        for b in slices(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), rows_of_lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], names=["doc_id", "features"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, features array<double>")


def _expand(x: np.ndarray) -> np.ndarray:
    """Linear, square-root and square terms."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


class Ranker:
    """Weights on standardised features, the threshold and the shift; plain arrays, so it travels with a closure.

    Ranker(x, y) learns from arrays that are one block; fit() from a table.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        good, bad = x[y == 1], x[y == 0]
        self._learn(
            len(good), len(bad), lambda: _moments(x), lambda w: _pair_sums(self.standard(good), self.standard(bad), w),
            lambda: _cells(self.raw(x), y))

    def _learn(self, good: int, bad: int, moments, pair_sums, cells, ridge: float = 1e-3) -> None:
        """From the numbers of texts, (n, mean, squared deviations), sums over the pairs by weights, and (cell, good, bad) of the scores."""
        width = 3 * len(NAMES)
        self.mean, self.scale, self.weights, self.threshold = np.zeros(width), np.ones(width), np.zeros(width), 0.0
        if not good or not bad:
            self.threshold = -1.0  # one label only: nothing to tell apart, all texts pass
            return
        n, self.mean, squares = moments()
        self.scale = np.sqrt(squares / n) + 1e-6
        self.weights = _newton(pair_sums, width, ridge)
        self.threshold = _threshold(*cells())

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (_expand(x) - self.mean) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -40, 40)))


def _moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    z = _expand(x)
    mean = z.mean(axis=0)
    return len(z), mean, ((z - mean) ** 2).sum(axis=0)


def _merged(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)


def _pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over all pairs of a good row and a bad one: their number, then the sums of the logistic loss's gradient and Hessian."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - bad @ w, -40, 40)))
    gradient = bad.T @ p.sum(axis=0) - good.T @ p.sum(axis=1)
    k = p * (1 - p)
    across = good.T @ (k @ bad)
    hessian = (good.T * k.sum(axis=1)) @ good + (bad.T * k.sum(axis=0)) @ bad - across - across.T
    return np.concatenate([[p.size], gradient, hessian.ravel()])


def _newton(sums, width: int, ridge: float, steps: int = 60) -> np.ndarray:
    """Newton's method for the mean loss of the pairs + ridge |w|^2 / 2."""
    w = np.zeros(width)
    for _ in range(steps):
        n, gradient, hessian = np.split(sums(w), [1, 1 + width])
        step = np.linalg.solve(hessian.reshape(width, width) / n + ridge * np.eye(width), gradient / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(d: np.ndarray, ridge: float) -> np.ndarray:
    """The least of mean(log(1 + exp(-d w))) + ridge |w|^2 / 2."""
    return _newton(lambda w: _pair_sums(d, np.zeros((1, d.shape[1])), w), d.shape[1], ridge)


def _cells(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, good, bad): how many texts of each label have scores in each cell of width 1 / CELLS; the outermost hold the rest."""
    cell, back = np.unique(np.floor(np.clip(raw, -40, 40) * CELLS).astype(np.int64), return_inverse=True)
    return cell, np.bincount(back, y == 1), np.bincount(back, y == 0)


def _threshold(cell: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The quantile, between two cells that hold scores, that tells the labels apart best; the middle one of equals."""
    if len(cell) == 1:
        return cell[0] / CELLS
    right = np.cumsum(bad)[:-1] + good.sum() - np.cumsum(good)[:-1]
    best = np.flatnonzero(right == right.max())
    at = best[len(best) // 2]
    return (cell[at] + 1 + cell[at + 1]) / 2 / CELLS


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), len(NAMES))


def blocks(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(good, bad): the features of the texts of each block of rows(doc_id, quality, features), which has so many of each.

    Every text of the commoner label is in one block, every text of the rarer one in one or more.
    """
    rarer = int(good < bad)
    n = -(-max(good, bad) // COMMONER)
    parts = max(1, min(n, min(good, bad) // RARER))  # of the rarer label; each goes to every so-many-th block
    at = F.xxhash64("doc_id")
    to = F.when(F.col("quality") == rarer, F.sequence(F.pmod(at, F.lit(parts)), F.lit(n - 1).cast("long"), F.lit(parts).cast("long"))).otherwise(F.array(F.pmod(at, F.lit(n))))
    dealt = rows.select(F.explode(to).alias("block"), "quality", "features")
    return dealt.groupBy("block").agg(*(F.collect_list(F.when(F.col("quality") == q, F.col("features"))).alias(name) for name, q in (("good", 1), ("bad", 0)))).drop("block")


def fit(spark: SparkSession, rows: DataFrame) -> Ranker:
    """A Ranker of all of rows(doc_id, quality 0 or 1, features), one row per doc_id."""
    ranker = Ranker(np.zeros((0, len(NAMES))), np.zeros(0))
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    table = materialize(spark, blocks(rows, good, bad), "quality-blocks") if good and bad else None

    def moments():
        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    some = _moments(_matrix(b.column("features")))
                    total = _merged(total, some) if total else some
            if total:
                yield pa.RecordBatch.from_pydict({"n": [total[0]], "mean": [total[1]], "squares": [total[2]]})

        total = None
        for r in rows.select("features").mapInArrow(run, "n long, mean array<double>, squares array<double>").collect():
            some = r["n"], np.array(r["mean"]), np.array(r["squares"])
            total = _merged(total, some) if total else some
        return total

    def pair_sums(w):
        def run(batches):
            total = 0
            for b in batches:
                for k in range(b.num_rows):
                    sides = [ranker.standard(_matrix(b.column(name)[k].values)) for name in ("good", "bad")]
                    total = total + _pair_sums(*sides, w)
            if np.ndim(total):
                yield pa.RecordBatch.from_pydict({"sums": [total]})

        return sum(np.array(r["sums"]) for r in table.mapInArrow(run, "sums array<double>").collect())

    def cells():
        def run(batches):
            for b in batches:
                cell, *sides = _cells(ranker.raw(_matrix(b.column("features"))), np.asarray(b.column("quality")))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(x.astype(np.int64)) for x in sides)], names=["cell", "good", "bad"])

        found = rows.select("quality", "features").mapInArrow(run, "cell long, good long, bad long")
        found = found.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas().sort_values("cell")
        return tuple(found[c].to_numpy() for c in ("cell", "good", "bad"))

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, BATCH)
    try:
        ranker._learn(good, bad, moments, pair_sums, cells)
    finally:
        spark.conf.set(size, before)
    return ranker


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    Learns from all labels(doc_id, quality, ...) of documents that are not held out, that
    is crc32(doc_id as text) mod 5 <> 0. predicted is 1 where score >= 0.3.

    Null and empty texts have zero features and are scored by them; a null doc_id is
    not held out. Null ids and labels do not teach, nor do ids whose labels differ; equal label rows
    count once. Without
    both labels every score is above the cut. Other columns are ignored.
    """
    table = materialize(spark, feature_table(docs), "quality-features")
    taught = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & (crc_remainder("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    )
    taught = materialize(spark, taught, "quality-labels")
    # Of rows that share an id the one of the smallest features teaches.
    rows = table.join(small(taught, 16), "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
    ranker = fit(spark, materialize(spark, rows, "quality-taught"))

    def run(batches):
        for b in batches:
            x = _matrix(b.column("features"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ranker.score(x))], names=["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    verdicts = classify(spark, docs, labels)
    rejected = verdicts.where((F.col("predicted") == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(materialize(spark, rejected, "quality-rejected"), "doc_id", "left_anti").select(*docs.columns)


