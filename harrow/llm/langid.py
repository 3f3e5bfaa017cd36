"""Language identification: known words first, ever shorter character n-grams for the others.

The model is a stored table of every word and every n-gram of ORDERS characters of the
training texts, with its log frequency in each language. A known word scores its log
frequency in every language; an unseen one scores the mean over its longest n-grams of
which any is known. A text's score is the sum over its words. Words are runs of letters,
lower-cased.

Tasks hold the commonest entries as a cache. A word that the cache lacks is looked up in
the table by a join, once however often it occurs, and what is no word there goes
through the n-grams order by order; the texts then take its score by the word's hash. So
the cache changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import _BASE, _INVERSE, SLICE_BYTES, commonest, crc_remainder, materialize, mix, powers, slices

ORDERS = (4, 3, 2, 1)
#: Words, and n-grams of each order, that tasks hold as a cache; no bound of the model.
CACHE_ENTRIES = 100_000
#: A language's texts count with at least this many smoothed occurrences for an entry that it lacks.
SMOOTH = 0.5

_STATE: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _STATE:
        _STATE["letters"] = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)
    return _STATE["letters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        _STATE.update(up=powers(_BASE, size), down=powers(_INVERSE, size))
    return _STATE["up"], _STATE["down"]


class LetterRuns:
    """Words of texts as hashes, and hashes of the n-grams at any place in them."""

    def __init__(self, texts: list):
        lowered = [(t or "").lower() for t in texts]
        self.text = "\n".join(lowered)
        chars = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in lowered], np.int64)
        inside = _letters()[chars]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.total = np.zeros(len(chars) + 1, np.uint64)
        up, self.down = _powers(len(chars) + 1)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(77)) * up[: len(chars)], out=self.total[1:])
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes)]))
        self.hash = self._spans(self.start, self.end)

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64)).view(np.int64)

    def grams(self, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the chosen words, and the index into which of each."""
        count = np.maximum(0, self.end[which] - self.start[which] - order + 1)
        of = np.repeat(np.arange(len(which)), count)
        at = self.start[which][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return self._spans(at, at + order), of


def _counted(docs: DataFrame) -> DataFrame:
    """(kind, lang, h, n) counts of words (kind 0) and n-grams (kind = order), summed over each task first."""

    def run(batches):
        held: dict = {}

        def add(kind, lang, h, n):
            held.setdefault((kind, lang), []).append((h, n))

        def summed(parts):
            h = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            u, back = np.unique(h, return_inverse=True)
            return u, np.bincount(back, n).astype(np.int64)

        for b in slices(batches):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                runs = LetterRuns([texts[i] for i in np.flatnonzero(langs == lang)])
                u, at, n = np.unique(runs.hash, return_index=True, return_counts=True)
                add(0, lang, u, n)
                for order in ORDERS:
                    h, of = runs.grams(at, order)
                    v, back = np.unique(h, return_inverse=True)
                    add(order, lang, v, np.bincount(back, n[of]).astype(np.int64) if len(v) else np.zeros(0, np.int64))
            for key, parts in held.items():
                if len(parts) >= 8:
                    held[key] = [summed(parts)]
        for (kind, lang), parts in held.items():
            h, n = summed(parts)
            for lo in range(0, len(h), 100_000):
                size = len(h[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, kind, np.int32)), pa.array([lang] * size, pa.string()),
                     pa.array(h[lo : lo + size]), pa.array(n[lo : lo + size])], names=["kind", "lang", "h", "n"])

    return docs.mapInArrow(run, "kind int, lang string, h long, n long").groupBy("kind", "lang", "h").agg(F.sum("n").alias("n"))


class Model:
    """langs in order; table (kind, h, all, logs) of all entries (kind 0: words, else the order), stored by kind; keys and logs of the cached ones."""

    def __init__(self, spark: SparkSession, langs: list[str], table: DataFrame, entries: int):
        self.spark, self.langs, self.table = spark, langs, table
        self.cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind in (0, *ORDERS) if langs else ():
            rows = commonest(table.where(F.col("kind") == kind), "all", entries).select("h", "logs").toArrow()
            keys = rows["h"].to_numpy()
            order = np.argsort(keys)
            self.cache[kind] = keys[order], np.asarray(rows["logs"].combine_chunks().flatten(), np.float32).reshape(len(keys), len(langs))[order]


def _cached(cache: dict, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the cache and which of h are there."""
    keys = cache[kind][0]
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def fit(spark: SparkSession, docs: DataFrame, entries: int = CACHE_ENTRIES) -> Model:
    """Counts over all texts of docs(text, lang) with a lang. The driver holds a number per language and kind."""
    counts = materialize(spark, _counted(docs.where("lang is not null").select("text", "lang")), "langid-counts")
    totals = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    each = counts.groupBy("kind", "h").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("of"))
    each = materialize(spark, each, "langid-entries")
    kinds = {r["kind"]: r["count"] for r in each.groupBy("kind").count().collect()}

    def logs(kind: int) -> Column:
        seen = [F.coalesce(F.col("of")[lang], F.lit(0)) + SMOOTH for lang in langs]
        return F.array(*(F.log(n / F.lit(totals.get((kind, lang), 0) + SMOOTH * kinds[kind] + 1.0)).cast("float") for lang, n in zip(langs, seen, strict=True)))

    chosen = F.lit(None).cast("array<float>")
    for kind in kinds:
        chosen = F.when(F.col("kind") == kind, logs(kind)).otherwise(chosen)
    table = materialize(spark, each.select("kind", "h", "all", chosen.alias("logs")), "langid-model")
    return Model(spark, langs, table, entries)


def _mean(column: str, n: int) -> Column:
    return F.array(*(F.avg(F.col(column)[i]) for i in range(n))).cast("array<double>")


def _open_words(model: Model, words: DataFrame) -> DataFrame:
    """(h, logs) for words(h, word) that the cache lacks: from the table, else by n-grams of the longest order that is known. Words without any are left out."""
    spark, n = model.spark, len(model.langs)
    table = model.table.select("kind", F.col("h").alias("key"), "logs")
    found = words.join(table.where("kind = 0"), F.col("h") == F.col("key"), "left").select("h", "word", F.col("logs").cast("array<double>").alias("logs"))
    found = materialize(spark, found, "langid-words")
    out, left = found.where("logs is not null").select("h", "logs"), found.where("logs is null").select("h", "word")
    for order in ORDERS:
        def grams(batches, order=order):
            for b in batches:
                runs = LetterRuns(b.column("word").to_pylist())
                g, of = runs.grams(np.arange(len(runs.start)), order)
                yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(of)), pa.array(g)], names=["h", "key"])

        scored = left.mapInArrow(grams, "h long, key long").join(table.where(F.col("kind") == order), "key")
        scored = materialize(spark, scored.groupBy("h").agg(_mean("logs", n).alias("logs")), "langid-grams")
        out = out.unionAll(scored)
        left = left.join(scored.select("h"), "h", "left_anti")
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text): the likeliest language and its share."""
    spark, n = model.spark, len(model.langs)
    if not model.langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model.cache)

    def run(batches):
        cache = shared.value
        row = TaskContext.get().partitionId() << 36
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            runs = LetterRuns(texts)
            words, first, back = np.unique(runs.hash, return_index=True, return_inverse=True)
            place, known = _cached(cache, 0, words)
            table = np.zeros((len(words), n))
            table[known] = cache[0][1][place[known]]
            sums = np.zeros((len(texts), n))
            for k in range(n):
                total = np.concatenate([[0.0], np.cumsum(table[back, k])])
                sums[:, k] = total[runs.first[1:]] - total[runs.first[:-1]]
            each = row + np.arange(len(texts))
            # A row for every text, then one for every text and word that the cache lacks.
            logs = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(texts) + 1, n, dtype=np.int32)), pa.array(sums.ravel()))
            some = pa.array(np.diff(runs.first) > 0)
            none = pa.nulls(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(each), b.column("doc_id"), some, logs, none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string())], names=MET)
            doc = np.repeat(np.arange(len(texts)), np.diff(runs.first))
            rest = ~known[back]
            pair, times = np.unique(doc[rest] * len(words) + back[rest], return_counts=True)
            word = pair % max(1, len(words))
            names = [runs.text[runs.start[i] : runs.end[i]] for i in first[word].tolist()]
            none = pa.nulls(len(pair))
            yield pa.RecordBatch.from_arrays(
                [pa.array(each[pair // max(1, len(words))]), none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(logs.type), pa.array(words[word]), pa.array(times.astype(np.int64)), pa.array(names, pa.string())], names=MET)
            row += len(texts)

    met = docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, some boolean, logs array<double>, h long, n long, word string")
    met = materialize(spark, met, "langid-texts")
    words = met.where("h is not null").groupBy("h").agg(F.min("word").alias("word"))
    opened = _open_words(model, words)
    gained = met.where("h is not null").select("row", "h", "n").join(opened, "h").groupBy("row").agg(F.array(*(F.sum(F.col("logs")[i] * F.col("n")) for i in range(n))).alias("more"))
    both = met.where("h is null").select("row", "doc_id", "some", "logs").join(gained, "row", "left")
    total = F.when(F.col("more").isNull(), F.col("logs")).otherwise(F.zip_with("logs", "more", lambda a, b: a + b))
    both = both.select("doc_id", "some", total.alias("total")).withColumn("top", F.array_max("total"))
    share = 1.0 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    name = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", F.col("top")).cast("int"))
    return both.select("doc_id", F.when(F.col("some"), name).otherwise("und").alias("lang_pred"), F.when(F.col("some"), share).otherwise(0.0).alias("score"))


MET = ["row", "doc_id", "some", "logs", "h", "n", "word"]


def identify(spark: SparkSession, docs: DataFrame, entries: int = CACHE_ENTRIES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang, ...).

    Learns from rows that have a lang and are not held out (crc32(doc_id as text) mod 3
    = 1). Equal scores go to the language that sorts first. A text that is null or has
    no letter is 'und' with score 0, as is everything if no row has a lang. A null
    doc_id is held out of nothing. Other columns are ignored. entries bounds the cache
    of the tasks only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(spark, docs.where(~held), entries)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
