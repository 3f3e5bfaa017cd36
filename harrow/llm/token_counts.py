"""Token counts of texts without their token ids.

No piece of the vocabulary holds a space after anything but spaces, or a newline, so a
text falls apart into pre-tokens that are encoded alone: a word with the spaces before
it, spaces that no word follows, and newlines. Pieces are counted once per distinct
pre-token: the commonest get a bounded table that is sent to the tasks, which join it
to the pre-token frequencies of each document; the frequencies of all others are dealt
out and sorted by pre-token, joined to the count of its pieces there, and summed by
document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import Spans, commonest, materialize, mix, slices

#: Entries of the table of common pre-tokens at most; 12 bytes each.
COMMON = 400_000
#: A pre-token that no task meets this often is not a candidate for the table.
OFTEN = 3

_META = "▁"


class PreTokens:
    """The pre-tokens of a slice of texts, as stretches of buf with a key each; newlines are counted apart."""

    def __init__(self, texts: list):
        texts = [t or "" for t in texts]
        self.n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
        self.newlines = np.array([t.count("\n") for t in texts], np.int64)
        # Every text gets a space in front, as the library does; the sign for a space is a space.
        parts = [(" " + t.replace(_META, " ")).encode() if t else b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join(parts), np.uint8)
        inside, space = self.buf != 0x0A, self.buf == 0x20
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (space[1:] & ~space[:-1])
        stops = np.flatnonzero(begins | ~inside)
        self.start = np.flatnonzero(begins)
        self.end = np.append(stops, len(self.buf))[np.searchsorted(stops, self.start, "right")]
        self.key = Spans(self.buf)(self.start, self.end).view(np.int64)
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]))

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode()


_LOADED: dict = {}


def pieces_of(model_path: str, words: list[str]) -> list[int]:
    """How many pieces each pre-token has. The library puts a space before every text: a
    pre-token gives it one, or stands behind a newline, which is two pieces with that space."""
    if model_path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if _META in piece.lstrip(_META) or ("\n" in piece and piece != "\n"):
                raise ValueError(f"a piece of this vocabulary goes over the end of a pre-token: {piece!r}")
        _LOADED[model_path] = model
    coded = _LOADED[model_path].encode([w[1:] if w[0] == " " else "\n" + w for w in words], num_threads=1)
    return [1 if w == " " else len(c) if w[0] == " " else len(c) - 2 for w, c in zip(words, coded, strict=True)]


def _frequencies(docs: DataFrame, often: int) -> DataFrame:
    """(key, word, n): how often the pre-tokens occur that some task meets often times."""

    def run(batches):
        keys, counts, words = np.zeros(0, np.int64), np.zeros(0, np.int64), {}
        for b in slices(batches):
            t = PreTokens(b.column("text").to_pylist())
            u, at, n = np.unique(t.key, return_index=True, return_counts=True)
            for i in np.flatnonzero(n >= often):
                if (k := int(u[i])) not in words:
                    words[k] = t.text(at[i])
            both = np.concatenate([keys, u])
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        hit = [i for i in np.flatnonzero(counts >= often) if int(keys[i]) in words]
        for lo in range(0, len(hit), 50_000):
            part = hit[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part]), pa.array([words[int(keys[i])] for i in part], pa.string()), pa.array(counts[part])], names=["key", "word", "n"])

    return docs.select("text").mapInArrow(run, "key long, word string, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


def _common_pieces(spark: SparkSession, docs: DataFrame, model_path: str, common: int, often: int):
    """Sorted keys and piece counts of the commonest pre-tokens, each counted once, as a broadcast."""
    table = materialize(spark, _frequencies(docs, often), "tc-frequencies")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(pieces_of(model_path, b.column("word").to_pylist()), pa.int64())], names=["key", "pieces"])

    rows = commonest(table, "n", common).select("key", "word").mapInArrow(run, "key long, pieces long").toPandas().drop_duplicates("key").sort_values("key")
    return spark.sparkContext.broadcast((rows["key"].to_numpy(np.int64), rows["pieces"].to_numpy(np.int32)))


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str, limit: int = 4096, common: int = COMMON, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text, ...).

    n_tokens is what the sentencepiece library at model_path gives for the whole text
    without added tokens; over_limit says n_tokens > limit.

    A null text is an empty one: no bytes, no tokens. Rows may repeat and lack an id;
    every row is answered. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = _common_pieces(spark, docs, model_path, common, often)

    def run(batches):
        keys, pieces = shared.value
        row = TaskContext.get().partitionId() << 36
        for b in slices(batches):
            t = PreTokens(b.column("text").to_pylist())
            n = b.num_rows
            place = np.minimum(np.searchsorted(keys, t.key), max(0, len(keys) - 1))
            known = keys[place] == t.key if len(keys) else np.zeros(len(t.key), bool)
            doc = np.repeat(np.arange(n), np.diff(t.first))
            tokens = t.newlines + np.bincount(doc[known], pieces[place[known]] if len(keys) else None, minlength=n).astype(np.int64)
            # The others, once for each text, with their frequencies in it.
            rest = np.flatnonzero(~known)
            _, at, times = np.unique(mix(doc[rest].astype(np.uint64)) ^ t.key[rest].view(np.uint64), return_index=True, return_counts=True)
            order = np.argsort(doc[rest][at], kind="stable")
            at, times = rest[at[order]], times[order]
            first = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=n))])
            words = pa.StructArray.from_arrays([pa.array([t.text(i) for i in at], pa.string()), pa.array(times.astype(np.int64))], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), b.column("doc_id"), pa.array(t.n_bytes), pa.array(tokens), lists], names=["row", "doc_id", "n_bytes", "tokens", "rest"])
            row += n

    counted = materialize(spark, docs.mapInArrow(run, "row long, doc_id long, n_bytes long, tokens long, rest array<struct<word:string,n:long>>"), "tc-documents")

    def rest_pieces(batches):
        # Equal words come one after the other: each is counted once.
        last, last_pieces = None, 0
        for b in batches:
            words = b.column("word").dictionary_encode()
            names = words.dictionary.to_pylist()
            new = [w for w in names if w != last]
            pieces = dict(zip(new, pieces_of(model_path, new), strict=True)) | ({last: last_pieces} if last is not None else {})
            if names:
                last = words[len(words) - 1].as_py()
                last_pieces = pieces[last]
            counts = np.array([pieces[w] for w in names], np.int64)[words.indices.to_numpy()] if names else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(counts * b.column("n").to_numpy())], names=["row", "more"])

    each = counted.select("row", F.explode("rest").alias("of")).select("row", "of.word", "of.n")
    more = each.repartition("word").sortWithinPartitions("word").mapInArrow(rest_pieces, "row long, more long").groupBy("row").agg(F.sum("more").alias("more"))
    total = F.col("tokens") + F.coalesce("more", F.lit(0))
    return counted.drop("rest").join(more, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
