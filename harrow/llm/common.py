"""Shared parts of the corpus operators: scratch tables, components, word hashing."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.sources.scratch import stored

#: A side is broadcast only if its counted rows stay below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Python tasks work through their Arrow batches in slices of about this much text.
SLICE_BYTES = 1 << 20


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return stored(df, name)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted size allows one, df itself otherwise (Spark then shuffles)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_remainder(col: str, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo n; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def commonest(counts: DataFrame, n: str, entries: int) -> DataFrame:
    """The rows of largest n, at most entries of them: whole frequency classes, 16 to an octave, so no ties are cut."""
    octave = F.floor(F.log2(n) * 16)
    total, cut = 0, None
    for row in counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("o")).collect():
        total += row["k"]
        if total > entries:
            break
        cut = row["o"]
    return counts.where(octave >= cut) if cut is not None else counts.limit(0)


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Every node points to its smallest neighbour, if that is smaller. Pointers are
    followed to the roots by jumping, which doubles the way each time, so long chains
    take a logarithm of their length. Then roots take the place of their nodes in the
    edges, and what is left of these goes through the same again: every root that still
    has a neighbour meets a smaller one or is met. Every step is a written table. Self
    loops and repeated edges are harmless; edges with a null end are ignored; no edges
    give no rows.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = materialize(spark, both.union(both.select("dst", "src")).distinct(), "cc-edges")
    labels = None
    while True:
        up = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("low"))
        up = materialize(spark, up, "cc-pointers")
        while True:
            over = up.select(F.col("node").alias("low"), F.col("low").alias("lower"))
            nxt = materialize(spark, up.join(over, "low").select("node", F.col("lower").alias("low"), (F.col("lower") < F.col("low")).alias("moved")), "cc-pointers")
            up = nxt.select("node", "low")
            if nxt.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("low").alias("component"))
        else:
            above = up.select(F.col("node").alias("component"), "low")
            labels = materialize(spark, labels.join(above, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "cc-labels")
        ends = [up.select(F.col("node").alias(end), F.col("low").alias(f"low_{end}")) for end in ("src", "dst")]
        both = both.join(ends[0], "src").join(ends[1], "dst").where("low_src <> low_dst").select(F.col("low_src").alias("src"), F.col("low_dst").alias("dst")).distinct()
        both = materialize(spark, both, "cc-edges")
        if both.isEmpty():
            return labels


# ---------------------------------------------------------------- Python workers

_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps from task to task: the last thing asked for, made once.

    Workers outlive the stages of a pipeline; what an earlier stage kept goes, so that
    the tables of several stages never lie in one worker together.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back(collect: bool = True) -> None:
    """Hand memory that nothing holds any more back to the system: workers live on between tasks and stages.

    collect looks for cycles first, which walks through all that the worker has loaded.
    """
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not this C library
    _TRIM = None


# ---------------------------------------------------------------- words in numpy

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: ASCII white space: what separates words in all contracts, [\x20\x09-\x0D].
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        _POWERS.update(up=powers(_BASE, size), down=powers(_INVERSE, size))
    return _POWERS["up"], _POWERS["down"]


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one buffer and the n + 1 offsets; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count or not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Spans:
    """64-bit hashes of any stretches of a buffer: equal bytes have equal hashes."""

    def __init__(self, buf: np.ndarray):
        up, self._down = _power_table(len(buf) + 1)
        self._total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self._total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(np.uint64))


class Words:
    """The white-space separated words of a slice of texts, lower-cased A-Z, as 64-bit hashes.

    hash, start, end, doc have one entry per word; first is where each document's
    words begin (n + 1 entries); buf is the lower-cased buffer.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        raw, self.offsets = utf8_parts(texts)
        self.buf = np.frombuffer(raw.tobytes().lower(), np.uint8) if lower else raw
        n = len(self.buf)
        inside = _IS_WORD[self.buf]
        begins, ends = inside.copy(), inside.copy()
        if n:
            edges = np.unique(self.offsets)
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            at = edges[edges < n]
            begins[at] = inside[at]
            at = edges[edges > 0] - 1
            ends[at] = inside[at]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.spans = Spans(self.buf)
        self.hash = self.spans(self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that Words gives these words."""
    return Words(pa.array([" ".join(words)])).hash


def slices(batches, limit: int = SLICE_BYTES, text: str = "text", collect: bool = True):
    """The record batches cut so that the texts of a piece hold about limit bytes, or one text; collect as in give_back."""
    for batch in batches:
        sizes = np.array(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        at, n = 0, batch.num_rows
        ends = np.cumsum(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        give_back(collect)


def rows_of_lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list array whose row i is flat[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
