"""Token ids of a corpus as ORC files in ascending doc_id order.

Texts are dealt out by ranges of doc_id, encoded, and written with integer run-length
encoding, row indexes and a Bloom filter on doc_id, so readers work stripe by stripe
and skip what a filter on doc_id rules out. A text falls apart into pre-tokens that the
library encodes alone; a worker encodes each one that it meets once and puts the ids of
a document together from those.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.llm.common import materialize, mix, rows_of_lists, slices
from harrow.sources.scratch import scratch_path

END_ID = 1
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1_200_000
#: New pre-tokens that go to the library in one call.
TOGETHER = 1_000
#: Row group size of the index, and the stripe size in bytes.
INDEX_STRIDE, STRIPE_BYTES = 1_000, 32 << 20

_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: What the last token of every pre-token ends with in the vocabulary.
_WORD_END = "</w>"
#: Stands behind every text of a slice; no byte of UTF-8.
_STOP = b"\xff"
#: Classes of bytes; from _DIGIT on, each stands alone. Bytes of Latin-1 letters count as letters.
_SPACE, _LETTER, _OTHER, _QUOTE, _DIGIT, _END = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 255)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _QUOTE
_CLASS[255] = _END
_CLASS = _CLASS.tobytes()
#: The bytes of a number that n bytes, at most eight, fill.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of raw; equal bytes have equal hashes in one process."""
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    size = end - start
    found = eight[start] & _FILLED[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    found[long] = mix(found[long]) ^ eight[end[long] - 8]
    found = mix(found + size.astype(np.uint64) * _ODD)
    for i in long[size[long] > 16].tolist():
        found[i] = hash(raw[start[i] : end[i]]) & 0xFFFFFFFFFFFFFFFF
    return found


class Seen:
    """The ids of the pre-tokens met so far, found by their hashes in an open table: a probe or two for each."""

    def __init__(self, room: int):
        self.room, self.n, self.used = room, 0, 0
        self.keys = np.zeros(room, np.uint64)
        self.mask = np.uint64((1 << (3 * room).bit_length()) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        self.starts, self.sizes, self.flat = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(4 * room, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their places; -1 where they are not."""
        at = self.table[hashes & self.mask]
        left = np.flatnonzero((at >= 0) & (self.keys[at] != hashes))
        slot = hashes[left] & self.mask
        while len(left):
            slot = (slot + np.uint64(1)) & self.mask
            at[left] = now = self.table[slot]
            on = (now >= 0) & (self.keys[now] != hashes[left])
            left, slot = left[on], slot[on]
        return at

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Hashes that are not there yet, each once, and their ids, flat."""
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(self.n, self.n + len(hashes))
        self.keys[at], self.sizes[at], self.starts[at] = hashes, sizes, self.used + np.cumsum(sizes) - sizes
        left, slot = np.arange(at.start, at.stop, dtype=np.int32), hashes & self.mask
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several one stays
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + np.uint64(1)) & self.mask
        self.used, self.n = self.used + len(ids), at.stop

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens at these places, flat, and where each one's end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        shift = self.starts[at]
        shift += sizes
        shift -= ends
        where = np.repeat(shift, sizes)
        where += np.arange(len(where))
        return self.flat[where], ends


class Encoder:
    """The tokenizer of one worker and the ids of the pre-tokens it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self._forget(0)

    def _forget(self, coming: int) -> None:
        self.seen = Seen(max(REMEMBERED, coming) + 1)
        self.seen.add(_hashes(_STOP, np.array([0]), np.array([1])), np.array([END_ID]), np.array([1]))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, flat, and how many each has.

        White space parts pre-tokens and has no ids, so they are encoded as one text and
        told apart by the tokens that end one; pre-tokens that this does not fit go one by one.
        """
        flat = np.asarray(self._library([" ".join(texts)])[0], np.int32)
        sizes = np.diff(np.flatnonzero(self.ends_word[flat]), prepend=-1)
        if len(sizes) == len(texts) and sizes.sum() == len(flat):
            return flat, sizes
        ids = self._library(texts)
        return np.array([i for x in ids for i in x], np.int32), np.array([len(i) for i in ids], np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        quoted = np.array(["'" in t for t in texts])  # may be more than one pre-token
        for which in (False, True):
            k = np.flatnonzero(quoted == which)
            for lo in range(0, len(k), TOGETHER):
                some = k[lo : lo + TOGETHER]
                self.seen.add(hashes[some], *self._each([texts[i] for i in some.tolist()]))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each text's, and where each text's begin."""
        raw = [(t or "").encode() for t in texts]
        joined = _STOP.join([*raw, b""])
        whole = _not_latin(joined, raw)
        if b"<|" in joined:
            whole |= {i for i, r in enumerate(raw) if any(s in r for s in _SPECIAL)}
        for i in whole:
            raw[i] = b""
        flat, first = self._assembled(_STOP.join([*raw, b""]) if whole else joined)
        if whole:
            parts = np.split(flat, first[1:-1])
            for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
                parts[i] = np.array([*ids, END_ID], np.int32)
            flat, first = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return flat, first

    def _assembled(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = joined.lower()
        buf = np.frombuffer(raw, np.uint8)
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1  # capitals of Latin-1: two bytes, 32 apart
        second = second[(buf[second] >= 0x80) & (buf[second] <= 0x9E)]
        if len(second):
            buf = buf.copy()
            buf[second] += 0x20
            raw = buf.tobytes()
        kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
        inside = kind != _SPACE
        begins = kind >= _DIGIT
        begins[:1] = True
        begins[1:] |= kind[1:] != kind[:-1]
        begins &= inside
        # A stretch between white space that has an apostrophe is left whole: it may be a contraction.
        if b"'" in raw:
            chunk = kind == _END
            chunk[:1] = True
            chunk[1:] |= (kind[:-1] == _SPACE) | (kind[:-1] == _END)
            chunk &= inside
            number = np.cumsum(chunk)
            quoted = np.zeros(number[-1] + 1, bool)
            quoted[number[kind == _QUOTE]] = True
            begins &= chunk | ~quoted[number]
        last = inside.copy()
        last[:-1] &= begins[1:] | ~inside[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(last) + 1
        at = self._places(raw, start, end)
        ids, ends = self.seen.ids(at)
        return ids, np.concatenate([[0], ends[kind[start] == _END]])

    def _places(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = _hashes(raw, start, end)
        at = self.seen.find(hashes)
        lost = np.flatnonzero(at < 0)
        if not len(lost):
            return at
        new, first = np.unique(hashes[lost], return_index=True)
        if self.seen.n + len(new) > self.seen.room:
            lost = np.flatnonzero(at)  # all but the ends of texts, whose place stays 0
            new, first = np.unique(hashes[lost], return_index=True)
            self._forget(len(new))
        spans = zip(start[lost[first]].tolist(), end[lost[first]].tolist(), strict=True)
        self._learn(new, [raw[lo:hi].decode() for lo, hi in spans])
        at[lost] = self.seen.find(hashes[lost])
        return at


def _not_latin(joined: bytes, texts: list[bytes]) -> set[int]:
    """Which texts have characters beyond ASCII that are no letters of Latin-1, U+00C0 to U+00FF."""
    buf = np.frombuffer(joined, np.uint8)
    high = np.flatnonzero(buf >= 0x80)
    byte, before = buf[high], buf[high - 1]
    letter = (byte == 0xC3) | (byte == 0xFF) | (byte < 0xC0) & (before == 0xC3) & (byte != 0x97) & (byte != 0xB7)
    if letter.all():
        return set()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return set(np.searchsorted(ends, high[~letter], "right").tolist())


_LOADED: dict[str, Encoder] = {}


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Write (doc_id, ids) for every row of docs(doc_id, text, ...) as ORC under path.

    Ascending doc_id over the files, null ids first; END_ID ends every document. A null
    text is an empty one and has only that. Rows may repeat; those of one doc_id stand
    together. Other columns are ignored; an empty table gives empty files.
    """

    def run(batches):
        encoder = _LOADED.get(tokenizer_path) or _LOADED.setdefault(tokenizer_path, Encoder(tokenizer_path))
        for b in slices(batches):
            flat, first = encoder.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows_of_lists(flat, first)], names=["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id long, ids array<int>")
    options = {
        "orc.compress": "ZSTD", "orc.row.index.stride": INDEX_STRIDE, "orc.stripe.size": STRIPE_BYTES,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01,
    }
    coded.write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the files; a filter on doc_id reaches row indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    start counts the ids of all documents before it; ids_crc32 is the unsigned crc32 of
    its ids as little-endian 32-bit integers. Rows that repeat a doc_id take their
    places by length, then crc.
    """

    def sums(batches):
        for b in batches:
            ids = b.column("ids")
            first = np.asarray(ids.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(ids.values, np.int32))).cast("B")
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "ids_crc32"])

    def running(batches):
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(b.column("n_tokens"))
            before = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before), pa.array(np.full(len(n), part, np.int64))], names=[*b.schema.names, "before", "part"])

    read = materialize(spark, read_ids(spark, path).mapInArrow(sums, "doc_id long, n_tokens long, ids_crc32 long"), "ids-read")
    ordered = read.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids_crc32")
    placed = materialize(spark, ordered.mapInArrow(running, "doc_id long, n_tokens long, ids_crc32 long, before long, part long"), "ids-placed")
    # One row per partition: small whatever the corpus.
    parts = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return placed.join(F.broadcast(parts), "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(spark, docs, tokenizer_path, path)
    return layout(spark, path)
