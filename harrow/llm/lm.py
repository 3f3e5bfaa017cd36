"""Katz backoff language model of order three over all words.

Events are the words of the training texts, the end of a text, and one event for words
that they lack. A token's history is the two words before it; the begin stands before
the first one, which has no other. Counts of one, two and three tokens are Good-Turing
discounted as Katz has it: counts 1 to KATZ_K by (r* / r - A) / (1 - A), larger ones not
at all. What a history's seen successors leave over goes to the others in proportion to
their probability after the shorter history, by a weight that makes the distribution of
every history sum to one exactly. A history none of whose counts is small enough for a
discount keeps one part in n + 1 for the unseen.

A token is evaluated recursively: its discounted probability after two words, else the
weight of this history times its probability after one word, else that one's weight
times the probability without a history.

The counts are far larger than the texts, so tasks exchange them in blocks: a row is a
bucket of word hashes and the packed columns of its n-grams. Two exchanges do the work.

* By the predicted word: counts of pairs and triples, how many there are of each count,
  and the table of pairs that the second exchange needs (lm-pairs, by bucket).
* By the word before: a bucket has all pairs and triples around its words, so discounts,
  weights and the evaluation of every token of every text happen there. Each text's sums
  are gathered by the block of texts it came from.

Words of more than half a bucket's share are dealt out by the word next to them too;
what then lies in other buckets comes from the table of pairs, and their weights from an
aggregation. The exchanges are made in PASSES parts, which bounds the scratch they need.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import Words, commonest, crc_remainder, materialize, mix, slices
from harrow.sources.scratch import scratch_path

#: Counts up to this one get the Good-Turing discount.
KATZ_K = 5
#: Words whose counts the tasks hold as a cache; no bound of the model.
COMMON_WORDS = 400_000
#: Tokens of a bucket, on average; parts of an exchange; tokens that a task sorts into blocks at once.
BUCKET_TOKENS, PASSES, CHUNK_TOKENS = 500_000, 3, 500_000
#: What a task is handed of a bucket at once.
BATCH = "8m"

#: The end, the begin and no word at all among the hashes of words.
END, BEGIN, NONE = (int(x) for x in mix(np.array([202, 203, 204], np.uint64)).view(np.int64))
_SCALE = float(1 << 52)


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of 64-bit numbers."""
    return mix(mix(a.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ b.view(np.uint64))


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word two before, word before, word, document) of every token of the texts, ends included."""
    n = len(words.first) - 1
    ends, begins = words.first[1:], words.first[:-1] + np.arange(n)
    w = np.insert(words.hash.view(np.int64), ends, END)
    doc = np.insert(words.doc, ends, np.arange(n))
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[begins] = BEGIN
    first = np.empty_like(w)
    first[1:] = before[:-1]
    first[begins] = NONE
    return first, before, w, doc


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted keys, and which of x are there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


class Places:
    """Where 64-bit hashes stand in keys, by an open table over their lowest bits: a probe or two, whatever the number of keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = (4 << max(1, len(keys)).bit_length()) // 2 - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = keys & self.mask
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several keys one stays
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of x in the keys (0 where they are not), and which of x are there."""
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = self.table[x & self.mask]
        there = (at >= 0) & (self.keys[at] == x)
        open_ = np.flatnonzero((at >= 0) & ~there)
        slot = x[open_] & self.mask
        while len(open_):
            slot = (slot + 1) & self.mask
            now = self.table[slot]
            same = (now >= 0) & (self.keys[now] == x[open_])
            at[open_], there[open_] = now, same
            on = (now >= 0) & ~same
            open_, slot = open_[on], slot[on]
        return np.where(there, at, 0), there


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to KATZ_K + 1 (1 from there on), from how many n-grams have each count.

    A count whose factor the data don't give (too few n-grams) has (r - 1/2) / r.
    """
    d = np.ones(KATZ_K + 2)
    n = of_counts.astype(float)
    common = (KATZ_K + 1) * n[KATZ_K + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ_K + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        found = (turing - common) / (1 - common) if common < 1 else 0.0
        d[r] = found if 0 < found < 1 else (r - 0.5) / r
    return d


def _discounted(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return d[np.minimum(n, KATZ_K + 1)] * n


class Buckets:
    """Where n-grams go. hot are the words that are dealt out by their neighbour too, with their counts."""

    def __init__(self, n: int, hot: np.ndarray, counts: np.ndarray):
        self.n, self.hot, self.counts = n, hot, counts

    def of(self, word: np.ndarray, beside: np.ndarray) -> np.ndarray:
        h = mix(word.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
        _, hot = _find(self.hot, word)
        h[hot] = _hash(word[hot], beside[hot])
        return ((h >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)


def _sorted(bucket: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """An order by bucket, then by bits of the hashes: what is equal in all of them comes together but for rare collisions."""
    bits = 40 // len(keys)
    code = bucket.astype(np.uint64) << np.uint64(40)
    for k, key in enumerate(keys):
        code |= (key >> np.uint64(64 - bits)) << np.uint64(40 - bits * (k + 1))
    return np.argsort(code)


BLOCK = "bucket int, kind int, block binary"


def _blocks(bucket: np.ndarray, kind: int, base: int, columns: list[np.ndarray]):
    """A row (BLOCK) for each bucket of rows that are in its order: base, then the columns one after the other."""
    if not len(bucket):
        return
    lo = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    hi = np.concatenate([lo[1:], [len(bucket)]])
    head = np.int64(base).tobytes()
    packed = [head + b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(lo, hi, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[lo], pa.int32()), pa.array(np.full(len(lo), kind, np.int32)), pa.array(packed, pa.binary())], names=["bucket", "kind", "block"])


def _unpacked(blocks: list[bytes], types: list) -> list[np.ndarray]:
    """The columns of blocks of one kind, and the base of every row in front."""
    width = sum(np.dtype(t).itemsize for t in types)
    sizes = [(len(b) - 8) // width for b in blocks]
    out = [np.repeat(np.array([int.from_bytes(b[:8], "little", signed=True) for b in blocks], np.int64), sizes)]
    at = [8] * len(blocks)
    for t in types:
        step = np.dtype(t).itemsize
        parts = []
        for k, (b, n) in enumerate(zip(blocks, sizes, strict=True)):
            parts.append(np.frombuffer(b, t, n, at[k]))
            at[k] += n * step
        out.append(np.concatenate(parts) if parts else np.zeros(0, t))
    return out


def _by_bucket(batches):
    """(bucket, {kind: blocks}) of rows in order of their buckets."""
    bucket, held = None, {}
    for batch in batches:
        for b, kind, block in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("block"), strict=True):
            block = block.as_py()
            if b != bucket and held:
                yield bucket, held
                held = {}
            bucket = b
            held.setdefault(kind, []).append(block)
    if held:
        yield bucket, held


def _exchanged(blocks: DataFrame, buckets: int) -> DataFrame:
    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _chunks(batches):
    """Tokens of as many texts as come to CHUNK_TOKENS, or one slice: (first, before, word, document, batches)."""
    held, n, docs = [], 0, 0
    for b in slices(batches, collect=False):
        first, before, w, doc = _tokens(Words(b.column("text")))
        held.append((first, before, w, doc + docs, b))
        n, docs = n + len(w), docs + b.num_rows
        if n >= CHUNK_TOKENS:
            yield *(np.concatenate(x) for x in list(zip(*held, strict=True))[:4]), [x[4] for x in held]
            held, n, docs = [], 0, 0
    if held:
        yield *(np.concatenate(x) for x in list(zip(*held, strict=True))[:4]), [x[4] for x in held]


def _release(spark: SparkSession, *paths: str) -> None:
    """Lets go of the disk of finished steps: tables that are not read again, and shuffle files that no plan refers to any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def _count_words(texts: DataFrame) -> DataFrame:
    """(key, n) of all words, summed over each task first, then over all."""

    def summed(held):
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        return keys[new], np.add.reduceat(counts[order], new) if len(new) else counts

    def run(batches):
        held, waiting = [], 0
        for b in slices(batches, collect=False):
            held.append(np.unique(Words(b.column("text")).hash.view(np.int64), return_counts=True))
            waiting += len(held[-1][0])
            if waiting > max(CHUNK_TOKENS, len(held[0][0])):  # as much new as there is already
                held, waiting = [summed(held)], 0
        if held:
            keys, counts = summed(held)
            for lo in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 200_000]), pa.array(counts[lo : lo + 200_000].astype(np.int64))], names=["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What a fitted model has besides the texts: the table of words (key, n), the table of pairs in blocks, and numbers.

    total counts the tokens, types the distinct ones, n_docs the texts; d1, d2, d3 are
    the discounts of each order, whole and unseen what words keep and new ones share
    without a history; heavy has, for each hot word before, what its pairs keep and leave
    over: (words, factor of the pairs, log10 of the weight).
    """

    words: DataFrame
    pairs: DataFrame
    total: int
    types: int
    n_docs: int
    d1: np.ndarray
    d2: np.ndarray
    d3: np.ndarray
    whole: float
    unseen: float
    buckets: Buckets
    common: tuple[Places, np.ndarray]
    heavy: tuple[np.ndarray, np.ndarray, np.ndarray]

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return _discounted(self.d1, n) * self.whole / max(1, self.total)


def _weights(n: np.ndarray, kept: np.ndarray, small: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor of the seen successors, weight of the unseen ones) of histories that occur n times.

    kept is the sum of the discounted counts, small whether any of them is discounted,
    below the probability of the seen successors after the shorter history.
    """
    factor = np.where(small, 1.0, n / (n + 1.0))
    left, room = 1.0 - factor * kept / n, 1.0 - below
    return factor, np.where(room > 1e-12, np.maximum(left, 1e-12) / np.maximum(room, 1e-12), 1e-12)


def fit(spark: SparkSession, docs: DataFrame, common_words: int = COMMON_WORDS, bucket_tokens: int = BUCKET_TOKENS, passes: int = PASSES) -> Model:
    """Counts over all of docs(text, held) that are not held; the table of pairs serves the others too.

    The other arguments bound what tasks hold and write at once, not the model.
    """
    texts = docs.where("not held").select("text")
    words = materialize(spark, _count_words(texts), "lm-words")
    n_docs = texts.count()
    ends = spark.createDataFrame([(END, n_docs)], "key long, n long").where("n > 0")
    words = words.unionAll(ends)
    capped = F.least("n", F.lit(KATZ_K + 1))
    # One row for each small count: tokens, types, and the count of counts.
    rows = {r["r"]: (r["tokens"], r["types"]) for r in words.groupBy(capped.alias("r")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).collect()}
    exact = words.where(F.col("n") == KATZ_K + 1).count()
    total, types = sum(t for t, _ in rows.values()), sum(k for _, k in rows.values())
    of = np.array([0, *(rows.get(r, (0, 0))[1] for r in range(1, KATZ_K + 1)), exact])
    d1 = discounts(of)
    lost = sum((1 - d1[r]) * r * of[r] for r in range(1, KATZ_K + 1))
    whole, unseen = (1.0, lost / total) if lost else (total / (total + 1), 1 / (total + 1))
    n_buckets = max(1, -(-total // bucket_tokens))
    often = words.where(F.col("n") * 2 * n_buckets >= total).toPandas()  # 2 * n_buckets words at most
    hot = dict(zip(often["key"], often["n"], strict=True)) | {BEGIN: n_docs}
    keys = np.array(sorted(hot), np.int64)
    buckets = Buckets(n_buckets, keys, np.array([hot[k] for k in keys], np.int64))
    cached = commonest(words, "n", common_words).toArrow()
    order = np.argsort(cached["key"].to_numpy())
    common = (Places(cached["key"].to_numpy()[order]), cached["n"].to_numpy()[order])
    one = Model(words, words, total, types, n_docs, d1, d1, d1, whole, unseen, buckets, common, (keys, keys, keys))
    shared = spark.sparkContext.broadcast((buckets, common, one.d1, whole, total))
    found = None
    for part in range(passes):
        # Written part by part, each partitioned by kind: pairs, sums of hot words, counts of counts.
        counted = materialize(spark, _exchanged(_counting(docs, shared, part, passes), n_buckets).mapInArrow(_counted(shared), COUNTED), "lm-counts")
        _release(spark)
        found = counted if found is None else found.unionAll(counted)
    of = np.zeros((2, KATZ_K + 2), np.int64)
    for r in found.where(F.col("kind") == _OF_COUNTS).groupBy("key").agg(F.sum(F.col("numbers")[0]).alias("n")).collect():
        of[divmod(r["key"], 100)] = r["n"]
    d2, d3 = discounts(of[0]), discounts(of[1])
    sums = found.where(F.col("kind") == _HOT_SUMS).groupBy("key").agg(*(F.sum(F.col("numbers")[k]).alias(f"s{k}") for k in range(KATZ_K + 2))).toPandas().sort_values("key")
    heavy = sums["key"].to_numpy(np.int64)
    n = buckets.counts[_find(keys, heavy)[0]] if len(heavy) else np.zeros(0, np.int64)
    by_count = [sums[f"s{r}"].to_numpy(float) for r in range(KATZ_K + 2)]  # s0: probability without a history, s1..: pairs of that count, the last: larger counts
    kept = sum(d2[r] * r * by_count[r] for r in range(1, KATZ_K + 1)) + by_count[KATZ_K + 1] if len(heavy) else np.zeros(0)
    small = sum(by_count[1 : KATZ_K + 1]) > 0 if len(heavy) else np.zeros(0, bool)
    factor, weight = _weights(np.maximum(n, 1), kept, small, by_count[0] / _SCALE)
    pairs = found.where(F.col("kind") == _PAIRS).select("bucket", F.lit(0).alias("kind"), "block")
    return Model(words, pairs, total, types, n_docs, d1, d2, d3, whole, unseen, buckets, common, (heavy, factor, np.log10(weight)))


_PAIRS, _HOT_SUMS, _OF_COUNTS = 0, 1, 2
_TOKENS, _TEXTS, _SUMS, _LATE = 1, 2, 3, 4
COUNTED = "kind int, bucket int, block binary, key long, numbers array<long>"


def _counting(docs: DataFrame, shared, part: int, passes: int) -> DataFrame:
    """Blocks (word, before, first, n) of the n-grams whose bucket, by the word, belongs to this part.

    Texts that are held count 0; of them only what follows a hot word goes along: the
    second exchange deals it out where the table of pairs has to follow.
    """

    def run(batches):
        buckets = shared.value[0]
        for first, before, w, doc, texts in _chunks(batches):
            teaches = np.concatenate([~np.asarray(b.column("held").to_numpy(zero_copy_only=False)) for b in texts])[doc]
            bucket = buckets.of(w, before)
            mine = np.flatnonzero((bucket % passes == part) & (teaches | _find(buckets.hot, before)[1]))
            first, before, w, bucket, teaches = first[mine], before[mine], w[mine], bucket[mine], teaches[mine]
            pair = _hash(w, before)
            triple = _hash(pair.view(np.int64), first)
            order = _sorted(bucket, mix(w.view(np.uint64)), pair, triple)
            triple, bucket = triple[order], bucket[order]
            new = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]])) if len(order) else order
            n = np.add.reduceat(teaches[order].astype(np.uint32), new) if len(new) else np.zeros(0, np.uint32)
            at = order[new]
            yield from _blocks(bucket[new], 0, 0, [w[at], before[at], first[at], n.astype(np.uint32)])

    return docs.select("text", "held").mapInArrow(run, BLOCK)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct 64-bit hash, the number of its key for each row)."""
    # Sorted with the row in place of the lowest bits; that is by key unless two keys differ in those alone.
    bits = np.uint64(max(1, len(key)).bit_length())
    code = np.sort((key.view(np.uint64) >> bits << bits) | np.arange(len(key), dtype=np.uint64))
    order = (code & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    if (new[1:] & (code[1:] >> bits == code[:-1] >> bits)).any():
        order = np.argsort(key)
        new[1:] = key[order[1:]] != key[order[:-1]]
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _counted(shared):
    def run(batches):
        buckets, (known, known_n), d1, whole, total = shared.value
        of = np.zeros((2, KATZ_K + 2), np.int64)
        hot_sums = np.zeros((len(buckets.hot), KATZ_K + 2), np.int64)
        for _, held in _by_bucket(batches):
            _, w, before, first, n = _unpacked(held[0], [np.int64, np.int64, np.int64, np.uint32])
            pair = _hash(w, before)
            at, back = _grouped(_hash(pair.view(np.int64), first))
            triples = np.bincount(back, n).astype(np.int64)
            of[1] += np.bincount(np.minimum(triples[first[at] != NONE], KATZ_K + 2), minlength=KATZ_K + 3)[: KATZ_K + 2]
            w, before, first, pair = w[at], before[at], first[at], pair[at]
            at, back = _grouped(pair)
            pairs = np.bincount(back, triples).astype(np.int64)
            of[0] += np.bincount(np.minimum(pairs, KATZ_K + 2), minlength=KATZ_K + 3)[: KATZ_K + 2]
            # How often the word occurs: all of it is here, unless it is hot.
            each, number = _grouped(w[at])
            times = np.bincount(number, pairs).astype(np.int64)[number]
            place, hot = _find(buckets.hot, w[at])
            times[hot] = buckets.counts[place[hot]]
            place, hot = _find(buckets.hot, before[at])
            hot &= pairs > 0
            few = np.minimum(pairs[hot], KATZ_K + 1)
            np.add.at(hot_sums, (place[hot], few), np.where(few > KATZ_K, pairs[hot], 1))
            alone = np.rint(_discounted(d1, times[hot]) * whole / total * _SCALE).astype(np.int64)
            np.add.at(hot_sums, (place[hot], 0), alone)
            # The second exchange needs a pair where its count or its word's is not at hand.
            need = np.flatnonzero(_find(buckets.hot, before)[1] | ~known(w)[1])
            to = buckets.of(before[need], first[need])
            chosen, _ = _grouped(_hash(pair[need].view(np.int64), to))
            need, to = need[chosen], to[chosen]
            order = np.argsort(to, kind="stable")
            need, to = need[order], to[order]
            for b in _blocks(to, 0, 0, [before[need], w[need], pairs[back[need]].astype(np.uint32), times[back[need]].astype(np.uint32)]):
                none = pa.nulls(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("bucket"), b.column("block"), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], names=_NAMES)
        rows = [(_OF_COUNTS, 100 * k + r, [int(of[k, r])]) for k in range(2) for r in range(KATZ_K + 2) if of[k, r]]
        rows += [(_HOT_SUMS, int(buckets.hot[k]), hot_sums[k].tolist()) for k in np.flatnonzero(hot_sums.any(axis=1))]
        none = pa.nulls(len(rows))
        kind, key, numbers = ([r[k] for r in rows] for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(key, pa.int64()), pa.array(numbers, pa.list_(pa.int64()))], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in COUNTED.split(", ")]


def _row_base() -> int:
    return TaskContext.get().partitionId() << 36


def _dealt(docs: DataFrame, shared, part: int, passes: int) -> DataFrame:
    """Blocks of all tokens whose bucket, by the word before, belongs to this part: first, before, word, text and whether it teaches, n.

    Texts are numbered within this one job; their keys go along, in blocks of their own.
    """

    def run(batches):
        buckets, row = shared.value.buckets, _row_base()
        for first, before, w, doc, texts in _chunks(batches):
            teaches = np.concatenate([~np.asarray(b.column("held").to_numpy(zero_copy_only=False)) for b in texts])
            bucket = buckets.of(before, first)
            mine = np.flatnonzero(bucket % passes == part)
            triple = _hash(_hash(w[mine], before[mine]).view(np.int64), first[mine])
            order = _sorted(bucket[mine], mix(before[mine].view(np.uint64)), triple)
            at, triple = mine[order], triple[order]
            # Tokens of a text that are equal and came together are one row.
            same = (triple[1:] == triple[:-1]) & (doc[at][1:] == doc[at][:-1])
            new = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else at
            n = np.diff(np.concatenate([new, [len(at)]])).astype(np.uint32)
            at = at[new]
            yield from _blocks(bucket[at], _TOKENS, row, [first[at], before[at], w[at], (2 * doc[at] + teaches[doc[at]]).astype(np.uint32), n])
            keys = [np.concatenate([b.column(k).to_numpy() for b in texts]) for k in ("k1", "k2")]
            to = TaskContext.get().partitionId() % max(1, buckets.n // passes) * passes + part
            yield from _blocks(np.full(len(teaches), to), _TEXTS, row, keys)
            row += len(teaches)

    return docs.select("text", "held", "k1", "k2").mapInArrow(run, BLOCK)


def _evaluated(m: Model, pairs: list[bytes], tokens: list[bytes]):
    """(texts, their sums), and (texts, words, times) whose probability without a history is still to be added."""
    base, first, before, w, doc, n = _unpacked(tokens, [np.int64, np.int64, np.int64, np.uint32, np.uint32])
    row, n, teaches = base + (doc >> 1), n.astype(np.int64), (doc & 1).astype(np.int64)
    _, of_before, of_w, given, given_times = _unpacked(pairs, [np.int64, np.int64, np.uint32, np.uint32])
    # Triples, then pairs, then words before, each with its training count.
    pair = _hash(w, before)
    at3, back3 = _grouped(_hash(pair.view(np.int64), first))
    c3 = np.bincount(back3, n * teaches).astype(np.int64)
    first, before, w, pair = first[at3], before[at3], w[at3], pair[at3]
    at2, to2 = _grouped(pair)
    c2 = np.bincount(to2, c3).astype(np.int64)
    key = _hash(of_w, of_before)
    order = np.argsort(key)
    place, there = _find(key[order], pair[at2])
    hot_at, hot = _find(m.buckets.hot, before[at2])
    c2[hot] = np.where(there[hot], given[order][place[hot]] if len(order) else 0, 0)
    known_at, known = m.common[0](w[at2])
    times = np.where(known, m.common[1][known_at] if len(m.common[1]) else 0, 0)
    rare = ~known & there
    times[rare] = given_times[order][place[rare]]
    p1 = np.where(times > 0, m.unigram(times), 0.0)
    at1, to1 = _grouped(before[at2])
    hot1_at, hot1 = _find(m.buckets.hot, before[at2][at1])
    c1 = np.bincount(to1, c2).astype(np.int64)
    c1[hot1] = m.buckets.counts[hot1_at[hot1]]
    kept2, seen2 = _discounted(m.d2, c2), c2 > 0
    small = np.bincount(to1, (seen2 & (c2 <= KATZ_K)).astype(float)) > 0
    with np.errstate(divide="ignore"):
        factor1, weight1 = _weights(np.maximum(c1, 1), np.bincount(to1, kept2), small, np.bincount(to1, p1 * seen2))
        log1 = np.where(c1 > 0, np.log10(weight1), 0.0)
        heavy_at, heavy = _find(m.heavy[0], before[at2][at1])
        factor1[heavy], log1[heavy] = m.heavy[1][heavy_at[heavy]], m.heavy[2][heavy_at[heavy]]
        p2 = factor1[to1] * kept2 / np.maximum(c1, 1)[to1]
        # A word without a count at hand is either new or rare; the table of words tells later.
        later = ~seen2 & (times == 0)
        log2 = np.where(seen2, np.log10(p2), log1[to1] + np.where(later, 0.0, np.log10(p1)))
        # Histories of two words.
        ath, toh = _grouped(_hash(before, first))
        ch = np.bincount(toh, c3).astype(np.int64)
        seen3 = (c3 > 0) & (first != NONE)
        kept3 = _discounted(m.d3, c3)
        small = np.bincount(toh, (seen3 & (c3 <= KATZ_K)).astype(float)) > 0
        factor2, weight2 = _weights(np.maximum(ch, 1), np.bincount(toh, kept3), small, np.bincount(toh, p2[to2] * seen3))
        after = (ch > 0) & (first[ath] != NONE)
        log3 = np.where(seen3, np.log10(factor2[toh] * kept3 / np.maximum(ch, 1)[toh]), log2[to2] + np.where(after, np.log10(weight2), 0.0)[toh])
    texts, back = np.unique(row, return_inverse=True)
    sums = np.bincount(back, n * log3[back3])
    open_ = np.flatnonzero((later[to2] & ~seen3)[back3])
    return (texts, sums), (row[open_], w[back3[open_]], n[open_])


def _scored(shared):
    def run(batches):
        m = shared.value
        for _, held in _by_bucket(batches):
            for block in held.get(_TEXTS, []):
                source = int.from_bytes(block[:8], "little") >> 36
                yield pa.RecordBatch.from_arrays([pa.array([source], pa.int32()), pa.array([_TEXTS], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "kind", "block"])
            if _TOKENS in held:
                (texts, sums), (rows, words, n) = _evaluated(m, held.get(_PAIRS, []), held[_TOKENS])
                yield from _blocks(texts >> 36, _SUMS, 0, [texts, sums])
                order = np.argsort(rows, kind="stable")
                yield from _blocks(rows[order] >> 36, _LATE, 0, [rows[order], words[order], n[order]])

    return run


def _summed(batches):
    """(k1, k2, score, copies) of the texts of a source, and (k1, k2, key, times) of their words that are still to be looked up."""
    for _, held in _by_bucket(batches):
        base, k1, k2 = _unpacked(held[_TEXTS], [np.int64, np.int64])
        starts = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        rows = base + np.arange(len(base)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(base)]])))
        order = np.argsort(rows)
        rows, k1, k2 = rows[order], k1[order], k2[order]
        _, texts, sums = _unpacked(held.get(_SUMS, []), [np.int64, np.float64])
        order = np.lexsort((sums, texts))  # one order of addition, whatever the order of arrival
        total = np.bincount(np.searchsorted(rows, texts[order]), sums[order], minlength=len(rows)).astype(float)
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(total), none, none], names=_SUMMED)
        _, texts, words, n = _unpacked(held.get(_LATE, []), [np.int64, np.int64, np.int64])
        at = np.searchsorted(rows, texts)
        yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.nulls(len(at), pa.float64()), pa.array(words), pa.array(n)], names=_SUMMED)


_SUMMED = ["k1", "k2", "score", "key", "times"]


def score(spark: SparkSession, docs: DataFrame, common_words: int = COMMON_WORDS, bucket_tokens: int = BUCKET_TOKENS, passes: int = PASSES) -> DataFrame:
    """Scores of every row of docs(doc_id, text, ...) by a model of the rows that are not held out.

    Held out are those with crc32(doc_id as text) mod 7 = 2. Columns: doc_id, held_out,
    n_tokens (words and the end), n_known (those with a count), train_tokens, base_score
    (log10 by add-one unigrams over the exact counts) and score (log10 by the model).

    A null text is an empty one: its only token is the end. A null doc_id is not held
    out. Rows may repeat; each teaches and is answered. Without training rows every
    token is new, with probability 1. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held", F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False)))
    docs = docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit(7))})
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, BATCH)
    try:
        return _score(spark, docs, fit(spark, docs, common_words, bucket_tokens, passes), passes)
    finally:
        spark.conf.set(size, before)


def _score(spark: SparkSession, docs: DataFrame, m: Model, passes: int) -> DataFrame:
    words, pairs = m.words, m.pairs
    m.words = m.pairs = None  # tables; the rest goes to the tasks
    shared = spark.sparkContext.broadcast(m)
    met = None
    for part in range(passes):
        blocks = _dealt(docs, shared, part, passes).unionAll(pairs.where(F.col("bucket") % passes == part))
        blocks = blocks.repartition(m.buckets.n, "bucket").sortWithinPartitions("bucket", "kind")
        path = scratch_path(spark, "lm-sums")
        blocks.mapInArrow(_scored(shared), BLOCK).write.parquet(path)
        del blocks
        _release(spark)  # the exchange is done, its files go before the next one begins
        some = spark.read.schema(BLOCK).parquet(path).repartition("bucket").sortWithinPartitions("bucket")
        some = materialize(spark, some.mapInArrow(_summed, "k1 long, k2 long, score double, key long, times long"), "lm-scores")
        _release(spark, path)
        met = some if met is None else met.unionAll(some)
    same = ["k1", "k2"]
    sums = met.where("score is not null").groupBy(same).agg(F.sum("score").alias("score"), (F.count(F.lit(1)) / passes).alias("copies"))
    alone = F.element_at(F.array(*map(F.lit, map(float, m.d1))), (F.least("n", F.lit(KATZ_K + 1)) + 1).cast("int")) * F.col("n") * F.lit(m.whole / max(1, m.total))
    late = met.where("key is not null").select(*same, "key", "times").join(words.select("key", F.log10(alone).alias("log")), "key", "left")
    late = late.groupBy(same).agg(F.sum(F.col("times") * F.coalesce("log", F.lit(float(np.log10(m.unseen) if m.unseen > 0 else 0.0)))).alias("late"))
    known = _known(docs, words, shared)
    per_token = float(np.log10(m.total + m.types + 1.0))
    out = known.join(sums, same, "left").join(late, same, "left")
    return out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * per_token).alias("base_score"),
        ((F.col("score") + F.coalesce("late", F.lit(0.0))) / F.col("copies")).alias("score"))  # equal rows were summed up together


def _known(docs: DataFrame, words: DataFrame, shared) -> DataFrame:
    """(k1, k2, doc_id, held, n_tokens, n_known, logs): exact counts of every text's tokens, common words from the cache, the others by a join."""

    def run(batches):
        m, row = shared.value, _row_base()
        for b in slices(batches, collect=False):
            w, n = Words(b.column("text")), b.num_rows
            hashes, ends = w.hash.view(np.int64), m.n_docs
            at, seen = m.common[0](hashes)
            logs = np.bincount(w.doc[seen], np.log10(m.common[1][at[seen]] + 1.0) if seen.any() else None, minlength=n) + np.log10(ends + 1.0)
            each = row + np.arange(n)
            stats = [b.column("k1"), b.column("k2"), b.column("doc_id"), b.column("held"), pa.array(np.diff(w.first) + 1), pa.array(np.bincount(w.doc[seen], minlength=n) + (ends > 0)), pa.array(logs.astype(float))]
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(each), *stats, none, none], names=_KNOWN)
            # A row for every text and word that the cache lacks.
            rows, rest = each[w.doc[~seen]], hashes[~seen]
            at, back = _grouped(_hash(rows, rest))
            times = np.bincount(back, minlength=len(at))
            none = [pa.nulls(len(at), s.type) for s in stats]
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), *none, pa.array(rest[at]), pa.array(times)], names=_KNOWN)
            row += n

    met = docs.select("text", "k1", "k2", "doc_id", "held").mapInArrow(run, "row long, k1 long, k2 long, doc_id long, held boolean, n_tokens long, n_known long, logs double, key long, times long")
    met = met.join(words, "key", "left")
    one = F.col("key").isNull()
    out = met.groupBy("row").agg(
        *(F.max(F.when(one, F.col(c))).alias(c) for c in ("k1", "k2", "doc_id", "held", "n_tokens", "n_known", "logs")),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    return out.select("k1", "k2", "doc_id", "held", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("logs"))


_KNOWN = ["row", "k1", "k2", "doc_id", "held", "n_tokens", "n_known", "logs", "key", "times"]
