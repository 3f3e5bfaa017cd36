"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised and cut once. What follows needs only how many pieces there are
of each length, one number a length however large the corpus is: pieces above a third of
the capacity, of which a sequence holds two at most, are matched greedily, the longest
with the longest that fits; shorter ones then go, longest first, where the gap is
smallest, and open sequences of their own when no gap holds them. The plan comes out as
runs, "the next so many pieces of this length go to these sequences at this offset",
and a piece finds its run by its rank among the pieces of its length: a running count
inside each task's output plus what the tasks before it have of that length.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.common import materialize, slices

CAPACITY = 1024
END_ID = 2


class Coder:
    """Token ids as the tokenizers library gives them for the file at path, special strings included.

    Where the file is a plain byte-level BPE whose ids follow the order of its merges,
    the ids are made by tiktoken from the same vocabulary, six times as fast; texts that
    it refuses (white space beyond its stack) go to the library, as do all texts of
    other files.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fast = _ranked(json.load(f))

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def _ranked(file: dict):
    """The file's vocabulary as a tiktoken encoding, or None where that might give other ids."""
    import tiktoken

    model, before, vocab = file["model"], file.get("pre_tokenizer") or {}, file["model"].get("vocab", {})
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    whole = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in file["added_tokens"])
    if not (plain and level and whole) or file.get("normalizer") or file.get("truncation") or file.get("padding"):
        return None
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)) or merged and merged[0] < 256 or len(merged) + 256 != len(set(vocab) - set(special)):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


_LOADED: dict[str, Coder] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, part, at) of every row of docs(doc_id, text, ...).

    A document's ids with end_id behind them; one of more than capacity ids is cut, all
    pieces but the first as long as capacity. ids_crc32 is the unsigned crc32 of a
    piece's ids as little-endian 32-bit integers. (part, at) tell the pieces of one
    length apart: the task, and how many of that length it had before. They belong to a
    run of the job, so the result must be stored before it is read twice.
    """

    def run(batches):
        coder = _LOADED.get(tokenizer_path) or _LOADED.setdefault(tokenizer_path, Coder(tokenizer_path))
        had, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches):
            ids = [x for t in b.column("text").to_pylist() for x in (coder.ids(t or ""), np.array([end_id], np.uint32))]
            sizes = np.array([len(x) for x in ids], np.int64)
            sizes = sizes[::2] + sizes[1::2]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            shorter = sizes - (count - 1) * capacity  # the first piece has what the others leave
            length = np.where(piece == 0, shorter[doc], capacity)
            start = np.where(piece == 0, 0, shorter[doc] + (piece - 1) * capacity)
            first = np.concatenate([[0], np.cumsum(length)])
            order = np.argsort(length, kind="stable")
            at = np.empty_like(length)
            at[order] = np.arange(len(order)) - np.searchsorted(length[order], length[order])
            at += had[length]
            had += np.bincount(length, minlength=capacity + 1)
            raw = memoryview(flat.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32)))
            columns = {
                "doc_id": b.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                "ids": lists, "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(doc), part, np.int32)), "at": pa.array(at),
            }
            yield from pa.Table.from_pydict(columns).to_batches(4096)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, part int, at long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, rank, pieces, each, sequence, offset), sorted by length and rank.

    The pieces of that length from this rank on go to sequences from this number on,
    each of which takes so many of them, one behind the other from the offset. Its size
    depends on the capacity, not on the counts.
    """
    left, rank, runs = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0), []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room in a sequence: (first sequence, how many)
    opened = 0

    def put(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        runs.append((length, rank[length], n, each, sequence, offset))
        rank[length] += n
        left[length] -= n

    large = [-n for n in left if 3 * n > capacity]
    heapq.heapify(large)
    while large:
        longest = -large[0]
        if not left[longest]:
            heapq.heappop(large)
            continue
        fits = [-n for n in large if -n + longest <= capacity and left[-n] > (-n == longest)]
        partner = max(fits, default=0)
        n = left[longest] if not partner else left[longest] // 2 if partner == longest else min(left[longest], left[partner])
        put(longest, n, 1, opened, 0)
        if partner:
            put(partner, n, 1, opened, longest)
        gaps.setdefault(capacity - longest - partner, []).append((opened, n))
        opened += n

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in [g for g in sorted(gaps) if g >= length]:
            each, offset, ranges = gap // length, capacity - gap, gaps.pop(gap)
            while ranges and left[length]:
                sequence, many = ranges.pop()
                whole, more = min(many, left[length] // each), left[length] % each
                more = more if whole < many else 0
                if whole:
                    put(length, whole * each, each, sequence, offset)
                    gaps.setdefault(gap - each * length, []).append((sequence, whole))
                if more:
                    put(length, more, more, sequence + whole, offset)
                    gaps.setdefault(gap - more * length, []).append((sequence + whole, 1))
                used = whole + (more > 0)
                if used < many:
                    ranges.append((sequence + used, many - used))
            if ranges:
                gaps.setdefault(gap, []).extend(ranges)
            if not left[length]:
                break
        if left[length]:
            each = capacity // length
            whole, more = divmod(left[length], each)
            if whole:
                put(length, whole * each, each, opened, 0)
                gaps.setdefault(capacity - each * length, []).append((opened, whole))
            if more:
                put(length, more, more, opened + whole, 0)
                gaps.setdefault(capacity - more * length, []).append((opened + whole, 1))
            opened += whole + (more > 0)
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def place(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of cut(length, part, at, ...), a stored table as pieces() gives it, with sequence_id and offset in place of part and at."""
    tasks = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    tasks = materialize(spark, tasks, "packing-tasks")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    before = tasks.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    kept = [c for c in cut.columns if c not in ("part", "at")]

    def run(batches):
        runs = shared.value
        first = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
        for b in batches:
            length, rank = np.asarray(b.column("length"), np.int64), np.asarray(b.column("rank"), np.int64)
            which = np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                which[mine] = first[n] + np.searchsorted(runs[first[n] : first[n + 1], 1], rank[mine], "right") - 1
            _, since, _, each, sequence, offset = runs[which].T
            i = rank - since
            found = [pa.array(sequence + i // each), pa.array(offset + i % each * length)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + found, names=[*kept, "sequence_id", "offset"])

    ranked = cut.join(before, ["length", "part"]).select(*kept, (F.col("before") + F.col("at")).alias("rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in kept)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset) of docs(doc_id, text, ...), a row a piece.

    Sequences from 0 on hold at most capacity tokens, their pieces gapless from offset
    0. A null text is an empty one: a piece of the end id alone. Rows may repeat and lack
    an id; each is a document. Longer documents are cut, none is dropped. Other columns
    are ignored; an empty table gives no rows. with_ids=False leaves the ids in the
    stored table.
    """
    cut = materialize(spark, pieces(docs, tokenizer_path, capacity, end_id), "packing-pieces")
    return place(spark, cut if with_ids else cut.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences that pack() made."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most capacity tokens
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
