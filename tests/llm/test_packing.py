"""Packing: the library's ids, the cut, gapless sequences, and how few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def best_fit(lengths, capacity):
    """Sequences that best fit gives piece by piece, longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = min((i for i, g in enumerate(gaps) if g >= n), key=gaps.__getitem__, default=None)
        if i is None:
            gaps.append(capacity - n)
        else:
            gaps[i] -= n
    return len(gaps)


def placed(runs, capacity):
    """sequence to [(offset, length)] of a plan."""
    out = defaultdict(list)
    for length, _, n, each, sequence, offset in runs.tolist():
        for i in range(n):
            out[sequence + i // each].append((offset + i % each * length, length))
    return out


def check(bins, capacity):
    assert sorted(bins) == list(range(len(bins)))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.sampled_from([60, 64, 100]))
def test_plan_is_as_tight_as_best_fit(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, capacity)
    bins = placed(runs, capacity)
    check(bins, capacity)
    assert sorted(n for parts in bins.values() for _, n in parts) == sorted(lengths)
    assert len(bins) <= best_fit(lengths, capacity)
    assert all(sum(3 * n > capacity for _, n in parts) <= 2 for parts in bins.values())
    for n, c in counts.items():  # ranks leave nothing out
        mine = runs[runs[:, 0] == n]
        assert mine[:, 1].tolist() == (np.cumsum(mine[:, 2]) - mine[:, 2]).tolist() and mine[:, 2].sum() == c


def test_large_pieces_are_matched_best():
    """Above a third of the capacity no packing needs fewer sequences than the greedy matching: every way is tried."""

    def fewest(lengths):
        if not lengths:
            return 0
        n, rest = lengths[0], lengths[1:]
        return 1 + min([fewest(rest)] + [fewest(rest[:i] + rest[i + 1 :]) for i, m in enumerate(rest) if n + m <= 60])

    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.randint(21, 60) for _ in range(7))
        assert len(placed(packing.plan({n: lengths.count(n) for n in set(lengths)}, 60), 60)) == fewest(lengths)


def test_plan_does_not_grow_with_the_counts():
    counts = {n: 10**9 + 7 * n for n in range(1, 1025)}
    runs = packing.plan(counts)
    assert len(runs) < 20_000
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 1024) <= (runs[:, 4] + -(-runs[:, 2] // runs[:, 3])).max() <= total / 1024 * 1.0001


@pytest.mark.parametrize("text", [
    None, "", " ", "<|endoftext|>", "a<|endoftext|> b", "don't  stop\n\n  now", "x" * 5000, " " * 200_000, "ÀÉ straße ﬁn 漢字 é 😀 ͸\x85　 ٣", "﷽ 𝒳 ǅ",
])
def test_ids_of_the_library(text):
    assert [*packing.Coder(PATH).ids(text or "").tolist(), 2] == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1.'s\n\té漢<|endoftext|>"), max_size=40) | st.text(max_size=30))
def test_ids_of_any_text(text):
    coder = packing._LOADED.setdefault(PATH, packing._LOADED.get(PATH) or packing.Coder(PATH))
    assert coder.fast and coder.ids(text).tolist() == library(text)[:-1]


def test_another_file_is_left_to_the_library():
    assert packing.Coder(public_tokenizers.path("word_bpe_49k.json")).fast is None


@pytest.mark.parametrize("capacity", [1024, 16])
def test_pieces_and_places(spark, edges, rows, capacity):
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edges.select("doc_id", "text")).withColumn("length", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    got = packing.pack(spark, docs, PATH, capacity).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(library(r["text"]))
    assert set(by_doc) == set(texts)
    for doc_id, want in texts.items():
        if len(want) > 1:  # a repeated row: as many pieces as both
            assert len(by_doc[doc_id]) == sum(-(-len(w) // capacity) for w in want)
            continue
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(want[0]) // capacity)))
        assert sum((r["ids"] for r in pieces), []) == want[0]
        for r in pieces:
            assert r["ids"] == want[0][r["start"] : r["start"] + r["length"]] and (r["piece"] == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    check(bins, capacity)
    assert len(bins) <= best_fit([r["length"] for r in got], capacity)
    if capacity == 1024:
        assert len(bins) <= 1.01 * sum(r["length"] for r in got) / capacity + 1


def test_sequences_and_empty_table(spark, rows, empty):
    packed = packing.pack(spark, spark.createDataFrame(rows[:60], "doc_id long, text string"), PATH)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, made.values())) == sum(len(library(t)) for _, t in rows[:60])
    assert packing.pack(spark, empty, PATH).count() == 0
