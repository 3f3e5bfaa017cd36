"""How the sources of a language differ in their words: sketch-prefiltered counting.

A first pass over the texts adds the document frequency of every (language, term) to
count-min sketches, one a task, that are merged by cell ranges. Cells stop at the
threshold, so a sketch is a byte a cell; an estimate is never below the true frequency,
and a term whose estimate stays under the threshold cannot be kept. The second pass
drops those terms before anything is shuffled and counts the others exactly, by
(language, source, term), summed in the task first.

Two sources are compared over all kept terms of the language, also those that neither
has: a group's terms with the other's share of an absent term come from a histogram of
the group's counts, only the terms that both have are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.common import Spans, materialize, mix, slices, utf8_parts

#: A language keeps the terms that stand in this many of its documents.
MIN_DOCS = 30
#: Terms listed for each group.
TOP_TERMS = 50
#: The sketch: rows, cells of a row for each document of the corpus, and the bounds of a row (25 MB in all at most).
DEPTH, CELLS_A_DOCUMENT, MIN_WIDTH, MAX_WIDTH = 3, 8, 1 << 16, 1 << 23
#: Cells that travel as one row while sketches are merged.
SLAB = 4096
#: Rows of (language, source, term) that a task sums before it lets go of them.
HELD_ROWS = 200_000

#: Terms are runs of A-Z, a-z and everything beyond ASCII; A-Z are lowered, all else parts terms.
_FOLD = bytes(i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x61 <= i <= 0x7A else 0x20 for i in range(256))


class Terms:
    """The terms of a slice of documents: (doc, code, n) a row for each document's distinct terms; names holds the terms by code."""

    def __init__(self, batch: pa.RecordBatch):
        raw, offsets = utf8_parts(batch.column("text"))
        texts = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(raw.tobytes().translate(_FOLD)))
        lists = pc.split_pattern(texts, " ")
        words, doc = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.not_equal(words, "")
        words, doc = words.filter(full).dictionary_encode(), np.asarray(doc.filter(full), np.int64)
        self.names = words.dictionary
        k = max(1, len(self.names))
        pairs, self.n = np.unique(doc * k + np.asarray(words.indices, np.int64), return_counts=True)
        self.doc, self.code = pairs // k, pairs % k
        lang = batch.column("lang").dictionary_encode()
        self.langs, self.lang = lang.dictionary, np.asarray(lang.indices, np.int64)

    def by_language(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and number of documents of each (language, term), and which of them the rows are."""
        k = max(1, len(self.names))
        pairs, back, df = np.unique(self.lang[self.doc] * k + self.code, return_inverse=True, return_counts=True)
        h = _hashes(self.names)[pairs % k] ^ mix(_hashes(self.langs)[pairs // k] if len(pairs) else np.zeros(0, np.uint64))
        return h, df, back


def _hashes(names: pa.Array) -> np.ndarray:
    raw, offsets = utf8_parts(names)
    return Spans(raw)(offsets[:-1], offsets[1:])


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(h + np.uint64(row) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(width - 1)).astype(np.int64)


def sketch(docs: DataFrame, width: int, top: int) -> np.ndarray:
    """The merged count-min sketch of document frequencies by (language, term), DEPTH rows of width cells that stop at top."""

    def add(batches):
        cells = np.zeros((DEPTH, width), np.uint8)
        for b in slices(batches):
            h, df, _ = Terms(b).by_language()
            for r in range(DEPTH):
                at, back = np.unique(_cells(h, r, width), return_inverse=True)
                cells[r, at] = np.minimum(cells[r, at] + np.bincount(back, df, len(at)), top)
        slabs = cells.reshape(-1, SLAB)
        some = np.flatnonzero(slabs.any(axis=1))
        for lo in range(0, len(some), 1024):
            part = some[lo : lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([slabs[i].tobytes() for i in part], pa.binary())], names=["slab", "cells"])

    def merge(batches):
        # Equal slabs come one after the other.
        last, total = None, None
        for b in batches:
            done = []
            for slab, cells in zip(b.column("slab").to_pylist(), b.column("cells").to_pylist(), strict=True):
                more = np.frombuffer(cells, np.uint8)
                if slab == last:
                    total = np.minimum(total.astype(np.uint16) + more, top).astype(np.uint8)
                    continue
                if last is not None:
                    done.append((last, total.tobytes()))
                last, total = slab, more
            yield _slabs(done)
        yield _slabs([(last, total.tobytes())] if last is not None else [])

    parts = docs.select("text", "lang").mapInArrow(add, "slab int, cells binary")
    merged = parts.repartition("slab").sortWithinPartitions("slab").mapInArrow(merge, "slab int, cells binary")
    out = np.zeros((DEPTH * width // SLAB, SLAB), np.uint8)
    for row in merged.toLocalIterator():  # at most 25 MB
        out[row["slab"]] = np.frombuffer(row["cells"], np.uint8)
    return out.reshape(DEPTH, width)


def _slabs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slab", "cells"])


def term_counts(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, width: int | None = None) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of the terms whose sketched frequency reaches min_docs.

    Those counts are exact; terms that fewer documents of the language have may be among
    them. Every (lang, source) that occurs has a row with the empty term and zeros.
    """
    if not 1 <= min_docs <= 255:
        raise ValueError("a cell of the sketch counts to 255")
    if width is None:
        width = 1 << max(0, docs.count() * CELLS_A_DOCUMENT - 1).bit_length()
        width = min(max(width, MIN_WIDTH), MAX_WIDTH)
    shared = spark.sparkContext.broadcast(sketch(docs, width, min_docs))

    def run(batches):
        cells, held, rows = shared.value, [], 0
        for b in slices(batches):
            t = Terms(b)
            h, _, back = t.by_language()
            maybe = np.min([cells[r, _cells(h, r, width)] for r in range(DEPTH)], axis=0) >= min_docs if len(h) else np.zeros(0, bool)
            live = maybe[back] if len(back) else np.zeros(0, bool)
            source = b.column("source").dictionary_encode()
            of = t.lang * max(1, len(source.dictionary)) + np.asarray(source.indices, np.int64)
            k = max(1, len(t.names))
            pairs, at, back = np.unique(of[t.doc[live]] * k + t.code[live], return_index=True, return_inverse=True)
            doc = t.doc[live][at]
            held.append(_counted(b, doc, t.names.take(pa.array(pairs % k)).cast(pa.string()), np.bincount(back, t.n[live], len(pairs)), np.bincount(back, minlength=len(pairs))))
            doc = np.unique(of, return_index=True)[1]
            held.append(_counted(b, doc, pa.array([""] * len(doc), pa.string()), np.zeros(len(doc)), np.zeros(len(doc))))
            rows += len(pairs)
            if rows > HELD_ROWS:
                held = [_summed(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(20_000)
                    held, rows = [], 0
        if held:
            yield from _summed(held).to_batches(20_000)

    schema = "lang string, source string, term string, n long, df long"
    return docs.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _counted(batch, doc, terms, n, df) -> pa.Table:
    rows = pa.array(doc)
    return pa.table({"lang": batch.column("lang").take(rows), "source": batch.column("source").take(rows), "term": terms, "n": pa.array(n.astype(np.int64)), "df": pa.array(df.astype(np.int64))})


def _summed(tables: list) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
    return out.rename_columns({"n_sum": "n", "df_sum": "df"}).select(["lang", "source", "term", "n", "df"])


def _share(n: str, total: str, terms: str):
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly; null without terms."""
    return F.expr(f"1L + (cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(25,0))) div nullif(cast({total} + 5 * {terms} as decimal(25,0)), 0)")


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs(text, lang, source, ...).

    Null text, lang and source are read as ''. A language keeps the terms that at least
    min_docs of its documents have; every row counts as a document, repeated ones too.
    With 5 added to each kept term's count, a group (lang, source) and the language
    itself give every kept term a share in billionths. Part pair compares a group with
    every other of its language by the sum of absolute differences over all kept terms
    (0 where none is kept); part term lists the top kept terms that the group has more
    of than the language. Ranks go by value, larger first, then by item as UTF-8. A
    group alone in its language has no pair rows; an empty table gives no rows. doc_id
    and other columns are ignored.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = materialize(spark, term_counts(spark, docs, min_docs, width), "terms-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= min_docs).drop("df")
    kept = materialize(spark, kept, "terms-kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    rows = counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    rows = materialize(spark, rows, "terms-rows")
    of_group = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = counts.where("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "own", "v", "lang_total")))
    groups = materialize(spark, groups.withColumn("p0", _share("0L", "total", "v")), "terms-groups")

    shares = rows.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    shares = materialize(spark, shares.select("lang", "source", "term", "p", "p0", _share("lang_n", "lang_total", "v").alias("q")), "terms-shares")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = _pairs(shares, groups).withColumn("rank", F.row_number().over(ranked))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(more.withColumn("part", F.lit("term")).select(columns))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b_p0"), F.col("own").alias("b_own"))
    # What a group's own terms would differ by if the other had none of them: its shares as a histogram.
    steps = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("k"))
    alone = steps.join(other.select("lang", "b", "b_p0"), "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.expr("k * abs(p - b_p0)")).alias("alone"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    change = F.sum(F.expr("abs(pa - pb) - abs(pa - b0) - abs(a0 - pb) + abs(a0 - b0)"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(change.alias("both"))
    first = groups.select("lang", F.col("source").alias("a"), "v", F.col("p0").alias("a_p0"), F.col("own").alias("a_own"))
    value = F.expr("(v - a_own - b_own) * abs(a_p0 - b_p0)")
    half = first.join(other, "lang").where("a < b").select("lang", "a", "b", F.coalesce(value, F.lit(0).cast("long")).alias("value"))
    turned = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("turned"))
    half = half.join(alone, ["lang", "a", "b"], "left").join(turned, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    total = F.col("value") + sum(F.coalesce(c, F.lit(0).cast("long")) for c in ("alone", "turned", "both"))
    half = half.select("lang", "a", "b", total.alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return half.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")
