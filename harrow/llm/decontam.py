"""Benchmark decontamination by template windows.

Texts become templates: numbers, units and names inside a sentence turn into typed
placeholders, other words are lower-cased without the punctuation around them. Windows
of WIDTH template words are joined by hash. Matches of a document and an item that lie
on one diagonal must fill the slots consistently - one value of the item always stands
for one value of the document - so a question with other numbers or names is caught
and a coincidence of placeholders is not. Windows are matched word for word as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import BROADCAST_BYTES, Words, hash_words, materialize, mix, slices, utf8_parts

WIDTH = 8
#: Windows on one diagonal that make a match; shorter items need all of theirs.
MIN_WINDOWS = 3
#: One word in so many, over the windows of a diagonal, must be none of the placeholders.
LITERAL_SHARE = 4

#: Units of measure and money, as whole words.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg lb lbs oz gram grams "
    "kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in mix(np.array([101, 102, 103], np.uint64)))
_PLACE = mix(np.arange(500, 500 + 64, dtype=np.uint64)) | np.uint64(1)
_BODY = np.zeros(256, bool)
_BODY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIGURE = _DIGIT.copy()
_FIGURE[[44, 46]] = True


class Templates:
    """The template words of a slice of texts: token (hash), value (hash of the word itself), slot, first."""

    def __init__(self, texts: pa.Array):
        raw, _ = utf8_parts(texts)
        words = Words(texts)
        body = np.flatnonzero(_BODY[words.buf])
        lo = np.searchsorted(body, words.start)
        hi = np.searchsorted(body, words.end)
        some = hi > lo
        start, end = body[lo[some]] if len(body) else lo[some], body[hi[some] - 1] + 1 if len(body) else hi[some]
        doc = words.doc[some]
        self.first = np.searchsorted(doc, np.arange(len(words.first)))
        self.value = words.spans(start, end)
        total = np.concatenate([[0], np.cumsum(_FIGURE[words.buf])])
        number = _DIGIT[words.buf[start]] & (total[end] - total[start] == end - start)
        unit = np.isin(self.value, _unit_hashes()) & ~number
        # A capital starts a name unless the word opens a text, a line or a sentence.
        capital = (raw[start] >= 65) & (raw[start] <= 90)
        opens = np.ones(len(start), bool)
        if len(start) > 1:
            stops = np.isin(raw, np.frombuffer(b".!?:\n", np.uint8))
            count = np.concatenate([[0], np.cumsum(stops)])
            opens[1:] = (count[start[1:]] > count[end[:-1]]) | (doc[1:] != doc[:-1])
        name = capital & ~opens & ~number & ~unit
        self.slot = number | unit | name
        self.token = self.value.copy()
        for mark, which in ((_NUMBER, number), (_UNIT, unit), (_NAME, name)):
            self.token[which] = mark

    def windows(self, width: int, opened: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text, first word and number of leading words whose slots do not count, of every window of width words.

        Windows with slots come as templates and word for word (no slot counts); with
        opened, those that begin with a name also as if a sentence began there.
        """
        n = max(0, len(self.token) - width + 1)
        h, literal = np.full(n, width, np.uint64), np.full(n, width + 1000, np.uint64)
        for k in range(width):
            h += self.token[k : k + n] * _PLACE[k]
            literal += self.value[k : k + n] * _PLACE[k]
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        inside = doc[width - 1 :] == doc[:n] if n else np.zeros(0, bool)
        every = np.flatnonzero(inside)
        filled = np.flatnonzero(inside & (slots[width : width + n] > slots[:n]))
        at, hashes, skip = [every, filled], [h[every], literal[filled]], [0, width]
        if opened:
            named = np.flatnonzero(inside & (self.token[:n] == _NAME))
            at.append(named)
            hashes.append(h[named] + (self.value[named] - _NAME) * _PLACE[0])
            skip.append(1)
        skip = np.repeat(skip, [len(x) for x in at])
        at = np.concatenate(at)
        return mix(np.concatenate(hashes)), doc[at] if n else at, at, skip

    def slots_of(self, at: int, width: int, skip: int) -> list[int]:
        picked = self.value[at + skip : at + width][self.slot[at + skip : at + width]]
        return picked.view(np.int64).tolist()


_HASHED: dict = {}


def _unit_hashes() -> np.ndarray:
    if "units" not in _HASHED:
        _HASHED["units"] = None
        _HASHED["units"] = hash_words(UNITS)
    return _HASHED["units"]


def _rows(keys, pos, width, hashes, slots) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(pos, pa.int64()), pa.array(width, pa.int32()), pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.int64()))],
        names=["id", "pos", "width", "h", "slots"])


_SCHEMA = "id long, pos long, width int, h long, slots array<long>"


def _item_windows(items: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            t = Templates(b.column("text"))
            ids = b.column("id").to_pylist()
            out = ([], [], [], [], [])
            for d in range(b.num_rows):
                n = int(t.first[d + 1] - t.first[d])
                if not n or ids[d] is None:
                    continue
                own = min(width, n)
                h, doc, at, skip = t.windows(own, False)
                for i in np.flatnonzero(doc == d):
                    for col, v in zip(out, (ids[d], int(at[i] - t.first[d]), own, int(h[i].view(np.int64)), t.slots_of(at[i], own, skip[i])), strict=True):
                        col.append(v)
            yield _rows(*out)

    return items.mapInArrow(run, _SCHEMA)


def _document_windows(docs: DataFrame, widths: list[int], wanted) -> DataFrame:
    """The documents' windows of the given widths; only those in wanted (a broadcast sorted array) if there is one."""

    def run(batches):
        for b in slices(batches):
            t = Templates(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            out = ([], [], [], [], [])
            for width in widths:
                h, doc, at, skip = t.windows(width, True)
                h = h.view(np.int64)
                if wanted is not None:
                    keys = wanted.value
                    hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h) if len(keys) else np.zeros(0, int)
                    h, doc, at, skip = h[hit], doc[hit], at[hit], skip[hit]
                for x, d, i, k in zip(h.tolist(), doc.tolist(), at.tolist(), skip.tolist(), strict=True):
                    if ids[d] is not None:
                        for col, v in zip(out, (ids[d], i - int(t.first[d]), width, x, t.slots_of(i, width, k)), strict=True):
                            col.append(v)
            yield _rows(*out)

    return docs.mapInArrow(run, _SCHEMA)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots) of every document that holds (part of) an item.

    n_windows matching template windows on one diagonal (the longest), of the item's
    item_windows, with n_slots consistently filled slot values. At least min_windows,
    or all of a shorter item, make a match.

    Null and empty texts and rows without an id match nothing. Rows that repeat an id
    count as one document or item. Items shorter than width are one window. Other
    columns are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    wins = materialize(spark, _item_windows(items, width).dropDuplicates(["id", "pos", "width", "h"]), "leak-items")
    widths = sorted(r["width"] for r in wins.select("width").distinct().collect())  # at most width values
    n = wins.select("h").distinct().count()
    wanted = None
    if n * 8 <= BROADCAST_BYTES:
        keys = wins.select("h").distinct().toPandas()["h"].to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(keys.astype(np.int64)))
    found = _document_windows(docs, widths, wanted).select(F.col("id").alias("doc_id"), F.col("pos").alias("at"), "h", "width", F.col("slots").alias("filled"))
    met = found.join(wins.select(F.col("id").alias("item_id"), "pos", "h", "width", "slots"), ["h", "width"])
    met = met.where(F.size("filled") == F.size("slots"))
    pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("slots", "filled"))))
    # A match word for word needs no slots; a template match needs consistent ones and enough words that are none.
    literal, words = F.sum(F.col("width") - F.size("slots")), F.sum("width")
    # Windows of mostly placeholders do not spoil the others: those alone are a match as well.
    sparse = F.size("slots") * 2 <= F.col("width")
    few = F.array_distinct(F.flatten(F.collect_list(F.when(sparse, F.arrays_zip("slots", "filled")))))
    runs = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.count_distinct("pos").alias("all"), F.count_distinct(F.when(F.size("slots") == 0, F.col("pos"))).alias("exact"),
        (literal * LITERAL_SHARE >= words).alias("telling"), pairs.alias("pairs"),
        F.count_distinct(F.when(sparse, F.col("pos"))).alias("sparse"), few.alias("few"))

    def consistent(col):
        return F.size(F.array_distinct(F.transform(col, lambda p: p["slots"]))) == F.size(col)

    whole, some = consistent("pairs") & F.col("telling"), consistent("few") & (F.col("sparse") > F.col("exact"))
    runs = runs.select(
        "doc_id", "item_id", F.when(consistent("few"), F.col("sparse")).otherwise(0).alias("sparse"),
        F.when(whole, F.col("all")).when(some, F.col("sparse")).otherwise(F.col("exact")).alias("n_windows"),
        F.when(whole, F.size("pairs")).when(some, F.size("few")).otherwise(0).alias("filled"))
    runs = runs.where("n_windows > 0").groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max_by("filled", "n_windows").alias("n_slots"), F.max("sparse").alias("sparse"))
    crowded = wins.where(F.size("slots") * 2 > F.col("width")).groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("pos").alias("crowded"))
    sizes = wins.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("pos").alias("item_windows")).join(crowded, "item_id", "left")
    others = F.col("item_windows") - F.coalesce("crowded", F.lit(0))
    enough = F.col("n_windows") >= F.least(F.col("item_windows"), F.lit(min_windows))
    out = runs.join(sizes, "item_id").where(enough | (others > 0) & (F.col("sparse") >= F.least(others, F.lit(min_windows))))
    return out.select("doc_id", "item_id", "n_windows", "item_windows", "n_slots")


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    leaked = materialize(spark, find_leaks(spark, docs, benchmark).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
