"""Sparse products block by block: sums of a block's rows are made in one task.

A block is a share of the rows of a product. Its task gets, for every pivot that the
block has entries of, those entries and the pivot's whole list, and sums the products of
a block at a time, so no row of a pair is ever shuffled. What travels is packed: the
lists of a block's pivots one after the other, a column each, in the smallest type that
holds every value, compressed. Blocks are dealt out by hash so that each has about WORK
products. A row with more products than that alone is left to a join, whose partial sums
come from many tasks. Where what leaves the blocks is small, blocks go in rounds of
about ROUND products: a round's shuffle files go before the next one begins.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from harrow.functions.expressions import cosine
from harrow.sources.scratch import stored

#: Products of a block, about; entries of a pivot that travel as one list; products expanded at once.
WORK, HEAVY, EXPANDED = 4_000_000, 5_000, 1 << 20
#: Products of a round, about, as long as there are no more rounds than this.
ROUND, ROUNDS = 256_000_000, 16
#: Rows that are broadcast to a join at most, and rows of a batch that leaves a task.
BROADCAST_ROWS, OUT_ROWS = 100_000, 1 << 17
_LOW = np.uint64(0xFFFFFFFF)
_NOT = np.uint64(0xFFFFFFFFFFFFFFFF)


class Sums:
    """Sums of several values by key, added in bulk; memory is that of the distinct keys. The last `same` values are equal for a key and stay as they are."""

    def __init__(self, n: int, same: int = 0):
        self.n, self.keys, self.values, self.parts, self.size = n, np.zeros(0, np.uint64), [np.zeros(0)] * (n + same), [], 0

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((keys, values))
        self.size += len(keys)
        if self.size > max(4 * EXPANDED, 2 * len(self.keys)):
            self.close()

    def close(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.size:
            keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
            columns = [[v, *(p[n] for _, p in self.parts)] for n, v in enumerate(self.values)]
            self.parts, self.size = [], 0
            by = np.argsort(keys)
            keys = keys[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.values = [np.add.reduceat(np.concatenate(c)[by], first) if n < self.n else np.concatenate(c)[by[first]] for n, c in enumerate(columns)]
            self.keys = keys[first]
        return self.keys, self.values


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in one array and where each list begins (n + 1 places)."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(sizes)])


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the entries of lists that begin somewhere, one list after the other."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(starts[-1]) - np.repeat(starts[:-1] - begin, sizes)


def _squeezed(a: np.ndarray, steps: bool = False) -> bytes:
    """An array in the smallest type that holds each of its values, byte by byte, compressed; steps: as differences of numbers below 2^32."""
    if steps:
        a = np.diff(a.astype(np.uint32), prepend=np.uint32(0))
    elif a.dtype.kind == "f" and a.min() >= 0 and a.max() < 1 << 32 and not np.signbit(a).any() and np.array_equal(whole := a.astype(np.uint32), a):
        a = whole
    if a.dtype.kind != "f":
        a = a.astype(np.min_scalar_type(a.max()))
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()
    return struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _opened(part: bytes, steps: bool = False) -> np.ndarray:
    kind, size, n = struct.unpack_from("<cBQ", part)
    raw = pa.Codec("zstd").decompress(memoryview(part)[struct.calcsize("<cBQ"):], n * size, asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<{kind.decode()}{size}").ravel()
    return np.cumsum(a, dtype=np.uint32) if steps else a


def _packs(lo: int, hi: int, left: list[str], right: list[str], above: bool):
    """From lists of entries (l_block, l_<left>, and r_<right> unless both are one list) to (block, parts): the entries
    of the blocks from lo to hi by block and list, each with the right list; above: with what comes after them in their list."""

    def run(batches):
        for b in batches:
            block, first = _lists(b.column("l_block"))
            l_cols = [_lists(b.column(f"l_{c}"))[0] for c in left]
            one = "r_x" not in b.schema.names
            r_cols = [_lists(b.column(f"l_{c}" if one else f"r_{c}"))[0] for c in right]
            r_first = first if one else _lists(b.column("r_x"))[1]
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            use = np.flatnonzero((block >= lo) & (block < hi))
            by = use[np.lexsort((use, row[use], block[use]))]
            if not len(by):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(block[by]) != 0) | (np.diff(row[by]) != 0)]))
            sizes, owner = np.diff(np.append(starts, len(by))), row[by[starts]]
            begin = by[starts] + 1 if above and one else r_first[owner]
            lengths = r_first[owner + 1] - begin
            some = lengths > 0
            starts, sizes, begin, lengths = starts[some], sizes[some], begin[some], lengths[some]
            blocks, ends, at = block[by[starts]], np.cumsum(lengths), 0
            while at < len(starts):
                # A row for each block, of so many entries at most.
                to = min(int(np.searchsorted(blocks, blocks[at], "right")), max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right"))))
                mine, theirs = by[_places(starts[at:to], sizes[at:to])], _places(begin[at:to], lengths[at:to])
                parts = [_squeezed(sizes[at:to]), _squeezed(lengths[at:to])]
                parts += [_squeezed(c[mine], name == "x") for name, c in zip(left, l_cols, strict=True)]
                parts += [_squeezed(c[theirs], name == "x") for name, c in zip(right, r_cols, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([blocks[at]], pa.int32()), pa.array([parts], pa.list_(pa.binary()))], names=["block", "parts"])
                at = to

    return run


class _Pack:
    """The arrays of a pack: l and r, by name; x as they are, other columns as numbers."""

    def __init__(self, parts: list[bytes], left: list[str], right: list[str]):
        self.sizes, self.lengths = (_opened(p).astype(np.int64) for p in parts[:2])
        columns = [_opened(p, c == "x").astype(np.uint64 if c == "x" else np.float64) for p, c in zip(parts[2:], [*left, *right], strict=True)]
        self.l, self.r = dict(zip(left, columns, strict=False)), dict(zip(right, columns[len(left):], strict=True))

    def products(self):
        """The products as (left place, right place), at most about EXPANDED at once."""
        pack = np.repeat(np.arange(len(self.sizes)), self.sizes)
        begin = np.concatenate([[0], np.cumsum(self.lengths)])
        sizes = self.lengths[pack]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(pack):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
            yield np.repeat(np.arange(at, to), sizes[at:to]), _places(begin[pack[at:to]], sizes[at:to])
            at = to


def _by_block(new: Callable, step: Callable, finish: Callable, left: list[str], right: list[str]):
    """A task over packs sorted by block: what step(sums, pack, left places, right places) adds up, one block after the other, finished into record batches."""

    def run(batches):
        at, sums = None, None
        for whole in batches:
            for block, parts in zip(whole.column("block").to_pylist(), whole.column("parts"), strict=True):
                if block != at:
                    if sums is not None:
                        yield from finish(sums)
                    at, sums = block, new()
                pack = _Pack(parts.as_py(), left, right)
                for l, r in pack.products():
                    step(sums, pack, l, r)
        if sums is not None:
            yield from finish(sums)

    return run


def _batches(**columns: np.ndarray):
    """Record batches of these columns."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + OUT_ROWS]) for c in columns.values()], names=list(columns))


def _ends(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & _LOW).astype(np.int64)


def _best(x: np.ndarray, y: np.ndarray, score: np.ndarray, k: int, digits: int) -> np.ndarray:
    """Places of the k best y of each x by score at so many digits, smaller y first on ties, in order."""
    by = np.lexsort((y, -np.round(score, digits), x))
    place = np.arange(len(by)) - np.searchsorted(x[by], x[by])
    return by[place < k]


def _cosines(dot: np.ndarray, ss1: np.ndarray, ss2: np.ndarray) -> np.ndarray:
    return np.divide(dot, np.sqrt(ss1) * np.sqrt(ss2), out=np.zeros(len(dot)), where=(dot != 0) & (ss1 != 0) & (ss2 != 0))


def _block_count(r: DataFrame, load: int | None, work: int) -> int:
    """Blocks of about work products; beyond a few, as many as fill all shuffle partitions alike."""
    n, wide = -(-(load or 0) // work), int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, n if 2 * n < wide else -(-n // wide) * wide)


def _dealt(packs: DataFrame, lo: int, n_blocks: int) -> DataFrame:
    """Packs by block, blocks dealt out evenly: one a partition, unless there are very many."""
    n = min(n_blocks, max(2000, int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = packs.repartitionById(n, F.pmod(F.col("block") - lo, F.lit(n)).cast("int"))
    return out if n == n_blocks else out.sortWithinPartitions("block")


_PACKED = "block int, parts array<binary>"


def in_rounds(make: Callable[[int, int], DataFrame], n_blocks: int, load: int, size: int) -> DataFrame:
    """What make gives for the blocks from lo to hi, all of them; round by round, stored, where they hold more than size products."""
    rounds = max(1, min(ROUNDS, n_blocks, -(-load // size)))
    if rounds == 1:
        return make(0, n_blocks)
    width, out = -(-n_blocks // rounds), None
    for lo in range(0, n_blocks, width):
        part = stored(make(lo, min(lo + width, n_blocks)), "round")
        out = part if out is None else out.unionByName(part)
    return out


def chunked(r: DataFrame, pivot: str, columns: dict, heavy: int = HEAVY) -> DataFrame:
    """(pivot, __s, __k, l): lists of structs of columns, in order; those of pivots of more than heavy entries cut into __s lists of about that size."""
    sizes = r.groupBy(pivot).agg(F.ceil(F.count(F.lit(1)) / heavy).cast("int").alias("__s"))
    rows = r.join(sizes, pivot).withColumn("__k", F.when(F.col("__s") > 1, F.pmod(F.xxhash64(*[c for c in r.columns if c != pivot]), "__s")).otherwise(0))
    return rows.groupBy(pivot, "__s", "__k").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(name) for name, c in columns.items())))).alias("l"))


class Odd(ValueError):
    """Ids or values that blocks have no room for."""


class Pairs:
    """All pairs of entities in column x of r(u, i, r) that share a pivot, block by block; above: each pair once, the smaller id first.

    r is best a stored table, it is read several times. squares names sums of r * r of an
    entity that its entries carry, where a condition on r holds; marks names expressions
    that they carry besides. Where ids are no numbers below 2^32 or values are null, odd is
    set and nothing else is made.
    """

    def __init__(self, r: DataFrame, x: str, pivot: str, squares: dict, above: bool, work: int | None = None, heavy: int | None = None, marks: dict | None = None):
        work, heavy, marks = work or WORK, heavy or HEAVY, marks or {}
        self.kind, self.x, self.pivot, self.above, self.heavy, self.carried = r.schema[x].dataType, x, pivot, above, heavy, [*squares, *marks]
        # Whether ids or values are such that only a join gives what SQL gives.
        self.odd = not isinstance(self.kind, IntegralType)
        if self.odd:
            return
        degrees = r.groupBy(pivot).agg(F.count(F.lit(1)).alias("__d"))
        squares = [F.coalesce(F.sum(F.when(F.expr(when), F.col("r") * F.col("r"))), F.lit(0.0)).alias(name) for name, when in squares.items()]
        nulls = F.sum(F.col("r").isNull().cast("long")).alias("nulls")
        of_x = stored(r.where(F.col(x).isNotNull()).join(degrees, pivot).groupBy(x).agg(F.sum("__d").alias("load"), nulls, *squares), "loads")
        hot = F.col("load") > work
        total = of_x.agg(
            F.sum(F.when(~hot, F.col("load"))).alias("load"), F.sum(F.when(hot, 1).otherwise(0)).alias("hot"), F.count(F.lit(1)).alias("n"),
            F.sum("nulls").alias("nulls"), F.min(x).alias("least"), F.max(x).alias("most")).first()
        self.odd = bool(total["n"]) and (total["nulls"] > 0 or total["least"] < 0 or total["most"] > int(_LOW))
        self.load, self.hot = total["load"] or 0, total["hot"] or 0
        self.load //= 2 if above else 1
        self.n_blocks = _block_count(r, self.load, work)
        if self.odd:
            return
        block = F.when(hot, -1).otherwise(F.pmod(F.xxhash64(x), F.lit(self.n_blocks))).cast("int")
        of_x = of_x.withColumn("block", block).drop("load", "nulls")
        entries = r.join(F.broadcast(of_x) if total["n"] <= BROADCAST_ROWS else of_x, x).withColumns({c: F.expr(e) for c, e in marks.items()})
        self.entries = entries.select(pivot, F.col(x).cast("long").alias(x), F.col("r").cast("double").alias("r"), *self.carried, "block")
        lists = chunked(self.entries, pivot, {"x": x, "value": "r"} | {c: c for c in [*self.carried, "block"]}, heavy)
        self.lists = stored(lists.where((F.col("__s") > 1) | (F.size("l") > 1)), "lists")
        self.cut = not self.lists.where("__s > 1").isEmpty()

    def summed(self, lo: int, hi: int, new: Callable, step: Callable, finish: Callable, schema: str, left: list[str], right: list[str]) -> DataFrame:
        """What finish makes of the sums of each of the blocks from lo to hi; left and right: the columns that its products need."""
        l_cols, r_cols = ([F.col(f"l.{c}").alias(f"{side}_{c}") for c in dict.fromkeys(columns)] for side, columns in (("l", [*left, *right, "block"]), ("r", right)))
        task = _packs(lo, hi, left, right, self.above)
        packs = self.lists.where("__s = 1").select(*l_cols).mapInArrow(task, _PACKED)
        if self.cut:
            cut = self.lists.where("__s > 1")
            both = cut.select(self.pivot, *l_cols).join(cut.select(self.pivot, *r_cols), self.pivot).drop(self.pivot)
            packs = packs.unionByName(both.mapInArrow(task, _PACKED))
        return _dealt(packs, lo, hi - lo).mapInArrow(_by_block(new, step, finish, left, right), schema)

    def hot_pairs(self) -> DataFrame:
        """(x1, x2, r1, r2, and what entries carry with 1 and 2): the pairs of rows that are too long for a block, product by product.

        Pivots of more than heavy entries are dealt out in slices of the left side, each
        joined to the whole right side.
        """
        sizes = self.entries.groupBy(self.pivot).agg(F.ceil(F.count(F.lit(1)) / self.heavy).cast("int").alias("__s"))
        rows = self.entries.join(sizes, self.pivot)
        one, two = ([self.pivot, F.col(self.x).alias(f"x{n}"), F.col("r").alias(f"r{n}"), *(F.col(c).alias(f"{c}{n}") for c in self.carried)] for n in (1, 2))
        left = rows.where("block < 0").select(*one, F.pmod(F.xxhash64(self.x), F.col("__s")).cast("int").alias("__k"))
        right = rows.select(*two, F.explode(F.sequence(F.lit(0), F.col("__s") - 1)).alias("__k"))
        return left.join(right, [self.pivot, "__k"]).where("x1 < x2" if self.above else "x1 <> x2")

    def ids(self, *columns: str) -> list:
        """Columns of ids in the type that r has them in."""
        return [F.col(c).cast(self.kind).alias(c) for c in columns]


def _keys(pack: _Pack, l: np.ndarray, r: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of products, and the places of those that are pairs."""
    x, y = pack.l["x"][l], pack.r["x"][r]
    some = x < y if above else x != y
    if not some.all():
        x, y, l, r = x[some], y[some], l[some], r[some]
    return (x << np.uint64(32)) | y, l, r


class _Cosines:
    """Sums of a block with the squares of its own rows."""

    def __init__(self, n: int, same: int):
        self.sums, self.own = Sums(n, same), []

    def squares(self, a: np.ndarray, name: str) -> np.ndarray:
        ids, values = (np.concatenate(c) for c in zip(*((p["x"], p[name]) for p in self.own), strict=True))
        ids, where = np.unique(ids, return_index=True)
        return values[where][np.searchsorted(ids, a.astype(np.uint64))]


def top_neighbors(r: DataFrame, x: str, pivot: str, k: int, min_common: int = 1, digits: int = 9, work: int | None = None, heavy: int | None = None, size: int | None = None) -> DataFrame:
    """(x, nb, sim, rk): the k neighbours of largest cosine of every entity in column x of r(u, i, r), id 0 left out.

    Ids are below 2^32. Same rows as ranking all pairs; r should be a stored table, it
    is read several times.
    """
    pairs = Pairs(r.where(F.col(x) != 0), x, pivot, {"ss": "true"}, False, work, heavy)
    if pairs.odd:
        raise Odd("ids must be from 0 to 2^32 - 1 and values not null")
    counted = min_common > 1

    def step(found: _Cosines, pack: _Pack, l: np.ndarray, r: np.ndarray) -> None:
        if not found.own or found.own[-1] is not pack.l:
            found.own.append(pack.l)
        keys, l, r = _keys(pack, l, r, False)
        found.sums.add(keys, pack.l["value"][l] * pack.r["value"][r], *[np.ones(len(l))] * counted, pack.r["ss"][r])

    def finish(found: _Cosines):
        keys, (dot, *count, ss) = found.sums.close()
        if counted:
            some = count[0] >= min_common
            keys, dot, ss = keys[some], dot[some], ss[some]
        a, b = _ends(keys)
        sim = _cosines(dot, found.squares(a, "ss"), ss)
        best = _best(a, b, sim, k, digits)
        a, b, sim = a[best], b[best], sim[best]
        rank = np.arange(len(a)) - np.searchsorted(a, a) + 1
        yield from _batches(x=a, nb=b, sim=sim, rk=rank.astype(np.int32))

    as_given, columns = [*pairs.ids("x", "nb"), "sim", "rk"], ["x", "value", "ss"]
    near = in_rounds(
        lambda lo, hi: pairs.summed(lo, hi, lambda: _Cosines(1 + counted, 1), step, finish, "x long, nb long, sim double, rk int", columns, columns).select(as_given),
        pairs.n_blocks, pairs.load, size or ROUND)
    if not pairs.hot:
        return near
    # Rows of more products than a block: partial sums by pair, the pivots' lists in slices.
    sums = pairs.hot_pairs().groupBy("x1", "x2", "ss1", "ss2").agg(F.sum(F.col("r1") * F.col("r2")).alias("dot"), F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_common)
    sims = sums.select(F.col("x1").alias("x"), F.col("x2").alias("nb"), cosine("dot", "ss1", "ss2").alias("sim"))
    order = Window.partitionBy("x").orderBy(F.round("sim", digits).desc(), "nb")
    return near.unionByName(sims.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select(as_given))


def pair_sums(pairs: Pairs) -> DataFrame:
    """(x1, x2, dot, cnt) of Pairs: products and number of pivots."""

    def step(sums: Sums, pack: _Pack, l: np.ndarray, r: np.ndarray) -> None:
        keys, l, r = _keys(pack, l, r, pairs_above)
        sums.add(keys, pack.l["value"][l] * pack.r["value"][r], np.ones(len(l)))

    def finish(sums: Sums):
        keys, (dot, count) = sums.close()
        a, b = _ends(keys)
        yield from _batches(x1=a, x2=b, dot=dot, cnt=count.astype(np.int64))

    pairs_above, as_given = pairs.above, [*pairs.ids("x1", "x2"), "dot", "cnt"]
    out = pairs.summed(0, pairs.n_blocks, lambda: Sums(2), step, finish, "x1 long, x2 long, dot double, cnt long", ["x", "value"], ["x", "value"]).select(as_given)
    if not pairs.hot:
        return out
    return out.unionByName(pairs.hot_pairs().groupBy("x1", "x2").agg(F.sum(F.col("r1") * F.col("r2")).alias("dot"), F.count(F.lit(1)).alias("cnt")).select(as_given))


def pair_count(pairs: Pairs, size: int | None = None) -> DataFrame:
    """(n): how many pairs there are."""

    def step(sums: Sums, pack: _Pack, l: np.ndarray, r: np.ndarray) -> None:
        sums.add(_keys(pack, l, r, pairs_above)[0])

    pairs_above = pairs.above
    finish = lambda sums: _batches(n=np.array([len(sums.close()[0])]))
    out = in_rounds(lambda lo, hi: pairs.summed(lo, hi, lambda: Sums(0), step, finish, "n long", ["x"], ["x"]), pairs.n_blocks, pairs.load, size or ROUND)
    if pairs.hot:
        out = out.unionByName(pairs.hot_pairs().select("x1", "x2").distinct().agg(F.count(F.lit(1)).alias("n")))
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def pair_cosines(pairs: Pairs, min_common: int = 1, size: int | None = None) -> DataFrame:
    """(x1, x2, sim) of Pairs whose entries carry ss, those of at least min_common pivots.

    Entries may carry ss_old and fresh (1 or 0, as the pivot says) as well: then pairs
    without a fresh pivot have the similarity that ss_old gives.
    """
    above, counted, kept = pairs.above, min_common > 1, "fresh" in pairs.carried
    squares = ["ss", "ss_old"] if kept else ["ss"]
    columns = ["x", "value", *squares, *["fresh"] * kept]

    def step(found: _Cosines, pack: _Pack, l: np.ndarray, r: np.ndarray) -> None:
        if not found.own or found.own[-1] is not pack.l:
            found.own.append(pack.l)
        keys, l, r = _keys(pack, l, r, above)
        found.sums.add(keys, pack.l["value"][l] * pack.r["value"][r], *[np.ones(len(l))] * counted, *[pack.r["fresh"][r]] if kept else [], *(pack.r[c][r] for c in squares))

    def finish(found: _Cosines):
        keys, values = found.sums.close()
        if counted:
            some = values[1] >= min_common
            keys, values = keys[some], [v[some] for n, v in enumerate(values) if n != 1]
        a, b = _ends(keys)
        theirs = dict(zip(squares, values[1 + kept:], strict=True))
        sims = {c: _cosines(values[0], found.squares(a, c), theirs[c]) for c in squares}
        yield from _batches(x1=a, x2=b, sim=np.where(values[1] > 0, sims["ss"], sims["ss_old"]) if kept else sims["ss"])

    made = lambda lo, hi: pairs.summed(lo, hi, lambda: _Cosines(1 + counted + kept, len(squares)), step, finish, "x1 long, x2 long, sim double", columns, columns).select(as_given)
    as_given = [*pairs.ids("x1", "x2"), "sim"]
    # All pairs are more than what is sent for them: only a choice of them is stored round by round.
    out = in_rounds(made, pairs.n_blocks, pairs.load, size or ROUND) if counted else made(0, pairs.n_blocks)
    if not pairs.hot:
        return out
    by = [f"{c}{n}" for c in ("x", *squares) for n in (1, 2)]
    sums = pairs.hot_pairs().groupBy(*by).agg(F.sum(F.col("r1") * F.col("r2")).alias("dot"), F.count(F.lit(1)).alias("cnt"), *[F.max("fresh1").alias("fresh")] * kept).where(F.col("cnt") >= min_common)
    sim = cosine("dot", "ss1", "ss2")
    sim = F.when(F.col("fresh") > 0, sim).otherwise(cosine("dot", "ss_old1", "ss_old2")) if kept else sim
    return out.unionByName(sums.withColumn("sim", sim).select(as_given))


def pairs_in_common(pairs: Pairs, size: int | None = None) -> DataFrame:
    """(x1, x2, pivots) of Pairs whose entries carry their pivot as mark: which pivots they share, ascending, where these are two or more."""
    above = pairs.above

    def step(found: list, pack: _Pack, l: np.ndarray, r: np.ndarray) -> None:
        keys, l, _ = _keys(pack, l, r, above)
        found.append((keys, pack.l["mark"][l].astype(np.int64)))

    def finish(found: list):
        keys, marks = (np.concatenate(c) for c in zip(*found, strict=True))
        found.clear()
        by = np.argsort(keys)
        keys, marks = keys[by], marks[by]
        twice = np.zeros(len(keys), bool)
        twice[1:] = keys[1:] == keys[:-1]
        twice[:-1] |= twice[1:]
        keys, marks = keys[twice], marks[twice]
        by = np.lexsort((marks, keys))
        keys, marks = keys[by], marks[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(keys))
        a, b = _ends(keys[first])
        for at in range(0, len(first), 4096):
            lo, hi = first[at], ends[min(at + 4096, len(first)) - 1]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first[at:at + 4096], hi) - lo, pa.int32()), pa.array(marks[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(a[at:at + 4096]), pa.array(b[at:at + 4096]), lists], names=["x1", "x2", "pivots"])

    as_given = [*pairs.ids("x1", "x2"), "pivots"]
    return in_rounds(
        lambda lo, hi: pairs.summed(lo, hi, list, step, finish, "x1 long, x2 long, pivots array<long>", ["x", "mark"], ["x"]).select(as_given),
        pairs.n_blocks, pairs.load, size or ROUND)


def top_sums(left: DataFrame, right: DataFrame, n: int, seen: DataFrame | None = None, digits: int = 6, work: int | None = None, heavy: int | None = None, size: int | None = None) -> DataFrame:
    """(row, col, score, rk): the n columns of largest score of every row, score(row, col) = sum over pivots of left * right.

    left(pivot, row, value), right(pivot, col, value); cells of seen(row, col) are left
    out. Ids are below 2^32. Rows of more than work products are summed by a join.
    """
    work, heavy = work or WORK, heavy or HEAVY
    width = right.groupBy("pivot").agg(F.count(F.lit(1)).alias("__d"))
    loads = stored(left.join(width, "pivot").groupBy("row").agg(F.sum("__d").alias("load")), "loads")
    is_hot = F.col("load") > work
    total = loads.agg(F.sum(F.when(~is_hot, F.col("load"))).alias("load"), F.sum(F.when(is_hot, 1).otherwise(0)).alias("hot")).first()
    load = total["load"] or 0
    n_blocks = _block_count(left, load, work)
    block = F.pmod(F.xxhash64(F.col("row").cast("long")), F.lit(n_blocks)).cast("int")
    light, marked, hot = left, seen, None
    if total["hot"]:
        names = loads.where(is_hot).select("row")
        names = F.broadcast(names) if total["hot"] <= BROADCAST_ROWS else names
        hot, light = left.join(names, "row", "left_semi"), left.join(names, "row", "left_anti")
        marked = seen.join(names, "row", "left_anti") if seen is not None else None
    entries = light.select("pivot", F.col("row").cast("long").alias("x"), F.col("value").cast("double").alias("value"), block.alias("block"))
    lists = right.select("pivot", F.col("col").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
    packed = lambda df, columns, side: chunked(df, "pivot", {c: c for c in columns}, heavy).select("pivot", *(F.col(f"l.{c}").alias(f"{side}_{c}") for c in columns))
    both = packed(entries, ["x", "value", "block"], "l").join(packed(lists, ["x", "value"], "r"), "pivot").drop("pivot")
    if marked is not None:
        # What is seen comes as products that are not numbers: no sum with one of them counts.
        cells = marked.select(F.col("row").alias("pivot"), F.col("col").cast("long").alias("x"), block.alias("block"), F.lit(1.0).alias("value"))
        own = [F.array(F.col("pivot").cast("long")).alias("l_x"), F.array(F.lit(float("nan"))).alias("l_value"), F.slice("r_block", 1, 1).alias("l_block")]
        both = both.unionByName(packed(cells, ["x", "value", "block"], "r").select(*own, "r_x", "r_value"))
    both, columns = stored(both, "lists"), ["x", "value"]

    def step(sums: Sums, pack: _Pack, l: np.ndarray, r: np.ndarray) -> None:
        sums.add((pack.l["x"][l] << np.uint64(32)) | pack.r["x"][r], pack.l["value"][l] * pack.r["value"][r])

    def finish(sums: Sums):
        keys, (score,) = sums.close()
        keys, score = keys[score == score], score[score == score]
        row, col = _ends(keys)
        best = _best(row, col, score, n, digits)
        row, col, score = row[best], col[best], score[best]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        yield from _batches(row=row, col=col, score=score, rk=rank.astype(np.int32))

    kinds = left.schema["row"].dataType, right.schema["col"].dataType
    as_given = [F.col("row").cast(kinds[0]).alias("row"), F.col("col").cast(kinds[1]).alias("col"), "score", "rk"]

    def made(lo: int, hi: int) -> DataFrame:
        packs = _dealt(both.mapInArrow(_packs(lo, hi, columns, columns, False), _PACKED), lo, hi - lo)
        return packs.mapInArrow(_by_block(lambda: Sums(1), step, finish, columns, columns), "row long, col long, score double, rk int").select(as_given)

    out = in_rounds(made, n_blocks, load, size or ROUND)
    if hot is None:
        return out
    sums = hot.select("pivot", "row", F.col("value").alias("v")).join(right, "pivot").groupBy("row", "col").agg(F.sum(F.col("v") * F.col("value")).alias("score"))
    if seen is not None:
        sums = sums.join(seen.select("row", "col"), ["row", "col"], "left_anti")
    order = Window.partitionBy("row").orderBy(F.round("score", digits).desc(), "col")
    return out.unionByName(sums.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= n).select(as_given))
