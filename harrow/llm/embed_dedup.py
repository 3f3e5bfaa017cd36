"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to the signs of random projections, concatenated into one
key, and orders the vectors of a label by it; neighbours within a window are compared
and those of enough cosine are joined. The union over the passes gives components.
Vectors are centred on their label's mean before they are projected: in a label whose
vectors all point one way the signs would say nothing otherwise.

The number of passes of a label follows from the data. The first ones measure, for every
vector, how many leading bits it takes until no more than a window of others shares
them, and how likely a pair at the threshold agrees in a bit, given the vector's distance
from the mean; passes go on until the expected share of the label's missed pairs falls
below MISS. A vector whose window is full of links needs no more: its group holds
together by them. Labels so crowded that MAX_PASSES would not do are compared block by
block instead, all of their vectors: no link is lost there.

The links of each vector are counted inside the components, exactly: blocks of vectors
that are near each other in a sorted order have a centre and a radius, by which most
pairs of blocks are links all or none; only the others are compared vector by vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import connected_components, materialize, small

WINDOW = 96
MISS = 1e-4
#: Passes that measure, and the most that are made: labels that need more are compared in blocks.
FIRST_PASSES, MAX_PASSES = 4, 64
KEY_BITS = 48
#: Vectors in a block of the exact comparison, blocks in a group whose centres are compared at once.
BLOCK, GROUP = 256, 512
#: Blocks of crowded labels are this many times as large: every two of them meet. They are compared in tiles of so many rows.
CROWDED, TILE = 32, 512
#: Room for rounding in angles.
SLACK = 1e-6
_SCALE = 1 << 30
_BINS = 200


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the list column at unit length in double precision, and which of them may link."""
    rows = column.to_pylist()
    size = max((len(r) for r in rows if r), default=1)
    x, good = np.zeros((len(rows), size)), np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r and None not in r:
            v = np.asarray(r, np.float64)
            if np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                v = v / top
                x[i, : len(v)] = v / math.sqrt(v @ v)
                good[i] = True
    return x, good


def _distinct_vectors(rows: DataFrame) -> DataFrame:
    """(label, size, vector, rep, copies): each vector that may link, once, with how many rows have it."""

    def run(batches):
        for b in batches:
            x, good = _unit(b.column("embedding"))
            keep = np.flatnonzero(good & np.array([v is not None for v in b.column("label").to_pylist()], bool))
            sizes = np.array([len(b.column("embedding")[int(i)]) for i in keep], np.int64)
            for size in np.unique(sizes):
                at = keep[sizes == size]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(at)), b.column("label").take(pa.array(at)), pa.array([x[i, :size].tobytes() for i in at], pa.binary())],
                    names=["vec_id", "label", "vector"])

    return rows.mapInArrow(run, "vec_id long, label long, vector binary")


def _means(vectors: DataFrame) -> DataFrame:
    """(label, size, mean) of vectors(label, vector). Summed in fixed point, so any order gives the same."""

    def run(batches):
        held: dict = {}
        for b in batches:
            for label, raw in zip(b.column("label").to_pylist(), b.column("vector").to_pylist(), strict=True):
                x = np.rint(np.frombuffer(raw) * _SCALE).astype(np.int64)
                n, total = held.get((label, len(x)), (0, 0))
                held[label, len(x)] = n + 1, total + x
            if len(held) > 10_000:
                yield from rows(held)
                held = {}
        yield from rows(held)

    def rows(held):
        for (label, size), (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([size], pa.int32()), pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["label", "size", "n", "total"])

    parts = vectors.select("label", "vector").mapInArrow(run, "label long, size int, n long, total array<long>")
    each = parts.select("label", "size", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "size", "at").agg((F.sum("x") / F.sum("n") / _SCALE).alias("x"))
    return each.groupBy("label", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"))


def _keys(x: np.ndarray, k: int) -> np.ndarray:
    planes = np.random.default_rng([5, x.shape[1], k]).standard_normal((x.shape[1], KEY_BITS))
    return ((x @ planes) > 0) @ (1 << np.arange(KEY_BITS, dtype=np.int64)[::-1])


ROW = "k int, label long, size int, key long, rep long, agree double, vector binary"


def _agreement(centred: np.ndarray, cosine: float) -> np.ndarray:
    """How likely a vector and one at the threshold, as far from the mean, agree in the sign of a projection."""
    r2 = np.einsum("ij,ij->i", centred, centred)
    return 1 - np.arccos(np.clip(1 - (1 - cosine) / np.maximum(r2, 1e-12), -1, 1)) / math.pi


def _passes(vectors: DataFrame, passes: range, cosine: float) -> DataFrame:
    """A row (ROW) per vector and pass below the vector's need, from vectors(label, rep, vector, mean, need)."""

    def run(batches):
        for b in batches:
            raw = b.column("vector").to_pylist()
            sizes = np.array([len(v) // 8 for v in raw], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = b.take(pa.array(at))
                centred = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), size) - np.asarray(part.column("mean").flatten()).reshape(len(at), size)
                agree = pa.array(_agreement(centred, cosine))
                need = np.asarray(part.column("need"))
                for k in passes:
                    of = np.flatnonzero(need > k)
                    if not len(of):
                        break
                    rows, take = part.take(pa.array(of)), pa.array(of)
                    same = lambda v: pa.array(np.full(len(of), v, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [same(k), rows.column("label"), same(size), pa.array(_keys(centred[of], k)), rows.column("rep"), agree.take(take), rows.column("vector")],
                        names=["k", "label", "size", "key", "rep", "agree", "vector"])

    return vectors.mapInArrow(run, ROW)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that the edges (i, j) reach."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        new = low.copy()
        for at in (i, j, low[i], low[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j) of n nodes are enough to connect what all of them connect."""
    chosen, low = np.zeros(0, np.int64), np.arange(n)
    while True:
        live = np.flatnonzero(low[i] != low[j])
        if not len(live):
            return chosen
        _, first = np.unique(low[i][live], return_index=True)
        chosen = np.concatenate([chosen, live[first]])
        low = _forest(n, i[chosen], j[chosen])


def _runs(frame: pd.DataFrame):
    """(first, end) of each stretch of one (k, label, size) in an ordered frame."""
    changed = (frame[["k", "label", "size"]].diff().fillna(0) != 0).any(axis=1).to_numpy()
    ends = np.concatenate([np.flatnonzero(changed), [len(frame)]])
    return zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)


def _joined(frame: pd.DataFrame, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Joins between rows at most window apart in an ordered frame, as (rep, rep of the root): at most one for each row.

    Also by label a histogram of how likely a pass finds a pair at the threshold, over the rows that have a row a window later.
    """
    rep, out, bins = frame["rep"].to_numpy(), [], {}
    for at, end in _runs(frame):
        if end - at < 2:
            continue
        x = np.frombuffer(b"".join(frame["vector"].iloc[at:end])).reshape(end - at, -1)
        hits, linked = [], np.zeros(end - at, np.int64)
        for lo in range(0, len(x), BLOCK):
            i, j = np.nonzero(x[lo : lo + BLOCK] @ x[lo : lo + BLOCK + window].T >= cosine)
            near = (j > i) & (j - i <= window)
            hits.append((i[near] + lo, j[near] + lo))
            linked[lo : lo + BLOCK] = np.bincount(i[near], minlength=min(BLOCK, len(x) - lo))
        low = _forest(len(x), *(np.concatenate(h) for h in zip(*hits, strict=True)))
        moved = np.flatnonzero(low != np.arange(len(x)))
        out.append((rep[at:end][moved], rep[at:end][low[moved]]))
        if len(x) > window:
            key, agree = frame["key"].to_numpy()[at:end], frame["agree"].to_numpy()[at : end - window]
            bits = KEY_BITS + 1 - np.ceil(np.log2((key[:-window] ^ key[window:]) + 1.0))  # the first bit that tells them apart
            found = np.where(linked[: len(agree)] == window, 1.0, agree**bits)
            label = int(frame["label"].iloc[at])
            bins[label] = bins.get(label, 0) + np.bincount((found * _BINS).astype(int), minlength=_BINS + 1)
    a, b = (np.concatenate(h) for h in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return a, b, bins


_FOUND = "a long, b long, bin int, part int, at long, " + ROW


def _found(**columns) -> pa.RecordBatch:
    """Rows of the window job: the given columns, all others null."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    fields = [f.split() for f in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in fields], names=[c for c, _ in fields])


def _window_joins(spark: SparkSession, vectors: DataFrame, passes: range, window: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of one component, from neighbours in these passes, and the histograms of _joined as (label, bin, n)."""
    order = ["k", "label", "size", "key", "rep"]
    ordered = _passes(vectors, passes, cosine).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        # Joins within the partition, chunk by chunk with an overlap. Its first and last rows go out for the seams, with their places.
        part, n, tail, bins = TaskContext.get().partitionId(), 0, None, {}
        for b in batches:
            frame = b.to_pandas()
            head = frame.iloc[: max(0, window - n)]
            if len(head):
                yield _found(part=np.full(len(head), part), at=n + np.arange(len(head)), **{c: head[c] for c in head})
            n += len(frame)
            frame = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
            x, y, more = _joined(frame, window, cosine)
            tail = frame.iloc[-window:].reset_index(drop=True)
            yield _found(a=np.minimum(x, y), b=np.maximum(x, y))
            for label, counts in more.items():
                bins[label] = bins.get(label, 0) + counts
            while len(bins) > 1:  # labels come in order, pass by pass
                yield tallied(next(iter(bins)), bins.pop(next(iter(bins))))
        if tail is not None:
            place = n - len(tail) + np.arange(len(tail))
            rest = tail[place >= window]  # the others have gone out as heads
            yield _found(part=np.full(len(rest), part), at=place[place >= window], **{c: rest[c] for c in rest})
            yield _found(part=np.array([part]), a=np.array([n]))
        for label, counts in bins.items():
            yield tallied(label, counts)

    def tallied(label: int, counts: np.ndarray) -> pa.RecordBatch:
        filled = np.flatnonzero(counts)
        return _found(label=np.full(len(filled), label), bin=filled, a=counts[filled])

    found = materialize(spark, ordered.mapInArrow(run, _FOUND), "ed-windows")
    sizes = {r["part"]: r["a"] for r in found.where("part is not null and at is null").select("part", "a").collect()}
    bins = found.where("bin is not null").groupBy("label", "bin").agg(F.sum("a").alias("n"))
    parts = np.array(sorted(sizes), np.int64)
    begins = np.concatenate([[0], np.cumsum([sizes[p] for p in parts])])
    starts = spark.sparkContext.broadcast((parts, begins[:-1], begins[1:-1]))  # a few numbers for each partition

    def seams(batches):
        # A row goes to every border of partitions that is less than a window away, over as many short partitions as it takes.
        known, begin, borders = starts.value
        for b in batches:
            place = begin[np.searchsorted(known, b.column("part").to_numpy())] + b.column("at").to_numpy()
            lo, hi = np.searchsorted(borders, place - window, "right"), np.searchsorted(borders, place + window, "right")
            of = np.repeat(np.arange(len(place)), hi - lo)
            border = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[of]
            part = b.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([pa.array(border), *(part.column(f.split()[0]) for f in ROW.split(", "))], names=["border", *(f.split()[0] for f in ROW.split(", "))])

    def stitch(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = _joined(frame.sort_values(order, kind="stable").reset_index(drop=True), window, cosine)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    seam = found.where("at is not null").mapInArrow(seams, "border long, " + ROW).groupBy("border").applyInPandas(stitch, "a long, b long")
    return found.where("b is not null").select("a", "b").union(seam), bins


def passes_needed(bins: DataFrame, miss: float = MISS) -> DataFrame:
    """(label, need): passes until the expected share of a label's missed pairs, over its measured rows, is at most miss; MAX_PASSES + 1 if none of those do."""
    q = F.least(F.lit(1.0), (F.col("bin") + 0.5) / _BINS)
    tried = range(FIRST_PASSES, MAX_PASSES + 1)
    shares = bins.groupBy("label").agg(F.array(*(F.sum(F.col("n") * F.pow(1 - q, F.lit(k))) / F.sum("n") for k in tried)).alias("shares"))
    # Shares fall from pass to pass: as many as are above miss have to be added.
    return shares.select("label", (F.size(F.filter("shares", lambda x: x > miss)) + FIRST_PASSES).alias("need"))


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _blocks(spark: SparkSession, members: DataFrame, block: int, cosine: float) -> DataFrame:
    """Blocks of members(component, label, rep, copies, vector, mean) in a sorted order, with centre, radius and what is linked inside: near is one count a row."""

    def keyed(batches):
        for b in batches:
            raw = b.column("vector").to_pylist()
            keys = [int(_keys((np.frombuffer(v) - np.asarray(m))[None], 0)[0]) for v, m in zip(raw, b.column("mean").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("component"), pa.array(keys, pa.int64()), b.column("rep"), b.column("copies"), b.column("vector")], names=["component", "key", "rep", "copies", "vector"])

    def run(batches):
        part, at, held = TaskContext.get().partitionId() << 32, 0, None
        for b in [*batches, None]:
            frame = b.to_pandas() if b is not None else None
            held = frame if held is None else held if frame is None else pd.concat([held, frame], ignore_index=True)
            if held is None or not len(held):
                continue
            component = held["component"].to_numpy()
            ends = np.concatenate([np.flatnonzero(component[1:] != component[:-1]) + 1, [len(held)]])
            lo = 0
            for end in ends:
                while lo < end:
                    hi = min(lo + block, end)
                    if frame is not None and hi == len(held) and hi - lo < block:
                        break  # may go on in the next batch
                    yield made(part + at, held.iloc[lo:hi])
                    lo, at = hi, at + 1
            held = held.iloc[lo:].reset_index(drop=True)

    def made(number, rows):
        x = np.frombuffer(b"".join(rows["vector"])).reshape(len(rows), -1)
        copies = rows["copies"].to_numpy(np.int64)
        centre = x.sum(axis=0)
        centre = centre / (math.sqrt(centre @ centre) or 1.0)
        near = x @ x.T >= cosine if len(x) <= TILE else None  # larger blocks are not counted inside
        if near is not None:
            np.fill_diagonal(near, False)
        columns = [
            [int(rows["component"].iloc[0])], [number], [rows["rep"].to_numpy(np.int64).tobytes()], [copies.tobytes()], [x.tobytes()],
            [centre.tobytes()], [float(_angle(x @ centre).max()) + SLACK], [int(copies.sum())], [(near @ copies).tobytes() if near is not None else None]]
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["component", "block", "reps", "copies", "vectors", "centre", "radius", "total", "near"])

    ordered = members.mapInArrow(keyed, "component long, key long, rep long, copies long, vector binary").repartitionByRange("component", "key", "rep").sortWithinPartitions("component", "key", "rep")
    return materialize(spark, ordered.mapInArrow(run, "component long, block long, reps binary, copies binary, vectors binary, centre binary, radius double, total long, near binary"), "ed-blocks")


def _block_joins(spark: SparkSession, members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(a, b) pairs of one component: whole members(component, ...), every block against every other that its centre and radius leave in reach."""
    blocks = _blocks(spark, members, block, cosine)
    met, data = _met_blocks(spark, blocks, cosine, joins=True)
    own = blocks.select(F.col("block"), F.col("block").alias("other"))
    close = met.where("other is not null").select("block", "other").union(own).join(data, "block").join(data.select(F.col("block").alias("other"), F.col("left").alias("right")), "other")

    def compare(batches):
        for b in batches:
            for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
                reps = [np.frombuffer(side["reps"], np.int64) for side in (left, right)]
                x, y = (np.frombuffer(side["vectors"]).reshape(len(r), -1) for side, r in zip((left, right), reps, strict=True))
                both, n = np.concatenate(reps), len(reps[0])
                kept = [(np.zeros(0, np.int64),) * 2]
                for lo in range(0, n, TILE):
                    i, j = np.nonzero(x[lo : lo + TILE] @ y.T >= cosine)
                    enough = _spanning(len(both), i + lo, n + j)
                    kept.append((i[enough] + lo, n + j[enough]))
                low = _forest(len(both), *(np.concatenate(k) for k in zip(*kept, strict=True)))
                moved = np.flatnonzero(low != np.arange(len(both)))
                a, c = both[moved], both[low[moved]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])

    return close.select("left", "right").mapInArrow(compare, "a long, b long").where("a <> b")


def _counted_links(spark: SparkSession, members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(rep, near): how many rows have another vector of the same component within the cosine."""
    blocks = _blocks(spark, members, block, cosine)
    met, data = _met_blocks(spark, blocks, cosine)
    close = met.where("other is not null and n is null").join(data, "block").join(data.select(F.col("block").alias("other"), F.col("left").alias("right")), "other").select("left", "right")

    def compare(batches):
        for b in batches:
            for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
                reps, copies = ([np.frombuffer(side[c], np.int64) for side in (left, right)] for c in _HELD_SIDE[:2])
                x, y = (np.frombuffer(side["vectors"]).reshape(len(r), -1) for side, r in zip((left, right), reps, strict=True))
                near = x @ y.T >= cosine
                for r, n in ((reps[0], near @ copies[1]), (reps[1], near.T @ copies[0])):
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n, pa.int64())], names=["rep", "near"])

    def inside(batches):
        for b in batches:
            for reps, near, n in zip(b.column("reps").to_pylist(), b.column("near").to_pylist(), b.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(reps, np.int64)), pa.array(np.frombuffer(near, np.int64) + n)], names=["rep", "near"])

    adds = met.where("n is not null").groupBy("block").agg(F.sum("n").alias("n"))
    own = blocks.select("block", "reps", "near").join(adds, "block", "left").select("reps", "near", F.coalesce("n", F.lit(0)).cast("long").alias("n")).mapInArrow(inside, "rep long, near long")
    return close.mapInArrow(compare, "rep long, near long").union(own).groupBy("rep").agg(F.sum("near").alias("near"))


_HELD_SIDE = ("reps", "copies", "vectors")


def _met_blocks(spark: SparkSession, blocks: DataFrame, cosine: float, joins: bool = False) -> tuple[DataFrame, DataFrame]:
    """Which blocks of a component have to be compared, (block, other), and how many links each row of a block surely has, (block, n);
    with joins also enough pairs of blocks all of whose rows are linked, (block, other, 0). Then the blocks' contents, (block, left)."""
    several = blocks.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"), F.count(F.lit(1)).alias("n")).where("n > 1")
    group = F.pmod(F.xxhash64("block"), F.col("groups")).alias("at")
    summary = blocks.join(several, "component").select("component", "groups", group, F.struct("block", "centre", "radius", "total").alias("of"))
    summary = materialize(spark, summary.groupBy("component", "groups", "at").agg(F.collect_list("of").alias("of")), "ed-groups")
    left = summary.select("component", F.col("at").alias("i"), F.col("of").alias("left"), F.explode(F.sequence(F.col("at"), F.col("groups") - 1)).alias("j"))
    pairs = left.join(summary.select("component", F.col("at").alias("j"), F.col("of").alias("right")), ["component", "j"]).select("i", "j", "left", "right")
    limit = math.acos(cosine)

    def classify(batches):
        # Of two blocks, by the angle of their centres: all pairs are links (added at once), none are, or they have to be compared.
        for b in batches:
            for i, j, *sides in zip(*(b.column(c).to_pylist() for c in ("i", "j", "left", "right")), strict=True):
                number, radius, total = (tuple(np.array([r[c] for r in side]) for side in sides) for c in ("block", "radius", "total"))
                centre = [np.frombuffer(b"".join(r["centre"] for r in side)).reshape(len(side), -1) for side in sides]
                angle, reach = _angle(centre[0] @ centre[1].T), radius[0][:, None] + radius[1][None, :]
                every = angle + reach <= limit - SLACK
                some = ~every & (angle - reach <= limit + SLACK)
                if i == j:
                    np.fill_diagonal(every, False)
                    some &= np.triu(np.ones_like(some), 1)
                adds = [(number[0], every @ total[1])] + ([(number[1], every.T @ total[0])] if i != j else [])
                for of, n in adds:
                    yield pa.RecordBatch.from_arrays([pa.array(of[n > 0], pa.int64()), pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(n[n > 0], pa.int64())], names=["block", "other", "n"])
                if joins:
                    x, y = np.nonzero(every)
                    kept = _spanning(len(number[0]) + (len(number[1]) if i != j else 0), x, y + (len(number[0]) if i != j else 0))
                    yield pa.RecordBatch.from_arrays([pa.array(number[0][x[kept]], pa.int64()), pa.array(number[1][y[kept]], pa.int64()), pa.array(np.zeros(len(kept), np.int64))], names=["block", "other", "n"])
                x, y = np.nonzero(some)
                yield pa.RecordBatch.from_arrays([pa.array(number[0][x], pa.int64()), pa.array(number[1][y], pa.int64()), pa.nulls(len(x), pa.int64())], names=["block", "other", "n"])

    met = materialize(spark, pairs.mapInArrow(classify, "block long, other long, n long"), "ed-pairs")
    return met, blocks.select("block", F.struct(*_HELD_SIDE).alias("left"))


def near_duplicate_vectors(spark: SparkSession, rows: DataFrame, cosine: float = 0.93, window: int = WINDOW, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows(vec_id, embedding, label, ...).

    Vectors of one label with a cosine of at least the threshold, in double precision,
    are linked; n_links counts a row's links, component_id is the smallest vec_id
    reachable, kept is vec_id = component_id. Vectors without a label, null, empty or
    zero ones, ones with null or non-finite components, and vectors of different
    lengths link with nothing. Equal vectors are compared once and counted each.
    Rows that repeat a vec_id each count; a row without one has n_links of its vector
    and takes its component. Other columns are ignored; no rows give no rows.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    each = materialize(spark, _distinct_vectors(rows), "ed-rows")
    vectors = each.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("rep is not null")
    vectors = materialize(spark, vectors, "ed-vectors")
    means = materialize(spark, _means(vectors), "ed-means")
    centred = vectors.withColumn("size", (F.octet_length("vector") / 8).cast("int")).join(small(means, 1 << 12), ["label", "size"])
    joins, bins = _window_joins(spark, centred.withColumn("need", F.lit(FIRST_PASSES)), range(FIRST_PASSES), window, cosine)
    need = materialize(spark, passes_needed(bins, miss).where(F.col("need") > FIRST_PASSES), "ed-needs")
    most = need.where(F.col("need") <= MAX_PASSES).agg(F.max("need")).first()[0]
    if most:
        more = centred.join(small(need.where(F.col("need") <= MAX_PASSES), 32), "label")
        joins = joins.union(_window_joins(spark, more, range(FIRST_PASSES, most), window, cosine)[0])
    crowded = need.where(F.col("need") > MAX_PASSES)
    if not crowded.isEmpty():
        # A label's vectors of one length stand for a component: its number is their smallest rep.
        whole = centred.join(small(crowded.select("label"), 16), "label")
        number = whole.groupBy("label", "size").agg(F.min("rep").alias("component"))
        whole = whole.join(small(number, 32), ["label", "size"]).select("component", "label", "rep", "copies", "vector", "mean")
        joins = joins.union(_block_joins(spark, whole, cosine, CROWDED * block))
    component = connected_components(spark, materialize(spark, joins.distinct(), "ed-joins"))
    members = centred.join(component, centred.rep == component.node).select("component", "label", "rep", "copies", "vector", "mean")
    near = _counted_links(spark, members, cosine, block)
    classes = vectors.join(component, vectors.rep == component.node, "left").join(near, "rep", "left").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    classes = materialize(spark, classes, "ed-classes")
    named = each.join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    named = materialize(spark, named.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "ed-named")
    out = rows.select("vec_id").join(named, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
