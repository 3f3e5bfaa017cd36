"""Hard negatives: a vantage-point tree over norm-augmented vectors.

A vector x gets one more coordinate, the root of M^2 - |x|^2, where M is the largest
norm; a query q gets a zero. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x: the larger the inner
product, the nearer, and a window of scores is an annulus of distances about the query.

The upper levels of the tree are fitted on a bounded sample and deal all vectors out to
leaves; a leaf is stored in blocks of bounded size, each with a tree of its own down to
buckets. Of every leaf and bucket the least and greatest distance to the vantage points
above it are kept, which bounds the distance of anything in it to a query. A search goes
over the leaves in rounds, nearest inside the annulus first, a growing number a round;
within a block it goes over the buckets in the same way. It stops where no leaf or
bucket can hold a better row than the k it has, so its result is exact. Scores are
integers and all comparisons of scores are exact; distances only ever leave room.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.common import materialize

#: Vectors that the upper tree is fitted on, about; leaves at most. Leaves grow with the root of the table before that.
SAMPLE, MAX_LEAVES = 16_384, 1024
#: Vectors of a block and of a bucket; queries that visit a block together.
BLOCK, BUCKET, PACK = 16_384, 128, 512
#: A round visits this many times the leaves of the rounds before it.
GROWTH = 8
#: Room for rounding in distances, as a share of M.
SLACK = 1e-6
_NONE = -(1 << 62)


class Space:
    """How vectors are held: dimensions, integer type, and the square of the largest norm."""

    def __init__(self, dims: int, dtype: str, square: int):
        self.dims, self.dtype, self.square = dims, dtype, float(square)
        self.slack = SLACK * max(1.0, self.square) ** 0.5
        self.exact = square < 1 << 52  # then products are exact in doubles

    def matrix(self, data) -> np.ndarray:
        x = np.frombuffer(data, self.dtype).reshape(-1, self.dims)
        return x.astype(np.float64 if self.exact else np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The coordinate that augments rows to norm M."""
        return np.sqrt(np.maximum(0.0, self.square - np.einsum("ij,ij->i", x, x).astype(np.float64)))

    def between(self, x, up, v, v_up) -> np.ndarray:
        """Distances of augmented rows x to augmented rows v."""
        return np.sqrt(np.maximum(0.0, 2 * (self.square - (x @ v.T).astype(np.float64) - np.outer(up, v_up))))

    def reached(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Distances of queries, whose added coordinate is zero, to rows v."""
        own = np.einsum("ij,ij->i", q, q).astype(np.float64)
        return np.sqrt(np.maximum(0.0, own[:, None] + self.square - 2 * (q @ v.T).astype(np.float64)))

    def scores(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (least, greatest) of the scores of what lies between near and far from the queries."""
        own = np.einsum("ij,ij->i", q, q).astype(np.float64)[:, None] + self.square
        room = 1 + 1e-9 * own
        return (own - (far + self.slack) ** 2) / 2 - room, (own - np.maximum(0.0, near - self.slack) ** 2) / 2 + room


def _best_vantage(space: Space, x: np.ndarray, up: np.ndarray, of: np.ndarray) -> tuple[int, np.ndarray]:
    """Of a few rows the one whose distances to the others spread most, and these distances."""
    tried = of[np.linspace(0, len(of) - 1, 4).astype(int)]
    distances = space.between(x[of], up[of], x[tried], up[tried])
    best = int(np.argmax(distances.std(axis=0)))
    return int(tried[best]), distances[:, best]


class Upper:
    """The upper levels: node i has a vantage row and a radius; inside goes to 2i, outside to 2i + 1. Leaves are 0 to leaves - 1."""

    def __init__(self, space: Space, x: np.ndarray, leaves: int):
        self.space, self.leaves, self.depth = space, leaves, leaves.bit_length() - 1
        up = space.lifted(x)
        self.vantage, self.vantage_up, self.radius = np.zeros((leaves, space.dims), x.dtype), np.zeros(leaves), np.full(leaves, np.inf)
        members = {1: np.arange(len(x))}
        for node in range(1, leaves):
            of = members.pop(node)
            if len(of):
                v, d = _best_vantage(space, x, up, of)
                self.vantage[node], self.vantage_up[node], self.radius[node] = x[v], up[v], np.median(d)
            inside = d <= self.radius[node] if len(of) else np.zeros(0, bool)
            members[2 * node], members[2 * node + 1] = of[inside], of[~inside]
        steps = np.arange(self.depth)
        #: The nodes above each leaf.
        self.path = ((np.arange(leaves) + leaves)[:, None] >> (self.depth - steps)).astype(np.int64)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, up = np.ones(len(x), np.int64), self.space.lifted(x)
        for _ in range(self.depth):
            product = np.einsum("ij,ij->i", x, self.vantage[node]).astype(np.float64) + up * self.vantage_up[node]
            d = np.sqrt(np.maximum(0.0, 2 * (self.space.square - product)))
            node = 2 * node + (d > self.radius[node])
        return node - self.leaves

    def spread(self, leaf: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of rows of a leaf to the vantage points above it."""
        above = self.path[leaf]
        d = self.space.between(x, self.space.lifted(x), self.vantage[above], self.vantage_up[above])
        return d.min(axis=0), d.max(axis=0)


def _grown(space: Space, x: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over the rows of a block: order, bucket ends, and for each bucket and level a vantage row (-1: none) and its interval."""
    up, ends, paths = space.lifted(x), [], []
    order, todo = [], [(np.arange(len(x)), [])]
    while todo:
        of, path = todo.pop()
        if len(of) > bucket:
            v, d = _best_vantage(space, x, up, of)
            inside = d <= np.median(d)
            if not inside.all():
                todo += [(of[side], [*path, (v, d[side].min(), d[side].max())]) for side in (~inside, inside)]
                continue
        # Rows at one distance from everything go on as buckets of bounded size.
        for lo in range(0, len(of), bucket):
            order.append(of[lo : lo + bucket])
            ends.append(len(order[-1]))
            paths.append(path)
    order, levels = np.concatenate(order), max(map(len, paths))
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    rows, spans = np.full((len(paths), levels), -1, np.int32), np.zeros((len(paths), levels, 2))
    for i, path in enumerate(paths):
        for level, (v, near, far) in enumerate(path):
            rows[i, level], spans[i, level] = place[v], (near, far)
    return order, np.cumsum(ends).astype(np.int32), rows, spans


def _bounds(d: np.ndarray, rows: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of queries to regions, from distances d to vantage points and the regions' intervals."""
    near, far = np.zeros((len(d), len(rows))), np.full((len(d), len(rows)), np.inf)
    for level in range(rows.shape[1]):
        some = rows[:, level] >= 0
        at, low, high = d[:, rows[some, level]], spans[some, level, 0], spans[some, level, 1]
        near[:, some] = np.maximum(near[:, some], np.maximum(at - high, low - at))
        far[:, some] = np.minimum(far[:, some], at + high)
    return near, far


class Queries:
    """Queries as arrays: key (anchor, number), label, vector, window [low, high] of scores and the score that a new row must reach."""

    FIELDS = {"anchor": "<i8", "number": "<i4", "kind": "<i8", "low": "<i8", "high": "<i8", "floor": "<i8"}
    SCHEMA = ", ".join(f"{n} binary" for n in FIELDS) + ", q binary"

    def __init__(self, space: Space, columns: dict, q: np.ndarray):
        self.space, self.columns, self.q = space, columns, q
        self.__dict__.update(columns)

    @classmethod
    def of_rows(cls, space: Space, batch: pa.RecordBatch) -> Queries:
        columns = {n: np.asarray(batch.column(n)).astype(t) for n, t in cls.FIELDS.items()}
        return cls(space, columns, space.matrix(b"".join(batch.column("q").to_pylist())))

    @classmethod
    def unpacked(cls, space: Space, row: dict) -> Queries:
        return cls(space, {n: np.frombuffer(row[n], t) for n, t in cls.FIELDS.items()}, space.matrix(row["q"]))

    def packed(self, which: np.ndarray) -> dict:
        return {n: c[which].tobytes() for n, c in self.columns.items()} | {"q": self.q[which].astype(self.space.dtype).tobytes()}

    def ranked(self, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the regions, best possible score first, and these scores; -inf where nothing of the window can lie."""
        least, most = self.space.scores(self.q, near, far)
        best = np.minimum(most, self.high[:, None])
        best[(most < self.low[:, None]) | (least > self.high[:, None])] = -np.inf
        order = np.argsort(-best, axis=1, kind="stable")
        return order, np.take_along_axis(best, order, axis=1)


def _found(space: Space, block: dict, queries: Queries, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of a block for each query as (query, id, score), those that reach its floor."""
    x, ids, kinds = block["x"], block["ids"], block["kinds"]
    starts = np.concatenate([[0], block["ends"][:-1]])
    vectors, of = np.unique(queries.q, axis=0, return_inverse=True)
    of = of.reshape(-1)
    used, rows = np.unique(block["rows"], return_inverse=True)
    rows = rows.reshape(block["rows"].shape) - (len(used) > 0 and used[0] < 0)
    d = space.reached(vectors, x[used[used >= 0]])
    near, far = _bounds(d, rows, block["spans"])
    order, best = queries.ranked(near[of], far[of])
    floor = np.maximum(queries.low, queries.floor)
    got = [np.zeros(0, np.int64)] * 3
    at, width = 0, 1
    while at < order.shape[1]:
        live = best[:, at : at + width] >= floor[:, None]
        if not live.any():
            break  # later ones are worse
        who, step = np.nonzero(live)
        bucket = order[who, at + step]
        by = np.argsort(bucket, kind="stable")
        who, bucket = who[by], bucket[by]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        more = [got]
        for lo, hi in zip(edges, np.append(edges[1:], len(who)), strict=True):
            mine, there = who[lo:hi], slice(starts[bucket[lo]], block["ends"][bucket[lo]])
            need, back = np.unique(of[mine], return_inverse=True)
            s = (vectors[need] @ x[there].T).astype(np.int64)[back]
            good = (s <= queries.high[mine, None]) & (s >= floor[mine, None]) & ((kinds[there] == queries.kind[mine, None]) == same)
            good &= ids[there] != queries.anchor[mine, None]
            i, j = np.nonzero(good)
            more.append([mine[i], ids[there][j], s[i, j]])
        got = [np.concatenate(c) for c in zip(*more, strict=True)]
        by = np.lexsort((got[1], -got[2], got[0]))
        got = [c[by] for c in got]
        place = np.arange(len(by)) - np.searchsorted(got[0], got[0])
        got = [c[place < k] for c in got]
        full = place[place < k] == k - 1
        floor[got[0][full]] = np.maximum(floor[got[0][full]], got[2][full])
        at, width = at + width, width * 2
    return got[0], got[1], got[2]


class Index:
    """All vectors as blocks of leaves, and what a search needs of the leaves: bounded, whatever the table."""

    def __init__(self, spark: SparkSession, space: Space, upper: Upper, blocks: DataFrame, chunks: dict[int, int], spans: np.ndarray):
        self.spark, self.space, self.chunks, self.blocks = spark, space, chunks, blocks
        self.live = np.array(sorted(chunks), np.int64)
        self.shared = spark.sparkContext.broadcast((upper, self.live, spans))

    def visits(self, queries: DataFrame, since: int, to: int) -> DataFrame:
        """Queries packed by the leaf that they visit: the since-th to to-th best of each, as far as it can hold a row that reaches the floor."""
        space, shared, chunks = self.space, self.shared, self.chunks

        def run(batches):
            upper, live, spans = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, PACK):
                    q = Queries.of_rows(space, batch.slice(lo, PACK))
                    order, best = q.ranked(*_bounds(space.reached(q.q, upper.vantage), upper.path[live], spans))
                    go = best[:, since:to] >= np.maximum(q.low, q.floor)[:, None]
                    who, step = np.nonzero(go)
                    leaf = live[order[who, since + step]]
                    out = []
                    for n in np.unique(leaf):
                        pack = q.packed(who[leaf == n])
                        out += [pack | {"leaf": int(n), "chunk": c} for c in range(chunks[int(n)])]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=_VISITS)

        return queries.mapInArrow(run, f"leaf int, chunk int, {Queries.SCHEMA}")

    def search(self, queries: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(anchor, number, id, score, rank): the best k rows of each query's window with its label, or with another one.

        queries is a stored table (anchor, number, kind, low, high, q) with different
        keys (anchor, number). Rows with the anchor's id are left out.
        """
        space = self.space
        best = None
        since, to = 0, 1

        def run(batches):
            block = None
            for b in batches:
                for row in b.to_pylist():
                    if block is None or block["key"] != (row["leaf"], row["chunk"]):
                        block = {
                            "key": (row["leaf"], row["chunk"]), "x": space.matrix(row["vectors"]), "ids": np.frombuffer(row["ids"], "<i8"), "kinds": np.frombuffer(row["kinds"], "<i8"),
                            "ends": np.frombuffer(row["ends"], "<i4"),
                        }
                        n = len(block["ends"])
                        block["rows"] = np.frombuffer(row["rows"], "<i4").reshape(n, -1) if row["rows"] else np.zeros((n, 0), np.int32)
                        block["spans"] = np.frombuffer(row["spans"], "<f8").reshape(n, -1, 2) if row["spans"] else np.zeros((n, 0, 2))
                    q = Queries.unpacked(space, row)
                    who, ids, score = _found(space, block, q, same, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q.anchor[who]), pa.array(q.number[who]), pa.array(ids), pa.array(score)], names=["anchor", "number", "id", "score"])

        ranked = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "id")
        while True:
            floors = queries.withColumn("floor", F.lit(_NONE))
            if best is not None:
                kth = best.where(F.col("rank") == k).select("anchor", "number", F.col("score").alias("floor"))
                floors = queries.join(kth, ["anchor", "number"], "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
            visits = materialize(self.spark, self.visits(floors, since, to), f"{name}-visits")
            found = visits.join(self.blocks, ["leaf", "chunk"]).mapInArrow(run, "anchor long, number int, id long, score long")
            both = found if best is None else found.unionByName(best.drop("rank"))
            best = materialize(self.spark, both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), f"{name}-best")
            if to >= len(self.live):
                return best
            since, to = to, to * GROWTH


_VISITS = pa.schema([*((n, pa.binary()) for n in [*Queries.FIELDS, "q"]), ("leaf", pa.int32()), ("chunk", pa.int32())])
_VISITS = pa.schema([_VISITS.field(n) for n in ["leaf", "chunk", *Queries.FIELDS, "q"]])


def quantised(spark: SparkSession, vectors: DataFrame, scale: int) -> tuple[DataFrame, Space]:
    """(vec_id, kind, q) of the rows that take part, one an id, and how q is held."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("kind"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("kind").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    seen = vectors.agg(F.max(F.size("embedding")).alias("dims"), F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))).alias("top")).first()
    dims, top = max(1, seen["dims"] or 0), scale * (seen["top"] or 0.0) + 1
    if 100 * dims * top * top >= 2.0**62:
        raise ValueError(f"scores of components up to {seen['top']} do not fit a long")
    dtype = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"

    def run(batches):
        for b in batches:
            lists = b.column("embedding")
            sizes, flat = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten(), np.float64)
            q = np.zeros((len(sizes), dims), dtype)
            row = np.repeat(np.arange(len(sizes)), sizes)
            q[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * flat)
            square = np.einsum("ij,ij->i", q.astype(np.int64), q.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("kind"), pa.array(square), pa.array([r.tobytes() for r in q], pa.binary())], names=["vec_id", "kind", "square", "q"])

    rows = vectors.mapInArrow(run, "vec_id long, kind long, square long, q binary")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("kind", "q", "square")).alias("r")).select("vec_id", "r.kind", "r.q", "r.square")
    rows = materialize(spark, rows, "vp-rows")
    square = rows.agg(F.max("square")).first()[0] or 0
    return rows.drop("square"), Space(dims, dtype, square)


def build(spark: SparkSession, rows: DataFrame, space: Space, leaves: int | None = None, block: int = BLOCK, bucket: int = BUCKET) -> Index | None:
    """The index over a stored table rows(vec_id, kind, q); None for an empty one."""
    n = rows.count()
    if not n:
        return None
    leaves = leaves or min(MAX_LEAVES, 1 << int(n**0.5 / 8).bit_length())
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < 2 * SAMPLE).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toPandas()
    drawn = drawn if len(drawn) else rows.limit(1).select("q").toPandas()
    upper = Upper(space, space.matrix(b"".join(drawn["q"])), leaves)
    shared = spark.sparkContext.broadcast(upper)

    def deal(batches):
        for b in batches:
            leaf = shared.value.leaf(space.matrix(b"".join(b.column("q").to_pylist())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=[*b.schema.names, "leaf"])

    dealt = materialize(spark, rows.mapInArrow(deal, "vec_id long, kind long, q binary, leaf int"), "vp-dealt")
    chunks = {r["leaf"]: -(-r["count"] // block) for r in dealt.groupBy("leaf").count().collect()}  # a row a leaf
    cut = spark.createDataFrame(list(chunks.items()), "leaf int, chunks int")
    dealt = dealt.join(F.broadcast(cut), "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")).drop("chunks")

    def pack(key, table):
        x = space.matrix(b"".join(table.column("q").to_pylist()))
        near, far = shared.value.spread(key[0].as_py(), x)
        order, ends, rows, spans = _grown(space, x, bucket)
        take = lambda c: np.asarray(table.column(c), np.int64)[order].tobytes()
        found = {
            "leaf": key[0].as_py(), "chunk": key[1].as_py(), "ids": take("vec_id"), "kinds": take("kind"), "vectors": x[order].astype(space.dtype).tobytes(),
            "ends": ends.tobytes(), "rows": rows.tobytes(), "spans": spans.tobytes(), "near": near.tolist(), "far": far.tolist(),
        }
        return pa.Table.from_pylist([found], schema=_BLOCK)

    schema = "leaf int, chunk int, ids binary, kinds binary, vectors binary, ends binary, rows binary, spans binary, near array<double>, far array<double>"
    # A group is one chunk of a leaf: ids differ, so their hashes deal it out evenly, about block rows.
    blocks = materialize(spark, dealt.groupBy("leaf", "chunk").applyInArrow(pack, schema), "vp-blocks")
    edges = blocks.select("leaf", F.posexplode(F.arrays_zip("near", "far")).alias("level", "d")).groupBy("leaf", "level").agg(F.min("d.near").alias("near"), F.max("d.far").alias("far"))
    live = sorted(chunks)
    place, spans = {leaf: i for i, leaf in enumerate(live)}, np.zeros((len(live), upper.depth, 2))
    for r in edges.collect():  # leaves x levels
        spans[place[r["leaf"]], r["level"]] = r["near"], r["far"]
    return Index(spark, space, upper, blocks.drop("near", "far"), chunks, spans)


_BLOCK = pa.schema([("leaf", pa.int32()), ("chunk", pa.int32()), *((n, pa.binary()) for n in ("ids", "kinds", "vectors", "ends", "rows", "spans")), ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64()))])


def mine(
    spark: SparkSession, vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
    leaves: int | None = None, block: int = BLOCK, bucket: int = BUCKET,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors(vec_id, label, embedding, ...).

    A component x counts as floor(scale x); scores are inner products, higher first, ties
    by smaller vec_id. Anchors are the rows whose vec_id is divisible by every; their
    positives are the first other rows of their label. For each, the first k rows of
    other labels with window[0] p <= 100 s <= window[1] p, p and s the scores of
    positive and negative. The result is exact.

    Rows with a null vec_id, label or vector and rows with a null or non-finite
    component take no part. Of rows that share a vec_id one takes part, the smallest by
    label, then by its vector's bytes. Shorter vectors are filled with zeros; an empty
    one scores 0 with all. An anchor without positives, or a positive without rows in
    its window (all negative scores: the window is empty), gives no rows; nor does an
    empty table. Other columns are ignored. Components so large that a score may not fit
    a long are an error.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, space = quantised(spark, vectors, scale)
    index = build(spark, rows, space, leaves, block, bucket)
    if index is None:
        return spark.createDataFrame([], schema)
    everything = F.lit(1 << 62)
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor"), F.lit(0).alias("number"), "kind", (-everything).alias("low"), everything.alias("high"), "q")
    anchors = materialize(spark, anchors, "vp-anchors")
    good = index.search(anchors, True, positives, "vp-positives").select("anchor", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Windows in whole scores; negative scores have none.
    p = F.col("positive_score")
    windows = good.where(p >= 0).join(anchors.select("anchor", "kind", "q"), "anchor").select(
        "anchor", "number", "kind", F.expr(f"({window[0]} * positive_score + 99) div 100").alias("low"), F.expr(f"{window[1]} * positive_score div 100").alias("high"), "q")
    windows = materialize(spark, windows.sortWithinPartitions("anchor", "number"), "vp-windows")
    bad = index.search(windows, False, k, "vp-negatives")
    return bad.join(good, ["anchor", "number"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
