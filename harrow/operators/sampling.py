"""Negative sampling by reproducible probes instead of a generator's state."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.expressions import uniform
from harrow.operators.ranges import before_ranges, ranged
from harrow.sources.scratch import stored

PROBES = 10
#: Items of a user that are held as one array at most.
LONG_LIST = 10_000


def _probes(rows: DataFrame, num_neg: int, attempts: int, n_items: int, seed: int) -> DataFrame:
    """rows(row, u, i) x k x attempt with a uniform item id 1..n_items in neg."""
    out = rows.select("row", "u", "i", F.explode(F.sequence(F.lit(1), F.lit(num_neg))).alias("k"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    place = F.floor(uniform(seed, F.col("row"), F.col("k"), F.col("attempt")) * n_items)
    return out.withColumn("neg", (place + 1).cast("int"))


def _first(probes: DataFrame, bad) -> DataFrame:
    """The first probe of each (row, k) that is not bad; the last one if all are."""
    rank = F.struct(bad.cast("int"), F.when(bad, -F.col("attempt")).otherwise(F.col("attempt")))
    return probes.groupBy("row", "u", "i", "k").agg(F.min_by("neg", rank).alias("neg"))


def random_lists(rows: DataFrame, n_items: int, num_neg: int = 1, seed: int = 42, attempts: int = PROBES) -> DataFrame:
    """rows(row, i, ...) with negs: for k from 1 to num_neg the first of so many uniform items that is not the row's own, the last one if all are.

    Row by row: nothing is shuffled, and most rows draw once for each k.
    """
    def draw(k, attempt):
        return (F.floor(uniform(seed, F.col("row"), k, attempt) * n_items) + 1).cast("int")

    def drawn(k):
        first = draw(k, F.lit(1))
        if attempts < 2:
            return first
        more = F.transform(F.sequence(F.lit(2), F.lit(attempts)), lambda a: draw(k, a))
        other = F.coalesce(F.get(F.filter(more, lambda x: x != F.col("i")), F.lit(0)), F.element_at(more, -1))
        return F.when(first.eqNullSafe(F.col("i")), other).otherwise(first)

    return rows.withColumn("negs", F.transform(F.sequence(F.lit(1), F.lit(num_neg)), drawn))


def _one_by_one(listed: DataFrame) -> DataFrame:
    """(row, u, i, k, neg) of rows with negs."""
    return listed.select("row", "u", "i", F.posexplode("negs").alias("k", "neg")).withColumn("k", F.col("k") + 1)


def negatives_from_random(rows: DataFrame, n_items: int, num_neg: int = 1, seed: int = 42, attempts: int = PROBES) -> DataFrame:
    """(row, u, i, k, neg): uniform items other than the row's own."""
    return _one_by_one(random_lists(rows, n_items, num_neg, seed, attempts))


#: Rounds of the keyed permutation, and how often a value beyond the range is sent through it again.
ROUNDS, WALKS = 3, 16
#: Fixed odd numbers of the permutation's mixing step.
_MIX = (1640531527, 1540483477)


def _mixed(value, key):
    """A number below 2^24 from a value and a key below 2^31 and 2^30."""
    first = F.floor(((value + key) * F.lit(_MIX[0])) % F.lit(1 << 32) / F.lit(64)).cast("long")
    return F.floor((first * F.lit(_MIX[1])) % F.lit(1 << 32) / F.lit(256)).cast("long")


def permuted(place, n: int, keys):
    """The place (0 to n - 1) that a keyed permutation gives a place: different places, different results, nothing is remembered.

    keys is an array of ROUNDS pairs (a, b). A Feistel network over the grid of a rows
    and b columns that just holds n cells; a result beyond n goes through again.
    """
    rows = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    columns = -(-n // rows)

    def once(x):
        def step(s, k):
            left = (s["l"] + _mixed(s["r"], k["a"])) % F.lit(rows)
            # The new left half is needed twice: it goes through a list of one.
            return F.transform(F.array(left), lambda new: F.struct(new.alias("l"), ((s["r"] + _mixed(new, k["b"])) % F.lit(columns)).alias("r")))[0]

        start = F.struct(F.floor(x / F.lit(columns)).cast("long").alias("l"), (x % F.lit(columns)).cast("long").alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * F.lit(columns) + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(place.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def batched(rows: DataFrame, batch_size: int, by: str = "row") -> DataFrame:
    """rows with batch and place: batches of batch_size rows in the order of by, places from 0."""
    placed = ranged(rows, by)
    before = before_ranges(placed, before=F.count(F.lit(1)))
    at = F.col("before") + F.col("__place")
    out = placed.join(F.broadcast(before), "__part")
    return out.withColumns({"batch": F.floor(at / batch_size), "place": at % batch_size}).drop("__part", "__place", "before")


def negatives_distinct(rows: DataFrame, n_items: int, num_neg: int = 1, batch_size: int = 256, seed: int = 42) -> DataFrame:
    """(row, u, i, batch, k, neg): uniform items other than the row's own, drawn without replacement inside a batch of rows.

    Every batch has a keyed permutation of the items, a draw takes its own place in it, so
    draws know nothing of each other. A draw that meets the row's item moves to a place
    beyond those of all draws, which cannot be that item. Where a batch needs more than
    half of the items for that, such a draw may repeat another of its batch; where it
    needs more than all of them, places wrap and each item comes as evenly as it can.
    The only item of all is drawn nowhere: n_items must be 2 or more.
    """
    if n_items < 2:
        raise ValueError("there is no other item to draw")
    key = lambda j, side: F.floor(uniform(seed, F.lit("order"), F.col("batch"), F.lit(f"{j}{side}")) * F.lit(1 << 30)).cast("long").alias(side)
    keys = F.array(*(F.struct(key(j, "a"), key(j, "b")) for j in range(ROUNDS)))
    # Keys are a batch's, not a row's.
    batches = batched(rows.select("row", "u", "i"), batch_size)
    keyed = batches.join(batches.select("batch").distinct().select("batch", keys.alias("keys")), "batch")
    draws = keyed.select("*", F.explode(F.sequence(F.lit(1), F.lit(num_neg))).alias("k"))
    own = F.col("place") * num_neg + F.col("k") - 1
    draws = draws.withColumn("neg", permuted(own % n_items, n_items, F.col("keys")) + 1)
    again = own + batch_size * num_neg
    again = F.when(again % n_items == own % n_items, again + 1).otherwise(again) % n_items
    neg = F.when(F.col("neg") == F.col("i"), permuted(again, n_items, F.col("keys")) + 1).otherwise(F.col("neg"))
    return draws.select("row", "u", "i", "batch", "k", neg.cast("int").alias("neg"))


def popularity(r: DataFrame, temperature: float = 0.75) -> DataFrame:
    """(i, p, lo, hi): distinct consumers ^ temperature, normalised, and as intervals of [0, 1).

    Running sums by hundred blocks of items, then within them: no window over all items
    in one task.
    """
    each = r.select("u", "i").distinct().groupBy("i").agg(F.pow(F.count(F.lit(1)), F.lit(temperature)).alias("w"))
    block = F.floor(F.col("i") / 1000).cast("int")
    each = each.withColumn("block", block)
    blocks = each.groupBy("block").agg(F.sum("w").alias("bw"))
    blocks = blocks.select("block", (F.sum("bw").over(Window.orderBy("block")) - F.col("bw")).alias("before"))
    total = each.agg(F.sum("w").alias("total"))
    inside = F.sum("w").over(Window.partitionBy("block").orderBy("i"))
    out = each.withColumn("inside", inside).join(blocks, "block").crossJoin(F.broadcast(total))
    hi = (F.col("before") + F.col("inside")) / F.col("total")
    return out.select("i", (F.col("w") / F.col("total")).alias("p"), (hi - F.col("w") / F.col("total")).alias("lo"), hi.alias("hi"))


def negatives_from_popular(rows: DataFrame, probs: DataFrame, num_neg: int = 1, seed: int = 42, attempts: int = 2, cells: int | None = None) -> DataFrame:
    """(row, u, i, k, neg) drawn by popularity(); one more try where the draw is the row's own item.

    The inverse of the cumulative distribution is a range join, turned into an equi
    join on the cell of [0, 1) that a draw and an interval lie in: as many cells as items,
    so that a draw meets a few intervals however many there are.
    """
    cells = cells or max(1024, probs.count())
    draws = rows.select("row", "u", "i", F.explode(F.sequence(F.lit(1), F.lit(num_neg))).alias("k"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    draws = draws.withColumn("x", uniform(seed, F.col("row"), F.col("k"), F.col("attempt"))).withColumn("cell", F.floor(F.col("x") * cells).cast("int"))
    span = probs.select(F.col("i").alias("neg"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.floor(F.col("hi") * cells).cast("int"))).alias("cell"))
    met = draws.join(span, "cell").where("lo <= x and x < hi")
    return _first(met, F.col("neg") == F.col("i"))


def negatives_from_unconsumed(rows: DataFrame, r: DataFrame, n_items: int, num_neg: int = 1, seed: int = 42, attempts: int = PROBES) -> DataFrame:
    """(row, u, i, k, neg) of unconsumed_lists()."""
    return _one_by_one(unconsumed_lists(rows, r, n_items, num_neg, seed, attempts))


def unconsumed_lists(rows: DataFrame, r: DataFrame, n_items: int, num_neg: int = 1, seed: int = 42, attempts: int = PROBES) -> DataFrame:
    """rows(row, u, i, ...) with negs: not the row's item, not consumed by its user, distinct within a row.

    Of 2 * attempts probes the first half must be unconsumed; then that rule is dropped.
    The num_neg first values by attempt, then k, are taken; where the probes hold fewer
    other items than that (as with hardly any items at all) the row has fewer.

    A user's items travel to the user's rows as one array. Users of more than LONG_LIST
    items have their probes joined to their items one by one instead.
    """
    long_ = stored(r.groupBy("u").agg(F.count_distinct("i").alias("n")).where(F.col("n") > LONG_LIST).select("u"), "long")
    lists = stored(r.join(long_, "u", "left_anti").groupBy("u").agg(F.collect_set("i").alias("eaten")), "eaten")
    heavy = rows.join(long_, "u", "left_semi")

    def picked(upto: int):
        def probe(k, attempt):
            draw = F.floor(uniform(seed, F.col("row"), k, attempt) * n_items)
            return F.struct(attempt.alias("attempt"), k.alias("k"), (draw + 1).cast("int").alias("neg"))

        tries = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(upto)), lambda a: F.transform(F.sequence(F.lit(1), F.lit(num_neg)), lambda k: probe(k, a))))
        good = F.filter(tries, lambda t: (t["neg"] != F.col("i")) & ((t["attempt"] > attempts) | ~F.array_contains("eaten", t["neg"])))
        return F.slice(F.array_distinct(F.transform(good, lambda t: t["neg"])), 1, num_neg)

    listed = rows.join(long_, "u", "left_anti").join(lists, "u", "left").withColumn("eaten", F.coalesce("eaten", F.array().cast("array<int>")))
    # Most rows are done after a few probes; only the others draw all of them.
    listed = listed.withColumn("negs", picked(min(3, attempts)))
    listed = listed.withColumn("negs", F.when(F.size("negs") == num_neg, F.col("negs")).otherwise(picked(2 * attempts)))
    listed = listed.select(*rows.columns, "negs")
    if long_.isEmpty():
        return listed
    joined = _unconsumed_joined(heavy.select("row", "u", "i"), r, n_items, num_neg, seed, attempts)
    joined = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "neg"))).alias("negs")).select("row", F.col("negs.neg").alias("negs"))
    none = F.array().cast("array<int>")
    return listed.unionByName(heavy.join(joined, "row", "left").select(*rows.columns, F.coalesce("negs", none).alias("negs")))


def _unconsumed_joined(rows: DataFrame, r: DataFrame, n_items: int, num_neg: int, seed: int, attempts: int) -> DataFrame:
    probes = _probes(rows, num_neg, 2 * attempts, n_items, seed)
    eaten = r.select("u", F.col("i").alias("neg"), F.lit(True).alias("eaten")).distinct()
    probes = probes.join(eaten, ["u", "neg"], "left")
    bad = (F.col("neg") == F.col("i")) | ((F.col("attempt") <= attempts) & F.coalesce("eaten", F.lit(False)))
    good = probes.where(~bad)
    # A value is worth its earliest probe in the row; the k-th negative is the k-th of those.
    worth = good.groupBy("row", "u", "i", "neg").agg(F.min(F.struct("attempt", "k")).alias("at"))
    out = worth.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("at")))
    return out.where(F.col("k") <= num_neg).select("row", "u", "i", F.col("k").cast("int").alias("k"), "neg")


def keep_probabilities(r: DataFrame, n_users: int, alpha: float = 1e-3) -> DataFrame:
    """(i, keep): the word2vec probability to keep a frequent positive, (sqrt(f / alpha) + 1) * alpha / f."""
    f = F.count(F.lit(1)) / F.lit(float(n_users))
    each = r.select("u", "i").distinct().groupBy("i").agg(f.alias("f"))
    return each.select("i", ((F.sqrt(F.col("f") / alpha) + 1) * alpha / F.col("f")).alias("keep"))


def item_corrections(enc: DataFrame) -> DataFrame:
    """(i, share): rows of the item over all rows, for logit correction."""
    total = enc.agg(F.count(F.lit(1)).alias("n"))
    return enc.groupBy("i").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(total)).select("i", (F.col("c") / F.col("n")).alias("share"))


def pointwise_rows(rows: DataFrame, negatives: DataFrame) -> DataFrame:
    """(row, k, u, i, label): each positive (k = 0, label 1) and its negatives (label 0)."""
    pos = rows.select("row", F.lit(0).alias("k"), "u", "i", F.lit(1.0).alias("label"))
    return pos.unionByName(negatives.select("row", "k", "u", F.col("neg").alias("i"), F.lit(0.0).alias("label")))


def multi_label_rows(rows: DataFrame, negatives: DataFrame) -> DataFrame:
    """(row, k, u, i, labels): each positive of rows(row, u, i, labels) with its own labels, and its negatives with all 0."""
    none = negatives.join(rows.select("row", "labels"), "row").select("row", "k", "u", F.col("neg").alias("i"), F.transform("labels", lambda x: x * 0).alias("labels"))
    return rows.select("row", F.lit(0).alias("k"), "u", "i", "labels").unionByName(none)


def pairwise_rows(negatives: DataFrame) -> DataFrame:
    """(row, k, u, pos, neg)."""
    return negatives.select("row", "k", "u", F.col("i").alias("pos"), "neg")
