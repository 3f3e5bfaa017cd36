"""MinHash near-duplicates: a signature-coordinate inverted join.

Every document's word-shingle set gets a signature of COORDS minima. A document is
posted under its (coordinate, value) pairs; pairs of documents are counted where
their postings collide, and those that collide in MIN_MATCHES coordinates are
confirmed on the full shingle sets.

* Prefix: values are ordered rarest first. Two documents that share MIN_MATCHES
  values share one among the first s - MIN_MATCHES + 1 of the s values that either
  has in common with anybody, so only those are posted, and the values of passages
  that very many documents share stay out of the lists.
* Skip: a pair is counted only in the list of the first value that it shares, and a
  list only compares documents whose set sizes allow the similarity.
* Exact copies (equal shingle sets) are one class before any list is built.
* Pairs of middling similarity, as of short texts around one passage, are told from
  near copies by the prefixes of their full sets, rarest shingle first: two sets that
  are similar enough share a shingle there.
* Hot lists: a first round compares each document with one hub of each of its lists
  and keeps the best few, so a list of n near copies costs n comparisons, not n * n.
  The second round counts only pairs that the first left in different components,
  and only where one of the two is outside the list's largest component.

With 32 coordinates and 14 matches a pair of similarity 0.8 is missed with a
probability of 1.2e-6 (binomial tail); below 0.8 nothing is ever linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from harrow.llm.common import Words, connected_components, held, materialize, mix, rows_of_lists, slices, small

COORDS = 32
MIN_MATCHES = 14
HUBS = 3

_SEED = np.random.default_rng(97)
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(1, 2**63, 256, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, flat, and where each document's begin."""
    words = Words(texts)
    h, first = words.hash, words.first
    counts = np.diff(first)
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * _PLACE[k]
    total = mix(total)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for d in range(len(counts)):
        lo, n = first[d], counts[d]
        if n >= width:
            got = np.unique(total[lo : lo + n - width + 1])
        elif n:
            got = mix(np.array([(h[lo : lo + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            continue
        sizes[d] = len(got)
        parts.append(got)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, first: np.ndarray, coords: int) -> np.ndarray:
    """One row of coords minima per document, as 32-bit integers; empty sets give zeros."""
    out = np.zeros((len(first) - 1, coords), np.int32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for c in range(coords):
            v = ((flat * _MULTIPLY[c] + _ADD[c]) >> np.uint64(32)).astype(np.uint32)
            out[some, c] = np.minimum.reduceat(v, first[some]).view(np.int32)
    return out


def set_keys(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each shingle set, as two longs."""
    n, some = len(first) - 1, np.flatnonzero(np.diff(first))
    keys = np.zeros((2, n), np.uint64)
    if len(some):
        for k, salt in enumerate((_ADD[200], _ADD[201])):
            keys[k, some] = np.add.reduceat(mix(flat ^ salt), first[some])
    return keys[0].view(np.int64), keys[1].view(np.int64)


def _signed(docs: DataFrame, width: int, coords: int) -> DataFrame:
    def run(batches):
        held("shingles", tuple)  # keeps nothing, lets go of other stages' tables
        for b in slices(batches):
            flat, first = shingle_sets(b.column("text"), width)
            k1, k2 = set_keys(flat, first)
            sig = signatures(flat, first, coords).ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(first)), pa.array(k1), pa.array(k2),
                 rows_of_lists(sig, np.arange(b.num_rows + 1) * coords)],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        held("shingles", tuple)  # keeps nothing, lets go of other stages' tables
        for b in slices(batches):
            flat, first = shingle_sets(b.column("text"), width)
            k1, k2 = set_keys(flat, first)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(k1), pa.array(k2), rows_of_lists(flat.view(np.int64), first)],
                names=["doc_id", "k1", "k2", "shingles"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, shingles array<long>")


def _sets_of(spark: SparkSession, docs: DataFrame, classes: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the full sets of the classes in reps(rep), which stands as doc_id, from the text of each one's smallest document."""
    ids = classes.join(reps, "rep").select("rep", F.col("low").alias("id"), F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    ids = materialize(spark, ids, "mh-ids")
    texts = docs.join(small(ids.select("id").distinct(), 16), F.col("doc_id") == F.col("id"), "left_semi")
    same = (F.col("doc_id") == F.col("id")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    found = _full_sets(texts, width).join(small(ids, 40), same)
    return materialize(spark, found.dropDuplicates(["rep"]).select(F.col("rep").alias("doc_id"), "shingles"), "mh-sets")


def _of_one_id(spark: SparkSession, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id: such rows are one document."""
    key = F.struct("k1", "k2")
    rows = signed.where("n_shingles > 0 and doc_id is not null")
    repeated = rows.groupBy("doc_id").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first <> last")
    repeated = materialize(spark, repeated.select("doc_id", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")), "mh-repeated")
    ends = rows.join(small(repeated, 24), "doc_id").select("k1", "k2", "f1", "f2").distinct()
    to = classes.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("rep").alias("a"))
    return ends.join(classes.select("k1", "k2", F.col("rep").alias("b")), ["k1", "k2"]).join(to, ["f1", "f2"]).where("a <> b").select("a", "b")


def _confirm(spark: SparkSession, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("i"))
    return materialize(spark, both.where(F.col("i") * 100 >= (F.col("n") + F.col("m") - F.col("i")) * percent).select("a", "b"), "mh-links")


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, alone, rare) of the sets that can reach percent with another one of them.

    alone counts the shingles that no other set has; rare holds the others, rarest
    first, as far as the prefix of the smallest overlap goes.
    """
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = each.join(often, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("rare"))
    kept = kept.select("doc_id", (F.col("n") - F.size("rare")).alias("alone"), F.col("rare.s").alias("rare"), "n")
    most = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") + 1 - F.col("alone")
    return kept.where(most > 0).select("doc_id", "alone", F.slice("rare", F.lit(1), most).alias("rare"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80,
    coords: int = COORDS, min_matches: int = MIN_MATCHES, hubs: int = HUBS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    distinct width-word shingles (with fewer words the whole sequence is the only
    shingle); component_id is the smallest doc_id reachable.

    Null and word-less texts have an empty set and stay alone. Rows that repeat a
    doc_id are one document to the links and each get a row. A row without a doc_id
    can only be a copy: it gets the component of its class, or null. Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(spark, _signed(docs, width, coords), "mh-signed")
    # The links are between classes of equal sets, numbered: a doc_id may stand on texts of several.
    classes = signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"))
    classes = materialize(spark, classes.withColumn("rep", F.monotonically_increasing_id()), "mh-classes")
    reps = signed.join(classes.where("low is not null").select("k1", "k2", "rep", F.col("low").alias("doc_id")), ["k1", "k2", "doc_id"])
    values = materialize(spark, reps.dropDuplicates(["rep"]).select(F.col("rep").alias("doc_id"), "n_shingles", "sig"), "mh-reps")
    coordinate = F.posexplode("sig").alias("c", "v")
    value = F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")
    flat = values.select(F.col("doc_id").alias("rep"), coordinate).select("rep", value.alias("value"))
    shared = materialize(spark, flat.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "mh-shared")
    ordered = (
        flat.join(shared, "value").groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
        .where(F.size("vs") >= min_matches)
        .select("rep", F.col("vs.value").alias("vs"), F.aggregate("vs.df", F.lit(0).cast("long"), lambda s, x: s + x).alias("weight"))
    )
    ordered = ordered.join(values.select(F.col("doc_id").alias("rep"), "n_shingles"), "rep")
    posted = ordered.select(
        "rep", F.col("n_shingles").alias("n"), "vs", "weight",
        F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.lit(min_matches - 1))).alias("value"))
    posted = materialize(spark, posted, "mh-posted")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == "value" else f"{c}_{tag}") for c in df.columns])

    size_fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    common = F.array_intersect("vs_a", "vs_b")

    # Round 1: each document and the hubs of its lists: the one whose values most documents
    # share (the original of a group of near copies) and one at random.
    key = F.xxhash64("rep", "value")
    first = posted.groupBy("value").agg(
        F.max(F.struct("weight", "rep")).alias("heavy"), F.min(F.struct(key.alias("key"), "rep")).alias("any"), F.count(F.lit(1)).alias("n_list"))
    first = first.where("n_list > 1").select("value", F.explode(F.array_distinct(F.array("heavy.rep", "any.rep"))).alias("rep"))
    hub = materialize(spark, posted.join(materialize(spark, first, "mh-first"), ["value", "rep"]), "mh-hubs")
    met = side(posted, "a").join(side(hub, "b"), "value").where((F.col("rep_a") != F.col("rep_b")) & size_fits)
    met = met.select("rep_a", "rep_b", F.size(common).alias("matches")).where(F.col("matches") >= min_matches).distinct()
    best = Window.partitionBy("rep_a").orderBy(F.desc("matches"), "rep_b")
    pairs = met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= hubs)
    pairs = pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    pairs = materialize(spark, pairs, "mh-pairs")
    sets = _sets_of(spark, docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), width)
    links = materialize(spark, _confirm(spark, sets, pairs, percent).union(_of_one_id(spark, signed, classes)), "mh-links")
    component = materialize(spark, connected_components(spark, links), "mh-components")

    # Round 2: what is still apart.
    tagged = posted.join(component, posted.rep == component.node, "left").select(
        "value", "rep", "n", "vs", F.coalesce("component", "rep").alias("component"))
    tagged = materialize(spark, tagged, "mh-tagged")
    sizes = tagged.groupBy("value", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("value").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
    main = materialize(spark, main.where("parts > 1").select("value", F.col("m.component").alias("main")), "mh-main")
    apart = materialize(spark, tagged.join(main, "value"), "mh-apart")
    sets = _sets_of(spark, docs, classes, apart.select("rep").distinct(), width)
    apart = apart.join(materialize(spark, _rare_first(sets, percent), "mh-rare"), apart.rep == F.col("doc_id")).drop("doc_id")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100.0 + percent) - 1e-9).cast("int")

    def prefix(tag: str):
        length = F.col(f"n_{tag}").cast("int") - need + 1 - F.col(f"alone_{tag}")
        return F.slice(F.col(f"rare_{tag}"), F.lit(1), F.greatest(F.lit(0), length))

    rest = apart.where("component <> main")
    cross = side(rest, "a").join(side(apart, "b"), "value").where(
        (F.col("component_a") != F.col("component_b")) & size_fits
        & ((F.col("rep_a") < F.col("rep_b")) | (F.col("component_b") == F.col("main_b")))
        & F.arrays_overlap(prefix("a"), prefix("b"))
        & (F.size(common) >= min_matches) & (F.element_at(common, 1) == F.col("value")))
    cross = cross.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    cross = materialize(spark, cross, "mh-cross")
    if not cross.isEmpty():
        more = _confirm(spark, sets, cross, percent)
        if not more.isEmpty():
            component = materialize(spark, connected_components(spark, links.union(more)), "mh-components")

    named = classes.join(component, classes.rep == component.node, "left").select("k1", "k2", "low", F.coalesce("component", "rep").alias("class"))
    lowest = named.groupBy("class").agg(F.min("low").alias("component"))
    named = materialize(spark, named.join(lowest, "class").select("k1", "k2", "component"), "mh-named")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near duplicates, with all columns.

    The row of the group's smallest doc_id stays; of rows that share it, the first by
    their text. Rows without a doc_id all stay.
    """
    verdicts = near_duplicates(spark, docs, **options)
    gone = materialize(spark, verdicts.where("not kept and doc_id is not null").select("doc_id").distinct(), "mh-gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    named = left.where("doc_id is not null")
    repeated = materialize(spark, named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "mh-repeated")
    if repeated.isEmpty():
        return left
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    among = named.join(repeated, "doc_id", "left_semi").withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    others = left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return others.unionByName(among.select(*docs.columns))
