"""Sparse, dense, multi-valued and hashed features, keyed by entity id; id 0 is the default row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import quantiles, vocab
from harrow.sources.scratch import stored


@dataclass(frozen=True)
class EntityConfig:
    """Feature columns of users or of items. multi_sparse: groups of columns that share values; pad marks an empty place."""

    sparse: tuple[str, ...] = ()
    dense: tuple[str, ...] = ()
    multi_sparse: tuple[tuple[str, ...], ...] = ()
    pad: tuple[str, ...] = ("missing",)

    @property
    def main_columns(self) -> dict[str, tuple[str, int]]:
        """For each column of a multi-sparse group the column that stands for the group, its first, and the place in it."""
        return {col: (group[0], place) for group in self.multi_sparse for place, col in enumerate(group)}

    @property
    def indexed(self) -> tuple[str, ...]:
        """The columns that have a value index: the sparse ones, and of each multi-sparse group the first."""
        return (*self.sparse, *(group[0] for group in self.multi_sparse))

    def pad_of(self, group: int) -> str:
        if len(self.pad) not in (1, len(self.multi_sparse)):
            raise ValueError("one pad value, or one per multi-sparse group")
        return self.pad[0] if len(self.pad) == 1 else self.pad[group]


@dataclass(frozen=True)
class FeatureConfig:
    user: EntityConfig = field(default_factory=EntityConfig)
    item: EntityConfig = field(default_factory=EntityConfig)


def _needs(data: DataFrame, cols) -> None:
    if missing := [c for c in cols if c not in data.columns]:
        raise ValueError(f"feature columns not in the table: {missing}")


def sparse_values(data: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """(col, value): distinct values of each column, as text."""
    _needs(data, cols)
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols))
    return data.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()


def multi_sparse_values(data: DataFrame, group: tuple[str, ...], pad: str) -> DataFrame:
    """(col, value): distinct values over the columns of a group without the pad, under the first column's name."""
    _needs(data, group)
    each = data.select(F.explode(F.array(*(F.col(c).cast("string") for c in group))).alias("value")).where(F.col("value").isNotNull() & (F.col("value") != pad))
    return each.distinct().select(F.lit(group[0]).alias("col"), "value")


def value_index(values: DataFrame) -> DataFrame:
    """(col, value, idx): per column 1..n in sorted order. Columns are numbered one by one, each in ranges."""
    out = None
    for row in values.select("col").distinct().orderBy("col").collect():  # one row per feature column
        part = vocab.make_id_mapping(values.where(F.col("col") == row["col"]).select("value"), "value", "idx").select(F.lit(row["col"]).alias("col"), "value", "idx")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else values.select("col", "value", F.lit(0).alias("idx")).limit(0)


def check_features(data: DataFrame, mapping: DataFrame, key: str, complete: bool = True) -> None:
    """Ids must be unique and, if complete, every id of the mapping must be there."""
    if not data.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique in the feature table")
    if complete and not mapping.join(data.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"the feature table lacks some values of {key}")


def reindex(data: DataFrame, mapping: DataFrame, key: str, id_col: str) -> DataFrame:
    """Feature rows by inner id; rows of values that the mapping lacks are dropped."""
    return data.join(mapping, key).drop(key)


def index_sizes(index: DataFrame) -> DataFrame:
    """(col, size): how many rows an embedding of each column of an index(col, value, idx) needs, that of unknown values included."""
    return index.groupBy("col").agg((F.max("idx") + 1).cast("long").alias("size"))


def sparse_features(data: DataFrame, mapping: DataFrame, key: str, id_col: str, cols: tuple[str, ...], index: DataFrame) -> DataFrame:
    """(id, cols...): value index per entity, 0 where the entity or the value is unknown, and the row of id 0."""
    out = mapping.join(data.select(key, *cols), key, "left").select(id_col, *cols)
    for c in cols:
        idx = index.where(F.col("col") == c).select(F.col("value").alias("__v"), "idx")
        out = out.join(idx, out[c].cast("string") == F.col("__v"), "left").withColumn(c, F.coalesce("idx", F.lit(0))).drop("__v", "idx")
    zero = data.sparkSession.range(1).select(F.lit(0).alias(id_col), *(F.lit(0).alias(c) for c in cols))
    return out.unionByName(zero)


def dense_features(data: DataFrame, mapping: DataFrame, key: str, id_col: str, cols: tuple[str, ...]) -> DataFrame:
    """(id, cols...): values per entity; the median of the mapped rows where missing, and for id 0."""
    _needs(data, cols)
    mapped = stored(reindex(data.select(key, *cols), mapping, key, id_col), "dense")
    middle = quantiles.medians(mapped, cols)
    everyone = mapping.select(id_col).unionByName(data.sparkSession.range(1).select(F.lit(0).alias(id_col)))
    out = everyone.join(mapped, id_col, "left")
    return out.select(id_col, *(F.coalesce(F.col(c).cast("double"), F.lit(middle[c])).cast("double").alias(c) for c in cols))


def multi_sparse_features(data: DataFrame, mapping: DataFrame, key: str, id_col: str, group: tuple[str, ...], index: DataFrame) -> DataFrame:
    """(id, first column): array of value indices, one per column of the group; pad and unknown are 0."""
    name = group[0]
    each = mapping.join(data.select(key, *group), key, "left").select(id_col, F.posexplode(F.array(*(F.col(c).cast("string") for c in group))).alias("pos", "value"))
    idx = index.where(F.col("col") == name).select("value", "idx")
    each = each.join(idx, "value", "left").select(id_col, F.struct("pos", F.coalesce("idx", F.lit(0)).alias("idx")).alias("s"))
    out = each.groupBy(id_col).agg(F.sort_array(F.collect_list("s")).alias("l")).select(id_col, F.col("l.idx").alias(name))
    zero = data.sparkSession.range(1).select(F.lit(0).alias(id_col), F.array_repeat(F.lit(0), len(group)).alias(name))
    return out.unionByName(zero)


def build(data: DataFrame, mapping: DataFrame, key: str, id_col: str, config: EntityConfig, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """All features of an entity in one table by id, and the value index (col, value, idx)."""
    check_features(data, mapping, key, complete)
    values = sparse_values(data, config.sparse) if config.sparse else None
    for g, group in enumerate(config.multi_sparse):
        more = multi_sparse_values(data, group, config.pad_of(g))
        values = more if values is None else values.unionByName(more)
    index = value_index(values) if values is not None else None
    parts = []
    if config.sparse:
        parts.append(sparse_features(data, mapping, key, id_col, config.sparse, index))
    if config.dense:
        parts.append(dense_features(data, mapping, key, id_col, config.dense))
    parts += [multi_sparse_features(data, mapping, key, id_col, g, index) for g in config.multi_sparse]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, id_col)
    return out, index


def hash_value_index(data: DataFrame, cols: tuple[str, ...], n_bins: int = vocab.DEFAULT_BINS, seed: int = 42) -> DataFrame:
    """(col, value, idx): the bin of every distinct value of each column."""
    out = None
    for c in cols:
        values = data.select(F.col(c).cast("string").alias("value")).where("value is not null").distinct()
        part = values.select(F.lit(c).alias("col"), "value", vocab.hash_ids(c, F.col("value"), n_bins, seed).alias("idx"))
        out = part if out is None else out.unionByName(part)
    return out


def update_hash_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two value indexes; the newer entry of a value wins."""
    return new.unionByName(old.join(new.select("col", "value"), ["col", "value"], "left_anti").select(*new.columns))


def hash_features(data: DataFrame, key: str, feature: str, cols: tuple[str, ...], n_bins: int = vocab.DEFAULT_BINS, seed: int = 42, existing: DataFrame | None = None) -> DataFrame:
    """(id, cols...) by hashed id: hashed values; of colliding entities the last in sorted order, new rows before existing ones.

    Every distinct value is hashed once, then joined. Values that are null have bin 0.
    """
    _needs(data, (key, *cols))
    own = vocab.hash_mapping(data.select(F.col(key).cast("string").alias("__k")), "__k", feature, n_bins, seed)
    hashed = data.select(F.col(key).cast("string").alias("__k"), *(F.col(c).cast("string").alias(c) for c in cols)).join(own, "__k")
    for c in cols:
        index = hash_value_index(data, (c,), n_bins, seed).select(F.col("value").alias(c), F.col("idx").alias("__idx"))
        hashed = hashed.join(index, c, "left").withColumn(c, F.coalesce("__idx", F.lit(0))).drop("__idx")
    out = hashed.groupBy("id").agg(*(F.max_by(c, "__k").alias(c) for c in cols))
    if existing is not None:
        out = out.unionByName(existing.join(out.select("id"), "id", "left_anti").select("id", *cols))
    return out


def override(features: DataFrame, values: dict, index: DataFrame | None = None) -> DataFrame:
    """features with the given columns set for all rows; a sparse value that the index lacks changes nothing."""
    for c, v in values.items():
        if index is not None:
            found = index.where((F.col("col") == c) & (F.col("value") == str(v))).select("idx").first()
            if found is None:
                continue
            v = found["idx"]
        features = features.withColumn(c, F.lit(v))
    return features


def inputs(rows: DataFrame, features: DataFrame, key: str, id_col: str, prefix: str = "") -> DataFrame:
    """rows with the features of the id in key; an id that the table features(id_col, ...) lacks has those of id 0."""
    cols = [c for c in features.columns if c != id_col]
    default = features.where(F.col(id_col) == 0).select(*(F.col(c).alias(f"__{c}") for c in cols))  # one row
    own = features.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__own_{c}") for c in cols))
    out = rows.join(own, F.col(key) == F.col("__id"), "left").join(F.broadcast(default), how="left")
    return out.select(*rows.columns, *(F.when(F.col("__id").isNull(), F.col(f"__{c}")).otherwise(F.col(f"__own_{c}")).alias(prefix + c) for c in cols))


def sequence_features(sequences: DataFrame, items: DataFrame, col: str, key: str = "u") -> DataFrame:
    """(key, seq_<col>): the feature of each element of seq, in order, from items(i, col)."""
    each = sequences.select(key, F.posexplode("seq").alias("pos", "i")).join(items.select("i", col), "i", "left")
    out = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(col, F.lit(0)).alias(col)))).alias("l"))
    return out.select(key, F.col(f"l.{col}").alias(f"seq_{col}"))
