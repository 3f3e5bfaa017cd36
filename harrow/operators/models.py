"""Datasets and similarity models: fit, predict, recommend_user, evaluate, save, load."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import features, history, metrics, serve, similarity, training, validate, vocab
from harrow.operators.state import PARTS, PartitionedState
from harrow.sources.scratch import stored

#: The tables of a DataInfo, and what they are partitioned by in a kept state.
INFO_PARTS = ("users", "items", "user_consumed", "item_consumed", "popular")
INFO_KEYS = {"users": "user", "items": "item", "user_consumed": "u", "item_consumed": "i", "popular": "item"}


@dataclass
class DataInfo:
    """What a dataset knows besides its rows: mappings, histories, popular items, sizes."""

    users: DataFrame
    items: DataFrame
    user_consumed: DataFrame
    item_consumed: DataFrame
    popular: DataFrame
    n_rows: int
    n_users: int
    n_items: int
    n_hash_bins: int | None = None

    @property
    def density(self) -> float:
        return vocab.density(self.n_rows, self.n_users, self.n_items)

    def __repr__(self) -> str:
        return f"n_users: {self.n_users}, n_items: {self.n_items}, data density: {self.density:.4f} %"


class Dataset:
    """Maps raw interactions to ids. Rows are ordered by order_col; labels are doubles."""

    def __init__(self, user_col: str = "user", item_col: str = "item", label_col: str | None = "label", multi_label_cols: list[str] | None = None, order_col: str = "ord", pop_num: int = 100, seed: int = 42):
        self.user_col, self.item_col, self.label_col, self.multi_label_cols = user_col, item_col, label_col, multi_label_cols
        self.order_col, self.pop_num, self.seed = order_col, pop_num, seed
        self.info: DataInfo | None = None
        self.features: dict[str, tuple[DataFrame, DataFrame]] = {}

    def _mappings(self, train: DataFrame) -> tuple[DataFrame, DataFrame]:
        users, items = vocab.make_id_mappings(train, ("user", "u"), ("item", "i"))
        return stored(users, "users"), stored(items, "items")

    def _plain(self, data: DataFrame) -> DataFrame:
        validate.check_data_cols(data, self.user_col, self.item_col, self.label_col, self.multi_label_cols)
        cols = [F.col(self.user_col).alias("user"), F.col(self.item_col).alias("item"), F.col(self.order_col).alias("ord")]
        if self.label_col:
            cols.append(F.col(self.label_col).cast("double").alias("label"))
        if self.multi_label_cols:
            labels = F.array(*(F.col(c).cast("double") for c in self.multi_label_cols))
            cols.append(labels.alias("labels"))
            if not self.label_col:
                cols.append(history.any_label(labels).alias("label"))
        return data.select(*cols)

    def build_data(self, train: DataFrame, eval_data: DataFrame | None = None, test_data: DataFrame | None = None) -> list[DataFrame]:
        """Encoded train, eval and test; the ids and histories come from train alone."""
        plain = self._plain(train)
        validate.check_ids(plain, "user", "item")
        users, items = self._mappings(plain)
        parts = [vocab.encode(self._plain(d), users, items) for d in (train, eval_data, test_data) if d is not None]
        parts[0] = stored(parts[0], "train")
        self.info = DataInfo(
            users, items, history.consumed(parts[0]), history.consumed(parts[0], key="i", value="u", name="users"),
            history.popular_items(plain, self.pop_num), parts[0].count(), users.count(), items.count())
        return parts

    def process_features(self, user_data: DataFrame | None = None, item_data: DataFrame | None = None, config: features.FeatureConfig | None = None, complete: bool = True) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Feature tables by u and by i, each with its value index."""
        if self.info is None:
            raise RuntimeError("build_data comes first")
        config = config or features.FeatureConfig()
        validate.check_feat_cols(self.user_col, self.item_col, config.user.sparse, config.user.dense, config.item.sparse, config.item.dense)
        for name, data, mapping, key, id_col, own in (("user", user_data, self.info.users, self.user_col, "u", config.user), ("item", item_data, self.info.items, self.item_col, "i", config.item)):
            wanted = own.sparse or own.dense or own.multi_sparse
            validate.check_feat_data(data, data, wanted, None)
            if wanted:
                mapped = mapping.withColumnRenamed("user" if name == "user" else "item", key)
                self.features[name] = features.build(data, mapped, key, id_col, own, complete)
        return self.features

    def remove_features(self) -> None:
        self.features = {}

    @staticmethod
    def for_retrain(trained: "CfModel | HashDataset", **options) -> "Dataset":
        """A dataset that goes on from a similarity model, or from the hashed dataset of another kind of model."""
        if isinstance(trained, HashDataset):
            return HashDataset.for_retrain(trained, **options)
        if not isinstance(trained, CfModel):
            raise ValueError("retraining goes on from a similarity model or a hashed dataset")
        if trained.info.n_hash_bins:
            raise ValueError("similarity models don't take hashed datasets")
        return ExtendableDataset(trained, **options)


class ExtendableDataset(Dataset):
    """A dataset that keeps a fitted model's ids and histories and appends to them.

    If the model keeps its state in a folder, so do the ids and histories: only the
    partitions that the new rows touch are written.
    """

    def __init__(self, model: "CfModel", **options):
        super().__init__(**options)
        self.old, self.state = model.info, model.kept

    def _mappings(self, train: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = []
        for name, col, id_col, n in (("users", "user", "u", self.old.n_users), ("items", "item", "i", self.old.n_items)):
            old = getattr(self.old, name)
            if self.state is None:
                out.append(stored(vocab.extend_mapping(old, train, col, id_col), name))
                continue
            new = stored(vocab.make_id_mapping(train.select(col).distinct().join(old.select(col), col, "left_anti"), col, id_col, n), name)
            self.state.merge(name, new, lambda a, b: a.unionByName(b))
            out.append(self.state.table(name))
        return out[0], out[1]

    def build_data(self, train, eval_data=None, test_data=None):
        parts = super().build_data(train, eval_data, test_data)
        for name, key, values in (("user_consumed", "u", "items"), ("item_consumed", "i", "users")):
            old, new = getattr(self.old, name), getattr(self.info, name)
            if self.state is None:
                merged = stored(history.merge_consumed(old, new, key, values), "consumed")
            else:
                self.state.merge(name, stored(new, "consumed"), lambda a, b, key=key, values=values: history.merge_consumed(a, b, key, values))
                merged = self.state.table(name)
            setattr(self.info, name, merged)
        if self.state is not None:
            self.state.put("popular", INFO_KEYS["popular"], self.info.popular)
            self.info.popular = self.state.table("popular")
        return parts


class HashDataset(Dataset):
    """Ids are hash bins: users and items share one range, new values need no mapping to grow.

    Features are sparse ones, by hashed id, their values hashed as well. From for_retrain()
    the mappings, histories, value indexes and feature rows of before are updated, not
    built anew.
    """

    def __init__(self, n_hash_bins: int = vocab.DEFAULT_BINS, previous: "HashDataset | None" = None, **options):
        super().__init__(**options)
        self.n_hash_bins, self.previous = n_hash_bins, previous

    @staticmethod
    def for_retrain(trained: "HashDataset", **options) -> "HashDataset":
        if not isinstance(trained, HashDataset) or trained.info is None:
            raise ValueError("a hashed dataset goes on from a hashed dataset that was built")
        return HashDataset(trained.n_hash_bins, trained, **({"seed": trained.seed} | options))

    def _mappings(self, train: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = []
        for col, name, id_col in (("user", "__users__", "u"), ("item", "__items__", "i")):
            new = vocab.hash_mapping(train, col, name, self.n_hash_bins, self.seed).withColumnRenamed("id", id_col)
            if self.previous is not None:
                new = vocab.update_mapping(self.previous.info.users if col == "user" else self.previous.info.items, new, col, id_col)
            out.append(stored(new, f"{col}s"))
        return out[0], out[1]

    def build_data(self, train, eval_data=None, test_data=None):
        parts = super().build_data(train, eval_data, test_data)
        self.info.n_hash_bins = self.n_hash_bins
        if self.previous is not None:
            old = self.previous.info
            self.info.user_consumed = stored(history.merge_consumed(old.user_consumed, self.info.user_consumed), "consumed")
            self.info.item_consumed = stored(history.merge_consumed(old.item_consumed, self.info.item_consumed, "i", "users"), "consumed")
        return parts

    def process_features(self, user_data=None, item_data=None, config=None, complete=False):
        """Feature tables by u and by i, each with its value index (col, value, idx); sparse columns only."""
        if self.info is None:
            raise RuntimeError("build_data comes first")
        config = config or features.FeatureConfig()
        for own in (config.user, config.item):
            if own.dense or own.multi_sparse:
                raise ValueError("hashed datasets take sparse features only")
        validate.check_feat_cols(self.user_col, self.item_col, config.user.sparse, config.item.sparse)
        for name, data, key, own, id_col, feature in (("user", user_data, self.user_col, config.user, "u", "__users__"), ("item", item_data, self.item_col, config.item, "i", "__items__")):
            validate.check_feat_data(data, data, own.sparse, None)
            if not own.sparse:
                continue
            before = self.previous.features.get(name) if self.previous is not None else None
            rows = features.hash_features(data, key, feature, own.sparse, self.n_hash_bins, self.seed, before and before[0].withColumnRenamed(id_col, "id"))
            index = features.hash_value_index(data, own.sparse, self.n_hash_bins, self.seed)
            index = features.update_hash_index(before[1], index) if before else index
            self.features[name] = stored(rows.withColumnRenamed("id", id_col), "features"), stored(index, "index")
        return self.features


@dataclass
class State:
    """A model's tables: interactions, similarities, and for cosine the sums behind them."""

    r: DataFrame
    pairs: DataFrame
    ss: DataFrame | None = None
    stats: DataFrame | None = None
    timings: dict = field(default_factory=dict)


class CfModel:
    """Base of the similarity models; target is the side that has neighbours."""

    model_type = "cf"
    target = "i"

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if cls.target not in ("u", "i"):
            raise ValueError("target must be 'u' or 'i'")

    def __init__(self, task: str, info: DataInfo, k_sim: int = 20, min_common: int = 1, seed: int = 42):
        if task not in ("rating", "ranking"):
            raise ValueError("task must be 'rating' or 'ranking'")
        self.task, self.info, self.k_sim, self.min_common, self.seed = task, info, k_sim, min_common, seed
        self.state: State | None = None
        self.kept: PartitionedState | None = None
        self.stream, self.folded = None, -1  # the last batch that is in, and the checkpoint of the stream that gave it

    @property
    def is_fitted(self) -> bool:
        return self.state is not None

    def _fitted(self) -> State:
        if self.state is None:
            raise RuntimeError(f"{type(self).__name__} is not fitted")
        return self.state

    def _compute(self, r: DataFrame) -> State:
        x, pivot = self.target, "u" if self.target == "i" else "i"
        stats, ss = stored(similarity.pair_stats(r, x, pivot), "stats"), stored(similarity.sum_squares(r, x), "ss")
        return State(r, stored(similarity.cosine_pairs(stats, ss, self.min_common), "pairs"), ss, stats)

    def _update(self, r: DataFrame) -> State:
        x, pivot, old = self.target, "u" if self.target == "i" else "i", self._fitted()
        fresh = stored(similarity.pair_stats(r, x, pivot), "fresh")
        stats = stored(similarity.update_pair_stats(old.stats, fresh), "stats")
        ss = stored(similarity.update_sum_squares(old.ss, r, x), "ss")
        pairs = stored(similarity.update_cosine(old.pairs, stats, ss, fresh, self.min_common), "pairs")
        return State(stored(similarity.merge_interactions(old.r, r), "r"), pairs, ss, stats)

    def _tables(self) -> dict[str, tuple[str, DataFrame]]:
        """The state as tables with the keys that they are partitioned by."""
        state = self._fitted()
        pairs = state.stats.join(state.pairs, ["x1", "x2"], "left").select("x1", "x2", "dot", "cnt", "sim")
        return {"r": ("u", state.r), "ss": ("x", state.ss), "pairs": ("x1", pairs)}

    def _merge(self, r: DataFrame) -> None:
        x, pivot = self.target, "u" if self.target == "i" else "i"
        self.kept.merge("ss", stored(similarity.sum_squares(r, x), "ss"), lambda a, b: a.unionByName(b).groupBy("x").agg(F.sum("ss").alias("ss")))
        self.kept.merge("pairs", stored(similarity.pair_stats(r, x, pivot), "fresh"), similarity.update_pairs(self.kept.table("ss"), self.min_common))
        self.kept.merge("r", r, similarity.merge_interactions)

    def _kept_state(self) -> State:
        pairs = self.kept.table("pairs")
        return State(self.kept.table("r"), pairs.where("sim is not null").select("x1", "x2", "sim"), self.kept.table("ss"), pairs.select("x1", "x2", "dot", "cnt"))

    def _notes(self) -> dict:
        info = {"n_rows": self.info.n_rows, "n_users": self.info.n_users, "n_items": self.info.n_items, "n_hash_bins": self.info.n_hash_bins}
        return {"model_type": self.model_type, "task": self.task, "k_sim": self.k_sim, "min_common": self.min_common, "stream": self.stream, "folded": self.folded, "info": info}

    def _put_all(self) -> None:
        for name, key in INFO_KEYS.items():
            self.kept.put(name, key, getattr(self.info, name))
            setattr(self.info, name, self.kept.table(name))
        for name, (key, df) in self._tables().items():
            self.kept.put(name, key, df)

    def keep(self, spark: SparkSession, path: str, n_parts: int = PARTS) -> "CfModel":
        """Keep ids, histories and similarities in a shared folder from now on: every fit() is committed there and
        writes only the hash partitions that its rows touch. of_kept() gives the model back, as of the last fit()."""
        self.kept = PartitionedState(spark, path, n_parts)
        if self.is_fitted:
            self._put_all()
            self.kept.commit(**self._notes())
            self.state = self._kept_state()
        return self

    @classmethod
    def of_kept(cls, spark: SparkSession, path: str) -> "CfModel | None":
        """The model that is kept in a folder, or none."""
        state = PartitionedState(spark, path)
        if not state.version:
            return None
        notes = state.notes
        if notes["model_type"] != cls.model_type:
            raise ValueError(f"{path} has a {notes['model_type']} model, not {cls.model_type}")
        model = cls(notes["task"], DataInfo(**{name: state.table(name) for name in INFO_PARTS}, **notes["info"]), notes["k_sim"], notes["min_common"])
        model.kept, model.stream, model.folded = state, notes["stream"], notes["folded"]
        model.state = model._kept_state()
        return model

    def fit(self, train: DataFrame, neg_sampling: bool = False, eval_data: DataFrame | None = None, metrics_wanted: list[str] | None = None, k: int = 10) -> "CfModel":
        """The first call computes the similarities, later ones fold the new rows in."""
        validate.check_labels(train, self.task, neg_sampling)
        began = time.time()
        r = stored(similarity.interactions(train), "r")
        if self.kept is None:
            self.state = self._update(r) if self.is_fitted else self._compute(r)
        else:
            if self.is_fitted:
                self._merge(r)
            else:
                self.state = self._compute(r)
                self._put_all()
            self.kept.commit(**self._notes())
            self.state = self._kept_state()
        self.state.timings["fit"] = time.time() - began
        if eval_data is not None:
            self.evaluation = self.evaluate(eval_data, neg_sampling, metrics_wanted, k)
        return self

    def neighbors(self, k: int | None = None) -> DataFrame:
        return similarity.neighbors(self._fitted().pairs, k)

    def num_sim_elements(self) -> int:
        return 2 * self._fitted().pairs.count()

    def _predict_task(self) -> str:
        return self.task

    def predict(self, pairs: DataFrame, inner_id: bool = False) -> DataFrame:
        """(u, i, pred) of raw (user, item) pairs or, with inner_id, of (u, i)."""
        enc = pairs if inner_id else vocab.encode(pairs, self.info.users, self.info.items)
        return serve.predict(enc, self.neighbors(self.k_sim), self._fitted().r, self.target, self.k_sim, self._predict_task())

    def recommend_user(self, users: DataFrame, n_rec: int, inner_id: bool = False, filter_consumed: bool = True, random_rec: bool = False) -> DataFrame:
        """(user, item, rk) for raw users, popular items for unknown ones and where a list is short; (u, i, rk) with inner_id."""
        known = users if inner_id else users.join(self.info.users, "user").select("u")
        popular = self.info.popular.join(self.info.items, "item").select("i", "rank")
        recs = serve.recommend(self._fitted().r, self.neighbors(self.k_sim), self.target, n_rec, self.k_sim, known, filter_consumed, random_rec, self.seed)
        recs = serve.backfill(recs.select("u", "i", "rk"), known, popular, n_rec)
        if inner_id:
            return recs
        out = recs.join(self.info.users, "u").join(self.info.items, "i").select("user", "item", "rk")
        strangers = users.select("user").join(self.info.users, "user", "left_anti")
        cold = serve.cold_start(strangers, popular, n_rec).join(self.info.items, "i").select("user", "item", "rk")
        return out.unionByName(cold)

    def evaluate(
        self, data: DataFrame, neg_sampling: bool = False, wanted: list[str] | None = None, k: int = 10, num_neg: int = 1, eval_user_num: int | None = None, sampler: str = "random",
    ) -> DataFrame:
        """(metric, value) of the wanted metrics over encoded eval rows.

        With neg_sampling every row is a positive and gets num_neg negatives by the sampler;
        what counts as consumed is what the eval rows hold, not the training rows.
        """
        everything = metrics.RATING if self.task == "rating" else metrics.POINTWISE + metrics.LISTWISE
        wanted = list(wanted or (("rmse",) if self.task == "rating" else ("roc_auc", "precision", "ndcg")))
        if bad := [m for m in wanted if m not in everything]:
            raise ValueError(f"no metrics for {self.task}: {bad}")
        rows = similarity.interactions(data).where("u > 0 and i > 0")
        out = None
        if pointwise := [m for m in wanted if m not in metrics.LISTWISE]:
            labelled = rows.select("u", "i", F.col("r").alias("label"))
            if neg_sampling:
                keyed = rows.select(F.xxhash64("u", "i").alias("row"), "u", "i")
                labelled = training.training_rows(keyed, rows, self.info.n_items, sampler, num_neg, seed=self.seed).select("u", "i", "label")
            preds = stored(labelled.join(self.predict(labelled, inner_id=True), ["u", "i"]), "preds")
            if self.task == "rating":
                found = metrics.long_form(metrics.rating_metrics(preds))
                found = found.unionByName(found.where("metric = 'rmse'").select(F.lit("loss").alias("metric"), "value"))
            else:
                loss = metrics.long_form(metrics.log_loss(preds))
                found = loss.unionByName(loss.select(F.lit("loss").alias("metric"), "value"))
                for f in (metrics.balanced_accuracy, metrics.roc_auc, metrics.pr_auc, metrics.roc_gauc):
                    if f.__name__ in pointwise:
                        found = found.unionByName(metrics.long_form(f(preds)))
            out = found.where(F.col("metric").isin(pointwise))
        if listwise := [m for m in wanted if m in metrics.LISTWISE]:
            truth = history.positive_consumed(rows.withColumnRenamed("r", "label"))
            users = metrics.sample_users(truth, eval_user_num, self.seed) if eval_user_num else truth.select("u")
            recs = stored(self.recommend_user(users, k, inner_id=True), "recs")
            found = metrics.long_form(metrics.listwise_metrics(recs, truth, k)).unionByName(metrics.long_form(metrics.coverage(recs, self.info.n_items)))
            found = found.where(F.col("metric").isin(listwise))
            out = found if out is None else out.unionByName(found)
        return out

    def save(self, path: str, name: str) -> None:
        """Similarities, interactions, ids, histories and popular items, under path/name: all that load() needs."""
        state = self._fitted()
        for part in INFO_PARTS:
            getattr(self.info, part).write.mode("overwrite").parquet(f"{path}/{name}/info-{part}")
        for part in ("r", "pairs", "ss", "stats"):
            if (df := getattr(state, part)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}/{part}")
        meta = self._notes() | {"parts": [p for p in ("r", "pairs", "ss", "stats") if getattr(state, p) is not None]}
        state.r.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/{name}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, name: str, info: DataInfo | None = None) -> "CfModel":
        """A saved model, with the ids and histories that were saved with it unless info is given."""
        try:
            meta = json.loads(spark.read.text(f"{path}/{name}/meta").first()[0])
        except AnalysisException as e:
            raise ValueError(f"no model {name!r} at {path}") from e
        if meta["model_type"] != cls.model_type:
            raise ValueError(f"{name} is a {meta['model_type']} model, not {cls.model_type}")
        if info is None:
            info = DataInfo(**{part: spark.read.parquet(f"{path}/{name}/info-{part}") for part in INFO_PARTS}, **meta["info"])
        model = cls(meta["task"], info, meta["k_sim"], meta["min_common"])
        model.stream, model.folded = meta["stream"], meta["folded"]
        model.state = State(**{p: spark.read.parquet(f"{path}/{name}/{p}") for p in meta["parts"]})
        return model

    def update_data_info(self, info: DataInfo) -> None:
        self.info = info


class UserCF(CfModel):
    model_type, target = "user_cf", "u"


class ItemCF(CfModel):
    model_type, target = "item_cf", "i"


class Swing(CfModel):
    """Ranking only; min_common is unused, alpha smooths the overlap of two users."""

    model_type, target, alpha = "swing", "i", 0.1

    def _compute(self, r: DataFrame) -> State:
        return State(r, stored(similarity.swing_pairs(r, self.alpha), "pairs"))

    def _update(self, r: DataFrame) -> State:
        old = self._fitted()
        return State(stored(similarity.merge_interactions(old.r, r), "r"), stored(similarity.swing_pairs(r, self.alpha, old.pairs), "pairs"))

    def _tables(self) -> dict[str, tuple[str, DataFrame]]:
        return {"r": ("u", self._fitted().r), "pairs": ("x1", self._fitted().pairs)}

    def _merge(self, r: DataFrame) -> None:
        self.kept.merge("pairs", stored(similarity.swing_pairs(r, self.alpha), "fresh"), similarity.update_swing)
        self.kept.merge("r", r, similarity.merge_interactions)

    def _kept_state(self) -> State:
        return State(self.kept.table("r"), self.kept.table("pairs"))

    def _predict_task(self) -> str:
        return "ranking"
