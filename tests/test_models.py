"""The model classes end to end, their files, the stream, and the checks."""

import pytest

from pyspark.sql import functions as F

from harrow.operators import embed, features, history, sampling, serve, similarity, training, validate, vocab
from harrow.operators.features import EntityConfig, FeatureConfig
from harrow.operators.models import Dataset, HashDataset, ItemCF, Swing, UserCF
from harrow.operators.split import split_by_num
from harrow.sources import views


@pytest.fixture(scope="module")
def built(spark, sf_dir):
    train, test = split_by_num(views.purchases(spark, sf_dir), test_size=2)
    data = Dataset()
    parts = data.build_data(train, test)
    return data, parts


@pytest.mark.parametrize("kind", [UserCF, ItemCF, Swing])
def test_fit_recommend_evaluate_and_load(spark, built, kind, tmp_path):
    data, (train, test) = built
    task = "ranking" if kind is Swing else "rating"
    model = kind(task, data.info)
    with pytest.raises(RuntimeError):
        model.neighbors()
    model.fit(train, neg_sampling=True)
    users = data.info.users.limit(5).select("user").unionByName(spark.createDataFrame([(10**9,)], "user long"))
    recs = model.recommend_user(users, 7).groupBy("user").count().collect()
    assert len(recs) == 6 and all(r["count"] == 7 for r in recs)
    names = ["roc_auc", "precision", "coverage"] if kind is Swing else ["rmse", "mae", "r2", "loss"]
    found = {r["metric"]: r["value"] for r in model.evaluate(test, neg_sampling=True, wanted=names).collect()}
    assert set(found) == set(names)
    model.save(f"file://{tmp_path}", "m")
    again = kind.load(spark, f"file://{tmp_path}", "m", data.info)
    assert again.num_sim_elements() == model.num_sim_elements() > 0
    # What was saved is enough: ids, histories and popular items come with it.
    alone = kind.load(spark, f"file://{tmp_path}", "m")
    assert sorted(map(tuple, alone.recommend_user(users, 7).collect())) == sorted(map(tuple, model.recommend_user(users, 7).collect()))
    assert (alone.info.n_users, alone.info.n_items, alone.info.density) == (data.info.n_users, data.info.n_items, data.info.density)
    with pytest.raises(ValueError):
        kind.load(spark, f"file://{tmp_path}", "no such model")
    other = UserCF if kind is not UserCF else ItemCF
    with pytest.raises(ValueError):
        other.load(spark, f"file://{tmp_path}", "m", data.info)


def test_features_and_hashing(spark, sf_dir, built):
    data, _ = built
    config = FeatureConfig(
        user=EntityConfig(sparse=("c_mktsegment",), dense=("c_acctbal",)),
        item=EntityConfig(sparse=("p_brand",), dense=("p_size",), multi_sparse=(("tag1", "tag2"),)))
    got = data.process_features(views.user_features(spark, sf_dir), views.item_features(spark, sf_dir), config)
    assert got["item"][0].count() == data.info.n_items + 1
    assert set(got["user"][0].columns) == {"u", "c_mktsegment", "c_acctbal"}
    with pytest.raises(ValueError):
        data.process_features(views.user_features(spark, sf_dir), views.item_features(spark, sf_dir).where("item % 2 = 0"), config)
    hashed = HashDataset(n_hash_bins=50)
    rows = hashed.build_data(views.purchases(spark, sf_dir))[0].agg({"u": "max", "i": "min"}).first()
    assert rows["max(u)"] <= 50 and rows["min(i)"] >= 1


def test_hashed_features_and_retraining(spark, sf_dir):
    """Mappings, histories, value indexes and feature rows go on from the first dataset; new values win."""
    p = views.purchases(spark, sf_dir)
    config = FeatureConfig(item=EntityConfig(sparse=("p_brand", "p_type")))
    items = views.item_features(spark, sf_dir)
    first = HashDataset(n_hash_bins=5000)
    with pytest.raises(RuntimeError):
        first.process_features(None, items, config)
    first.build_data(p.where("time < '1996-01-01'"))
    with pytest.raises(ValueError):
        first.process_features(None, items, FeatureConfig(item=EntityConfig(dense=("p_size",))))
    with pytest.raises(ValueError):
        first.process_features(None, None, config)
    old, old_index = first.process_features(None, items.where("item % 2 = 0"), config)["item"]
    row = items.where("item = 4").first()
    bins = old.select(vocab.hash_ids("__items__", F.lit(4), 5000).alias("i"), vocab.hash_ids("p_brand", F.lit(row["p_brand"]), 5000).alias("b")).first()
    assert old.where(F.col("i") == bins["i"]).first()["p_brand"] == bins["b"]
    assert {r["value"] for r in old_index.where("col = 'p_brand'").collect()} == {r["p_brand"] for r in items.where("item % 2 = 0").collect()}

    again = Dataset.for_retrain(first)
    assert isinstance(again, HashDataset) and again.n_hash_bins == 5000
    again.build_data(p.where("time >= '1996-01-01'"))
    assert again.info.users.count() == p.select("user").distinct().count()
    total = again.info.user_consumed.select(F.sum(F.size("items"))).first()[0]
    assert total > first.info.user_consumed.select(F.sum(F.size("items"))).first()[0]
    changed = items.where("item % 2 = 1 or item = 4").withColumn("p_brand", F.when(F.col("item") == 4, "a new brand").otherwise(F.col("p_brand")))
    new, index = again.process_features(None, changed, config)["item"]
    assert new.count() > old.count() and index.where("value = 'a new brand'").count() == 1 and old_index.join(index, ["col", "value"], "left_anti").isEmpty()
    touched = {r[0] for r in changed.select(vocab.hash_ids("__items__", F.col("item"), 5000)).collect()}
    brand = {r["i"]: r["p_brand"] for r in new.collect()}
    assert brand[bins["i"]] != bins["b"] and all(brand[r["i"]] == r["p_brand"] for r in old.where(F.col("i") != bins["i"]).collect() if r["i"] not in touched)
    with pytest.raises(ValueError):
        Dataset.for_retrain(data_only := Dataset())
    assert data_only.info is None


@pytest.mark.parametrize("sampler", training.SAMPLERS)
def test_training_rows(spark, built, sampler):
    data, (train, _) = built
    r = similarity.interactions(train)
    rows = r.limit(200).select(F.xxhash64("u", "i").alias("row"), "u", "i")
    out = training.training_rows(rows, r, data.info.n_items, sampler, 3, lists=data.info.user_consumed, length=4)
    positive, negative = out.where("k = 0"), out.where("k > 0")
    assert positive.count() == 200 and positive.where("label <> 1").isEmpty() and negative.where("label <> 0").isEmpty()
    assert negative.join(rows.select("row", F.col("i").alias("own")), "row").where("i = own").isEmpty()
    assert out.where(F.size("seq") != 4).isEmpty() and negative.groupBy("row").count().where("count <> 3").isEmpty()
    if sampler == "unconsumed":
        assert negative.join(r, ["u", "i"]).isEmpty() and negative.groupBy("row", "i").count().where("count > 1").isEmpty()
    pairs = training.training_rows(rows, r, data.info.n_items, sampler, 2, pairwise=True)
    assert pairs.count() == 400 and set(pairs.columns) == {"row", "k", "u", "pos", "neg"}
    with pytest.raises(ValueError):
        training.training_rows(rows, r, 10, None, pairwise=True)
    with pytest.raises(ValueError):
        training.training_rows(rows, r, 10, "no such sampler")


def test_unconsumed_negatives_of_long_lists(spark, built, monkeypatch):
    """Users of many items are joined to them instead of carrying an array: the same negatives."""
    data, (train, _) = built
    r = similarity.interactions(train)
    rows = r.select(F.xxhash64("u", "i").alias("row"), "u", "i")
    got = sorted(map(tuple, sampling.negatives_from_unconsumed(rows, r, data.info.n_items, 2).select("row", "k", "neg").collect()))
    monkeypatch.setattr(sampling, "LONG_LIST", 20)
    assert got == sorted(map(tuple, sampling.negatives_from_unconsumed(rows, r, data.info.n_items, 2).select("row", "k", "neg").collect()))


def test_random_recommendations_and_evaluation_samplers(spark, built):
    data, (train, test) = built
    model = ItemCF("ranking", data.info).fit(train, neg_sampling=True)
    users = data.info.users.limit(8).select("user")
    best, drawn = (model.recommend_user(users, 5, random_rec=x).groupBy("user").agg(F.sort_array(F.collect_list("item")).alias("l")) for x in (False, True))
    assert drawn.where(F.size("l") != 5).isEmpty() and not best.exceptAll(drawn).isEmpty()
    for sampler in training.SAMPLERS:
        assert model.evaluate(test, neg_sampling=True, wanted=["roc_auc"], sampler=sampler).first()["value"] > 0


def test_swing_of_users_with_much_in_common(spark, built, monkeypatch):
    """Pairs of common items come from several places where they are many: the same sums."""
    _, (train, _) = built
    r = similarity.interactions(train)
    got = {(a["x1"], a["x2"]): a["sim"] for a in similarity.swing_pairs(r).collect()}
    monkeypatch.setattr(similarity, "SHARED_ITEMS", 1)
    again = {(a["x1"], a["x2"]): a["sim"] for a in similarity.swing_pairs(r).collect()}
    assert got.keys() == again.keys() and all(again[k] == pytest.approx(x) for k, x in got.items())


def test_pieces_of_serving(spark):
    preds = spark.createDataFrame([(1, 1, 2.0), (0, 1, 3.0), (1, 0, -1.0)], "u int, i int, pred double")
    plain = {(r["u"], r["i"]): r["pred"] for r in serve.normalize_prediction(preds, "ranking").collect()}
    zeroed = {(r["u"], r["i"]): r["pred"] for r in serve.normalize_prediction(preds, "ranking", "popular").collect()}
    assert plain[0, 1] == pytest.approx(0.9525741268) and zeroed[0, 1] == zeroed[1, 0] == 0 and zeroed[1, 1] == plain[1, 1]
    assert serve.normalize_prediction(preds, "rating").where("u = 1 and i = 1").first()["pred"] == 2.0
    known = spark.createDataFrame([(0, "a"), (1, "b")], "i int, kind string")
    got = {r["row"]: r["x_kind"] for r in features.inputs(spark.createDataFrame([(1, 1), (2, 7)], "row int, i int"), known, "i", "i", "x_").collect()}
    assert got == {1: "b", 2: "a"}
    raw = spark.createDataFrame([("k", ["x", "y", "nope", "x"])], "key string, values array<string>")
    ids = spark.createDataFrame([("x", 5), ("y", 6)], "item string, i int")
    assert history.build_sequence(raw, ids, 3).first()["seq"] == [6, 0, 5] and history.build_sequence(raw, ids, 6).first()["seq"] == [5, 6, 0, 5, 0, 0]
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, vec array<double>")
    assert embed.with_default(two).where("id = 0").first()["vec"] == [0.5, 1.0]
    assert [(r["i"], r["rank"]) for r in embed.default_items(two, two, 1).collect()] == [(2, 1)]


def test_checks(spark):
    rows = spark.createDataFrame([(1, 2, 0.0), (1, 3, 2.0)], "user int, item int, label double")
    with pytest.raises(ValueError):
        validate.check_data_cols(rows, "user", "nothing", "label", None)
    with pytest.raises(ValueError):
        validate.check_data_cols(rows, "user", "item", None, ["label"])
    with pytest.raises(ValueError):
        validate.check_labels(rows, "ranking", False)
    validate.check_labels(rows, "rating", False)
    with pytest.raises(ValueError):
        validate.check_feat_cols("user", "item", ["user"])
    with pytest.raises(ValueError):
        validate.check_lr_scheduler_config("step", {})
    validate.check_lr_scheduler_config("plateau", None)
    several = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],)], "labels array<double>")
    validate.check_multi_labels(several, "ranking", False)
    with pytest.raises(ValueError):
        validate.check_multi_labels(several, "ranking", True)


def test_feature_columns_and_sizes(spark, built):
    config = EntityConfig(sparse=("a", "b"), multi_sparse=(("x", "y", "z"), ("p", "q")))
    assert config.main_columns == {"x": ("x", 0), "y": ("x", 1), "z": ("x", 2), "p": ("p", 0), "q": ("p", 1)}
    assert config.indexed == ("a", "b", "x", "p")
    index = spark.createDataFrame([("a", "u", 1), ("a", "v", 2), ("x", "w", 1)], "col string, value string, idx int")
    assert {r["col"]: r["size"] for r in features.index_sizes(index).collect()} == {"a": 3, "x": 2}
    data, _ = built
    data.features = {"user": (index, index)}
    data.remove_features()
    assert data.features == {}
