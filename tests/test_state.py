"""State in partitions: what a batch touches is written, what is not keeps its files; streams that lose nothing."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators.models import Dataset, ExtendableDataset, ItemCF, Swing, UserCF
from harrow.operators.state import PartitionedState
from harrow.sources import scratch
from harrow.sources.scratch import names_in
from harrow.streaming.incremental import fit_stream, resumed

SCHEMA = "user long, item long, ord long, label double"


@pytest.fixture(scope="module")
def batches(spark):
    """Four batches: two that share users and items, one that corrects labels, one of a single new user."""
    rng = np.random.default_rng(9)
    draw = lambda n, users, items, since: [(int(u), int(i), since + k, float(v)) for k, (u, i, v) in enumerate(zip(rng.integers(*users, n), rng.integers(*items, n), rng.integers(1, 6, n), strict=True))]
    parts = [draw(300, (0, 30), (0, 40), 0), draw(200, (20, 45), (10, 60), 1000)]
    parts += [[(u, i, 2000 + k, 5.0) for k, (u, i, _, _) in enumerate(parts[0][:60])], [(999, i, 3000 + i, 1.0) for i in (1, 2, 70)]]
    ALL[:] = [spark.createDataFrame(p, SCHEMA).coalesce(1).cache() for p in parts]
    return ALL


def sims(model):
    return {(r["x1"], r["x2"]): round(r["sim"], 9) for r in model.state.pairs.collect()}


@functools.cache
def wanted(which):
    """Similarities of ItemCF without a kept state, by the indexes of the batches."""
    return sims(folded(ItemCF, [ALL[i] for i in which]))


ALL = []


def folded(kind, batches, path=None, **options):
    task = "ranking" if kind is Swing else "rating"
    data = Dataset()
    train = data.build_data(batches[0])[0]
    model = kind(task, data.info, **options)
    if path:
        model.keep(batches[0].sparkSession, path, 16)
    model.fit(train, neg_sampling=True)
    for batch in batches[1:]:
        data = ExtendableDataset(model)
        train = data.build_data(batch)[0]
        model.update_data_info(data.info)
        model.fit(train, neg_sampling=True)
    return model


@pytest.mark.parametrize("kind,options,n", [(ItemCF, {}, 4), (UserCF, {"min_common": 2}, 2), (Swing, {}, 2)])
def test_kept_state_gives_the_same_model(spark, batches, tmp_path, kind, options, n):
    plain, kept = folded(kind, batches[:n], **options), folded(kind, batches[:n], f"file://{tmp_path}", **options)
    again = kind.of_kept(spark, f"file://{tmp_path}")
    for model in (kept, again):
        assert sims(model) == sims(plain)
        assert sorted(model.state.r.collect()) == sorted(plain.state.r.collect())
        for part in ("users", "items", "popular"):
            assert sorted(getattr(model.info, part).collect()) == sorted(getattr(plain.info, part).collect())
        for part in ("user_consumed", "item_consumed"):
            assert {r[0]: r[1] for r in getattr(model.info, part).collect()} == {r[0]: r[1] for r in getattr(plain.info, part).collect()}
    users = plain.info.users.select("user").limit(8)
    assert sorted(again.recommend_user(users, 4).collect()) == sorted(plain.recommend_user(users, 4).collect())
    with pytest.raises(ValueError):
        (UserCF if kind is not UserCF else ItemCF).of_kept(spark, f"file://{tmp_path}")


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet") if not f.name.startswith(".")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    state = PartitionedState(spark, f"file://{tmp_path}", 8)
    add = lambda a, b: a.unionByName(b).groupBy("k").agg(F.sum("n").alias("n"))
    state.put("t", "k", spark.range(100).selectExpr("id as k", "1L as n"))
    state.put("other", "k", spark.range(5).selectExpr("id as k"))
    state.commit(folded=1)
    first = files(tmp_path)
    few = spark.createDataFrame([(3, 10), (1000, 7)], "k long, n long")
    touched = state.merge("t", few, add)
    assert 1 <= len(touched) <= 2
    with pytest.raises(RuntimeError):
        state.merge("t", few, add)
    # Nothing counts before the commit, and what was not committed goes.
    assert PartitionedState(spark, f"file://{tmp_path}").table("t").agg(F.sum("n")).first()[0] == 100
    state.discard()
    assert files(tmp_path) == first
    state.merge("t", few, add)
    reader = PartitionedState.__new__(PartitionedState)
    reader.__dict__.update(state.__dict__ | {"tables": dict(state.committed)})
    before = reader.table("t")
    state.commit(folded=2)
    assert before.agg(F.sum("n")).first()[0] == 100  # a reader of the version before
    now = files(tmp_path)
    assert first <= now and {f.split("/")[0] for f in now - first} == {"v2"}
    assert {f.split("__part=")[1].split("/")[0] for f in now - first} == set(touched)
    state.merge("t", few, add)
    state.commit(folded=3)
    gone = first - files(tmp_path)
    assert gone and all("/t/" in f and f.split("__part=")[1].split("/")[0] in touched for f in gone)  # two versions later
    again = PartitionedState(spark, f"file://{tmp_path}")
    rows = {r["k"]: r["n"] for r in again.table("t").collect()}
    assert again.notes == {"folded": 3} and rows[3] == 21 and rows[1000] == 14 and rows[50] == 1 and len(rows) == 101
    assert again.table("other").count() == 5 and names_in(spark, f"file://{tmp_path}/manifest") != []


def test_partitions_that_become_empty(spark, tmp_path):
    state = PartitionedState(spark, f"file://{tmp_path}", 4)
    state.put("t", "k", spark.range(3).selectExpr("id as k"))
    state.merge("t", spark.range(0).selectExpr("id as k"), lambda a, b: a)
    state.commit()
    state.merge("t", spark.range(3).selectExpr("id as k"), lambda a, b: a.join(b, "k", "left_anti"))
    state.commit()
    assert PartitionedState(spark, f"file://{tmp_path}").table("t").count() == 0


def streamed(spark, tmp_path, batches):
    for n, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    for n, f in enumerate(sorted((tmp_path / "in").glob("*/part*.parquet"))):
        (tmp_path / "feed").mkdir(exist_ok=True)
        f.rename(tmp_path / "feed" / f"{n}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_stream_of_batches(spark, batches, tmp_path):
    stream = streamed(spark, tmp_path, batches[:3])
    saves, seen = f"file://{tmp_path}/saves", []
    assert resumed(spark, ItemCF, saves) is None
    made = set(names_in(spark, scratch.scratch_dir(spark)))
    fit_stream(stream, ItemCF("rating", None), f"{tmp_path}/one", lambda m, k: seen.append(k), saves).awaitTermination()
    assert set(names_in(spark, scratch.scratch_dir(spark))) == made  # batches leave nothing but the state
    again = resumed(spark, ItemCF, saves)
    assert seen == [0, 1, 2] == list(range(again.folded + 1))
    assert sims(again) == wanted((0, 1, 2))
    # The same checkpoint goes on behind what is folded in.
    batches[3].coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("part*.parquet")).rename(tmp_path / "feed" / "9.parquet")
    fit_stream(stream, again, f"{tmp_path}/one", lambda m, k: seen.append(k)).awaitTermination()
    assert seen == [0, 1, 2, 3] and sims(again) == wanted((0, 1, 2, 3))


def test_a_lost_checkpoint_loses_no_rows(spark, batches, tmp_path):
    stream = streamed(spark, tmp_path, batches[:2])
    saves = f"file://{tmp_path}/saves"
    fit_stream(stream, ItemCF("rating", None), f"{tmp_path}/one", None, saves).awaitTermination()
    batches[3].coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("part*.parquet")).rename(tmp_path / "feed" / "9.parquet")
    with pytest.raises(Exception, match="another checkpoint"):
        fit_stream(stream, resumed(spark, ItemCF, saves), f"{tmp_path}/two").awaitTermination()
    assert sims(resumed(spark, ItemCF, saves)) == wanted((0, 1))
    model = resumed(spark, ItemCF, saves)
    fit_stream(stream, model, f"{tmp_path}/three", on_other_checkpoint="refit").awaitTermination()
    every = batches[:2] + batches[3:]
    assert model.folded == 2 and sims(model) == wanted((0, 1, 3)) == sims(resumed(spark, ItemCF, saves))
    assert model.info.users.count() == every[0].union(every[1]).union(every[2]).select("user").distinct().count()
    with pytest.raises(ValueError):
        fit_stream(stream, model, f"{tmp_path}/x", saves="file:///elsewhere")
    with pytest.raises(ValueError):
        fit_stream(stream, model, f"{tmp_path}/x", on_other_checkpoint="ignore")


def test_a_failed_batch_changes_nothing(spark, batches, tmp_path, monkeypatch):
    saves = f"file://{tmp_path}/saves"
    stream = streamed(spark, tmp_path, batches[:2])
    commit, calls = PartitionedState.commit, []

    def failing(self, **notes):
        calls.append(notes["folded"])
        if notes["folded"] == 1 and calls.count(1) == 1:
            raise RuntimeError("lost")
        return commit(self, **notes)

    monkeypatch.setattr(PartitionedState, "commit", failing)
    with pytest.raises(Exception, match="lost"):
        fit_stream(stream, ItemCF("rating", None), f"{tmp_path}/one", None, saves).awaitTermination()
    model = resumed(spark, ItemCF, saves)
    assert model.folded == 0 and sims(model) == wanted((0,))
    fit_stream(stream, model, f"{tmp_path}/one").awaitTermination()
    assert model.folded == 1 and sims(model) == wanted((0, 1))
