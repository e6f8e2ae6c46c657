import math
import random
import threading
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import recommend, splits
from cairnspark.operators.metrics import rmse
from cairnspark.plans import ratings
from cairnspark.sources import materialise
from cairnspark.sources.tables import release_unused

USERS, ITEMS = 60, 40


@pytest.fixture(scope="module")
def folded(spark):
    """Rank-one ratings: user taste times item quality. One user rates far more than the others."""
    rng = random.Random(4)
    rows = []
    for u in range(USERS):
        for i in rng.sample(range(ITEMS), ITEMS if u == 0 else rng.randint(3, 25)):
            rows.append((u, i, 1.0 + 4.0 * ((u * 7) % 11) / 10 * ((i * 3) % 13) / 12))
    rows.append((999, 0, 3.0))  # a user with one rating: cold whenever it is a test row
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    return materialise(splits.assign_folds(df, ["user_id", "item_id"]), "folds", ["fold"])


@pytest.fixture(scope="module")
def cv(folded):
    return recommend.als_cv(folded, {"a": {"rank": 3, "reg": 0.01}, "b": {"rank": 1, "reg": 0.3}}, max_iter=8, parallelism=4)


def test_planted_ratings_are_learned(folded, cv):
    spread = folded.agg(F.stddev("rating")).first()[0]
    report = {(r["variant"], r["fold"]): r for r in recommend.cv_report(cv.predictions, folded).collect()}
    assert len(report) == 10
    for fold in range(5):
        assert report["a", fold]["rmse"] < spread / 3
        assert report["a", fold]["rmse"] < report["b", fold]["rmse"]
    # Every test row is scored but that of the user without any training row.
    assert sum(report["a", f]["n_test"] - report["a", f]["n_scored"] for f in range(5)) == 1


def test_factors_of_every_fit_are_stored(cv):
    rows = cv.item_factors.groupBy("variant", "fold").agg(F.count(F.lit(1)), F.max(F.size("features"))).collect()
    assert {(r[0], r[3]) for r in rows} == {("a", 3), ("b", 1)} and all(r[2] == ITEMS for r in rows)


def test_training_activity(folded):
    want = Counter()
    for r in folded.collect():
        for fold in range(5):
            if r["fold"] != fold:
                want[fold, r["user_id"]] += 1
    got = {(r["fold"], r["user_id"]): r["n_ratings"] for r in recommend.training_activity(folded).collect()}
    assert got == want


def test_group_rmse_against_loops(folded, cv):
    activity = recommend.training_activity(folded)
    got = {
        (r["variant"], r["fold"], r["grp"]): (r["n_scored"], r["rmse"])
        for r in recommend.group_rmse(cv.predictions, activity).collect()
    }
    counts = defaultdict(dict)
    for r in activity.collect():
        counts[r["fold"]][r["user_id"]] = r["n_ratings"]
    errors = defaultdict(list)
    for r in cv.predictions.collect():
        users = counts[r["fold"]]
        n = int(len(users) * 0.1)
        hot = sorted(users, key=lambda u: (-users[u], u))[:n]
        cool = sorted(users, key=lambda u: (users[u], u))[:n]
        for grp, members in (("hot", hot), ("cool", cool)):
            if r["user_id"] in members:
                errors[r["variant"], r["fold"], grp].append((r["rating"] - r["prediction"]) ** 2)
    assert set(got) == set(errors)
    for key, squares in errors.items():
        assert got[key][0] == len(squares)
        assert got[key][1] == pytest.approx(math.sqrt(sum(squares) / len(squares)))


def test_group_errors_recombine(spark, folded, cv):
    """With a share of one, the group holds all users and its error is the total error."""
    report = recommend.group_rmse(cv.predictions, recommend.training_activity(folded), share=1.0).collect()
    total = {(r["variant"], r["fold"]): r["rmse"] for r in rmse(cv.predictions, ["variant", "fold"]).collect()}
    for r in report:
        assert r["rmse"] == pytest.approx(total[r["variant"], r["fold"]])
    assert recommend.rmse_long(spark.createDataFrame(report)).columns == ["variant", "fold", "grp", "rmse"]


def test_recommendations(folded):
    model, scored = recommend.als_predict(folded.where("fold > 0"), folded.where("fold = 0"), rank=3, reg=0.01, blocks=2)
    assert scored.where(F.col("prediction").isNull()).count() == 0
    by_user = defaultdict(list)
    for r in recommend.recommend_users(model, 5).collect():
        by_user[r["user_id"]].append((r["rank"], r["item_id"], r["score"]))
    for recs in by_user.values():
        recs.sort()
        assert [r[0] for r in recs] == [1, 2, 3, 4, 5] and len({r[1] for r in recs}) == 5
        assert all(a[2] >= b[2] for a, b in zip(recs, recs[1:]))
    items = folded.select("item_id").distinct().orderBy("item_id").limit(3)
    rows = recommend.recommend_items(model, items, 4).collect()
    assert Counter(r["item_id"] for r in rows) == {0: 4, 1: 4, 2: 4}


def test_semi_join_keeps_rows_of_the_group_only(spark, cv):
    users = spark.createDataFrame([(0,), (3,)], "user_id int")
    got = recommend.semi_to_group(cv.predictions, users)
    assert {r[0] for r in got.select("user_id").distinct().collect()} == {0, 3}
    assert got.columns == cv.predictions.columns


def test_a_user_with_most_rows_is_split_in_the_semi_join(spark):
    """Beyond the broadcast size, AQE splits the partition of a hot user."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pred = spark.range(0, 200000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5000).cast("int").alias("user_id"),
            F.xxhash64("id").alias("x"),
        )
        users = spark.range(0, 1000).select(F.col("id").cast("int").alias("user_id"))
        joined = recommend.semi_to_group(pred, users)
        n = joined.collect()
        assert len(n) == sum(1 for i in range(200000) if (7 if i % 3 else i % 5000) < 1000)
        assert "skewed" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fit_sends_factors_to_few_item_blocks(spark, monkeypatch):
    """The same fit as with as many item blocks as user blocks, with less sent and stored every other iteration."""
    seen = []

    class Spy(recommend.ALS):
        def fit(self, *args):
            seen.append((self.getNumUserBlocks(), self.getNumItemBlocks(), self.getCheckpointInterval()))
            return super().fit(*args)

    monkeypatch.setattr(recommend, "ALS", Spy)
    rows = [(u, i, float((u * 7 + i * 3) % 10) / 2 + 0.5) for u in range(40) for i in range(30) if (u + i) % 3]
    rated = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    few, _ = recommend.als_predict(rated, rated, rank=3, max_iter=5)
    many, _ = recommend.als_predict(rated, rated, rank=3, max_iter=5, blocks=10)
    assert seen == [(10, 4, 2), (10, 10, 2)]
    for side in ("userFactors", "itemFactors"):
        a, b = ({r["id"]: r["features"] for r in getattr(m, side).collect()} for m in (few, many))
        assert a.keys() == b.keys()
        assert all(x == pytest.approx(y, rel=1e-4, abs=1e-5) for key in a for x, y in zip(a[key], b[key]))


def test_cross_validation_drops_what_its_fits_hold(spark, folded):
    """What a fit holds in memory and on disk goes when its tables are written, but for the last fit of each thread."""
    held = spark.sparkContext._jsc.getPersistentRDDs
    release_unused(spark)
    time.sleep(2)
    before = set(held().keys())
    recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, max_iter=3, parallelism=2)
    until = time.monotonic() + 20
    while len(set(held().keys()) - before) > 4 and time.monotonic() < until:
        time.sleep(0.2)
    assert len(set(held().keys()) - before) <= 4  # factors of users and items, where five fits have ten tables


def _blocks_seen(monkeypatch) -> list[tuple[int, int]]:
    seen = []

    class Spy(recommend.ALS):
        def fit(self, *args):
            seen.append((self.getNumUserBlocks(), self.getNumItemBlocks()))
            return super().fit(*args)

    monkeypatch.setattr(recommend, "ALS", Spy)
    return seen


def test_folds_of_many_ratings_are_fitted_in_few_blocks(spark, folded, monkeypatch):
    """Ten user blocks for each of several fits at a time send an item's factors up to ten times in every iteration."""
    seen = _blocks_seen(monkeypatch)
    monkeypatch.setattr(recommend, "MANY_RATINGS", 1)
    recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, max_iter=1, parallelism=4)
    assert seen == [(4, 4)] * 5
    seen.clear()
    recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, k=1, max_iter=1, blocks=3)
    assert seen == [(3, 3)]


def test_holdout_fit_of_many_ratings_has_few_blocks(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 41).select(F.col("id").alias("o_orderkey"), (F.col("id") % 8).alias("o_custkey"))
    lines = spark.range(400).select(
        (F.col("id") % 40 + 1).alias("l_orderkey"),
        (F.col("id") * 7 % 30).alias("l_partkey"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = _blocks_seen(monkeypatch)
    monkeypatch.setattr(recommend, "MANY_RATINGS", 1)
    assert ratings.als_predict(spark, str(tmp_path)).count() > 0
    assert seen == [(4, 4)]


def test_blocks_follow_tasks_and_ratings(spark, monkeypatch):
    """Fits of fewer ratings keep the blocks, and with them the starts, that they always had."""
    few = spark.range(10)
    assert recommend.fit_blocks(few) == recommend.fit_blocks(few, 4) == {"blocks": 10, "item_blocks": 4}
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 12)
    assert recommend.fit_blocks(few) == {"blocks": 12, "item_blocks": 4}
    many = spark.range(recommend.MANY_RATINGS)
    assert recommend.fit_blocks(many) == {"blocks": 6, "item_blocks": 4}
    assert recommend.fit_blocks(many, 4) == {"blocks": 4, "item_blocks": 4}


def test_fits_on_many_ratings_wait_for_tasks(spark, folded, monkeypatch):
    """Every fit at work holds shuffle files: four of four blocks each are two too many for eight tasks."""
    lock, at_work, most, events = threading.Lock(), [0], [0], []

    class Spy(recommend.ALS):
        def fit(self, *args):
            with lock:
                at_work[0] += 1
                most[0] = max(most[0], at_work[0])
                events.append("fit")
            try:
                time.sleep(0.5)
                return super().fit(*args)
            finally:
                with lock:
                    at_work[0] -= 1

    monkeypatch.setattr(recommend, "ALS", Spy)
    monkeypatch.setattr(recommend, "release_unused", lambda spark: events.append("release"))
    monkeypatch.setattr(recommend, "MANY_RATINGS", 1)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 8)
    cv = recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, max_iter=1, parallelism=4)
    assert most[0] == 2 and events.count("fit") == 5
    assert events[0] == "release"  # the files left by the table of folds go before the first fit
    assert cv.predictions.select("fold").distinct().count() == 5


def test_fits_at_work_follow_tasks_and_ratings(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 12)
    assert recommend.fits_at_work(spark.range(10), 4) == 4
    many = spark.range(recommend.MANY_RATINGS)
    assert [recommend.fits_at_work(many, n) for n in (1, 2, 4)] == [1, 2, 3]
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 2)
    assert recommend.fits_at_work(many, 4) == 1


def test_stored_folds_are_sorted_by_user(spark, tmp_path):
    """So the blocks of a fit hold runs of one user, which compress better on the way."""
    orders = spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") * 37 % 101).alias("o_custkey"))
    lines = spark.range(3000).select(
        (F.col("id") * 11 % 400).alias("l_orderkey"),
        (F.col("id") * 7 % 53).alias("l_partkey"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    stored = ratings.stored_folds(spark, str(tmp_path))
    assert sorted(stored.collect()) == sorted(ratings.folded(spark, str(tmp_path)).collect())
    files = stored.inputFiles()
    assert len(files) >= ratings.K
    for path in files:
        keys = [(r["user_id"], r["item_id"]) for r in spark.read.parquet(path).collect()]
        assert keys == sorted(keys) and len(keys) > 1


def test_a_stored_fit_is_scored_without_its_files(spark, folded, monkeypatch):
    """Else the files of its blocks and last factors are on disk together with those of the joins that score."""
    held = spark.sparkContext._jsc.getPersistentRDDs
    release_unused(spark)
    time.sleep(2)
    before, left, written = set(held().keys()), [], recommend.write_parquet

    def write(df, path, *args, **kwargs):
        if "fold-predictions" in path:
            until = time.monotonic() + 10
            while set(held().keys()) - before and time.monotonic() < until:
                time.sleep(0.2)
            left.append(len(set(held().keys()) - before))
        written(df, path, *args, **kwargs)

    monkeypatch.setattr(recommend, "write_parquet", write)
    monkeypatch.setattr(recommend, "MANY_RATINGS", 1)
    recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, k=2, max_iter=2, parallelism=1)
    assert left == [0, 0]


def test_a_stored_fit_gives_the_same_scores(spark, folded, tmp_path):
    train, test = folded.where("fold > 0"), folded.where("fold = 0")
    keys = ["user_id", "item_id", "prediction"]
    rows = [
        {(r[0], r[1]): r[2] for r in recommend.als_predict(train, test, rank=3, blocks=2, **how)[1].select(*keys).collect()}
        for how in ({}, {"store": f"{tmp_path}/model", "checkpoint": 1})
    ]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) > 50
    assert all(rows[1][key] == pytest.approx(value, rel=1e-4) for key, value in rows[0].items())


def test_models_of_the_folds_are_deleted(spark, folded, tmp_path, monkeypatch):
    paths = []

    def fresh(spark, name):
        paths.append(tmp_path / name)
        return str(paths[-1])

    monkeypatch.setattr(recommend, "fresh_path", fresh)
    monkeypatch.setattr(recommend, "MANY_RATINGS", 1)
    recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, k=2, max_iter=1)
    assert sorted(p.name for p in paths if p.exists()) == ["fold-item-factors", "fold-predictions"]


@pytest.mark.parametrize("many,expected", [(1, (2, {1})), (10**9, (4, {2}))])
def test_fits_on_many_ratings_hold_no_more_on_more_tasks(spark, folded, monkeypatch, many, expected):
    """Two at a time however many tasks there are, and sent factors on disk for one iteration, not two."""
    lock, at_work, most, seen = threading.Lock(), [0], [0], set()

    class Spy(recommend.ALS):
        def fit(self, *args):
            with lock:
                at_work[0] += 1
                most[0] = max(most[0], at_work[0])
                seen.add(self.getCheckpointInterval())
            try:
                time.sleep(1)
                return super().fit(*args)
            finally:
                with lock:
                    at_work[0] -= 1

    monkeypatch.setattr(recommend, "ALS", Spy)
    monkeypatch.setattr(recommend, "MANY_RATINGS", many)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 16)
    recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, max_iter=1, parallelism=4, blocks=2)
    assert (most[0], seen) == expected


def test_blocks_of_a_cross_validation_follow_the_ratings(spark, monkeypatch):
    """A task's memory is that of one block, so a block holds no more on larger tables."""
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 12)
    monkeypatch.setattr(recommend, "MANY_RATINGS", 1)
    monkeypatch.setattr(recommend, "BLOCK_RATINGS", 100)
    assert recommend.bounded_blocks(spark.range(400), 4) == recommend.fit_blocks(spark.range(400), 4)
    assert recommend.bounded_blocks(spark.range(4001), 4) == {"blocks": 41, "item_blocks": 41, "hold": "DISK_ONLY"}
    # More user blocks than needed stay as they are.
    assert recommend.bounded_blocks(spark.range(500), 1) == {"blocks": 6, "item_blocks": 5, "hold": "DISK_ONLY"}


@pytest.mark.parametrize("share,expected", [(6, (1, {(6, 6, "DISK_ONLY")})), (1, (2, {(4, 4, "MEMORY_AND_DISK")}))])
def test_fits_of_bounded_blocks_run_one_at_a_time(spark, folded, monkeypatch, share, expected):
    """As many blocks as the session has tasks leave nothing to a second fit but the disk it holds."""
    lock, at_work, most, seen = threading.Lock(), [0], [0], set()

    class Spy(recommend.ALS):
        def fit(self, *args):
            with lock:
                at_work[0] += 1
                most[0] = max(most[0], at_work[0])
                seen.add((self.getNumUserBlocks(), self.getNumItemBlocks(), self.getIntermediateStorageLevel()))
            try:
                time.sleep(0.5)
                return super().fit(*args)
            finally:
                with lock:
                    at_work[0] -= 1

    monkeypatch.setattr(recommend, "ALS", Spy)
    monkeypatch.setattr(recommend, "MANY_RATINGS", 1)
    monkeypatch.setattr(recommend, "BLOCK_RATINGS", -(-folded.count() // share))
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 8)
    cv = recommend.als_cv(folded, {"a": {"rank": 2, "reg": 0.1}}, max_iter=1, parallelism=4)
    assert (most[0], seen) == expected
    n_test = {r["fold"]: r["n_test"] for r in recommend.cv_report(cv.predictions, folded).collect()}
    assert n_test == {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
