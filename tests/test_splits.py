import hashlib

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import splits


def bucket(text, n):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % n


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.range(2000).select((F.col("id") % 50).alias("u"), F.col("id").alias("i")).cache()


def test_folds_follow_the_hash_and_partition_the_rows(pairs):
    rows = splits.assign_folds(pairs, ["u", "i"], 5).collect()
    assert all(r["fold"] == bucket(f"folds-{r['u']}-{r['i']}", 5) for r in rows)
    sizes = {r["fold"]: r for r in splits.fold_sizes(splits.assign_folds(pairs, ["u", "i"], 5)).collect()}
    assert set(sizes) == set(range(5))
    assert sum(r["n_test"] for r in sizes.values()) == 2000
    assert all(r["n_train"] + r["n_test"] == 2000 for r in sizes.values())


def test_training_part_is_the_rest(pairs):
    folded = splits.assign_folds(pairs, ["u", "i"], 5)
    train = splits.training_part(folded, 2)
    assert train.where("fold = 2").count() == 0
    assert train.count() + folded.where("fold = 2").count() == 2000


def test_sample_and_holdout(pairs):
    got = {r["i"] for r in splits.hash_sample(pairs, ["i"], 0.25).collect()}
    assert got == {i for i in range(2000) if bucket(f"sample-{i}", 100) < 25}
    parts = {r["part"]: r["n_rows"] for r in splits.split_counts(splits.holdout(pairs, ["i"], 0.2)).collect()}
    assert parts["test"] == sum(bucket(f"holdout-{i}", 100) < 20 for i in range(2000))
    assert sum(parts.values()) == 2000
    with pytest.raises(ValueError):
        splits.hash_sample(pairs, ["i"], 0.001)
    assert splits.hash_sample(pairs, ["i"], 0.001, resolution=1000).count() < 20


def test_random_forms(pairs):
    assert 300 < splits.hash_sample(pairs, None, 0.2).count() < 500
    parts = {r["part"]: r["n_rows"] for r in splits.split_counts(splits.holdout(pairs, None, 0.2)).collect()}
    assert sum(parts.values()) == 2000 and 300 < parts["test"] < 500


def test_keyed_splits_do_not_shuffle(pairs):
    plan = splits.holdout(splits.assign_folds(pairs, ["u", "i"]), ["u"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


@pytest.mark.parametrize("fraction", [0.01, 0.2])
def test_sample_of_a_training_part_keeps_its_share(spark, fraction):
    keys = spark.range(60000)
    train = splits.holdout(keys, ["id"]).where("part = 'train'")
    sample = splits.hash_sample(train, ["id"], fraction)
    assert sample.count() == pytest.approx(48000 * fraction, rel=0.15)
    for k in (3, 5):
        sizes = [r["n_test"] for r in splits.fold_sizes(splits.assign_folds(sample, ["id"], k)).collect()]
        assert len(sizes) == k and min(sizes) > 0.7 * sum(sizes) / k
