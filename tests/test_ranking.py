import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.operators import ranking


def brute_share(counts, share, largest):
    order = sorted(counts, key=lambda kv: (-kv[1] if largest else kv[1], kv[0]))
    return set(order[: int(len(order) * share)])


def test_extreme_k_breaks_ties_by_key(spark):
    counts = spark.createDataFrame([("d", 3), ("b", 3), ("a", 1), ("c", 3), ("e", 9)], "endpoint string, count long")
    top = [tuple(r) for r in ranking.extreme_k(counts, 3).collect()]
    assert top == [("e", 9), ("b", 3), ("c", 3)]
    low = [tuple(r) for r in ranking.extreme_k(counts, 2, largest=False).collect()]
    assert low == [("a", 1), ("b", 3)]
    some = ranking.extreme_k(counts, 5, where=F.col("endpoint") > "c").collect()
    assert [r[0] for r in some] == ["e", "d"]
    plan = ranking.extreme_k(counts, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_endpoint_long_and_rank_in_group(spark):
    counts = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef")], "endpoint string, count long")
    both = ranking.endpoint_long(ranking.extreme_k(counts, 2), ranking.extreme_k(counts, 2, largest=False))
    assert sorted(tuple(r) for r in both.collect()) == [
        ("bottom", 1, "a", 0),
        ("bottom", 2, "b", 1),
        ("top", 1, "f", 5),
        ("top", 2, "e", 4),
    ]
    rows = spark.range(0, 1000).select((F.col("id") % 3 == 0).alias("g"), "id")
    ranked = ranking.rank_in_group(rows, "g", [F.col("id").desc()], 2)
    assert sorted(tuple(r) for r in ranked.collect()) == [
        (False, 997, 2),
        (False, 998, 1),
        (True, 996, 2),
        (True, 999, 1),
    ]
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_limit_sample(spark):
    rows = ranking.limit_sample(spark.range(100).repartition(7), ["id"], 3).collect()
    assert [r[0] for r in rows] == [0, 1, 2]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("share", [0.0, 0.1, 0.37, 1.0])
def test_share_where_one_level_holds_most_keys(spark, largest, share):
    rng = random.Random(1)
    keys = rng.sample(range(10**6), 3000)
    # Nearly all keys share one count, so the cut always falls among thousands of equal keys.
    counts = [(k, 1 if rng.random() < 0.9 else rng.randint(2, 50)) for k in keys]
    df = spark.createDataFrame(counts, "user_id long, n_ratings long").repartition(4)
    got = ranking.extreme_share(df, share, largest, slices=16).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_share(counts, share, largest)


def test_share_per_group_and_for_text_keys(spark):
    rng = random.Random(2)
    counts = [(fold, f"u{rng.randint(0, 10**9)}", rng.randint(1, 4)) for fold in range(3) for _ in range(200 + fold)]
    df = spark.createDataFrame(counts, "fold int, user_id string, n_ratings long")
    got = {tuple(r) for r in ranking.extreme_share(df, 0.1, by="fold", slices=4).collect()}
    want = set()
    for fold in range(3):
        part = [(k, n) for f, k, n in counts if f == fold]
        want |= {(fold, k, n) for k, n in brute_share(part, 0.1, True)}
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    counts=st.dictionaries(st.integers(-(2**31), 2**31 - 1), st.integers(1, 4), max_size=40),
    share=st.sampled_from([0.1, 0.25, 0.5]),
    largest=st.booleans(),
)
def test_share_equals_sorting(spark, counts, share, largest):
    df = spark.createDataFrame(list(counts.items()), "user_id int, n_ratings int")
    got = {tuple(r) for r in ranking.extreme_share(df, share, largest, slices=3).collect()}
    assert got == brute_share(list(counts.items()), share, largest)


def test_share_sorts_no_whole_table(spark):
    df = spark.range(5000).select(F.col("id").alias("user_id"), F.lit(1).alias("n_ratings"))
    plan = ranking.extreme_share(df, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "rangepartitioning" not in plan


def test_share_with_other_partitions_and_without_adaptive_plans(spark):
    rng = random.Random(10)
    counts = [(k, rng.choice([1, 1, 1, 2])) for k in range(400)]
    df = spark.createDataFrame(counts, "user_id int, n_ratings int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {tuple(r) for r in ranking.extreme_share(df, 0.3, slices=8).collect()}
        assert got == brute_share(counts, 0.3, True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
