import numpy as np
import pytest

from cairnspark.operators import products, recommend


def brute(vectors, others, k):
    out = {}
    for i, v in vectors:
        scored = [(-float(np.float32(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w))))), j) for j, w in others]
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id int, features array<float>").repartition(3)


def vectors(rng, n, spread):
    return [(i, rng.standard_normal(6) * rng.exponential(1) ** spread) for i in range(n)]


@pytest.mark.parametrize("block_rows,round_bytes", [(8192, 32 << 20), (20, 1000), (7, 1)])
@pytest.mark.parametrize("spread", [0, 2])
def test_equal_to_all_products(spark, block_rows, round_bytes, spread):
    rng = np.random.default_rng(5)
    mine, others = vectors(rng, 90, 1), vectors(rng, 300, spread)
    others += [(1000 + i, others[i][1]) for i in range(40)]  # equal vectors: ties go by id
    mine += [(500, np.zeros(6)), (501, others[0][1])]
    found = products.best_products(frame(spark, mine), frame(spark, others), 5, block_rows, round_bytes).collect()
    want = brute(mine, others, 5)
    assert len(found) == len(mine)
    for r in found:
        assert [(i, pytest.approx(s, rel=1e-6)) for i, s in zip(r["ids"], r["scores"])] == want[r["id"]]
    made = sum(r["n_products"] for r in found if r["id"] != 500)
    if spread and block_rows < 100:
        assert made < 0.5 * 91 * len(others)  # long and short vectors: most are left out


def test_fewer_others_than_wanted_and_none(spark):
    rng = np.random.default_rng(6)
    mine, others = vectors(rng, 4, 1), vectors(rng, 3, 1)
    found = products.best_products(frame(spark, mine), frame(spark, others), 5, block_rows=2, round_bytes=1)
    assert {r["id"]: len(r["ids"]) for r in found.collect()} == {0: 3, 1: 3, 2: 3, 3: 3}
    none = products.best_products(frame(spark, mine), frame(spark, others).where("false"), 5).collect()
    assert [r["ids"] for r in none] == [[]] * 4
    assert products.best_products(frame(spark, mine).where("false"), frame(spark, others), 5).collect() == []


def test_recommendations_equal_those_of_the_model(spark):
    rng = np.random.default_rng(7)
    rows = [(int(u), int(i), float(rng.integers(1, 11)) / 2) for u in range(50) for i in rng.choice(120, 30, replace=False)]
    rated = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    model, _ = recommend.als_predict(rated, rated, rank=4, max_iter=4, blocks=2)
    want = {}
    for r in model.recommendForAllUsers(5).collect():
        want[r["user_id"]] = [(x["item_id"], x["rating"]) for x in r["recommendations"]]
    found = recommend.recommend_users(model, 5, block_rows=16, round_bytes=600)
    assert found.dtypes == [("user_id", "int"), ("rank", "int"), ("item_id", "int"), ("score", "float")]
    got = {}
    for r in found.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["item_id"], r["score"]))
    assert got.keys() == want.keys()
    for user, mine in got.items():
        assert [s for _, s in mine] == pytest.approx([s for _, s in want[user]], rel=1e-5)
        apart = min(abs(a[1] - b[1]) for a, b in zip(want[user], want[user][1:]))
        if apart > 1e-5:
            assert [i for i, _ in mine[:4]] == [i for i, _ in want[user][:4]]
    some = spark.createDataFrame([(3,), (4,), (999,)], "user_id int")
    assert {r[0] for r in recommend.recommend_users(model, 5, some).select("user_id").distinct().collect()} == {3, 4}
