import numpy as np

from cairnspark.llm import neighbours


def brute(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % 50 == 0:
            a = np.array(v)
            scored = []
            for j, w in good:
                if j != i:
                    b = np.array(w)
                    scored.append((-((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), j))
            out[i] = sorted(scored)[:k]
    return out


def vectors(rng, n):
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(n)]
    for i in range(0, n, 3):  # one very common vector
        rows[i] = (i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as leaves", "2 as rank", "0 as label")


def test_recall_and_order_against_brute_force(spark):
    rows = vectors(np.random.default_rng(3), 3000)
    rows += [(9000, None), (9050, [0.0] * 8), (9100, [float("nan")] * 8), (9150, [1.0] * 3), (9200, [1.0, None] * 4), (None, [1.0] * 8), rows[7], (9250, [float("inf")] + [1.0] * 7)]
    settings = neighbours.Settings(block_rows=500, trees=16)
    got = {}
    for r in neighbours.nearest(frame(spark, rows), settings).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    wanted = brute(rows, 5)
    assert got.keys() == wanted.keys()
    hits = 0
    for query, best in wanted.items():
        mine = sorted(got[query])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {b[1] for b in best})
    assert hits / (5 * len(wanted)) >= 0.9
    common = sorted(got[0])  # the common vector: ties go to the smallest ids
    assert [m[1] for m in common] == [3, 6, 9, 12, 15]


def test_few_rows_and_none(spark):
    rows = [(0, [1.0] * 8), (1, [1.0] * 7 + [0.5]), (50, [-1.0] * 8)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(frame(spark, rows)).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert neighbours.nearest(frame(spark, rows).where("false")).collect() == []
    assert neighbours.nearest(frame(spark, [(0, [1.0, 2.0])])).collect() == []


def test_one_id_with_several_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 40)]
    rows += [(50, rows[0][1]), (50, rows[1][1]), (50, rows[1][1]), (7, rows[2][1])]
    lists = {}
    for r in neighbours.nearest(frame(spark, rows), neighbours.Settings(trees=8), counted="n").collect():
        lists.setdefault((r.query_id, r.n, r.score if r["rank"] == 1 else None), r)
        assert r.vec_id != r.query_id and r.n <= 40
    firsts = sorted((r.query_id, r.vec_id) for r in lists.values() if r["rank"] == 1)
    assert firsts == [(50, 1), (50, 2)]  # a list for each vector of the id, the repeated row counts once


def test_recall_and_rows_compared_in_many_dimensions(spark):
    """Directions without any structure, the worst case; the share of rows compared falls as tables grow."""
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((8000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(rows, counted="n").collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    hits, compared = 0, {}
    for query in range(0, 8000, 50):
        score = unit @ unit[query]
        score[query] = -2
        best = set(np.argsort(-score)[:5].tolist())
        hits += sum(r.vec_id in best for r in found if r.query_id == query)
    for r in found:
        compared[r.query_id] = r.n
    assert len(compared) == 160 and hits >= 0.9 * 800
    assert sum(compared.values()) < 0.3 * 160 * 8000


def test_visits_do_not_go_through_the_driver(spark):
    """A query makes thousands of visits, which Spark's estimate does not know; broadcast, they fill the driver's memory."""
    found = neighbours.nearest(frame(spark, vectors(np.random.default_rng(6), 400)), neighbours.Settings(trees=4))
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [slot#" in line and "part#" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_leaves_hold_equal_shares():
    rng = np.random.default_rng(1)
    sample = rng.standard_normal((4096, 8))
    forest = neighbours.plant(sample, neighbours.Settings(trees=3, leaf_rows=32, node_rows=32))
    assert (forest.depth, forest.fitted) == (7, 7)
    counts = np.bincount(forest.leaves(sample)[:, 1], minlength=1 << forest.depth)
    assert counts.min() >= 28 and counts.max() <= 36
    deep = neighbours.plant(sample, neighbours.Settings(trees=3), n_rows=400_000)
    assert (deep.depth, deep.fitted) == (16, 6)
    more = rng.standard_normal((20_000, 8))
    halves = deep.leaves(more)[:, 0] >> 8
    assert np.bincount(halves, minlength=256).max() < 5 * 20_000 / 256
    for f in (forest, deep):
        own = f.leaves(sample[:50])
        for v, leaves in zip(sample[:50], own):
            first = {}
            for t, leaf, missed in f.search(v, -0.05):
                first.setdefault(t, leaf)
            assert all(leaves[t] == leaf for t, leaf in first.items())  # a tree is entered at the own leaf
    every = list(forest.search(sample[0], -np.inf))
    assert len(set(x[:2] for x in every)) == len(every) == 3 << forest.depth


def test_chances_are_fitted():
    rng = np.random.default_rng(2)
    sample = rng.standard_normal((2000, 16))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    forest = neighbours.plant(sample, neighbours.Settings(trees=24))
    near = []
    for v in sample[:100]:
        near.append(sample[np.argsort(-(sample @ v))[1:6]])
    fitted = neighbours.fit_search(forest, sample[:100], near, 0.9)
    hit = total = 0
    for v, others in zip(sample[:100], near):
        seen = {x[:2] for x in fitted.search(v)}
        for leaves in fitted.leaves(others):
            hit += any((t, leaf) in seen for t, leaf in enumerate(leaves.tolist()))
            total += 1
    assert 0.9 <= hit / total < 0.96
    assert neighbours.fit_search(forest, np.zeros((0, 16)), [], 0.9) is forest
