"""Predictions from a model written down as a table equal those of the model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.operators import classify, model_tables, recommend

INPUTS = [f"_c{i}" for i in range(5)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    data = []
    for i in range(600):
        x = [round(rng.gauss(0, 1), 2) for _ in INPUTS]
        data.append((i, *x, int(x[0] * x[1] + 0.3 * rng.gauss(0, 1) > 0)))
    return spark.createDataFrame(data, "id int, " + ", ".join(f"{c} double" for c in INPUTS) + ", label int").cache()


def expected(model, rows):
    return {r["id"]: (r["score"], r["prediction"]) for r in classify.score(model, rows).collect()}


def compare(found, want):
    got = {r["id"]: (r["score"], r["prediction"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for i, (score, prediction) in want.items():
        assert got[i][0] == pytest.approx(score, abs=1e-9)
        assert got[i][1] == prediction or abs(score - 0.5) < 1e-9


@pytest.mark.parametrize("params", [{"maxDepth": 6, "numTrees": 7}, {"maxDepth": 0, "numTrees": 2}, {"maxDepth": 3, "numTrees": 1, "minInfoGain": 0.05}])
def test_forest(rows, params, monkeypatch):
    model = classify.fit("rf", rows, params, inputs=INPUTS)
    nodes = model_tables.tree_nodes(model)
    assert nodes.count() == model.stages[-1].totalNumNodes
    assert model_tables.forest_depth(nodes) == max(t.depth for t in model.stages[-1].trees)
    compare(model_tables.score_forest(rows, nodes, INPUTS, ["id"]), expected(model, rows))
    monkeypatch.setattr(model_tables, "BROADCAST_NODES", 0)
    compare(model_tables.score_forest(rows, nodes, INPUTS, ["id"]), expected(model, rows))


@pytest.mark.parametrize("params", [{"maxIter": 20}, {"maxIter": 5, "elasticNetParam": 1.0, "regParam": 0.3}])
def test_regression(rows, params):
    model = classify.fit("lr", rows, params, inputs=INPUTS)
    table = model_tables.coefficients(model, INPUTS)
    assert [r["feature"] for r in table.orderBy("position").collect()] == [None, *INPUTS]
    compare(model_tables.score_linear(rows, table, INPUTS), expected(model, rows))


@pytest.mark.parametrize("layers", [[5, 4, 2], [5, 2], [5, 3, 6, 2]])
def test_perceptron(rows, layers):
    model = classify.fit("mlp", rows, {"layers": layers, "maxIter": 15}, inputs=INPUTS)
    table = model_tables.layer_weights(model)
    sizes = {(r["layer"]): (r["n_out"], r["n_in"]) for r in table.groupBy("layer").agg(F.countDistinct("output").alias("n_out"), F.countDistinct("input").alias("n_in")).collect()}
    assert sizes == {i: (b, a + 1) for i, (a, b) in enumerate(zip(layers, layers[1:]))}
    compare(model_tables.score_layers(rows, table, INPUTS), expected(model, rows))


def test_factors(spark):
    rng = np.random.default_rng(1)
    rated = spark.createDataFrame(
        [(int(u), int(i), float(rng.integers(1, 11)) / 2) for u in range(20) for i in rng.choice(30, 8, replace=False)],
        "user_id int, item_id int, rating double",
    )
    model, scored = recommend.als_predict(rated, rated, rank=3, max_iter=3, blocks=2)
    pairs = scored.withColumnRenamed("prediction", "fitted").unionByName(
        spark.createDataFrame([(999, 1, 1.0, 0.0)], "user_id int, item_id int, rating double, fitted float")
    )
    found = model_tables.score_factors(pairs, model_tables.factors(model)).collect()
    assert len(found) == scored.count()
    for r in found:
        assert r["prediction"] == pytest.approx(r["fitted"], rel=1e-5, abs=1e-5)
