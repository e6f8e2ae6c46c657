import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cairnspark.operators import classify, metrics


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        x = [rng.gauss(0, 1) for _ in range(6)]
        rows.append((i, *x, 1 if x[0] + x[1] > 0 else -1))
    columns = ", ".join(f"_c{i} double" for i in range(6))
    return spark.createDataFrame(rows, f"vec_id int, {columns}, _c6 int").cache()


@pytest.fixture(scope="module")
def parts(table):
    coded = classify.recode_label(table, "_c6").withColumnRenamed("_c6", "label")
    return coded.where("vec_id < 480"), coded.where("vec_id >= 480")


def test_recode_keeps_type_and_other_values(spark):
    df = spark.createDataFrame([(-1,), (1,), (7,), (None,)], "y int")
    assert [r[0] for r in classify.recode_label(df, "y").collect()] == [0, 1, 7, None]
    assert [r[0] for r in classify.recode_label(df, "y", {7: 2}).collect()] == [-1, 1, 2, None]
    assert classify.recode_label(df, "y").schema == df.schema


def test_assemble(table):
    inputs = classify.feature_columns(table, "_c6")
    assert inputs == [f"_c{i}" for i in range(6)]
    row = classify.assemble(table, inputs).select("vec_id", vector_to_array("features").alias("v")).first()
    assert len(row["v"]) == 6


@pytest.mark.parametrize(
    "kind, params", [("rf", {"maxDepth": 5}), ("lr", {"maxIter": 5, "regParam": 0.01}), ("mlp", {"maxIter": 40, "layers": [6, 5, 2]})]
)
def test_models_beat_the_majority_class(parts, kind, params):
    train, test = parts
    model = classify.fit(kind, train, params)
    scored = classify.score(model, test)
    assert metrics.accuracy(scored).first()["accuracy"] > 0.8
    assert metrics.auc(scored).first()["auc"] > 0.9
    names = {r["param"]: r["value"] for r in classify.param_rows(model, kind).collect()}
    if kind == "rf":
        assert (names["numTrees"], names["maxBins"], names["impurity"]) == ("20", "15", "gini")


def test_unknown_kind(parts):
    with pytest.raises(ValueError):
        classify.fit("svm", parts[0])
    with pytest.raises(ValueError):
        classify.fit("svm", classify.prepare(parts[0]))


def test_prepared_rows_give_the_same_models(spark, parts, tmp_path):
    train, test = parts
    ready = classify.prepare(train.withColumn("features", F.lit("not the vector")), path=str(tmp_path / "ready"))
    assert ready.rows.columns == ["label", "features"] and ready.rows.count() == train.count()
    assert ready.inputs == classify.feature_columns(train, "label")

    def scores(kind, rows, **params):
        found = classify.score(classify.fit(kind, rows, params), test)
        assert found.columns == [*test.columns, "prediction", "score"]
        return {r["vec_id"]: r["score"] for r in found.collect()}

    for kind, params in (("lr", {"maxIter": 5}), ("mlp", {"maxIter": 20, "layers": [6, 5, 2]})):
        plain, stored = scores(kind, train, **params), scores(kind, ready, **params)
        assert stored == pytest.approx(plain, rel=1e-6, abs=1e-6)
    # The forest draws its rows by partition, so only its quality is comparable.
    forest = classify.score(classify.fit("rf", ready, {"maxDepth": 5}), test)
    assert metrics.accuracy(forest).first()["accuracy"] > 0.8


def test_refit_takes_prepared_rows(parts):
    train, test = parts
    tuned = classify.cv_tune("lr", train, {"regParam": [0.01, 10.0]}, folds=2, fold_keys=["vec_id"])
    plain, stored = (classify.refit("lr", rows, tuned).stages[-1].coefficients for rows in (train, classify.prepare(train)))
    assert list(stored) == pytest.approx(list(plain), rel=1e-6, abs=1e-9)


def test_tune_and_refit(parts):
    train, test = parts
    tuned = classify.cv_tune("lr", train, {"regParam": [0.01, 10.0], "elasticNetParam": [0.0, 1.0]}, folds=3, fold_keys=["vec_id"])
    rows = tuned.report.collect()
    assert len(rows) == 4 and sum(r["winner"] for r in rows) == 1
    winner = next(r for r in rows if r["winner"])
    assert winner["mean_metric"] == max(r["mean_metric"] for r in rows)
    assert tuned.params["regParam"] == 0.01 and "regParam=0.01" in winner["params"]
    # The same folds, and so the same report, in a second run.
    again = classify.cv_tune("lr", train, {"regParam": [0.01, 10.0], "elasticNetParam": [0.0, 1.0]}, folds=3, fold_keys=["vec_id"])
    assert [tuple(r) for r in again.report.collect()] == [tuple(r) for r in rows]
    model = classify.refit("lr", train, tuned)
    assert metrics.accuracy(classify.score(model, test)).first()["accuracy"] > 0.85
    names = {r["param"]: r["value"] for r in classify.param_rows(model, "lr").collect()}
    assert names["regParam"] == "0.01"


def test_a_stopped_tuning_goes_on_where_it_was(parts, tmp_path, monkeypatch):
    train, _ = parts
    grid, store = {"regParam": [0.01, 10.0], "elasticNetParam": [0.0, 1.0]}, str(tmp_path / "store")
    fits, stop_after = [], 5
    estimator = classify._estimator

    def counted(kind, label, params, n):
        if len(fits) == stop_after:
            raise RuntimeError("stopped")
        fits.append(dict(params))
        return estimator(kind, label, params, n)

    monkeypatch.setattr(classify, "_estimator", counted)

    def tune(rows=train, wanted=grid, **more):
        fits.clear()
        return classify.cv_tune("lr", rows, wanted, folds=3, fold_keys=["vec_id"], parallelism=1, store=store, **more)

    with pytest.raises(RuntimeError, match="stopped"):
        tune()
    stop_after = 100
    found = tune()
    assert len(fits) == 12 - 5 + 1  # what was left, and the winner on all rows
    whole = classify.cv_tune("lr", train, grid, folds=3, fold_keys=["vec_id"])
    assert sorted(found.metrics.collect()) == sorted(whole.metrics.collect())
    assert [tuple(r) for r in found.report.collect()] == [tuple(r) for r in whole.report.collect()]
    tune(wanted={"elasticNetParam": [1.0, 0.5], "regParam": [0.01]})
    assert len(fits) == 3 + 1  # of two points one is known, in whatever order names and values come
    for changed in ({"rows": train.where("vec_id <> 7")}, {"params": {"maxIter": 3}}):
        tune(**changed)
        assert len(fits) == 12 + 1


def test_default_grids_use_parameters_of_their_models(parts):
    for kind, grid in classify.GRIDS.items():
        estimator = classify._estimator(kind, "label", {}, 6)
        assert all(estimator.hasParam(name) for name in grid)
    assert parts[0].where(F.col("label").isNull()).count() == 0
