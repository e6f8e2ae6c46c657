"""Binary classification on wide numeric tables: assemble, tune on a sample, refit, score."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import hash_bucket
from cairnspark.operators.metrics import accuracy
from cairnspark.operators.splits import SEED
from cairnspark.sources.tables import ensure_checkpoint_dir, exists, fresh_path, materialise, write_parquet

# Settings seen in the published runs.
DEFAULTS: dict[str, dict[str, Any]] = {
    "rf": {"numTrees": 20, "maxBins": 15, "seed": SEED, "cacheNodeIds": True},
    "lr": {"regParam": 0.01},
    "mlp": {"blockSize": 128, "solver": "l-bfgs", "stepSize": 0.03, "tol": 1e-6, "seed": SEED},
}
GRIDS: dict[str, dict[str, list]] = {
    "rf": {"maxDepth": [5, 10, 15], "minInfoGain": [0.0, 0.2]},
    "lr": {"elasticNetParam": [0.0, 1.0], "maxIter": [1, 5]},
    "mlp": {"maxIter": [1, 5]},
}
HIDDEN = 16

_ESTIMATORS = {"rf": RandomForestClassifier, "lr": LogisticRegression, "mlp": MultilayerPerceptronClassifier}


def recode_label(df: DataFrame, col: str, mapping: Mapping[int, int] | None = None) -> DataFrame:
    """Replace label values (-1 by 0 unless a mapping is given); others, and the type, stay."""
    value = F.col(col)
    for old, new in (mapping or {-1: 0}).items():
        value = F.when(F.col(col) == old, new).otherwise(value)
    return df.withColumn(col, value.cast(df.schema[col].dataType))


def feature_columns(df: DataFrame, label: str) -> list[str]:
    """The generated feature columns (``_c0`` ..) of a wide table."""
    return [c for c in df.columns if c.startswith("_c") and c[2:].isdigit() and c != label]


def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features") -> DataFrame:
    """Replace ``inputs`` by one vector column."""
    return VectorAssembler(inputCols=list(inputs), outputCol=out).transform(df).drop(*inputs)


def _estimator(kind: str, label: str, params: Mapping[str, Any], n_features: int):
    if kind not in _ESTIMATORS:
        raise ValueError(f"unknown model kind: {kind}")
    settings = {**DEFAULTS[kind], **params}
    if kind == "mlp":
        settings.setdefault("layers", [n_features, HIDDEN, 2])
    return _ESTIMATORS[kind](featuresCol="features", labelCol=label, **settings)


class Prepared(NamedTuple):
    rows: DataFrame  # features, label: a table in shared storage
    inputs: list[str]
    label: str


def prepare(train: DataFrame, label: str = "label", inputs: Sequence[str] | None = None, path: str | None = None) -> Prepared:
    """The training rows as vectors, assembled and written once, for any number of fits.

    Every fit reads its input at least twice (statistics first, then its own blocks of rows), and each time
    would put the vectors together again. Further columns of ``train`` are left out. The table stays until
    ``sources.release``, or until the end of the ``scratch`` block around the call.
    """
    inputs = list(inputs or feature_columns(train, label))
    rows = assemble(train.select(*inputs, label), inputs)
    return Prepared(materialise(rows, "assembled", path=path), inputs, label)


def fit(
    kind: str,
    train: DataFrame | Prepared,
    params: Mapping[str, Any] | None = None,
    label: str = "label",
    inputs: Sequence[str] | None = None,
) -> PipelineModel:
    """Fit ``rf``, ``lr`` or ``mlp`` as a pipeline that starts at the raw columns.

    ``train`` is a table, or the ``prepare``-d form of one, which knows its label and inputs. The model
    takes raw columns in both cases.

    The forest keeps node ids with the rows and cuts their lineage by checkpoints, so a deep forest
    does not ship its trees with every task. Each estimator holds its own form of the input
    in memory and disk while it iterates.
    """
    if isinstance(train, Prepared):
        ensure_checkpoint_dir(train.rows.sparkSession)
        assembler = VectorAssembler(inputCols=train.inputs, outputCol="features")
        estimator = _estimator(kind, train.label, params or {}, len(train.inputs))
        return PipelineModel(stages=[assembler, estimator.fit(train.rows)])
    ensure_checkpoint_dir(train.sparkSession)
    inputs = list(inputs or feature_columns(train, label))
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        _estimator(kind, label, params or {}, len(inputs)),
    ]
    return Pipeline(stages=stages).fit(train.select(*inputs, label))


class Tuned(NamedTuple):
    report: DataFrame  # model, grid_point, params, mean_metric, winner
    params: dict[str, Any]  # the winner's point of the grid
    model: PipelineModel  # the winner, fitted on all of the tuning rows
    metrics: DataFrame  # grid_point, fold, metric: the accuracy of each fit


METRICS = "grid_point int, fold int, metric double"


def grid_points(grid: Mapping[str, Sequence]) -> list[dict[str, Any]]:
    """All combinations; the values of the last name change first."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _named(point: Mapping[str, Any]) -> str:
    return ", ".join(f"{n}={v}" for n, v in sorted(point.items()))


def _identity(rows: DataFrame, *settings: Any) -> str:
    """A name for a tuning: its settings, and the number and a hash of its rows in any order."""
    seen = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns)), F.sum(F.crc32(F.to_json(F.struct(*rows.columns)))))
    return hashlib.sha256(repr((*settings, tuple(seen.first()))).encode()).hexdigest()[:32]


def cv_tune(
    kind: str,
    df: DataFrame,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = 3,
    params: Mapping[str, Any] | None = None,
    label: str = "label",
    inputs: Sequence[str] | None = None,
    fold_keys: Sequence[str] | None = None,
    parallelism: int = 4,
    store: str | None = None,
) -> Tuned:
    """Cross-validate a grid by accuracy; meant for a sample of the training rows.

    Features are assembled and written once for all fits, by fold. Folds come from the hash of ``fold_keys``
    (of the feature columns if not given), so the folds are the same in every run.

    The metric of each (grid point, fold) is written as soon as it is known. With ``store``, a folder of
    the caller's, a later call with the same rows and settings finds them there and fits only what is left; other rows
    or settings have a folder of their own in it. Without, the metrics go to a fresh folder.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    inputs = list(inputs or feature_columns(df, label))
    fold = hash_bucket(fold_keys or inputs, folds, "tuning")
    plain = df.select(*inputs, label, fold.alias("_fold"))
    settings = {**DEFAULTS[kind], **(params or {})}
    points = grid_points(dict(grid or GRIDS[kind]))
    if store is None:
        path = fresh_path(spark, f"tuning-{kind}")
    else:
        path = f"{store.rstrip('/')}/{kind}-{_identity(plain, sorted(settings.items()), inputs, label, folds)}"
    rows = materialise(assemble(plain, inputs), f"tuning-rows-{kind}", ["_fold"])

    def place(i: int, f: int) -> str:
        # Under the point's own settings, so that a longer grid finds what a shorter one has left.
        return f"{path}/{hashlib.sha256(_named(points[i]).encode()).hexdigest()[:16]}/fold={f}"

    def known(i: int, f: int) -> float | None:
        if not exists(spark, f"{place(i, f)}/_SUCCESS"):
            return None
        return spark.read.schema("metric double").parquet(place(i, f)).first()["metric"]

    def run(task: tuple[int, int]) -> float:
        i, f = task
        metric = known(i, f) if store is not None else None
        if metric is None:
            estimator = _estimator(kind, label, {**(params or {}), **points[i]}, len(inputs))
            model = estimator.fit(rows.where(F.col("_fold") != f))
            metric = accuracy(model.transform(rows.where(F.col("_fold") == f)), label=label).first()["accuracy"]
            if metric is None:
                raise ValueError(f"fold {f} of the tuning has no rows")
            write_parquet(spark.createDataFrame([(metric,)], "metric double"), place(i, f))
        return metric

    tasks = [(i, f) for i in range(len(points)) for f in range(folds)]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        found = dict(zip(tasks, pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)))
    means = [sum(found[i, f] for f in range(folds)) / folds for i in range(len(points))]
    best = max(range(len(points)), key=lambda i: (means[i], -i))
    report = spark.createDataFrame(
        [(kind, i, _named(point), mean, i == best) for i, (point, mean) in enumerate(zip(points, means))],
        "model string, grid_point int, params string, mean_metric double, winner boolean",
    )
    winner = _estimator(kind, label, {**(params or {}), **points[best]}, len(inputs))
    model = Pipeline(stages=[winner]).fit(rows.drop("_fold"))
    metrics = spark.createDataFrame([(i, f, found[i, f]) for i, f in tasks], METRICS)
    return Tuned(report, points[best], model, metrics)


def refit(
    kind: str,
    train: DataFrame | Prepared,
    tuned: Tuned,
    params: Mapping[str, Any] | None = None,
    label: str = "label",
    inputs: Sequence[str] | None = None,
) -> PipelineModel:
    """Fit the winner of a tuning on the full training rows (``prepare`` them if several kinds are refitted)."""
    return fit(kind, train, {**(params or {}), **tuned.params}, label, inputs)


def score(model: PipelineModel, test: DataFrame) -> DataFrame:
    """``test`` with ``prediction`` and, as ``score``, the probability of class 1."""
    scored = model.transform(test)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability"
    )


def param_rows(model: PipelineModel, name: str) -> DataFrame:
    """(model, param, value): the settings of the fitted estimator."""
    from pyspark.sql import SparkSession

    settings = model.stages[-1].extractParamMap()
    rows = sorted((name, param.name, str(value)) for param, value in settings.items())
    return SparkSession.active().createDataFrame(rows, "model string, param string, value string")
