"""Fitted models as tables, and their predictions from these tables by joins and expressions.

A model written down this way can be read, compared and applied without the library that fitted it.
Predictions are those of the model: same classes, scores up to rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.sources.tables import fresh_path

#: Nodes of a forest up to which they are sent to every task.
BROADCAST_NODES = 1_000_000


def _fitted(model: PipelineModel):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def _saved(model: PipelineModel, name: str) -> DataFrame:
    """The data of the fitted estimator, written to shared storage by the executors."""
    spark = SparkSession.active()
    path = fresh_path(spark, name)
    _fitted(model).write().save(path)
    return spark.read.parquet(f"{path}/data")


def coefficients(model: PipelineModel, inputs: Sequence[str]) -> DataFrame:
    """(position, feature, coefficient) of a binary logistic regression; the intercept has position -1 and no feature."""
    fitted = _fitted(model)
    spark = SparkSession.active()
    rows = [(-1, None, float(fitted.intercept)), *((i, c, float(w)) for i, (c, w) in enumerate(zip(inputs, fitted.coefficients.toArray())))]
    return spark.createDataFrame(rows, "position int, feature string, coefficient double")


def tree_nodes(model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, left, right, shares) of a random forest; 0 is the root of each tree.

    ``feature`` is the position of the input that an inner node compares: values up to ``threshold`` go left. A leaf
    has -1 for ``left`` and ``right``. ``shares`` are those of the classes among the node's training rows.
    """
    node = F.col("nodeData")
    counts = node.impurityStats
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return _saved(model, "forest").select(
        F.col("treeID").alias("tree"),
        node.id.alias("node"),
        node.split.featureIndex.alias("feature"),
        F.get(node.split.leftCategoriesOrThreshold, F.lit(0)).alias("threshold"),
        node.leftChild.alias("left"),
        node.rightChild.alias("right"),
        F.transform(counts, lambda x: x / total).alias("shares"),
    )


def layer_weights(model: PipelineModel) -> DataFrame:
    """(layer, output, input, weight) of a multilayer perceptron; input -1 is the bias of an output.

    The stored vector holds, layer by layer, the weights input by input and then the biases.
    """
    sizes = [int(n) for n in _fitted(model).getLayers()]
    flat = _saved(model, "perceptron").select(F.posexplode(vector_to_array("weights")).alias("at", "weight"))
    layer, output, source = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")
    start = 0
    for i, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
        at = F.col("at") - start
        here = (at >= 0) & (at < (n_in + 1) * n_out)
        layer = F.when(here, i).otherwise(layer)
        output = F.when(here, at % n_out).otherwise(output)
        source = F.when(here & (at < n_in * n_out), F.floor(at / n_out)).when(here, -1).otherwise(source)
        start += (n_in + 1) * n_out
    return flat.select(layer.alias("layer"), output.alias("output"), source.cast("int").alias("input"), "weight")


def factors(model: ALSModel) -> DataFrame:
    """(side, id, factor, value) of a matrix factorisation; the sides are ``user`` and ``item``."""
    sides = [
        rows.select(F.lit(side).alias("side"), "id", F.posexplode("features").alias("factor", "value"))
        for side, rows in (("user", model.userFactors), ("item", model.itemFactors))
    ]
    return sides[0].unionByName(sides[1])


def _vector(inputs: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in inputs])


def _dot(left: Column, right: Column, start: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), start, lambda total, x: total + x)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def score_linear(rows: DataFrame, table: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """``rows`` with ``score``, the probability of class 1, and ``prediction``, from ``coefficients``.

    The coefficients enter the plan as one scalar query; rows are not shuffled.
    """
    weights = table.where("position >= 0").agg(F.array_sort(F.collect_list(F.struct("position", "coefficient"))).alias("w"))
    by_position = weights.select(F.transform("w", lambda w: w.coefficient)).scalar()
    intercept = table.where("position = -1").agg(F.max("coefficient")).scalar()
    weighted = rows.withColumns({"_weights": by_position, "_intercept": intercept})
    scored = weighted.withColumn("score", _logistic(_dot(_vector(inputs), F.col("_weights"), F.col("_intercept"))))
    return scored.withColumn("prediction", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)).drop("_weights", "_intercept")


def forest_depth(nodes: DataFrame) -> int:
    """The number of comparisons on the longest way to a leaf."""
    inner = nodes.where("left >= 0").select("tree", "node", F.explode(F.array("left", "right")).alias("child"))
    level, depth = inner.where("node = 0"), 0
    while level.limit(1).count():
        depth += 1
        level = inner.join(level.select("tree", F.col("child").alias("node")), ["tree", "node"])
    return depth


def score_forest(rows: DataFrame, nodes: DataFrame, inputs: Sequence[str], keys: Sequence[str], depth: int | None = None) -> DataFrame:
    """(keys.., score, prediction) from ``tree_nodes``: the mean share of class 1 over the leaves a row comes to.

    ``keys`` identify a row. Each row goes down all trees at once, one join a level; equal shares give class 0.
    Up to ``BROADCAST_NODES`` nodes are sent to every task; beyond that AQE splits the many rows of a root.
    """
    depth = forest_depth(nodes) if depth is None else depth
    small = F.broadcast if nodes.count() <= BROADCAST_NODES else (lambda df: df)
    trees = F.array_sort(F.collect_set("tree"))
    place = rows.select(*keys, _vector(inputs).alias("_x"), F.explode(nodes.agg(trees).scalar()).alias("tree"))
    place = place.withColumn("node", F.lit(0))
    step = nodes.select("tree", "node", "feature", "threshold", "left", "right")
    for _ in range(depth):
        down = F.when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        place = place.join(small(step), ["tree", "node"]).select(
            *keys, "_x", "tree", F.when(F.col("left") < 0, F.col("node")).otherwise(down).alias("node")
        )
    leaves = place.select(*keys, "tree", "node").join(small(nodes.select("tree", "node", "shares")), ["tree", "node"])
    summed = leaves.groupBy(*keys).agg(F.avg(F.get("shares", F.lit(0))).alias("_zero"), F.avg(F.get("shares", F.lit(1))).alias("_one"))
    return summed.select(
        *keys,
        (F.col("_one") / (F.col("_zero") + F.col("_one"))).alias("score"),
        F.when(F.col("_one") > F.col("_zero"), 1.0).otherwise(0.0).alias("prediction"),
    )


def score_layers(rows: DataFrame, table: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """``rows`` with ``score``, the probability of class 1, and ``prediction``, from ``layer_weights``.

    Hidden layers are logistic, the last one is a softmax over two classes. Weights enter as scalar queries, one a layer.
    """
    last = table.agg(F.max("layer")).first()[0]
    values = _vector(inputs)
    for i in range(last + 1):
        by_output = (
            table.where(F.col("layer") == i)
            .groupBy("output")
            .agg(
                F.array_sort(F.collect_list(F.when(F.col("input") >= 0, F.struct("input", "weight")))).alias("w"),
                F.max(F.when(F.col("input") == -1, F.col("weight"))).alias("bias"),
            )
            .select("output", "bias", F.transform("w", lambda w: w.weight).alias("w"))
        )
        layer = by_output.agg(F.array_sort(F.collect_list(F.struct("output", "bias", "w")))).scalar()
        rows = rows.withColumns({"_values": values, "_layer": layer}).withColumn(
            "_values", F.transform("_layer", lambda o: _dot(F.col("_values"), o.w, F.lit(0.0)) + o.bias)
        )
        values = F.transform("_values", _logistic) if i < last else F.col("_values")
    zero, one = F.get("_values", F.lit(0)), F.get("_values", F.lit(1))
    return rows.withColumns(
        {"score": _logistic(one - zero), "prediction": F.when(one > zero, 1.0).otherwise(0.0)}
    ).drop("_values", "_layer")


def score_factors(pairs: DataFrame, table: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """``pairs`` with ``prediction`` from ``factors``; pairs with an unseen user or item are dropped."""

    def side(name: str, key: str) -> DataFrame:
        values = F.transform(F.array_sort(F.collect_list(F.struct("factor", "value"))), lambda f: f.value.cast("double"))
        return table.where(F.col("side") == name).groupBy(F.col("id").alias(key)).agg(values.alias(f"_{name}"))

    both = pairs.join(side("user", user), user).join(side("item", item), item)
    return both.select(*pairs.columns, _dot(F.col("_user"), F.col("_item"), F.lit(0.0)).alias("prediction"))
