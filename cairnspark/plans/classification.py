"""Queries on the wide table: samples, labels, models, tuning and metrics."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.operators import classify, metrics, model_tables, splits
from cairnspark.operators.relational import union_all
from cairnspark.plans import views
from cairnspark.plans.registry import once, query
from cairnspark.plans.views import N_FEATURES, sql
from cairnspark.sources import fresh_path, materialise, read_checked, read_wide, wide_schema

LABEL = f"_c{N_FEATURES}"
INPUTS = [f"_c{i}" for i in range(N_FEATURES)]
# Settings of the single fits, as in the published runs.
FITS = {
    "rf": {"maxDepth": 15},
    "lr": {"elasticNetParam": 0.0, "maxIter": 5},
    "mlp": {"maxIter": 5},
}
GRIDS = classify.GRIDS
#: Share of the training rows that the grids are tuned on. The published runs take 0.01 of five
#: million rows; the smallest test table has 500.
TUNING_SHARE = 0.5


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted table, stored by train and test part."""

    def build():
        return materialise(splits.holdout(views.planted(spark, sf_dir), ["vec_id"]), "wide", partition_by=["part"])

    return once(spark, sf_dir, "wide-parts", build)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where("part = 'train'").drop("part")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where("part = 'test'").drop("part")


def fitted(spark: SparkSession, sf_dir: str, kind: str):
    return once(
        spark, sf_dir, f"fit-{kind}", lambda: classify.fit(kind, train(spark, sf_dir), FITS[kind], inputs=INPUTS)
    )


def tuned(spark: SparkSession, sf_dir: str, kind: str) -> classify.Tuned:
    return once(
        spark,
        sf_dir,
        f"tune-{kind}",
        lambda: classify.cv_tune(
            kind,
            splits.hash_sample(train(spark, sf_dir), ["vec_id"], TUNING_SHARE),
            GRIDS[kind],
            inputs=INPUTS,
            fold_keys=["vec_id"],
        ),
    )


def prepared(spark: SparkSession, sf_dir: str) -> classify.Prepared:
    """The training part as vectors, stored once for the refits of all kinds."""
    return once(spark, sf_dir, "wide-prepared", lambda: classify.prepare(train(spark, sf_dir), inputs=INPUTS))


def refitted(spark: SparkSession, sf_dir: str, kind: str):
    """The winner of the tuning, fitted on the whole training part."""
    return once(
        spark,
        sf_dir,
        f"refit-{kind}",
        lambda: classify.refit(kind, prepared(spark, sf_dir), tuned(spark, sf_dir, kind)),
    )


def scored(spark: SparkSession, sf_dir: str, kind: str, model=fitted) -> DataFrame:
    rows = classify.score(model(spark, sf_dir, kind), test(spark, sf_dir))
    return rows.select(F.lit(kind).alias("model"), "vec_id", "label", "prediction", "score")


# Table


@query("scan_wide_csv", sql("SELECT * EXCLUDE (vec_id) FROM v_wide", "v_wide"))
def scan_wide_csv(spark, sf_dir):
    path = fresh_path(spark, "wide-csv")
    views.wide(spark, sf_dir).drop("vec_id").write.csv(path)
    return read_wide(spark, path, N_FEATURES)


@query(
    "scan_wide_rejects",
    """SELECT CASE WHEN label >= 5 THEN 1 ELSE -1 END AS label, NULL::VARCHAR AS ends, count(*) AS n_rows
       FROM embeddings WHERE vec_id % 20 > 2 GROUP BY 1
       UNION ALL
       SELECT NULL, CASE vec_id % 20 WHEN 0 THEN 'one' WHEN 1 THEN 'short' ELSE 'long' END, count(*)
       FROM embeddings WHERE vec_id % 20 <= 2 GROUP BY ALL""",
)
def scan_wide_rejects(spark, sf_dir):
    """A wide file with broken lines: rows by label, rejected lines by their last value (word, feature, one too many)."""
    wide = views.wide(spark, sf_dir)
    values = [F.col(c).cast("string") for c in (*INPUTS, LABEL)]
    kind = F.col("vec_id") % 20
    line = F.concat_ws(",", *values)
    lines = wide.select(
        F.when(kind == 0, F.concat_ws(",", *values[:-1], F.lit("one")))
        .when(kind == 1, F.concat_ws(",", *values[:-2], F.lit("short")))
        .when(kind == 2, F.concat(line, F.lit(",long")))
        .otherwise(line)
        .alias("line")
    )
    path = fresh_path(spark, "broken-wide")
    lines.write.text(path)
    found = read_checked(spark, path, wide_schema(N_FEATURES), header=False)
    rows = found.rows.groupBy(F.col(LABEL).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
    ends = F.substring_index("line", ",", -1).alias("ends")
    rejects = found.rejects.groupBy(ends).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.unionByName(rejects, allowMissingColumns=True).select("label", "ends", "n_rows")


@query(
    "recode_label",
    "SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS _c64 FROM embeddings",
)
def recode_label(spark, sf_dir):
    return classify.recode_label(views.wide(spark, sf_dir), LABEL).select("vec_id", LABEL)


@query(
    "assemble_features",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_features,
         round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""",
)
def assemble_features(spark, sf_dir):
    rows = classify.assemble(views.wide(spark, sf_dir), INPUTS)
    values = vector_to_array("features")
    return rows.select(
        "vec_id",
        F.size(values).alias("n_features"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


_TOTAL = " + ".join(INPUTS)


@query(
    "assemble_stored",
    sql(
        f"""SELECT {LABEL} AS label, count(*) AS n_rows, CAST({N_FEATURES} AS INTEGER) AS n_features,
              round(sum({_TOTAL}), 3) AS total FROM v_wide GROUP BY 1""",
        "v_wide",
    ),
)
def assemble_stored(spark, sf_dir):
    """The assembled rows as they are stored for several fits, summed up by label."""
    ready = classify.prepare(views.wide(spark, sf_dir), label=LABEL, inputs=INPUTS)
    values = vector_to_array("features")
    rows = ready.rows.select(
        F.col(LABEL).alias("label"),
        F.size(values).alias("n_features"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"),
    )
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("n_features").alias("n_features"), F.round(F.sum("total"), 3).alias("total")
    )


# Samples and balance


@query(
    "sample_fraction",
    "SELECT event_id FROM events WHERE ('0x' || substr(md5('sample-' || event_id), 1, 8))::BIGINT % 100 < 1",
)
def sample_fraction(spark, sf_dir):
    return splits.hash_sample(views.table(spark, sf_dir, "events"), ["event_id"], 0.01).select("event_id")


@query(
    "split_counts",
    """WITH h AS (SELECT ('0x' || substr(md5('holdout-' || event_id), 1, 8))::BIGINT % 100 AS h,
                         ('0x' || substr(md5('sample-' || event_id), 1, 8))::BIGINT % 100 AS s FROM events)
       SELECT 'test' AS part, count(*) AS n_rows FROM h WHERE h < 20
       UNION ALL SELECT 'train', count(*) FROM h WHERE h >= 20
       UNION ALL SELECT 'subset', count(*) FROM h WHERE h >= 20 AND s < 1""",
)
def split_counts(spark, sf_dir):
    rows = splits.holdout(views.table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    subset = splits.hash_sample(rows.where("part = 'train'"), ["event_id"], 0.01).withColumn("part", F.lit("subset"))
    return splits.split_counts(union_all([rows, subset]))


@query(
    "label_balance",
    sql(
        """SELECT stage, CASE WHEN stage = 'recoded' AND label = -1 THEN 0 ELSE label END AS label, n_rows,
             round(n_rows / sum(n_rows) OVER (PARTITION BY stage), 6) AS share,
             round(max(n_rows) OVER (PARTITION BY stage) / sum(n_rows) OVER (PARTITION BY stage), 6) AS majority_share
           FROM (SELECT _c64 AS label, count(*) AS n_rows FROM v_wide GROUP BY 1), (VALUES ('raw'), ('recoded')) s(stage)""",
        "v_wide",
    ),
)
def label_balance(spark, sf_dir):
    """Counts of the label as it comes, and recoded."""
    raw = views.wide(spark, sf_dir)
    stages = {"raw": raw, "recoded": classify.recode_label(raw, LABEL)}
    counts = union_all(
        [
            metrics.label_balance(rows.withColumnRenamed(LABEL, "label")).withColumn("stage", F.lit(stage))
            for stage, rows in stages.items()
        ]
    )
    return counts.withColumns({c: F.round(c, 6) for c in ("share", "majority_share")})


# Metrics on fixed predictions


def _fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.recode_label(views.wide(spark, sf_dir), LABEL)
    return rows.select(
        F.col(LABEL).alias("label"),
        F.when(F.col("_c0") > 0, 1).otherwise(0).alias("prediction"),
        F.round("_c0", 2).alias("score"),
    )


@query(
    "accuracy",
    sql(
        """SELECT count(*) AS n_rows,
             round(avg(CAST((_c64 = 1) = (_c0 > 0) AS INTEGER)), 6) AS accuracy FROM v_wide""",
        "v_wide",
    ),
)
def accuracy(spark, sf_dir):
    return metrics.accuracy(_fixed_scores(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "auc",
    sql(
        """SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(1 - p) AS BIGINT) AS n_neg,
             round((sum(p * r) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(1 - p)), 6) AS auc
           FROM (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
                 FROM (SELECT CASE WHEN _c64 = 1 THEN 1 ELSE 0 END AS p, round(_c0, 2) AS s FROM v_wide))""",
        "v_wide",
    ),
)
def auc(spark, sf_dir):
    return metrics.auc(_fixed_scores(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


# Models


def _is_test(part: str) -> str:
    return f"('0x' || substr(md5('{part}-' || vec_id), 1, 8))::BIGINT % 100"


_PLANTED = f"""v_planted AS (SELECT vec_id, CASE WHEN _c0 + _c1 > 0 THEN 1 ELSE 0 END AS label,
    {_is_test("holdout")} < 20 AS in_test, {_is_test("sample")} < {round(100 * TUNING_SHARE)} AS in_sample FROM v_wide)"""

_FITTED = sql(
    """SELECT '{kind}' AS model, vec_id, label, true AS agrees, true AS score_in_range, true AS as_from_tables
       FROM v_planted WHERE in_test""",
    "v_wide",
    _PLANTED,
)


def from_tables(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(vec_id, score, prediction) of the test part, from the fitted model written down as a table."""
    model, rows = fitted(spark, sf_dir, kind), test(spark, sf_dir).select("vec_id", *INPUTS)
    if kind == "rf":
        nodes = materialise(model_tables.tree_nodes(model), "tree-nodes")
        return model_tables.score_forest(rows, nodes, INPUTS, ["vec_id"])
    if kind == "lr":
        found = model_tables.score_linear(rows, model_tables.coefficients(model, INPUTS), INPUTS)
    else:
        found = model_tables.score_layers(rows, model_tables.layer_weights(model), INPUTS)
    return found.select("vec_id", "score", "prediction")


def _checked(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Keys, label, whether prediction and score fit together, and whether the model as a table gives the same."""
    again = from_tables(spark, sf_dir, kind).toDF("vec_id", "score_again", "prediction_again")
    rows = scored(spark, sf_dir, kind).join(again, "vec_id", "left")
    close = F.abs(F.col("score") - F.col("score_again")) < 1e-9
    same = close & ((F.col("prediction") == F.col("prediction_again")) | (F.abs(F.col("score") - 0.5) < 1e-9))
    return rows.select(
        "model",
        "vec_id",
        "label",
        # At a score of one half either class may win.
        (((F.col("score") >= 0.5) == (F.col("prediction") == 1)) | (F.abs(F.col("score") - 0.5) < 1e-9)).alias("agrees"),
        F.col("score").between(0, 1).alias("score_in_range"),
        F.coalesce(same, F.lit(False)).alias("as_from_tables"),
    )


@query("rf_fit_predict_check", _FITTED.format(kind="rf"))
def rf_fit_predict_check(spark, sf_dir):
    return _checked(spark, sf_dir, "rf")


@query("lr_fit_predict_check", _FITTED.format(kind="lr"))
def lr_fit_predict_check(spark, sf_dir):
    return _checked(spark, sf_dir, "lr")


@query("mlp_fit_predict_check", _FITTED.format(kind="mlp"))
def mlp_fit_predict_check(spark, sf_dir):
    return _checked(spark, sf_dir, "mlp")


@query("rf_tree_nodes")
def rf_tree_nodes(spark, sf_dir):
    """The fitted forest as a table."""
    return model_tables.tree_nodes(fitted(spark, sf_dir, "rf"))


@query("lr_coefficients")
def lr_coefficients(spark, sf_dir):
    """The fitted regression as a table."""
    return model_tables.coefficients(fitted(spark, sf_dir, "lr"), INPUTS)


@query("mlp_layer_weights")
def mlp_layer_weights(spark, sf_dir):
    """The fitted perceptron as a table."""
    return model_tables.layer_weights(fitted(spark, sf_dir, "mlp"))


def _grid_sizes() -> str:
    sizes = {kind: math.prod(len(v) for v in grid.values()) for kind, grid in GRIDS.items()}
    return ", ".join(f"('{kind}', {n})" for kind, n in sizes.items())


@query(
    "cv_tune_check",
    f"""SELECT model, CAST(i AS INTEGER) AS grid_point, CAST(1 AS BIGINT) AS n_winners, true AS metric_in_range
        FROM (VALUES {_grid_sizes()}) AS g(model, n), range(100) AS r(i) WHERE i < n""",
)
def cv_tune_check(spark, sf_dir):
    """Every grid point of the tuning on a sample of the training part, with checks of its metric."""
    report = union_all([tuned(spark, sf_dir, kind).report for kind in GRIDS])
    best = Window.partitionBy("model")
    is_best = F.col("winner") & (F.col("mean_metric") == F.max("mean_metric").over(best))
    return report.select(
        "model",
        "grid_point",
        F.count_if(is_best).over(best).alias("n_winners"),
        F.col("mean_metric").between(0, 1).alias("metric_in_range"),
    )


_ACCURACY = sql(
    """SELECT m.model, count(*) AS n_rows, true AS in_range
       FROM v_planted, (VALUES ('rf'), ('lr'), ('mlp')) AS m(model) WHERE in_test GROUP BY m.model""",
    "v_wide",
    _PLANTED,
)


@query("score_test_check", _ACCURACY)
def score_test_check(spark, sf_dir):
    """Rows behind the accuracy of each refitted winner, and whether it is a share."""
    report = metrics.accuracy(union_all([scored(spark, sf_dir, kind, refitted) for kind in GRIDS]), ["model"])
    return report.select("model", "n_rows", F.col("accuracy").between(0, 1).alias("in_range"))


@query(
    "refit_full_check",
    sql(
        """SELECT m.model, count(*) FILTER (WHERE in_test) AS n_test, count(*) FILTER (WHERE NOT in_test) AS n_train,
             count(*) FILTER (WHERE in_sample AND NOT in_test) AS n_tuning, true AS has_winners_settings
           FROM v_planted, (VALUES ('rf'), ('lr'), ('mlp')) AS m(model) GROUP BY m.model""",
        "v_wide",
        _PLANTED,
    ),
)
def refit_full_check(spark, sf_dir):
    """Rows of the chain (tuned on, fitted on, scored) and whether the refit has the winner's settings."""
    train_rows = train(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_train"))
    tuning_rows = splits.hash_sample(train(spark, sf_dir), ["vec_id"], TUNING_SHARE).agg(F.count(F.lit(1)).alias("n"))
    reports = []
    for kind in GRIDS:
        wanted = tuned(spark, sf_dir, kind).params
        settings = classify.param_rows(refitted(spark, sf_dir, kind), kind).where(F.col("param").isin(*wanted))
        given = settings.agg(F.sort_array(F.collect_list(F.concat_ws("=", "param", "value"))).alias("x"))
        same = given.scalar() == F.array(*(F.lit(f"{k}={v}") for k, v in sorted(wanted.items())))
        done = scored(spark, sf_dir, kind, refitted).groupBy("model").agg(F.count("prediction").alias("n_test"))
        reports.append(done.select("*", same.alias("has_winners_settings")))
    return union_all(reports).select(
        "model", "n_test", train_rows.scalar().alias("n_train"), tuning_rows.scalar().alias("n_tuning"), "has_winners_settings"
    )


@query("model_report_check", _ACCURACY)
def model_report_check(spark, sf_dir):
    """Rows behind the report on the refitted winners, and whether accuracy and area under ROC are shares."""
    report = metrics.model_report(union_all([scored(spark, sf_dir, kind, refitted) for kind in GRIDS]))
    in_range = F.col("accuracy").between(0, 1) & F.col("auc").between(0, 1)
    return report.select("model", "n_rows", in_range.alias("in_range"))


# Whole results of the fits, which no other engine can recompute; the checks above hold what SQL can say of them.


@query("rf_fit_predict")
def rf_fit_predict(spark, sf_dir):
    return scored(spark, sf_dir, "rf")


@query("lr_fit_predict")
def lr_fit_predict(spark, sf_dir):
    return scored(spark, sf_dir, "lr")


@query("mlp_fit_predict")
def mlp_fit_predict(spark, sf_dir):
    return scored(spark, sf_dir, "mlp")


@query("cv_tune")
def cv_tune(spark, sf_dir):
    """Every grid point of the tuning on a sample of the training part."""
    return union_all([tuned(spark, sf_dir, kind).report for kind in GRIDS])


@query("score_test")
def score_test(spark, sf_dir):
    """Accuracy on the test part of each winner, refitted on the whole training part."""
    return metrics.accuracy(union_all([scored(spark, sf_dir, kind, refitted) for kind in GRIDS]), ["model"])


@query("refit_full")
def refit_full(spark, sf_dir):
    """Settings of each winner, refitted on the whole training part; ``score_test`` scores them."""
    return union_all([classify.param_rows(refitted(spark, sf_dir, kind), kind) for kind in GRIDS])


@query("model_report")
def model_report(spark, sf_dir):
    return metrics.model_report(union_all([scored(spark, sf_dir, kind, refitted) for kind in GRIDS]))
