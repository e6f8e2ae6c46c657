"""Queries on ratings, cross-validation, item clusters and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.operators import clusters as cl
from cairnspark.operators import folds, model_tables, ranking, recommend, splits
from cairnspark.operators.metrics import rmse as rmse_of
from cairnspark.operators.relational import distinct_items as distinct_items_of
from cairnspark.operators.relational import union_all
from cairnspark.plans import views
from cairnspark.plans.registry import once, query
from cairnspark.plans.views import sql
from cairnspark.sources import (
    RATINGS,
    TAG_SCORES,
    Checked,
    fresh_path,
    materialise,
    read_checked,
    read_ratings,
    read_tag_scores,
    read_tags,
)

KEYS = ["user_id", "item_id"]
K = 5


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_folds(views.ratings(spark, sf_dir), KEYS, K)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating in its test fold with a fixed prediction."""
    return stored_folds(spark, sf_dir).withColumn("prediction", views.fixed_prediction())


def stored_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark,
        sf_dir,
        "folds",
        lambda: materialise(
            folded(spark, sf_dir), "folds", partition_by=["fold"], sort_by=KEYS, compression="zstd"
        ),
    )


def cross_validation(spark: SparkSession, sf_dir: str) -> recommend.CrossValidation:
    return once(
        spark,
        sf_dir,
        "cross-validation",
        lambda: recommend.als_cv(stored_folds(spark, sf_dir), k=K, parallelism=4),
    )


def holdout_fit(spark: SparkSession, sf_dir: str):
    """One fit on 80% of the ratings: (model, scored test rows)."""

    def build():
        rows = materialise(
            splits.holdout(views.ratings(spark, sf_dir), KEYS), "holdout", partition_by=["part"]
        )
        blocks = recommend.fit_blocks(rows)
        return recommend.als_predict(rows.where("part = 'train'"), rows.where("part = 'test'"), **blocks)

    return once(spark, sf_dir, "holdout-fit", build)


def clusters_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        factors = cross_validation(spark, sf_dir).item_factors
        return folds.fold_clusters(factors.where("variant = 'default'"), K, parallelism=K)

    return once(spark, sf_dir, "fold-clusters", build)


# Sources


@query("scan_ratings_csv", sql("SELECT * FROM v_ratings", "v_ratings"))
def scan_ratings_csv(spark, sf_dir):
    path = fresh_path(spark, "ratings-csv")
    views.ratings(spark, sf_dir).write.option("header", True).csv(path)
    return read_ratings(spark, path)


@query(
    "scan_tag_tables",
    sql("SELECT tag_id, tag, item_id, score FROM v_scores JOIN v_tags USING (tag_id)", "v_scores", "v_tags"),
)
def scan_tag_tables(spark, sf_dir):
    scores_path, tags_path = fresh_path(spark, "tag-scores-csv"), fresh_path(spark, "tags-csv")
    views.tag_scores(spark, sf_dir).write.option("header", True).csv(scores_path)
    views.tags(spark, sf_dir).write.option("header", True).csv(tags_path)
    return cl.with_tag_names(read_tag_scores(spark, scores_path), read_tags(spark, tags_path))


def _write_lines(lines: DataFrame, name: str, header: str | None = None) -> str:
    """Text files of the lines, each file with the header, as another program would leave them."""
    path = fresh_path(lines.sparkSession, name)
    # One column, a separator that does not occur: no quotes are written.
    lines.select(lines[lines.columns[0]].alias(header or "line")).write.option("header", header is not None).option("sep", "\x01").csv(path)
    return path


def _broken(key: Column, values: list[Column], at: int) -> Column:
    """A CSV line; by its key one in 97 has a word as value ``at``, one lacks the last value, one has a value too many."""
    line, short = F.concat_ws(",", *values), F.concat_ws(",", *values[:-1])
    word = F.concat_ws(",", *[F.lit("many") if i == at else v for i, v in enumerate(values)])
    kind = F.pmod(key, F.lit(97))
    return F.when(kind == 0, word).when(kind == 1, short).when(kind == 2, F.concat(line, F.lit(",0"))).otherwise(line)


def _both(found: Checked) -> DataFrame:
    """Rows and reject lines in one table."""
    rows = found.rows.select("*", F.lit(None).cast("string").alias("line"))
    return rows.unionByName(found.rejects.select("line"), allowMissingColumns=True)


def _broken_sql(key: str, values: list[str], at: int, view: str, types: list[str]) -> str:
    """What ``_both`` has of a broken file: rows as they are, lines of the others."""
    text = [f"CAST({v} AS VARCHAR)" for v in values]
    word = " || ',' || ".join("'many'" if i == at else t for i, t in enumerate(text))
    line = " || ',' || ".join(text)
    nulls = ", ".join(f"CAST(NULL AS {t}) AS {v}" for v, t in zip(values, types))
    return sql(
        f"""SELECT {", ".join(values)}, CAST(NULL AS VARCHAR) AS line FROM {view} WHERE ({key}) % 97 > 2
            UNION ALL
            SELECT {nulls}, CASE ({key}) % 97 WHEN 0 THEN {word} WHEN 1 THEN {" || ',' || ".join(text[:-1])}
              ELSE {line} || ',0' END FROM {view} WHERE ({key}) % 97 <= 2""",
        view,
    )


@query(
    "scan_ratings_rejects",
    _broken_sql("user_id * 31 + item_id", ["user_id", "item_id", "rating"], 2, "v_ratings", ["INTEGER", "INTEGER", "DOUBLE"]),
)
def scan_ratings_rejects(spark, sf_dir):
    """A ratings file with broken lines: what fits the schema, and the text of the rest."""
    values = [F.col(c).cast("string") for c in ("user_id", "item_id", "rating")]
    lines = views.ratings(spark, sf_dir).select(_broken(F.col("user_id") * 31 + F.col("item_id"), values, 2))
    return _both(read_checked(spark, _write_lines(lines, "broken-ratings", "userId,movieId,rating"), RATINGS))


@query(
    "scan_tag_scores_rejects",
    _broken_sql("item_id * 31 + tag_id", ["item_id", "tag_id", "score"], 1, "v_scores", ["INTEGER", "INTEGER", "DOUBLE"]),
)
def scan_tag_scores_rejects(spark, sf_dir):
    """A file of tag scores with broken lines: what fits the schema, and the text of the rest."""
    values = [F.col(c).cast("string") for c in ("item_id", "tag_id", "score")]
    lines = views.tag_scores(spark, sf_dir).select(_broken(F.col("item_id") * 31 + F.col("tag_id"), values, 1))
    return _both(read_checked(spark, _write_lines(lines, "broken-scores", "movieId,tagId,relevance"), TAG_SCORES))


# Activity


@query("agg_user_activity", sql("SELECT user_id, count(*) AS n_ratings FROM v_ratings GROUP BY 1", "v_ratings"))
def agg_user_activity(spark, sf_dir):
    return recommend.user_activity(views.ratings(spark, sf_dir))


def _decile_sql(order: str) -> str:
    return sql(
        f"""SELECT user_id, n_ratings FROM (
              SELECT *, row_number() OVER (ORDER BY n_ratings {order}, user_id) AS r, count(*) OVER () AS n
              FROM (SELECT user_id, count(*) AS n_ratings FROM v_ratings GROUP BY 1))
            WHERE r <= floor(0.1 * n)""",
        "v_ratings",
    )


@query("hot_users", _decile_sql("DESC"))
def hot_users(spark, sf_dir):
    return ranking.extreme_share(recommend.user_activity(views.ratings(spark, sf_dir)))


@query("cool_users", _decile_sql("ASC"))
def cool_users(spark, sf_dir):
    return ranking.extreme_share(recommend.user_activity(views.ratings(spark, sf_dir)), largest=False)


# Joins and sets

_GROUPS = """
    v_train AS (SELECT f.fold, user_id, count(*) AS n
                FROM v_folded JOIN (SELECT DISTINCT fold FROM v_folded) f ON v_folded.fold <> f.fold
                GROUP BY 1, 2),
    v_ranked AS (SELECT fold, user_id, count(*) OVER (PARTITION BY fold) AS total,
                   row_number() OVER (PARTITION BY fold ORDER BY n DESC, user_id) AS hot,
                   row_number() OVER (PARTITION BY fold ORDER BY n, user_id) AS cool FROM v_train),
    v_groups AS (SELECT fold, user_id, 'hot' AS grp FROM v_ranked WHERE hot <= floor(0.1 * total)
                 UNION ALL
                 SELECT fold, user_id, 'cool' FROM v_ranked WHERE cool <= floor(0.1 * total))"""


@query(
    "join_predictions_to_group",
    sql(
        """SELECT user_id, item_id, rating, fold, prediction FROM v_pred
           WHERE (fold, user_id) IN (SELECT (fold, user_id) FROM v_groups WHERE grp = 'hot')""",
        "v_ratings",
        "v_folded",
        "v_pred",
        _GROUPS,
    ),
)
def join_predictions_to_group(spark, sf_dir):
    pred = predicted(spark, sf_dir)
    hot = ranking.extreme_share(recommend.training_activity(stored_folds(spark, sf_dir), K), by="fold")
    return recommend.semi_to_group(pred, hot, ["fold", "user_id"]).select(
        "user_id", "item_id", "rating", "fold", "prediction"
    )


@query(
    "join_scores_to_clusters",
    sql(
        "SELECT item_id, tag_id, score, cluster FROM v_scores JOIN v_clusters USING (item_id)",
        "v_scores",
        "v_clusters",
    ),
)
def join_scores_to_clusters(spark, sf_dir):
    return cl.scores_in_clusters(views.tag_scores(spark, sf_dir), views.item_clusters(spark, sf_dir))


@query(
    "join_tag_names",
    sql("SELECT item_id, tag_id, score, tag FROM v_scores JOIN v_tags USING (tag_id)", "v_scores", "v_tags"),
)
def join_tag_names(spark, sf_dir):
    return cl.with_tag_names(views.tag_scores(spark, sf_dir), views.tags(spark, sf_dir))


@query("union_all_parts", sql("SELECT * FROM v_folded WHERE fold <> 0", "v_ratings", "v_folded"))
def union_all_parts(spark, sf_dir):
    return splits.training_part(stored_folds(spark, sf_dir), 0, K)


@query("distinct_items", sql("SELECT DISTINCT item_id FROM v_ratings", "v_ratings"))
def distinct_items(spark, sf_dir):
    return distinct_items_of(views.ratings(spark, sf_dir))


# Splits


@query(
    "split_holdout",
    sql(
        """SELECT user_id, item_id, rating,
             CASE WHEN ('0x' || substr(md5('holdout-' || user_id || '-' || item_id), 1, 8))::BIGINT % 100 < 20
                  THEN 'test' ELSE 'train' END AS part FROM v_ratings""",
        "v_ratings",
    ),
)
def split_holdout(spark, sf_dir):
    return splits.holdout(views.ratings(spark, sf_dir), KEYS)


@query("assign_folds", sql("SELECT * FROM v_folded", "v_ratings", "v_folded"))
def assign_folds(spark, sf_dir):
    return folded(spark, sf_dir)


@query(
    "fold_sizes",
    sql(
        """SELECT fold, (SELECT count(*) FROM v_ratings) - count(*) AS n_train, count(*) AS n_test
           FROM v_folded GROUP BY fold""",
        "v_ratings",
        "v_folded",
    ),
)
def fold_sizes(spark, sf_dir):
    return splits.fold_sizes(folded(spark, sf_dir))


# Recommendation


_HOLDOUT = """v_holdout AS (SELECT *,
    ('0x' || substr(md5('holdout-' || user_id || '-' || item_id), 1, 8))::BIGINT % 100 < 20 AS in_test FROM v_ratings)"""


def _finite(column: str) -> Column:
    """Whether a number, which no other engine can recompute, is one at all."""
    return F.coalesce(F.col(column).between(-1e6, 1e6) & ~F.isnan(column), F.lit(False))


@query(
    "als_predict_check",
    sql(
        """SELECT user_id, item_id, rating, true AS finite, true AS as_from_tables FROM v_holdout WHERE in_test
             AND user_id IN (SELECT user_id FROM v_holdout WHERE NOT in_test)
             AND item_id IN (SELECT item_id FROM v_holdout WHERE NOT in_test)""",
        "v_ratings",
        _HOLDOUT,
    ),
)
def als_predict_check(spark, sf_dir):
    """Which rows are scored, and whether the factors as a table give the same prediction (in single precision)."""
    model, rows = holdout_fit(spark, sf_dir)
    again = model_tables.score_factors(rows.withColumnRenamed("prediction", "fitted"), model_tables.factors(model))
    same = F.abs(F.col("fitted") - F.col("prediction")) <= 1e-5 * (1 + F.abs("fitted"))
    return again.select(
        "user_id", "item_id", "rating", _finite("fitted").alias("finite"), F.coalesce(same, F.lit(False)).alias("as_from_tables")
    )


@query("als_factors")
def als_factors(spark, sf_dir):
    """The factors of the fit on the training part as a table."""
    return model_tables.factors(holdout_fit(spark, sf_dir)[0])


@query(
    "rmse",
    sql(
        """SELECT count(*) AS n_scored, round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse
           FROM v_pred""",
        "v_ratings",
        "v_folded",
        "v_pred",
    ),
)
def rmse(spark, sf_dir):
    return rmse_of(predicted(spark, sf_dir)).withColumn("rmse", F.round("rmse", 6))


def _cv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.cv_report(cross_validation(spark, sf_dir).predictions, stored_folds(spark, sf_dir))


@query(
    "als_cv_check",
    sql(
        "SELECT variant, fold, count(*) AS n_test, true AS finite FROM v_folded, (VALUES ('default'), ('compact')) v(variant) GROUP BY 1, 2",
        "v_ratings",
        "v_folded",
    ),
)
def als_cv_check(spark, sf_dir):
    return _cv_report(spark, sf_dir).select("variant", "fold", "n_test", _finite("rmse").alias("finite"))


@query(
    "als_cv_coverage",
    sql(
        """SELECT variant, t.fold, count(*) AS n_test,
             count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_folded u WHERE u.user_id = t.user_id AND u.fold <> t.fold)
                                AND EXISTS (SELECT 1 FROM v_folded i WHERE i.item_id = t.item_id AND i.fold <> t.fold)
             ) AS n_scored
           FROM v_folded t JOIN (VALUES ('default'), ('compact')) v(variant) ON true GROUP BY 1, 2""",
        "v_ratings",
        "v_folded",
    ),
)
def als_cv_coverage(spark, sf_dir):
    """How many test rows each fit scores: those whose user and item occur in the training part."""
    return _cv_report(spark, sf_dir).drop("rmse")


def _grid(*variants: str) -> str:
    """Every variant, fold and group."""
    names = ", ".join(f"('{v}')" for v in variants)
    return f"""v_grid AS (SELECT variant, fold, grp FROM (SELECT DISTINCT fold FROM v_train),
                          (VALUES {names}) v(variant), (VALUES ('hot'), ('cool')) g(grp))"""


_VARIANTS = """v_variants AS (
    SELECT 'plain' AS variant, * FROM v_pred
    UNION ALL
    SELECT 'turned', * REPLACE (5.5 - prediction AS prediction) FROM v_pred)"""


@query(
    "group_rmse",
    sql(
        """SELECT g.variant, g.fold, g.grp, count(rating) AS n_scored,
             round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse
           FROM v_grid g LEFT JOIN (SELECT * FROM v_variants JOIN v_groups USING (fold, user_id)) v
             ON v.variant = g.variant AND v.fold = g.fold AND v.grp = g.grp GROUP BY 1, 2, 3""",
        "v_ratings",
        "v_folded",
        "v_pred",
        _GROUPS,
        _VARIANTS,
        _grid("plain", "turned"),
    ),
)
def group_rmse(spark, sf_dir):
    pred = predicted(spark, sf_dir)
    variants = union_all(
        [
            pred.withColumn("variant", F.lit("plain")),
            pred.withColumn("variant", F.lit("turned")).withColumn("prediction", 5.5 - F.col("prediction")),
        ]
    )
    activity = recommend.training_activity(stored_folds(spark, sf_dir), K)
    return recommend.group_rmse(variants, activity).withColumn("rmse", F.round("rmse", 6))


@query(
    "group_rmse_long_check",
    sql(
        """SELECT g.variant, g.fold, g.grp, count(t.user_id) AS n_scored, true AS finite
           FROM v_grid g LEFT JOIN (
             SELECT t.fold, t.user_id, grp FROM v_folded t JOIN v_groups USING (fold, user_id)
             WHERE EXISTS (SELECT 1 FROM v_folded i WHERE i.item_id = t.item_id AND i.fold <> t.fold)
           ) t ON t.fold = g.fold AND t.grp = g.grp GROUP BY 1, 2, 3""",
        "v_ratings",
        "v_folded",
        _GROUPS,
        _grid("default", "compact"),
    ),
)
def group_rmse_long_check(spark, sf_dir):
    """How many rows each error covers; an error is a number where there are any, and NULL elsewhere."""
    activity = recommend.training_activity(stored_folds(spark, sf_dir), K)
    report = recommend.group_rmse(cross_validation(spark, sf_dir).predictions, activity)
    finite = F.when(F.col("n_scored") > 0, _finite("rmse")).otherwise(F.col("rmse").isNull())
    return report.select("variant", "fold", "grp", "n_scored", finite.alias("finite"))


def _in_order(rows: DataFrame, key: str, other: str, known: DataFrame) -> DataFrame:
    """Keys and ranks of recommendations, whether scores fall, and whether the other side was in the fit."""
    before = F.lag("score").over(Window.partitionBy(key).orderBy("rank"))
    seen = known.select(F.col("id").alias(other), F.lit(True).alias("known"))
    return (
        rows.withColumn("falling", F.coalesce(F.col("score") <= before, _finite("score")))
        .join(seen, other, "left")
        .select(key, "rank", "falling", F.coalesce("known", F.lit(False)).alias("known"))
    )


@query(
    "recommend_users_check",
    sql(
        """SELECT user_id, CAST(r AS INTEGER) AS rank, true AS falling, true AS known
           FROM (SELECT DISTINCT user_id FROM v_holdout WHERE NOT in_test), range(1, 6) AS t(r)
           WHERE r <= (SELECT count(DISTINCT item_id) FROM v_holdout WHERE NOT in_test)""",
        "v_ratings",
        _HOLDOUT,
    ),
)
def recommend_users_check(spark, sf_dir):
    model = holdout_fit(spark, sf_dir)[0]
    return _in_order(recommend.recommend_users(model, 5), "user_id", "item_id", model.itemFactors)


@query(
    "recommend_item_subset_check",
    sql(
        """SELECT item_id, CAST(r AS INTEGER) AS rank, true AS falling, true AS known
           FROM (SELECT DISTINCT item_id FROM v_ratings ORDER BY 1 LIMIT 3), range(1, 11) AS t(r)
           WHERE item_id IN (SELECT item_id FROM v_holdout WHERE NOT in_test)
             AND r <= (SELECT count(DISTINCT user_id) FROM v_holdout WHERE NOT in_test)""",
        "v_ratings",
        _HOLDOUT,
    ),
)
def recommend_item_subset_check(spark, sf_dir):
    model = holdout_fit(spark, sf_dir)[0]
    items = ranking.limit_sample(distinct_items_of(views.ratings(spark, sf_dir)), ["item_id"], 3)
    return _in_order(recommend.recommend_items(model, items, 10), "item_id", "user_id", model.userFactors)


# Clusters and tags


@query(
    "cluster_item_factors_check",
    sql(
        """SELECT f.fold, count(DISTINCT item_id) AS n_items, true AS ranks_follow_sizes
           FROM v_folded JOIN (SELECT DISTINCT fold FROM v_folded) f ON v_folded.fold <> f.fold GROUP BY 1""",
        "v_ratings",
        "v_folded",
    ),
)
def cluster_item_factors_check(spark, sf_dir):
    """Items of all clusters of each fold, and whether the ranks 1 to 10 follow the sizes."""
    ranked = cl.largest(clusters_by_fold(spark, sf_dir), 10, by="fold")
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("size_rank", "n_items"))), lambda x: x.n_items)
    falling = sizes == F.sort_array(sizes, asc=False)
    return ranked.groupBy("fold").agg(
        F.sum("n_items").alias("n_items"), (falling & (F.max("size_rank") <= 10)).alias("ranks_follow_sizes")
    )


@query(
    "largest_clusters",
    sql(
        """SELECT cluster, n_items, CAST(row_number() OVER (ORDER BY n_items DESC, cluster) AS INTEGER) AS size_rank
           FROM (SELECT cluster, count(*) AS n_items FROM v_clusters GROUP BY 1)
           ORDER BY n_items DESC, cluster LIMIT 2""",
        "v_clusters",
    ),
)
def largest_clusters(spark, sf_dir):
    return cl.largest(views.item_clusters(spark, sf_dir), 2)


_SUMS = """v_sums AS (SELECT cluster, tag_id, sum(score) AS score
                      FROM v_scores JOIN v_clusters USING (item_id) GROUP BY 1, 2)"""


@query("cluster_tag_scores", sql("SELECT * FROM v_sums", "v_scores", "v_clusters", _SUMS))
def cluster_tag_scores(spark, sf_dir):
    return cl.cluster_tag_scores(views.tag_scores(spark, sf_dir), views.item_clusters(spark, sf_dir))


@query(
    "cluster_score_coverage",
    sql(
        """SELECT cluster, count(*) AS n_items,
             count(*) FILTER (WHERE item_id IN (SELECT l_partkey FROM lineitem)) AS n_scored
           FROM v_clusters GROUP BY 1""",
        "v_clusters",
    ),
)
def cluster_score_coverage(spark, sf_dir):
    return cl.score_coverage(views.tag_scores(spark, sf_dir), views.item_clusters(spark, sf_dir))


@query(
    "cluster_top_bottom_tags",
    sql(
        """SELECT cluster, place, tag_id, tag, score FROM (
             SELECT c.cluster, t.tag_id, t.tag, coalesce(s.score, 0) AS score,
               row_number() OVER (PARTITION BY c.cluster ORDER BY coalesce(s.score, 0) DESC, t.tag_id) AS top,
               row_number() OVER (PARTITION BY c.cluster ORDER BY coalesce(s.score, 0), t.tag_id) AS bottom
             FROM (SELECT cluster FROM v_clusters GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) c
             JOIN v_tags t ON true LEFT JOIN v_sums s ON s.cluster = c.cluster AND s.tag_id = t.tag_id)
           JOIN (VALUES ('top'), ('bottom')) p(place)
             ON (place = 'top' AND top = 1) OR (place = 'bottom' AND bottom = 1)""",
        "v_scores",
        "v_tags",
        "v_clusters",
        _SUMS,
    ),
)
def cluster_top_bottom_tags(spark, sf_dir):
    clusters = views.item_clusters(spark, sf_dir)
    chosen = cl.largest(clusters, 2)
    members = clusters.join(F.broadcast(chosen.select("cluster")), "cluster", "left_semi")
    sums = cl.cluster_tag_scores(views.tag_scores(spark, sf_dir), members)
    return cl.top_bottom_tags(sums, views.tags(spark, sf_dir), clusters=chosen)


@query(
    "fold_cluster_tags_check",
    sql(
        """SELECT fold, CAST(s AS INTEGER) AS size_rank, place, true AS is_sum_of_items
           FROM (SELECT DISTINCT fold FROM v_folded), range(1, 3) AS r(s), (VALUES ('top'), ('bottom')) p(place)""",
        "v_ratings",
        "v_folded",
    ),
)
def fold_cluster_tags_check(spark, sf_dir):
    """The places of each fold's two largest clusters, and whether a score is the sum over the cluster's items."""
    clusters, scores = clusters_by_fold(spark, sf_dir), views.tag_scores(spark, sf_dir)
    found = folds.fold_tags(clusters, scores, views.tags(spark, sf_dir))
    ranks = cl.largest(clusters, 2, by="fold").select("fold", "cluster", "size_rank")
    again = (
        clusters.join(ranks, ["fold", "cluster"])
        .join(scores, "item_id")
        .groupBy("fold", "size_rank", "tag_id")
        .agg(F.sum("score").alias("again"))
    )
    same = F.abs(F.col("score") - F.coalesce("again", F.lit(0.0))) < 1e-6
    return found.join(again, ["fold", "size_rank", "tag_id"], "left").select(
        "fold", "size_rank", "place", same.alias("is_sum_of_items")
    )


# Whole results of the fits, which no other engine can recompute; the checks above hold what SQL can say of them.


@query("als_predict")
def als_predict(spark, sf_dir):
    return holdout_fit(spark, sf_dir)[1].select("user_id", "item_id", "rating", "prediction")


@query("als_cv")
def als_cv(spark, sf_dir):
    return _cv_report(spark, sf_dir)


@query("group_rmse_long")
def group_rmse_long(spark, sf_dir):
    activity = recommend.training_activity(stored_folds(spark, sf_dir), K)
    return recommend.rmse_long(recommend.group_rmse(cross_validation(spark, sf_dir).predictions, activity))


@query("recommend_users")
def recommend_users(spark, sf_dir):
    return recommend.recommend_users(holdout_fit(spark, sf_dir)[0], 5)


@query("recommend_item_subset")
def recommend_item_subset(spark, sf_dir):
    items = ranking.limit_sample(distinct_items_of(views.ratings(spark, sf_dir)), ["item_id"], 3)
    return recommend.recommend_items(holdout_fit(spark, sf_dir)[0], items, 10)


@query("cluster_item_factors")
def cluster_item_factors(spark, sf_dir):
    return cl.largest(clusters_by_fold(spark, sf_dir), 10, by="fold").select("fold", "size_rank", "n_items")


@query("fold_cluster_tags")
def fold_cluster_tags(spark, sf_dir):
    return folds.fold_tags(
        clusters_by_fold(spark, sf_dir), views.tag_scores(spark, sf_dir), views.tags(spark, sf_dir)
    )
