"""Matrix factorisation on ratings: fits, folds, error of heavy and light users, recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.metrics import rmse
from cairnspark.operators.products import best_products
from cairnspark.operators.ranking import share_of_stored
from cairnspark.operators.relational import union_all
from cairnspark.operators.splits import SEED
from cairnspark.sources.tables import (
    ensure_checkpoint_dir,
    fresh_path,
    materialise,
    release,
    release_unused,
    write_parquet,
)

# Two settings that differ: the estimator's defaults, and a smaller model with a stronger penalty.
VARIANTS = {"default": {"rank": 10, "reg": 0.1}, "compact": {"rank": 5, "reg": 0.2}}
# Iterations after which a fit stores its item factors and deletes the shuffle files behind them.
CHECKPOINT_ITERATIONS = 2
# Ratings from which on fits get fewer user blocks, and the blocks a fit has then at least.
MANY_RATINGS, LEAST_BLOCKS = 2_000_000, 4
# From as many on, the fits of a cross-validation at work at most, and the iterations after which they store factors.
MOST_FITS, CHECKPOINT_OF_MANY = 2, 1
# Ratings of a table for each block of a fit of a cross-validation, at most: a task holds its block's several times over.
BLOCK_RATINGS = 9_000_000


def user_activity(ratings: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, n_ratings)."""
    return ratings.groupBy(user).agg(F.count(F.lit(1)).alias("n_ratings"))


def fit_blocks(ratings: DataFrame, fits: int = 1) -> dict[str, int]:
    """``blocks`` and ``item_blocks`` of ``als_predict`` for one of ``fits`` at work on the stored table ``ratings``.

    The user blocks of all fits are as many as the session runs tasks at a time, and ten at least for each. From
    ``MANY_RATINGS`` on a single fit has half of that, and the least is ``LEAST_BLOCKS``: what an iteration sends
    grows with the blocks. A block is one task's, so with four a task holds a quarter of the training ratings.
    """
    tasks, least = ratings.sparkSession.sparkContext.defaultParallelism, 10
    if ratings.count() >= MANY_RATINGS:
        fits, least = max(2, fits), LEAST_BLOCKS
    blocks = max(least, -(-tasks // fits))
    return {"blocks": blocks, "item_blocks": max(LEAST_BLOCKS, blocks // 3)}


def bounded_blocks(ratings: DataFrame, fits: int = 1) -> dict[str, int | str]:
    """As ``fit_blocks``, but with no more than ``BLOCK_RATINGS`` of the stored table ``ratings`` in a block of either side.

    A task holds the ratings of its block several times over while it builds it, and then the factors sent to it, so a
    fixed number of blocks needs more memory the more ratings there are. Where that takes more blocks they are held on disk
    (``hold``): else those of both sides fill the storage part of the executors' memory, next to what the tasks build.
    """
    dealt: dict[str, int | str] = dict(fit_blocks(ratings, fits))
    needed = -(-ratings.count() // BLOCK_RATINGS)
    if needed > min(dealt.values()):
        dealt = {side: max(n, needed) for side, n in dealt.items()} | {"hold": "DISK_ONLY"}
    return dealt


def fits_at_work(ratings: DataFrame, wanted: int) -> int:
    """How many of ``wanted`` fits on the stored table ``ratings`` to run at a time.

    Each keeps shuffle files of its own, so from ``MANY_RATINGS`` on no more are at work than fill the session's tasks.
    """
    if ratings.count() < MANY_RATINGS:
        return wanted
    return max(1, min(wanted, ratings.sparkSession.sparkContext.defaultParallelism // LEAST_BLOCKS))


def als_predict(
    train: DataFrame,
    test: DataFrame,
    rank: int = 10,
    reg: float = 0.1,
    max_iter: int = 10,
    seed: int = SEED,
    user: str = "user_id",
    item: str = "item_id",
    rating: str = "rating",
    blocks: int | None = None,
    item_blocks: int | None = None,
    checkpoint: int = CHECKPOINT_ITERATIONS,
    store: str | None = None,
    hold: str = "MEMORY_AND_DISK",
) -> tuple[ALSModel, DataFrame]:
    """Fit ALS on ``train`` and score ``test``; rows with an unseen user or item are dropped.

    ``blocks`` sets the user and item blocks, which bound the number of tasks; by default as many as
    the session runs tasks at a time, and ten at least, for users, and a third of that, four at least, for items.

    Every iteration sends a user's factors once to each item block with one of the user's items, and an
    item's to each user block: fewer blocks, less to shuffle. The fit starts from numbers drawn per user
    block, so those decide the result; ``item_blocks`` alone changes no more than the order of sums.
    Sent factors stay on disk for ``checkpoint`` iterations; ``hold`` is the storage level of the blocks.

    With ``store``, a fresh path, the model is saved there and read back, and what the fit has on disk is deleted
    before anything is scored: else it stays as long as the model does.
    """
    ensure_checkpoint_dir(train.sparkSession)
    if blocks is None:
        blocks = max(10, train.sparkSession.sparkContext.defaultParallelism)
        item_blocks = item_blocks or max(4, blocks // 3)
    als = ALS(
        rank=rank,
        regParam=reg,
        maxIter=max_iter,
        seed=seed,
        userCol=user,
        itemCol=item,
        ratingCol=rating,
        coldStartStrategy="drop",
        numUserBlocks=blocks,
        numItemBlocks=item_blocks or blocks,
        checkpointInterval=checkpoint,
        intermediateStorageLevel=hold,
    )
    model = als.fit(train)
    if store is not None:
        model.save(store)
        model = ALSModel.load(store)
        # After the load, for until Spark runs another query its listeners refer to the last one, which saved.
        release_unused(train.sparkSession)
    return model, model.transform(test)


@dataclass(frozen=True)
class CrossValidation:
    """What a cross-validation leaves in shared storage."""

    predictions: DataFrame  # variant, fold, user_id, item_id, rating, prediction
    item_factors: DataFrame  # variant, fold, item_id, features


def als_cv(
    folded: DataFrame,
    variants: Mapping[str, Mapping] = VARIANTS,
    k: int = 5,
    max_iter: int = 10,
    seed: int = SEED,
    parallelism: int = 2,
    blocks: int | None = None,
) -> CrossValidation:
    """Fit every variant on every fold of a table (user_id, item_id, rating, fold).

    Predictions and item factors of each fit are written under the shared folder as soon as they
    exist, so later reports read two tables: no fit runs twice, and a lost executor costs at most
    the fits in progress. ``parallelism`` fits run at a time, or as many as ``fits_at_work`` allows; from
    ``MANY_RATINGS`` on ``MOST_FITS`` at most, so that the disk they hold does not grow with the session's tasks,
    and beyond ``BLOCK_RATINGS`` a block no more than fill the session's tasks.
    ``folded`` should be stored by fold; then each fit reads only the directories of its folds. If it is sorted by
    user there, what a fit sends to build its blocks compresses better.

    The blocks of the fits are by default those of ``bounded_blocks``. The shuffle files of a fit are deleted when its
    tables are written, from ``MANY_RATINGS`` on before its test rows are scored; those behind ``folded`` before the
    first fit.
    """
    spark = folded.sparkSession
    ensure_checkpoint_dir(spark)
    predictions_path = fresh_path(spark, "fold-predictions")
    factors_path = fresh_path(spark, "fold-item-factors")
    models_path = fresh_path(spark, "fold-models")

    tasks = [(variant, fold) for variant in variants for fold in range(k)]
    at_work = min(parallelism, len(tasks))
    dealt = bounded_blocks(folded, at_work) if blocks is None else {"blocks": blocks}
    at_work = fits_at_work(folded, at_work)
    many = folded.count() >= MANY_RATINGS
    if many:
        at_work = min(MOST_FITS, at_work)
        dealt["checkpoint"] = CHECKPOINT_OF_MANY
    if "hold" in dealt:
        at_work = max(1, min(at_work, spark.sparkContext.defaultParallelism // dealt["blocks"]))
    release_unused(spark)

    def fit(variant: str, fold: int) -> None:
        train = folded.where(F.col("fold") != fold)
        test = folded.where(F.col("fold") == fold)
        leaf = f"variant={variant}/fold={fold}"
        store = f"{models_path}/{leaf}"
        model, scored = als_predict(
            train, test, max_iter=max_iter, seed=seed, store=store if many else None, **dealt, **variants[variant]
        )
        write_parquet(
            scored.select("user_id", "item_id", "rating", "prediction"),
            f"{predictions_path}/{leaf}",
            compression="zstd",
        )
        write_parquet(
            model.itemFactors.select(F.col("id").alias("item_id"), "features"),
            f"{factors_path}/{leaf}",
            compression="zstd",
        )
        release(spark, store)

    def run(task: tuple[str, int]) -> None:
        fit(*task)
        release_unused(spark)

    with ThreadPool(at_work) as pool:
        pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)
    release(spark, models_path)
    parts = "variant string, fold int"
    return CrossValidation(
        predictions=spark.read.schema(
            f"user_id int, item_id int, rating double, prediction float, {parts}"
        ).parquet(predictions_path),
        item_factors=spark.read.schema(f"item_id int, features array<float>, {parts}").parquet(factors_path),
    )


def cv_report(predictions: DataFrame, folded: DataFrame) -> DataFrame:
    """(variant, fold, n_test, n_scored, rmse): the error and how many test rows it covers."""
    tests = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    return (
        rmse(predictions, ["variant", "fold"])
        .join(tests, "fold")
        .select("variant", "fold", "n_test", "n_scored", "rmse")
    )


def training_activity(folded: DataFrame, k: int = 5) -> DataFrame:
    """(fold, user_id, n_ratings): ratings of each user in the training part of each fold, where any.

    One pass for all folds: a user's training count of a fold is what lies outside that fold.
    """
    counts = folded.groupBy("user_id").agg(*[F.count_if(F.col("fold") != f).alias(str(f)) for f in range(k)])
    return (
        counts.unpivot("user_id", [str(f) for f in range(k)], "fold", "n_ratings")
        .where(F.col("n_ratings") > 0)
        .select(F.col("fold").cast("int").alias("fold"), "user_id", "n_ratings")
    )


GROUPS = {"hot": True, "cool": False}


def activity_groups(activity: DataFrame, share: float = 0.1, by: str | None = "fold") -> DataFrame:
    """(by, user_id, grp): the most (``hot``) and the least (``cool``) active users. A user may be in both.

    ``activity`` is read four times and should be a stored table.
    """
    keys = [by, "user_id"] if by else ["user_id"]
    return union_all(
        [
            share_of_stored(activity, share, largest, by=by).select(*keys, F.lit(name).alias("grp"))
            for name, largest in GROUPS.items()
        ]
    )


def semi_to_group(pred: DataFrame, users: DataFrame, on: Sequence[str] = ("user_id",)) -> DataFrame:
    """Rows of ``pred`` whose user is in ``users``.

    Spark broadcasts ``users`` when its size allows; otherwise AQE splits the partition of a user
    with very many rows.
    """
    return pred.join(users, list(on), "left_semi")


def group_rmse(
    pred: DataFrame, activity: DataFrame, share: float = 0.1, by: Sequence[str] = ("variant", "fold")
) -> DataFrame:
    """(by.., grp, n_scored, rmse) for hot and cool users, the groups taken from training ``activity``.

    Every group of every fold of ``activity`` has a row for each combination of the other ``by``
    columns in ``pred``: where none of its users has a scored row, ``n_scored`` is 0 and ``rmse``
    NULL. Rows with a NULL in ``by`` are left out.

    Errors are summed per user before the join, so both sides of it hold one row per user (and
    variant, fold, group) and a very active user weighs no more than any other.
    """
    by = list(by)
    fold = [c for c in by if c == "fold"]
    others = [c for c in by if c != "fold"]
    pred = pred.dropna(subset=by) if by else pred
    error = F.col("rating") - F.col("prediction")
    per_user = pred.groupBy(*by, "user_id").agg(
        F.count(error).alias("_n"), F.sum(error * error).alias("_sum")
    )
    activity = materialise(activity, "activity")
    members = activity_groups(activity, share, "fold" if fold else None)
    errors = (
        per_user.join(members, [*fold, "user_id"])
        .groupBy(*by, "grp")
        .agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    )
    # The grid has a few rows for each fold: groups, and the settings found in one scalar query.
    grid = activity.select(*fold).dropna().distinct() if fold else activity.limit(1).select()
    if others:
        settings = pred.select(*others).distinct().agg(F.collect_list(F.struct(*others))).scalar()
        grid = grid.withColumn("_setting", F.explode(settings)).select(*fold, "_setting.*")
    grid = grid.withColumn("grp", F.explode(F.array(*map(F.lit, GROUPS))))
    n_scored = F.coalesce("_n", F.lit(0)).alias("n_scored")
    root = F.when(F.col("_n") > 0, F.sqrt(F.col("_sum") / F.col("_n")))
    return grid.join(errors, [*by, "grp"], "left").select(*by, "grp", n_scored, root.alias("rmse"))


def rmse_long(report: DataFrame) -> DataFrame:
    """(variant, fold, grp, rmse): the table behind one figure of all group errors."""
    return report.select("variant", "fold", "grp", "rmse")


def _exploded(recs: DataFrame, key: str, other: str) -> DataFrame:
    return recs.select(key, F.posexplode("recommendations").alias("_pos", "_rec")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col(f"_rec.{other}").alias(other),
        F.col("_rec.rating").alias("score"),
    )


def recommend_users(model: ALSModel, n: int = 5, users: DataFrame | None = None, **blocks: int) -> DataFrame:
    """(user, rank, item, score): the ``n`` best items for every user, or for those of ``users`` only.

    Equal scores go by item. Items are searched by falling length of their factors, and only as far as a user's
    n-th score may still be beaten; see ``best_products``, whose block sizes can be given.
    """
    user, item = model.getOrDefault("userCol"), model.getOrDefault("itemCol")
    wanted = model.userFactors
    if users is not None:
        wanted = wanted.join(users.select(F.col(user).alias("id")), "id", "left_semi")
    found = best_products(wanted, model.itemFactors, n, **blocks)
    place = F.posexplode(F.arrays_zip("ids", "scores")).alias("_pos", "_best")
    return found.select("id", place).select(
        F.col("id").cast("int").alias(user),
        (F.col("_pos") + 1).alias("rank"),
        F.col("_best.ids").cast("int").alias(item),
        F.col("_best.scores").alias("score"),
    )


def recommend_items(model: ALSModel, items: DataFrame, n: int = 10) -> DataFrame:
    """(item, rank, user, score): the ``n`` best users for each item of ``items``."""
    user, item = model.getOrDefault("userCol"), model.getOrDefault("itemCol")
    return _exploded(model.recommendForItemSubset(items, n), item, user)
