"""The three workloads from files to results, as a user would call them."""

import gzip
import random

import pytest

from cairnspark.operators import classify, folds, logs, metrics, profile, ranking, recommend, splits, traffic
from cairnspark.sources import materialise, read_log, read_ratings, read_tag_scores, read_tags, read_wide


def test_log(spark, tmp_path):
    path = tmp_path / "access_log.gz"
    with gzip.open(path, "wt") as out:
        for day in range(1, 32):
            for i in range(day):
                out.write(
                    f'h{i}.example.org - - [{day:02d}/Jul/1995:10:00:{i:02d} -0400] '
                    f'"GET /m/{i:02d}.mpg HTTP/1.0" 200 {i}\n'
                )
    parsed = logs.parse_clf(read_log(spark, str(path), partitions=4))
    assert set(profile.null_profile(parsed).first()) == {0}
    clean = logs.clean_logs(parsed)
    extremes = traffic.weekday_extremes(traffic.daily_requests(clean), parity_days=True)
    got = {r["weekday"]: (r["min_reqs"], r["max_reqs"]) for r in extremes.collect()}
    # 1 July 1995 was a Saturday; each day has as many requests as its number.
    assert got == {6: (1, 22), 7: (2, 23), 1: (3, 24), 2: (4, 25), 3: (5, 26), 4: (6, 27), 5: (7, 28)}
    movies = ranking.endpoint_counts(logs.endpoint_contains(clean, ".mpg"))
    assert tuple(ranking.extreme_k(movies, 12).first()) == ("/m/00.mpg", 31)
    assert tuple(ranking.extreme_k(movies, 12, largest=False).first()) == ("/m/30.mpg", 1)


def test_ratings(spark, tmp_path):
    rng = random.Random(8)
    ratings, scores, tags = tmp_path / "ratings.csv", tmp_path / "scores.csv", tmp_path / "tags.csv"
    rows = [(u, i, rng.randint(1, 10) / 2, 1) for u in range(40) for i in rng.sample(range(30), 12)]
    ratings.write_text("userId,movieId,rating,timestamp\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    scores.write_text("movieId,tagId,relevance\n" + "".join(f"{i},{t},{rng.random()}\n" for i in range(30) for t in range(4)))
    tags.write_text("tagId,tag\n" + "".join(f"{t},tag {t}\n" for t in range(4)))
    rated = splits.assign_folds(read_ratings(spark, str(ratings)), ["user_id", "item_id"])
    folded = materialise(rated, "folds", partition_by=["fold"])
    cv = recommend.als_cv(folded, max_iter=2, parallelism=4)
    report = recommend.group_rmse(cv.predictions, recommend.training_activity(folded)).collect()
    assert len(report) == 20 and all(r["rmse"] > 0 if r["n_scored"] else r["rmse"] is None for r in report)
    # In three folds every rating of the four hot users is in the training part.
    assert sorted((r["variant"], r["fold"], r["grp"]) for r in report if not r["n_scored"]) == [
        (variant, fold, "hot") for variant in ("compact", "default") for fold in (0, 2, 4)
    ]
    found = folds.fold_clusters(cv.item_factors.where("variant = 'default'"), k=4, parallelism=4)
    named = folds.fold_tags(found, read_tag_scores(spark, str(scores)), read_tags(spark, str(tags))).collect()
    assert len(named) == 20 and {r["tag"] for r in named} <= {f"tag {t}" for t in range(4)}


def test_wide_table(spark, tmp_path):
    rng = random.Random(9)
    path = tmp_path / "train.csv"
    with open(path, "w") as out:
        for _ in range(800):
            x = [rng.gauss(0, 1) for _ in range(5)]
            out.write(",".join(f"{v:.4f}" for v in x) + f",{1 if x[0] > 0 else -1}\n")
    table = classify.recode_label(read_wide(spark, str(path), 5), "_c5")
    parts = splits.holdout(table, ["_c0", "_c1"])
    train, test = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
    sample = splits.hash_sample(train, ["_c2", "_c3"], 0.5)
    tuned = classify.cv_tune("rf", sample, {"maxDepth": [2, 4]}, label="_c5")
    model = classify.refit("rf", train, tuned, label="_c5")
    scored = classify.score(model, test)
    assert metrics.auc(scored, label="_c5").first()["auc"] > 0.95
    assert metrics.accuracy(scored, label="_c5").first()["accuracy"] > 0.9
    balance = metrics.label_balance(table, "_c5").first()
    assert balance["majority_share"] == pytest.approx(0.5, abs=0.1)
