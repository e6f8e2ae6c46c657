"""Time the headline queries; prints one JSON line.

Each query runs once to warm up, then up to three times (slow ones fewer); the median counts.
Results go to Spark's ``noop`` sink, so every row and column is computed. Model fits are timed
with the scoring of the test part, forced by an aggregate.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from cairnspark.operators import classify, metrics, recommend
from cairnspark.plans import ORACLES, QUERIES
from cairnspark.plans import classification as wide_plans
from cairnspark.plans import ratings as rating_plans
from cairnspark.plans.registry import forget
from cairnspark.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = 3
ENOUGH_SECONDS = 6.0


def median_seconds(run: Callable[[], None]) -> float:
    run()
    times: list[float] = []
    while len(times) < RUNS and sum(times) < ENOUGH_SECONDS:
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return statistics.median(times)


def main() -> None:
    spark = build_session("bench", CPUS)

    def named(name: str) -> Callable[[], None]:
        return lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    def fit(kind: str) -> Callable[[], None]:
        train, test = wide_plans.train(spark, SF_DIR), wide_plans.test(spark, SF_DIR)

        def run() -> None:
            model = classify.fit(kind, train, wide_plans.FITS[kind], inputs=wide_plans.INPUTS)
            metrics.accuracy(classify.score(model, test)).collect()

        return run

    def als() -> None:
        folded = rating_plans.stored_folds(spark, SF_DIR)
        _, scored = recommend.als_predict(folded.where("fold <> 0"), folded.where("fold = 0"))
        metrics.rmse(scored).collect()

    forget()
    # ``als_cv_coverage`` and the checks of the fits need whole tunings; single fits are timed below instead.
    plain = [name for name in QUERIES if name in ORACLES and not name.endswith("_check") and name != "als_cv_coverage"]
    runs = {name: named(name) for name in plain}
    runs |= {f"{kind}_fit_and_score": fit(kind) for kind in ("rf", "lr", "mlp")}
    runs["als_fit_and_score"] = als
    seconds = {}
    for name, run in runs.items():
        seconds[name] = round(median_seconds(run), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "sum of median seconds over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
