"""Fit the three classifiers on a table of the published shape; prints one JSON line per fit.

``python scale_trial.py ROWS FEATURES [kind:param=value,..] ...``; the table is derived from the
test vectors (each repeated with hashed noise), written once to the shared folder, and read from
there. ROWS is rounded up to whole copies. ``stored`` among the fits assembles the vectors once and lets all fits after it read them. Fit time includes reading; scoring is forced by an aggregate over a fifth of the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.operators import classify, metrics
from cairnspark.plans.views import N_FEATURES, table
from cairnspark.session import build_session
from cairnspark.sources import materialise

DEFAULT_FITS = [
    "lr:maxIter=5,elasticNetParam=0.0",
    "lr:maxIter=1,elasticNetParam=1.0",
    "mlp:maxIter=1",
    "rf:maxDepth=5,minInfoGain=0.2",
    "rf:maxDepth=10",
]


def wide_table(spark: SparkSession, rows: int, features: int) -> DataFrame:
    vectors = table(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), "embeddings")
    copies = -(-rows // vectors.count())
    repeated = vectors.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    repeated = repeated.repartition(8 * spark.sparkContext.defaultParallelism, "vec_id", "copy")
    noise = [F.pmod(F.xxhash64("vec_id", "copy", F.lit(i)), F.lit(1000)) / 5000.0 for i in range(features)]
    columns = [(F.col("embedding")[i % N_FEATURES] + noise[i]).alias(f"_c{i}") for i in range(features)]
    label = F.pmod(F.xxhash64("copy", "vec_id"), F.lit(2)).cast("int").alias("label")
    return materialise(repeated.select(*columns, label), "scale-trial")


def parse(spec: str) -> tuple[str, dict]:
    kind, _, settings = spec.partition(":")
    return kind, {k: json.loads(v) for k, v in (s.split("=") for s in settings.split(",") if s)}


def main() -> None:
    rows, features = int(sys.argv[1]), int(sys.argv[2])
    spark = build_session("scale-trial", int(os.environ.get("BENCH_CPUS", "8")))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10")
    start = time.perf_counter()
    df = wide_table(spark, rows, features)
    print(json.dumps({"step": "write", "seconds": round(time.perf_counter() - start, 1)}), flush=True)
    inputs = [f"_c{i}" for i in range(features)]
    train: DataFrame | classify.Prepared = df
    for spec in sys.argv[3:] or DEFAULT_FITS:
        if spec == "stored":
            start = time.perf_counter()
            train = classify.prepare(df, inputs=inputs)
            print(json.dumps({"step": spec, "seconds": round(time.perf_counter() - start, 1)}), flush=True)
            continue
        kind, params = parse(spec)
        start = time.perf_counter()
        model = classify.fit(kind, train, params, inputs=inputs)
        fitted = time.perf_counter()
        test = df.where(F.pmod(F.xxhash64("_c0", "_c1"), F.lit(5)) == 0)
        report = metrics.model_report(classify.score(model, test).withColumn("model", F.lit(kind))).first()
        line = {
            "step": spec,
            "rows": rows,
            "features": features,
            "fit_seconds": round(fitted - start, 1),
            "score_seconds": round(time.perf_counter() - fitted, 1),
            "n_scored": report["n_rows"],
            "accuracy": round(report["accuracy"], 4),
            "auc": round(report["auc"], 4),
        }
        print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
