"""The largest inner products of many vectors with many others, exactly and without all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.sources.tables import materialise


@dataclass(frozen=True)
class Block:
    """Some of the others, all of them no longer than ``norm``."""

    ids: np.ndarray
    vectors: np.ndarray
    norm: float


#: A vector's length is found by a sum in another order than the product, both in double precision.
_SLACK = 1e-6
_STATE = "id long, features array<float>, ids array<long>, scores array<float>, n_products long"


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def merge_best(
    vectors: np.ndarray, ids: np.ndarray, scores: np.ndarray, blocks: Sequence[Block], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each vector (ids, scores, both by falling score, then id) after ``blocks``, and the products made.

    ``scores`` is -inf where fewer than k are known. A block is skipped for the vectors whose length
    times that of the block's longest is below their k-th score.
    """
    ids, scores = ids.copy(), scores.copy()
    made = np.zeros(len(vectors), np.int64)
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    for block in blocks:
        rows = np.flatnonzero(lengths * block.norm * (1 + _SLACK) >= scores[:, k - 1])
        if not len(rows):
            continue
        made[rows] += len(block.ids)
        # Rounded to single precision: equal vectors get equal scores wherever they stand.
        new = (vectors[rows] @ block.vectors.T).astype(np.float32)
        least = scores[rows, k - 1]
        if new.shape[1] >= k:
            least = np.maximum(least, np.partition(new, new.shape[1] - k, axis=1)[:, -k])
        row, column = np.nonzero(new >= least[:, None])
        row = np.concatenate([np.repeat(np.arange(len(rows)), k), row])
        score = np.concatenate([scores[rows].ravel(), new[row[k * len(rows) :], column]])
        who = np.concatenate([ids[rows].ravel(), block.ids[column]])
        order = np.lexsort((who, -score, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        ids[rows], scores[rows] = who[order].reshape(-1, k), score[order].reshape(-1, k)
    return ids, scores, made


def _blocks(others: DataFrame, block_rows: int) -> DataFrame:
    """(block, norm, n, ids, vectors): the others by falling length, about ``block_rows`` in a row of the result."""
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    measured = materialise(others.select("id", "features", length.alias("norm")), "measured-vectors")
    n_blocks = max(1, -(-measured.count() // block_rows))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(p.num_rows for p in parts):
            return
        rows = pa.Table.from_batches(parts)
        ids = rows["id"].to_numpy().astype(np.int64)
        vectors = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        yield pa.record_batch(
            {
                "norm": pa.array([max(rows["norm"].to_pylist())], pa.float64()),
                "n": pa.array([len(ids)], pa.int64()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
            }
        )

    ranged = measured.repartitionByRange(n_blocks, F.desc("norm"), "id")
    made = ranged.mapInArrow(together, "norm double, n long, ids binary, vectors binary")
    return materialise(made.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def best_products(
    vectors: DataFrame, others: DataFrame, k: int, block_rows: int = 1024, round_bytes: int = 32 << 20
) -> DataFrame:
    """(id, ids, scores, n_products): for each vector the ``k`` others with the largest inner product.

    Both tables are (id, features array<float>), all of one length. Scores are single-precision and
    fall; equal ones go by id. ``n_products`` is how many products were made for the vector.

    The others are sorted by length and go round by round to all tasks, ``round_bytes`` at a time, so what is
    broadcast does not grow with the data. No other can beat a vector's k-th score if both lengths multiplied are below it:
    blocks of short ones are skipped, and a vector leaves the rounds when all that follow are too short. Each
    round is written to shared storage. If all lengths are alike nothing can be left out, and all
    products are made.
    """
    blocks = _blocks(others, block_rows)
    spark = vectors.sparkSession
    heads = blocks.select("block", "norm", "n", F.octet_length("vectors").alias("size")).orderBy(F.desc("norm"), "block").collect()
    rounds: list[list] = []
    held = 0
    for head in heads:
        if not rounds or held + head["size"] > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(head)
        held += head["size"]

    state = vectors.select(
        F.col("id").cast("long"),
        "features",
        F.array().cast("array<long>").alias("ids"),
        F.array().cast("array<float>").alias("scores"),
        F.lit(0).cast("long").alias("n_products"),
    )
    finished = []
    for i, heads_now in enumerate(rounds):
        rows = {r["block"]: r for r in blocks.where(F.col("block").isin([h["block"] for h in heads_now])).collect()}
        made = []
        for head in heads_now:
            row = rows[head["block"]]
            ids = np.frombuffer(bytes(row["ids"]), np.int64)
            made.append(Block(ids, np.frombuffer(bytes(row["vectors"]), np.float32).reshape(len(ids), -1).astype(np.float64), row["norm"]))
        shared = spark.sparkContext.broadcast(made)  # at most ``round_bytes``, as double twice that
        ahead = rounds[i + 1][0]["norm"] if i + 1 < len(rounds) else None

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    known = batch.column("ids").to_pylist()
                    ids = np.full((batch.num_rows, k), np.iinfo(np.int64).max)
                    scores = np.full((batch.num_rows, k), -np.inf, np.float32)
                    for row, (mine, values) in enumerate(zip(known, batch.column("scores").to_pylist())):
                        ids[row, : len(mine)], scores[row, : len(mine)] = mine, values
                    matrix = _matrix(batch.column("features"))
                    ids, scores, n = merge_best(matrix, ids, scores, shared.value, k)
                    lengths = np.sqrt((matrix * matrix).sum(axis=1))
                    more = np.zeros(len(n), bool) if ahead is None else lengths * ahead * (1 + _SLACK) >= scores[:, k - 1]
                    found = scores > -np.inf
                    yield pa.record_batch(
                        {
                            "id": batch.column("id"),
                            "features": batch.column("features"),
                            "ids": pa.array([x[f].tolist() for x, f in zip(ids, found)], pa.list_(pa.int64())),
                            "scores": pa.array([x[f].tolist() for x, f in zip(scores, found)], pa.list_(pa.float32())),
                            "n_products": pa.array(n + batch.column("n_products").to_numpy()),
                            "open": pa.array(more),
                        }
                    )

        done = materialise(state.mapInArrow(step, f"{_STATE}, open boolean"), "product-round", ["open"], rebalance=False)
        finished.append(done.where("not open").select("id", "ids", "scores", "n_products"))
        state = done.where("open").drop("open")
        if ahead is not None and not state.limit(1).count():
            break
    if not finished:
        finished = [state.select("id", "ids", "scores", "n_products")]
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result
