"""Sparse linear models: follow-the-regularised-leader training in one task, scoring of features."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: An example: label 0 or 1, distinct feature numbers, their values.
Example = tuple[int, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Linear:
    """A bias and one weight for each of 2**bits features."""

    weights: np.ndarray
    bias: float

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1


def follow_leader(
    examples: list[Example],
    bits: int,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.003,
    l2: float = 0.001,
    epochs: int = 6,
) -> Linear:
    """Logistic regression by follow-the-proximally-regularised-leader updates, one example at a time.

    Each feature has its own learning rate; weights whose gradient sum stays within ``l1`` are 0.
    The last place of the arrays holds the bias, which is not regularised.
    """
    size = 1 << bits
    gradient, square = np.zeros(size + 1), np.zeros(size + 1)

    def leader(at: np.ndarray) -> np.ndarray:
        z, lasso = gradient[at], np.where(at == size, 0.0, l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - lasso, 0)
        return -shrunk / ((beta + np.sqrt(square[at])) / alpha + np.where(at == size, 0.0, l2))

    packed = [(y, np.append(at, size).astype(np.int64), np.append(x, 1.0)) for y, at, x in examples]
    for _ in range(epochs):
        for y, at, x in packed:
            w = leader(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            root, grown = np.sqrt(square[at]), square[at] + g * g
            gradient[at] += g - (np.sqrt(grown) - root) / alpha * w
            square[at] = grown
    everywhere = leader(np.arange(size + 1))
    return Linear(everywhere[:-1].astype(np.float32), float(everywhere[-1]))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def fit_in_one_task(
    sample: DataFrame,
    featurise: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]],
    train: Callable[[list[Example]], dict[str, np.ndarray]],
) -> dict[str, np.ndarray]:
    """Features of a bounded sample (doc_id, text, label) on all tasks, then ``train`` in a single one.

    The sample is bounded by its maker, so one task can hold its features. They are ordered by a
    hash of the id: the same rows give the same model, however they were dealt out.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cairnspark.llm.text import pieces

        for batch in pieces(batches, "text"):
            found = list(featurise(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place"),
                    batch.column("label"),
                    pa.array([at.astype(np.int32).tobytes() for at, _ in found], pa.binary()),
                    pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary()),
                ],
                names=["place", "label", "at", "x"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[Example] = []
        for batch in batches:
            for y, at, x in zip(*(batch.column(c).to_pylist() for c in ("label", "at", "x"))):
                examples.append((y, np.frombuffer(at, np.int32), np.frombuffer(x, np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array([_packed(**train(examples))], pa.binary())], names=["model"])

    rows = sample.selectExpr("xxhash64(doc_id, label) as place", "label", "text")
    features = rows.mapInArrow(extract, "place long, label int, at binary, x binary")
    fitted = features.repartition(1).sortWithinPartitions("place", "at").mapInArrow(learn, "model binary")
    found = fitted.head()
    if found is None:  # without rows no task runs
        return train([])
    with np.load(io.BytesIO(bytes(found["model"]))) as arrays:
        return dict(arrays)
