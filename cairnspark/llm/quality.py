"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.linear import Linear, fit_in_one_task, follow_leader
from cairnspark.llm.text import (
    PIECE_BYTES,
    bounded_batches,
    flat,
    labelled_sample,
    mix,
    row_sums,
    run_hashes,
    sigmoid,
    slices,
    tokens,
    unique_counts,
)

#: Stands for a word that repeats the word before it.
_SAME = np.uint64(0x5A5A0F0F3C3C9696)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    orders: int = 2
    sample_rows: int = 8000
    epochs: int = 6


def word_features(
    data: np.ndarray, bounds: np.ndarray, bits: int, orders: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, feature number and value of each distinct feature; a row's values have length 1.

    Features are runs of one to ``orders`` tokens (words, and runs of punctuation), hashed. In a
    run of two or more, a token equal to the one before it counts as "the same again".
    """
    starts, ends, rows = tokens(data, bounds)
    codes = run_hashes(data, starts, ends)
    joined, parts = codes, [(rows.astype(np.uint64) << np.uint64(bits)) | (codes >> np.uint64(64 - bits))]
    again = np.append(False, codes[1:] == codes[:-1])
    backward = np.where(again, _SAME, codes)
    for n in range(2, orders + 1):
        if len(codes) < n:
            break
        with np.errstate(over="ignore"):
            head = np.where(again[n - 1 :] & (n == 2), _SAME, joined[:-1])
            joined = mix(head * np.uint64(0xBF58476D1CE4E5B9) + backward[n - 1 :] + np.uint64(n))
        within = rows[: len(joined)] == rows[n - 1 :]
        parts.append((rows[n - 1 :][within].astype(np.uint64) << np.uint64(bits)) | (joined[within] >> np.uint64(64 - bits)))
    keys, counts = unique_counts(np.concatenate(parts))
    row, at = (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = 1 + np.log(counts)
    norm = np.sqrt(row_sums(row, value * value, len(bounds) - 1))
    return row, at, value / norm[row]


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> Linear:
    """Train on at most ``settings.sample_rows`` labelled rows, chosen by the hash of their id.

    ``labels`` has doc_id and the label column; rows without one of them take no part. Without any
    labelled row the model is empty and gives every text the score 0.5.
    """

    def featurise(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data, bounds = flat(batch.column("text"))
        row, at, value = word_features(data, bounds, settings.bits, settings.orders)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for i in range(batch.num_rows):
            yield at[cuts[i] : cuts[i + 1]], value[cuts[i] : cuts[i + 1]]

    def train(examples: list) -> dict[str, np.ndarray]:
        model = follow_leader(examples, settings.bits, epochs=settings.epochs)
        return {"weights": model.weights, "bias": np.array(model.bias)}

    sample = labelled_sample(documents, labels, label, settings.sample_rows)
    fitted = fit_in_one_task(sample, featurise, train)
    return Linear(fitted["weights"], float(fitted["bias"]))


def score(
    documents: DataFrame, model: Linear, text: str = "text", to: str = "quality_score", orders: int = Settings.orders
) -> DataFrame:
    """The rows with one more column, the probability of label 1 of the whole text.

    The score is the logistic function of a sparse dot product. A null or empty text has no
    feature: its score is that of the bias alone. A column named ``to`` is replaced; other columns
    pass unchanged, equal texts get equal scores. No rows in, no rows out.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        found, held = [], shared.value
        for part in slices(texts, PIECE_BYTES):
            data, bounds = flat(part)
            row, at, value = word_features(data, bounds, held.bits, orders)
            found.append(held.bias + row_sums(row, held.weights[at] * value, len(part)))
        return pa.array(sigmoid(np.concatenate(found)) if found else np.zeros(0))

    return documents.withColumn(to, scores(F.col(text)))
