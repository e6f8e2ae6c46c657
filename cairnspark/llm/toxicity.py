"""Toxicity: a linear model on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.chars import char_ngrams, distinct_words, expand
from cairnspark.llm.linear import Example, Linear, fit_in_one_task, follow_leader
from cairnspark.llm.text import (
    PIECE_BYTES,
    bounded_batches,
    flat,
    labelled_sample,
    row_sums,
    sigmoid,
    slices,
    unique_counts,
)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    shortest: int = 3
    longest: int = 6
    sample_rows: int = 6000
    smoothing: float = 1.0
    epochs: int = 5

    @property
    def orders(self) -> range:
        return range(self.shortest, self.longest + 1)


def char_features(
    data: np.ndarray, bounds: np.ndarray, settings: Settings, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each distinct feature of a row, by row; with ``weights`` only those that weigh anything."""
    words = distinct_words(data, bounds)
    owner, codes = char_ngrams(words, settings.orders)
    at = (codes >> np.uint64(64 - settings.bits)).astype(np.int64)
    if weights is not None:
        weighs = weights[at] != 0
        owner, at = owner[weighs], at[weighs]
    edges = np.searchsorted(owner, np.arange(len(words) + 1))
    count = np.diff(edges)
    has = count[words.word] > 0
    pairs, _ = unique_counts(words.rows[has] * max(1, len(words)) + words.word[has])
    row, word = pairs // max(1, len(words)), pairs % max(1, len(words))
    keys, _ = unique_counts(
        (np.repeat(row, count[word]) << settings.bits) | at[expand(edges[:-1][word], count[word])]
    )
    return keys >> settings.bits, keys & ((1 << settings.bits) - 1)


def log_count_ratios(examples: list[Example], bits: int, smoothing: float) -> np.ndarray:
    """log of (share of label 1 rows with the feature / share of label 0 rows with it), 0 for unseen features."""
    seen, rows = np.zeros((2, 1 << bits)), np.zeros(2)
    for y, at, _ in examples:
        seen[y][at] += 1
        rows[y] += 1
    prior = rows / max(1.0, rows.sum())
    share = (seen + smoothing * prior[:, None]) / (rows + smoothing)[:, None]
    if not rows.all():
        return np.zeros(1 << bits)
    return np.log(share[1] / share[0]) * (seen.sum(axis=0) > 0)


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "toxic") -> Linear:
    """Train on at most ``settings.sample_rows`` labelled rows, chosen by the hash of their id.

    Ratios of the counts in the two classes scale the features (present or not); logistic
    regression on the scaled features gives the weights. Rows without id or label take no part.
    With rows of one class only, ratios are 0 and the bias alone decides.
    """

    def featurise(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data, bounds = flat(batch.column("text"))
        row, at = char_features(data, bounds, settings)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for i in range(batch.num_rows):
            yield at[cuts[i] : cuts[i + 1]], np.zeros(0)

    def train(examples: list[Example]) -> dict[str, np.ndarray]:
        ratios = log_count_ratios(examples, settings.bits, settings.smoothing)
        scaled = [(y, at[np.abs(ratios[at]) > 0.2], None) for y, at, _ in examples]
        model = follow_leader([(y, at, ratios[at]) for y, at, _ in scaled], settings.bits, 0.1, epochs=settings.epochs)
        return {"weights": model.weights * ratios.astype(np.float32), "bias": np.array(model.bias)}

    fitted = fit_in_one_task(labelled_sample(documents, labels, label, settings.sample_rows), featurise, train)
    return Linear(fitted["weights"], float(fitted["bias"]))


def score(
    documents: DataFrame,
    model: Linear,
    text: str = "text",
    to: str = "toxicity",
    settings: Settings = Settings(),
) -> DataFrame:
    """The rows with one more column, the probability of label 1 of the whole text.

    A null or empty text has no feature: its score is that of the bias alone. Equal texts get equal
    scores; a column named ``to`` is replaced, other columns pass unchanged. No rows in, no rows out.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        found, held = [], shared.value
        for part in slices(texts, PIECE_BYTES):
            row, at = char_features(*flat(part), settings, held.weights)
            found.append(held.bias + row_sums(row, held.weights[at], len(part)))
        return pa.array(sigmoid(np.concatenate(found)) if found else np.zeros(0))

    return documents.withColumn(to, scores(F.col(text)))
