"""Ranked lexical search: an automaton of all item terms counts them in whole texts, without an index.

The distinct terms of the items, each between two guards, make one Aho-Corasick automaton. A first
pass over the documents counts its matches and keeps, for each document, its length and the
(term, count) pairs of item terms. The corpus statistics are sums over that table. A second pass maps
the automaton's outputs to items, scores each document for each item that shares a term with it, and
keeps the best of a task; the best of all tasks are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.text import bounded_batches, flat, lowered, pieces, tokens
from cairnspark.sources.tables import materialise

# Fixed values of the score.
_SCALE, _SATURATION, _LEVEL, _SLOPE = 1_000_000_000, 8, 10, 90


@dataclass(frozen=True)
class Settings:
    best: int = 10
    #: Bytes of item texts that are searched at a time. They bound the automaton that every task holds;
    #: more items are searched in several blocks, each with a scan of its own.
    block_bytes: int = 4 << 20


#: Separators (and what they become), A-Z as a-z; bytes from 128 on belong to terms.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def guarded(text: str) -> str:
    """The text with each separator as a blank, in lower case (A-Z), and with a blank at both ends."""
    return f" {text.encode().translate(_PLAIN).decode()} "


def terms_of(text: str) -> list[str]:
    return guarded(text).split(" ")


def distinct_terms(text: str) -> list[str]:
    return sorted(set(terms_of(text)) - {""})


def weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


_built: dict[str, object] = {}


def _automaton(key: str, terms: list[str]):
    """The automaton of the guarded terms; a Python worker keeps the last one."""
    if key not in _built:
        import ahocorasick

        _built.clear()
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(f" {term} ", i)
        if terms:
            made.make_automaton()
        _built[key] = made
    return _built[key]


def _counts(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n_terms, terms, tfs) of each document: its length, and how often item terms occur in it."""
    spark = documents.sparkSession
    bounded_batches(spark)
    key = hashlib.sha256("\0".join(terms).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(terms)  # at most ``block_bytes``
    second = itemgetter(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in pieces(batches, "text"):
            data, bounds = flat(batch.column("text"))
            rows = tokens(lowered(data), bounds, marks=False)[2]
            found = [
                Counter(map(second, automaton.iter(guarded(text)))) if text and shared.value else {}
                for text in batch.column("text").to_pylist()
            ]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_terms": pa.array(np.bincount(rows, minlength=batch.num_rows)[: batch.num_rows].astype(np.int64)),
                    "terms": pa.array([list(x) for x in found], pa.list_(pa.int32())),
                    "tfs": pa.array([list(x.values()) for x in found], pa.list_(pa.int64())),
                }
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, n_terms long, terms array<int>, tfs array<long>"
    )


class _Best:
    """The best (score, doc) of each item so far; equal scores go by doc_id, null ids last."""

    def __init__(self, n_items: int, best: int):
        self.best, self.n_items = best, n_items
        self.least = np.zeros(n_items, np.int64)  # a score below it cannot count any more
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is null, id
        self.held = 0
        self.waiting: list[list[np.ndarray]] = []

    def add(self, item: np.ndarray, score: np.ndarray, unknown: np.ndarray, doc: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.least[item])
        if keep.any():
            self.waiting.append([x[keep] for x in (item, score, unknown, doc)])
            self.held += int(keep.sum())
            if self.held > 4 * self.best * self.n_items + 10_000:
                self.settle()

    def settle(self) -> None:
        item, score, unknown, doc = (np.concatenate(x) for x in zip(self.rows, *self.waiting))
        order = np.lexsort((doc, unknown, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        order, item = order[rank < self.best], item[rank < self.best]
        self.rows = [x[order] for x in (np.concatenate(y) for y in zip(self.rows, *self.waiting))]
        full = np.flatnonzero(rank[rank < self.best] == self.best - 1)
        self.least[item[full]] = self.rows[1][full]
        self.waiting, self.held = [], 0


def _best_of_tasks(counted: DataFrame, items_of: list[list[int]], weights: list[int], n_docs: int, n_words: int, best: int) -> DataFrame:
    """(item, doc_id, score): of each task, the best documents of each item."""
    n_items = max((i for x in items_of for i in x), default=-1) + 1
    shared = counted.sparkSession.sparkContext.broadcast(
        (  # the items of each term, one after the other, and where each term's items begin
            np.array([i for x in items_of for i in x], np.int64),
            np.cumsum([0, *map(len, items_of)]),
            np.array(weights, np.int64),
        )
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, weight_of = shared.value
        held = _Best(n_items, best)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("terms")
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                term = lists.flatten().to_numpy()
                tf = part.column("tfs").flatten().to_numpy()
                length = part.column("n_terms").to_numpy()
                m = 100 - _SLOPE + (_SLOPE * length * n_docs) // max(1, n_words)
                gain = weight_of[term] * ((_SCALE * tf) // (1000 * tf + _SATURATION * m[rows]))
                # Each gain goes to all items of its term.
                width = starts[term + 1] - starts[term]
                entry = np.repeat(np.arange(len(term)), width)
                inside = np.arange(len(entry)) - np.repeat(np.cumsum(width) - width, width)
                place = rows[entry] * n_items + items[starts[term][entry] + inside]
                cells, where = np.unique(place, return_inverse=True)
                score = np.zeros(len(cells), np.int64)
                np.add.at(score, where, gain[entry])
                ids = part.column("doc_id")
                unknown = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = ids.fill_null(0).to_numpy()
                row = cells // max(1, n_items)
                held.add(cells % max(1, n_items), score, unknown[row], doc[row])
        held.settle()
        item, score, unknown, doc = held.rows
        for at in range(0, len(item), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.record_batch(
                {
                    "item": pa.array(item[cut].astype(np.int32)),
                    "doc_id": pa.array(doc[cut], pa.int64(), mask=unknown[cut].astype(bool)),
                    "score": pa.array(score[cut]),
                }
            )

    return counted.mapInArrow(scored, "item int, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents with a score above 0 for each row of ``items``.

    ``documents`` has (doc_id, text), ``items`` (item_id, text). Whole texts are counted; a null text
    has no term, and neither document nor item is dropped for it: such an item has no result. Every
    row is a document of its own, also when ids repeat; equal scores go by ``doc_id``, a null id
    last. Items with equal texts are searched once, and each of their rows gets the list. Other
    columns are ignored, whatever their names. Empty tables give an empty result.

    Only item texts reach the driver, ``block_bytes`` of them at a time. A task returns at most
    ``best`` rows an item, so what is sorted by item is bounded by tasks, not documents.
    """
    spark = documents.sparkSession
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = items.select("item_id", key.alias("_key"))
    wanted = items.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Blocks by hash are uneven, so their average is half of the bound.
    n_blocks = 1 if size <= settings.block_bytes else math.ceil(2 * size / settings.block_bytes)
    found, totals = [], None
    for block in range(n_blocks):
        texts = sorted(r.text for r in wanted.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block).collect())
        terms = sorted({t for text in texts for t in distinct_terms(text)})
        number = {t: i for i, t in enumerate(terms)}
        items_of: list[list[int]] = [[] for _ in terms]
        for i, text in enumerate(texts):
            for t in distinct_terms(text):
                items_of[number[t]].append(i)
        counted = materialise(_counts(documents, terms), "term-counts")
        if totals is None:
            totals = counted.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row a term
        holders = {r["term"]: r["count"] for r in held}
        weights = [weight(totals[0], holders.get(i, 0)) for i in range(len(terms))]
        ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = (
            _best_of_tasks(counted, items_of, weights, totals[0], totals[1], settings.best)
            .withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= settings.best)
        )
        keys = spark.createDataFrame(
            [(i, hashlib.sha256(text.encode()).hexdigest()) for i, text in enumerate(texts)], "item int, _key string"
        )
        found.append(best.join(keys, "item").select("_key", "rank", "doc_id", "score"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return keyed.join(every, "_key").select("item_id", "rank", "doc_id", "score")
