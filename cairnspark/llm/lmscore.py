"""Stupid-backoff scores: n-gram counts of the whole corpus, joined to the n-grams of each document.

N-grams never travel one by one. A block of documents asks for each of its distinct n-grams once:
sorted hashes and counts, cut into buckets of the hash. All requests of a bucket meet in one
place, which adds up the counts (its part of the count table) and answers each block in the order
of its request. So a very frequent n-gram is one entry for each block, however often it occurs.
Words and pairs are asked for first; of longer n-grams only those that may occur more than once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm.text import bounded_batches, flat, lowered, mix, pieces, run_hashes, slices, tokens
from cairnspark.sources.tables import materialise


@dataclass(frozen=True)
class Settings:
    order: int = 3
    backoff: float = 0.4
    #: N-grams of two words or more that the corpus has less often count as unseen; every n-gram counts by default.
    least_count: int = 1
    block_bytes: int = 3 << 20
    #: Entries of a bucket of the count table, about.
    bucket_entries: int = 1 << 20


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane, compressed: equal high bytes stand together."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size, planes = np.dtype(kind).itemsize, zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries inside the block delete their shuffle files when they are done, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the word number of each token, bounds of the rows in the tokens."""
    codes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in slices(batch.column("text")):  # only numbers of words, not of bytes, are held for a whole block
        data, bounds = flat(part)
        data = lowered(data)
        starts, ends, rows = tokens(data, bounds, marks=False)
        codes.append(run_hashes(data, starts, ends))
        sizes.append(np.bincount(rows, minlength=len(part))[: len(part)])
    words, word = np.unique(np.concatenate(codes), return_inverse=True)
    return words, word.astype(np.uint32), np.append(0, np.cumsum(np.concatenate(sizes)))


def _grams(words: np.ndarray, word: np.ndarray, edges: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: hashes of the distinct n-grams, the one that ends at each token (-1: none), counts."""
    which, codes = word.astype(np.int64), words
    place = np.arange(len(word)) - np.repeat(edges[:-1], np.diff(edges))
    yield codes, which, np.bincount(which, minlength=len(codes))
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 1)
        keys = which[at - 1] * len(words) + word[at]  # the run before, and this word
        distinct, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        with np.errstate(over="ignore"):
            codes = mix(codes[distinct // max(1, len(words))] * np.uint64(0xBF58476D1CE4E5B9) + words[distinct % max(1, len(words))] + np.uint64(n))
        which = np.full(len(word), -1, np.int64)
        which[at] = inverse
        yield codes, which, count


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


Request = tuple[np.ndarray, np.ndarray]


def walk(
    words: np.ndarray, word: np.ndarray, edges: np.ndarray, totals: list[np.ndarray], order: int
) -> tuple[list[np.ndarray], list[np.ndarray], Request | None]:
    """What the answers so far say of a block: for each n the corpus count of the n-gram that ends at each token, and
    whether there is one; and the next request, sorted hashes and counts, if not all orders are answered.

    The first request has all words and pairs. A longer n-gram is asked for only if the runs of n - 1 words at both of its
    ends occur twice or more in the corpus: with either of them there once, it is there once, too.
    """
    grams = _grams(words, word, edges, order)
    low = [next(grams) for _ in range(min(2, order))]
    hashes = np.concatenate([g[0] for g in low])
    sort = np.argsort(hashes, kind="stable")
    if not totals:
        return [], [], (hashes[sort], np.concatenate([g[2] for g in low])[sort])
    total = np.zeros(len(hashes) + 1, np.uint64)
    total[sort] = totals[0]
    counts, exists, begin = [], [], 0
    for codes, which, _ in low:
        there = which >= 0
        counts.append(np.where(there, total[begin + np.maximum(which, 0)], 0))
        exists.append(there)
        begin += len(codes)
    for phase, (codes, which, count) in enumerate(grams, start=1):
        there = which >= 0
        before = np.append(np.uint64(0), counts[-1][:-1])
        chosen = np.unique(which[there & (before > 1) & (counts[-1] > 1)])
        chosen = chosen[np.argsort(codes[chosen], kind="stable")]
        if phase == len(totals):
            return counts, exists, (codes[chosen], count[chosen])
        total = np.ones(len(codes) + 1, np.uint64)
        total[chosen] = totals[phase]
        counts.append(np.where(there, total[np.maximum(which, 0)], 0))
        exists.append(there)
    return counts, exists, None


def token_logs(
    count: list[np.ndarray], exists: list[np.ndarray], corpus_words: int, settings: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the score of each token, whether the longest n-gram that ends at it was found, and whether it is there twice."""
    log = np.log(np.maximum(count[0], 1)) - np.log(max(1, corpus_words))
    top, twice = np.ones(len(log), bool), count[0] > 1
    for n in range(1, len(count)):
        found = exists[n] & (count[n] >= settings.least_count)
        context = np.append(1, count[n - 1][:-1])[: len(log)]  # of the n-gram that ends one token before
        log = np.where(found, np.log(np.maximum(count[n], 1)) - np.log(np.maximum(context, 1)), log + exists[n] * np.log(settings.backoff))
        top, twice = np.where(exists[n], found, top), np.where(exists[n], count[n] > 1, twice)
    return log, top, twice


def score(documents: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_found, n_repeated, log_score): the log score of each document, summed over its words.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. The score of a word is
    count(n-gram) / count(its first n - 1 words) for the longest n-gram up to ``order`` that ends at
    it within the document, if the corpus has it ``least_count`` times; else ``backoff`` times the
    score of the n-gram one shorter; for a single word count / all words. Counts are those of all
    rows of ``documents``. ``n_found`` counts the words whose longest n-gram was found,
    ``n_repeated`` those whose longest n-gram the rows have twice or more. A text that is null, empty or
    without words has 0, 0, 0 and 0.0. Repeated rows count and are scored as often as they occur.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    order = settings.order

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", settings.block_bytes):
            words, word, edges = _block(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    pa.array([len(word)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")),
                    *(pa.array([x], pa.binary()) for x in (packed(words), packed(word), packed(edges.astype(np.uint64)))),
                ],
                names=["block", "n", "doc_ids", "words", "word", "edges"],
            )

    kinds = f"block string, n long, doc_ids array<{id_type}>, words binary, word binary, edges binary"
    # Written once: from here on the blocks and their names are fixed, whatever is run again.
    blocks = materialise(plain.mapInArrow(cut, kinds), "blocks")
    corpus_words = blocks.agg(F.sum("n")).head()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corpus_words * order // settings.bucket_entries))

    def held(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return unpacked(row["words"], np.uint64), unpacked(row["word"], np.uint32), unpacked(row["edges"], np.uint64).astype(np.int64)

    def answered(row: dict, phase: int) -> list[np.ndarray]:
        parts = [[unpacked(x["totals"], np.uint64) for x in row[f"answers{i}"] or ()] for i in range(phase)]
        return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in parts]

    def ask(phase: int):
        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    hashes, counts = walk(*held(row), answered(row, phase), order)[2]
                    cuts = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
                    used = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(used.astype(np.int32)),
                            pa.array([row["block"]] * len(used), pa.string()),
                            pa.array([packed(hashes[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
                            pa.array([packed(counts[cuts[b] : cuts[b + 1]].astype(np.uint32)) for b in used], pa.binary()),
                        ],
                        names=["bucket", "block", "hashes", "counts"],
                    )

        return asked

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come bucket by bucket."""
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[-1]["bucket"] != row["bucket"]:
                    yield _answers(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield _answers(rows)

    known = blocks.select("block", "n", "doc_ids", "words", "word", "edges")
    phases = 1 + max(0, order - 2)
    for phase in range(phases):
        rows = known.where("n > 0").drop("n", "doc_ids")
        asked = rows.mapInArrow(ask(phase), "bucket int, block string, hashes binary, counts binary")
        dealt = asked.repartition(int(min(buckets, 10_000)), "bucket").sortWithinPartitions("bucket")
        answers = dealt.mapInArrow(answer, "bucket int, block string, totals binary")
        # The answers to one block have one entry for each of the n-grams it has asked for.
        told = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias(f"answers{phase}"))
        with shuffles_released(spark):  # the requests take most of the disk, and are not needed any more
            told = materialise(told, "answers")
        known = known.join(told, "block", "left")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, word, edges = held(row)
                totals = answered(row, phases)
                count, exists, _ = walk(words, word, edges, totals, order)
                log, found, twice = token_logs(count, exists, corpus_words, settings)
                owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        pa.array(np.diff(edges)),
                        pa.array(np.bincount(owner, found, len(edges) - 1).astype(np.int64)),
                        pa.array(np.bincount(owner, twice, len(edges) - 1).astype(np.int64)),
                        pa.array(np.bincount(owner, log, len(edges) - 1).astype(np.float64)),
                    ],
                    names=["doc_id", "n_words", "n_found", "n_repeated", "log_score"],
                )

    return known.drop("block", "n").mapInArrow(
        add_up, f"doc_id {id_type}, n_words long, n_found long, n_repeated long, log_score double"
    )


def _answers(rows: list[dict]) -> pa.RecordBatch:
    """Total count of each n-gram of a bucket, for each request in its own order."""
    hashes = [unpacked(r["hashes"], np.uint64) for r in rows]
    every = np.concatenate(hashes)
    sort = np.argsort(every, kind="stable")
    first = np.append(True, every[sort][1:] != every[sort][:-1])
    counts = np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]).astype(np.uint64)
    totals = np.add.reduceat(counts[sort], np.flatnonzero(first))
    back = np.empty(len(every), np.uint64)
    back[sort] = np.repeat(totals, np.diff(np.append(np.flatnonzero(first), len(every))))
    parts = np.split(back, np.cumsum([len(h) for h in hashes])[:-1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r["bucket"] for r in rows], pa.int32()),
            pa.array([r["block"] for r in rows], pa.string()),
            pa.array([packed(p) for p in parts], pa.binary()),
        ],
        names=["bucket", "block", "totals"],
    )
