"""Benchmark decontamination: spaced-seed hashes of both sides, joined, then verified word by word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.chars import expand
from cairnspark.llm.text import bounded_batches, flat, lowered, mix, pieces, run_hashes, tokens
from cairnspark.sources.tables import materialise

#: Fixed masks over neighbouring words: 1 counts, 0 is ignored. Wherever at most a fifth of six or
#: more words are substituted, one of them fits: more than 15 words keep four equal neighbours, and for
#: 15 and fewer every choice of words is tried in the tests.
MASKS = ("1111", "11011")
#: An item of fewer words than this is found only where it is the whole document.
SHINGLE = 5
#: The masks that items of ``SHINGLE`` words need besides, one word of theirs being substituted.
_SHINGLE_MASKS = ("11101", "10111")


@dataclass(frozen=True)
class Settings:
    #: Words an overlap must span (all of them, for a shorter item).
    least_words: int = 13
    #: Share of its words that must be equal.
    identity: float = 0.8
    #: Bits of the filter that leaves out most document seeds before the shuffle; the size is fixed.
    filter_bits: int = 1 << 24


def _salted(codes: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(codes + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))


def seeds(codes: np.ndarray, edges: np.ndarray, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Token number and hash of every seed within the rows ``codes[edges[i]:edges[i + 1]]``.

    Rows of ``SHINGLE`` words or more have one seed for each mask and position; shorter rows have one
    seed, all their words, if ``short`` has their length. ``SHINGLE`` in ``short`` adds the masks of
    items of that length.
    """
    sizes = np.diff(edges)
    found_at, found = [], []
    for mask in (*MASKS, *(_SHINGLE_MASKS if SHINGLE in short else ()), *("1" * n for n in short if n < SHINGLE)):
        whole = len(mask) < SHINGLE and mask not in MASKS
        fits = np.where(sizes == len(mask), 1, 0) if whole else np.where(sizes >= SHINGLE, sizes - len(mask) + 1, 0)
        at = expand(edges[:-1], fits)
        value = np.full(len(at), len(mask), np.uint64)
        for i, counts in enumerate(mask):
            if counts == "1":
                with np.errstate(over="ignore"):
                    value = value * np.uint64(0xBF58476D1CE4E5B9) + codes[at + i] * np.uint64(2 * i + 1)
        found_at.append(at)
        found.append(_salted(value, int(mask, 2)))
    return np.concatenate(found_at), np.concatenate(found)


def _row_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and the row bounds in them."""
    data, bounds = flat(column)
    data = lowered(data)
    starts, ends, rows = tokens(data, bounds, marks=False)
    return run_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(bounds)))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(bits)).astype(np.int64), (_salted(hashes, 77) % np.uint64(bits)).astype(np.int64)


def best_stretch(equal: np.ndarray, least: int = Settings.least_words, identity: float = Settings.identity) -> tuple[int, int]:
    """Bounds of the stretch with most equal words among those of ``least`` words (all, if there are fewer) and ``identity``.

    Of several the shortest, of these the first; (0, 0) if there is none.
    """
    least = min(least, len(equal))
    sums = np.append(0, np.cumsum(equal))
    over = sums - identity * np.arange(len(sums))
    # The farthest start for each end: the first place where ``over`` is no higher than at the end.
    ends = np.arange(least, len(sums))
    starts = np.searchsorted(-np.minimum.accumulate(over), -over[ends] - 1e-9)
    fits = starts <= ends - least
    starts, ends = starts[fits], ends[fits]
    if not least or not len(ends):
        return 0, 0
    count = sums[ends] - sums[starts]
    starts, ends = starts[count == count.max()], ends[count == count.max()]
    # Unequal words in front go, as long as enough words stay.
    starts = np.minimum(np.searchsorted(sums, sums[starts], side="right") - 1, ends - least)
    i = int(np.argmin(ends - starts))
    return int(starts[i]), int(ends[i])


def overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, content, item_id, n_words, n_equal, doc_word, item_word): overlaps of documents with items.

    ``content`` is the MD5 of the document's text. Words are runs of letters, digits and non-ASCII
    characters, A-Z as a-z. Where a seed is shared, document and item are laid over each other at
    that place; a stretch is an overlap if it spans ``least_words`` words, or all of a shorter item, and
    ``identity`` of its words are equal. Per row and item the overlap with most equal words is
    returned. None is missed as long as ``identity`` is 0.8 or more and ``least_words`` five or more;
    with lower settings those are found that share a seed. Items of fewer than five words match
    only a document of just these words; items and documents without words match nothing.
    Repeated documents give repeated rows, equal items one row each; ids may be null.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    short = _short_lengths(benchmark.select(F.col(item_text).alias("text")))
    items = materialise(_items(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), short), "items")
    item_seeds = items.dropDuplicates(["item"]).select("item", F.explode(F.arrays_zip("at", "seed")).alias("s")).select(
        "item", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed")
    )
    known = spark.sparkContext.broadcast(_filter(item_seeds, settings.filter_bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(known.value, bitorder="little").view(bool)
        for batch in pieces(batches, "text"):
            codes, edges = _row_tokens(batch.column("text"))
            at, value = seeds(codes, edges, short)
            one, other = _places(value, len(held))
            hit = held[one]
            hit[hit] = held[other[hit]]
            at, value = at[hit], value[hit]
            row = np.searchsorted(edges, at, side="right") - 1
            order = np.argsort(row, kind="stable")
            at, value, row = at[order], value[order].view(np.int64), row[order]
            rows, first = np.unique(row, return_index=True)
            cuts = np.append(first, len(row))
            texts = batch.column("text").take(pa.array(rows)).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([codes[edges[r] : edges[r + 1]].tobytes() for r in rows], pa.binary()),
                    pa.array([at[x:y] - edges[r] for r, x, y in zip(rows, cuts, cuts[1:])], pa.list_(pa.int64())),
                    pa.array([value[x:y] for x, y in zip(cuts, cuts[1:])], pa.list_(pa.int64())),
                ],
                names=["doc_id", "content", "words", "at", "seed"],
            )

    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    found = materialise(
        plain.mapInArrow(candidates, f"doc_id {id_type}, content string, words binary, at array<long>, seed array<long>"),
        "candidates",
    )
    # Copies of a text are looked at once.
    once = found.groupBy("content").agg(F.min(F.struct("words", "at", "seed")).alias("d")).select("content", "d.*")
    hits = (
        once.select("content", F.explode(F.arrays_zip("at", "seed")).alias("s"))
        .select("content", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
        .join(item_seeds, "seed")
        .select("content", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    size = lambda words: F.expr(f"octet_length({words}) div 8")
    laid = (
        hits.join(items.dropDuplicates(["item"]).select("item", F.col("words").alias("item_words")), "item")
        .join(once.select("content", "words"), "content")
        .withColumn("low", F.greatest(F.lit(0), -F.col("shift")))
        .withColumn("item_size", size("item_words"))
        .withColumn("high", F.least("item_size", size("words") - F.col("shift")))
        # Only the words of the document that lie under the item go on.
        .withColumn("words", F.expr("substring(words, int(8 * (low + shift) + 1), int(8 * (high - low)))"))
        .withColumn("item_words", F.expr("substring(item_words, int(8 * low + 1), int(8 * (high - low)))"))
    )

    sides = ["content", "item", "shift", "low", "item_size", "words", "item_words"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, item, shift, low, item_size, a, b in zip(*(batch.column(c).to_pylist() for c in sides)):
                equal = np.frombuffer(a, np.uint64) == np.frombuffer(b, np.uint64)
                least = min(settings.least_words, item_size)
                if len(equal) < least or equal.sum() < settings.identity * least:
                    continue
                start, end = best_stretch(equal, least, settings.identity)
                if start < end:
                    rows.append((content, item, end - start, int(equal[start:end].sum()), low + shift + start, low + start))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.string(), *[pa.int64()] * 4))],
                names=["content", "item", "n_words", "n_equal", "doc_word", "item_word"],
            )

    checked = laid.select(*sides).mapInArrow(
        verify, "content string, item string, n_words long, n_equal long, doc_word long, item_word long"
    )
    best = checked.groupBy("content", "item").agg(
        F.max(F.struct("n_equal", -F.col("n_words"), -F.col("doc_word"), -F.col("item_word"))).alias("b")
    ).select(
        "content", "item", F.col("b.n_equal").alias("n_equal"), *((-F.col(f"b.col{i}")).alias(c) for i, c in ((2, "n_words"), (3, "doc_word"), (4, "item_word")))
    )
    return (
        found.select("doc_id", "content")
        .join(best, "content")
        .join(items.select("item_id", "item"), "item")
        .select("doc_id", "content", "item_id", "n_words", "n_equal", "doc_word", "item_word")
    )


def _short_lengths(items: DataFrame) -> tuple[int, ...]:
    """Which numbers of words up to ``SHINGLE`` occur among the items."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes = np.unique(np.diff(_row_tokens(batch.column("text"))[1]))
            yield pa.RecordBatch.from_arrays([pa.array(sizes[(sizes > 0) & (sizes <= SHINGLE)].astype(np.int64))], names=["n"])

    return tuple(sorted(r["n"] for r in items.mapInArrow(lengths, "n long").distinct().collect()))


def _items(benchmark: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """(item_id, item, words, at, seed) for each benchmark row with words; ``item`` is a digest of its words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            codes, edges = _row_tokens(batch.column("text"))
            rows = np.flatnonzero(np.diff(edges))
            words = [codes[edges[r] : edges[r + 1]] for r in rows]
            each = [seeds(w, np.array([0, len(w)]), (len(w),) if len(w) in short else ()) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array(rows)),
                    pa.array([hashlib.md5(w.tobytes()).hexdigest() for w in words], pa.string()),
                    pa.array([w.tobytes() for w in words], pa.binary()),
                    pa.array([at for at, _ in each], pa.list_(pa.int64())),
                    pa.array([value.view(np.int64) for _, value in each], pa.list_(pa.int64())),
                ],
                names=["item_id", "item", "words", "at", "seed"],
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.mapInArrow(hashed, f"item_id {kind}, item string, words binary, at array<long>, seed array<long>")


def _filter(item_seeds: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the seeds: two bits each, packed into bits / 8 bytes however many there are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.zeros(bits, bool)
            for at in _places(batch.column("seed").to_numpy().view(np.uint64), bits):
                held[at] = True
            packed = np.packbits(held, bitorder="little").view(np.int64)
            full = np.flatnonzero(packed)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(packed[full])], names=["place", "word"])

    merged = item_seeds.select("seed").mapInArrow(places, "place long, word long").groupBy("place").agg(F.expr("bit_or(word)").alias("word"))
    out = np.zeros(bits // 64, np.int64)
    rows = merged.toArrow()  # bits / 64 rows at most
    out[rows["place"].to_numpy()] = rows["word"].to_numpy()
    return out.view(np.uint8)


def clean(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that overlap with no item; all columns pass unchanged, whatever their names.

    A null text counts as empty and has no words, so its row stays. Repeated rows stay or go together,
    and so do rows of equal text under different ids. Without items all rows stay; no rows in, no rows out.
    """
    dirty = overlaps(documents, benchmark, settings, doc_id, text).select("content").distinct()
    digest = F.md5(F.coalesce(documents[text], F.lit("")))
    return documents.join(dirty, digest == dirty["content"], "left_anti")
