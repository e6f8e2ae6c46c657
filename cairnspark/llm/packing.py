"""Packing documents into sequences along a space-filling curve.

A document's tokens are hashed to a vector, which is projected to a few dimensions; its place is the
Hilbert key of the projection. Documents are sorted by range of that key, so neighbours on the curve,
which are alike, share sequences. The sorted tokens are one stream that is cut at sequence ends only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.text import Known, bounded_batches, flat, lowered, mix, pieces, run_hashes, unique_counts
from cairnspark.sources.tables import materialise


@dataclass(frozen=True)
class Settings:
    length: int = 4096  #: tokens of a sequence
    end_id: int = 2  #: follows each document
    buckets: int = 4096  #: of the hashed document vector
    dimensions: int = 4
    bits: int = 10  #: of a coordinate on the curve
    chunk: int = 1 << 16  #: most tokens in one stored row; a longer document has several
    part_tokens: int = 1 << 22  #: tokens that one task places, about
    most_parts: int = 50_000  #: beyond this number, parts grow instead


#: Kinds of visible ASCII: letters, digits, others; 0 for blanks, controls and parts of other characters.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
#: How byte-level vocabularies write the bytes that are no visible Latin-1 character: from U+0100 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
_BYTE_LEVEL = {byte: 256 + i for i, byte in enumerate(_HIDDEN)}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and never joins across it.

    Such a tokenizer also ends a piece between ASCII characters of different kinds and after a digit,
    but for letters behind an apostrophe. What stands between these places is encoded independently of
    its surroundings, so each such word is encoded once and remembered by its 64-bit hash, up to
    ``keep`` of them. Words of more than ``LONG`` bytes are not remembered. Texts that hold one of the
    tokenizer's special strings are left to the library as a whole.
    """

    LONG = 64

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The library's normaliser and splitter leave a word of small Latin letters as it is, and its
        # byte level writes each byte as a character; the model alone is faster.
        self.plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
        self.known = Known(np.zeros(0, np.uint64), keep)
        self.flat, self.bounds, self.asked = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words that were asked for more than once, if they are less than half of all."""
        keep = self.asked > 1
        keep &= 2 * keep.sum() < len(keep)
        sizes = np.diff(self.bounds)
        self.known = Known(self.known.hashes[: len(keep)][keep], self.keep)
        self.flat = self.flat[np.repeat(keep, sizes)]
        self.bounds = np.append(0, np.cumsum(sizes[keep]))
        self.asked = np.zeros(self.known.n, np.int64)

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and their numbers."""
        model, plain = self.tokenizer.model, self.plain
        texts = [w.decode() for w in words]
        ids = [
            [x.id for x in model.tokenize(t if t.isascii() else w.decode("latin-1").translate(_BYTE_LEVEL))] if plain(t) else self._ids(w)
            for w, t in zip(words, texts)
        ]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the n + 1 bounds of the texts."""
        data, bounds = flat(texts)
        small = lowered(data)
        whole = small.tobytes()
        if not any(mark in whole for mark in self.special):
            return self._split(small, bounds)
        parts, sizes, at = [], [], 0
        special = [any(m in whole[a:b] for m in self.special) for a, b in zip(bounds[:-1], bounds[1:])]
        while at < len(special):
            if special[at]:
                ids = np.array(self._ids(data[bounds[at] : bounds[at + 1]].tobytes()), np.uint32)
                size, end = np.array([len(ids)]), at + 1
            else:
                end = next((i for i in range(at, len(special)) if special[i]), len(special))
                ids, ends = self._split(small[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
                size = np.diff(ends)
            parts.append(ids)
            sizes.append(size)
            at = end
        return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))

    def _split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        kind = _KIND[data]
        before, after = kind[:-1], kind[1:]
        over = (before > 0) & (after > 0) & ((before != after) | (before == 2))
        cut[1:-1] |= over & ((data[:-1] != ord("'")) | (after != 1))
        seen = np.concatenate([[False], ~_BLANK[data], [False]])
        starts = np.flatnonzero(seen[1:-1] & (~seen[:-2] | cut[:-1]))
        ends = np.flatnonzero(seen[1:-1] & (~seen[2:] | cut[1:])) + 1
        hashes = run_hashes(data, starts, ends)
        long = ends - starts > self.LONG

        where = self.known.find(hashes)
        new, first = np.unique(hashes[(where < 0) & ~long], return_index=True)
        if self.known.n + len(new) > self.keep:
            self._forget()
            where = self.known.find(hashes)
            new, first = np.unique(hashes[(where < 0) & ~long], return_index=True)
        spelt = np.flatnonzero((where < 0) & ~long)[first]
        once = np.flatnonzero(long)
        ids, sizes = self._encode([data[starts[i] : ends[i]].tobytes() for i in np.append(spelt, once)])
        flat_ids = np.append(self.flat, ids)
        edges = np.append(self.bounds, self.bounds[-1] + np.cumsum(sizes))
        where[once] = self.known.n + len(new) + np.arange(len(once))
        if self.known.n + len(new) <= self.keep:
            n_before = self.known.n
            self.known.add(new)
            fresh = (where < 0) & ~long
            where[fresh] = n_before + np.searchsorted(new, hashes[fresh])
            self.bounds = edges[: self.known.n + 1]
            self.flat = flat_ids[: self.bounds[-1]]
            self.asked = np.append(self.asked, np.zeros(len(new), np.int64))
            self.asked += np.bincount(where[where < self.known.n], minlength=self.known.n)
        else:  # more new words than may be kept: they serve this call only
            fresh = (where < 0) & ~long
            where[fresh] = self.known.n + np.searchsorted(new, hashes[fresh])
        begin, size = edges[where], edges[where + 1] - edges[where]
        stops = np.cumsum(size)
        ids = flat_ids[np.repeat(begin - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
        return ids, np.append(0, stops)[np.searchsorted(starts, bounds)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def projection(settings: Settings) -> np.ndarray:
    """A fixed random direction for each bucket."""
    return np.random.default_rng(20).standard_normal((settings.buckets, settings.dimensions))


def coordinates(ids: np.ndarray, bounds: np.ndarray, settings: Settings, directions: np.ndarray) -> np.ndarray:
    """(documents, dimensions): unit vectors of log counts of hashed ids, projected; 0 without ids."""
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds)).astype(np.uint64)
    buckets = np.uint64(settings.buckets)
    cells, counts = unique_counts(rows * buckets + mix(ids) % buckets)
    row, bucket = (cells // buckets).astype(np.int64), (cells % buckets).astype(np.int64)
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value * value, n))
    columns = [np.bincount(row, value * directions[bucket, d], n) for d in range(settings.dimensions)]
    return np.stack(columns, axis=1) / np.maximum(norm, 1e-12)[:, None]


def cells_of(points: np.ndarray, bits: int) -> np.ndarray:
    """Coordinates as whole numbers of ``bits`` bits: the logistic function spreads them over the range."""
    share = 1 / (1 + np.exp(-1.7 * np.clip(points, -20, 20)))
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (points, dimensions) on the Hilbert curve; neighbours on it differ by one step.

    Skilling's method: undo the excess rotations from the highest bit down, then decode the Gray code
    of the transposed bits.
    """
    x = [c.copy() for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (((x[i] ^ flip) >> bit) & 1)
    return key


def encoded(documents: DataFrame, path: str, settings: Settings) -> DataFrame:
    """(place, row, doc_id, start, n, doc_tokens, ids): rows of at most ``chunk`` tokens, ids compressed.

    The place is the Hilbert key with a hash of the row behind it, so that a large group of equal
    documents can be divided between tasks.
    """
    import zstandard

    bounded_batches(documents.sparkSession)
    tie_bits = 63 - settings.dimensions * settings.bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, directions = _encoder(path), projection(settings)
        packer = zstandard.ZstdCompressor(level=1)
        next_row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text"):
            ids, bounds = encoder(batch.column("text"))
            keys = hilbert_keys(cells_of(coordinates(ids, bounds, settings, directions), settings.bits), settings.bits)
            row = np.arange(next_row, next_row + batch.num_rows)
            next_row += batch.num_rows
            places = keys << tie_bits | (mix(row) >> np.uint64(64 - tie_bits)).astype(np.int64)
            out: list[tuple] = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                mine = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(settings.end_id)).astype("<u4")
                for start in range(0, len(mine), settings.chunk):
                    part = mine[start : start + settings.chunk]
                    out.append((places[i], row[i], doc_id, start, len(part), len(mine), packer.compress(part.astype("<u4").tobytes())))
            place, number, doc, start, n, total, packed = zip(*out) if out else [()] * 7
            yield pa.record_batch(
                {
                    "place": pa.array(place, pa.int64()),
                    "row": pa.array(number, pa.int64()),
                    "doc_id": pa.array(doc, pa.int64()),
                    "start": pa.array(start, pa.int64()),
                    "n": pa.array(n, pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()),
                    "ids": pa.array(packed, pa.binary()),
                }
            )

    schema = "place long, row long, doc_id long, start long, n long, doc_tokens long, ids binary"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def sequence_ends(total: int, length: int) -> list[int]:
    """Where the sequences after the last full one end: the rest of the stream as falling powers of two.

    No sequence then needs padding, whatever the number of tokens.
    """
    at, ends = total // length * length, []
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return ends


def cuts(at: int, n: int, total: int, length: int, tail: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of ``n`` tokens that begin at ``at`` in the stream."""
    full = total // length
    start = 0
    while start < n:
        here = at + start
        number, begin = here // length, here // length * length
        end = begin + length
        if number >= full:
            ahead = next(i for i, e in enumerate(tail) if e > here)
            number, begin, end = full + ahead, tail[ahead - 1] if ahead else full * length, tail[ahead]
        size = min(end - here, n - start)
        yield start, size, number, here - begin
        start += size


def pack(documents: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all sequences.

    ``documents`` has (doc_id, text); ``path`` is a vocabulary file of the ``tokenizers`` library.
    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers. Sequences are numbered from
    0 along the curve and have ``length`` tokens; the rest at the very end is cut into powers of two.

    A null or empty text is the end id alone. Every row is a document of its own, also when ids are
    null or repeat. Other columns are ignored, whatever their names. An empty table has no pieces.

    The encoded documents are stored once. What the driver holds is one number for each of at most
    ``most_parts`` parts: quantiles of the places, and the tokens in between.
    """
    stored = materialise(encoded(documents, path, settings), "encoded-documents")
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_parts = min(max(1, math.ceil(total / settings.part_tokens)), settings.most_parts)
    bounds = np.zeros(0, np.int64)
    if n_parts > 1:
        shares = [i / n_parts for i in range(1, n_parts)]
        bounds = np.array(stored.agg(F.percentile_approx("place", shares, max(10_000, 20 * n_parts))).first()[0], np.int64)

    @F.arrow_udf("int")
    def part_of_place(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, places.to_numpy(), side="left").astype(np.int32))

    parted = stored.withColumn("part", part_of_place("place"))
    sizes = {r["part"]: r["size"] for r in parted.groupBy("part").agg(F.sum("n").alias("size")).collect()}
    starts = np.cumsum([0] + [sizes.get(i, 0) for i in range(n_parts)])
    tail = sequence_ends(total, settings.length)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        part, at = -1, 0
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("part", "doc_id", "start", "n", "doc_tokens", "ids")]
            for row_part, doc_id, start, n, doc_tokens, packed in zip(*columns):
                if row_part != part:
                    part, at = row_part, int(starts[row_part])
                ids = unpacker.decompress(packed)
                for first, size, sequence, offset in cuts(at, n, total, settings.length, tail):
                    out.append((doc_id, start + first, size, ids[4 * first : 4 * (first + size)], doc_tokens, sequence, offset))
                at += n
            doc, start, size, ids, doc_tokens, sequence, offset = zip(*out) if out else [()] * 7
            yield pa.record_batch(
                {
                    "doc_id": pa.array(doc, pa.int64()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "doc_tokens": pa.array(doc_tokens, pa.int64()),
                    "sequence_id": pa.array(sequence, pa.int64()),
                    "offset": pa.array(offset, pa.int64()),
                }
            )

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return (
        parted.repartitionById(n_parts, "part")
        .sortWithinPartitions("part", "place", "row", "start")
        .mapInArrow(placed, schema)
    )
