"""Shared helpers: Arrow batches as flat byte arrays, vectorised tokens and hashes, labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch is cut into pieces of about this many bytes of text; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= _GOLDEN
        x ^= x >> np.uint64(29)
        x *= np.uint64(_BASE)
        x ^= x >> np.uint64(32)
    return x


#: A random 64-bit number for each byte value.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            size = 1 << (n - 1).bit_length()
            ones = np.ones(size, np.uint64)
            up, down = ones * np.uint64(_BASE), ones * np.uint64(pow(_BASE, -1, 1 << 64))
            up[0] = down[0] = 1
            _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n + 1 row bounds; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """A column in parts of at most ``limit`` bytes of text (a longer text comes alone)."""
    start, held = 0, 0
    for row, size in enumerate(np.diff(flat(column)[1]).tolist()):
        if held and held + size > limit:
            yield column.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(column):
        yield column.slice(start)


def bounded_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Let no Arrow batch that goes to Python hold many more bytes than ``limit``, however long the rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not 0 < int(now.rstrip("b")) <= limit:
        spark.conf.set(name, str(limit))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (a longer text comes alone)."""
    for batch in batches:
        start = 0
        for part in slices(batch.column(text), limit):
            yield batch.slice(start, len(part))
            start += len(part)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each run data[start:end], equal for equal bytes wherever they stand."""
    up, down = _grown(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


class Known:
    """Numbers of 64-bit hashes, by open addressing in one array."""

    def __init__(self, hashes: np.ndarray, size: int):
        self.hashes, self.n = np.zeros(size, np.uint64), 0
        self.slots = np.full(1 << (2 * size).bit_length(), -1, np.int32)
        self.add(hashes)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """Distinct hashes, none of them known; they get the next numbers."""
        numbers = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.hashes[numbers] = hashes
        self.n += len(hashes)
        slot = self._slot(hashes)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers  # taken, or another one came to the same slot
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.slots) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is not known."""
        out = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            number = self.slots[slot]
            same = (number >= 0) & (self.hashes[number] == hashes[left])
            out[left[same]] = number[same]
            on = (number >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out


_SPACE, _WORD, _MARK = 0, 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[128:] = _WORD
for _first, _last in ("09", "AZ", "az"):
    _CLASS[ord(_first) : ord(_last) + 1] = _WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return _LOWER[data]


def tokens(data: np.ndarray, bounds: np.ndarray, marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the tokens, in text order.

    A token is a longest run of letters, digits and non-ASCII bytes, or (``marks``) of other
    visible ASCII characters.
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    kind = _CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    inner = bounds[1:-1]
    edge[inner[inner < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != _SPACE if marks else kind[starts] == _WORD
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def blank_split(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the longest runs without ASCII white space."""
    visible = np.append(_CLASS[data] != _SPACE, False)
    before = np.append(False, visible[:-1])
    cut = np.zeros(len(data) + 1, bool)  # a run ends with its row
    cut[bounds] = True
    starts = np.flatnonzero(visible & (~before | cut))
    ends = np.flatnonzero(before & (~visible | cut))
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)[:n]


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def part_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n: which part of a fixed split a row belongs to."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text, label): at most ``limit`` labelled rows, those with the smallest hash of the id.

    Which rows are taken depends on the ids alone. Rows without id or label take no part.
    """
    marks = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(limit)
    )
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # At most ``limit`` ids and labels, so this side may be sent to every task.
    return rows.join(F.broadcast(marks), "doc_id")
