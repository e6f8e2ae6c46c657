"""SimHash near-duplicates: fingerprints, exact comparison of tiles of fingerprints, groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.chars import expand
from cairnspark.llm.components import connected_components
from cairnspark.llm.text import PIECE_BYTES, blank_split, bounded_batches, flat, lowered, slices
from cairnspark.sources.tables import materialise

SEED = 42
_SEGMENTS, _WIDTH = 4, 16


@dataclass(frozen=True)
class Settings:
    words: int = 3
    radius: int = 3
    #: Fingerprints in a tile, about.
    tile: int = 2048


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and XXH64 of each shingle in text order; a row of fewer words is one shingle."""
    data = lowered(data)
    starts, ends, rows = blank_split(data, bounds)
    sizes = ends - starts
    edges = np.append(0, np.cumsum(sizes + 1))  # words stand one blank apart
    joined = np.full(edges[-1], ord(" "), np.uint8)
    joined[expand(edges[:-1], sizes)] = data[expand(starts, sizes)]
    per_row = np.bincount(rows, minlength=len(bounds) - 1)
    first_word = np.cumsum(per_row) - per_row
    count = np.where(per_row > 0, np.maximum(per_row - words + 1, 1), 0)
    first = expand(first_word, count)
    owner = np.repeat(np.arange(len(count)), count)
    last = np.minimum(first + words, first_word[owner] + per_row[owner]) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(edges[first].tolist(), (edges[last] + sizes[last]).tolist())
    return owner, np.fromiter((digest(text[a:b], SEED) for a, b in spans), np.uint64, len(first))


def majority_bits(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the bits that are set in over half of its hashes; 0 without hashes."""
    counts = np.bincount(rows, minlength=n)
    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    # Eight one-byte counters stand in a 64-bit number: they hold the sums of runs of up to 255.
    runs = -(-counts // 255)
    owner = np.repeat(np.arange(n), runs)
    start = np.repeat(np.cumsum(counts) - counts, runs) + 255 * (expand(np.zeros(n, np.int64), runs))
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    full = owner[heads]
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101), start)
        eight = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        for lane in range(8):
            more = 2 * eight[:, lane] > counts[full]
            out[full] |= more.astype(np.uint64) << np.uint64(8 * lane + shift)
    return out


def fingerprints(documents: DataFrame, text: str = "text", to: str = "fingerprint", settings: Settings = Settings()) -> DataFrame:
    """The rows with their 64-bit fingerprint as a signed number.

    A-Z count as a-z, words stand between blanks, shingles of ``settings.words`` words count as
    often as they occur. A null or empty text, or one of blanks only, has the fingerprint 0. A
    column named ``to`` is replaced; other columns pass unchanged.
    """
    bounded_batches(documents.sparkSession)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        found = [
            majority_bits(*shingle_hashes(*flat(part), settings.words), len(part)).view(np.int64)
            for part in slices(texts, PIECE_BYTES)
        ]
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))

    return documents.withColumn(to, prints(F.col(text)))


def _forest(nodes: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node with the least node it is connected to through the given links."""
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[one], least[other])
        before = least.copy()
        np.minimum.at(least, one, low)
        np.minimum.at(least, other, low)
        least = least[least]
        if (least == before).all():
            moved = np.flatnonzero(least != np.arange(len(nodes)))
            return nodes[moved], nodes[least[moved]]


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with at most ``radius`` differing bits; i < j if ``same`` (a and b are one tile)."""
    ones, others = [], []
    rows = max(1, (1 << 20) // max(1, len(b)))
    for start in range(0, len(a), rows):
        near = np.bitwise_count(a[start : start + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        ones.append(i)
        others.append(j)
    return np.concatenate(ones), np.concatenate(others)


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of the segments' bit counts that ``radius`` allows, one of each opposite two."""
    around = range(-radius, radius + 1)
    steps = (s for s in product(around, repeat=_SEGMENTS) if sum(map(abs, s)) <= radius)
    return [s for s in steps if s >= (0,) * _SEGMENTS]


def _bits(print_: Column, segment: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(print_, segment * _WIDTH).bitwiseAND((1 << _WIDTH) - 1))


def links(prints: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints connected by links of at most ``radius`` bits.

    ``prints`` holds distinct numbers ``fingerprint``. They are dealt into tiles by the bit counts of
    their four 16-bit segments. The differences of these counts add up to no more than the bits
    that differ, so tile pairs with a greater sum are never formed; all others are compared in
    full. A tile pair gives a spanning forest of its links, not all of them.
    """
    side, steps = _WIDTH + 1, _steps(settings.radius)
    counted = prints.select("fingerprint", *(_bits(F.col("fingerprint"), i).alias(f"c{i}") for i in range(_SEGMENTS)))
    counts = [f"c{i}" for i in range(_SEGMENTS)]
    # At most 17**4 rows, whatever the input.
    sizes = counted.groupBy(*counts).agg(F.ceil(F.count("*") / settings.tile).alias("parts"))
    tiles = materialise(
        counted.join(F.broadcast(sizes), counts)
        .withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts"))
        .groupBy(*counts, "part")
        .agg(F.collect_list("fingerprint").alias("prints")),
        "tiles",
    )
    shift = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(s))) for s in steps)))
    moved = tiles.select("part", "prints", *counts, shift.alias("step")).select(
        F.col("part").alias("part_a"),
        F.col("prints").alias("prints_a"),
        sum(((F.col(f"c{i}") + F.col(f"step.d{i}")) * side**i for i in range(_SEGMENTS)), F.lit(0)).alias("place"),
        F.forall(F.array(*(F.col(f"c{i}") + F.col(f"step.d{i}") for i in range(_SEGMENTS))), lambda x: x.between(0, _WIDTH)).alias("within"),
        F.expr(" and ".join(f"step.d{i} = 0" for i in range(_SEGMENTS))).alias("still"),
    )
    fixed = tiles.select("part", "prints", sum((F.col(f"c{i}") * side**i for i in range(_SEGMENTS)), F.lit(0)).alias("place"))
    pairs = moved.where("within").join(fixed, "place").where("not still or part_a <= part")
    radius = settings.radius

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for name in ("prints_a", "prints"):
                column = batch.column(name)
                edges = column.offsets.to_numpy()
                values = column.values.to_numpy().view(np.uint64)
                lists.append([values[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b, same in zip(*lists, batch.column("same").to_pylist()):
                i, j = near_pairs(a, b, radius, same)
                if len(i):
                    nodes, places = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
                    found.append(_forest(nodes.view(np.int64), places[: len(i)], places[len(i) :]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    return pairs.select("prints_a", "prints", F.expr("still and part_a = part").alias("same")).mapInArrow(compare, "a long, b long")


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``documents``.

    ``component_id`` is the smallest id reachable over links of at most ``settings.radius`` bits.
    Equal fingerprints are one node, so copies make no pairs. Rows without id get the component of
    their fingerprint, null if no row there has an id. Repeated rows stay repeated; no rows in, no rows out.
    """
    bounded_batches(documents.sparkSession)
    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialise(fingerprints(plain, settings=settings).select("doc_id", "fingerprint"), "fingerprints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = connected_components(links(nodes.select("fingerprint"), settings))
    linked = materialise(linked.withColumnRenamed("node", "fingerprint"), "linked")
    tops = linked.join(nodes, "fingerprint").groupBy("component").agg(F.min("first_id").alias("least_id"))
    found = linked.join(tops, "component").select("fingerprint", "least_id")
    named = nodes.join(found, "fingerprint", "left").select(
        "fingerprint", F.coalesce("least_id", "first_id").alias("component_id")
    )
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row of each group of ``groups``, with all its columns: that of the smallest id.

    A row without id stays only if no row of its group has one. Of rows with the same id, and of
    rows without id, one is taken. No rows in, no rows out.
    """
    bounded_batches(documents.sparkSession)
    rows = fingerprints(documents, text, "__print", settings).withColumn("__row", F.monotonically_increasing_id())
    rows = materialise(rows, "printed")  # the row numbers hold from here on
    nodes = rows.select(F.col("__print").alias("fingerprint")).distinct()
    linked = connected_components(links(materialise(nodes, "classes"), settings))
    best = (
        rows.select("__print", "__row", F.col(doc_id).alias("__id"))
        .groupBy("__print")
        .agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("first"))
        .join(linked, F.col("__print") == F.col("node"), "left")
        .groupBy(F.coalesce("component", "__print").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.__row").alias("__row"))
    )
    return rows.join(best, "__row", "left_semi").drop("__row", "__print")
