"""Nearest neighbours: a forest of random-projection trees, one queue over all trees, exact reranking.

Every row is put into one leaf of each tree: (tree, leaf, row) entries, as deep as the number of rows asks
for. A search goes to the leaves that most likely hold a near row, in the order of one queue over
all trees; entries and visits are joined by leaf, and the rows found are compared exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.text import bounded_batches
from cairnspark.sources.tables import materialise


@dataclass(frozen=True)
class Settings:
    k: int = 5
    trees: int = 128
    #: Rows that the split points are fitted on, at most; a node with fewer of them than ``node_rows`` lends its own
    #: rows to all levels below it.
    sample_rows: int = 8192
    node_rows: int = 64
    #: Rows of a leaf, about: the depth follows the number of all rows.
    leaf_rows: int = 6
    #: Searches go so far that this share of the nearest rows of ``probes`` rows of the sample would be found.
    recall: float = 0.95
    probes: int = 192
    #: Rows that are compared in one place.
    block_rows: int = 4096
    seed: int = 1


@dataclass(frozen=True)
class Forest:
    """Complete binary trees. All nodes of a level of a tree share a direction; each has its own split point.

    Node n of a tree has the children 2 n and 2 n + 1, the root is 1. Below level ``fitted`` a node has the split points that
    its ancestor at that level has for the lower levels.
    """

    directions: np.ndarray  #: trees x depth x dimensions
    splits: np.ndarray  #: trees x 2**fitted
    lower: np.ndarray  #: trees x (depth - fitted) x 2**fitted
    slope: float = 1.0  #: a near row lies on the same side of a split with the chance Phi(slope * distance to it)
    wanted: float = -3.0  #: a search ends when the logarithm of the chance to have missed a near row is below

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    @property
    def fitted(self) -> int:
        return self.depth - self.lower.shape[1]

    def _split(self, t: int, node: np.ndarray, level: int) -> np.ndarray:
        if level < self.fitted:
            return self.splits[t][node]
        return self.lower[t, level - self.fitted][(node >> (level - self.fitted)) - (1 << self.fitted)]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        trees, depth, _ = self.directions.shape
        out = np.empty((len(vectors), trees), np.int64)
        for t in range(trees):
            shadow = vectors @ self.directions[t].T
            node = np.ones(len(vectors), np.int64)
            for level in range(depth):
                node = 2 * node + (shadow[:, level] >= self._split(t, node, level))
            out[:, t] = node - (1 << depth)
        return out

    def search(self, vector: np.ndarray, wanted: float | None = None) -> Iterator[tuple[int, int, float]]:
        """The (tree, leaf) to look at, most likely first by one queue over all trees, and the logarithm of the chance
        to have missed a near row before it, trees taken as independent.

        The cost of a leaf is minus the logarithm of the chance that a near row lies in it: that of its side, at each
        split on the way. What lies behind a split is queued with the cost of the path that was taken, but for the other side there.
        """
        trees, depth, _ = self.directions.shape
        shadow = (self.directions @ vector).tolist()
        phi, slope, fitted = _LOG_PHI, self.slope, self.fitted
        base = 1 << fitted

        def descend(t: int, node: int, level: int) -> tuple[int, list[tuple[float, float, int]]]:
            line, own, lower, steps = shadow[t], self.splits[t], self.lower[t], []
            while level < depth:
                split = own[node] if level < fitted else lower[level - fitted, (node >> (level - fitted)) - base]
                margin = line[level] - split
                at = min(_PHI_SIZE, int(abs(margin) * slope * _PHI_STEP))
                near = 2 * node + (margin >= 0)
                steps.append((phi[_PHI_SIZE + at], phi[_PHI_SIZE - at], near ^ 1))
                node, level = near, level + 1
            return node - (1 << depth), steps

        queue = []
        for t in range(trees):
            _, steps = descend(t, 1, 0)
            queue.append((sum(s[0] for s in steps), t, 1, 0, 0.0))
        heapq.heapify(queue)
        chance, missed = [0.0] * trees, 0.0
        wanted = self.wanted if wanted is None else wanted
        while queue and missed > wanted:
            _, t, node, level, spent = heapq.heappop(queue)
            leaf, steps = descend(t, node, level)
            total = spent + sum(s[0] for s in steps)
            for i, (near, far, other) in enumerate(steps):
                heapq.heappush(queue, (total - near + far, t, other, level + i + 1, spent + far))
                spent += near
            yield t, leaf, missed
            missed -= math.log(max(1e-12, 1 - chance[t]))
            chance[t] += math.exp(-total)
            missed += math.log(max(1e-12, 1 - chance[t]))


#: Visits of a query whose finds are put together, and rows of a part of a leaf, at most.
_VISITS, _LEAF_PART = 1 << 14, 1 << 12

#: -log Phi(x) for x from -8 to 8.
_PHI_STEP, _PHI_SIZE = 64, 512
_LOG_PHI = [-math.log(max(1e-300, NormalDist().cdf(i / _PHI_STEP))) for i in range(-_PHI_SIZE, _PHI_SIZE + 1)]


def fit_search(forest: Forest, probes: np.ndarray, near: list[np.ndarray], recall: float, most: int = 4000) -> Forest:
    """The forest with ``slope`` and ``wanted`` fitted to some rows and the rows nearest to each, nearest first."""
    pairs = [(v, w) for v, w in zip(probes, near) if len(w)]
    if not pairs or not forest.depth:
        return forest
    # The slope at which near rows lie on the same side of a split as often as they do.
    some, other = np.array([v for v, _ in pairs]), np.array([w[-1] for _, w in pairs])
    margins, same = [], []
    for t in range(min(32, len(forest.directions))):
        a, b = some @ forest.directions[t].T, other @ forest.directions[t].T
        node = np.ones(len(some), np.int64)
        for level in range(forest.depth):
            split = forest._split(t, node, level)
            margins.append(np.abs(a[:, level] - split))
            same.append((a[:, level] >= split) == (b[:, level] >= split))
            node = 2 * node + (a[:, level] >= split)
    margin, share = np.concatenate(margins), min(float(np.mean(np.concatenate(same))), 0.999)
    table = np.exp(-np.array(_LOG_PHI))
    low, high = 1e-3, 1e6
    for _ in range(60):  # the mean chance grows with the slope
        middle = math.sqrt(low * high)
        at = np.minimum(_PHI_SIZE, margin * middle * _PHI_STEP).astype(np.int64)
        low, high = (middle, high) if table[_PHI_SIZE + at].mean() < share else (low, middle)
    forest = replace(forest, slope=high)
    # How far searches must go to find the share of near rows in their leaves.
    needed: list[float] = []
    for vector, others in pairs:
        places: dict[tuple[int, int], list[int]] = {}
        for j, leaves in enumerate(forest.leaves(others).tolist()):
            for t, leaf in enumerate(leaves):
                places.setdefault((t, leaf), []).append(j)
        left = set(range(len(others)))
        for n, (t, leaf, missed) in enumerate(forest.search(vector, -math.inf)):
            for j in places.get((t, leaf), ()):
                if j in left:
                    left.remove(j)
                    needed.append(missed)
            if not left or n == most:
                break
        needed += [-100.0] * len(left)
    # The chance before the leaf was visited: it must still be above the limit.
    return replace(forest, wanted=float(np.quantile(needed, 1 - recall, method="lower")) - 1e-9)


def plant(sample: np.ndarray, settings: Settings, n_rows: int | None = None) -> Forest:
    """Random unit directions, and split points at the medians of the sampled vectors (of length 1)."""
    rng = np.random.default_rng(settings.seed)
    n_rows = len(sample) if n_rows is None else n_rows
    depth = min(30, max(0, round(math.log2(max(1, n_rows / settings.leaf_rows)))))
    fitted = min(depth, max(0, int(math.log2(max(1, len(sample) / settings.node_rows)))))
    directions = rng.standard_normal((settings.trees, depth, sample.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-300)
    splits = np.zeros((settings.trees, 1 << fitted))
    lower = np.zeros((settings.trees, depth - fitted, 1 << fitted))
    for t in range(settings.trees):
        shadow = sample @ directions[t].T
        node = np.ones(len(sample), np.int64)
        for level in range(fitted + 1):
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
            for n, a, b in zip(range(1 << level, 2 << level), cuts, cuts[1:]):
                if a == b:
                    continue
                if level < fitted:
                    splits[t, n] = np.median(shadow[order[a:b], level])
                else:
                    lower[t, :, n - (1 << fitted)] = np.median(shadow[order[a:b], fitted:], axis=0)
            if level < fitted:
                node = 2 * node + (shadow[:, level] >= splits[t][node])
    return Forest(directions, splits, lower)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64) if len(column) else np.zeros((0, size))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, each once, and the number of components.

    Rows without id, and vectors that are null, zero, hold a null or non-finite component, or have
    another length than most (the longer, if equally many) take no part.
    """
    plain = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    good = plain.where("vec_id is not null and embedding is not null").where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    size = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    n = size["n"] if size else 0
    return good.where(F.size("embedding") == n).distinct(), n


def _nearest_to(rows: DataFrame, probes: np.ndarray, size: int, k: int) -> list[np.ndarray]:
    """The k rows of greatest cosine to each of a few vectors, itself left out: all rows are compared."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros((0, size)))] * len(shared.value)
        for batch in batches:
            unit = _unit(_matrix(batch.column("embedding"), size))
            close = unit @ shared.value.T
            for i, (scores, vectors) in enumerate(held):
                least = scores[-1] if len(scores) == k else -2.0
                at = np.flatnonzero((close[:, i] > least) & (close[:, i] < 1 - 1e-12))
                if len(at):
                    scores, vectors = np.append(scores, close[at, i]), np.vstack([vectors, unit[at]])
                    top = np.argsort(-scores, kind="stable")[:k]
                    held[i] = scores[top], vectors[top]
        for i, (scores, vectors) in enumerate(held):
            yield pa.record_batch(
                {
                    "probe": pa.array(np.full(len(scores), i, np.int32)),
                    "score": pa.array(scores),
                    "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())),
                }
            )

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vector")
    found = rows.select("embedding").mapInArrow(best, "probe int, score double, vector array<double>")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).orderBy("probe", "rank").collect()
    return [np.array([r["vector"] for r in top if r["probe"] == i]).reshape(-1, size) for i in range(len(probes))]


def nearest(
    vectors: DataFrame,
    settings: Settings = Settings(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    is_query: str = "vec_id % 50 = 0",
    counted: str | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of greatest cosine found for each query, best first.

    Queries are the rows for which ``is_query`` holds; candidates are all rows of another id. The
    forest is fitted on at most ``sample_rows`` rows, chosen by the hash of the id; how far searches go, on the exact
    nearest rows, among all, of ``probes`` of them. All rows are put into its leaves. The rows in the leaves that a query visits are compared in double precision.
    Equal scores go by the smaller id. For rows that take no part see ``usable``; fewer than ``k``
    candidates give fewer rows. An id that occurs with several vectors is a query, and a
    candidate, with each of them: it then has a list for each. ``counted`` names a further column:
    how many rows were compared for the query.

    Of equal vectors only the ``k`` + 1 of smallest id can be among anyone's ``k`` nearest; the
    others are left out before the rows are dealt out, so a very common vector costs nothing. A leaf
    that holds very many rows is kept and visited in parts.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, size = usable(vectors, vec_id, embedding)
    rows = materialise(rows.withColumn("row", F.xxhash64("vec_id", "embedding")), "usable-vectors")
    n_rows = rows.count()
    same = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= settings.k + 1).drop("nth")
    indexed = materialise(indexed, "indexed-vectors")
    queries = rows.where(is_query)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(settings.sample_rows).toArrow()
    fitted_on = _unit(_matrix(sample["embedding"].combine_chunks(), size)) if size else np.zeros((0, 1))
    forest = plant(fitted_on, settings, n_rows)
    probes = fitted_on[: settings.probes]
    forest = fit_search(forest, probes, _nearest_to(indexed, probes, size, settings.k) if size else [], settings.recall)
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample and the depth

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                leaves = shared.value.leaves(_unit(_matrix(batch.column("embedding"), size)))
                trees = leaves.shape[1]
                slots = (leaves + (np.arange(trees, dtype=np.int64) << shared.value.depth)).ravel()
                owners = np.repeat(batch.column("row").to_numpy(), trees)
                yield pa.record_batch({"slot": pa.array(slots), "row": pa.array(owners)})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, vector in zip(batch.column("row").to_numpy(), _unit(_matrix(batch.column("embedding"), size))):
                slots = np.array([leaf + (t << shared.value.depth) for t, leaf, _ in shared.value.search(vector)], np.int64)
                pieces = np.arange(len(slots)) // _VISITS
                yield pa.record_batch(
                    {"slot": pa.array(slots), "query": pa.array(np.full(len(slots), query)), "piece": pa.array(pieces)}
                )

    n_blocks = -(-n_rows // settings.block_rows) or 1

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, lists in zip(batch.column("query").to_pylist(), batch.column("lists")):
                found = np.unique(lists.values.flatten().to_numpy())
                block = found % n_blocks
                order = np.argsort(block, kind="stable")
                used, starts = np.unique(block[order], return_index=True)
                parts = np.split(found[order], starts[1:])
                yield pa.record_batch(
                    {
                        "block": pa.array(used.astype(np.int32)),
                        "query": pa.array(np.full(len(used), query)),
                        "rows": pa.array([x.tolist() for x in parts], pa.list_(pa.int64())),
                    }
                )

    entries = indexed.select("row", "embedding").mapInArrow(put, "slot long, row long")
    visits = (
        queries.select("row", "embedding")
        .repartition(4 * spark.sparkContext.defaultParallelism, "row")
        .mapInArrow(visit, "slot long, query long, piece long")
    )
    # A leaf with very many rows, of vectors that no split tells apart, is kept in several parts.
    heavy = entries.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _LEAF_PART)
    heavy = materialise(heavy.select("slot", F.ceil(F.col("n") / _LEAF_PART).cast("int").alias("parts")), "full-leaves")
    parts = F.coalesce("parts", F.lit(1))
    leaves = (
        entries.join(heavy, "slot", "left")
        .groupBy("slot", F.pmod("row", parts).cast("int").alias("part"))
        .agg(F.collect_list("row").alias("leaf"))
    )
    asked_leaves = visits.join(heavy, "slot", "left").select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    block = F.pmod("row", F.lit(n_blocks)).cast("int").alias("block")
    # Of a query, only what it has found in a block goes there, with its vector once. Spark takes the visits for no more
    # than the queries that they are made of, thousands to one; without the hint it sends them all through the driver.
    found = (
        asked_leaves.join(leaves.hint("merge"), ["slot", "part"])
        .groupBy("query", "piece")
        .agg(F.collect_list("leaf").alias("lists"))
        .mapInArrow(by_block, "block int, query long, rows array<long>")
    )
    asked = found.join(
        queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query"
    )
    k = settings.k

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compare(left.combine_chunks(), right.combine_chunks(), size, k)

    near = (
        indexed.select("row", "vec_id", "embedding", block)
        .groupBy("block")
        .cogroup(asked.groupBy("block"))
        .applyInArrow(compare, "query long, query_id long, row long, vec_id long, score double, n_compared long")
        .dropDuplicates(["query", "row"])  # a row may be found by several pieces of the visits
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # Within a block the first row of a query tells how many were compared.
    ranked = near.withColumns({"rank": F.row_number().over(best), "all": F.sum("n_compared").over(Window.partitionBy("query"))})
    extra = [F.col("all").alias(counted)] if counted else []
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *extra)


def _compare(rows: pa.Table, queries: pa.Table, size: int, k: int) -> pa.Table:
    """The k best of the rows found for each query in this block, and on the first of them how many were compared."""
    out: dict[str, list] = {name: [] for name in ("query", "query_id", "row", "vec_id", "score", "n_compared")}
    if rows.num_rows and queries.num_rows:
        numbers, ids = rows["row"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.argsort(numbers, kind="stable")
        vectors = _matrix(rows["embedding"].combine_chunks(), size)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / norms[:, None]
        for query, query_id, vector, found in zip(*(queries[c].to_pylist() for c in ("query", "query_id", "vector", "rows"))):
            at = order[np.searchsorted(numbers[order], np.array(found, np.int64))]
            at = at[ids[at] != query_id]
            if not len(at):
                continue
            n_compared = len(at)
            q = np.array(vector)
            norm = np.sqrt((q * q).sum())
            rough = unit[at] @ (q / norm)
            if len(at) > k:
                at = at[rough >= np.partition(rough, -k)[-k] - 1e-9]
            # Summed row by row in a fixed order, so equal vectors have equal scores.
            score = (vectors[at] * q).sum(axis=1) / (norms[at] * norm)
            top = np.lexsort((ids[at], -score))[:k]
            for name, values in (
                ("query", [query] * len(top)),
                ("query_id", [query_id] * len(top)),
                ("row", numbers[at][top].tolist()),
                ("vec_id", ids[at][top].tolist()),
                ("score", score[top].tolist()),
                ("n_compared", [n_compared] + [0] * (len(top) - 1)),
            ):
                out[name] += values
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})
