"""Grouping spelling variants: a trie of letter-group counts finds the words within one edit of each word.

A word's vector counts the letters of each group. One inserted, deleted or replaced letter changes it
by at most one surplus and one deficit. The trie arranges the vectors by one count after the other; a
search walks down from the root, spends its surplus and its deficit at most once each, and the words
of the leaves it reaches are verified.

The upper part of the trie divides the vocabulary into subtrees of bounded size, found from a sample.
Each word goes to the subtree it lies in and, as a query, to those its search enters. So that a pair is
met once, a search spends its surplus before its deficit: the partner is the word with more letters
of the first group in which both differ.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.text import bounded_batches, mix, pieces
from cairnspark.sources.tables import materialise


@dataclass(frozen=True)
class Settings:
    least_length: int = 7
    least_count: int = 2
    ratio: int = 10  #: a form occurs so many times as often at least
    thin: int = 31  #: runs whose hash is a multiple of it lose a letter
    subtree: int = 32_000  #: words of a subtree, about
    most_subtrees: int = 10_000  #: beyond this number, subtrees grow instead
    sample: int = 500_000  #: words that the subtrees are found from; balance alone depends on them


#: Letters by falling frequency; the groups take them in turn. Other letters go by code point.
_LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
GROUPS = 16
_GROUP = np.arange(256) % GROUPS
for _i, _c in enumerate(_LETTERS):
    _GROUP[ord(_c)] = _i % GROUPS

_LEAF = 1 << 62


def _runs(least: int) -> re.Pattern[str]:
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def word_counts(text: str | None, doc_id: int | None, settings: Settings, runs: re.Pattern[str]) -> Counter[str]:
    """The words of one text, thinned, with at least ``least_length`` code points; a null id is hashed as ''."""
    found = Counter(runs.findall((text or "").encode().lower().decode()))  # bytes.lower() changes A-Z alone
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    thinned: Counter[str] = Counter()
    for run in list(found):
        code = zlib.crc32(run.encode(), start)
        if code % settings.thin == 0:
            word, n = run[: code % len(run)] + run[code % len(run) + 1 :], found.pop(run)
            if len(word) >= settings.least_length:
                thinned[word] += n
    return found + thinned


def vocabulary(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n): the words of all texts that occur at least ``least_count`` times."""
    bounded_batches(documents.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(settings.least_length)
        held: Counter[str] = Counter()

        def batch_of(part: Counter[str]) -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(part), pa.string()), "n": pa.array(list(part.values()), pa.int64())})

        for batch in pieces(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.update(word_counts(text, doc_id, settings, runs))
            if len(held) > 100_000:
                yield batch_of(held)
                held.clear()
        yield batch_of(held)

    words = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least_count)


class Words:
    """Words, all of them Latin-1, as flat bytes with bounds."""

    def __init__(self, words: list[str]):
        data = [w.encode("latin-1") for w in words]
        self.sizes = np.fromiter(map(len, data), np.int64, len(data))
        self.bounds = np.append(0, np.cumsum(self.sizes))
        self.data = np.frombuffer(b"".join(data), np.uint8)
        rows = np.repeat(np.arange(len(data)), self.sizes)
        counts = np.bincount(rows * GROUPS + _GROUP[self.data], minlength=len(data) * GROUPS)
        # Capped counts of two words differ by one at most where the counts do, so no word is lost.
        self.vectors = np.minimum(counts, 255).astype(np.uint8).reshape(len(data), GROUPS)

    def ends(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last ``size`` letters of each word as a number."""
        first = last = np.zeros(len(self.sizes), np.int64)
        for i in range(size):
            inside = i < self.sizes
            first = first << 8 | np.where(inside, self.data[np.minimum(self.bounds[:-1] + i, len(self.data) - 1)], 0)
            last = last << 8 | np.where(inside, self.data[np.maximum(self.bounds[1:] - 1 - i, 0)], 0)
        return first, last

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b differ by one edit: what they share at both ends is all but one letter."""
        short, long = np.where(self.sizes[a] <= self.sizes[b], a, b), np.where(self.sizes[a] <= self.sizes[b], b, a)
        size, other = self.sizes[short], self.sizes[long]
        shared = np.zeros(len(a), np.int64)
        for step in (1, -1):
            left = self.bounds[short] if step == 1 else self.bounds[short + 1] - 1
            right = self.bounds[long] if step == 1 else self.bounds[long + 1] - 1
            active, same = np.arange(len(a)), np.zeros(len(a), np.int64)
            for i in range(int(size.max()) if len(a) else 0):
                active = active[size[active] > i]
                active = active[self.data[left[active] + step * i] == self.data[right[active] + step * i]]
                if not len(active):
                    break
                same[active] += 1
            shared += same
        return (other - size <= 1) & (shared >= other - 1) & ((size != other) | (shared < other))


class Trie:
    """Sorted distinct vectors as a trie; level by level, the children of a node by their count."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.leaf_of = np.unique(vectors, axis=0, return_inverse=True)
        self.leaf_of = self.leaf_of.reshape(-1)
        node = np.zeros(len(self.vectors), np.int64)
        self.keys: list[np.ndarray] = []  # of each level, node * 256 + count; the position is the child
        for level in range(GROUPS):
            keys, node = np.unique(node * 256 + self.vectors[:, level], return_inverse=True)
            self.keys.append(keys)

    def search(self, vectors: np.ndarray, held: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, equal) of the leaves in reach, depth first in blocks of at most ``held`` paths."""
        zeros = np.zeros(len(vectors), np.int64)
        waiting = [(0, np.arange(len(vectors)), zeros, zeros)]
        while waiting:
            level, query, node, spent = waiting.pop()
            if level == GROUPS:
                yield query, node, spent == 0
                continue
            if len(query) > held:
                half = len(query) // 2
                waiting += [(level, query[:half], node[:half], spent[:half]), (level, query[half:], node[half:], spent[half:])]
                continue
            found = []
            for step, before, after in ((0, None, None), (1, 0, 1), (-1, 1, 2)):
                on = slice(None) if before is None else spent == before
                q, at = query[on], node[on]
                count = vectors[q, level].astype(np.int64) + step
                key = at * 256 + count
                child = np.searchsorted(self.keys[level], key)
                there = (count >= 0) & (count < 256)
                there &= self.keys[level][np.minimum(child, len(self.keys[level]) - 1)] == key
                state = spent[on] if after is None else np.full(len(q), after)
                found.append((q[there], child[there], state[there]))
            waiting.append((level + 1, *map(np.concatenate, zip(*found))))


def near_words(
    words: list[str], home: np.ndarray, n: np.ndarray, least_length: int = 7, pairs: int = 1 << 21
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the number of near words, whether there is any, and the best of them (largest n, then smallest).

    Partners are looked for among the ``home`` words; a pair counts for both of its words.
    """
    table = Words(words)
    # An edit leaves the first three or the last three letters of a word of seven as they are.
    first, last = table.ends(max(0, min(3, (least_length - 1) // 2)))
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    alphabetic = np.empty(len(words), np.int64)
    alphabetic[order] = np.arange(len(words))
    by_rank = np.lexsort((alphabetic, -n))
    rank = np.empty(len(words), np.int64)
    rank[by_rank] = np.arange(len(words))

    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    at_home = np.flatnonzero(home)
    if not len(at_home):
        return near, near > 0, best
    trie = Trie(table.vectors[at_home])
    inside = np.argsort(trie.leaf_of, kind="stable")  # home words by leaf
    leaf_starts = np.append(0, np.cumsum(np.bincount(trie.leaf_of, minlength=len(trie.vectors))))
    # One search for all words of a vector.
    asked, asked_of = np.unique(table.vectors, axis=0, return_inverse=True)
    asked_of = asked_of.reshape(-1)
    askers = np.argsort(asked_of, kind="stable")
    asker_starts = np.append(0, np.cumsum(np.bincount(asked_of, minlength=len(asked))))
    for query, leaf, equal in trie.search(asked):
        wide, high = np.diff(asker_starts)[query], np.diff(leaf_starts)[leaf]
        size = wide * high
        ends = np.cumsum(size)
        start = 0
        while start < len(size):  # some leaves at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + pairs, side="right")))
            cut = slice(start, stop)
            row = np.repeat(np.arange(stop - start), size[cut])
            inner = np.arange(len(row)) - np.repeat(np.cumsum(size[cut]) - size[cut], size[cut])
            a = askers[asker_starts[query[cut]][row] + inner // high[cut][row]]
            b = at_home[inside[leaf_starts[leaf[cut]][row] + inner % high[cut][row]]]
            likely = ((first[a] == first[b]) | (last[a] == last[b])) & (~equal[cut][row] | (alphabetic[a] < alphabetic[b]))
            a, b = a[likely], b[likely]
            true = table.near(a, b)
            a, b = a[true], b[true]
            near += np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
            np.minimum.at(best, a, rank[b])
            np.minimum.at(best, b, rank[a])
            start = stop
    some = near > 0
    best[some] = by_rank[best[some]]
    return near, some, best


@dataclass(frozen=True)
class Upper:
    """The nodes of the trie's upper part: their children by (node, count), and the blocks of full leaves."""

    keys: np.ndarray  #: sorted; parent * 256 + count
    nodes: np.ndarray  #: the child of each key
    blocks: dict[int, int]  #: node at the last level: into how many blocks its words are divided

    def subtrees(self, vectors: np.ndarray, hashes: np.ndarray, visit: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, subtree): where each word lies or, if ``visit``, which subtrees its search enters."""
        rows, found = [], []
        query = np.arange(len(vectors))
        node, spent = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        for level in range(GROUPS):
            onward = []
            for step, before, after in ((0, None, None), (1, 0, 1), (-1, 1, 2))[: 3 if visit else 1]:
                on = slice(None) if before is None else spent == before
                q, at = query[on], node[on]
                count = vectors[q, level].astype(np.int64) + step
                there = (count >= 0) & (count < 256)
                q, at, count = q[there], at[there], count[there]
                state = spent[on][there] if after is None else np.full(len(q), after)
                key = at * 256 + count
                if len(self.keys):
                    place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    inner = self.keys[place] == key
                    onward.append((q[inner], self.nodes[place[inner]], state[inner]))
                else:
                    inner = np.zeros(len(q), bool)
                rows.append(q[~inner])
                found.append(key[~inner])
            if not onward:
                break
            query, node, spent = map(np.concatenate, zip(*onward))
        else:
            for q, at in zip(query.tolist(), node.tolist()):
                n = self.blocks[at]
                for block in range(n) if visit else [int(hashes[q] % np.uint64(n))]:
                    rows.append(np.array([q]))
                    found.append(np.array([_LEAF | at << 20 | block]))
        return np.concatenate(rows), np.concatenate(found)


def upper_part(words: DataFrame, settings: Settings) -> Upper:
    """The nodes below which, as a sample tells, more words lie than a subtree may hold."""
    n = words.count()
    limit = max(settings.subtree, n // settings.most_subtrees)
    if n <= limit:
        return Upper(np.zeros(0, np.int64), np.zeros(0, np.int64), {})
    stride = max(1, n // settings.sample)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = Words(batch.column("word").to_pylist()).vectors.tobytes()
            held = Counter(vectors[at : at + size] for at in range(0, len(vectors), GROUPS) for size in range(1, GROUPS + 1))
            yield pa.record_batch({"prefix": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    sampled = words.where(F.pmod(F.xxhash64("word"), F.lit(stride)) == 0).select("word")
    found = sampled.mapInArrow(prefixes, "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    # Disjoint subtrees on each of the levels: at most GROUPS * most_subtrees rows reach the driver.
    large = {bytes(r["prefix"]): r["n"] * stride for r in found.where(F.col("n") > limit // stride).collect()}
    number = {prefix: i + 1 for i, prefix in enumerate(sorted(large, key=lambda p: (len(p), p)))}
    number[b""] = 0
    keys = sorted((number[p[:-1]] * 256 + p[-1], i) for p, i in number.items() if p)
    blocks = {number[p]: math.ceil(large[p] / limit) for p in large if len(p) == GROUPS}
    return Upper(np.array([k for k, _ in keys], np.int64), np.array([i for _, i in keys], np.int64), blocks)


def _routed(words: DataFrame, upper: Upper) -> DataFrame:
    """(subtree, home, word, n): each word where it lies and where its search goes."""
    shared = words.sparkSession.sparkContext.broadcast(upper)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            vectors = Words(words).vectors
            hashes = mix(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)))
            home_row, home = shared.value.subtrees(vectors, hashes, visit=False)
            row, subtree = shared.value.subtrees(vectors, hashes, visit=True)
            lies = np.empty(len(words), np.int64)
            lies[home_row] = home
            # A search may enter a subtree on several ways; there it starts from the root again.
            order = np.lexsort((subtree, row))
            row, subtree = row[order], subtree[order]
            fresh = np.append(True, (row[1:] != row[:-1]) | (subtree[1:] != subtree[:-1]))[: len(row)]
            row, subtree = row[fresh], subtree[fresh]
            yield pa.record_batch(
                {
                    "subtree": pa.array(subtree),
                    "home": pa.array(lies[row] == subtree),
                    "word": batch.column("word").take(pa.array(row)),
                    "n": batch.column("n").take(pa.array(row)),
                }
            )

    return words.select("word", "n").mapInArrow(rows, "subtree long, home boolean, word string, n long")


def neighbours(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n_near, best): the number of near words and the most frequent of them, as (-n, word); words without any are left out.

    ``words`` is a stored table (word, n) of distinct words.
    """

    def searched(group: pa.Table) -> pa.Table:
        words = group.column("word").to_pylist()
        n = group.column("n").to_numpy()
        near, some, best = near_words(words, group.column("home").to_numpy(zero_copy_only=False), n, settings.least_length)
        rows = np.flatnonzero(some).tolist()
        return pa.table(
            {
                "word": pa.array([words[i] for i in rows], pa.string()),
                "n_near": pa.array(near[rows], pa.int64()),
                "best_n": pa.array(n[best[rows]], pa.int64()),
                "best_word": pa.array([words[i] for i in best[rows].tolist()], pa.string()),
            }
        )

    routed = _routed(words, upper_part(words, settings))
    found = routed.groupBy("subtree").applyInArrow(searched, "word string, n_near long, best_n long, best_word string")
    best = F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))


def variants(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents' texts.

    ``documents`` has (doc_id, text). Words are the runs of Latin letters, A-Z lower-cased and thinned
    by hash, with ``least_length`` letters and ``least_count`` occurrences. ``form`` is the most frequent
    near word (ties: the first in code-point order) if it occurs ``ratio`` times as often, else NULL;
    ``root`` is reached by following forms, and is the word itself without a form.

    A null or empty text has no word, a null id is hashed as an empty one, each row counts, also where
    ids or texts repeat. Other columns are ignored, whatever their names. Without words, the result is
    empty. The vocabulary is stored once, and so are the forms found for it.
    """
    words = materialise(vocabulary(documents, settings), "vocabulary")
    common = F.when(-F.col("best.less") >= settings.ratio * F.col("n"), F.col("best"))
    told = materialise(
        words.join(neighbours(words, settings), "word", "left").select(
            "word",
            common["word"].alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            (-common["less"]).alias("form_n"),
        ),
        "word-forms",
    )
    # A form is ten times as frequent as its word, so chains are short: one join for each step of the longest.
    # Words that share a form differ from it by one letter, so a form has few of them.
    links = told.where("form is not null").select("word", "form")
    roots = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("form"), F.col("root").alias("ahead"))
        further = links.join(ahead, "form", "left").select(
            "word", F.coalesce("ahead", "form").alias("root")
        )
        further = materialise(further.join(roots.withColumnRenamed("root", "was"), "word"), "word-roots")
        roots = further.select("word", "root")
        if not further.where("root <> was").limit(1).count():
            break
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
