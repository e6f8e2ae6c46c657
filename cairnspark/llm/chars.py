"""Character n-grams of the distinct words of a piece of text, as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cairnspark.llm.text import lowered, run_hashes, tokens


@dataclass(frozen=True)
class Words:
    """The distinct words of a piece, each with a blank on either side, and where they occur."""

    data: np.ndarray  #: bytes of all distinct words
    bounds: np.ndarray  #: of each distinct word in ``data``
    rows: np.ndarray  #: row of each occurrence, in text order
    word: np.ndarray  #: distinct word of each occurrence
    codes: np.ndarray  #: sorted hashes of the distinct words

    def __len__(self) -> int:
        return len(self.bounds) - 1


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), then the same for the next ones."""
    total = int(count.sum())
    skip = np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + np.arange(total) - skip


def distinct_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Lower-cased runs of letters, digits and non-ASCII bytes."""
    data = lowered(data)
    starts, ends, rows = tokens(data, bounds, marks=False)
    codes, first, word = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = (ends - starts)[first]
    edges = np.append(0, np.cumsum(sizes + 2))
    framed = np.full(edges[-1], ord(" "), np.uint8)
    framed[expand(edges[:-1] + 1, sizes)] = data[expand(starts[first], sizes)]
    return Words(framed, edges, rows, word, codes)


def chosen_words(words: Words, which: np.ndarray) -> Words:
    """Some of the distinct words, without their occurrences."""
    sizes = np.diff(words.bounds)[which]
    data = words.data[expand(words.bounds[:-1][which], sizes)]
    none = np.zeros(0, np.int64)
    return Words(data, np.append(0, np.cumsum(sizes)), none, none, words.codes[which])


def char_starts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of ``words.data`` starts (and the end of the data), and its word."""
    starts = np.flatnonzero((words.data & 0xC0) != 0x80)
    return np.append(starts, len(words.data)), np.searchsorted(words.bounds, starts, side="right") - 1


def char_ngrams(words: Words, orders: range) -> tuple[np.ndarray, np.ndarray]:
    """Word and 64-bit hash of each run of ``orders`` characters within a word and its blanks, by word."""
    starts, word = char_starts(words)
    found_words, found = [], []
    for n in orders:
        if len(word) < n:
            continue
        at = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
        found_words.append(word[at])
        found.append(run_hashes(words.data, starts[at], starts[at + n]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, codes = np.concatenate(found_words), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], codes[order]
