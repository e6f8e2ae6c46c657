"""Language identification: one interpolated Kneser-Ney character model per language."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.chars import Words, char_starts, chosen_words, distinct_words
from cairnspark.llm.text import PIECE_BYTES, Known, bounded_batches, flat, pieces, run_hashes, slices, unique_counts

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    order: int = 4
    rows_per_language: int = 1000
    most_languages: int = 1000
    discount: float = 0.75
    #: Bits a character by which a text may lie above the worst calibration text of its language.
    slack: float = 0.5
    #: Characters of evidence that count for the score.
    evidence: int = 30


@dataclass(frozen=True)
class Models:
    """Sorted hash arrays shared by all languages, one column of numbers for each language."""

    languages: list[str]
    ngrams: list[np.ndarray]  #: of order 1, 2, ...: hashes of the seen n-grams
    direct: list[np.ndarray]  #: discounted share of the n-gram after its context
    contexts: list[np.ndarray]  #: hashes of the seen contexts
    backoff: list[np.ndarray]  #: weight of the next lower order after the context
    floor: float  #: probability of a character that no model knows
    limits: np.ndarray  #: highest accepted cross-entropy, bits a character


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], default)


def _grams(words: Words, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: positions in the list of characters, hashes of n-gram, context and suffix.

    Every character but the first blank of a word is predicted, from at most ``order`` - 1
    characters of the word before it.
    """
    starts, word = char_starts(words)
    for n in range(1, order + 1):
        last = np.arange(max(1, n - 1), len(word))
        last = last[(word[last - (n - 1)] == word[last]) & (word[last - 1] == word[last])]
        first = last - (n - 1)
        yield (
            n,
            last,
            run_hashes(words.data, starts[first], starts[last + 1]),
            run_hashes(words.data, starts[first], starts[last]),
            run_hashes(words.data, starts[np.minimum(first + 1, last)], starts[last + 1]),
        )


def word_bits(words: Words, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each distinct word under each language, and its number of predicted characters."""
    starts, word = char_starts(words)
    p = np.full((len(word), len(models.languages)), models.floor)
    for n, last, grams, contexts, _ in _grams(words, len(models.ngrams)):
        direct = _look_up(models.ngrams[n - 1], models.direct[n - 1], grams, 0.0)
        back = _look_up(models.contexts[n - 1], models.backoff[n - 1], contexts, 1.0)
        p[last] = direct + back * p[last]
    predicted = np.flatnonzero(np.append(False, word[1:] == word[:-1])) if len(word) else np.zeros(0, np.int64)
    bits = np.zeros((len(words), p.shape[1]))
    for column in range(p.shape[1]):
        bits[:, column] = np.bincount(word[predicted], -np.log2(p[predicted, column]), len(words))[: len(words)]
    return bits, np.bincount(word[predicted], minlength=len(words))[: len(words)]


class Remembered:
    """The bits of the words that were met last, up to ``keep`` of them, by their hash."""

    def __init__(self, models: Models, keep: int | None = None):
        self.models = models
        self.keep = keep or max(1000, (32 << 20) // (8 * len(models.languages) + 40))
        self.clear()

    def clear(self) -> None:
        self.known = Known(np.zeros(0, np.uint64), self.keep)
        self.bits, self.size = np.zeros((self.keep, len(self.models.languages))), np.zeros(self.keep, np.int64)

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        at = self.known.find(words.codes)
        if self.known.n + int((at < 0).sum()) > self.keep:
            self.clear()
            at = np.full(len(words), -1)
        new = np.flatnonzero(at < 0)
        if not len(new) or len(new) > self.keep:
            return word_bits(words, self.models) if len(new) else (self.bits[at], self.size[at])
        bits, size = word_bits(chosen_words(words, new), self.models)
        numbers = np.arange(self.known.n, self.known.n + len(new))
        self.known.add(words.codes[new])
        self.bits[numbers], self.size[numbers], at[new] = bits, size, numbers
        return self.bits[at], self.size[at]


_held: dict[str, Remembered] = {}


def _remembered(key: str, models: Models) -> Remembered:
    """What this Python worker remembers of the words of one call of ``identify``, the last one."""
    if key not in _held:
        _held.clear()
        _held[key] = Remembered(models)
    return _held[key]


def cross_entropies(column: pa.Array, models: Models, remembered: Remembered | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bits a character of each row under each language (0 without characters), and the characters."""
    words = distinct_words(*flat(column))
    bits, size = remembered(words) if remembered else word_bits(words, models)
    n = len(column)
    chars = np.bincount(words.rows, size[words.word], n)[:n]
    sums = [np.bincount(words.rows, bits[words.word, j], n)[:n] for j in range(bits.shape[1])]
    return np.stack(sums, axis=1) / np.maximum(chars, 1)[:, None], chars


def _tables(counts: list[np.ndarray], discount: float) -> tuple[list, list, list, list]:
    """Per order: n-grams, discounted shares, contexts, back-off weights of one language.

    ``counts`` holds per order a structured array (gram, context, suffix, first, count); ``first``
    marks n-grams at the start of a word. Below the highest order an n-gram counts once for each
    distinct character before it; one at the start of a word, which has none, keeps its count.
    """
    tables: tuple[list, list, list, list] = ([], [], [], [])
    for n, rows in enumerate(counts, start=1):
        count = rows["count"].astype(float)
        if n < len(counts):
            before, kinds = np.unique(counts[n]["suffix"], return_counts=True)
            at = np.minimum(np.searchsorted(before, rows["gram"]), max(0, len(before) - 1))
            found = len(before) > 0 and before[at] == rows["gram"]
            count = np.where(rows["first"] | ~found if len(before) else True, count, kinds[at] if len(before) else 0)
        contexts, where = np.unique(rows["context"], return_inverse=True)
        total = np.bincount(where, count, len(contexts))
        kinds = np.bincount(where, minlength=len(contexts))
        for table, values in zip(
            tables,
            (rows["gram"], np.maximum(count - discount, 0) / total[where], contexts, discount * kinds / total),
        ):
            table.append(values)
    return tables


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], default: float) -> tuple[np.ndarray, np.ndarray]:
    """One sorted key array for all languages, and a column of values for each."""
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), default, np.float32)
    for j, (own, numbers) in enumerate(parts):
        values[np.searchsorted(keys, own), j] = numbers
    return keys, values


_ROW = np.dtype(
    [("gram", np.uint64), ("context", np.uint64), ("suffix", np.uint64), ("first", bool), ("count", np.int64)]
)


def _learn(counts: dict[tuple[str, int], np.ndarray], settings: Settings) -> Models:
    languages = sorted({language for language, _ in counts})
    empty = np.zeros(0, _ROW)
    by_language = []
    for language in languages:
        rows = [np.sort(counts.get((language, n), empty), order="gram") for n in range(1, settings.order + 1)]
        by_language.append(_tables(rows, settings.discount))
    merged = [
        (*_merged([(t[0][n], t[1][n]) for t in by_language], 0), *_merged([(t[2][n], t[3][n]) for t in by_language], 1))
        for n in range(settings.order)
    ]
    alphabet = len(merged[0][0]) + 1
    return Models(languages, *(list(x) for x in zip(*merged)), 1 / alphabet, np.full(len(languages), np.inf))


def sample_limits(places: DataFrame, wanted: int, most_languages: int) -> dict[str, int]:
    """The ``wanted``-th smallest place of each language, or its last place where there are fewer distinct ones.

    Places are hashes, so how many rows a language has tells about where that place is. Only rows
    up to there, and a few more, are looked at, and each task keeps distinct places: no language
    comes to one task as a whole. Should there be too few, as ids repeat, the range is widened.
    """
    sizes = {r["lang"]: r["count"] for r in places.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    found: dict[str, int] = {}
    widen = 1.0
    while len(found) < len(sizes):
        shares = {x: min(1.0, widen * (wanted + 6 * wanted**0.5 + 20) / n) for x, n in sizes.items() if x not in found}
        bounds = [(x, (1 << 63) - 1 if share == 1 else int(share * 2.0**64) - (1 << 63)) for x, share in sorted(shares.items())]
        near = places.join(F.broadcast(places.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang")
        least = F.array_sort(F.collect_set("place"))
        for r in (
            near.where("place <= bound")
            .groupBy("lang")
            .agg(least.alias("places"))
            .select("lang", F.size("places").alias("n"), F.get("places", F.least(F.size("places"), F.lit(wanted)) - 1).alias("last"))
            .collect()
        ):
            if r["n"] >= wanted or shares[r["lang"]] == 1:
                found[r["lang"]] = r["last"]
        widen *= 8
    return found


def fit(documents: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Models:
    """Learn from at most ``settings.rows_per_language`` rows of each language, chosen by the hash of their id.

    Rows without id or language take no part; a null text is an empty one; rows of one id and language count once. Four of five sampled rows
    are counted, the fifth sets the limit of rejection. Raises ValueError if no row has a language,
    or if there are more than ``settings.most_languages``.
    """
    rows = (
        documents.select(F.xxhash64(doc_id).alias("place"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
        .where("doc_id is not null and lang is not null")
        .drop("doc_id")
    )
    limits = sample_limits(rows.select("lang", "place"), settings.rows_per_language, settings.most_languages)
    limits = documents.sparkSession.createDataFrame(sorted(limits.items()), "lang string, last long")
    # At most ``most_languages`` limits. Rows of one id count once, with the first of their texts.
    sample = rows.join(F.broadcast(limits), "lang").where("place <= last").groupBy("lang", "place").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            tongues = np.array(batch.column("lang").to_pylist(), object)
            for language in sorted(set(tongues)):
                words = distinct_words(*flat(batch.column("text").filter(pa.array(tongues == language))))
                often = np.bincount(words.word, minlength=len(words))
                starts, word = char_starts(words)
                for n, last, grams, contexts, suffixes in _grams(words, settings.order):
                    keys, at, which = np.unique(grams, return_index=True, return_inverse=True)
                    head = starts[last - (n - 1)] == words.bounds[:-1][word[last]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([language] * len(keys), pa.string()),
                            pa.array(np.full(len(keys), n, np.int32)),
                            *(pa.array(x.view(np.int64)) for x in (keys, contexts[at], suffixes[at])),
                            pa.array(head[at]),
                            pa.array(np.bincount(which, often[word[last]], len(keys)).astype(np.int64)),
                        ],
                        names=["lang", "n", "gram", "context", "suffix", "first", "count"],
                    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[str, int], list[np.ndarray]] = {}
        for batch in batches:
            table = np.zeros(batch.num_rows, _ROW)
            for name in ("gram", "context", "suffix", "count"):
                table[name] = batch.column(name).to_numpy().view(_ROW[name])
            table["first"] = batch.column("first").to_numpy(zero_copy_only=False)
            owner = np.array([f"{n} {tongue}" for tongue, n in zip(batch.column("lang").to_pylist(), batch.column("n").to_pylist())])
            for key in np.unique(owner):
                n, _, tongue = str(key).partition(" ")
                parts.setdefault((tongue, int(n)), []).append(table[owner == key])
        if parts:
            models = _learn({k: np.concatenate(v) for k, v in parts.items()}, settings)
            yield pa.RecordBatch.from_arrays([pa.array([_stored(models)], pa.binary())], names=["models"])

    counted = (
        sample.where("pmod(place, 5) <> 0")
        .select("lang", "text")
        .mapInArrow(count, "lang string, n int, gram long, context long, suffix long, first boolean, count long")
        .groupBy("lang", "n", "gram")
        .agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.max("first").alias("first"), F.sum("count").alias("count"))
    )
    found = counted.repartition(1).mapInArrow(learn, "models binary").head()
    if found is None:
        raise ValueError("no row to learn a language from")
    models = _loaded(bytes(found["models"]))
    return _calibrated(sample.where("pmod(place, 5) = 0").select("lang", "text"), models, settings)


def _stored(models: Models) -> bytes:
    arrays = {"languages": np.array(models.languages), "floor": np.array(models.floor), "limits": models.limits}
    for name in ("ngrams", "direct", "contexts", "backoff"):
        arrays |= {f"{name}{n}": x for n, x in enumerate(getattr(models, name))}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(stored: bytes) -> Models:
    with np.load(io.BytesIO(stored)) as held:
        orders = sum(name.startswith("ngrams") for name in held.files)
        lists = ([held[f"{name}{n}"] for n in range(orders)] for name in ("ngrams", "direct", "contexts", "backoff"))
        return Models([str(x) for x in held["languages"]], *lists, float(held["floor"]), held["limits"])


def _calibrated(rows: DataFrame, models: Models, settings: Settings) -> Models:
    """Set each language's limit from the cross-entropies of texts that were not counted."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {language: j for j, language in enumerate(shared.value.languages)}
        for batch in pieces(batches, "text"):
            bits, chars = cross_entropies(batch.column("text"), shared.value)
            tongues = batch.column("lang").to_pylist()
            keep = [i for i, tongue in enumerate(tongues) if tongue in place and chars[i] >= settings.evidence]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tongues[i] for i in keep], pa.string()), pa.array([float(bits[i, place[tongues[i]]]) for i in keep], pa.float64())],
                names=["lang", "bits"],
            )

    limits = dict(
        rows.mapInArrow(own, "lang string, bits double").groupBy("lang").agg(F.percentile("bits", 0.99)).collect()
    )
    highest = np.array([limits.get(language, np.inf) for language in models.languages]) + settings.slack
    return Models(models.languages, models.ngrams, models.direct, models.contexts, models.backoff, models.floor, highest)


def identify(documents: DataFrame, models: Models, text: str = "text", settings: Settings = Settings(), prefix: str = "lang_") -> DataFrame:
    """The rows with ``lang_pred``, ``lang_score``, ``lang_bits`` and ``lang_rejected`` (the names start with ``prefix``).

    ``lang_pred`` is the language of least cross-entropy a character, the first by name if equal;
    ``und`` for a text that is null or has no letter. The score is the language's share when at
    most ``settings.evidence`` characters count; 0 for ``und``. A row is rejected if even the best
    language needs more bits than its limit, or for ``und``. Columns of these names are replaced.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(models)  # the sample bounds the tables
    key = uuid.uuid4().hex

    @F.arrow_udf("struct<pred: string, score: double, bits: double, rejected: boolean>")
    def identified(texts: pa.Array) -> pa.Array:
        remembered = _remembered(key, shared.value)
        parts = [_identify(part, shared.value, settings, remembered) for part in slices(texts, PIECE_BYTES)]
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 4
        return pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1].astype(float)), pa.array(columns[2].astype(float)), pa.array(columns[3].astype(bool))],
            names=["pred", "score", "bits", "rejected"],
        )

    held = documents.withColumn("__identified", identified(F.col(text)))
    names = ("pred", "score", "bits", "rejected")
    return held.withColumns({prefix + x: F.col(f"__identified.{x}") for x in names}).drop("__identified")


_LETTER = np.zeros(256, bool)
for _first, _last in ("AZ", "az"):
    _LETTER[ord(_first) : ord(_last) + 1] = True


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, bounds = flat(column)
    seen = np.append(0, np.cumsum(_LETTER[data]))
    found = seen[bounds[1:]] > seen[bounds[:-1]]
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(map(str.isalpha, column[i].as_py() or ""))
    return found


def _identify(column: pa.Array, models: Models, settings: Settings, remembered: Remembered) -> tuple[np.ndarray, ...]:
    bits, chars = cross_entropies(column, models, remembered)
    best = bits.argmin(axis=1)
    lowest = bits[np.arange(len(best)), best]
    evidence = np.minimum(chars, settings.evidence)[:, None]
    share = 1 / np.exp2(np.maximum(-700, -(bits - lowest[:, None]) * evidence)).sum(axis=1)
    known = has_letter(column)
    names = np.array([*models.languages, UNDETERMINED], object)
    return (
        names[np.where(known, best, len(models.languages))],
        np.where(known, share, 0.0),
        lowest,
        ~known | (lowest > models.limits[best]),
    )
