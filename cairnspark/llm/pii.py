"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole segments of up to ``LONGEST`` words. Its weights are learnt from documents
in which the base patterns mark the segments; some of these are rewritten (a phone number without
its country code, a card number with other separators) so that the field learns forms which the
patterns do not know.
"""

from __future__ import annotations

import io
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.text import bounded_batches, flat, slices

KINDS = ("email", "ip", "card", "phone")
#: A span: start, end (code points, exclusive), number of the kind.
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits never comes first, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, 0
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and non-overlapping within a kind, by start and kind."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGIT.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- the field ---------------------------------------------------------------------------------

LONGEST = 4
_TYPES = 1 + len(KINDS)  # 0 is "no entity", always one word long
_FEATURES = 1 << 12
_HINT = re.compile("[0-9@]")
_WORD = re.compile(r"\S+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|\s+")
_LEAD, _TAIL = "\"'[{<,;:", ".,;:!?\"'])}>"


@dataclass(frozen=True)
class Field:
    segment: np.ndarray  #: weights by type and segment feature
    follow: np.ndarray  #: weights by type and type before it

    @property
    def trained(self) -> bool:
        return bool(self.segment.any())


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of word bounds that an entity can touch: words with a digit or @, and one word around them.

    All words of an entity have a digit or @, so every other word is "no entity" for sure.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    done, run = 0, []
    for i in [i for i, (a, b) in enumerate(words) if _HINT.search(text, a, b)]:
        low, high = max(done, i - 1), min(len(words), i + 2)
        if run and low > done:
            yield run
            run = []
        run += words[low:high]
        done = max(done, high)
    if run:
        yield run


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without quotes and punctuation around it; an opening bracket stays if it is closed inside."""
    while start < end and (text[start] in _LEAD or text[start] == "(" and ")" not in text[start:end]):
        start += 1
    while start < end and text[end - 1] in _TAIL and not (text[end - 1] == ")" and "(" in text[start:end]):
        end -= 1
    return start, end


def _shape(part: str, exact: bool) -> str:
    def one(m: re.Match) -> str:
        if m[0][0].isdigit():
            return "9" * min(len(m[0]), 6) if exact else "9"
        return "_" if m[0].isspace() else "a"

    return _RUN.sub(one, part)


def segment_features(text: str, words: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Numbers of the features of the segment of words i to j - 1."""
    start, end = trimmed(text, words[i][0], words[j - 1][1])
    part = text[start:end]
    digits = "".join(_DIGIT.findall(part))
    before = text[slice(*words[i - 1])].lower() if i else ""
    after = text[slice(*words[j])].lower() if j < len(words) else ""
    fours = part.split(".")
    octets = len(fours) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in fours)
    names = [
        f"n={j - i}",
        f"shape={_shape(part, False)[:40]}",
        f"exact={_shape(part, True)[:60]}",
        f"digits={len(digits)}",
        f"size={min(20, end - start)}",
        f"first={part[:1] if not part[:1].isalnum() else ''}",
        f"mail={bool(_DOMAIN.search(part.partition('@')[2])) and '@' in part}",
        f"octets={octets}",
        f"luhn={12 <= len(digits) <= 19 and luhn(digits)}",
        f"letters={any(map(str.isalpha, part))}",
        f"hint={bool(_HINT.search(part))}",
        f"before={_shape(before, True)[:12]}",
        f"after={_shape(after, True)[:12]}",
        f"groups={'-'.join(str(len(g)) for g in re.findall('[0-9]+', part)[:6])}",
    ]
    return [zlib.crc32(x.encode()) % _FEATURES for x in names]


def training_parts(words: list[tuple[int, int]], spans: list[Span], least: int = 64) -> Iterator[list[tuple[int, int]]]:
    """An island in parts of ``least`` words or a few more, cut where no span goes across; decoding needs no parts."""
    start = 0
    for i in range(least, len(words)):
        if i - start >= least and not any(a < words[i - 1][1] and words[i][0] < b for a, b, _ in spans):
            yield words[start:i]
            start = i
    yield words[start:]


def _candidates(text: str, words: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Features of each segment; none for a word that can only be "no entity"."""
    hint = [bool(_HINT.search(text, a, b)) for a, b in words]
    out = {(i, i + 1): np.zeros(0, np.int64) for i in range(len(words))}
    for i in range(len(words)):
        for j in range(i + 1, min(i + LONGEST, len(words)) + 1):
            if not hint[j - 1]:
                break
            out[i, j] = np.array(segment_features(text, words, i, j))
    return out


def _scores(field: Field, candidates: dict) -> dict[tuple[int, int], np.ndarray]:
    """Score by type of each segment; "no entity" is one word long."""
    out = {}
    for (i, j), at in candidates.items():
        s = field.segment[:, at].sum(axis=1)
        if j > i + 1:
            s[0] = -np.inf
        if not len(at):
            s[1:] = -np.inf
        out[i, j] = s
    return out


def decode(field: Field, text: str, words: list[tuple[int, int]]) -> list[Span]:
    """Entities of the best segmentation of an island, boundaries and kinds chosen together."""
    hint = [bool(_HINT.search(text, a, b)) for a, b in words]
    n = len(words)
    best = np.full((n + 1, _TYPES), -np.inf)
    best[0, 0] = 0
    # Words and type before; features are dropped at once, so a long island takes a few bytes a word.
    size, come_from = np.zeros((n + 1, _TYPES), np.int8), np.zeros((n + 1, _TYPES), np.int8)
    for j in range(1, n + 1):
        for i in range(max(0, j - LONGEST), j):
            if all(hint[i:j]):
                at = np.array(segment_features(text, words, i, j))
            elif i == j - 1:
                at = np.zeros(0, np.int64)
            else:
                continue
            come = best[i][None, :] + field.follow  # type, type before
            value = _scores(field, {(i, j): at})[i, j] + come.max(axis=1)
            for t in np.flatnonzero(value > best[j]).tolist():
                best[j, t] = value[t]
                size[j, t], come_from[j, t] = j - i, come[t].argmax()
    spans, j, t = [], n, int(best[n].argmax())
    while j:
        i, before = j - int(size[j, t]), int(come_from[j, t])
        if t:
            spans.append((*trimmed(text, words[i][0], words[j - 1][1]), t - 1))
        j, t = i, before
    return spans[::-1]


def _gradient(field: Field, candidates: dict, gold: dict[tuple[int, int], int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of a segmentation: observed minus expected features."""
    scores = _scores(field, candidates)
    ends: list[list[int]] = [[i for i in range(max(0, j - LONGEST), j) if (i, j) in scores] for j in range(n + 1)]
    forward, backward = np.full((n + 1, _TYPES), -np.inf), np.full((n + 1, _TYPES), -np.inf)
    forward[0, 0], backward[n] = 0, 0
    with np.errstate(divide="ignore"):
        for j in range(1, n + 1):
            for i in ends[j]:
                come = np.logaddexp.reduce(forward[i][None, :] + field.follow, axis=1)
                forward[j] = np.logaddexp(forward[j], scores[i, j] + come)
        for j in range(n, 0, -1):
            for i in ends[j]:
                go = (scores[i, j] + backward[j])[:, None] + field.follow
                backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(go, axis=0))
        total = np.logaddexp.reduce(forward[n])
        segment, follow = np.zeros_like(field.segment), np.zeros_like(field.follow)
        for (i, j), at in candidates.items():
            p = np.exp(forward[i][None, :] + field.follow + (scores[i, j] + backward[j])[:, None] - total)
            follow -= p
            np.subtract.at(segment.T, at, p.sum(axis=1))
    last = 0
    for (i, j), t in sorted(gold.items()):
        segment[t, candidates[i, j]] += 1
        follow[t, last] += 1
        last = t
    return segment, follow


def gold_segments(spans: list[Span], text: str, words: list[tuple[int, int]]) -> dict[tuple[int, int], int] | None:
    """The segmentation that the spans ask for; None if a span does not fit the words of the island."""
    kind = {(a, b): k + 1 for a, b, k in spans}
    gold, i, seen = {}, 0, 0
    while i < len(words):
        for j in range(min(i + LONGEST, len(words)), i, -1):
            t = kind.get(trimmed(text, words[i][0], words[j - 1][1]))
            if t:
                gold[i, j] = t
                i, seen = j, seen + 1
                break
        else:
            gold[i, i + 1] = 0
            i += 1
    inside = [s for s in spans if words[0][0] <= s[0] and s[1] <= words[-1][1]]
    return gold if seen == len(inside) else None


def _rewritten(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The text with its entities in forms that the base patterns do not know."""
    out, moved, done, size = [], [], 0, 0
    for start, end, kind in spans:
        if start < done:
            continue
        part = text[start:end]
        if kind == 3:
            part = re.sub(r"^\+[0-9]+[ .-]*", "", part)
            part = rng.choice([part, part.replace("(", "").replace(")", "").replace(" ", rng.choice("-."))])
        elif kind == 2:
            digits = "".join(_DIGIT.findall(part))
            part = rng.choice("./").join(digits[i : i + 4] for i in range(0, len(digits), 4))
        out += [text[done:start], part]
        size += start - done
        moved.append((size, size + len(part), kind))
        size += len(part)
        done = end
    return "".join([*out, text[done:]]), moved


def _negatives(rng: random.Random) -> str:
    """Numbers that are no personal data, between words."""
    d = rng.randint
    forms = (
        f"{d(1900, 2100)}-{d(1, 12):02}-{d(1, 28):02}", f"{d(1, 28)}.{d(1, 12)}.{d(1900, 2100)}", f"{d(1, 12)}/{d(1, 28)}/{d(1900, 2100)}",
        f"{d(0, 23)}:{d(0, 59):02}", f"{d(1, 9)}.{d(0, 20)}.{d(0, 20)}", f"{d(1, 999)},{d(0, 999):03},{d(0, 999):03}", f"{d(1, 10**6)}",
        f"{d(1, 999)}.{d(0, 99):02}", f"{d(1, 99)}%", f"({d(1, 99)})", f"[{d(1, 99)}]", f"{d(10**9, 10**11)}", f"{d(1, 99)}-{d(100, 199)}",
        f"x{d(1, 99)}", f"{d(1, 9)}. {d(1, 9)}. {d(1, 9)}.", f"{d(1, 99)} {d(100, 999)} {d(1, 9)}", "@name", f"user{d(1, 99)}@", f"{d(1900, 2100)} - {d(1900, 2100)}",
    )
    words = [rng.choice(forms) if rng.random() < 0.6 else rng.choice(["word", "at", "on", "we", "paid", "and"]) for _ in range(7)]
    return " ".join(["word", *words, "word"])


def train(texts: list[str], epochs: int = 3, rate: float = 0.3) -> Field:
    """Maximum likelihood by AdaGrad on the islands of the texts, plain and rewritten, and on plain numbers."""
    rng, examples = random.Random(1), []
    for text in texts:
        spans = base_spans(text)
        for told, marked in ((text, spans), *([_rewritten(text, spans, rng)] if spans else []), *((_negatives(rng), []) for _ in range(6))):
            for words in (part for island in islands(told) for part in training_parts(island, marked)):
                gold = gold_segments(marked, told, words)
                if gold:
                    examples.append((_candidates(told, words), gold, len(words)))
    field = Field(np.zeros((_TYPES, _FEATURES)), np.zeros((_TYPES, _TYPES)))
    if not any(any(gold.values()) for _, gold, _ in examples):
        return field
    squares = Field(np.full_like(field.segment, 1e-8), np.full_like(field.follow, 1e-8))
    for _ in range(epochs):
        rng.shuffle(examples)
        for candidates, gold, n in examples:
            for weights, square, g in zip(
                (field.segment, field.follow), (squares.segment, squares.follow), _gradient(field, candidates, gold, n)
            ):
                changed = np.nonzero(g)
                square[changed] += g[changed] ** 2
                weights[changed] += rate * g[changed] / np.sqrt(square[changed])
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans; base spans and those that the field adds clear of them, both by start and kind."""
    base = base_spans(text)
    found = list(base)
    if field.trained:
        for words in islands(text):
            for start, end, kind in decode(field, text, words):
                if start < end and all(end <= a or b <= start for a, b, _ in base):
                    found.append((start, end, kind))
    return base, sorted(found, key=lambda s: (s[0], s[2], s[1]))


def training_texts(documents: DataFrame, text: str = "text", sample_rows: int = 400) -> DataFrame:
    """(text): at most ``sample_rows`` distinct texts with a digit or @, those with a base span first, by their hash.

    Only hashes are compared; then the chosen texts are read, copies of one as one row a task.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("hash", F.xxhash64("text"))

    @F.arrow_udf("boolean")
    def marked(texts: pa.Array) -> pa.Array:
        return pa.array([bool(base_spans(value.as_py())) for value in texts], pa.bool_())

    known = rows.select("hash", marked("text").alias("marked")).distinct()
    chosen = known.orderBy(F.desc("marked"), "hash").limit(sample_rows).select("hash").distinct()
    return rows.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.min("text").alias("text")).select("text")


def fit(documents: DataFrame, text: str = "text", sample_rows: int = 400) -> Field:
    """Learn the field from the ``training_texts``; a table without any base span gives a field that adds nothing."""
    sample = training_texts(documents, text, sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for t in batch.column("text").to_pylist()]
        field, out = train(sorted(texts)), io.BytesIO()
        np.savez(out, segment=field.segment, follow=field.follow)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["field"])

    got = sample.repartition(1).mapInArrow(learn, "field binary").head()
    if got is None:
        return Field(np.zeros((_TYPES, _FEATURES)), np.zeros((_TYPES, _TYPES)))
    with np.load(io.BytesIO(bytes(got["field"]))) as arrays:
        return Field(arrays["segment"], arrays["follow"])


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span as its kind in brackets; overlapping spans become one, named after the first."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_OUT = "struct<base: array<struct<start: int, stop: int, kind: string>>, spans: array<struct<start: int, stop: int, kind: string>>, text: string>"


def find(documents: DataFrame, field: Field, text: str = "text", to: str = "pii") -> DataFrame:
    """The rows with a struct ``to``: ``base`` and ``spans`` (start, stop, kind; code points) and the redacted ``text``.

    ``spans`` holds all base spans and those the field adds. A null text counts as empty and stays
    null when redacted. The column ``to`` is replaced if there is one; others pass unchanged.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(field)  # of fixed size
    empty: list = []

    def structs(spans: list[Span]) -> list[dict]:
        return [{"start": a, "stop": b, "kind": KINDS[k]} for a, b, k in spans]

    entry = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    @F.arrow_udf(_OUT)
    def found(texts: pa.Array) -> pa.Array:
        base, spans, clean = [], [], []
        for part in slices(texts):
            data, bounds = flat(part)
            hint = np.append(0, np.cumsum(((data >= 48) & (data <= 57)) | (data == 64)))
            may = hint[bounds[1:]] > hint[bounds[:-1]]
            for value, look in zip(part.to_pylist(), may.tolist()):
                one, every = all_spans(value, shared.value) if look else (empty, empty)
                base.append(structs(one))
                spans.append(structs(every))
                clean.append(redacted(value, every) if every else value)
        return pa.StructArray.from_arrays([pa.array(base, entry), pa.array(spans, entry), pa.array(clean, pa.string())], names=["base", "spans", "text"])

    return documents.withColumn(to, found(F.col(text)))
