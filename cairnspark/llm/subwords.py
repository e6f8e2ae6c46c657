"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds on flat arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.chars import expand
from cairnspark.llm.text import PIECE_BYTES, bounded_batches, flat, run_hashes, slices

#: How the format writes a blank: U+2581 in UTF-8.
BLANK = "▁".encode()
_NORMAL, _BYTE = 1, 6
_BPE = 2


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message (numbers as they are, others as bytes)."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            out.append((tag >> 3, number()))
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            out.append((tag >> 3, data[at : at + size]))
            at += size
    return out


@dataclass(frozen=True)
class Model:
    """Pieces by id, and every way to join two pieces into a third, as sorted arrays."""

    piece_bytes: np.ndarray  #: what the ids decode to, all in a row (a blank for U+2581)
    piece_edges: np.ndarray
    chars: np.ndarray  #: sorted code points that are pieces
    char_ids: np.ndarray
    pairs: np.ndarray  #: sorted left * n + right
    joined: np.ndarray  #: id of the joined piece
    ranks: np.ndarray  #: by id: 0 for the piece that is joined first
    by_rank: np.ndarray
    byte_ids: np.ndarray  #: id of each byte, for characters that are no piece
    is_byte: np.ndarray
    starts_blank: np.ndarray
    prefix: bool  #: whether a blank is put before a text

    def __len__(self) -> int:
        return len(self.ranks)


_loaded: dict[str, Model] = {}


def load(path: str) -> Model:
    """Read a model file once per process. Only BPE with byte fallback and no normalisation is read."""
    if path not in _loaded:
        with open(path, "rb") as file:
            _loaded[path] = parse(file.read())
    return _loaded[path]


def parse(data: bytes) -> Model:
    pieces: list[tuple[bytes, float, int]] = []
    trainer: dict = {}
    normal: dict = {}
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b""), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, _NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normal = dict(_fields(value))
    if trainer.get(3) != _BPE or not trainer.get(35) or trainer.get(24):
        raise ValueError("not a BPE model with byte fallback")
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("the model changes the characters or blanks of a text")
    n = len(pieces)
    known = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == _NORMAL}
    left, right, whole = [], [], []
    for piece, i in known.items():
        cuts = [k for k in range(1, len(piece)) if piece[k] & 0xC0 != 0x80]
        for k in cuts:
            a, b = known.get(piece[:k]), known.get(piece[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                whole.append(i)
    pairs = np.array(left, np.int64) * n + np.array(right, np.int64)
    order = np.argsort(pairs)
    ranks, by_rank = np.full(n, n, np.int64), np.argsort([-score for _, score, _ in pieces], kind="stable")
    ranks[by_rank] = np.arange(n)
    decoded, byte_ids, is_byte = [], np.zeros(256, np.int64), np.zeros(n, bool)
    for i, (piece, _, kind) in enumerate(pieces):
        if kind == _BYTE:
            byte = int(piece[3:5], 16)
            byte_ids[byte], is_byte[i] = i, True
            decoded.append(bytes([byte]))
        elif kind == _NORMAL:
            decoded.append(piece.replace(BLANK, b" "))
        else:
            decoded.append(b"" if kind != 2 else " ⁇ ".encode())  # what the format shows for an unknown piece
    single = sorted((ord(p.decode()), i) for p, i in known.items() if len(p.decode()) == 1)
    return Model(
        np.frombuffer(b"".join(decoded), np.uint8),
        np.append(0, np.cumsum([len(x) for x in decoded])),
        np.array([c for c, _ in single], np.int64),
        np.array([i for _, i in single], np.int64),
        pairs[order],
        np.array(whole, np.int64)[order],
        ranks,
        by_rank,
        byte_ids,
        is_byte,
        np.array([p.startswith(BLANK) and k == _NORMAL for p, _, k in pieces]),
        bool(normal.get(3, 1)),
    )


def _joins(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of the piece that two neighbours make, the number of pieces if none."""
    wanted = left * len(model) + right
    at = np.minimum(np.searchsorted(model.pairs, wanted), max(0, len(model.pairs) - 1))
    if not len(model.pairs):
        return np.full(len(wanted), len(model), np.int64)
    good = (model.pairs[at] == wanted) & (left >= 0) & (right >= 0)
    return np.where(good, model.ranks[model.joined[at]], len(model))


def merge(model: Model, symbols: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, and the new bounds of the words.

    ``symbols`` holds ids, or negative numbers for characters that are no piece; word w is
    ``symbols[edges[w]:edges[w + 1]]``. In each round every word finds its pair of least rank and
    joins all places of it from the left. If joining one of them makes a pair of lower rank with a
    neighbour, which must come before the next place, only the first place of that word is joined.
    Words without any pair leave the arrays.
    """
    none = len(model)
    n_words = len(edges) - 1
    done_symbols, done_words = [], []
    word = np.repeat(np.arange(n_words), np.diff(edges))
    symbols = symbols.astype(np.int64)

    def pair_ranks(symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), none, np.int64)  # of the pair that starts here
        if len(symbols) > 1:
            near = np.flatnonzero(word[:-1] == word[1:])
            rank[near] = _joins(model, symbols[near], symbols[near + 1])
        return rank

    rank = pair_ranks(symbols, word)
    while len(symbols):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(heads, len(word)))
        least = np.minimum.reduceat(rank, heads)
        over = np.repeat(least == none, sizes)
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            symbols, word, rank = symbols[~over], word[~over], rank[~over]
            keep = least != none
            least, sizes = least[keep], sizes[keep]
            if not len(symbols):
                break
        place = np.repeat(np.arange(len(sizes)), sizes)
        target = least[place]
        at = np.flatnonzero(rank == target)
        # Of places that overlap in a row, take the first, third, ...
        fresh = np.append(True, np.diff(at) > 1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        new = model.by_rank[rank[at]]
        # Ranks that a join makes with its neighbours, those to the left already joined.
        joined = symbols.copy()
        joined[at] = new
        taken = np.zeros(len(symbols) + 1, bool)
        taken[at + 1] = True
        before = at - 1 - (taken[at - 1] & (at > 0))
        lower = np.full(len(at), none, np.int64)
        ok = (before >= 0) & (word[np.maximum(before, 0)] == word[at])
        lower[ok] = _joins(model, joined[before[ok]], new[ok])
        after = at + 2
        ok = (after < len(symbols)) & (word[np.minimum(after, len(symbols) - 1)] == word[at])
        lower[ok] = np.minimum(lower[ok], _joins(model, new[ok], symbols[after[ok]]))
        early = np.zeros(len(sizes), bool)
        early[place[at[lower < target[at]]]] = True
        if early.any():
            first = np.append(True, place[at[1:]] != place[at[:-1]])
            keep = first | ~early[place[at]]
            at, new = at[keep], new[keep]
        symbols[at] = new
        gone = np.zeros(len(symbols), bool)
        gone[at + 1] = True
        stay = ~gone
        touched = np.zeros(len(symbols) + 1, bool)
        touched[at] = True
        kept = np.flatnonzero(stay)
        symbols, word, rank = symbols[kept], word[kept], rank[kept]
        touched = touched[kept]
        redo = np.flatnonzero(touched | np.append(touched[1:], False))
        rank[redo] = none
        near = redo[redo + 1 < len(symbols)]
        near = near[word[near] == word[near + 1]]
        rank[near] = _joins(model, symbols[near], symbols[near + 1])
    if not done_symbols:
        return np.zeros(0, np.int64), np.zeros(n_words + 1, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.append(0, np.cumsum(np.bincount(word, minlength=n_words)))


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each starts."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    a, b, c, d = (padded[starts + i] for i in range(4))
    size = 1 + (a >= 0xC0) + (a >= 0xE0) + (a >= 0xF0)
    two = (a & 0x1F) << 6 | b & 63
    three = (a & 0x0F) << 12 | (b & 63) << 6 | c & 63
    four = (a & 0x07) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63
    return np.select([size == 1, size == 2, size == 3], [a, two, three], four), starts


def _framed(data: np.ndarray, bounds: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts with blanks as the format writes them, and one more before each text that is not empty."""
    sizes = np.diff(bounds)
    lead = (sizes > 0) & prefix
    width = np.where(data == 32, len(BLANK), 1)
    before = np.append(0, np.cumsum(width))
    edges = np.append(0, np.cumsum(np.diff(before[bounds]) + lead * len(BLANK)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = before[:-1] - before[bounds[:-1]][row] + edges[:-1][row] + lead[row] * len(BLANK)
    out = np.empty(edges[-1], np.uint8)
    out[at] = data
    for i, byte in enumerate(BLANK):
        out[at[data == 32] + i] = byte
        out[edges[:-1][lead] + i] = byte
    return out, edges


def encode(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the bounds of each text in them.

    No piece has a blank after another character, so a text falls into words, each a run of blanks
    and what follows; equal words are merged once.
    """
    data, edges = _framed(data, bounds, model.prefix)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    code, starts = _code_points(data)
    blank = code == 0x2581
    head = np.append(True, blank[1:] & ~blank[:-1])
    text_start = np.zeros(len(data) + 1, bool)
    text_start[edges] = True
    head |= text_start[starts]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(starts))
    ends = np.append(starts, len(data))
    hashes = run_hashes(data, starts[first], ends[last])
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    count = (last - first)[one]
    where = expand(first[one], count)
    found = np.minimum(np.searchsorted(model.chars, code[where]), len(model.chars) - 1)
    symbols = np.where(model.chars[found] == code[where], model.char_ids[found], -1 - code[where])
    merged, cuts = merge(model, symbols, np.append(0, np.cumsum(count)))
    ids, cuts = _with_bytes(model, merged, cuts)
    size = np.diff(cuts)[which]
    out = ids[expand(cuts[:-1][which], size)]
    at = np.searchsorted(starts[first], edges)  # words before each text
    return out, np.append(0, np.cumsum(size))[at]


def _with_bytes(model: Model, symbols: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that are no piece become the ids of their UTF-8 bytes."""
    odd = np.flatnonzero(symbols < 0)
    if not len(odd):
        return symbols, cuts
    size = np.ones(len(symbols), np.int64)
    code = -1 - symbols[odd]
    size[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    at = np.append(0, np.cumsum(size))
    out = np.repeat(symbols, size)
    tail = "".join(map(chr, code.tolist())).encode()
    out[expand(at[odd], size[odd])] = model.byte_ids[np.frombuffer(tail, np.uint8)]
    return out, at[cuts]


def decode(model: Model, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """UTF-8 text of each run of ids. Byte ids that are no valid UTF-8 become U+FFFD each; the first blank goes."""
    size = np.diff(model.piece_edges)[ids]
    data = model.piece_bytes[expand(model.piece_edges[ids], size)].tobytes()
    at = np.append(0, np.cumsum(size))
    out = []
    odd = np.append(0, np.cumsum(model.is_byte[ids]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        first = a
        while first < b and not size[first]:  # control pieces show nothing
            first += 1
        skip = int(first < b and model.prefix and model.starts_blank[ids[first]])
        part = data[at[a] + skip : at[b]]
        if odd[b] > odd[a] and not _valid(part):
            part = _repaired(model, ids[a:b])[skip:]
        out.append(part)
    return out


def _valid(part: bytes) -> bool:
    try:
        part.decode()
    except UnicodeDecodeError:
        return False
    return True


def _repaired(model: Model, ids: np.ndarray) -> bytes:
    out, run = [], b""
    for i in [*ids.tolist(), None]:
        if i is not None and model.is_byte[i]:
            run += model.piece_bytes[model.piece_edges[i] : model.piece_edges[i + 1]].tobytes()
            continue
        while run:
            for n in range(1, 5):
                if _valid(run[:n]):
                    out.append(run[:n])
                    run = run[n:]
                    break
            else:
                out.append("�".encode())
                run = run[1:]
        if i is not None:
            out.append(model.piece_bytes[model.piece_edges[i] : model.piece_edges[i + 1]].tobytes())
    return b"".join(out)


def _digests(model: Model, part: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
    ids, cuts = encode(model, *flat(part))
    texts = decode(model, ids, cuts)
    digits, edges = _decimal(len(model))
    size = np.diff(edges)[ids]
    told = digits[expand(edges[:-1][ids], size)].tobytes()
    at = np.append(0, np.cumsum(size))[cuts]
    sha: Callable = hashlib.sha256
    sums = [sha(told[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return np.diff(cuts), sums, [sha(t).hexdigest() for t in texts]


_decimals: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``0,1,2,...`` as bytes and the bounds of each number with its comma."""
    if n not in _decimals:
        texts = [f"{i},".encode() for i in range(n)]
        _decimals[n] = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    return _decimals[n]


def token_digests(documents: DataFrame, path: str, text: str = "text", to: str = "tokens") -> DataFrame:
    """The rows with a struct ``to``: n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    Digests of ``encode_ids`` and of the text that the ids decode to, without moving either out of
    Python. A null text counts as empty: no tokens. A column named ``to`` is replaced.
    """
    bounded_batches(documents.sparkSession)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(texts: pa.Array) -> pa.Array:
        model = load(path)
        parts = [_digests(model, part) for part in slices(texts, PIECE_BYTES)]
        n, ids, decoded = zip(*parts) if parts else ([np.zeros(0)], [[]], [[]])
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(n).astype(np.int64)), pa.array(sum(ids, []), pa.string()), pa.array(sum(decoded, []), pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return documents.withColumn(to, digests(F.col(text)))


def encode_ids(documents: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """The rows with an array ``to`` of token ids, empty for a null or empty text.

    A column named ``to`` is replaced, other columns pass unchanged. No rows in, no rows out.
    """
    bounded_batches(documents.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        parts = [encode(load(path), *flat(part)) for part in slices(texts, PIECE_BYTES)]
        arrays = [pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32))) for i, c in parts]
        return pa.concat_arrays(arrays) if arrays else pa.array([], pa.list_(pa.int32()))

    return documents.withColumn(to, ids(F.col(text)))


def decode_ids(documents: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the text ``to`` that an array of ids stands for; a null array is an empty one.

    A column named ``to`` is replaced, other columns pass unchanged. No rows in, no rows out.
    """

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        rows = [x or [] for x in column.to_pylist()]
        cuts = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int64)
        every = np.array([i for x in rows for i in x], np.int64)
        return pa.array([t.decode() for t in decode(load(path), every, cuts)], pa.string())

    return documents.withColumn(to, texts(F.col(ids)))
