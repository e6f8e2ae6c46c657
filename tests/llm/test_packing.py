from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import packing
from cairnspark.llm.queries import word_vocabulary

SMALL = packing.Settings(length=64, chunk=100, part_tokens=700)


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def rebuilt(rows):
    """Ids of each (doc_id, doc_tokens) document, after checking that sequences have no gap."""
    sequences, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    sizes = {}
    for number, pieces in sequences.items():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        sizes[number] = at
    return docs, sizes


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_touch(dimensions, bits):
    side = np.arange(1 << bits)
    cells = np.stack([x.ravel() for x in np.meshgrid(*[side] * dimensions)], axis=1)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_encoder_equals_the_library(prose, rng):
    encoder = packing.Encoder(word_vocabulary(), keep=50)
    texts = [prose(80), "", None, "  Don't\tSTOP now x\x1cy z été ́ ΣΑΣ Σ.", "a" * 3000, prose(300), "日本 x1"]
    texts += ["A<|endoftext|>z <|ENDOFTEXT|> b", "I'll, you've 'san ,'s x'RE can't. 'r, it's1 a\x02b x y z", "Ab.́c d1̊ KK"]
    pool = list("aBs'tre.,1 ́É\x02\x7f\x1f\n<|>")
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += ["".join(map(chr, range(0xC0, 0x180))), " ".join(map(chr, range(0xA0, 0x250))), " ".join("a" + chr(c) + "z" for c in range(0x7F, 0x250))]
    for kept in (texts, texts[:9], texts[2:]):
        ids, bounds = encoder(pa.array(kept, pa.string()))
        assert [ids[a:b].tolist() + [2] for a, b in zip(bounds[:-1], bounds[1:])] == [plain_ids(t) for t in kept]


def test_every_token_lies_in_one_piece(spark, prose, rng):
    rows = [(i, prose(rng.choice([0, 1, 5, 40, 90]))) for i in range(60)] + [(100, prose(900)), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "'x' as ids").repartition(3)
    found = packing.pack(docs, word_vocabulary(), SMALL).collect()
    got, sizes = rebuilt(found)
    for doc_id, text in rows:
        want, at = plain_ids(text), 0
        for start, ids, doc_tokens in sorted(got[doc_id]):
            assert start == at and ids == want[at : at + len(ids)] and doc_tokens == len(want)
            at += len(ids)
        assert at == len(want)
    assert set(got) == {i for i, _ in rows} and sorted(sizes) == list(range(len(sizes)))
    # Full sequences, then falling powers of two.
    full = sum(sizes.values()) // 64
    assert all(sizes[i] == 64 for i in range(full))
    rest = [sizes[i] for i in range(full, len(sizes))]
    assert rest == sorted(rest, reverse=True) and all(x & (x - 1) == 0 for x in rest) and len(set(rest)) == len(rest)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "one two")] * 40 + [(7, "one two")] * 40, "doc_id long, text string")
    found = packing.pack(docs, word_vocabulary(), SMALL).collect()
    got, sizes = rebuilt(found)
    assert sum(len(ids) for x in got.values() for _, ids, _ in x) == 240 == sum(sizes.values())
    assert packing.pack(docs.where("false"), word_vocabulary(), SMALL).collect() == []


def test_alike_documents_share_sequences(spark, rng):
    themes = [[f"{a}{b}" for b in "aeiou"] for a in ("str", "bl", "gr", "pl")]
    rows = [(i, " ".join(rng.choice(themes[i % 4]) for _ in range(12))) for i in range(400)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), word_vocabulary(), SMALL)
    mixed = found.groupBy("sequence_id").agg(F.countDistinct(F.col("doc_id") % 4).alias("themes"), F.countDistinct("doc_id").alias("docs"))
    assert mixed.where("docs > 1").agg(F.avg("themes")).first()[0] < 2.2
    assert packing.sequence_ends(64 + 13, 64) == [72, 76, 77] and packing.sequence_ends(128, 64) == []
