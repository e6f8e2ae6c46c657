import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cairnspark.llm import subwords
from cairnspark.llm.text import flat

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = [
    None, "", " ", "   ", "a", "  a b ", "▁x", "▁ ▁", "日本語 𝄞", "a\0b", "\n\n\t x\r", "aaaaaaaaaaaaaaaaa", "x" * 3000,
    " " * 300, "<s> </s> <unk> <0x41>", "ñ �", "ab" * 2000 + " ab",
]


def compare(library, texts):
    model = subwords.load(PATH)
    ids, cuts = subwords.encode(model, *flat(pa.array(texts, pa.string())))
    decoded = subwords.decode(model, ids, cuts)
    for i, text in enumerate(texts):
        wanted = library.encode(text or "")
        assert ids[cuts[i] : cuts[i + 1]].tolist() == wanted, text
        assert decoded[i].decode() == library.decode(wanted), text


def test_odd_texts(library):
    compare(library, ODD)


@pytest.mark.parametrize("alphabet", ["aabbcdeth in▁  ñé日0019.,-\n", "thequickbrownandoveringtionabcdefghijklmnop"])
def test_random_texts(library, alphabet):
    rng = random.Random(3)
    compare(library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)])


def test_decoding_any_ids(library):
    rng, model = random.Random(5), subwords.load(PATH)
    for _ in range(500):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 8))]
        got = subwords.decode(model, np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()
        assert got == library.decode(ids), ids


def test_operator(spark, library):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as ids")
    for r in subwords.token_digests(docs, PATH).select("text", "tokens.*").collect():
        ids = library.encode(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = subwords.decode_ids(subwords.encode_ids(docs, PATH), PATH).collect()
    assert [r.decoded for r in back] == [library.decode(library.encode(r.text or "")) for r in back]
    assert subwords.token_digests(docs.where("false"), PATH).collect() == []


def test_clashing_names_and_null_ids(spark, library):
    text = "A river of words"
    docs = spark.createDataFrame([(1, text, "x", "y"), (2, None, "x", "y")], "doc_id long, text string, ids string, decoded string")
    coded = subwords.encode_ids(docs, PATH)
    assert coded.columns == docs.columns
    assert [r.ids for r in coded.orderBy("doc_id").collect()] == [library.encode(text), []]
    back = subwords.decode_ids(coded.selectExpr("doc_id", "if(doc_id = 1, ids, null) as ids", "decoded"), PATH)
    assert [tuple(r)[2] for r in back.orderBy("doc_id").collect()] == [text, ""]
    assert subwords.decode_ids(coded.where("false"), PATH).collect() == []
