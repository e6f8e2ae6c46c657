import zlib
from collections import Counter

import numpy as np
import pytest

from cairnspark.llm import spelling
from cairnspark.llm.spelling import Settings

SYLLABLES = "an the ring sto ça ßu ÉÀ ter lo mi Era".split()


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, settings):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % settings.thin == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= settings.least_length and n >= settings.least_count}


def brute(rows, settings):
    words = brute_words(rows, settings)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= settings.ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def made(rng, n, copies=1):
    """Words of syllables, now and then with a slip, the first ones far more often."""
    stock = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(60)]
    for _ in range(n):
        w = stock[int(len(stock) * rng.random() ** 3)]
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeéx") + w[i:], w[:i] + rng.choice("aeéx") + w[i + 1 :]])
        yield w


@pytest.mark.parametrize(
    "settings", [Settings(), Settings(subtree=5, ratio=3), Settings(subtree=1, least_length=4, thin=3), Settings(least_length=1, least_count=1, ratio=2, subtree=7)]
)
def test_variants_against_brute_force(spark, rng, settings):
    rows = [(i if i % 9 else None, " ".join(made(rng, 120)) + rng.choice([".", "", "_x1"])) for i in range(40)]
    rows += [(5, None), (6, ""), (7, "1234567 -"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1L as n").repartition(3)
    found = spelling.variants(docs, settings)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}
    want = brute(rows, settings)
    assert got == want and any(x[0] for x in want.values())


def test_chains_are_followed_to_the_end(spark):
    text = " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000)
    found = spelling.variants(spark.createDataFrame([(0, text)], "doc_id long, text string"), Settings(thin=1 << 40))
    got = {r["word"]: (r["form"], r["root"]) for r in found.collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij") and got["abcdefghij"] == (None, "abcdefghij") and len(got) == 4


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    assert spelling.variants(docs).collect() == [] == spelling.variants(docs.where("false")).collect()
    assert spelling.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_very_long_words_and_full_leaves():
    long = ["a" * 700, "a" * 699, "a" * 698 + "b", "b" + "a" * 699]
    near, some, best = spelling.near_words(long, np.ones(4, bool), np.array([5, 4, 3, 2]))
    assert near.tolist() == [2, 3, 1, 2] and best.tolist() == [1, 0, 1, 0]
    want = [sum(one_edit(a, b) for b in long) for a in long]
    assert near.tolist() == want and some.all()


def test_pairs_in_blocks_of_one_leaf(rng):
    words = sorted({"".join(rng.sample("abcdefg", 7)) for _ in range(150)} | {"".join(rng.sample("abcdefg", 7))[:6] + "h" for _ in range(80)})
    n = np.arange(len(words)) + 1
    near, _, _ = spelling.near_words(words, np.ones(len(words), bool), n, pairs=50)
    assert near.tolist() == [sum(one_edit(a, b) for b in words) for a in words]
