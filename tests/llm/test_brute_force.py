"""The trained operators against plain versions with dictionaries and loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import langid, linear, quality, text, toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-60, min(60, x))))


def plain_leader(examples, alpha, l1, l2, epochs, beta=1.0):
    """Follow the regularised leader, one feature at a time; the bias is feature None."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        lasso, ridge = (0, 0) if i is None else (l1, l2)
        if abs(z[i]) <= lasso:
            return 0.0
        return -(z[i] - math.copysign(lasso, z[i])) / ((beta + math.sqrt(n[i])) / alpha + ridge)

    for _ in range(epochs):
        for y, features in examples:
            features = {**features, None: 1.0}
            w = {i: weight(i) for i in features}
            slope = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * x for i, x in features.items()))))) - y
            for i, x in features.items():
                g = slope * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def dot(weights, features):
    return weights.get(None, 0.0) + sum(weights.get(i, 0.0) * x for i, x in features.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = "stone river Größe light, under!! x1 the the".split()
    return [(i, " ".join(rng.choice(words) + rng.choice(["", "s", "!"]) for _ in range(rng.randint(1, 12))), i % 3 % 2) for i in range(60)]


def frames(spark, rows, label):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], f"doc_id long, {label} int")


def in_training_order(spark, rows):
    order = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int").selectExpr("doc_id", "xxhash64(doc_id, label) as place")
    place = {r.doc_id: r.place for r in order.collect()}
    return sorted(rows, key=lambda r: place[r[0]])


def test_updates_against_loops():
    rng = random.Random(3)
    examples = [(rng.randint(0, 1), {i: rng.uniform(-1, 1) for i in rng.sample(range(16), 5)}) for _ in range(80)]
    model = linear.follow_leader([(y, np.array(list(f)), np.array(list(f.values()))) for y, f in examples], 4)
    want = plain_leader(examples, 1.0, 0.003, 0.001, 6)
    assert model.bias == pytest.approx(want[None], abs=1e-9)
    assert model.weights == pytest.approx([want.get(i, 0.0) for i in range(16)], abs=1e-6)


def plain_tokens(value):
    import re

    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", value)


def test_quality_against_plain_version(spark, rows):
    """Fit and scores from the operator's features, which test_classifiers compares with plain counts."""
    docs, labels = frames(spark, rows, "quality")
    model = quality.fit(docs, labels)

    hashed = {}
    for i, value, _ in rows:
        row, at, x = quality.word_features(*text.flat(pa.array([value])), 20, 2)
        hashed[i] = dict(zip(at.tolist(), x.astype(np.float32).astype(float).tolist()))
    want = plain_leader([(y, hashed[i]) for i, _, y in in_training_order(spark, rows)], 1.0, 0.003, 0.001, 6)
    got = {r.doc_id: r.s for r in quality.score(docs, model, to="s").collect()}
    for i, _, _ in rows:
        assert got[i] == pytest.approx(sigmoid(dot(want, hashed[i])), abs=1e-6)


def test_toxicity_against_plain_version(spark, rows):
    """Log-count ratios, fit and scores on n-grams themselves instead of their hashes."""
    docs, labels = frames(spark, rows, "toxic")
    settings = toxicity.Settings()
    model = toxicity.fit(docs, labels)

    def grams(value):
        found = set()
        for token in plain_tokens(value):
            if token[0].isalnum():
                framed = f" {token.encode().lower().decode()} "
                found |= {framed[j : j + n] for n in range(3, 7) for j in range(len(framed) - n + 1)}
        return found

    seen, size = [Counter(), Counter()], [0, 0]
    for _, value, y in rows:
        seen[y].update(grams(value))
        size[y] += 1
    share = [size[y] / len(rows) for y in (0, 1)]

    def ratio(g):
        p = [(seen[y][g] + settings.smoothing * share[y]) / (size[y] + settings.smoothing) for y in (0, 1)]
        return math.log(p[1] / p[0])

    scaled = {i: {g: r for g in grams(value) if abs(r := ratio(g)) > 0.2} for i, value, _ in rows}
    # An example's ratios are kept in double precision.
    want = plain_leader([(y, scaled[i]) for i, _, y in in_training_order(spark, rows)], 0.1, 0.003, 0.001, settings.epochs)
    got = {r.doc_id: r.s for r in toxicity.score(docs, model, to="s").collect()}
    for i, value, _ in rows:
        plain = want[None] + sum(want.get(g, 0.0) * ratio(g) for g in grams(value))
        assert got[i] == pytest.approx(sigmoid(plain), abs=1e-5)


class PlainKneserNey:
    """Interpolated Kneser-Ney over the characters of words between blanks, by definition."""

    def __init__(self, words, order, discount):
        self.order, self.discount = order, discount
        self.counts = [Counter() for _ in range(order + 1)]
        first = [set() for _ in range(order + 1)]
        before = [defaultdict(set) for _ in range(order + 1)]
        for word in words:
            s = f" {word} "
            for end in range(1, len(s)):  # the first blank is not predicted
                for n in range(1, order + 1):
                    at = end - n + 1
                    if at < 0:
                        break
                    gram = s[at : end + 1]
                    self.counts[n][gram] += 1
                    if at == 0:
                        first[n].add(gram)
                    else:
                        before[n][gram].add(s[at - 1])
        for n in range(1, order):  # continuation counts below the highest order
            for gram in self.counts[n]:
                if gram not in first[n] and before[n][gram]:
                    self.counts[n][gram] = len(before[n][gram])
        self.floor = None

    def probability(self, gram, floor):
        """Of the last character after those before it."""
        p = floor
        for n in range(1, min(self.order, len(gram)) + 1):
            own, context = gram[-n:], gram[-n:-1]
            followers = {g: c for g, c in self.counts[n].items() if g[:-1] == context}
            total = sum(followers.values())
            if total:
                p = max(followers.get(own, 0) - self.discount, 0) / total + self.discount * len(followers) / total * p
        return p


def test_language_models_against_plain_kneser_ney(spark):
    texts = {"aa": ["the stone and the river", "light the stone Ends"], "bb": ["der größe stein", "das licht über grün der"]}
    settings = langid.Settings(order=3)
    counts, plain = {}, {}
    for tongue, own in texts.items():
        words = langid.distinct_words(*text.flat(pa.array(own)))
        often = np.bincount(words.word, minlength=len(words))
        starts, word = langid.char_starts(words)
        for n, last, grams, contexts, suffixes in langid._grams(words, 3):
            keys, at, which = np.unique(grams, return_index=True, return_inverse=True)
            table = np.zeros(len(keys), langid._ROW)
            table["gram"], table["context"], table["suffix"] = keys, contexts[at], suffixes[at]
            table["first"] = (starts[last - (n - 1)] == words.bounds[:-1][word[last]])[at]
            table["count"] = np.bincount(which, often[word[last]])
            counts[tongue, n] = table
        plain[tongue] = PlainKneserNey([w.lower() for t in own for w in t.split()], 3, settings.discount)
    models = langid._learn(counts, settings)
    tried = ["the stone", "Über die größe", "zzz river", "", None, "a the the"]
    bits, chars = langid.cross_entropies(pa.array(tried), models)
    again = langid.Remembered(models, keep=3)
    for _ in range(2):
        assert langid.cross_entropies(pa.array(tried), models, again)[0] == pytest.approx(bits)
    alphabet = {g for p in plain.values() for g in p.counts[1]}
    assert models.floor == pytest.approx(1 / (len(alphabet) + 1))
    for i, value in enumerate(tried):
        n = 0
        total = [0.0, 0.0]
        for w in (value or "").replace("Ü", "Ü").split():
            s = f" {w.encode().lower().decode()} "
            for end in range(1, len(s)):
                n += 1
                for j, tongue in enumerate(models.languages):
                    total[j] -= math.log2(plain[tongue].probability(s[max(0, end - 2) : end + 1], models.floor))
        assert chars[i] == n
        assert bits[i] == pytest.approx([x / max(1, n) for x in total], abs=1e-6)


def test_limits_of_the_language_sample(spark):
    rng = random.Random(8)
    rows = [(rng.randint(-(2**63), 2**63 - 1), rng.choice(["aa"] * 9 + ["bb"])) for _ in range(6000)]
    rows += [(i * 2**50, "cc") for i in range(20)] + [(7, "dd")] * 4000 + [(rng.randint(-(2**63), 2**63 - 1), "dd") for _ in range(300)]
    places = spark.createDataFrame(rows, "place long, lang string").repartition(5)
    got = langid.sample_limits(places, 200, 10)
    for tongue in ("aa", "bb", "cc", "dd"):
        own = sorted({p for p, x in rows if x == tongue})
        assert got[tongue] == own[min(200, len(own)) - 1]
    with pytest.raises(ValueError):
        langid.sample_limits(places, 200, 3)
    assert langid.sample_limits(places.where("false"), 200, 3) == {}
    assert places.where(F.col("place").isNull()).count() == 0
