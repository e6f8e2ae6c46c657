import itertools
import re

import numpy as np
import pytest
import xxhash

from cairnspark.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_print(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            top[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(
        ((d, p, least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr
    )


def found(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as component_id")
    out = simhash.groups(docs, settings=simhash.Settings(**settings)).collect()
    return sorted(((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in out), key=repr)


@pytest.mark.parametrize("tile", [2048, 3])
def test_equals_brute_force(spark, prose, rng, tile):
    rows = []
    for i in range(60):
        text = prose(rng.choice([1, 2, 3, 5, 40, 400, 900]))
        rows.append((rng.randint(0, 10**6), text))
        if i % 3 == 0:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            rows.append((rng.randint(0, 10**6), "\n ".join(words)))
    rows += [(5, None), (3, ""), (9, " \t\n"), (None, "a B c"), (8, "A b C"), (8, "A b C"), (None, "only null here")]
    assert found(spark, rows, tile=tile) == plain_groups(rows)


def test_long_chain_of_close_prints(spark, monkeypatch):
    # Neighbours differ by three bits, the ends by far more: one group.
    prints, value = [], 0
    for i in range(40):
        value ^= 0b111 << (i % 20 * 3)
        prints.append((value,))
    df = spark.createDataFrame(list({p for p in prints}), "fingerprint long")
    edges = simhash.links(df, simhash.Settings(tile=2))
    from cairnspark.llm.components import connected_components

    tops = {r.component for r in connected_components(edges).collect()}
    assert len(tops) == 1


def test_no_rows(spark):
    assert found(spark, []) == []


def test_tile_steps_cover_the_radius():
    rng = np.random.default_rng(1)
    steps = set(simhash._steps(3))
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.integers(0, 64, 3):
            b ^= 1 << int(bit)
        count = [[(x >> 16 * i & 0xFFFF).bit_count() for i in range(4)] for x in (a, b)]
        step = tuple(y - x for x, y in zip(*count))
        assert step in steps or tuple(-s for s in step) in steps
