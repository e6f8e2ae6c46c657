import math
import re
from collections import Counter

import pytest

import check
from cairnspark.llm import lexical
from cairnspark.llm.queries import ORACLES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [t.encode().lower().decode() for t in TERM.findall(text or "")]


def brute(docs, items, best):
    bags = [(i, Counter(terms(text))) for i, text in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            score = 0
            for t in set(terms(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b in bags) + 1)))
                    m = 10 + 90 * sum(bag.values()) * n_docs // n_words
                    score += w * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [lexical.Settings(), lexical.Settings(best=3, block_bytes=60)])
def test_search_against_brute_force(spark, prose, rng, settings):
    docs = [(i, prose(rng.choice([3, 20, 60]))) for i in range(70)]
    docs += [(None, docs[3][1]), (None, docs[4][1]), (900, None), (901, ""), (902, "--- !"), (903, "THE the\x7fThe a_b Étoile"), docs[5], docs[5]]
    items = [(i, prose(rng.choice([1, 4, 9]))) for i in range(9)]
    items += [(50, None), (51, "?"), (52, "absent"), (None, items[2][1]), (2, items[2][1]), (53, "a b the THE"), (54, docs[6][1])]
    got = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_terms", "'x' as terms").repartition(4),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "'x' as score"),
        settings,
    )
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, settings.best)


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = rows.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(rows.where("false"), items).collect() == [] == lexical.search(rows, items.where("false")).collect()
    # One document that holds every term: (2 * 1 + 2) / (2 * 1 + 1)
    assert lexical.search(rows, items).first()["score"] > 0


def test_sql_twin_equals_brute_force():
    connection = check.connect("/root/testdata/sf0.001")
    docs = connection.sql("SELECT doc_id, text FROM documents").fetchall()
    items = connection.sql("SELECT item_id, text FROM benchmark").fetchall()[:12]
    got = [r for r in connection.sql(ORACLES["op13_ranked_search"]).fetchall() if r[0] in dict(items)]
    assert sorted(got, key=repr) == brute(docs, items, 10)


def test_many_candidates_are_settled_in_between(rng):
    import numpy as np

    rows = [(rng.randrange(3), rng.randrange(1, 400), rng.randrange(50)) for _ in range(60000)]
    held = lexical._Best(3, 10)
    for at in range(0, len(rows), 700):
        item, score, doc = (np.array(x, np.int64) for x in zip(*rows[at : at + 700]))
        held.add(item, score, np.zeros(len(item), np.int64), doc)
    held.settle()
    got = sorted(zip(held.rows[0].tolist(), held.rows[1].tolist(), held.rows[3].tolist()))
    want = [x for i in range(3) for x in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[1], r[2]))[:10]]
    assert got == sorted(want)
