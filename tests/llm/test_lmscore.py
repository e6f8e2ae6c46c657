import math
import re
from collections import Counter

import pytest

from cairnspark.llm import lmscore


def plain(rows, order, least=2, alpha=0.4):
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    count = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for (doc, _), w in zip(rows, words):
        log, found, twice = 0.0, 0, 0
        for i in range(len(w)):
            longest = min(order, i + 1)
            twice += count[tuple(w[i - longest + 1 : i + 1])] > 1
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or count[gram] >= least:
                    log += math.log(count[gram] / (count[gram[:-1]] if n > 1 else total)) + (longest - n) * math.log(alpha)
                    found += n == longest
                    break
        out.append((doc, len(w), found, twice, log))
    return out


@pytest.mark.parametrize("order,block,bucket,least", [(1, 8 << 20, 1 << 21, 1), (2, 200, 5, 2), (3, 1000, 40, 1), (3, 8 << 20, 40, 3), (5, 4000, 100, 1)])
def test_equals_plain_counts(spark, prose, rng, order, block, bucket, least):
    rows = [(i, prose(rng.choice([0, 1, 2, 30, 90]))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "!! ,"), (43, "the " * 500), (43, "the " * 500), (None, "the river and THE River")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as block", "0 as n")
    settings = lmscore.Settings(order=order, block_bytes=block, bucket_entries=bucket, least_count=least)
    got = [tuple(r) for r in lmscore.score(docs, settings).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(got, key=key), sorted(plain(rows, order, least), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)


def test_no_rows(spark):
    assert lmscore.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only_empty = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in lmscore.score(only_empty).collect()] == [(1, 0, 0, 0, 0.0)]


def test_settings_cut_nothing():
    assert lmscore.Settings().order >= 3 and lmscore.Settings().least_count == 1
