import itertools
import re

from cairnspark.llm import decontaminate


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, least=13, identity=0.8):
    """Every item laid over every place of every document."""
    found = {}
    for doc, text in docs:
        w = words(text)
        for item, own in items:
            v = words(own)
            if not v or (len(v) < 5 and v != w):
                continue
            for shift in range(-len(v) + 1, len(w)):
                low, high = max(0, -shift), min(len(v), len(w) - shift)
                start, end = decontaminate.best_stretch(decontaminate.np.array([v[i] == w[i + shift] for i in range(low, high)], bool))
                equal = sum(v[i] == w[i + shift] for i in range(low + start, low + end))
                if end - start >= min(least, len(v)) and equal >= identity * (end - start) and equal:
                    found[doc, item] = max(found.get((doc, item), 0), equal)
    return found


def test_equals_brute_force(spark, rng):
    make = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    items = [(i, make(rng.randint(15, 40))) for i in range(12)] + [(12, make(6)), (13, make(3)), (14, "one"), (15, ""), (16, None)]
    items += [(17, items[0][1]), (None, items[1][1]), (18, make(9)), (19, make(8))]
    docs = [(i, make(rng.randint(0, 60))) for i in range(15)]
    for i, (item, own) in enumerate(items):
        if own:
            inside = own.split()
            for k in range(len(inside) // 12):
                inside[12 * k + rng.randrange(10)] = "Changed"
            docs.append((100 + i, f"{make(20)}\n{' '.join(inside)}, {make(9)}"))
            docs.append((200 + i, own.upper()))
    docs += [(300, None), (301, "one"), (302, "one one"), (100, docs[20][1]), (303, f"{make(70000)} {items[3][1]}")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as seed", "2 as item")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words")
    rows = decontaminate.overlaps(d, b).collect()
    got = {(r.doc_id, r.item_id): r.n_equal for r in rows}
    short = [x for x in docs if len(x[1] or "") < 10000]
    assert {k: v for k, v in got.items() if k[0] != 303} == plain(short, items)
    assert got[303, 3] == len(items[3][1].split())
    for r in rows:
        assert r.n_equal >= 0.8 * r.n_words
    dirty = {k[0] for k in got}
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in dirty)


def test_chance_matches_do_not_count(spark, rng):
    common = "the of and to in a is it".split()
    make = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(i, make(100)) for i in range(20)]
    items = [(1, make(30))]
    got = decontaminate.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id): r.n_equal for r in got} == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.overlaps(docs.where("false"), items).collect() == []
    assert decontaminate.overlaps(docs, items.where("false")).collect() == []
    assert len(decontaminate.overlaps(docs, items).collect()) == 1


def every_stretch(equal, least):
    """Most equal words of any stretch of ``least`` words or more of which four fifths are equal; 0 if there is none."""
    sizes = ((sum(equal[i:j]), j - i) for i in range(len(equal)) for j in range(i + max(1, least), len(equal) + 1))
    return max((n for n, size in sizes if 5 * n >= 4 * size), default=0)


def test_best_stretch_equals_every_stretch(rng):
    for _ in range(3000):
        n = rng.randint(1, 30)
        equal, least = [rng.random() < 0.75 for _ in range(n)], rng.randint(5, 13)
        start, end = decontaminate.best_stretch(decontaminate.np.array(equal), least)
        assert sum(equal[start:end]) == every_stretch(equal, min(least, n))
        assert start == end == 0 or (end - start >= min(least, n) and 5 * sum(equal[start:end]) >= 4 * (end - start))


def test_a_seed_fits_whichever_fifth_is_substituted():
    for n in range(decontaminate.SHINGLE, 16):
        own = decontaminate.np.arange(1, n + 1).astype("uint64")
        short = (n,) if n == decontaminate.SHINGLE else ()
        edges = decontaminate.np.array([0, n])
        seeds = set(zip(*(x.tolist() for x in decontaminate.seeds(own, edges, short))))
        for changed in itertools.combinations(range(n), n // 5):
            other = own.copy()
            other[list(changed)] += decontaminate.np.uint64(100)
            assert seeds & set(zip(*(x.tolist() for x in decontaminate.seeds(other, edges, short)))), (n, changed)


def test_finds_short_items_wherever_a_word_is_substituted(spark):
    docs, items = [], []
    for n in (5, 6, 8, 9, 10, 12, 13, 15, 20):
        own = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        for k in range(n):
            inside = [*own[:k], "changed", *own[k + 1 :]]
            docs.append((100 * n + k, f"some words before {' '.join(inside)} and some behind"))
    docs.append((1, "i10w0 x i10w2 i10w3 i10w4 y z i10w7 i10w8 i10w9"))
    rows = decontaminate.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = {}
    for n, own in items:
        for k in range(n):
            longest = every_stretch([i != k for i in range(n)], min(13, n))
            want[100 * n + k, n] = longest
    assert {(r.doc_id, r.item_id): r.n_equal for r in rows} == want


def test_clean_keeps_nulls_and_clashing_columns(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, passage), (1, passage), (2, passage), (3, None), (None, "quite another text"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as content", "'y' as __content", "7 as item_id")
    items = spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.content, r["__content"]) for r in kept.collect()) == [(0, "x", "y"), (3, "x", "y"), (4, "x", "y")]
    assert decontaminate.clean(docs, items.where("false")).count() == len(rows)
    assert decontaminate.clean(docs.where("false"), items).collect() == []
