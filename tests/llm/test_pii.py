import re

import pytest

from cairnspark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def good(kind, part):
        digits = re.sub("[^0-9]", "", part)
        if kind == "ip":
            return all(int(x) <= 255 for x in part.split("."))
        if kind == "card":
            values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in values) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    spans = [(m.start(), m.end(), k) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good(kind, m[0])]
    return sorted(spans, key=lambda s: (s[0], s[2]))


TEXTS = [
    "write to a.b@c.de, or x@y; 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (456) 555-2186 +49 30 1234567 +1",
    "é a@b.c@d.e@f.g.h ..@a.b %@x-.y", "0007.08.9.1 1..2.3.4", "٣.٤.٥.٦ ４111", "a@b. c@.d @e.f g@h.i.", "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_of_chosen_texts(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_random_texts(rng):
    for _ in range(4000):
        text = "".join(rng.choice("0123411111.@a-+ ()%é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain(text)


def test_base_spans_of_long_texts_take_linear_time():
    assert pii.base_spans("1" * 300000 + "." * 10 + "a" * 300000) == []
    assert len(pii.base_spans("a." * 100000 + "@b.c " + "1." * 100001 + "1")) > 1
    assert pii.base_spans("+1" + " " * 300000 + "x") == []


@pytest.fixture(scope="module")
def field():
    import random

    rng = random.Random(5)
    texts = []
    for i in range(160):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        forms = [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"ab{d(2)}@mail.example.com", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.7.{rng.randint(0, 255)}", "4111111111111111"]
        texts.append(f"some words here {forms[i % 4]} and {forms[(i + 1) % 4]} follow here {d(3)}")
    return pii.train(texts)


def test_field_adds_other_forms_and_leaves_plain_numbers(field):
    base, spans = pii.all_spans("please call (555) 123-4567 today", field)
    assert base == [] and spans == [(12, 26, 3)]
    for text in ("on 2024-01-05 we paid 1,234,567 there", "version 2.0.1 of 30 files", "no number at all", "at 12:30 we met"):
        assert pii.all_spans(text, field) == ([], [])


def test_base_spans_stay(field, rng):
    for _ in range(300):
        text = " ".join(rng.choice(TEXTS).split(" ")[0] + rng.choice(["", ".", " 5"]) for _ in range(rng.randint(1, 12)))
        base, spans = pii.all_spans(text, field)
        assert base == plain(text) and set(base) <= set(spans)
        for a, b, k in set(spans) - set(base):
            assert all(b <= c or d <= a for c, d, _ in base)


def test_decoding_finds_the_best_segmentation(field):
    """Against every segmentation of a short text."""
    text = "call (555) 123-4567 or 10.0.0.1"
    words = next(iter(pii.islands(text)))
    scores = pii._scores(field, pii._candidates(text, words))

    def every(i, before):
        if i == len(words):
            yield 0.0, []
        for (a, b), s in scores.items():
            if a == i:
                for t in range(len(s)):
                    for rest, tail in every(b, t):
                        yield s[t] + field.follow[t, before] + rest, ([(*pii.trimmed(text, words[a][0], words[b - 1][1]), t - 1)] if t else []) + tail

    assert pii.decode(field, text, words) == max(every(0, 0), key=lambda x: x[0])[1]


def test_islands_cover_all_hints(rng):
    for _ in range(300):
        text = " ".join(rng.choice(["a", "b1", "@", "c", "7"]) for _ in range(rng.randint(0, 200)))
        words = [w for run in pii.islands(text) for w in run]
        assert len(words) == len(set(words)) and words == sorted(words)
        assert {m.span() for m in re.finditer(r"\S*[0-9@]\S*", text)} <= set(words)


def test_operator(spark, field):
    rows = [(1, None), (2, ""), (3, "a@b.cd x"), (3, "a@b.cd x"), (None, "é 10.0.0.1"), (4, "word " * 50000 + "1.2.3.4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as pii", "1 as base")
    got = {r.doc_id: r.pii for r in pii.find(docs, field).collect()}
    assert [s.asDict() for s in got[3].base] == [{"start": 0, "stop": 6, "kind": "email"}]
    assert got[3].text == "[EMAIL] x" and got[None].text == "é [IP]" and got[1].text is None and got[2].text == ""
    assert got[4].text.endswith("word [IP]") and got[4].base[0].start == 250000
    assert pii.find(docs.where("false"), field).collect() == []
    assert not pii.fit(docs.where("false")).trained
    assert not pii.fit(spark.createDataFrame([("no 1 here",)], "text string")).trained


def test_copies_of_a_text_do_not_fill_the_training_texts(spark):
    texts = [f"no {i} here" for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    lowest = rows.selectExpr("text", "xxhash64(text) as hash").orderBy("hash").head().text
    told = [f"write to ab{i}@mail.example.com, or call {i}" for i in range(4)]
    docs = spark.createDataFrame([(t,) for t in [lowest] * 40 + told * 3 + texts], "text string").repartition(3)
    got = [r.text for r in pii.training_texts(docs, sample_rows=10).collect()]
    assert len(got) == len(set(got)) == 10 and set(told) <= set(got) and lowest in got
    assert pii.fit(docs, sample_rows=10).trained


def test_long_islands_are_decoded_whole(field):
    assert [len(run) for run in pii.islands("7 " * 1000)] == [1000]
    for k in range(58, 70):
        text = "2024-01-05 " * k + "(555) 123-4567" + " 2024-01-05" * 5
        assert (11 * k, 11 * k + 14, 3) in pii.all_spans(text, field)[1], k


def test_training_parts_keep_spans_whole():
    text = "7 " * 200
    words = next(iter(pii.islands(text)))
    parts = list(pii.training_parts(words, [(126, 131, 3)]))
    assert [w for part in parts for w in part] == words and [len(p) for p in parts] == [66, 64, 64, 6]
