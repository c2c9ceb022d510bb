from __future__ import annotations

import random

import numpy as np
import pytest

import bytegrove.llm.leakage as L
from bytegrove.llm.leakage import align, find_leaks, passage, slot_types, window_keys
from bytegrove.llm.textnorm import tokens

EN = "Inspector {} {} counted {} broken {} beside {}, although {} from {} had reported only {}."
EN2 = "In {} the weavers of {} traded {} painted {} for hollow {}, which {} later hid under gilded {}."
ZH = "检查员{}在{}旁边数出{}件{}的灯笼，而{}只申报了{}件。"
SYL = ["zan", "mor", "tel", "kar", "vel", "ros", "dun", "pel", "gar", "lim"]
THINGS = ["kilns", "looms", "glass", "ropes", "tiles"]
HAN = "溪新石光海岑柏方恩西平安定秋文"


def name(rng):
    return "".join(rng.choice(SYL) for _ in range(3)).title()


def item(rng, zh=False):
    n = lambda: rng.randrange(100, 9999)
    if zh:
        h = lambda: "".join(rng.choice(HAN) for _ in range(4))
        return "".join(ZH.format(h(), h(), n(), rng.choice(["腌制", "空心"]), h(), n()) for _ in range(3))
    t = lambda: rng.choice(THINGS)
    return " ".join([EN.format(name(rng), name(rng), n(), t(), name(rng), t(), name(rng), n()), EN2.format(n(), name(rng), n(), t(), t(), name(rng), t())])


def setting():
    rng = random.Random(7)
    items = {i: item(rng) for i in range(25)} | {i: item(rng, True) for i in range(25, 40)}
    a, z = items[3], items[30]
    words = a.split()
    half = " ".join(words[4:22])
    dropped = [w for i, w in enumerate(words) if i % 7 != 3]
    docs = {
        0: f"Thank you. {a} That is all.", 1: a.upper().replace(",", ""), 2: f"The annex says “{half}” and no more.", 3: "Quote: " + " ".join(words[:7]) + " end.",
        4: " ".join(dropped), 5: item(rng), 6: " ".join(words[:12]) + " (Laughter. Order, order!) " + " ".join(words[12:]), 7: a.replace("counted", "coun-\nted").replace("beside", "be­side"),
        8: z, 9: z[20:70] + "。他说", 10: item(rng, True), 11: z[:12], 12: a.translate(str.maketrans("0123456789", "０１２３４５６７８９")), 13: "", 14: None, 15: a + " " + items[4],
    }
    want = {(0, 3), (1, 3), (2, 3), (4, 3), (6, 3), (7, 3), (8, 30), (9, 30), (12, 3), (15, 3), (15, 4)}
    return items, docs, want


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(k, v, 1) for k, v in items.items()], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id) for r in find_leaks(d, e, **kw).collect()}


def test_forms_of_leaks(spark):
    items, docs, want = setting()
    assert run(spark, docs, items) == want


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    items, docs, want = setting()
    monkeypatch.setattr(L, "MAX_BITS", L.CHUNK)
    monkeypatch.setattr(L, "_bitmap", lambda index, n: np.full(8192, 255, np.uint8))
    assert run(spark, docs, items) == want


def brute(docs, items):
    out = set()
    for d, text in docs.items():
        for i, t in items.items():
            a, b = tokens(t or ""), tokens(text or "")
            if a and b and passage(a, b, 0.4, 0.75):
                out.add((d, i))
    return out


def test_candidates_lose_nothing_against_alignment_of_all(spark):
    items, docs, _ = setting()
    assert run(spark, docs, items) == brute(docs, items)


WORDS = [a + b + c for a in SYL for b in SYL for c in ("", "ia", "on", "es")]


def altered(rng, words, rate):
    """Words of which a part is replaced or left out."""
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 2:
            continue
        out.append("odd" + str(rng.randrange(100)) + "x" if r < rate else w)
    return out


@pytest.mark.parametrize("n, times, digits", [(1, 1, True), (1, 1, False), (2, 1, False), (30, 1, False), (30, 3, True)])
def test_recall_whatever_the_size_of_the_set(spark, n, times, digits):
    """Sets of one item or many, each once or several times, with digits or without: every altered copy is found."""
    rng = random.Random(n)
    texts = [" ".join(rng.choice(WORDS) + (str(rng.randrange(99)) if digits and rng.random() < 0.2 else "") for _ in range(rng.randrange(25, 70))) for _ in range(n)]
    items = {100 * k + i: t for k in range(times) for i, t in enumerate(texts)}
    docs = {}
    for d in range(60):
        i = rng.randrange(n)
        w = texts[i].split()
        length = rng.randrange(7 * len(w) // 10, len(w) + 1)
        at = rng.randrange(len(w) - length + 1)
        docs[d] = " ".join(["Thank", "you"] + altered(rng, w[at : at + length], 0.12) + ["that", "is", "all"])
    got, want = run(spark, docs, items), brute(docs, items)
    assert got <= want and len(got) >= 0.97 * len(want)
    assert len({d for d, _ in got}) >= 0.9 * len(docs)


def test_short_items(spark):
    items = {1: "tea", 2: "green tea", 3: "the old mill burns", 4: "one two three four five six seven eight nine ten", 5: "茶", 6: "", 7: None}
    docs = {1: "we drink green tea here", 2: "the old mill burns again", 3: "one two three four five six", 4: "nothing", 5: "他喝茶吗", 6: "seven eight one two", 7: "mill the old"}
    assert run(spark, docs, items) == brute(docs, items)


def test_ids_that_repeat_or_are_null(spark):
    rng = random.Random(9)
    a, b, c = item(rng), item(rng), item(rng)
    d = spark.createDataFrame([(1, a), (1, b), (None, c), (2, c)], "doc_id long, text string")
    e = spark.createDataFrame([(7, a), (7, b), (None, a), (None, c), (8, a.upper())], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, e).collect()} == {(1, 7), (1, None), (1, 8), (None, None), (2, None)}


def test_a_long_remark_does_not_split_a_passage(spark):
    rng = random.Random(12)
    a = item(rng).split()
    half = len(a) // 4
    remark = [f"w{i}" for i in range(2000)]
    docs = {1: " ".join(a[: half + 2] + remark + a[half + 2 : 2 * half + 4])}
    assert run(spark, docs, {1: " ".join(a)}) == {(1, 1)}


def test_empty_and_null(spark):
    assert run(spark, {}, {1: "some text here"}) == set()
    assert run(spark, {1: "some text here 12"}, {}) == set()
    assert run(spark, {1: None, 2: ""}, {1: None, 2: ""}) == set()
    long = " ".join(f"w{i}" for i in range(30_000))
    assert run(spark, {1: long}, {1: "alpha beta 77 gamma delta"}) == set()


def test_items_without_template_words(spark):
    rng = random.Random(3)
    items = {1: item(rng), 2: item(rng, True)}
    a, z = items[1].split(), items[2]
    docs = {1: f"Thank you. {items[1]} That is all.", 2: " ".join(a[4:22]), 3: "他说" + z, 4: " ".join(a[:6]), 5: item(random.Random(4)), 6: None}
    assert run(spark, docs, items) == {(1, 1), (2, 1), (3, 2)}
    assert run(spark, docs, {1: items[1]}) == {(1, 1), (2, 1)}


def test_alignment():
    a = "the 12 red cats of Zan met 40 dogs near Pel".lower().split()
    assert align(a, a)[1:] == (11, 11)
    assert align(a, ["x"] * 5)[1:] == (0, 0)
    assert align(a, a[:5] + ["remark"] * 10 + a[5:])[1:] == (11, 11)
    assert align(a, a[:6] + ["other"] + a[7:])[1:] == (11, 10)


def test_slots_and_windows():
    of = L._Hashes()
    h = lambda t: np.array([of[x] for x in tokens(t)], np.uint64)
    assert slot_types(h("Inspector Zan counted 12 kilns twice")).tolist() == [2, 2, 2, 0, 1, 2]
    one, other = h("a b 12 kilns c"), h("a b 17 kilns c")
    same = [bool(x[0] == y[0]) for (_, x), (_, y) in zip(window_keys(one), window_keys(other))]
    assert same == [False, False, True, False]  # only the window with the number open
    assert [len(k) for _, k in window_keys(h("a b"), (1, 2))] == [2, 1, 0, 0, 0, 0]


def test_density_never_hides_a_passage():
    from bytegrove.llm.leakage import dense, shortest

    rng = random.Random(11)
    for _ in range(4000):
        n = rng.randrange(1, 40)
        a = [f"a{i}" for i in range(n)]
        lo = rng.randrange(n)
        part = a[lo : lo + rng.randrange(1, n + 1)]
        b = [t if rng.random() < 0.8 else "x" for t in part if rng.random() < 0.95]
        _, span, same = align(a, b) if b else (0, 0, 0)
        if span >= shortest(n, 0.4, 0.75) and same >= 0.75 * span:
            assert dense(a, b, 0.4, 0.75)
