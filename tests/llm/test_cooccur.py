from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from bytegrove.llm import cooccur


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "b string, i string, item string, basket int")
    return {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccur.pair_counts(df, F.col("b"), F.col("i"), **kw).collect()}


def brute(rows, least=1):
    baskets = defaultdict(set)
    for b, i, *_ in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    one, two = Counter(), Counter()
    for items in baskets.values():
        one.update(items)
        two.update(combinations(sorted(items), 2))
    return {p: (c, one[p[0]], one[p[1]], len(baskets)) for p, c in two.items() if c >= least}


def data(n=1500):
    rng = random.Random(2)
    rows = [(f"b{rng.randrange(120)}", rng.choice(["everywhere", *(f"i{int(rng.paretovariate(1)) % 40}" for _ in range(1)), "Z", "é"]), None, 1) for _ in range(n)]
    return rows + rows[:100] + [(None, "x", None, 0), ("b1", None, None, 0)]


def test_against_combinations(spark):
    rows = data()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_pair=5) == brute(rows, 5)


def test_large_baskets_and_flushes(spark, monkeypatch):
    rows = [("big", f"i{k:03d}", None, 0) for k in range(130)] + [("b2", f"i{k:03d}", None, 0) for k in range(0, 130, 3)] + [("one", "i000", None, 0)]
    monkeypatch.setattr(cooccur, "BLOCK", 16)
    assert run(spark, rows) == brute(rows)
    left = [["a", "b", "c"], ["b", "c"], ["c", "d"]]
    import pyarrow as pa

    monkeypatch.setattr(cooccur, "ENTRIES", 1)
    batch = pa.RecordBatch.from_arrays([pa.array(left), pa.array([None] * 3, pa.list_(pa.string()))], names=["l", "r"])
    total = Counter()
    parts = list(cooccur._add_baskets(iter([batch])))
    want = Counter({("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 2, ("c", "d"): 1})
    rows = sorted(r for out in parts for r in zip(*(c.to_pylist() for c in out.columns)))
    for a, _, s in rows:
        total.update({(a, b): n for b, n in s})
    assert total == want and len(rows) == 5
    ordered = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2]), cooccur._SCHEMA)], schema=cooccur._SCHEMA) for i in (0, 2, 4)]
    merged = [r for out in cooccur._merge_stripes(iter(ordered)) for r in zip(*(c.to_pylist() for c in out.columns))]
    assert Counter({(a, b): n for a, _, s in merged for b, n in s}) == want and len({(a, k) for a, k, _ in merged}) == len(merged)


def test_no_block_of_a_large_basket_holds_it_whole(spark, monkeypatch):
    """One basket holds most rows: it is met in blocks of about BLOCK items, each two of them once."""
    monkeypatch.setattr(cooccur, "BLOCK", 20)
    rows = [("big", f"i{k:03d}", None, 0) for k in range(200)] + [(f"s{k}", f"i{k:03d}", None, 0) for k in range(40)]
    df = spark.createDataFrame(rows, "b string, i string, item string, basket int")
    sizes = []
    real = cooccur.lookup_join
    monkeypatch.setattr(cooccur, "lookup_join", lambda l, r, k, how: (sizes.append((how, r.collect())), real(l, r, k, how))[1])
    assert cooccur.pair_counts(df, F.col("b"), F.col("i")).count() == 200 * 199 // 2
    assert {h for h, _ in sizes} == {"left_anti", "inner"} and sizes[0][1][0].blocks == 20


def test_significance(spark):
    rows = data()
    df = spark.createDataFrame(rows, "b string, i string, x string, y int")
    for r in cooccur.cooccurrence(df, F.col("b"), F.col("i")).collect():
        k = [r.n_ab, r.n_a - r.n_ab, r.n_b - r.n_ab, r.n - r.n_a - r.n_b + r.n_ab]
        e = [r.n_a * r.n_b / r.n, r.n_a * (r.n - r.n_b) / r.n, (r.n - r.n_a) * r.n_b / r.n, (r.n - r.n_a) * (r.n - r.n_b) / r.n]
        assert math.isclose(r.llr, 2 * sum(o * math.log(o / x) for o, x in zip(k, e) if o), abs_tol=1e-6)
        assert math.isclose(r.lift, r.n_ab * r.n / r.n_a / r.n_b)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [("b", "only", None, 0)]) == {}
