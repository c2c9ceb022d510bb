from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from bytegrove.operators.skew import HOT_SHARE, hot_keys, lookup_join, value_frequencies, weighted_percentiles, weighted_profile


def data():
    rng = random.Random(3)
    rows = [("hot", rng.randrange(40)) for _ in range(3000)] + [(f"k{rng.randrange(300)}", rng.randrange(5)) for _ in range(1500)]
    return rows + [(None, 1), ("k1", None), ("none", None)]


def test_lookup_join_splits_hot_keys(spark):
    rows = data()
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 9)], "k string, w int")
    assert hot_keys(left, "k") == ["hot"]
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = lookup_join(left, right, "k", how), left.join(right, "k", how)
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    assert len(hot_keys(spark.range(1000).withColumn("k", F.col("id")), "k", HOT_SHARE)) <= HOT_SHARE
    assert hot_keys(left.limit(0), "k") == []


def test_profiles_from_weighted_values(spark):
    rows = data()
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in rows], "k string, v int, weight int, value string")
    freq = value_frequencies(df, ["k"], F.col("v"))
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    for r in weighted_profile(freq, "k").collect():
        known = [v for v in by[r.k] if v is not None]
        top = min(((-n, v) for v, n in Counter(known).items()), default=(None, None))
        assert (r.n_rows, r.n_distinct, r.mode_value, r.mode_rows) == (len(by[r.k]), len(set(known)), top[1], -top[0] if known else None)
    got = {r.k: (r.a, r.b, r.c) for r in weighted_percentiles(freq, "k", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None)
        if known:
            at = lambda p: known[max(0, -(-int(p * 4) * len(known) // 4) - 1)]
            assert got[k] == (at(0.25), at(0.5), at(1.0))
        else:
            assert k not in got


def test_empty(spark):
    freq = value_frequencies(spark.createDataFrame([], "k string, v int"), ["k"], F.col("v"))
    assert weighted_profile(freq, "k").count() == weighted_percentiles(freq, "k", {"a": 0.5}).count() == 0


def test_scratch_tables_are_dropped_and_cleared(spark):
    import os

    from bytegrove import scratch

    sc = scratch.Scratch(spark, "test")
    a, b = sc.save(spark.range(3).toDF("x")), sc.save(spark.range(5).toDF("x"))
    assert (a.count(), b.count()) == (3, 5) and len(os.listdir(sc.root)) == 2
    sc.drop(a, None)
    assert len(os.listdir(sc.root)) == 1 and b.count() == 5
    kept, scratch._ROOTS[:] = [r for r in scratch._ROOTS if r[1] != sc.root], [(spark, sc.root)]
    scratch.clear()
    scratch._ROOTS.extend(kept)
    assert not os.path.exists(sc.root)


def test_checkpoint_folder_is_the_sessions(spark, monkeypatch):
    from bytegrove import scratch

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Session:
        def __init__(self, **kw):
            self.conf = Conf(kw)

    assert scratch.checkpoint_dir(Session(**{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    import pytest

    with pytest.raises(RuntimeError):
        scratch.checkpoint_dir(Session(**{"spark.master": "spark://h:7077"}))
