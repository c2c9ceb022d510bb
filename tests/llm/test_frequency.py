from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from bytegrove.llm.frequency import term_frequencies


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "kind string, term string, record string, row_key int, n string, mark int")
    return {(r.kind, r.term): (r.n, r.n_records, r.total_records, r.mark) for r in term_frequencies(df, F.col("kind"), F.col("term"), F.col("record"), F.col("row_key"), **kw).collect()}


def brute(rows):
    occ, rec, total = defaultdict(set), defaultdict(set), defaultdict(set)
    for kind, term, record, key, *_ in rows:
        if record is not None:
            total[kind].add(record)
        if term is not None:
            occ[kind, term].add((record, key))
            if record is not None:
                rec[kind, term].add(record)
    out = {}
    for k in occ:
        n, t = len(rec[k]), len(total[k[0]])
        out[k] = (len(occ[k]), n, t, "rare" if n < 3 else "common" if n * 10 >= t else None)
    return out


def test_against_sets(spark):
    rng = random.Random(1)
    rows = [("a", "hot", f"r{rng.randrange(60)}", rng.randrange(3), None, None) for _ in range(2000)]
    rows += [(rng.choice("ab"), rng.choice([None, "", *(f"t{i}" for i in range(80))]), rng.choice([None, *(f"r{i}" for i in range(90))]), rng.randrange(4), "x", 1) for _ in range(3000)]
    rows += rows[:500] + [("b", "once", "r1", 0, None, None)]
    rng.shuffle(rows)
    got = run(spark, rows)
    assert got == brute(rows)
    assert {v[3] for v in got.values()} == {"rare", "common", None}


def test_runs_cross_batches_and_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("k", f"t{i % 3}", f"r{i % 50:02d}", i % 2, None, None) for i in range(700)]
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_record_spans_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("k", "one", "r1", i, None, None) for i in range(4000)] + [("k", "two", f"r{i % 2}", i, None, None) for i in range(4000)]
        rows += [("k", "nowhere", None, i, None, None) for i in range(2000)] + [("k", f"t{i % 7}", f"s{i % 40}", i % 3, None, None) for i in range(2000)]
        got = run(spark, rows)
        assert got == brute(rows)
        assert got["k", "one"] == (4000, 1, 42, "rare") and got["k", "two"] == (4000, 2, 42, "rare")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_nulls_and_long(spark):
    assert run(spark, []) == {}
    rows = [("k", None, "r", 1, None, None), ("k", "x" * 100_000, None, None, None, None)]
    assert run(spark, rows) == {("k", "x" * 100_000): (1, 0, 1, "rare")}
