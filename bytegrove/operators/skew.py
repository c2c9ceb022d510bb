"""Work per key when a few keys hold most rows.

``lookup_join`` splits hot keys off a shuffle join; ``value_frequencies`` and ``weighted_profile`` give exact
per-key results from (key, value, weight) rows, so that a key's cost is that of its distinct values, spread
over many tasks, and not that of its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bytegrove.scratch import Scratch

#: A key is hot if it holds at least one row in HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 128


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Keys with at least ``1/share`` of the rows: at most ``share`` of them, whatever the data. Null is none."""
    total = df.count()
    if not total:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n__"))
    return sorted(r[0] for r in counts.where(F.col("n__") * share >= total).select(key).collect())


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """``left`` joined to ``right``, which holds a key once at most; ``how`` is inner, left, left_semi or left_anti.

    Rows of hot keys meet a broadcast of the at most ``HOT_SHARE`` right rows of these keys, all others are
    shuffled. Null keys match nothing. ``left`` should be a written table, as it is read more than once.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def value_frequencies(df: DataFrame, keys: list[str], value: Column, *, name: str = "value", weight: str = "weight") -> DataFrame:
    """(keys, value, weight): each distinct value of a key once, with the rows that hold it. Null is a value here."""
    return df.select(*keys, value.alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias(weight))


def weighted_profile(freq: DataFrame, key: str, *, value: str = "value", weight: str = "weight") -> DataFrame:
    """(key, n_rows, n_distinct, mode_value, mode_rows) from distinct values with weights.

    Null values count as rows and as nothing else. The mode is the value with most rows, of these the smallest;
    it is null where all values are. Every part is an aggregate with map-side combine.
    """
    known = F.col(value).isNotNull()
    best = F.min(F.when(known, F.struct((-F.col(weight)).alias("w"), F.col(value).alias("v"))))
    return (
        freq.groupBy(key)
        .agg(F.sum(weight).alias("n_rows"), F.sum(known.cast("long")).alias("n_distinct"), best.alias("b__"))
        .select(key, "n_rows", "n_distinct", F.col("b__.v").alias("mode_value"), (-F.col("b__.w")).alias("mode_rows"))
    )


def weighted_percentiles(
    freq: DataFrame, key: str, fractions: dict[str, float], *, value: str = "value", weight: str = "weight"
) -> DataFrame:
    """(key, one column per fraction): the smallest value with at least that fraction of the key's rows up to it.

    Exact (no sketch). The distinct values are range-partitioned by (key, value), so a key of many values spans
    partitions; each partition adds up its own weights and starts from the sum of the key's earlier partitions.
    Null values are left out; a key with no other value gives no row, a null key is a key.
    """
    scratch = Scratch(freq.sparkSession, "percentiles")
    ranged = scratch.save(
        freq.where(F.col(value).isNotNull())
        .select(key, value, weight)
        .repartitionByRange(F.col(key), F.col(value))
        .withColumn("part__", F.spark_partition_id()),
        "ranged",
    )
    per_key = Window.partitionBy(key)
    parts = (
        ranged.groupBy(key, "part__")
        .agg(F.sum(weight).alias("w__"))
        .withColumn("before__", F.coalesce(F.sum("w__").over(per_key.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total__", F.sum("w__").over(per_key))
        .select(F.col(key).alias("key__"), F.col("part__").alias("of__"), "before__", "total__")
    )
    running = ranged.withColumn("in__", F.sum(weight).over(Window.partitionBy(key, "part__").orderBy(value)))
    same = F.col(key).eqNullSafe(F.col("key__")) & (F.col("part__") == F.col("of__"))
    cum = running.join(parts, same).withColumn("cum__", F.col("before__") + F.col("in__"))
    picks = [
        F.min(F.when(F.col("cum__") >= F.ceil(F.lit(p) * F.col("total__")), F.col(value))).alias(n) for n, p in fractions.items()
    ]
    return cum.groupBy(key).agg(*picks)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Rows with their number from 0 in an order, as ``name``. The rows are range-partitioned by the order and each range is
    numbered from the sum of those before it, so no task orders all rows; the driver gets a count per range."""
    scratch = Scratch(df.sparkSession, "numbered")
    ranged = scratch.save(df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()), "ranged")
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("part__").count().collect()):
        before[part], total = total, total + n
    if not before:
        return ranged.drop("part__").withColumn(name, F.lit(0).cast("bigint"))
    start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    within = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    return ranged.withColumn(name, (within - 1 + F.element_at(start, F.col("part__"))).cast("bigint")).drop("part__")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
