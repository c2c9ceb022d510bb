"""Items that appear together: exact pair counts by stripes, with the log-likelihood ratio against chance.

A stripe is an associative array from an item to its neighbours' counts. Each task adds the baskets it reads into stripes
and passes on slices of them, which meet by (item, slice) and are merged as arrays: what is shuffled are merged counts and
never the pairs of a basket, and the stripe of an item that is everywhere is spread over as many tasks as it has slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bytegrove.operators.skew import lookup_join
from bytegrove.scratch import Scratch

#: Items of one basket that are held in one array, about; a larger basket is cut into blocks that meet two by two.
BLOCK = 512
#: Entries of a task's stripes after which they are passed on.
ENTRIES = 400_000
#: Slices of a stripe, by a hash of the neighbour.
SLICES = 16
#: Log-likelihood ratio from which on a pair is more than chance: the 95 % point of chi-square with one degree of freedom.
SIGNIFICANT = 3.841458820694124

_STRIPES = "item_a string, slice int, neighbours map<string,bigint>"
_SCHEMA = pa.schema([("item_a", pa.string()), ("slice", pa.int32()), ("neighbours", pa.map_(pa.string(), pa.int64()))])


def _batches(stripes: list[tuple[str, int, dict[str, int]]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(stripes), 2000):
        a, k, s = zip(*stripes[i : i + 2000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(k, pa.int32()), pa.array([list(x.items()) for x in s], _SCHEMA.field(2).type)], schema=_SCHEMA)


def _add_baskets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the baskets read; the input is (left, right): pairs come from left x right, or from left alone if right is null."""
    stripes: dict[str, dict[str, int]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        sliced: list[tuple[str, int, dict[str, int]]] = []
        for a, stripe in stripes.items():
            parts: dict[int, dict[str, int]] = {}
            for b, n in stripe.items():
                parts.setdefault(zlib.crc32(b.encode("utf-8", "surrogatepass")) % SLICES, {})[b] = n
            sliced.extend((a, k, p) for k, p in parts.items())
        yield from _batches(sliced)

    def add(a: str, others: list[str]) -> int:
        stripe = stripes.setdefault(a, {})
        before = len(stripe)
        for b in others:
            stripe[b] = stripe.get(b, 0) + 1
        return len(stripe) - before

    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if right is None:
                left = sorted(left)  # str order is by code points
                for i, a in enumerate(left[:-1]):
                    held += add(a, left[i + 1 :])
            else:
                for a in left:
                    held += add(a, [b for b in right if a < b])
                for b in right:
                    held += add(b, [a for a in left if b < a])
            if held >= ENTRIES:
                yield from out()
                stripes, held = {}, 0
    yield from out()


def _merge_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order of (item_a, slice) to one for each: arrays are merged by key as they stream by."""
    last: tuple[str, int] | None = None
    merged: dict[str, int] = {}
    done: list[tuple[str, int, dict[str, int]]] = []
    for batch in batches:
        for a, k, entries in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, k) != last:
                if last is not None:
                    done.append((*last, merged))
                last, merged = (a, k), {}
            for b, n in entries:
                merged[b] = merged.get(b, 0) + n
        if len(done) >= 2000:
            yield from _batches(done)
            done = []
    if last is not None:
        done.append((*last, merged))
    yield from _batches(done)


def pair_counts(baskets: DataFrame, basket: Column, item: Column, *, min_pair: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n): pairs of distinct items with a < b by code points, in at least ``min_pair`` baskets.

    n counts the baskets with any item. Null baskets and items are left out, a repeated row counts once, an empty table
    gives no rows. Items in fewer than ``min_pair`` baskets can't be in a pair and are dropped first, which is exact.
    A basket of any size is fine: beyond BLOCK items its blocks are joined two by two, each two in a task of their own.
    """
    sc = Scratch(baskets.sparkSession, "pairs")
    known = baskets.select(basket.alias("basket"), item.alias("item")).where("basket is not null and item is not null")
    # Everything below is read from the distinct rows, written once.
    rows = sc.save(known.groupBy("basket", "item").agg(F.lit(1).alias("one")).drop("one"), "rows")
    items = sc.save(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "items")
    total = rows.select("basket").distinct().count()
    frequent = rows.join(items.where(F.col("n_item") >= min_pair).select("item"), "item", "left_semi") if min_pair > 1 else rows
    # Baskets of more than BLOCK items are cut by a hash of the item, so that no step ever sees one of them whole.
    sizes = frequent.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    large = sc.save(sizes.where(F.col("size") > BLOCK).select("basket", F.ceil(F.col("size") * 2 / BLOCK).cast("int").alias("blocks")), "large")
    none = F.lit(None).cast("array<string>")
    cut_any = not large.isEmpty()
    if cut_any:
        frequent = sc.save(frequent, "frequent")
    whole = lookup_join(frequent, large, "basket", "left_anti") if cut_any else frequent
    stripes = whole.groupBy("basket").agg(F.collect_list("item").alias("l")).select("l", none.alias("r"))
    if cut_any:
        cut = lookup_join(frequent, large, "basket", "inner").withColumn("block", F.pmod(F.xxhash64("item", F.lit(5)), F.col("blocks")).cast("int"))
        blocks = sc.save(cut.groupBy("basket", "block", "blocks").agg(F.collect_list("item").alias("items")), "blocks")
        # Each block goes to every block it meets, keyed by the two: one basket's pairs of blocks are spread over all tasks.
        meets = blocks.select("basket", "block", "items", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where(F.col("block") != F.col("other"))
        left = meets.where(F.col("block") < F.col("other")).select("basket", F.col("block").alias("x"), F.col("other").alias("y"), F.col("items").alias("l"))
        right = meets.where(F.col("block") > F.col("other")).select("basket", F.col("other").alias("x"), F.col("block").alias("y"), F.col("items").alias("r"))
        stripes = stripes.unionByName(blocks.select(F.col("items").alias("l"), none.alias("r"))).unionByName(left.join(right, ["basket", "x", "y"]).select("l", "r"))
    slices = stripes.mapInArrow(_add_baskets, _STRIPES).repartition("item_a", "slice").sortWithinPartitions("item_a", "slice")
    pairs = slices.mapInArrow(_merge_stripes, _STRIPES).select("item_a", F.explode("neighbours").alias("item_b", "n_ab")).where(F.col("n_ab") >= min_pair)
    a, b = (items.select(F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}")) for x in "ab")
    return pairs.join(a, "item_a").join(b, "item_b").select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(total).cast("long").alias("n"))


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's G2 of the 2 x 2 table of two items."""

    def h(*cells: Column) -> Column:
        cells = [c.cast("double") for c in cells]
        whole = cells[0]
        for c in cells[1:]:
            whole = whole + c
        xlogx = [F.when(c > 0, c * F.log(c / whole)).otherwise(F.lit(0.0)) for c in cells]
        s = xlogx[0]
        for x in xlogx[1:]:
            s = s + x
        return s

    k11, k12, k21 = n_ab, n_a - n_ab, n_b - n_ab
    k22 = n - n_a - n_b + n_ab
    return F.lit(2.0) * (h(k11, k12, k21, k22) - h(k11 + k12, k21 + k22) - h(k11 + k21, k12 + k22))


def cooccurrence(baskets: DataFrame, basket: Column, item: Column, *, min_pair: int = 1) -> DataFrame:
    """``pair_counts`` with lift (how many times more often than chance) and llr (its significance)."""
    p = pair_counts(baskets, basket, item, min_pair=min_pair)
    lift = F.col("n_ab").cast("double") * F.col("n") / F.col("n_a") / F.col("n_b")
    return p.withColumn("lift", lift).withColumn("llr", log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")))
