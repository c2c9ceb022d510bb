"""Filling containers of fixed capacity with whole documents by sum-of-squares online packing.

With N(h) containers open at fill level h, an item goes to the level that makes the sum of N(h)^2 over all partly filled
levels smallest. The level array is all the state that choice needs. Tasks pack the documents they hold; what they leave
partly filled are themselves items, and are packed again by fewer tasks that hold other mixtures. Rounds end when one task
has had all that was left, when nothing left fits anything, or when a round saves next to nothing; no task ever holds
more than a fixed number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytegrove.llm.tokens import VOCABULARY, token_counts
from bytegrove.scratch import Scratch

CAPACITY = 4096
#: Items that one task packs, of documents and of leftover containers; a task that gets more starts afresh at this number.
TASK_ITEMS, FAN_IN = 1_000_000, 50_000
#: A container this full is left alone by later rounds.
FULL = 0.98
#: Rounds go on while one saves at least this part of the containers it packs again.
SAVING = 0.005


class SumOfSquares:
    """Level array of open containers of one capacity; ``place`` gives the container of an item of size 1..capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """Minimises the change of sum N(h)^2; of equal choices the fullest container, and a new one last."""
        cap, n = self.capacity, self.count
        # From level h to h + size: 2 (N(h + size) - N(h)) + 2, or 1 - 2 N(h) where this fills the container.
        delta = np.full(cap + 1, np.iinfo(np.int64).max // 2)
        if size < cap:
            h = np.flatnonzero(n[1 : cap - size + 1]) + 1
            if len(h):
                delta_h = np.where(h + size == cap, 1 - 2 * n[h], 2 * (n[np.minimum(h + size, cap)] - n[h]) + 2)
                delta[h] = delta_h
        fresh = 2 * n[size] + 1 if size < cap else 0
        best = cap - int(np.argmin(delta[::-1]))
        if delta[best] <= fresh and n[best]:
            container = self.open[best].pop()
            n[best] -= 1
            level = best + size
        else:
            container, level = self.made, size
            self.made += 1
        if level < cap:
            n[level] += 1
            self.open[level].append(container)
        return container


def _packer(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(task, id, size) to (task, id, size, part, container); a part of a task is at most ``most`` items, one packer's."""
        packers: dict[int, SumOfSquares] = {}
        held: dict[int, int] = {}
        for batch in batches:
            task, size = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            part, where = [], []
            for t, s in zip(task, size):
                n = held[t] = held.get(t, -1) + 1
                if n % most == 0:
                    packers[t] = SumOfSquares(capacity)
                part.append(n // most)
                where.append(packers[t].place(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part, pa.int32()), pa.array(where, pa.int64())], names=["task", "id", "size", "part", "container"])

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """(id, size, container): items (id string, size 1..capacity) in containers, each container's sizes at most the capacity.

    The order within a task is by a hash of the id, so the result doesn't depend on how the input is split beyond the
    number of shuffle partitions. Containers are named by round and number. An empty table gives no rows.
    """
    spark = items.sparkSession
    sc = scratch or Scratch(spark, "packing")
    todo = sc.save(items.select("id", F.col("size").cast("long").alias("size")), "items")
    n, puts, most = todo.count(), [], TASK_ITEMS
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n > FAN_IN else 1, -(-2 * n // TASK_ITEMS))
    while True:
        round_ = len(puts)
        # Another hash in each round: what one task couldn't fill meets others.
        task = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(tasks)).cast("int")
        spread = todo.select(task.alias("task"), "id", "size").repartitionById(tasks, F.col("task")).sortWithinPartitions("task", F.xxhash64("id", F.lit(7)), "id")
        box = F.concat(F.lit(f"{round_}-"), "task", F.lit("-"), "part", F.lit("-"), "container").alias("box")
        put = spread.mapInArrow(_packer(capacity, most), "task int, id string, size bigint, part int, container bigint").select("id", "size", box)
        puts.append(sc.save(put, "put"))
        if tasks == 1 and n <= most:
            break
        fill = puts[-1].groupBy("box").agg(F.sum("size").alias("size"))
        part = sc.save(fill.where(F.col("size") < capacity * FULL).select(F.col("box").alias("id"), "size"), "part")
        # What even the smallest leftover doesn't fit is closed.
        least, left = part.agg(F.min("size"), F.count(F.lit(1))).first()
        if not left or (puts[1:] and left > (1 - SAVING) * n):
            break
        todo = sc.save(part.where(F.col("size") + least <= capacity), "todo")
        n, most = todo.count(), FAN_IN
        sc.drop(part)
        if n < 2:
            break
        tasks = 1 if n <= FAN_IN else -(-2 * n // FAN_IN)
    # From the last round back: a box that was packed again is the box it went into. Later tables are ever smaller.
    last = puts.pop()
    while puts:
        top = last.select(F.col("id").alias("box"), F.col("box").alias("top"))
        last = puts.pop().join(top, "box", "left").select("id", "size", F.coalesce("top", "box").alias("box"))
    return last.withColumnRenamed("box", "container")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, doc_tokens, container): each document, or part of an oversized one, once.

    A document of at most ``capacity`` tokens is one part. A longer one, and no other, is cut into parts of exactly
    ``capacity`` tokens, each a container of its own, and a rest that is packed like a document. Documents without a
    token (null or empty text) have part 0 of 0 tokens and no container. A row whose doc_id comes twice is two items.
    """
    sc = Scratch(docs.sparkSession, "packing")
    sizes = sc.save(token_counts(docs, doc_id, text, vocabulary=vocabulary).withColumn("copy", F.monotonically_increasing_id()), "sizes")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1))
    cut = (
        sizes.select("doc_id", "copy", F.col("n_tokens").alias("doc_tokens"), F.explode(parts).alias("part"))
        .withColumn("start_token", F.col("part").cast("long") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start_token")))
        .withColumn("id", F.concat("copy", F.lit(":"), "part"))
    )
    cut = sc.save(cut, "cut")
    columns = ["doc_id", "part", "start_token", "n_tokens", "doc_tokens"]
    none = cut.where("n_tokens = 0").select(*columns, F.lit(None).cast("string").alias("container"))
    whole = cut.where(F.col("n_tokens") == capacity).select(*columns, F.concat(F.lit("full-"), "id").alias("container"))
    rest = cut.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    packed = pack(rest.select("id", F.col("n_tokens").alias("size")), capacity=capacity, scratch=sc)
    placed = rest.join(packed.select("id", "container"), "id").select(*columns, "container")
    return none.unionByName(whole).unionByName(placed)
