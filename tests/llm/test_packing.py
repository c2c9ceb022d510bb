from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest

from bytegrove.llm import packing
from bytegrove.llm.tokens import VOCABULARY, encoding

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")


class Plain:
    """Sum of squares by definition: every choice is tried and the sum computed anew."""

    def __init__(self, cap):
        self.cap, self.levels = cap, []

    def cost(self, levels):
        n = defaultdict(int)
        for x in levels:
            if x < self.cap:
                n[x] += 1
        return sum(v * v for v in n.values())

    def place(self, size):
        options = {}
        for h in {x for x in self.levels if x + size <= self.cap}:
            after = list(self.levels)
            after[after.index(h)] = h + size
            options[h] = self.cost(after)
        fresh = self.cost([*self.levels, size])
        best = max((h for h in options if options[h] == min(options.values())), default=None)
        if best is not None and options[best] <= fresh:
            self.levels[self.levels.index(best)] = best + size
        else:
            self.levels.append(size)


def test_choices_are_sums_of_squares():
    rng = random.Random(4)
    for cap in (7, 20):
        fast, slow = packing.SumOfSquares(cap), Plain(cap)
        for _ in range(150):
            s = rng.randint(1, cap)
            fast.place(s)
            slow.place(s)
            assert [int(x) for x in fast.count[1:cap]] == [slow.levels.count(h) for h in range(1, cap)]
        assert fast.made == len(slow.levels)


def check(rows, sizes, cap):
    fill = defaultdict(int)
    for r in rows:
        assert sizes.pop(r.id) == r.size
        fill[r.container] += r.size
    assert not sizes and max(fill.values(), default=0) <= cap
    return len(fill)


@pytest.mark.parametrize("fan_in", [50_000, 200])
def test_containers(spark, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(5)
    sizes = {f"d{i}": min(4095, 1 + int(rng.lognormvariate(5, 1.2))) for i in range(3000)}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "id string, size long, container string")
    n = check(packing.pack(df).collect(), dict(sizes), 4096)
    assert n <= sum(sizes.values()) / 4096 * 1.02 + 3
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("low, high", [(2100, 3900), (1500, 2000), (4095, 4095)])
def test_no_task_holds_more_than_its_share(spark, monkeypatch, low, high):
    """Sizes that leave every container open end by themselves, and in every round the parts of a task are bounded."""
    seen = []
    place = packing._packer

    def watched(capacity, most):
        seen.append(most)
        return place(capacity, most)

    monkeypatch.setattr(packing, "FAN_IN", 100)
    monkeypatch.setattr(packing, "TASK_ITEMS", 400)
    monkeypatch.setattr(packing, "_packer", watched)
    rng = random.Random(8)
    sizes = {f"d{i}": rng.randint(low, high) for i in range(2000)}
    rows = packing.pack(spark.createDataFrame(list(sizes.items()), "id string, size long")).collect()
    n = check(rows, dict(sizes), 4096)
    assert len(seen) < 12 and seen[0] == 400 and set(seen[1:]) <= {100}
    # At most two such items fit one container.
    assert n == 2000 if low > 2048 else n <= 1005


def test_a_task_with_too_many_items_starts_afresh():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"task": pa.array([0] * 25, pa.int32()), "id": [str(i) for i in range(25)], "size": pa.array([3] * 25, pa.int64())})
    (out,) = packing._packer(10, 10)(iter([batch]))
    assert out.column(3).to_pylist() == [0] * 10 + [1] * 10 + [2] * 5


@needs_vocabulary
def test_documents(spark):
    enc = encoding(VOCABULARY, None)
    texts = {1: "a b c", 2: "word " * 9000, 3: "", 4: None, 5: "x" * 100_000, 6: "日本語" * 2000, 7: "a b c", 8: "<|endoftext|>"}
    df = spark.createDataFrame([(k, v, "z") for k, v in texts.items()] + [(None, "hi", "z")], "doc_id long, text string, n_tokens string")
    by, fill = defaultdict(list), defaultdict(int)
    for r in packing.pack_documents(df).collect():
        by[r.doc_id].append(r)
        if r.container:
            fill[r.container] += r.n_tokens
    assert max(fill.values()) <= 4096
    for k, t in texts.items():
        n = len(enc.encode_ordinary(t or ""))
        parts = sorted(by[k], key=lambda r: r.part)
        assert sum(r.n_tokens for r in parts) == n and all(r.doc_tokens == n for r in parts)
        assert [r.start_token for r in parts] == [4096 * i for i in range(len(parts))] and all(r.n_tokens == 4096 for r in parts[:-1])
        assert len(parts) == max(1, -(-n // 4096)) and (parts[0].container is None) == (n == 0)
    assert len(by[None]) == 1
