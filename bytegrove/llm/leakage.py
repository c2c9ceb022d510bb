"""Evaluation texts leaking into training text, by template canonicalisation.

Texts become tokens, and each token a typed slot: a number, the unit after a number, or a word that may be a name.
Windows of five tokens are template windows with one slot open: the key of a window is the type of that slot and the
values of all others, so two windows that share a key have consistent slots but for one at most, and a question of the
same build with other names and numbers shares none or few. Keys of all items, of whatever length and number, are
hash-joined with those of the documents. What is joined is aligned exactly.

The corpus is read once for an evaluation set of any size. A bitmap of the keys, bounded in size, tells tasks which
windows are worth passing on: only pieces of text around these are shuffled, never whole texts. A bitmap that fills up
passes on more and loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from bytegrove.llm.textnorm import tokens
from bytegrove.operators.skew import hot_keys, lookup_join
from bytegrove.scratch import Scratch

#: Tokens of a template window.
WINDOW = 5
#: Windows that more texts of the evaluation set hold are formulas: an item does without them where enough others remain.
COMMON_ITEMS = 1
#: Tokens around a window that are passed on with it, on either side.
MARGIN = 64
#: Bits of the bitmap for each key and of the whole bitmap at most (128 MB).
BITS_PER_KEY, MAX_BITS = 64, 1 << 30
#: Bits of the bitmap in one row while it is put together.
CHUNK = 1 << 16
#: Words whose hash a task remembers.
MEMORY = 1_000_000

LEAKS = "doc_id bigint, item_id bigint, item_tokens int, span_tokens int, matched_tokens int"

#: Odd multipliers, one for each place of a window, and the marks of an open slot by type: number, unit, word.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_OPEN = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class _Hashes(dict):
    """Token to 64 bits; the lowest tells whether it is a number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        v = self[token] = xxhash.xxh64_intdigest(token) & ~1 | token[0].isdigit()
        return v


def slot_types(a: np.ndarray) -> np.ndarray:
    """Index into ``_OPEN`` of each token's slot: 0 number, 1 unit (what follows a number), 2 word."""
    number = (a & np.uint64(1)).astype(bool)
    out = np.where(number, 0, 2)
    out[1:][number[:-1] & ~number[1:]] = 1
    return out


def _mixed(k: np.ndarray) -> np.ndarray:
    """Sums of products are spread over all bits."""
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


def window_keys(a: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(tokens covered, key at each start) of the windows of hashed tokens, by the slot that is open.

    The first and the last slot are open at once as runs of ``WINDOW - 1`` tokens; ``short`` names lengths of shorter runs
    that some item needs.
    """
    for size in (*short, WINDOW - 1):
        n = max(0, len(a) - size + 1)
        run = np.zeros(n, np.uint64)
        for i in range(size):
            run += a[i : i + n] * _PLACE[i]
        yield size, _mixed(run + np.uint64(size))
    n = max(0, len(a) - WINDOW + 1)
    whole = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        whole += a[i : i + n] * _PLACE[i]
    mark = _OPEN[slot_types(a)] if len(a) else a
    for i in range(1, WINDOW - 1):
        yield WINDOW, _mixed(whole + (mark[i : i + n] - a[i : i + n]) * _PLACE[i])


def shortest(n: int, share: float, same: float) -> int:
    """Tokens that the shortest passage of an item of n tokens has. The ends of a passage are cut where they differ: up to
    two tokens, but no more than what may differ of it."""
    return max(1, math.ceil(share * n) - min(2, int((1 - same) * share * n)))


def run_length(n: int, share: float, same: float) -> int:
    """Tokens of the runs an item of n tokens is looked up by: fewer where its shortest passage has few windows."""
    least = shortest(n, share, same)
    return WINDOW - 1 if least >= 2 * (WINDOW - 1) else min(2, least)


def dense(a: list, b: Collection, share: float, same: float) -> bool:
    """Whether a can have a passage of the wanted share in b: some stretch of that length must hold enough tokens of b.

    A passage of length L in [W, 2W) with a part s of its tokens in b has W consecutive ones with at least s / (2 - s) of W:
    its two halves overlap, or lack little. A longer passage has one of such length that is as dense.
    """
    w = shortest(len(a), share, same)
    there = b if isinstance(b, set) else set(b)
    sums = [0, *accumulate(t in there for t in a)]
    return max(sums[i + w] - sums[i] for i in range(len(a) - w + 1)) >= same / (2 - same) * w


def align(a: list[str], b: list[str], differ: float = 2.5, insert: float = 0.05) -> tuple[float, int, int]:
    """(score, tokens of a in the best passage, of these equal) of the best local alignment of a in b.

    Equal tokens score 1; a token of a that is missing or other costs ``differ``, so that a passage with up to a fifth of
    them gains by being whole; a token put into b costs next to nothing, so that a remark does not end a passage.
    """
    ids = {t: i for i, t in enumerate(dict.fromkeys(a))}
    bv = np.array([ids.get(t, -1) for t in b])
    m = len(b)
    equal = bv == np.arange(len(ids))[:, None]
    gain, count = np.where(equal, 1.0, -differ), equal.astype(np.int64)
    pos, index = np.arange(m + 1) * insert, np.arange(m + 1)
    # A cell's path is one number: where it starts in a, and the equal tokens on it.
    score, path = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    best, occurs = (0.0, 0, 0), equal.any(axis=1).tolist()
    for i, t in enumerate(a, 1):
        k = ids[t]
        if not occurs[k] and score.max() <= differ:
            score[:], path[:] = 0.0, i << 24  # every path ends here
            continue
        new, diag = score - differ, score[:-1] + gain[k]
        take = diag >= new[1:]
        np.maximum(new[1:], diag, out=new[1:])
        went = path.copy()
        went[1:] = np.where(take, path[:-1] + count[k], path[1:])
        new += pos
        top = np.maximum.accumulate(new)
        path = went[np.maximum.accumulate(np.where(new >= top, index, 0))]
        score = top - pos
        path[score <= 0] = i << 24
        np.maximum(score, 0.0, out=score)
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (float(score[j]), i - (int(path[j]) >> 24), int(path[j]) & 0xFFFFFF)
    return best


def passage(a: list, b: list, share: float, same: float) -> tuple[int, int] | None:
    """(tokens of a's passage in b, of these equal) if it is long and alike enough."""
    if not b or not dense(a, b, share, same):
        return None
    _, span, matched = align(a, b)
    return (span, matched) if span >= shortest(len(a), share, same) and matched >= same * span else None


def _hashed(items: DataFrame, share: float, same: float) -> DataFrame:
    """(item_id, text_key, toks, run): items with any token; equal texts have equal keys whatever way they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Hashes()
        for batch in batches:
            rows = [(i, [of[t] for t in tokens(x)]) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x]
            rows = [(i, np.array(a, np.uint64)) for i, a in rows if a]
            cols = [
                pa.array([i for i, _ in rows], pa.int64()), pa.array([xxhash.xxh128_hexdigest(a.tobytes()) for _, a in rows], pa.string()),
                pa.array([a.view(np.int64) for _, a in rows], pa.list_(pa.int64())), pa.array([run_length(len(a), share, same) for _, a in rows], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["item_id", "text_key", "toks", "run"])

    return items.mapInArrow(run, "item_id bigint, text_key string, toks array<bigint>, run int")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, toks, run) to (text_key, at, key), each key of a text at its first place."""
    for batch in batches:
        for text_key, toks, size in zip(*(c.to_pylist() for c in batch.columns)):
            a = np.array(toks, np.int64).view(np.uint64)
            parts = [k for n, k in window_keys(a, () if size == WINDOW - 1 else (size,)) if n == size or (n == WINDOW and size == WINDOW - 1)]
            keys, at = np.concatenate(parts), np.concatenate([np.arange(len(k)) for k in parts])
            keys, first = np.unique(keys, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array([text_key] * len(keys), pa.string()), pa.array(at[first], pa.int32()), pa.array(keys.view(np.int64))], names=["text_key", "at", "key"])


def _chooser(share: float, same: float):
    """Leaves out the windows that many texts hold, of texts in which every stretch that could leak keeps half of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_key, n, ws in zip(*(c.to_pylist() for c in batch.columns)):
                places = np.zeros(n + 1, np.int64)
                places[[w["at"] + 1 for w in ws if w["n"] <= COMMON_ITEMS]] = 1
                sums, length = np.cumsum(places), shortest(n, share, same)
                kept = sums[length:] - sums[: n + 1 - length]
                every = 2 * kept.min() < max(1, length - WINDOW + 2)
                keys = [w["key"] for w in ws if every or w["n"] <= COMMON_ITEMS]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([text_key] * len(keys), pa.string())], names=["key", "text_key"])

    return run


def _bitmap(index: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the keys, one bit for each of ``_SHIFTS``. The driver gets at most MAX_BITS bits, put together by tasks."""
    bits = min(MAX_BITS, max(CHUNK, 1 << (n * BITS_PER_KEY - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for where in batch.column(1).to_pylist():
                chunk = np.zeros(CHUNK, bool)
                chunk[where] = True
                packed.append(np.packbits(chunk, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["chunk", "packed"])

    # Bits of the key itself: it is mixed, so any run of its bits is a hash.
    bit = F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(bits - 1) for s in _SHIFTS)))
    chunks = index.select(bit.alias("bit")).select((F.col("bit") / CHUNK).cast("bigint").alias("chunk"), (F.col("bit") % CHUNK).cast("int").alias("b")).groupBy("chunk").agg(F.collect_set("b").alias("where"))
    out = np.zeros(bits // 8, np.uint8)
    for r in chunks.mapInArrow(run, "chunk bigint, packed binary").toLocalIterator():
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.packed, np.uint8)
    return out


#: Where the bits of a key begin that its probes take.
_SHIFTS = (0, 17, 34)


def _probe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the bitmap may hold; each probe looks at what the one before left."""
    at = None
    for s in _SHIFTS:
        b = (keys if at is None else keys[at]) >> np.uint64(s) & np.uint64(len(bitmap) * 8 - 1)
        hit = np.flatnonzero(bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
        at = hit if at is None else at[hit]
    return at


_PIECE = pa.schema([("doc_row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("toks", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
PIECES = "doc_row bigint, doc_id bigint, piece int, start bigint, toks array<bigint>, keys array<bigint>"


def _cutter(shared):
    """(doc_row, doc_id, text) to the pieces of each text around windows that some item may hold, with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, short = shared.value
        of = _Hashes()
        for batch in batches:
            row, doc, text = (c.to_pylist() for c in batch.columns)
            part: list[list[int]] = [[of[t] for t in tokens(x)] if x else [] for x in text]
            ends = np.cumsum([len(p) for p in part])
            a = np.fromiter((v for p in part for v in p), np.uint64, int(ends[-1]))
            owner = np.repeat(np.arange(len(part)), [len(p) for p in part])
            at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for size, k in window_keys(a, short):
                hit = _probe(bitmap, k)
                hit = hit[owner[hit] == owner[hit + size - 1]]
                at.append(hit)
                keys.append(k[hit])
            at, keys = np.concatenate(at), np.concatenate(keys)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
            new = np.ones(len(at), bool)
            new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (np.diff(at) > 2 * MARGIN + WINDOW)
            first = np.flatnonzero(new)
            rows = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
                d = int(owner[at[lo]])
                begin = int(ends[d]) - len(part[d])
                a0, a1 = max(begin, int(at[lo]) - MARGIN), min(int(ends[d]), int(at[hi - 1]) + WINDOW + MARGIN)
                same_doc = bool(rows) and rows[-1][0] == row[d]
                rows.append((row[d], doc[d], rows[-1][2] + 1 if same_doc else 0, a0 - begin, a[a0:a1].view(np.int64), np.unique(keys[lo:hi]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    return run


def _aligner(share: float, same: float):
    """(doc_id, text_key, pieces, toks) to what is a passage. Between two pieces as much is put as was left out, up to MARGIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("item_tokens", pa.int32()), ("span_tokens", pa.int32()), ("matched_tokens", pa.int32())])
        for batch in batches:
            found = []
            for doc, key, pieces, a in zip(*(c.to_pylist() for c in batch.columns)):
                b: list[int | None] = []
                end = pieces[0]["start"]
                for p in pieces:
                    b += [None] * min(MARGIN, max(0, p["start"] - end))
                    b += p["toks"][max(0, end - p["start"]) :]
                    end = max(end, p["start"] + len(p["toks"]))
                hit = passage(a, b, share, same)
                if hit:
                    found.append((doc, key, len(a), *hit))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.4, same: float = 0.75
) -> DataFrame:
    """Columns of ``LEAKS``: documents that repeat at least ``share`` of an item's tokens as one passage in its order.

    Tokens are words, or characters in scripts without spaces, whatever their case, spacing, hyphenation and digits.
    Of a passage at least ``same`` must agree: the fifth that may differ, and some room for words that the writing itself
    splits. A document id and an item id come once at most, with the longest passage; null is an id like another, and of
    several texts under one id each is searched. Null and empty texts, on either side, repeat nothing. Items of any length
    and number are found, whatever the other items hold; equal texts are searched once. Documents are read whole and once.
    """
    spark: SparkSession = docs.sparkSession
    sc = Scratch(spark, "leaks")
    given = sc.save(_hashed(items.select(F.col(item_id).cast("long"), F.col(item_text)), share, same), "items")
    texts = sc.save(given.groupBy("text_key").agg(F.first("toks").alias("toks"), F.first("run").alias("run")), "texts")
    windows = sc.save(texts.select("text_key", "toks", "run").mapInArrow(_windows, "text_key string, at int, key bigint"), "windows")
    held = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    by_text = windows.join(held, "key").groupBy("text_key").agg(F.collect_list(F.struct("at", "key", "n")).alias("ws"))
    sized = by_text.join(texts.select("text_key", F.size("toks").alias("n_tokens")), "text_key").select("text_key", "n_tokens", "ws")
    index = sc.save(sized.mapInArrow(_chooser(share, same), "key bigint, text_key string"), "index")
    sc.drop(windows)
    n, short = index.count(), tuple(sorted(r[0] for r in texts.where(F.col("run") < WINDOW - 1).select("run").distinct().collect()))
    shared = spark.sparkContext.broadcast((_bitmap(index, n), short))
    rows = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    pieces = sc.save(rows.mapInArrow(_cutter(shared), PIECES), "pieces")
    keys = pieces.select("doc_row", "piece", F.explode("keys").alias("key"))
    hits = sc.save(keys.join(index, "key").select("doc_row", "piece", "text_key").distinct(), "hits")
    near = hits.join(pieces.drop("keys"), ["doc_row", "piece"]).groupBy("doc_row", "text_key").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "toks"))).alias("pieces"))
    near = sc.save(near, "near")
    both = lookup_join(near, texts.select("text_key", F.col("toks").alias("item")), "text_key", "inner", hot_keys(hits, "text_key"))
    leaks = both.select("doc_id", "text_key", "pieces", "item").mapInArrow(_aligner(share, same), "doc_id bigint, text_key string, item_tokens int, span_tokens int, matched_tokens int")
    out = sc.save(leaks.join(given.select("text_key", "item_id"), "text_key").groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("item_tokens", "span_tokens", "matched_tokens"))), "leaks")
    sc.drop(pieces, hits, near, index, texts, given)
    return out
