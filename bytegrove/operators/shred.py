"""Nested JSON records to related flat tables through an adjacency table.

``shred`` turns each record into nodes (node, parent, label, ordinal, scalar); ``entities`` joins the object nodes of
some labels with their scalar children and pivots these into columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Labels that hold objects, and labels of scalars, as results spell them.
STRUCTURAL = ("classInfo", "fieldInfo", "methodInfo", "annotationInfo", "parameterInfo", "annotationParamValues")
SCALAR = ("className", "fieldName", "methodName", "annotationName", "typeDescriptorStr", "typeSignatureStr", "modifiers", "name")
#: Labels whose whole value is kept as one JSON text.
OPAQUE = ("value",)

NODES = "record_id bigint, record_key bigint, node int, parent int, label string, ordinal int, is_object boolean, scalar string, path string"
_ARROW = pa.schema(
    [
        ("record_id", pa.int64()), ("record_key", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()),
        ("ordinal", pa.int32()), ("is_object", pa.bool_()), ("scalar", pa.string()), ("path", pa.string()),
    ]
)


@lru_cache(maxsize=1 << 16)
def fold(label: str) -> str:
    """A label without its spelling: letters and digits in lower case."""
    return re.sub(r"[\W_]+", "", label).lower()


class _Many(list):
    """Values of one key that an object holds more than once."""


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        out = {}
        for k, v in pairs:
            if k in out:
                out[k] = _Many([*(out[k] if isinstance(out[k], _Many) else [out[k]]), v])
            else:
                out[k] = v
    return out


class _Number(str):
    """A number as it is written; texts of values keep it."""


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_pairs, parse_float=_Number, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\d.])|(true|false|null))', re.S)


def parse(text: str | None):
    """The value of a complete JSON text, else None. A byte order mark and outer white space are no part of it.

    Numbers of any length stay as they are written, nesting may be of any depth, ``NaN`` and the like are no JSON.
    """
    if text is None:
        return None
    text = text.lstrip("\ufeff \t\r\n")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)
    except ValueError as e:
        # Integers that are too long for the standard library are kept as they are written.
        return _parse_deep(text) if "digits" in str(e) else None


def _parse_deep(text: str):
    """As ``parse`` for texts nested deeper than the standard library goes: with a stack of its own."""
    at, n = 0, len(text.rstrip(" \t\r\n"))
    stack: list[tuple[str, list]] = []
    value, wanted = None, "value"
    while at < n:
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        mark, string, number, word = m.groups()
        if wanted == "done":
            return None
        if mark in ("{", "[") and wanted in ("value", "value or end"):
            stack.append((mark, []))
            wanted = "key or end" if mark == "{" else "value or end"
            continue
        if mark in ("}", "]"):
            if not stack or stack[-1][0] != {"}": "{", "]": "["}[mark] or wanted not in ("next", "key or end" if mark == "}" else "value or end"):
                return None
            kind, parts = stack.pop()
            value = _pairs([(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]) if kind == "{" else parts
        elif mark == ",":
            if wanted != "next":
                return None
            wanted = "key" if stack[-1][0] == "{" else "value"
            continue
        elif mark == ":":
            if wanted != "colon":
                return None
            wanted = "value"
            continue
        elif string is not None:
            try:
                value = json.loads(string)
            except ValueError:
                return None
            if wanted in ("key", "key or end"):
                stack[-1][1].append(value)
                wanted = "colon"
                continue
            if wanted not in ("value", "value or end"):
                return None
        else:
            if wanted not in ("value", "value or end"):
                return None
            value = _Number(number) if number is not None and (len(number) > 4000 or not number.lstrip("-").isdigit()) else int(number) if number is not None else {"true": True, "false": False, "null": None}[word]
        if stack:
            stack[-1][1].append(value)
            wanted = "next"
        else:
            wanted = "done"
    return value if wanted == "done" else None


def _flat(v) -> Iterator:
    """Elements of arrays inside each other, in order, without nulls; anything else is its own element."""
    stack = [iter((v,))]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            if x is not None:
                yield x
        else:
            stack.pop()


def _text(v) -> str:
    """A scalar as it is, anything else as JSON; a lone surrogate, which no text can hold, by its escape."""
    if isinstance(v, str):
        return v if v.isprintable() else v.encode("utf-8", "backslashreplace").decode("utf-8")
    return str(v).lower() if isinstance(v, (bool, int)) else _json(v)


_SURROGATE = re.compile("[\ud800-\udfff]")


def _json(v) -> str:
    """JSON of a value, numbers as they were written, of any depth."""
    out: list[str] = []
    todo: list = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, _Mark):
            out.append(x)
        elif isinstance(x, _Number):
            out.append(x)
        elif isinstance(x, str):
            out.append(json.dumps(x, ensure_ascii=bool(_SURROGATE.search(x))))
        elif isinstance(x, dict):
            todo.append(_Mark("}"))
            for i, (k, y) in enumerate(reversed(x.items())):
                for z in reversed(y) if isinstance(y, _Many) else (y,):
                    todo += [z, _Mark(json.dumps(k, ensure_ascii=bool(_SURROGATE.search(k))) + ":"), _Mark(",")]
            if x:
                todo.pop()
            out.append("{")
        elif isinstance(x, list):
            todo.append(_Mark("]"))
            for y in reversed(x):
                todo += [y, _Mark(",")]
            if x:
                todo.pop()
            out.append("[")
        elif x is None or isinstance(x, bool):
            out.append({True: "true", False: "false", None: "null"}[x])
        else:
            out.append(str(x))
    return "".join(out)


class _Mark(str):
    """A piece of JSON that is written as it is."""


def walk(top, structural: dict[str, str], scalar: dict[str, str], opaque: dict[str, str]) -> Iterator[tuple]:
    """(node, parent, label, ordinal, is_object, scalar, path) of one record, parents before children.

    Maps give the result's spelling of folded labels; other labels are passed through only when objects of a
    structural label lie below them. Depth is bounded by the parser alone, as this keeps its own stack.
    """
    n = 0
    todo = [(None, "", 0, x, "") for x in reversed(list(_flat(top))) if isinstance(x, dict)]
    # What holds something below is found in one pass over the record, at the first object that asks.
    tops: list = [top]
    held: set[int] | None = None

    def inner(text: str):
        """A part written as JSON text inside the JSON."""
        nonlocal held
        x = parse(text)
        tops.append(x)
        if held is not None:
            held |= _holders(x, structural)
        return x

    while todo:
        parent, label, ordinal, v, path = todo.pop()
        me, n = n, n + 1
        yield me, parent, label, ordinal, True, None, path
        counts: dict[str, int] = {}
        below = []
        for key, x in v.items():
            if not key.isprintable():
                key = _text(key)
            f = fold(key)
            if f in scalar or f in opaque:
                for i, y in enumerate([x] if f in opaque and not isinstance(x, _Many) else _flat(x)):
                    if y is not None:
                        yield n, me, scalar.get(f) or opaque[f], i, False, _text(y), None
                        n += 1
                if f in scalar:
                    continue
            name = structural.get(f) or opaque.get(f) or key
            if f in structural and isinstance(x, str) and not isinstance(x, _Number):
                x = inner(x)
            for y in _flat(x):
                if f in structural and isinstance(y, str) and not isinstance(y, _Number):
                    y = inner(y)
                if isinstance(y, dict):
                    i = counts[name] = counts.get(name, -1) + 1
                    if f not in structural and held is None:
                        held = set().union(*(_holders(t, structural) for t in tops))
                    if f in structural or id(y) in held:
                        below.append((me, name, i, y, f"{path}.{name}[{i}]" if path else f"{name}[{i}]"))
        todo.extend(reversed(below))


def _holders(top, structural: dict[str, str]) -> set[int]:
    """Identities of the objects and arrays of a record below which a structural label lies, all found in one pass."""
    order: list[tuple[object, object]] = []
    stack: list[tuple[object, object]] = [(top, None)]
    while stack:
        x, above = stack.pop()
        if isinstance(x, (dict, list)):
            order.append((x, above))
            stack.extend((y, x) for y in (x.values() if isinstance(x, dict) else x))
    out: set[int] = set()
    for x, above in reversed(order):
        if id(x) in out or (isinstance(x, dict) and any(fold(k) in structural for k in x)):
            out.add(id(x))
            out.add(id(above))
    return out


def shred(
    records: DataFrame,
    record_id: str = "record_id",
    record: str = "record",
    *,
    structural: tuple[str, ...] = STRUCTURAL,
    scalar: tuple[str, ...] = SCALAR,
    opaque: tuple[str, ...] = OPAQUE,
) -> DataFrame:
    """The adjacency table of JSON records, by columns of ``NODES``.

    Labels match in any spelling (case, underscores, hyphens). A part may stand alone instead of in an array, be null,
    be missing, or be a JSON text within the JSON; nulls in arrays take no ordinal. Null, blank, cut off or otherwise
    incomplete records give no nodes. ``record_key`` tells apart texts that share an id; a text that comes twice gives
    the same nodes twice, which ``entities`` folds into one. ``path`` is set for objects: ``name[i]`` joined by dots.
    """
    maps = tuple({fold(x): x for x in names} for names in (structural, scalar, opaque))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.extend((rid, key, *x) for x in walk(parse(text), *maps))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    given = records.select(F.col(record_id).cast("long"), F.xxhash64(record), F.col(record)).where(F.col(record).isNotNull())
    return given.mapInArrow(run, NODES)


def entities(nodes: DataFrame, labels: list[str], columns: dict[str, str]) -> DataFrame:
    """(record_id, record_key, node, parent, label, ordinal, path, parent_path, *columns) of objects with these labels.

    ``columns`` maps scalar labels to column names; a missing scalar is null, of repeated ones the largest is taken.
    Object nodes meet their scalar children in one grouping by (record, owner), where an object owns itself and a
    scalar belongs to its parent: a join and a pivot in one shuffle, over nodes parsed once. No group is larger than
    one object's scalars.
    """
    wanted = nodes.where(F.when(F.col("is_object"), F.col("label").isin(labels)).otherwise(F.col("label").isin(list(columns))))
    owner = F.when(F.col("is_object"), F.col("node")).otherwise(F.col("parent"))
    head = F.max(F.when(F.col("is_object"), F.struct("parent", "label", "ordinal", "path")))
    pivot: list[Column] = [F.max(F.when(~F.col("is_object") & (F.col("label") == k), F.col("scalar"))).alias(v) for k, v in columns.items()]
    grouped = wanted.groupBy("record_id", "record_key", owner.alias("node")).agg(head.alias("head"), *pivot).where("head is not null")
    parent_path = F.when(F.instr("head.path", "].") > 0, F.regexp_replace("head.path", r"\.[^.]*$", "")).otherwise(F.lit(""))
    return grouped.select("record_id", "record_key", "node", "head.*", parent_path.alias("parent_path"), *columns.values())
