"""Class files and archives written from tables: the reverse of a scan.

A class row with its members and annotations becomes the bytes of a class file; the files of a class-path element become
one archive with its manifest. Archives are streamed out by the tasks that hold their rows in order.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import struct
import tempfile
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytegrove.catalog import OBJECT, Catalog
from bytegrove.functions.modifiers import INTERFACE
from bytegrove.functions.names import class_name, descriptor
from bytegrove.scratch import Scratch

#: Versions of a class that multi-release archives hold beside the base: one that runs on the configured Java, one beyond.
VERSION, FUTURE = 11, 99
#: Copies of files that are kept aside up to this size in memory, beyond it in a file.
SPOOL_BYTES = 16 << 20
#: Stands for no number where numbers are compared as plain columns; in files they have 16 bits.
_NONE = -(1 << 31)
_json = functools.lru_cache(4096)(json.loads)


def _modified(s: str) -> bytes:
    return b"".join(b"\xc0\x80" if c == "\0" else c.encode() if ord(c) < 0x10000 else c.encode("utf-16-be", "surrogatepass")[:2].decode("utf-16-be", "surrogatepass").encode("utf-8", "surrogatepass") + c.encode("utf-16-be")[2:].decode("utf-16-be", "surrogatepass").encode("utf-8", "surrogatepass") for c in s)


class _Writer:
    """Bytes with a constant pool; texts are modified UTF-8."""

    def __init__(self):
        self.pool: list[bytes] = []
        self.index: dict[bytes, int] = {}
        self.texts: dict[str, int] = {}
        self.classes: dict[str, int] = {}

    def add(self, entry: bytes) -> int:
        at = self.index.get(entry)
        if at is None:
            at = self.index[entry] = len(self.pool) + 1
            self.pool.append(entry)
            if entry[0] in (5, 6):  # long and double take two places
                self.pool.append(b"")
        return at

    def text(self, s: str) -> int:
        at = self.texts.get(s)
        if at is None:
            raw = s.encode() if s.isascii() and "\0" not in s else _modified(s)
            self.pool.append(b"\1" + len(raw).to_bytes(2) + raw)
            at = self.texts[s] = len(self.pool)
        return at

    def klass(self, name: str) -> int:
        at = self.classes.get(name)
        if at is None:
            at = self.classes[name] = self.add(struct.pack(">BH", 7, self.text(name.replace(".", "/"))))
        return at

    def attribute(self, name: str, body: bytes) -> bytes:
        return struct.pack(">HI", self.text(name), len(body)) + body

    def number(self, kind: str, v) -> int:
        tag, form = {"J": (5, "q"), "F": (4, "f"), "D": (6, "d")}.get(kind, (3, "i"))
        return self.add(struct.pack(f">B{form}", tag, float(v) if form in "fd" else int(v)))

    def value(self, v) -> bytes:
        """A tagged value; a plain one, as arrays may hold, is tagged by its kind."""
        if not isinstance(v, dict):
            v = {"t": "s" if isinstance(v, str) else "Z" if isinstance(v, bool) else "D" if isinstance(v, float) else "I", "v": v}
        t = v["t"]
        if t == "s":
            return b"s" + struct.pack(">H", self.text(v["v"]))
        if t == "e":
            return b"e" + struct.pack(">HH", self.text("L" + v["class"].replace(".", "/") + ";"), self.text(v["name"]))
        if t == "c":
            return b"c" + struct.pack(">H", self.text(v["v"]))
        if t == "@":
            return b"@" + self.annotation(v["annotation"], [(p["name"], p["value_json"]) for p in v["params"]])
        if t == "[":
            return b"[" + struct.pack(">H", len(v["v"])) + b"".join(map(self.value, v["v"]))
        return t.encode() + struct.pack(">H", self.number(t, v["v"]))

    def annotation(self, name: str, params: list[tuple[str, str]]) -> bytes:
        out = struct.pack(">HH", self.text("L" + name.replace(".", "/") + ";"), len(params))
        for key, value_json in params:
            out += struct.pack(">H", self.text(key)) + self.value(_json(value_json))
        return out

    def annotations(self, given: list[tuple]) -> list[bytes]:
        """Attributes for visible and invisible ones of (param_idx, annotation, visible, params)."""
        out = []
        for visible, name in ((True, "RuntimeVisibleAnnotations"), (False, "RuntimeInvisibleAnnotations")):
            own = [self.annotation(a[1], a[3]) for a in given if a[2] is visible]
            if own:
                out.append(self.attribute(name, _counted(own)))
        return out

    def parameter_annotations(self, given: list[tuple], n: int) -> list[bytes]:
        out = []
        for visible, name in ((True, "RuntimeVisibleParameterAnnotations"), (False, "RuntimeInvisibleParameterAnnotations")):
            if any(a[2] is visible for a in given):
                body = struct.pack(">B", n)
                for i in range(n):
                    body += _counted([self.annotation(a[1], a[3]) for a in given if a[2] is visible and a[0] == i])
                out.append(self.attribute(name, body))
        return out


def _counted(parts: list[bytes]) -> bytes:
    return struct.pack(">H", len(parts)) + b"".join(parts)


_FIELD_KEY, _METHOD_KEY, _ANNOTATION_KEY = operator.itemgetter(1), operator.itemgetter(1, 2), operator.itemgetter(2)


def _once(rows: list[tuple], key) -> list[tuple]:
    """Of rows with one key the first."""
    keys = [*map(key, rows)]
    if len(set(keys)) == len(keys):
        return rows
    seen: dict = {}
    for k, r in zip(keys, rows):
        seen.setdefault(k, r)
    return [*seen.values()]


def class_bytes(c: dict) -> bytes:
    """A class file of (class_name, modifiers, minor, major, superclass, interfaces, type_signature, source_file, is_record,
    outer, fields, methods, annotations), the last three as sorted tuples of ``class_records``.

    Of several fields with one name, methods with one name and descriptor, or annotations with one ann_id the first counts.
    Annotations are on the first member of their number; those of no member are left out.
    """
    from bytegrove.sources.classfile import parameter_descriptors

    w = _Writer()
    own_fields = [f for f in _once(c["fields"], _FIELD_KEY) if f[3] is not None]
    own_methods = _once(c["methods"], _METHOD_KEY)
    on: dict[tuple, list[tuple]] = {}
    if c["annotations"]:
        first: dict[tuple, int] = {}
        for kind, at, members in (("field", 6, own_fields), ("method", 10, own_methods)):
            for i, x in enumerate(members):
                if x[at] != _NONE:
                    first.setdefault((kind, x[at]), i)
        for param, _, _, annotation, visible, kind, member, params in _once(c["annotations"], _ANNOTATION_KEY):
            at = 0 if kind == "class" else first.get(("field" if kind == "field" else "method", member))
            if at is not None:
                on.setdefault((kind, at), []).append((param, annotation, visible, params))
    head = struct.pack(">HHH", c["modifiers"] & 0xFFFF, w.klass(c["class_name"]), w.klass(c["superclass"])) + _counted([struct.pack(">H", w.klass(i)) for i in c["interfaces"]])
    fields, methods = [], []
    for i, (_, name, _, desc, modifiers, _, _, const) in enumerate(own_fields):
        attrs = w.annotations(on.get(("field", i), ())) if on else []
        if const is not None:
            attrs.append(w.attribute("ConstantValue", struct.pack(">H", w.number(desc, const))))
        fields.append(struct.pack(">HHH", (modifiers or 0) & 0xFFFF, w.text(name), w.text(desc)) + _counted(attrs))
    for i, (_, name, desc, _, modifiers, has_body, _, signature, min_line, max_line, _, thrown) in enumerate(own_methods):
        attrs = w.annotations(on.get(("method", i), ())) if on else []
        if ("param", i) in on:
            attrs += w.parameter_annotations(on["param", i], len(parameter_descriptors(desc)))
        if signature:
            attrs.append(w.attribute("Signature", struct.pack(">H", w.text(signature))))
        if thrown:
            attrs.append(w.attribute("Exceptions", _counted([struct.pack(">H", w.klass(t)) for t in thrown])))
        if has_body:
            lines = [struct.pack(">HH", 0, x) for x in (max_line, min_line) if x]
            table = [w.attribute("LineNumberTable", _counted(lines))] if lines else []
            attrs.append(w.attribute("Code", struct.pack(">HHI", 1, 1, 1) + b"\xb1" + struct.pack(">H", 0) + _counted(table)))
        methods.append(struct.pack(">HHH", (modifiers or 0) & 0xFFFF, w.text(name), w.text(desc)) + _counted(attrs))
    attrs = w.annotations(on.get(("class", 0), ())) if on else []
    if c["type_signature"]:
        attrs.append(w.attribute("Signature", struct.pack(">H", w.text(c["type_signature"]))))
    if c["source_file"]:
        attrs.append(w.attribute("SourceFile", struct.pack(">H", w.text(c["source_file"]))))
    if c["is_record"]:
        attrs.append(w.attribute("Record", struct.pack(">H", 0)))
    if c["outer"]:
        attrs.append(w.attribute("InnerClasses", _counted([struct.pack(">HHHH", w.klass(c["class_name"]), w.klass(c["outer"]), 0, c["modifiers"] & 0xFFFF)])))
    body = head + _counted(fields) + _counted(methods) + _counted(attrs)
    return struct.pack(">IHHH", 0xCAFEBABE, c["minor"], c["major"], len(w.pool) + 1) + b"".join(w.pool) + body


def class_records(cat: Catalog) -> DataFrame:
    """(cp_idx, path, class_name, ..., fields, methods, annotations): each class file of each element with what it declares.

    A class without an element or path has no file. Members are in order of ord, name and descriptor; a member or class
    row that says less (no modifiers, no body) says none of it. Nothing here is larger than one class's declaration.
    Members and annotations are moved once, to their class; repeated ones are in it still, behind the one that counts.
    """
    raw = cat.raw["classes"].where("cp_idx is not null and resource_path is not null").select("cp_idx", F.col("resource_path").alias("path"), class_name("class_name").alias("class_name"), "modifiers", "is_record", "major", "minor", "type_signature", "source_file")
    names = [c for c in raw.columns if c not in ("cp_idx", "path")]
    files = raw.where("class_name is not null").groupBy("cp_idx", "path").agg(F.min(F.struct(*names)).alias("f")).select("cp_idx", "path", "f.*")
    files = files.withColumns({"modifiers": F.coalesce("modifiers", F.lit(0)), "is_record": F.coalesce("is_record", F.lit(False)), "major": F.coalesce("major", F.lit(52)), "minor": F.coalesce("minor", F.lit(0))})
    e = cat.edges.where("rel in ('extends', 'implements', 'inner_of')")
    of = lambda rel, c: F.when(F.col("rel") == rel, c)
    above = e.groupBy(F.col("src").alias("class_name")).agg(
        F.min(of("extends", F.col("dst"))).alias("superclass"), F.min(of("inner_of", F.col("dst"))).alias("outer"),
        F.transform(F.sort_array(F.collect_list(of("implements", F.struct(F.coalesce("ord", F.lit(1 << 30)).alias("o"), "dst")))), lambda x: x["dst"]).alias("interfaces"),
    )
    zero, last = F.lit(0), F.coalesce("ord", F.lit(1 << 30)).alias("o")
    number = lambda c: F.coalesce(c, F.lit(_NONE))
    m = cat.raw["methods"].select(class_name("class_name").alias("class_name"), "ord", "name", descriptor("descriptor").alias("descriptor"), "modifiers", "has_body", "thrown", "signature", "min_line", "max_line")
    m = m.where("class_name is not null and name is not null and descriptor is not null")
    methods = _per_class(m, "methods", F.struct(
        last, "name", "descriptor", F.col("modifiers").isNull().alias("no_modifiers"), F.coalesce("modifiers", zero).alias("modifiers"), "has_body", "thrown", "signature", "min_line", "max_line", number("ord").alias("ord"),
        F.array_compact(F.transform(F.coalesce("thrown", F.array()), class_name)).alias("thrown_classes"),
    ))
    const = F.when(F.col("descriptor").isin("B", "S", "I", "C", "J"), F.get_json_object("const_json", "$.v").cast("bigint"))
    f = cat.raw["fields"].select(class_name("class_name").alias("class_name"), "ord", "name", descriptor("descriptor").alias("descriptor"), "modifiers", "const_json").where("class_name is not null and name is not null")
    fields = _per_class(f, "fields", F.struct(last, "name", F.col("descriptor").isNull().alias("no_descriptor"), "descriptor", "modifiers", "const_json", number("ord").alias("ord"), const.alias("const")))
    a = cat.raw["annotations"].select("ann_id", "target_kind", class_name("class_name").alias("class_name"), "member_ord", "param_idx", "ord", class_name("annotation").alias("annotation"), "visible", "params")
    a = _one_class(a.where("class_name is not null and annotation is not null"))
    annotations = _per_class(a, "annotations", F.struct(F.coalesce("param_idx", F.lit(-1)).alias("param_idx"), last, "ann_id", "annotation", F.coalesce("visible", F.lit(False)).alias("visible"), "target_kind", number("member_ord").alias("member_ord"), F.coalesce("params", F.array()).alias("params")))
    out = files
    for t in (above, methods, fields, annotations):
        out = out.join(t, "class_name", "left")
    nominal = (F.col("modifiers").bitwiseAND(INTERFACE) != 0) | F.col("superclass").isNull()
    return out.withColumn("superclass", F.when(nominal, F.lit(OBJECT)).otherwise(F.col("superclass")))


def _per_class(rows: DataFrame, name: str, item) -> DataFrame:
    return rows.repartition("class_name").groupBy("class_name").agg(F.sort_array(F.collect_list(item)).alias(name))


def _one_class(a: DataFrame) -> DataFrame:
    """Annotations without those whose ann_id another class has too; only ids and hashes are moved to find these."""
    h = F.xxhash64("class_name")
    twice = Scratch(a.sparkSession, "instances").save(a.groupBy("ann_id").agg(F.min(h).alias("of"), F.max(h).alias("to")).where("of <> to").select(F.col("ann_id").alias("id"), "of"), "twice")
    if twice.isEmpty():
        return a
    return a.join(twice, F.col("ann_id").eqNullSafe(F.col("id")), "left").where(F.col("of").isNull() | (F.col("of") == h)).drop("id", "of")


_FILES = pa.schema([("cp_idx", pa.int32()), ("path", pa.string()), ("place", pa.int32()), ("copies", pa.int32()), ("content", pa.binary())])
_DDL = "cp_idx int, path string, place int, copies int, content binary"
#: Bits of ``copies``: files of other versions, damaged files.
VERSIONED, DAMAGED = 1, 2


def _plain(a: pa.Array) -> list:
    """Values as ``to_pylist`` gives them, structs as tuples and missing lists as empty ones; by columns, which is many times faster."""
    if pa.types.is_list(a.type):
        rows, at = _plain(a.values), a.offsets.to_numpy().tolist()
        return [rows[i:j] for i, j in zip(at, at[1:])]
    if pa.types.is_struct(a.type):
        return list(zip(*(_plain(a.field(i)) for i in range(a.type.num_fields))))
    if pa.types.is_string(a.type) or not a.null_count:
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def _to_bytes(names: list[str], damage: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, map(_plain, batch.columns)))
            content = [class_bytes(dict(zip(names, row))) for row in zip(*columns.values())]
            copies = [(VERSIONED if v >= 60 else 0) | (DAMAGED if damage and s is None else 0) for v, s in zip(columns["major"], columns["source_file"])]
            given = columns["cp_idx"], columns["path"], [1] * len(content), copies, content
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(given, _FILES)], schema=_FILES)

    return run


def _open_out(path: str):
    if "://" not in path and not path.startswith("file:"):
        return open(path, "wb")
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return where.open_output_stream(at)


class _Archive:
    """An archive written in one go. Contents come deflated, so that one that is written several times is deflated once."""

    def __init__(self, out):
        self.out, self.at, self.n, self.directory = out, 0, 0, bytearray()
        t = time.localtime()
        self.stamp = t[3] << 11 | t[4] << 5 | t[5] // 2, max(0, t[0] - 1980) << 9 | t[1] << 5 | t[2]

    def add(self, path: str, body: bytes, length: int, crc: int) -> None:
        name, far = path.encode(), self.at >= 0xFFFFFFFF
        head = struct.pack("<HHHHHIIIH", 45 if far else 20, 0 if path.isascii() else 0x800, 8, *self.stamp, crc, len(body), length, len(name))
        self.directory += b"PK\1\2\x14\3" + head + struct.pack("<HHHHII", 12 if far else 0, 0, 0, 0, 0o600 << 16, 0xFFFFFFFF if far else self.at) + name + (struct.pack("<HHQ", 1, 8, self.at) if far else b"")
        entry = b"PK\3\4" + head + b"\0\0" + name + body
        self.out.write(entry)
        self.at += len(entry)
        self.n += 1

    def close(self) -> None:
        n, size, at = self.n, len(self.directory), self.at
        self.out.write(self.directory)
        if n >= 0xFFFF or at >= 0xFFFFFFFF or size >= 0xFFFFFFFF:
            self.out.write(b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at) + b"PK\6\7" + struct.pack("<IQI", 0, at + size, 1))
        self.out.write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))
        self.out.close()


def deflated(data: bytes) -> tuple[bytes, int, int]:
    return zlib.compress(data, 6, -15), len(data), zlib.crc32(data)


def _write_archive(path: str, files: Iterator[tuple[str, int, bytes]]) -> int:
    """Entries of one archive written: files in order, then their copies for other versions, then damaged ones."""
    z = _Archive(_open_out(path))
    again: dict[str, list[tuple]] = {}
    with tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) as aside:

        def keep(prefixes: tuple[str, ...], name: str, entry: tuple[bytes, int, int]) -> None:
            at = aside.tell()
            aside.write(entry[0])
            for p in prefixes:
                again.setdefault(p, []).append((name, at, len(entry[0]), *entry[1:]))

        for name, copies, data in files:
            entry = deflated(data)
            z.add(name, *entry)
            if copies & VERSIONED:
                keep(_VERSIONS, name, entry)
            if copies & DAMAGED:
                keep(("broken/",), name, deflated(data[: len(data) // 2]))
                keep(("moved/",), name, entry)
        for p in (*_VERSIONS, "broken/", "moved/"):
            for name, at, n, *rest in again.get(p, ()):
                aside.seek(at)
                z.add(p + name, aside.read(n), *rest)
    z.close()
    return z.n


_VERSIONS = tuple(f"META-INF/versions/{v}/" for v in (VERSION, FUTURE))


def _zipper(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cp_idx, path, copies, content) in order of element, the manifest first: one archive after the other."""
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        done = [(cp, at := f"{root}/e{cp:03d}.jar", _write_archive(at, (r[1:] for r in own))) for cp, own in itertools.groupby(rows, lambda r: r[0])]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["cp_idx", "element", "n_entries"])

    return run


def manifest_text(entries: dict[str, str]) -> str:
    """A main section: lines of at most 72 bytes, longer ones go on after a blank."""
    lines = ["Manifest-Version: 1.0"]
    for k, v in entries.items():
        line = f"{k}: {v}"
        while len(line.encode()) > 72:
            cut = 72
            while len(line[:cut].encode()) > 72:
                cut -= 1
            lines.append(line[:cut])
            line = " " + line[cut:]
        lines.append(line)
    return "\r\n".join(lines) + "\r\n\r\n"


def write_archives(cat: Catalog, root: str, *, multi_release_every: int = 3, damage: bool = False) -> DataFrame:
    """(cp_idx, element, n_entries): each element of the catalog as an archive ``eNNN.jar`` below ``root``.

    Every so many elements are marked as multi-release. With ``damage`` some files are also written cut off, or under
    another name than their class has. An element without files has its manifest only.
    """
    import os

    if "://" not in root and not root.startswith("file:"):
        os.makedirs(root, exist_ok=True)
    else:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(root)
        where.create_dir(at, recursive=True)
    records = class_records(cat)
    files = records.mapInArrow(_to_bytes(records.columns, damage), _DDL)
    text = F.udf(lambda m, multi: manifest_text(dict(m or {}) | ({"Multi-Release": "true"} if multi else {})).encode(), "binary")
    heads = cat.raw["elements"].select("cp_idx", F.lit("META-INF/MANIFEST.MF").alias("path"), F.lit(0).alias("place"), F.lit(0).alias("copies"), text("manifest", F.col("cp_idx") % multi_release_every == 0).alias("content"))
    every = files.unionByName(heads)
    n = int(cat.spark.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "cp_idx").sortWithinPartitions("cp_idx", "place", "path").select("cp_idx", "path", "copies", "content").mapInArrow(_zipper(root), "cp_idx int, element string, n_entries bigint")
