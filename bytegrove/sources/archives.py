"""Directories and archives as tables of entries, listed and read by tasks in parallel.

Listing reads central directories only, each once. Contents are read in a second step, by (archive, range of entries) and
from the place that the listing gives, so that one huge archive is read by many tasks, none of them reads its directory
again, and no content is ever shuffled.
"""

from __future__ import annotations

import datetime as dt
import io
import stat
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bytegrove.functions.paths import ARCHIVE, REMOTE, has_scheme, sanitize
from bytegrove.sources.manifest import child_paths, parse_manifest

#: Directories within archives. Fixed values of packaging formats.
PACKAGE_ROOTS = ("BOOT-INF/classes/", "WEB-INF/classes/", "test-classes/", "classes/")
LIB_DIRS = ("BOOT-INF/lib/", "WEB-INF/lib/", "WEB-INF/lib-provided/")
VERSIONS = "META-INF/versions/"
#: A nested archive up to this size is inflated in memory, a larger one in a file.
SPOOL_BYTES = 64 << 20
#: Entries that one task reads at a time.
ENTRIES_PER_TASK = 2000


@dataclass(frozen=True)
class ArchiveOptions:
    nested: bool = True
    jvm_major: int = 17
    #: List every version of an entry under its own path instead of the newest one that runs.
    all_versions: bool = False
    accept_names: tuple[str, ...] = ()
    reject_names: tuple[str, ...] = ()
    platform: bool = False
    allow_remote: bool = False


ENTRIES = "element string, nested string, ord int, path string, path_in_element string, root string, is_classfile boolean, version int, length bigint, compressed_length bigint, mtime timestamp, posix_mode int, manifest map<string,string>, error string, place struct<at:bigint,method:int,crc:bigint>"
_SCHEMA = pa.schema(
    [
        ("element", pa.string()), ("nested", pa.string()), ("ord", pa.int32()), ("path", pa.string()), ("path_in_element", pa.string()), ("root", pa.string()), ("is_classfile", pa.bool_()),
        ("version", pa.int32()), ("length", pa.int64()), ("compressed_length", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("posix_mode", pa.int32()),
        ("manifest", pa.map_(pa.string(), pa.string())), ("error", pa.string()), ("place", pa.struct([("at", pa.int64()), ("method", pa.int32()), ("crc", pa.int64())])),
    ]
)


def open_file(uri: str):
    """A seekable file of any file system that pyarrow knows; local paths are opened as they are."""
    if uri.startswith("file:"):
        from urllib.parse import unquote

        uri = "/" + unquote(uri[5:]).lstrip("/")
    if not has_scheme(uri):
        return open(uri, "rb")
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def _names_ok(chain: str, o: ArchiveOptions) -> bool:
    """Every archive on the way must be accepted by file name, in any case; names may be globs."""
    import re

    from bytegrove.functions.globs import glob_to_regex, is_glob

    def hit(name: str, specs: tuple[str, ...]) -> bool:
        return any(re.match(glob_to_regex(s.lower()), name) if is_glob(s) else name == s.lower() for s in specs)

    names = [p.rsplit("/", 1)[-1].lower() for p in chain.split("!/") if p]
    return all((not o.accept_names or hit(n, o.accept_names)) and not hit(n, o.reject_names) for n in names)


def usable(i: zipfile.ZipInfo, size: int) -> bool:
    """Stored or deflated, not encrypted, within the file, no directory."""
    return not i.is_dir() and not i.flag_bits & 1 and i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and 0 <= i.header_offset < size and i.file_size >= 0


def check_count(z: zipfile.ZipFile, size: int) -> None:
    """An archive that claims more entries than its central directory has room for is broken."""
    if len(z.infolist()) * 46 > max(0, size - z.start_dir):
        raise zipfile.BadZipFile("more entries than the directory can hold")


def places(infos: list[zipfile.ZipInfo], size: int) -> dict[int, int]:
    """Where the bytes of each local header's entry must have ended, by the header's offset: at the next header or the directory."""
    at = sorted({i.header_offset for i in infos})
    return dict(zip(at, [*at[1:], size]))


def place(i: zipfile.ZipInfo, ends: dict[int, int]) -> dict | None:
    """What it takes to read an entry without the directory; None for those that need more (patched, overlapping)."""
    fits = i.header_offset + 30 + len(i.orig_filename) + i.compress_size <= ends[i.header_offset]
    return {"at": i.header_offset, "method": i.compress_type, "crc": i.CRC} if fits and not i.flag_bits & 0x61 else None


def read_at(f, name: str, compressed: int, length: int, where: dict) -> bytes:
    """The content of one entry, from its local header on; the header must give the same name."""
    f.seek(where["at"])
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile(f"no entry at {where['at']}")
    flags, n, extra = struct.unpack("<6xH18xHH", head)
    raw = f.read(n + extra + compressed)
    if sanitize(raw[:n].decode("utf-8" if flags & 0x800 else "cp437")) != name:
        raise zipfile.BadZipFile(f"directory and header differ in the name of {name}")
    body = raw[n + extra :]
    data = zlib.decompressobj(-15).decompress(body, max(1, length)) if where["method"] == zipfile.ZIP_DEFLATED else body[:length]
    if zlib.crc32(data) != where["crc"]:
        raise zipfile.BadZipFile(f"bad checksum of {name}")
    return data


def package_root(z: zipfile.ZipFile, names: list[str]) -> list[str]:
    """Prefixes whose first class file is named as if the prefix weren't there."""
    from bytegrove.sources.classfile import ClassFile, ClassFormatError

    found = []
    for root in PACKAGE_ROOTS:
        first = next((n for n in names if n.startswith(root) and n.lower().endswith(".class") and "-info." not in n), None)
        if first is None:
            continue
        try:
            name = ClassFile(z.read(first), members=False, refs=False).name
        except (ClassFormatError, zipfile.BadZipFile, OSError, struct.error, NotImplementedError):
            continue
        if first[len(root) : -6].replace("/", ".") == name:
            found.append(root)
    return found


def _entry_time(i: zipfile.ZipInfo) -> dt.datetime | None:
    """Extended time of the extra field if there, else the MS-DOS time, as UTC."""
    extra, at = i.extra, 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 0x5455 and n >= 5 and extra[at + 4] & 1:
            return dt.datetime.fromtimestamp(struct.unpack_from("<i", extra, at + 5)[0], dt.UTC)
        at += 4 + n
    try:
        return dt.datetime(*i.date_time, tzinfo=dt.UTC)
    except ValueError:
        return None


def list_archive(f, element: str, nested: str, o: ArchiveOptions) -> Iterator[dict]:
    """Entries of an open archive in central-directory order, those of archives in it after it.

    Of one path the first entry counts. With versions, ``path`` is without ``META-INF/versions/N/`` and the newest that
    the configured Java runs stays. Anything unreadable is a row with ``error`` and never an exception.
    """
    blank = dict.fromkeys(_SCHEMA.names) | {"element": element, "nested": nested}
    try:
        z = zipfile.ZipFile(f)
        f.seek(0, io.SEEK_END)
        size = f.tell()
        check_count(z, size)
    except (zipfile.BadZipFile, OSError, struct.error, ValueError, NotImplementedError) as e:
        yield blank | {"error": f"{type(e).__name__}: {e}"}
        return
    with z:
        infos: dict[str, zipfile.ZipInfo] = {}
        for i in z.infolist():
            name = sanitize(i.filename)
            if usable(i, size) and name and name not in infos:
                infos[name] = i
        try:
            manifest = parse_manifest(z.read(infos["META-INF/MANIFEST.MF"])) if "META-INF/MANIFEST.MF" in infos else {}
        except (zipfile.BadZipFile, OSError, ValueError):
            manifest = {}
        for key, std in (("spring-boot-classes", PACKAGE_ROOTS[:2]), ("spring-boot-lib", LIB_DIRS)):
            if manifest.get(key) and manifest[key].rstrip("/") + "/" not in std:
                yield blank | {"error": f"unusual {key}: {manifest[key]}"}
                return
        roots = package_root(z, list(infos))
        multi = manifest.get("multi-release", "").lower() == "true"
        rows: dict[str, tuple] = {}
        for ord_, (name, i) in enumerate(infos.items()):
            version, path = 8, name
            if name.startswith(VERSIONS):
                number, _, rest = name[len(VERSIONS) :].partition("/")
                n = int(number) if rest and number.isdecimal() and len(number) < 6 else 0
                if o.all_versions:
                    version = n if 9 <= n <= o.jvm_major else 8
                elif n > o.jvm_major and not rest.startswith("META-INF/"):
                    continue
                elif n >= 9 and not rest.startswith("META-INF/"):
                    version, path = n, rest
            root = next((r for r in roots if path.startswith(r)), "")
            path = path[len(root) :]
            old = rows.get(path)
            # Without the flag a version is one more entry of that path, and the first entry counts.
            if old is None or (multi and version > old[-1]):
                rows[path] = ord_, name, root, version
        ends = places(z.infolist(), z.start_dir)
        for path, (ord_, name, root, version) in rows.items():
            i = infos[name]
            mode = i.external_attr >> 16
            yield blank | {
                "ord": ord_, "path": path, "path_in_element": name, "root": root, "is_classfile": path.lower().endswith(".class"), "version": version, "length": i.file_size,
                "compressed_length": i.compress_size, "mtime": _entry_time(i), "posix_mode": stat.S_IMODE(mode) if i.create_system == 3 and mode else None, "manifest": list(manifest.items()) if ord_ == 0 else None, "place": place(i, ends),
            }
        if o.nested:
            bundled = {sanitize(p) for p in child_paths(manifest)}
            for name, i in infos.items():
                if ARCHIVE.search(name) and (name.startswith(LIB_DIRS) or name in bundled) and _names_ok(name, o):
                    chain = f"{nested}!/{name}" if nested else name
                    try:
                        inner = spool(z, i)
                    except (zipfile.BadZipFile, OSError, ValueError) as e:
                        yield blank | {"nested": chain, "error": f"{type(e).__name__}: {e}"}
                        continue
                    yield from list_archive(inner, element, chain, o)


def spool(z: zipfile.ZipFile, info):
    """An entry as a seekable file: in memory while small."""
    import shutil
    import tempfile

    out = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
    with z.open(info) as src:
        shutil.copyfileobj(src, out, 1 << 20)
    out.seek(0)
    return out


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    part: list[dict] = []
    for r in rows:
        part.append(r)
        if len(part) >= 10_000:
            yield pa.RecordBatch.from_pylist(part, schema=_SCHEMA)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=_SCHEMA)


def check_scheme(path: str, options: ArchiveOptions) -> None:
    scheme = path.split(":", 1)[0].lower() if has_scheme(path) else ""
    if scheme in REMOTE and not options.allow_remote:
        raise ValueError(f"{scheme} locations are off unless asked for: {path}")


def archive_files(spark: SparkSession, paths: list[str], options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """(element, length, mtime) of archives below the paths, each once however often it is reached, without reading one; file
    names are filtered before."""
    for p in paths:
        check_scheme(p, options)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("path").alias("element"), "length", F.col("modificationTime").alias("mtime"))
    name = F.lower(F.element_at(F.split("element", "/"), -1))
    from bytegrove.functions.globs import Filter

    return files.where(name.rlike(ARCHIVE.pattern)).where(Filter("leaf", options.accept_names, options.reject_names).accepted(F.col("element"))).dropDuplicates(["element"])


def list_entries(files: DataFrame, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """Columns of ``ENTRIES`` for all archives of (element, ...), one task for some archives each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for element in b.column(0).to_pylist():
                    try:
                        with open_file(element) as f:
                            yield from list_archive(f, element, "", options)
                    except OSError as e:
                        yield dict.fromkeys(_SCHEMA.names) | {"element": element, "nested": "", "error": str(e)}

        yield from _batches(rows())

    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("element").repartition(n, "element").mapInArrow(run, ENTRIES)


def list_contents(archives: DataFrame, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """Columns of ``ENTRIES`` for archives that are given as bytes, (element, content), from whatever table or stream; without
    content an element is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for element, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield from list_archive(io.BytesIO(content or b""), element, "", options)

        yield from _batches(rows())

    return archives.select("element", "content").mapInArrow(run, ENTRIES)


def directory_entries(spark: SparkSession, root: str) -> DataFrame:
    """(element, path, length, mtime, order_key, is_classfile) of the files below a directory.

    ``order_key`` sorts the files of a directory before its sub-directories, each by name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("mtime"))
    at = root.rstrip("/").split(":", 1)[-1].lstrip("/") if has_scheme(root) else root.strip("/")
    rel = F.regexp_replace("path", r"^[a-z0-9]+:/*", "")
    rel = F.substring(rel, len(at) + 2, 1 << 20)
    parts = F.split(rel, "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    key = F.array_join(F.concat(F.transform(above, lambda s: F.concat(F.lit("1"), s)), F.array(F.concat(F.lit("0"), F.element_at(parts, -1)))), "\x01")
    return files.select(F.lit(root).alias("element"), rel.alias("path"), "length", "mtime", key.alias("order_key"), F.lower(rel).endswith(".class").alias("is_classfile"))


def directory_listing(spark: SparkSession, root: str) -> DataFrame:
    """Columns of ``ENTRIES`` for a directory as one element, its name with a slash at the end.

    ``ord`` spreads files over tasks and is no order; that of a walk is ``order_key`` of ``directory_entries``. Archives
    within are files like others here.
    """
    e = directory_entries(spark, root)
    none = {"root": "''", "version": "8", "compressed_length": "length", "posix_mode": "cast(null as int)", "manifest": "cast(null as map<string,string>)", "error": "cast(null as string)", "place": "cast(null as struct<at:bigint,method:int,crc:bigint>)"}
    have = {"element": F.lit(root.rstrip("/") + "/"), "nested": F.lit(""), "ord": F.pmod(F.xxhash64("path"), F.lit(1 << 24)).cast("int"), "path_in_element": F.col("path")}
    names = _SCHEMA.names
    return e.select(*((have[n] if n in have else F.expr(none[n]) if n in none else F.col(n)).alias(n) for n in names))


def read_entries(entries: DataFrame, handle, schema: str, options: ArchiveOptions = ArchiveOptions(), tasks: int | None = None) -> DataFrame:
    """``handle(rows)`` over the contents of entries, where rows are (element, nested, path, ord, bytes or None, error).

    ``entries`` needs element, nested, path, path_in_element and ord. An element that ends in a slash is a directory, any
    other an archive, whose directory is read only for entries that come without length, compressed_length and place. The
    handler gives record batches of ``schema``. ``tasks`` is for few entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now: tuple | None = None
            for b in batches:
                for element, nested, path, name, ord_, compressed, length, where in zip(*(c.to_pylist() for c in b.columns)):
                    try:
                        if element.endswith("/"):
                            with open_file(element + name) as f:
                                yield element, nested, path, ord_, f.read(), None
                            continue
                        if now != (element, nested):
                            now, z = None, None
                            f = open_file(element)
                            for step in [s for s in (nested or "").split("!/") if s]:
                                outer = zipfile.ZipFile(f)
                                f = spool(outer, _info(outer, step))
                            now = element, nested
                        if where is not None:
                            data = read_at(f, name, compressed, length, where)
                        else:
                            z = z or zipfile.ZipFile(f)
                            data = z.read(_info(z, name))
                        yield element, nested, path, ord_, data, None
                    except (zipfile.BadZipFile, zlib.error, OSError, KeyError, ValueError, NotImplementedError, EOFError) as e:
                        yield element, nested, path, ord_, None, f"{type(e).__name__}: {e}"

        yield from handle(rows())

    chunk = F.floor(F.col("ord") / ENTRIES_PER_TASK).cast("int")
    n = tasks or max(2, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    have = {"compressed_length", "length", "place"} <= set(entries.columns)
    lies = ("compressed_length", "length", "place") if have else (F.lit(None).cast("bigint").alias("compressed_length"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("struct<at:bigint,method:int,crc:bigint>").alias("place"))
    spread = entries.select("element", "nested", "path", "path_in_element", "ord", *lies).repartition(n, "element", "nested", chunk)
    return spread.sortWithinPartitions("element", "nested", "ord").mapInArrow(run, schema)


def _info(z: zipfile.ZipFile, name: str) -> zipfile.ZipInfo:
    """The first entry of this sanitised name."""
    index = getattr(z, "by_clean_name", None)
    if index is None:
        index = {}
        for i in z.infolist():
            index.setdefault(sanitize(i.filename), i)
        z.by_clean_name = index
    return index[name]


def map_contents(entries: DataFrame, function, schema: str, *, strict: bool = True, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    """``function(path, content)`` of each entry gives the rows of ``schema`` as tuples, on the tasks that read the contents.

    An entry that can't be read ends the job if ``strict``, and is left out otherwise.
    """
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def handle(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(target), []
        for _, _, path, _, data, error in rows:
            if error is not None:
                if strict:
                    raise OSError(f"{path}: {error}")
                continue
            part.extend(function(path, data))
            if len(part) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return read_entries(entries, handle, schema, options)
