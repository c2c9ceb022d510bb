"""Scanning archives into the class graph: list, filter, mask, parse, link."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bytegrove.catalog import Catalog, Scope
from bytegrove.functions.globs import Filter
from bytegrove.functions.names import package_of, path_to_class
from bytegrove.functions.paths import ARCHIVE, has_scheme, sanitize
from bytegrove.operators.dependencies import value_classes
from bytegrove.operators.members import containers_of, unwrap_repeatable
from bytegrove.operators.resources import element_order, elements_with_paths, unmasked
from bytegrove.operators.skew import numbered, union_all
from bytegrove.scratch import Scratch
from bytegrove.sources.archives import ENTRIES, ArchiveOptions, archive_files, directory_listing, list_entries, read_entries
from bytegrove.sources.classfile import ClassFile, ClassFormatError


@dataclass(frozen=True)
class ScanConfig:
    """What to scan and to read. Without accepted packages everything is accepted; rejecting wins."""

    accept_packages: tuple[str, ...] = ()
    #: Packages accepted without those below them.
    accept_packages_flat: tuple[str, ...] = ()
    reject_packages: tuple[str, ...] = ()
    accept_modules: tuple[str, ...] = ()
    reject_modules: tuple[str, ...] = ()
    accept_classes: tuple[str, ...] = ()
    reject_classes: tuple[str, ...] = ()
    ignore_class_visibility: bool = True
    ignore_member_visibility: bool = True
    invisible_annotations: bool = True
    external_classes: bool = False
    directories: bool = True
    archive_files: bool = True
    #: Keeps elements; a Column over ``element`` and ``nested``.
    element_filter: Column | None = None
    #: Keeps elements that hold one of these paths (any if none is named), and none of those; paths may be globs.
    accept_element_paths: tuple[str, ...] = ()
    reject_element_paths: tuple[str, ...] = ()
    #: List the elements and their entries only: nothing is parsed, and there is no graph.
    class_path_only: bool = False
    extend_to_external: bool = True
    #: Scan archives that manifests name in Class-Path too.
    follow_class_path: bool = True
    reads: frozenset[str] = field(default_factory=lambda: frozenset({"class", "field", "method", "annotation", "refs"}))
    archives: ArchiveOptions = ArchiveOptions()

    def scope(self) -> Scope:
        return Scope(self.accept_packages, self.reject_packages, self.reject_classes, self.external_classes, self.reads)


_MEMBER = [("ord", pa.int32()), ("name", pa.string()), ("descriptor", pa.string()), ("modifiers", pa.int32()), ("signature", pa.string())]
_VALUES = pa.list_(pa.struct([("name", pa.string()), ("value_json", pa.string())]))
_CLASS = pa.schema(
    [
        ("element", pa.string()), ("nested", pa.string()), ("path", pa.string()), ("ord", pa.int32()), ("parse_error", pa.string()), ("class_name", pa.string()), ("modifiers", pa.int32()), ("is_record", pa.bool_()),
        ("minor", pa.int32()), ("major", pa.int32()), ("type_signature", pa.string()), ("source_file", pa.string()), ("defining_method", pa.string()), ("module_name", pa.string()), ("superclass", pa.string()),
        ("interfaces", pa.list_(pa.string())), ("inner", pa.list_(pa.struct([("inner", pa.string()), ("outer", pa.string()), ("modifiers", pa.int32())]))),
        ("fields", pa.list_(pa.struct([*_MEMBER, ("const_json", pa.string())]))),
        ("methods", pa.list_(pa.struct([*_MEMBER, ("has_body", pa.bool_()), ("min_line", pa.int32()), ("max_line", pa.int32()), ("thrown", pa.list_(pa.string()))]))),
        ("params", pa.list_(pa.struct([("method_ord", pa.int32()), ("idx", pa.int32()), ("name", pa.string()), ("modifiers", pa.int32()), ("descriptor", pa.string()), ("signature", pa.string())]))),
        ("annotations", pa.list_(pa.struct([("target_kind", pa.string()), ("member_ord", pa.int32()), ("param_idx", pa.int32()), ("ord", pa.int32()), ("annotation", pa.string()), ("visible", pa.bool_()), ("params", _VALUES)]))),
        ("type_annotations", pa.list_(pa.struct([("target_kind", pa.string()), ("member_ord", pa.int32()), ("target_type", pa.int32()), ("target_info", pa.list_(pa.int32())), ("path", pa.list_(pa.struct([("kind", pa.int32()), ("arg", pa.int32())]))), ("annotation", pa.string()), ("visible", pa.bool_()), ("params", _VALUES)]))),
        ("defaults", pa.list_(pa.struct([("ord", pa.int32()), ("name", pa.string()), ("value_json", pa.string())]))), ("refs", pa.list_(pa.string())),
    ]
)


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in t) + ">"
    return {"int32": "int", "string": "string", "bool": "boolean"}[str(t)]


CLASS_DDL = ", ".join(f"{f.name} {_ddl(f.type)}" for f in _CLASS)
#: Archives within an archive come after those that its manifest names.
NESTED_LAST = 1 << 20
#: What it takes to order class files and to read them.
_PLACED = ("cp_idx", "element", "nested", "path", "path_in_element", "ord", "compressed_length", "length", "place")
#: Names asked for that make one more task worth while; tables of them that are merged into one.
NAMES_PER_TASK, MERGED = 256, 8
#: Parsed classes per batch handed to the JVM.
BATCH = 500


def parse_classes(entries: DataFrame, config: ScanConfig = ScanConfig(), tasks: int | None = None) -> DataFrame:
    """One row per class file, as ``CLASS_DDL``; unreadable ones have ``parse_error`` and no class_name.

    What the config leaves out is not parsed. A class whose name is not that of its path is an error, as is bad format;
    neither ends the scan.
    """
    invisible, members, refs = config.invisible_annotations, bool({"method", "field"} & config.reads), "refs" in config.reads
    only_public = not config.ignore_class_visibility

    def handle(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        part: list[dict] = []
        for element, nested, path, ord_, data, error in rows:
            head = dict.fromkeys(_CLASS.names) | {"element": element, "nested": nested, "path": path, "ord": ord_, "parse_error": error}
            if data is not None:
                try:
                    c = ClassFile(data, invisible=invisible, members=members, refs=refs)
                    if path.lower().endswith(".class") and path[:-6].replace("/", ".") != c.name and not path.endswith("module-info.class"):
                        raise ClassFormatError(f"{c.name} in {path}")
                    if only_public and not c.flags & 1 and not c.name.endswith("-info"):
                        continue
                    head |= c.record()
                except (ClassFormatError, ValueError, IndexError, KeyError, struct.error, RecursionError) as e:
                    head["parse_error"] = f"{type(e).__name__}: {e}"
            part.append(head)
            if len(part) >= BATCH:
                yield pa.RecordBatch.from_pylist(part, schema=_CLASS)
                part = []
        if part:
            yield pa.RecordBatch.from_pylist(part, schema=_CLASS)

    return read_entries(entries, handle, CLASS_DDL, config.archives, tasks)


class Scan:
    """Tables of one scan: elements, entries, resources, parsed, errors, params, defaults, type_annotations, class_refs,
    and ``catalog()`` for the graph."""

    def __init__(self, spark: SparkSession, paths: list[str], config: ScanConfig = ScanConfig()):
        self.spark, self.config = spark, config
        sc = self.scratch = Scratch(spark, "scan")
        if config.archives.all_versions and config.reads:
            raise ValueError("listing every version of an entry excludes class info: set reads=frozenset()")
        if any("*" in p or "?" in p for p in config.accept_packages_flat):
            raise ValueError("a package that is accepted without those below it can't be a pattern")
        listed = list_entries(archive_files(spark, paths, config.archives), config.archives) if config.archive_files else spark.createDataFrame([], ENTRIES)
        if config.directories:
            for p in paths:
                if not ARCHIVE.search(p) and not any(c in p for c in "*?["):
                    found = directory_listing(spark, p)
                    # What lies below another root of the scan is that root's alone.
                    for other in paths:
                        if other.rstrip("/").startswith(p.rstrip("/") + "/"):
                            found = found.where(~F.col("path").startswith(other.rstrip("/")[len(p.rstrip("/")) + 1 :] + "/"))
                    listed = listed.unionByName(found.where(~F.lower("path").rlike(ARCHIVE.pattern)))
        listed = sc.save(listed, "listed")
        links: DataFrame | None = None
        if config.follow_class_path:
            listed, links = self._follow(listed)
        self.errors_listing = listed.where("error is not null").select("element", "nested", "error")
        # A first number by the place of the path in the request and by name; then parents before what they bring along.
        place = F.coalesce(*(F.when(F.regexp_replace("element", r"^file:/*", "/").startswith(p.removeprefix("file:").rstrip("/")), i) for i, p in enumerate(paths)), F.lit(len(paths)))
        el = listed.groupBy("element", "nested").agg(F.first("manifest", ignorenulls=True).alias("manifest"))
        el = el.withColumns({"place": place, "level": F.length(F.regexp_replace("nested", "[^!]", ""))})
        el = numbered(el, ["place", "element", "level", "nested"], "id").select("element", "nested", "manifest", F.col("id").cast("int").alias("id"))
        el = sc.save(el, "numbered")
        inside = el.where("nested <> ''").select("element", F.regexp_replace("nested", r"(^|!/)[^!]*$", "").alias("up"), F.col("id").alias("cp_idx"), (F.col("id") + NESTED_LAST).alias("i"))
        parents = inside.join(el.select("element", F.col("nested").alias("up"), F.col("id").alias("parent_idx")), ["element", "up"]).select("cp_idx", "parent_idx", "i")
        if links is not None:
            ids = el.where("nested = ''").select("element", "id")
            by = links.join(ids.withColumnRenamed("id", "cp_idx"), "element").drop("element").join(ids.select(F.col("element").alias("parent"), F.col("id").alias("parent_idx")), "parent")
            parents = parents.unionByName(by.select("cp_idx", "parent_idx", "i"))
        order = el.select(F.col("id").alias("cp_idx"), F.lit("zip").alias("kind")).join(parents.withColumnRenamed("i", "idx_in_parent"), "cp_idx", "left")
        positions = element_order(order).select(F.col("cp_idx").alias("id"), F.col("position").cast("int").alias("cp_idx"))
        el = el.join(positions, "id").drop("id")
        if not config.archives.platform:
            el = el.where(~_platform(F.col("manifest")))
        if config.element_filter is not None:
            el = el.where(config.element_filter)
        el = sc.save(el, "kept")
        # A module's name is read from its descriptor even if the root package isn't accepted, or else from the manifest.
        descriptors = parse_classes(listed.where("error is null and path = 'module-info.class'").join(el.select("element", "nested"), ["element", "nested"]), config)
        named = descriptors.where("module_name is not null").groupBy("element", "nested").agg(F.first("module_name").alias("descriptor"))
        el = el.join(named, ["element", "nested"], "left").withColumn("module_name", F.coalesce("descriptor", F.element_at("manifest", "automatic-module-name")))
        modules = Filter("whole", config.accept_modules, config.reject_modules, ".")
        if config.accept_modules or config.reject_modules:
            el = el.where(F.col("module_name").isNull() | modules.accepted(F.col("module_name")))
        self.elements = sc.save(el, "elements")
        entries = listed.where("error is null").join(self.elements.select("element", "nested", "cp_idx"), ["element", "nested"])
        if config.accept_element_paths or config.reject_element_paths:
            some = elements_with_paths(self.elements, entries.select("cp_idx", "path"), list(config.accept_element_paths), list(config.reject_element_paths))
            self.elements = sc.save(some, "elements")
            entries = entries.join(self.elements.select("cp_idx"), "cp_idx", "left_semi")
        # Classes without a package don't belong to a module.
        modular = self.elements.where("descriptor is not null").select("cp_idx")
        loose = F.lower("path").rlike(r"^[^/]*\.class$") & (F.col("path") != "module-info.class")
        entries = entries.where(~loose).unionByName(entries.where(loose).join(modular, "cp_idx", "left_anti").select(*entries.columns))
        self.entries = sc.save(entries, "entries")
        package = F.when(F.col("is_classfile"), package_of(path_to_class("path"))).otherwise(F.translate(F.regexp_replace("path", r"/?[^/]*$", ""), "/", "."))
        wanted = Filter("prefix", config.accept_packages, config.reject_packages, ".").accepted(package)
        if config.accept_packages_flat:
            flat = package.isin(*config.accept_packages_flat) & ~Filter("prefix", (), config.reject_packages, ".").rejected(package)
            wanted = (wanted | flat) if config.accept_packages else flat
        if config.accept_classes:
            named = path_to_class("path").isin(*config.accept_classes)
            wanted = (wanted | named) if config.accept_packages or config.accept_packages_flat else named
        if config.reject_classes:
            wanted = wanted & ~F.coalesce(path_to_class("path").isin(*config.reject_classes), F.lit(False))
        self.resources = self.entries.where(F.coalesce(wanted, F.lit(False)) & ~F.col("path").endswith("module-info.class"))
        if config.class_path_only:
            self.errors = self.errors_listing.select("element", "nested", F.lit(None).cast("string").alias("path"), "error")
            return
        own = unmasked(self.resources.where("is_classfile").select(*_PLACED))
        self.parsed = sc.save(parse_classes(own, config).withColumn("is_external", F.lit(False)), "parsed")
        if config.extend_to_external:
            self._extend()
        self.errors = self.parsed.where("parse_error is not null").select("element", "nested", "path", F.col("parse_error").alias("error")).unionByName(
            self.errors_listing.select("element", "nested", F.lit(None).cast("string").alias("path"), "error")
        )
        self.parsed = self.parsed.where("parse_error is null and class_name is not null")

    def _follow(self, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Listings with those of archives that manifests name beside them, and (element, parent, i) for these; the first
        archive that names another is its parent. Archives that aren't there are passed over."""
        sc = self.scratch
        every, newest, links = listed, listed, None
        while True:
            named = newest.where("nested = '' and manifest is not null").select(F.col("element").alias("parent"), F.posexplode(_class_path("element", "manifest")).alias("i", "element"))
            first = named.groupBy("element").agg(F.min(F.struct("parent", "i")).alias("f")).select("element", "f.parent", "f.i")
            fresh = sc.save(first.join(every.select("element").distinct(), "element", "left_anti"), "named")
            if fresh.isEmpty():
                return every, links if links is not None else fresh
            newest = sc.save(list_entries(fresh, self.config.archives).where("error is null or not error like '%No such file%'"), "listed")
            links = fresh if links is None else links.unionByName(fresh)
            every = every.unionByName(newest)

    def _extend(self) -> None:
        """Superclasses, interfaces, outer classes, annotations and exceptions outside the accepted packages, until no more
        are found: each round parses only names that were never asked for. A chain takes as many rounds as it is long, so a
        round is two jobs, and what it reads is as much as it finds, but for the names of the index."""
        sc = self.scratch
        index = unmasked(self.entries.where("is_classfile").select(*_PLACED)).withColumn("class_name", path_to_class("path"))
        reject = Filter("prefix", (), self.config.reject_packages, ".").rejected(package_of("class_name"))
        index = index.where(~reject & (F.col("class_name") != "java.lang.Object"))
        own = self.parsed.select("class_name").where("class_name is not null")
        index = sc.save(index.join(own, "class_name", "left_anti"), "index")
        n_tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        newest, asked, found = self.parsed, [], []
        while True:
            names = referenced(newest)
            if asked:
                names = names.join(union_all(asked), "class_name", "left_anti")
            names, n = sc.counted(names, "names", n=F.count(F.lit(1)))
            asked.append(names)
            if len(asked) >= MERGED:
                parts, asked = asked, [sc.save(union_all(asked).coalesce(n_tasks), "asked")]
            todo = index.join(names, "class_name", "left_semi").drop("class_name")
            parsed = parse_classes(todo, self.config, min(n_tasks, 1 + n["n"] // NAMES_PER_TASK)).withColumn("is_external", F.lit(True))
            newest, n = sc.counted(parsed, "external", n=F.count(F.lit(1)))
            if len(asked) == 1 and asked[0] is not names:
                sc.drop(*parts)
            if not n["n"]:
                break
            found.append(newest)
        if len(found) > 1:  # one table instead of one for each round, for all who ask later
            parts, found = found, [sc.save(union_all(found).coalesce(n_tasks), "external")]
            sc.drop(*parts)
        self.parsed = union_all([self.parsed, *found])

    def _each(self, column: str, *keys: str) -> DataFrame:
        return self.parsed.select("class_name", *keys, F.explode(column).alias("x")).select("class_name", *keys, "x.*")

    def members(self, column: str) -> DataFrame:
        """Methods or fields; only public ones unless their visibility is ignored."""
        every = self._each(column)
        return every if self.config.ignore_member_visibility else every.where(F.col("modifiers").bitwiseAND(1) != 0)

    @property
    def modules(self) -> DataFrame:
        """(name, location) of elements that are modules."""
        return self.elements.where("module_name is not null").select(F.col("module_name").alias("name"), "element")

    @property
    def params(self) -> DataFrame:
        return self._each("params")

    @property
    def defaults(self) -> DataFrame:
        return self._each("defaults").withColumnRenamed("class_name", "annotation")

    @property
    def type_annotations(self) -> DataFrame:
        return self._each("type_annotations")

    @property
    def class_refs(self) -> DataFrame:
        return self.parsed.select(F.col("class_name").alias("src"), F.explode("refs").alias("dst")).distinct()

    def classes(self) -> DataFrame:
        """Parsed classes with access bits as their enclosing classes declare them: these replace the access bits, other bits add up."""
        inner = self.parsed.select(F.explode("inner").alias("x")).where("x.modifiers is not null").groupBy(F.col("x.inner").alias("class_name")).agg(F.bit_or("x.modifiers").alias("bits"))
        p = self.parsed.drop("module_name").join(inner, "class_name", "left").join(self.elements.select("element", "nested", "cp_idx", "module_name"), ["element", "nested"])
        flags = F.when(F.col("bits").isNull(), F.col("modifiers")).otherwise((F.col("modifiers").bitwiseAND(~7)).bitwiseOR(F.col("bits")))
        inherited = F.exists("annotations", lambda a: (a["target_kind"] == "class") & (a["annotation"] == "java.lang.annotation.Inherited"))
        return p.select(
            "class_name", flags.alias("modifiers"), "is_record", F.lit(False).alias("is_array"), "is_external", F.lit(True).alias("is_scanned"), "minor", "major", "type_signature", "source_file", "defining_method", "cp_idx",
            F.col("path").alias("resource_path"), package_of("class_name").alias("package_name"), "module_name", inherited.alias("inherited_meta"), F.lit(None).cast("timestamp").alias("scanned_at"),
        )

    def edges(self) -> DataFrame:
        p, is_itf = self.parsed, F.col("modifiers").bitwiseAND(0x200) != 0
        none = F.lit(None).cast("boolean")
        ext = p.where(F.col("superclass").isNotNull() & ~is_itf).select(F.lit("extends").alias("rel"), F.col("class_name").alias("src"), F.col("superclass").alias("dst"), F.lit(0).alias("ord"), none.alias("nonprivate"))
        imp = p.select(F.lit("implements").alias("rel"), F.col("class_name").alias("src"), F.posexplode("interfaces").alias("ord", "dst")).select("rel", "src", "dst", "ord", none.alias("nonprivate"))
        inn = p.select(F.explode("inner").alias("x")).where("x.outer is not null").select(F.lit("inner_of").alias("rel"), F.col("x.inner").alias("src"), F.col("x.outer").alias("dst"), F.lit(0).alias("ord"), none.alias("nonprivate"))
        # The edges of containers stay beside those of what they hold.
        a = self._each("annotations")
        a = a.unionByName(self._unwrapped().drop("sub_ord").select(*a.columns)).distinct()
        flags = self._each("methods").select("class_name", F.lit("method").alias("k"), F.col("ord").alias("member_ord"), F.col("modifiers").alias("m")).unionByName(
            self._each("fields").select("class_name", F.lit("field").alias("k"), F.col("ord").alias("member_ord"), F.col("modifiers").alias("m"))
        )
        a = a.withColumn("k", F.when(F.col("target_kind") == "field", "field").otherwise("method")).join(flags, ["class_name", "k", "member_ord"], "left")
        rel = F.when(F.col("target_kind") == "class", "class_ann").when(F.col("target_kind") == "field", "field_ann").when(F.col("target_kind") == "param", "method_param_ann").otherwise("method_ann")
        ann = a.select(rel.alias("rel"), F.col("class_name").alias("src"), F.col("annotation").alias("dst"), "ord", F.when(F.col("target_kind") != "class", F.col("m").bitwiseAND(2) == 0).alias("nonprivate"))
        return ext.unionByName(imp).unionByName(inn).unionByName(ann)

    def annotations(self) -> DataFrame:
        """Annotations with their ids; containers of repeated ones are replaced by what they hold."""
        a = self._unwrapped()
        key = F.xxhash64("class_name", "target_kind", "member_ord", "param_idx", "ord", "sub_ord", "annotation", F.to_json("params"))
        return a.withColumn("ann_id", key).drop("sub_ord")

    def _unwrapped(self) -> DataFrame:
        a = self._each("annotations")
        return unwrap_repeatable(a, containers_of(a))

    def catalog(self) -> Catalog:
        return Catalog(self.classes(), self.edges(), self.members("methods"), self.members("fields"), self.annotations(), self.elements, None, self.config.scope())


def referenced(parsed: DataFrame) -> DataFrame:
    """(class_name) distinct names that a class leans on: superclass, interfaces, outer class, exceptions, annotations, and the
    annotations, enumerations and classes in their values."""
    own = F.filter("inner", lambda x: x["inner"] == F.col("class_name"))
    names = F.flatten(
        F.array(
            F.array_compact(F.array("superclass")), F.coalesce("interfaces", F.array()), F.coalesce(F.transform("annotations", lambda a: a["annotation"]), F.array()),
            F.coalesce(F.flatten(F.transform("annotations", lambda a: value_classes(F.coalesce(a["params"], F.array())))), F.array()),
            F.coalesce(F.array_compact(F.transform(own, lambda x: x["outer"])), F.array()), F.coalesce(F.flatten(F.transform("methods", lambda m: m["thrown"])), F.array()),
        )
    )
    return parsed.where("class_name is not null").select(F.explode(names).alias("class_name")).where("class_name is not null").distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _class_path(element: pd.Series, manifest: pd.Series) -> pd.Series:
    """Archives that a manifest's Class-Path names, as locations beside the archive; others than archives are left out."""
    out = []
    for e, m in zip(element, manifest):
        names = [p for p in dict(m).get("class-path", "").split() if ARCHIVE.search(p)]
        base = e.rsplit("/", 1)[0]
        scheme = re.match(r"[a-z][a-z0-9+.-]+:/*", base)
        head = scheme.group() if scheme else "/"
        out.append([p if has_scheme(p) else head + sanitize((p if p.startswith("/") else f"{base[len(head):]}/{p}")) for p in names])
    return pd.Series(out)


def _platform(manifest):
    m = F.coalesce(manifest, F.create_map().cast("map<string,string>"))
    return (F.coalesce(m["implementation-title"], F.lit("")) == "Java Runtime Environment") | (F.coalesce(m["specification-title"], F.lit("")) == "Java Platform API Specification")


def scan(spark: SparkSession, paths: list[str], config: ScanConfig = ScanConfig()) -> Scan:
    return Scan(spark, paths, config)
