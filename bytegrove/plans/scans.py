"""Queries over archives: the tables are written out as archives of class files, listed, read, parsed and scanned, and SQL
says from the same tables what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytegrove.catalog import OBJECT, SQL_ANNOTATIONS, SQL_CLASSES, SQL_FIELDS, SQL_METHODS, Catalog
from bytegrove.functions.modifiers import INTERFACE
from bytegrove.functions.names import sql_class_name
from bytegrove.functions.paths import automatic_module_name_column
from bytegrove.plans.graph import _VALUES
from bytegrove.scratch import Scratch
from bytegrove.sinks.archives import FUTURE, VERSION, write_archives
from bytegrove.sources.archives import ArchiveOptions, archive_files, list_entries
from bytegrove.sources.scan import ScanConfig, parse_classes, scan

EVERY = 3
_WRITTEN: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def archives(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(folder, what was written) of the archives of the tables; written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        sc = Scratch(spark, "archives")
        root = f"{sc.root}/jars"
        _WRITTEN[key] = root, sc.save(write_archives(Catalog.load(spark, sf_dir), root, multi_release_every=EVERY, damage=True), "written")
    return _WRITTEN[key]


def _archive() -> F.Column:
    return F.element_at(F.split("element", "/"), -1).alias("archive")


def _entries(spark: SparkSession, sf_dir: str, options: ArchiveOptions = ArchiveOptions()) -> DataFrame:
    return list_entries(archive_files(spark, [archives(spark, sf_dir)[0]], options), options)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_classes(_entries(spark, sf_dir).where("is_classfile and error is null"))


def s1_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element with the entries of its archive as they were written."""
    return archives(spark, sf_dir)[1].select("cp_idx", _archive(), "n_entries")


def s2_archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive: entries after versions are resolved, class files, those of newer versions, and errors."""
    return _entries(spark, sf_dir).groupBy(_archive()).agg(
        F.count("path").alias("n_entries"), F.count_if("is_classfile").alias("n_classes"), F.count_if(F.col("version") > 8).alias("n_versioned"), F.count("error").alias("n_errors")
    )


def s7_from_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive listed from its bytes, as a table of contents holds them."""
    from bytegrove.sources.archives import list_contents

    given = spark.read.format("binaryFile").load(archives(spark, sf_dir)[0]).select(F.col("path").alias("element"), "content")
    return list_contents(given).groupBy(_archive()).agg(F.count("path").alias("n_entries"), F.count_if("is_classfile").alias("n_classes"), F.count_if(F.col("version") > 8).alias("n_versioned"), F.count("error").alias("n_errors"))


def s5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class files by path and version, with versions resolved and with every version under its own path."""
    one = _entries(spark, sf_dir).where("is_classfile").select(F.lit("newest").alias("how"), _archive(), "path", "version")
    every = _entries(spark, sf_dir, ArchiveOptions(all_versions=True)).where("is_classfile").select(F.lit("all").alias("how"), _archive(), "path", "version")
    return one.unionByName(every)


def s8_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as they are read from the archives, with the module name each element would have."""
    m = _entries(spark, sf_dir).where("manifest is not null").select(_archive(), "manifest")
    e = Catalog.load(spark, sf_dir).raw["elements"].select("cp_idx", F.concat(F.lit("e"), F.lpad(F.col("cp_idx").cast("string"), 3, "0"), F.lit(".jar")).alias("archive"), "module_name", "uri")
    name = F.coalesce("module_name", F.element_at("manifest", "automatic-module-name"), automatic_module_name_column("uri"))
    return e.join(m, "archive").select("cp_idx", name.alias("module_name"), F.size("manifest").alias("n_manifest"), F.element_at("manifest", "bundle-name").alias("bundle"), F.coalesce(F.lower(F.element_at("manifest", "multi-release")) == "true", F.lit(False)).alias("is_multi_release"))


def s15_parsed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class file of every archive with what it says of its class."""
    own = F.filter("inner", lambda x: x["inner"] == F.col("class_name"))
    return _parsed(spark, sf_dir).where("parse_error is null").select(
        _archive(), "class_name", "modifiers", "superclass", F.array_join("interfaces", " ").alias("interfaces"), "major", "minor", "type_signature", "source_file", "is_record",
        F.get(F.transform(own, lambda x: x["outer"]), 0).alias("outer"), F.size("methods").alias("n_methods"), F.size("fields").alias("n_fields"),
    )


def s16_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every class file, with the constants that they hold."""
    f = _parsed(spark, sf_dir).where("parse_error is null").select(_archive(), "class_name", F.explode("fields").alias("x"))
    return f.select("archive", "class_name", "x.ord", "x.name", "x.descriptor", "x.modifiers", F.get_json_object("x.const_json", "$.v").alias("constant"))


def s17_annotation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of classes, members and parameters in the class files, with those of their values that are no arrays."""
    a = _parsed(spark, sf_dir).where("parse_error is null").select("class_name", F.explode("annotations").alias("a"))
    v = a.select("class_name", "a.target_kind", F.coalesce("a.member_ord", F.lit(0)).alias("place"), F.coalesce("a.param_idx", F.lit(-1)).alias("param_idx"), "a.annotation", "a.visible", F.explode_outer("a.params").alias("p"))
    j = lambda path: F.get_json_object("p.value_json", path)
    value = F.when(j("$.t") == "e", F.concat_ws(".", j("$.class"), j("$.name"))).when(j("$.t") != "[", j("$.v"))
    return v.select("class_name", "target_kind", "place", "param_idx", "annotation", "visible", F.col("p.name").alias("name"), j("$.t").alias("tag"), value.alias("value")).distinct()


def s18_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of every class file: signature, body, line numbers, thrown exceptions."""
    m = _parsed(spark, sf_dir).where("parse_error is null").select(_archive(), "class_name", F.explode("methods").alias("x"))
    return m.select("archive", "class_name", "x.ord", "x.name", "x.descriptor", "x.modifiers", "x.signature", "x.has_body", "x.min_line", "x.max_line", F.array_join("x.thrown", " ").alias("thrown"))


def s16_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the methods in the class files: their types, and how many there are."""
    m = _parsed(spark, sf_dir).where("parse_error is null").select("class_name", F.explode("params").alias("x"))
    return m.select("class_name", "x.method_ord", "x.idx", "x.descriptor").distinct()


def s20_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that the constant pools name."""
    return _parsed(spark, sf_dir).where("parse_error is null").select("class_name", F.explode("refs").alias("ref")).distinct()


def s21_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold no whole class, or another class than their path says: rows, and no end of the job."""
    p = _parsed(spark, sf_dir).where("parse_error is not null")
    return p.select(_archive(), "path", F.when(F.col("parse_error").contains(" in "), "misnamed").otherwise("damaged").alias("fault"))


ACCEPTED = ("brenvo.depot", "fennik")


def scan_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scan with two accepted packages: their classes, the first of each path, and the classes outside that these lean
    on, directly or through others."""
    s = scan(spark, [archives(spark, sf_dir)[0]], ScanConfig(accept_packages=ACCEPTED))
    return s.catalog().raw["classes"].select("class_name", "is_external", "cp_idx")


QUERIES = {
    f.__name__: f
    for f in (s1_written, s2_archive_entries, s5_versions, s7_from_bytes, s8_manifests, s15_parsed_classes, s16_constants, s17_annotation_values, s18_methods, s16_parameters, s20_references, s21_bad_files, scan_classes)
}

_NAME = "'e' || lpad(CAST(cp_idx AS VARCHAR), 3, '0') || '.jar'"
_FILES = f"""file_ AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT cp_idx, {_NAME} AS archive, resource_path AS path, {sql_class_name("class_name")} AS class_name, coalesce(modifiers, 0) AS modifiers, coalesce(is_record, false) AS is_record, coalesce(major, 52) AS major, coalesce(minor, 0) AS minor, type_signature, source_file,
      row_number() OVER (PARTITION BY cp_idx, resource_path ORDER BY class_name, classes.modifiers NULLS FIRST, classes.is_record NULLS FIRST, classes.major NULLS FIRST, classes.minor NULLS FIRST, type_signature NULLS FIRST, source_file NULLS FIRST) AS rn
    FROM classes WHERE cp_idx IS NOT NULL AND resource_path IS NOT NULL AND class_name IS NOT NULL) WHERE rn = 1)"""
_MULTI = f"cp_idx IN (SELECT cp_idx FROM cp_elements WHERE cp_idx % {EVERY} = 0 OR lower(coalesce(manifest['Multi-Release'], '')) = 'true')"
_PLACED = """placed_methods AS (SELECT *, CAST(row_number() OVER (PARTITION BY class_name ORDER BY coalesce(ord, 1 << 30), name, descriptor) - 1 AS INTEGER) AS place FROM methods_),
placed_fields AS (SELECT *, CAST(row_number() OVER (PARTITION BY class_name ORDER BY coalesce(ord, 1 << 30), name, descriptor) - 1 AS INTEGER) AS place FROM fields_ WHERE descriptor IS NOT NULL),
first_place AS (SELECT class_name, kind, member_ord, min(place) AS place FROM (SELECT class_name, 'method' AS kind, ord AS member_ord, place FROM placed_methods UNION ALL SELECT class_name, 'field', ord, place FROM placed_fields) GROUP BY ALL),
in_files AS (SELECT DISTINCT class_name FROM file_)"""
_ABOVE = f"""sup_ AS (SELECT src AS class_name, min(dst) AS superclass FROM edges_ WHERE rel = 'extends' GROUP BY src),
itf_ AS (SELECT src AS class_name, string_agg(dst, ' ' ORDER BY coalesce(ord, 1 << 30), dst) AS interfaces FROM edges_ WHERE rel = 'implements' GROUP BY src),
outer_ AS (SELECT src AS class_name, min(dst) AS "outer" FROM edges_ WHERE rel = 'inner_of' GROUP BY src),
said AS (SELECT f.*, CASE WHEN f.modifiers & {INTERFACE} <> 0 OR superclass IS NULL THEN '{OBJECT}' ELSE superclass END AS superclass, coalesce(interfaces, '') AS interfaces, "outer"
  FROM file_ f LEFT JOIN sup_ USING (class_name) LEFT JOIN itf_ USING (class_name) LEFT JOIN outer_ USING (class_name))"""
_PARAM = r"regexp_extract_all(regexp_extract(descriptor, '\((.*)\)', 1), '\[*(?:[BCDFIJSZ]|L[^;]+;)')"
_ANNS = f"""anns AS (SELECT a.class_name, a.target_kind, CASE a.target_kind WHEN 'class' THEN 0 ELSE p.place END AS place, coalesce(param_idx, -1) AS param_idx, annotation, coalesce(visible, false) AS visible, coalesce(params, []) AS params
  FROM annotations_ a LEFT JOIN first_place p ON p.class_name = a.class_name AND p.member_ord = a.member_ord AND p.kind = CASE a.target_kind WHEN 'field' THEN 'field' WHEN 'class' THEN NULL ELSE 'method' END
  WHERE a.class_name IN (SELECT class_name FROM in_files)),
kept_anns AS (SELECT a.* FROM anns a LEFT JOIN placed_methods m ON m.class_name = a.class_name AND m.place = a.place AND a.target_kind = 'param'
  WHERE a.place IS NOT NULL AND (a.target_kind <> 'param' OR (a.param_idx >= 0 AND a.param_idx < len({_PARAM}))))"""
_MEMBERS = ("annotations", "fields", "methods")


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_ALL = (SQL_CLASSES, _FILES, SQL_METHODS, SQL_FIELDS, SQL_ANNOTATIONS, _PLACED, _ABOVE)
_THROWN = f"list_filter(list_transform(coalesce(thrown, []), lambda t: {sql_class_name('t')}), lambda t: t IS NOT NULL)"
_SCANNED = " OR ".join(f"(package_name = '{p}' OR starts_with(package_name, '{p}.'))" for p in ACCEPTED)

ORACLE = {
    "s1_written": _with(_FILES) + f"SELECT e.cp_idx, {_NAME.replace('cp_idx', 'e.cp_idx')} AS archive, 1 + count(f.path) + 2 * count(CASE WHEN f.major >= 60 THEN 1 END) + 2 * count(CASE WHEN f.path IS NOT NULL AND f.source_file IS NULL THEN 1 END) AS n_entries FROM cp_elements e LEFT JOIN file_ f ON f.cp_idx = e.cp_idx GROUP BY e.cp_idx",
    "s2_archive_entries": _with(_FILES) + f"""SELECT archive, n + 1 AS n_entries, n AS n_classes, CASE WHEN {_MULTI} THEN v ELSE 0 END AS n_versioned, 0 AS n_errors FROM (
  SELECT e.cp_idx, {_NAME.replace('cp_idx', 'e.cp_idx')} AS archive, count(f.path) + 2 * count(CASE WHEN f.path IS NOT NULL AND f.source_file IS NULL THEN 1 END) AS n, count(CASE WHEN f.major >= 60 THEN 1 END) AS v FROM cp_elements e LEFT JOIN file_ f ON f.cp_idx = e.cp_idx GROUP BY e.cp_idx)""",
    "s5_versions": _with(_FILES) + f"""SELECT 'newest' AS how, archive, path, CASE WHEN {_MULTI} AND major >= 60 THEN {VERSION} ELSE 8 END AS version FROM file_
UNION ALL SELECT 'newest', archive, unnest(['broken/' || path, 'moved/' || path]), 8 FROM file_ WHERE source_file IS NULL
UNION ALL SELECT 'all', archive, path, 8 FROM file_ UNION ALL SELECT 'all', archive, unnest(['broken/' || path, 'moved/' || path]), 8 FROM file_ WHERE source_file IS NULL
UNION ALL SELECT 'all', archive, unnest(['META-INF/versions/{VERSION}/' || path, 'META-INF/versions/{FUTURE}/' || path]), unnest([{VERSION}, 8]) FROM file_ WHERE major >= 60""",
    "s8_manifests": rf"""SELECT cp_idx, coalesce(module_name, manifest['Automatic-Module-Name'], regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(uri, '^.*/', ''), '\.[A-Za-z]+$', ''), '-\d+(\.|$).*$', ''), '[^A-Za-z0-9]', '.', 'g'), '\.+', '.', 'g'), '^\.|\.$', '', 'g')) AS module_name,
CAST(coalesce(cardinality(manifest), 0) + 1 + CASE WHEN {_MULTI} AND manifest['Multi-Release'] IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_manifest, manifest['Bundle-Name'] AS bundle, {_MULTI} AS is_multi_release FROM cp_elements""",
    "s15_parsed_classes": _with(*_ALL) + f"""SELECT archive, s.class_name, modifiers & ~32 & 65535 AS modifiers, superclass, interfaces, major, minor, type_signature, source_file, is_record, "outer", CAST(coalesce(m.n, 0) AS INTEGER) AS n_methods, CAST(coalesce(f.n, 0) AS INTEGER) AS n_fields FROM said s
LEFT JOIN (SELECT class_name, count(*) AS n FROM placed_methods GROUP BY 1) m ON m.class_name = s.class_name LEFT JOIN (SELECT class_name, count(*) AS n FROM placed_fields GROUP BY 1) f ON f.class_name = s.class_name""",
    "s16_constants": _with(*_ALL) + "SELECT archive, f.class_name, place AS ord, name, descriptor, coalesce(f.modifiers, 0) & 65535 AS modifiers, CASE WHEN descriptor IN ('B', 'S', 'I', 'C', 'J') THEN CAST(TRY_CAST(json_extract_string(const_json, '$.v') AS BIGINT) AS VARCHAR) END AS constant FROM file_ JOIN placed_fields f ON f.class_name = file_.class_name",
    "s17_annotation_values": _with(*_ALL, _ANNS) + """SELECT DISTINCT class_name, target_kind, place, param_idx, annotation, visible, p.name AS name, json_extract_string(p.value_json, '$.t') AS tag,
CASE json_extract_string(p.value_json, '$.t') WHEN 'e' THEN concat_ws('.', json_extract_string(p.value_json, '$.class'), json_extract_string(p.value_json, '$.name')) WHEN '[' THEN NULL ELSE json_extract_string(p.value_json, '$.v') END AS value
FROM (SELECT * EXCLUDE (params), unnest(CASE WHEN len(params) = 0 THEN [NULL] ELSE params END) AS p FROM kept_anns)""",
    "s18_methods": _with(*_ALL) + f"""SELECT archive, m.class_name, place AS ord, name, descriptor, coalesce(m.modifiers, 0) & 65535 AS modifiers, nullif(signature, '') AS signature, coalesce(has_body, false) AS has_body,
CASE WHEN NOT coalesce(has_body, false) THEN 0 WHEN coalesce(min_line, 0) = 0 THEN coalesce(max_line, 0) WHEN coalesce(max_line, 0) = 0 THEN min_line ELSE least(min_line, max_line) END AS min_line,
CASE WHEN NOT coalesce(has_body, false) THEN 0 ELSE greatest(coalesce(min_line, 0), coalesce(max_line, 0)) END AS max_line, array_to_string({_THROWN}, ' ') AS thrown FROM file_ JOIN placed_methods m ON m.class_name = file_.class_name""",
    "s16_parameters": _with(*_ALL) + f"SELECT class_name, place AS method_ord, CAST(unnest(range(len({_PARAM}))) AS INTEGER) AS idx, unnest({_PARAM}) AS descriptor FROM placed_methods WHERE class_name IN (SELECT class_name FROM in_files)",
    "s20_references": _with(*_ALL) + f"""SELECT DISTINCT class_name, ref FROM (SELECT class_name, superclass AS ref FROM said UNION ALL SELECT class_name, "outer" FROM said UNION ALL SELECT class_name, unnest(string_split(interfaces, ' ')) FROM said WHERE interfaces <> ''
UNION ALL SELECT class_name, unnest({_THROWN}) FROM placed_methods WHERE class_name IN (SELECT class_name FROM in_files)) WHERE ref IS NOT NULL AND ref <> class_name""",
    "s21_bad_files": _with(_FILES) + "SELECT archive, 'broken/' || path AS path, 'damaged' AS fault FROM file_ WHERE source_file IS NULL UNION ALL SELECT archive, 'moved/' || path, 'misnamed' FROM file_ WHERE source_file IS NULL",
    "scan_classes": _with(*_ALL, _ANNS, f"""first_ AS (SELECT class_name, min(cp_idx) AS cp_idx FROM file_ GROUP BY class_name),
seeds AS (SELECT class_name FROM (SELECT class_name, CASE WHEN instr(class_name, '.') > 0 THEN regexp_replace(class_name, '\\.[^.]*$', '') ELSE '' END AS package_name FROM first_) WHERE {_SCANNED}),
leans AS (SELECT class_name, superclass AS ref FROM said UNION SELECT class_name, "outer" FROM said UNION SELECT class_name, unnest(string_split(interfaces, ' ')) FROM said UNION SELECT class_name, annotation FROM kept_anns UNION SELECT class_name, unnest({_VALUES}) FROM kept_anns UNION SELECT class_name, unnest({_THROWN}) FROM placed_methods),
got(class_name) AS (SELECT class_name FROM seeds UNION SELECT f.class_name FROM got g JOIN leans l ON l.class_name = g.class_name JOIN first_ f ON f.class_name = l.ref)""")
    + "SELECT class_name, class_name NOT IN (SELECT class_name FROM seeds) AS is_external, cp_idx FROM got JOIN first_ USING (class_name)",
}
ORACLE["s7_from_bytes"] = ORACLE["s2_archive_entries"]
