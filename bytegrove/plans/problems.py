"""Queries of the general data problems: hierarchies, nested records, heavy keys (p1, p2, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytegrove.functions.names import class_name, descriptor, package_of, sql_class_name, sql_descriptor
from bytegrove.operators.hierarchy import Hierarchy
from bytegrove.operators.shred import entities, shred
from bytegrove.operators.skew import value_frequencies, weighted_percentiles, weighted_profile
from bytegrove.scratch import Scratch
from bytegrove.sources.tables import table

#: A superclass is heavy if at least one link in HEAVY names it.
HEAVY = 50


def superclass_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) of every superclass link, whichever side it was recorded from; not distinct."""
    e = table(spark, sf_dir, "edges").where(F.col("rel").isin("extends", "extended_by"))
    down = F.col("rel") == "extends"
    sub, sup = F.when(down, F.col("src")).otherwise(F.col("dst")), F.when(down, F.col("dst")).otherwise(F.col("src"))
    return e.select(class_name(sub).alias("child"), class_name(sup).alias("parent")).where("child is not null and parent is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Hierarchy(superclass_links(spark, sf_dir)).cycles().select(F.col("node").alias("class_name"), "cycle_name")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class with its path to the topmost class (joined by ``>``), depth, root and status."""
    n = Hierarchy(superclass_links(spark, sf_dir)).nodes()
    return n.select(F.col("node").alias("class_name"), "root", F.col("depth").cast("int").alias("depth"), F.array_join("path", ">").alias("path"), "status", "cycle_name")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class with each of its direct and indirect subclasses."""
    d = Hierarchy(superclass_links(spark, sf_dir)).descendants()
    return d.select(F.col("node").alias("class_name"), F.col("descendant").alias("subclass"), F.col("distance").cast("int").alias("distance"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(table(spark, sf_dir, "class_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"fieldInfo": "fieldName", "methodInfo": "methodName", "annotationInfo": "annotationName"}
    e = entities(_nodes(spark, sf_dir), list(kinds), {v: v for v in kinds.values()})
    name = F.coalesce(*(F.when(F.col("label") == k, F.col(v)) for k, v in kinds.items()))
    return e.select("record_id", F.col("path").alias("obj_path"), name.alias("obj_name"))


def _entity(label: str, columns: dict[str, str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = entities(_nodes(spark, sf_dir), [label], columns)
        return e.select("record_id", F.col("path").alias("obj_path"), "parent_path", "ordinal", *columns.values())

    return query


p2_fields = _entity("fieldInfo", {"fieldName": "field_name", "typeDescriptorStr": "type_descriptor"})
p2_methods = _entity("methodInfo", {"methodName": "method_name", "typeDescriptorStr": "type_descriptor"})
p2_annotations = _entity("annotationInfo", {"annotationName": "annotation_name"})
p2_annotation_values = _entity("annotationParamValues", {"name": "param_name", "value": "value_json"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = value_frequencies(superclass_links(spark, sf_dir), ["parent"], F.col("child"))
    per = Scratch(spark, "heavy").save(weighted_profile(freq, "parent").select("parent", "n_distinct"), "per_key")
    total = per.agg(F.sum("n_distinct")).first()[0] or 0
    return per.where(F.col("n_distinct") * HEAVY >= total).select(F.col("parent").alias("class_name"))


def p5_superclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per superclass: rows that name it, distinct subclasses, and the package most of its subclasses' rows lie in."""
    freq = value_frequencies(superclass_links(spark, sf_dir), ["parent"], F.col("child"))
    direct = weighted_profile(freq, "parent").select("parent", "n_rows", F.col("n_distinct").alias("n_subclasses"))
    # The frequencies stand in for the rows: (parent, package) sums come from them, not from the rows again.
    packages = freq.groupBy("parent", package_of("value").alias("value")).agg(F.sum("weight").alias("weight"))
    modes = weighted_profile(packages, "parent").select("parent", F.col("n_distinct").alias("n_packages"), F.col("mode_value").alias("top_package"))
    return direct.join(modes, "parent").withColumnRenamed("parent", "class_name")


def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_name, kind, ord, name, descriptor, n_lines) of methods and fields, each row once."""
    m = table(spark, sf_dir, "methods").select(
        class_name("class_name").alias("class_name"), F.lit("method").alias("kind"), "ord", "name", descriptor("descriptor").alias("descriptor"),
        (F.col("max_line") - F.col("min_line") + 1).alias("n_lines"),
    )
    f = table(spark, sf_dir, "class_fields").select(
        class_name("class_name").alias("class_name"), F.lit("field").alias("kind"), "ord", "name", descriptor("descriptor").alias("descriptor"), F.lit(None).cast("int").alias("n_lines")
    )
    return m.unionByName(f).where("class_name is not null").distinct()


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class over its methods and fields: members, distinct descriptors, the most used one, and quartiles of method length."""
    members = class_members(spark, sf_dir)
    by_descriptor = weighted_profile(value_frequencies(members, ["class_name"], F.col("descriptor")), "class_name").select(
        "class_name", F.col("n_rows").alias("n_members"), F.col("n_distinct").alias("n_descriptors"), F.col("mode_value").alias("top_descriptor"), F.col("mode_rows").alias("n_top_descriptor")
    )
    lines = weighted_percentiles(value_frequencies(members.where("n_lines is not null"), ["class_name"], F.col("n_lines")), "class_name", {"lines_p25": 0.25, "lines_p50": 0.5, "lines_p90": 0.9})
    return by_descriptor.join(lines, "class_name", "left")


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p5_found, p5_superclasses, p5_members)} | {
    "p2_fields": p2_fields, "p2_methods": p2_methods, "p2_annotations": p2_annotations, "p2_annotation_values": p2_annotation_values,
}

_LINKS = f"""all_links AS (
  SELECT {sql_class_name("CASE rel WHEN 'extends' THEN src ELSE dst END")} AS child, {sql_class_name("CASE rel WHEN 'extends' THEN dst ELSE src END")} AS parent
  FROM edges WHERE rel IN ('extends', 'extended_by')),
rows_ AS (SELECT child, parent FROM all_links WHERE child IS NOT NULL AND parent IS NOT NULL),
links AS (SELECT child, min(parent) AS parent FROM rows_ GROUP BY child),
reach AS (SELECT child AS a, parent AS x FROM links UNION SELECT r.a, l.parent FROM reach r JOIN links l ON r.x = l.child),
rings AS (SELECT a, min(x) AS cycle_name FROM reach WHERE a IN (SELECT a FROM reach WHERE a = x) GROUP BY a)"""

_PATHS = f"""WITH RECURSIVE {_LINKS},
up AS (
  SELECT child AS node, parent AS top, 1 AS depth, child || '>' || parent AS path, [child, parent] AS names FROM links WHERE child NOT IN (SELECT a FROM rings)
  UNION ALL
  SELECT u.node, l.parent, u.depth + 1, u.path || '>' || l.parent, list_append(u.names, l.parent) FROM up u JOIN links l ON u.top = l.child WHERE u.top NOT IN (SELECT a FROM rings)),
longest AS (SELECT u.*, row_number() OVER (PARTITION BY node ORDER BY depth DESC) AS rn FROM up u)"""

_MEMBERS = f"""members AS (
  SELECT DISTINCT * FROM (
    SELECT {sql_class_name("class_name")} AS class_name, 'method' AS kind, ord, name, {sql_descriptor("descriptor")} AS descriptor, max_line - min_line + 1 AS n_lines FROM methods
    UNION ALL
    SELECT {sql_class_name("class_name")}, 'field', ord, name, {sql_descriptor("descriptor")}, NULL FROM class_fields) WHERE class_name IS NOT NULL)"""

_FOLD = "lower(replace(replace({}, '_', ''), '-', ''))"
_OBJECTS = f"""WITH RECURSIVE labels(folded, label) AS (VALUES ('classinfo', 'classInfo'), ('fieldinfo', 'fieldInfo'), ('methodinfo', 'methodInfo'),
  ('annotationinfo', 'annotationInfo'), ('parameterinfo', 'parameterInfo'), ('annotationparamvalues', 'annotationParamValues')),
texts AS (SELECT DISTINCT record_id, TRY_CAST(ltrim(record, chr(65279) || ' ') AS JSON) AS j FROM class_records),
nodes(record_id, path, parent_path, ordinal, label, obj) AS (
  SELECT record_id, '', '', 0, '', j FROM texts WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT record_id, CASE WHEN path = '' THEN '' ELSE path || '.' END || label || '[' || i || ']', path, CAST(i AS INTEGER), label, objs[i + 1] FROM (
    SELECT record_id, path, label, objs, unnest(range(len(objs))) AS i FROM (
      SELECT record_id, path, label, list_filter(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END, lambda x: json_type(x) = 'OBJECT') AS objs FROM (
        SELECT record_id, path, n.label, CASE json_type(raw) WHEN 'VARCHAR' THEN TRY_CAST(raw ->> '$' AS JSON) ELSE raw END AS v FROM (
          SELECT record_id, path, k, obj -> ('$."' || k || '"') AS raw FROM (SELECT record_id, path, obj, unnest(json_keys(obj)) AS k FROM nodes))
        JOIN labels n ON n.folded = {_FOLD.format('k')}))))"""


def _scalar(folded: str) -> str:
    """The value of an object's key in whatever spelling."""
    keys = f"list_filter(json_keys(obj), lambda k: {_FOLD.format('k')} = {folded})"
    return f"CASE WHEN len({keys}) > 0 THEN obj ->> ('$.\"' || {keys}[1] || '\"') END"


def _value(folded: str) -> str:
    """The whole value of an object's key as JSON text; a string as it is."""
    keys = f"list_filter(json_keys(obj), lambda k: {_FOLD.format('k')} = {folded})"
    whole = f"obj -> ('$.\"' || {keys}[1] || '\"')"
    return f"CASE WHEN len({keys}) > 0 AND json_type({whole}) <> 'NULL' THEN CASE json_type({whole}) WHEN 'VARCHAR' THEN ({whole}) ->> '$' ELSE CAST(json({whole}) AS VARCHAR) END END"


def _entity_sql(label: str, columns: dict[str, str]) -> str:
    shown = ", ".join(f"{_scalar(repr(k.lower()))} AS {v}" for k, v in columns.items())
    return f"{_OBJECTS} SELECT record_id, path AS obj_path, parent_path, ordinal, {shown} FROM nodes WHERE label = '{label}'"


ORACLE = {
    "p2_found": f"""{_OBJECTS} SELECT record_id, path AS obj_path, {_scalar("replace(lower(label), 'info', 'name')")} AS obj_name FROM nodes WHERE label IN ('fieldInfo', 'methodInfo', 'annotationInfo')""",
    "p2_fields": _entity_sql("fieldInfo", {"fieldName": "field_name", "typeDescriptorStr": "type_descriptor"}),
    "p2_methods": _entity_sql("methodInfo", {"methodName": "method_name", "typeDescriptorStr": "type_descriptor"}),
    "p2_annotations": _entity_sql("annotationInfo", {"annotationName": "annotation_name"}),
    "p2_annotation_values": f"""{_OBJECTS} SELECT record_id, path AS obj_path, parent_path, ordinal, {_scalar("'name'")} AS param_name, {_value("'value'")} AS value_json FROM nodes WHERE label = 'annotationParamValues'""",
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT a AS class_name, cycle_name FROM rings",
    "p1_paths": f"""{_PATHS}
SELECT node AS class_name, CASE WHEN r.a IS NULL THEN top END AS root, depth, path, CASE WHEN r.a IS NULL THEN 'tree' ELSE 'into_cycle' END AS status, r.cycle_name
FROM longest LEFT JOIN rings r ON top = r.a WHERE rn = 1
UNION ALL SELECT DISTINCT parent, parent, 0, parent, 'tree', NULL FROM links WHERE parent NOT IN (SELECT child FROM links)
UNION ALL SELECT a, NULL, 0, a, 'cycle', cycle_name FROM rings""",
    "p1_descendants": f"""{_PATHS}
SELECT names[i + 1] AS class_name, node AS subclass, CAST(i AS INTEGER) AS distance FROM (SELECT node, names, unnest(range(1, depth + 1)) AS i FROM longest WHERE rn = 1)""",
    "p5_found": f"""WITH RECURSIVE {_LINKS}, d AS (SELECT DISTINCT child, parent FROM rows_)
SELECT parent AS class_name FROM d GROUP BY parent HAVING count(*) * {HEAVY} >= (SELECT count(*) FROM d)""",
    "p5_superclasses": f"""WITH RECURSIVE {_LINKS},
p AS (SELECT parent, CASE WHEN instr(child, '.') > 0 THEN regexp_replace(child, '\\.[^.]*$', '') ELSE '' END AS package, count(*) AS w FROM rows_ GROUP BY ALL),
m AS (SELECT parent, package, row_number() OVER (PARTITION BY parent ORDER BY w DESC, package) AS rn, count(*) OVER (PARTITION BY parent) AS n_packages FROM p)
SELECT parent AS class_name, n_rows, n_subclasses, n_packages, package AS top_package
FROM (SELECT parent, count(*) AS n_rows, count(DISTINCT child) AS n_subclasses FROM rows_ GROUP BY parent) JOIN m USING (parent) WHERE rn = 1""",
    "p5_members": f"""WITH {_MEMBERS},
f AS (SELECT class_name, descriptor, count(*) AS w FROM members GROUP BY ALL),
t AS (SELECT class_name, descriptor, w, row_number() OVER (PARTITION BY class_name ORDER BY w DESC, descriptor) AS rn FROM f WHERE descriptor IS NOT NULL),
l AS (SELECT class_name, n_lines, row_number() OVER (PARTITION BY class_name ORDER BY n_lines) AS i, count(*) OVER (PARTITION BY class_name) AS n FROM members WHERE n_lines IS NOT NULL),
q AS (SELECT class_name, min(n_lines) FILTER (i >= ceil(0.25 * n)) AS lines_p25, min(n_lines) FILTER (i >= ceil(0.5 * n)) AS lines_p50, min(n_lines) FILTER (i >= ceil(0.9 * n)) AS lines_p90 FROM l GROUP BY class_name)
SELECT a.class_name, n_members, n_descriptors, t.descriptor AS top_descriptor, t.w AS n_top_descriptor, lines_p25, lines_p50, lines_p90
FROM (SELECT class_name, count(*) AS n_members, count(DISTINCT descriptor) AS n_descriptors FROM members GROUP BY class_name) a
LEFT JOIN t ON a.class_name = t.class_name AND t.rn = 1 LEFT JOIN q ON a.class_name = q.class_name""",
}
