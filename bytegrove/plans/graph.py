"""Queries over the class graph, one per operator family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytegrove.catalog import OBJECT, SQL_ANNOTATIONS, SQL_CLASSES, SQL_FIELDS, SQL_METHODS, Catalog, Scope, sql_visible
from bytegrove.functions import modifiers as M
from bytegrove.functions.names import sql_class_name
from bytegrove.operators import relations as R
from bytegrove.operators.members import Members
from bytegrove.operators.relations import Relations

SCOPE = Scope()


def _rel(method: str, *args):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Relations(Catalog.load(spark, sf_dir, SCOPE)), method)(*args)

    query.__name__ = method
    return query


def _members(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Members(Catalog.load(spark, sf_dir, SCOPE)), method)()

    return query


def f2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class with its kind predicates; an implemented interface is one that an implements edge leads to."""
    cat = Catalog.load(spark, sf_dir)
    used = cat.rel("implements").select(F.col("dst").alias("class_name")).distinct().withColumn("u", F.lit(True))
    return cat.classes.join(used, "class_name", "left").select(
        "class_name", M.is_standard().alias("standard"), M.is_interface().alias("interface"), M.is_interface_or_annotation().alias("interface_or_annotation"),
        F.coalesce("u", F.lit(False)).alias("implemented_interface"), M.is_annotation().alias("annotation"), (M.has(M.ENUM) & M.is_standard()).alias("enum"), "is_record",
    )


def f3_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that strict answers show when two package trees are rejected."""
    cat = Catalog.load(spark, sf_dir, REJECTING)
    return cat.classes.where(REJECTING.visible()).select("class_name")


REJECTING = Scope(reject_packages=("brenvo.atlas", "*.billing"))


def f16_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a class has declared methods, fields, annotations, a constructor, an annotated method, or inner classes."""
    cat = Catalog.load(spark, sf_dir)
    m, f, a = cat.methods, cat.fields, cat.annotations
    flags = (
        m.select("class_name", (F.col("name") != "<init>").alias("m"), (F.col("name") == "<init>").alias("c"), F.lit(False).alias("f"), F.lit(False).alias("a"), F.lit(False).alias("i"))
        .unionByName(f.select("class_name", F.lit(False).alias("m"), F.lit(False).alias("c"), F.lit(True).alias("f"), F.lit(False).alias("a"), F.lit(False).alias("i")))
        .unionByName(a.where("target_kind = 'class'").select("class_name", F.lit(False).alias("m"), F.lit(False).alias("c"), F.lit(False).alias("f"), F.lit(True).alias("a"), F.lit(False).alias("i")))
        .unionByName(cat.rel("inner_of").select(F.col("dst").alias("class_name"), F.lit(False).alias("m"), F.lit(False).alias("c"), F.lit(False).alias("f"), F.lit(False).alias("a"), F.lit(True).alias("i")))
    )
    g = flags.groupBy("class_name").agg(*(F.max(x).alias(x) for x in "mcfai"))
    no = F.lit(False)
    return cat.classes.join(g, "class_name", "left").select(
        "class_name", F.coalesce("m", no).alias("has_methods"), F.coalesce("c", no).alias("has_constructor"), F.coalesce("f", no).alias("has_fields"), F.coalesce("a", no).alias("has_annotations"), F.coalesce("i", no).alias("has_inner")
    )


def f17_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared methods with their modifiers in words."""
    m = Catalog.load(spark, sf_dir).methods
    return m.select("class_name", "name", "descriptor", M.modifiers_string("method").alias("words"), M.is_package_visible().alias("package_visible"), M.has(M.STATIC).alias("static"))


def u_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference and all/any over the carriers of the three most and least used class annotations."""
    rel = Relations(Catalog.load(spark, sf_dir))
    carriers = rel.scratch.save(rel.with_annotation(), "carriers")
    one = lambda name: carriers.where(F.col("class_name") == name).select(F.col("related").alias("class_name"), "is_direct")
    a, b, c = (one(n) for n in SET_ANNOTATIONS)
    none = F.lit(None).cast("boolean")
    parts = {
        "union": R.union(a, b, c), "intersect": R.intersect(a, b), "exclude": R.exclude(a, b), "direct_only": R.direct_only(R.union(a, b)),
        "all": R.with_all(carriers, list(SET_ANNOTATIONS[:2])).withColumn("is_direct", none), "any": R.with_any(carriers, list(SET_ANNOTATIONS)).withColumn("is_direct", none),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("op"), "class_name", "is_direct")
        out = df if out is None else out.unionByName(df)
    return out


SET_ANNOTATIONS = ("vantar.meta.Managed", "vantar.meta.Config", "vantar.meta.Guarded")


def u_assignable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each interface with every class assignable to it, itself included."""
    rel = Relations(Catalog.load(spark, sf_dir))
    below = rel.implementing().select("class_name", "related")
    roots = below.select("class_name").distinct()
    return below.unionByName(roots.select("class_name", F.col("class_name").alias("related"))).distinct()


def j2_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that only edges know, with the kind that their use gives them."""
    cat = Catalog.load(spark, sf_dir)
    real = cat.raw["classes"].select("class_name").unionByName(cat.raw["external"].select("class_name"))
    return cat.classes.join(real, "class_name", "left_anti").select("class_name", "modifiers", "package_name")


def j4_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible classes per module and package."""
    cat = Catalog.load(spark, sf_dir)
    return cat.classes.where(SCOPE.visible()).groupBy("module_name", "package_name").agg(F.count(F.lit(1)).alias("n"), F.min("class_name").alias("first_class"))


def w1_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class files by path in element order: the first is the class, the others are masked but stay resources."""
    from bytegrove.operators.resources import mask_classes

    return mask_classes(_resources(spark, sf_dir))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytegrove.sources.tables import table

    return table(spark, sf_dir, "classes").where("resource_path is not null").select("cp_idx", F.col("resource_path").alias("path")).distinct()


def a1_resources_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resources(spark, sf_dir)
    return r.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("cp_idx")), lambda x: x.cast("string")), ",").alias("elements"))


def a2_duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytegrove.operators.resources import duplicates

    return duplicates(_resources(spark, sf_dir))


def f14_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources by three globs."""
    from bytegrove.functions.globs import glob_to_regex

    r = _resources(spark, sf_dir)
    out = None
    for g in GLOBS:
        df = r.where(F.col("path").rlike(glob_to_regex(g))).select(F.lit(g).alias("glob"), "cp_idx", "path")
        out = df if out is None else out.unionByName(df)
    return out


GLOBS = ("brenvo/*/*.class", "**/*Reader*.class", "fennik/**")


def f4_path_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directory of the class path as a walk with accepted and rejected paths sees it."""
    from bytegrove.functions.globs import path_status

    d = _resources(spark, sf_dir).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")).distinct()
    return d.select("dir", path_status(F.col("dir"), ("brenvo/atlas", "fennik/*"), ("fennik/depot",), ("tolvik/billing",)).alias("status"))


def s11_element_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in class-path order: modules first, each element before its children, children by their place in it."""
    from bytegrove.operators.resources import element_order
    from bytegrove.sources.tables import table

    return element_order(table(spark, sf_dir, "cp_elements"))


def g19_reverse_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class with every class that refers to it, in name order."""
    from bytegrove.operators.dependencies import dependencies, dependency_map

    return dependency_map(dependencies(Catalog.load(spark, sf_dir)), reverse=True)


def g19_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class with every class that it refers to, in name order."""
    from bytegrove.operators.dependencies import dependencies, dependency_map

    return dependency_map(dependencies(Catalog.load(spark, sf_dir)))


def g18_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytegrove.operators.dependencies import dependencies

    return dependencies(Catalog.load(spark, sf_dir))


def k1_dot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytegrove.sinks.dot import graph_edges

    return graph_edges(Catalog.load(spark, sf_dir))


def k9_node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bytegrove.sinks.dot import node_contents

    return node_contents(Catalog.load(spark, sf_dir))


def g12_annotation_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation instances of each class by how it comes to them, with their values as name and JSON."""
    i = Relations(Catalog.load(spark, sf_dir, SCOPE)).annotation_instances()
    values = F.from_json("params", "array<struct<name:string,value_json:string>>")
    return i.select("class_name", "annotation", "directness", F.array_join(F.transform(values, lambda p: F.concat(p["name"], F.lit("="), p["value_json"])), ";").alias("params")).distinct()


def sig_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared methods with their generic signature in words and its erasure."""
    from bytegrove.operators.signatures import method_signatures

    return method_signatures(Catalog.load(spark, sf_dir))


def sig_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with what their signatures say they extend and implement, or else their links."""
    from bytegrove.operators.signatures import class_signatures

    return class_signatures(Catalog.load(spark, sf_dir))


def g16_type_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What classes fill in for the variables of their superclasses. The tables have no generic superclass, so each class is
    given a signature: it has a variable, and passes it on to its superclass or, by the length of its name, a fixed type."""
    from bytegrove.operators.signatures import supertype_arguments

    cat = Catalog.load(spark, sf_dir).pin()
    reach = Relations(cat).up()
    circular = reach.join(reach.where("root = node").select("node").distinct(), "node", "left_semi").select(F.col("root").alias("class_name")).distinct()
    parent = cat.rel("extends").groupBy(F.col("src").alias("class_name")).agg(F.min("dst").alias("parent")).join(circular, "class_name", "left_anti")
    given = F.when(F.length("class_name") % 3 == 0, F.lit("Ljava/lang/String;")).otherwise(F.lit("TT;"))
    sig = F.concat(F.lit("<T:Ljava/lang/Object;>L"), F.coalesce(F.concat(F.translate("parent", ".", "/"), F.lit("<"), given, F.lit(">")), F.lit("java/lang/Object")), F.lit(";"))
    rows = cat._rows().join(circular.withColumn("circular", F.lit(True)), "class_name", "left").join(parent, "class_name", "left")
    rows = rows.withColumn("type_signature", F.when(F.col("circular").isNull(), sig)).drop("circular", "parent")
    return supertype_arguments(Relations(Catalog(rows, cat.raw["edges"])))


def f14_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources by path, file name, extension and pattern."""
    from bytegrove.operators.resources import select_resources

    r = _resources(spark, sf_dir)
    parts = {"extension": {"extension": "CLASS"}, "regex": {"regex": ".*/[A-C][a-zA-Z]*X[0-9a-z]+\\.class"}, "glob": {"glob": "*/*/*/*.class", "classfiles": True}, "leaf": {"leaf": "RosterReaderX0.class"}, "path": {"path": "/fennik/tariff/intern/RosterReaderX0.class"}}
    out = None
    for k, how in parts.items():
        df = select_resources(r, **how).select(F.lit(k).alias("how"), "cp_idx", "path")
        out = df if out is None else out.unionByName(df)
    return out


def a8_modifier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a class OR-ed over all rows that describe it."""
    from bytegrove.functions.names import class_name
    from bytegrove.sources.tables import table

    c = table(spark, sf_dir, "classes")
    return c.groupBy(class_name("class_name").alias("class_name")).agg(F.bit_or("modifiers").alias("modifiers"))


def a5_last_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest change of any element, and how many were changed after the first scan time."""
    from bytegrove.operators.resources import modification
    from bytegrove.sources.tables import table

    return modification(table(spark, sf_dir, "cp_elements"), "2024-06-01 00:00:00")


HAS_NAMES = {"superclass": "vantar.kernel.BaseUnit", "interface": "vantar.spi.NamedSource", "annotation": "vantar.meta.Managed", "method": "close", "field": "marker0"}


def f16_class_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(predicate, class_name): classes that a predicate of each kind holds for, for one name of each sort."""
    from bytegrove.operators.predicates import Predicates

    p = Predicates(Members(Catalog.load(spark, sf_dir)))
    n = HAS_NAMES
    found = {
        "extends": p.extends_superclass(n["superclass"]), "implements": p.implements_interface(n["interface"]), "annotated": p.has_annotation(n["annotation"]),
        "declared_method": p.has_declared_method("<init>"), "method": p.has_method(n["method"]), "declared_field": p.has_declared_field(n["field"]), "field": p.has_field(n["field"]),
    }
    for member in ("field", "method", "param"):
        found[f"declared_{member}_annotation"] = p.has_declared_member_annotation(member, n["annotation"])
        found[f"{member}_annotation"] = p.has_member_annotation(member, n["annotation"])
    out = None
    for name, df in found.items():
        df = df.select(F.lit(name).alias("predicate"), "class_name")
        out = df if out is None else out.unionByName(df)
    return out


def j10_effective_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each annotation on a class, given ones over defaults; the smallest value seen of a name stands for its default."""
    from bytegrove.operators.members import params_over_defaults

    a = Catalog.load(spark, sf_dir).annotations
    p = a.select("annotation", F.posexplode("params").alias("i", "p"))
    defaults = p.groupBy("annotation", F.col("p.name").alias("name")).agg(F.min("i").alias("ord"), F.min("p.value_json").alias("value_json"))
    return params_over_defaults(a.where("target_kind = 'class'"), defaults).select("ann_id", "name", "value_json", "is_default")


def o_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in order, as positions: classes and packages by name, methods by class, name and descriptor."""
    from bytegrove.operators.skew import numbered

    cat = Catalog.load(spark, sf_dir)
    none = F.lit(None).cast("string")
    classes = numbered(cat.classes.where(SCOPE.visible()).select("class_name"), ["class_name"], "position").select(F.lit("class").alias("what"), "class_name", none.alias("name"), none.alias("descriptor"), "position")
    packages = numbered(cat.classes.where(SCOPE.visible()).select("package_name").distinct(), ["package_name"], "position").select(F.lit("package").alias("what"), F.col("package_name").alias("class_name"), none.alias("name"), none.alias("descriptor"), "position")
    methods = numbered(cat.methods.select("class_name", "name", "descriptor"), ["class_name", "name", "descriptor"], "position").select(F.lit("method").alias("what"), "class_name", "name", "descriptor", "position")
    return classes.unionByName(packages).unionByName(methods)


def fn_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of elements as paths and URLs."""
    import pandas as pd

    from bytegrove.functions import paths as P
    from bytegrove.sources.tables import table

    def run(frames):
        for f in frames:
            yield pd.DataFrame(
                {
                    "cp_idx": f["cp_idx"], "path": [P.resolve("/x", u) for u in f["uri"]], "url": [P.normalize_url(P.resolve("/x", u)) for u in f["uri"]], "beside": [P.resolve(P.parent_dir(P.resolve("/", u)), "../y z/./a.jar") for u in f["uri"]],
                    "leaf": [P.leaf(u) for u in f["uri"]], "is_url": [P.has_scheme(u) for u in f["uri"]], "list": [P.join_path_list(P.split_path_list(f"{u}:/a b:jar:{u}!/c")) for u in f["uri"]],
                }
            )

    return table(spark, sf_dir, "cp_elements").where("uri is not null").select("cp_idx", "uri").mapInPandas(run, "cp_idx int, path string, url string, beside string, leaf string, is_url boolean, list string")


QUERIES = {
    "g1_subclasses": _rel("subclasses"), "g2_superclasses": _rel("superclasses"), "g3_superclass": _rel("superclass"), "g4_superinterfaces": _rel("superinterfaces"),
    "g5_implementing": _rel("implementing"), "g6_subinterfaces": _rel("subinterfaces"), "g7_outer": _rel("outer"), "g7_inner": _rel("inner"),
    "g8_with_annotation": _rel("with_annotation"), "g9_annotations": _rel("annotations"),
    "g10_with_method_annotation": _rel("with_member_annotation", "method_ann"), "g10_with_field_annotation": _rel("with_member_annotation", "field_ann"),
    "g10_with_param_annotation": _rel("with_member_annotation", "method_param_ann"),
    "g11_method_annotations": _rel("member_annotations", "method_ann"), "g11_field_annotations": _rel("member_annotations", "field_ann"),
    "g11_param_annotations": _rel("member_annotations", "method_param_ann"),
    "g13_package_tree": _rel("package_tree"),
    "w3_methods": _members("methods"), "w4_fields": _members("fields"), "a3_overloads": _members("overloads"), "a9_single_methods": _members("single"), "j8_thrown": _members("thrown"),
} | {
    f.__name__: f
    for f in (
        f2_kinds, f3_visible, f4_path_status, f14_globs, f16_has, f17_modifiers, u_set_operations, u_assignable, j2_placeholders, j4_membership, w1_masking,
        f14_selections, g12_annotation_instances, g16_type_arguments, sig_classes, sig_methods, a1_resources_by_path, a2_duplicate_paths, a5_last_modified, a8_modifier_union, s11_element_order, g18_dependencies, g19_reverse_dependencies, g19_dependencies, f16_class_predicates, j10_effective_values, o_orders, fn_paths, k1_dot_edges, k9_node_labels,
    )
}

# SQL. Closures run on names only, so that UNION ends on circles.
_UP = "up_(root, node) AS (SELECT src, dst FROM edges_ WHERE rel = 'extends' UNION SELECT u.root, e.dst FROM up_ u JOIN edges_ e ON e.rel = 'extends' AND e.src = u.node)"


def _closure(rel: str) -> str:
    return f"c_{rel}(root, node) AS (SELECT src, dst FROM edges_ WHERE rel = '{rel}' UNION SELECT c.root, e.dst FROM c_{rel} c JOIN edges_ e ON e.rel = '{rel}' AND e.src = c.node)"


def _depth(rel: str, name: str) -> str:
    """Fewest edges, by walks that visit no name twice but may come back to the start."""
    return (
        f"{name}(root, node, depth, seen) AS (SELECT src, dst, 1, [dst] FROM edges_ WHERE rel = '{rel}' UNION ALL "
        f"SELECT w.root, e.dst, w.depth + 1, list_append(w.seen, e.dst) FROM {name} w JOIN edges_ e ON e.rel = '{rel}' AND e.src = w.node AND NOT list_contains(w.seen, e.dst))"
    )


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((SQL_CLASSES, *parts)) + "\n"


def _answer(reach: str, direct: str, strict: bool) -> str:
    shown = f"(SELECT class_name FROM classes_ WHERE {sql_visible(SCOPE)})" if strict else "(SELECT class_name FROM classes_)"
    return (
        f"SELECT root AS class_name, node AS related, bool_or(d) AS is_direct FROM (SELECT root, node, false AS d FROM ({reach}) UNION ALL SELECT root, node, true FROM ({direct})) "
        f"WHERE node IN {shown} GROUP BY root, node"
    )


def _one(rel: str, a: str, b: str) -> str:
    return f"SELECT {a} AS root, {b} AS node FROM edges_ WHERE rel = '{rel}'"


_IMPL = "hit AS (SELECT node AS root, root AS node FROM c_implements), impl AS (SELECT * FROM hit UNION SELECT h.root, u.root FROM hit h JOIN up_ u ON u.node = h.node)"
_KIND = {k: f"(modifiers & {b}) <> 0" for k, b in (("ann", M.ANNOTATION), ("itf", M.INTERFACE), ("enum", M.ENUM))}


def _member(rel: str) -> str:
    e = f"SELECT src, dst, nonprivate FROM edges_ WHERE rel = '{rel}'"
    return _with(_UP, _closure("class_ann"), f"e AS ({e}), hits AS (SELECT dst AS root, src AS node, nonprivate FROM e UNION SELECT c.node, e.src, e.nonprivate FROM e JOIN c_class_ann c ON c.root = e.dst)") + _answer(
        "SELECT root, node FROM hits UNION SELECT h.root, u.root FROM hits h JOIN up_ u ON u.node = h.node WHERE h.nonprivate", "SELECT dst AS root, src AS node FROM e", True
    )


def _on_members(rel: str) -> str:
    return _with(_closure("class_ann")) + _answer(
        f"SELECT src AS root, dst AS node FROM edges_ WHERE rel = '{rel}' UNION SELECT e.src, c.node FROM edges_ e JOIN c_class_ann c ON c.root = e.dst WHERE e.rel = '{rel}' AND NOT starts_with(c.node, '{R.JAVA_META}')", _one(rel, "src", "dst"), False
    )


_WITH_ANN = _answer(
    "SELECT node AS root, root AS node FROM c_class_ann UNION SELECT c.node, u.root FROM c_class_ann c JOIN up_ u ON u.node = c.root WHERE c.node IN (SELECT class_name FROM classes_ WHERE inherited_meta)", _one("class_ann", "dst", "src"), True
)
_OWN_ANN = f"own AS (SELECT root, node FROM c_class_ann WHERE NOT starts_with(node, '{R.JAVA_META}') UNION SELECT src, dst FROM edges_ WHERE rel = 'class_ann')"
_LISTED = ", ".join(f"'{x}'" for x in SET_ANNOTATIONS)
#: Names above a class: its superclasses with their distance.
_SUP = "sup AS (SELECT root, node, min(depth) AS depth FROM w_up WHERE root <> node GROUP BY root, node)"
#: Interface links in the order of their declaration, and every way along them as the list of places taken.
_WAYS = """irank AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord NULLS LAST, dst) AS k FROM edges_ WHERE rel = 'implements'),
ways(root, node, way, seen) AS (SELECT src, dst, [k], [src, dst] FROM irank UNION ALL SELECT w.root, i.dst, list_append(w.way, i.k), list_append(w.seen, i.dst) FROM ways w JOIN irank i ON i.src = w.node AND NOT list_contains(w.seen, i.dst)),
first_way AS (SELECT root, node, min(way) AS way FROM ways GROUP BY root, node)"""
#: Fields: the class, then interfaces in the order of a walk in depth, own ones first, then superclasses.
_FIELD_LINES = """lines AS (SELECT root, node, min(key) AS key FROM (
  SELECT class_name AS root, class_name AS node, [0] AS key FROM classes_ UNION ALL SELECT root, node, list_concat([1, 0], way) FROM first_way WHERE root <> node
  UNION ALL SELECT s.root, f.node, list_concat([1, s.depth], f.way) FROM sup s JOIN first_way f ON f.root = s.node WHERE f.node <> s.root
  UNION ALL SELECT root, node, [2, depth] FROM sup) GROUP BY root, node)"""
#: Methods: interfaces are met from the topmost class down, and each goes before the first of its own super-interfaces.
_METHOD_LINES = f"""met AS (SELECT root, list(node ORDER BY key) AS todo FROM (SELECT root, node, min(key) AS key FROM (
    SELECT root, node, list_concat([0], way) AS key FROM first_way WHERE root <> node UNION ALL SELECT s.root, f.node, list_concat([-s.depth], f.way) FROM sup s JOIN first_way f ON f.root = s.node WHERE f.node <> s.root)
  GROUP BY root, node) GROUP BY root),
above AS (SELECT root, list(DISTINCT node) AS ups FROM c_implements GROUP BY root),
placed(root, i, done, todo) AS (
  SELECT root, 0, CAST([] AS VARCHAR[]), todo FROM met
  UNION ALL
  SELECT p.root, i + 1, CASE WHEN slot IS NULL THEN list_append(done, todo[i + 1]) ELSE list_concat(list_append(done[1:slot - 1], todo[i + 1]), done[slot:]) END, todo
  FROM (SELECT q.*, list_min(list_filter(list_transform(coalesce(ups, []), lambda u: list_position(done, u)), lambda p: p > 0)) AS slot FROM placed q LEFT JOIN above a ON a.root = q.todo[q.i + 1]) p WHERE i < len(todo)),
lines AS (
  SELECT class_name AS root, class_name AS node, [0, 0] AS key FROM classes_ UNION ALL SELECT root, node, [1, depth] FROM sup
  UNION ALL SELECT root, unnest(done), [2, unnest(range(len(done)))] FROM placed WHERE i = len(todo) AND len(todo) > 0)"""
_RESOLVED_METHODS = """resolved_methods AS (SELECT root AS class_name, name, descriptor, b.node AS declared_in, b.modifiers AS modifiers FROM (
  SELECT root, name, descriptor, min({'key': key, 'node': node, 'modifiers': m.modifiers}) AS b FROM method_lines l JOIN methods_ m ON m.class_name = l.node
  WHERE name <> '<clinit>' AND (name <> '<init>' OR root = node) GROUP BY root, name, descriptor))"""
_RESOLVED_FIELDS = """resolved_fields AS (SELECT root AS class_name, name, b.descriptor AS descriptor, b.node AS declared_in FROM (
  SELECT root, name, min({'key': key, 'node': node, 'descriptor': descriptor}) AS b FROM field_lines l JOIN fields_ f ON f.class_name = l.node GROUP BY root, name))"""
_MEMBER_LINES = (_depth("extends", "w_up"), _closure("implements"), _SUP, _WAYS, _FIELD_LINES.replace("lines AS", "field_lines AS", 1), _METHOD_LINES.replace("\nlines AS", "\nmethod_lines AS", 1))
_RES = "res AS (SELECT DISTINCT cp_idx, resource_path AS path FROM classes WHERE resource_path IS NOT NULL)"
_NAMES = r"list_transform(regexp_extract_all({}, 'L([^;<>()\[:*+-]+)', 1), lambda x: replace(x, '/', '.'))"
_INSTANCES = f"""ann1 AS (SELECT DISTINCT class_name, annotation FROM annotations_ WHERE target_kind = 'class'),
inh AS (SELECT class_name AS annotation FROM classes_ WHERE inherited_meta),
nearest AS (SELECT w.root AS class_name, a.annotation, min(w.depth) AS depth FROM w_up w JOIN ann1 a ON a.class_name = w.node WHERE a.annotation IN (SELECT annotation FROM inh) AND (w.root, a.annotation) NOT IN (SELECT (class_name, annotation) FROM ann1) GROUP BY ALL),
base AS (SELECT class_name, annotation, 0 AS directness FROM ann1 UNION ALL SELECT class_name, annotation, 1 FROM nearest),
meta AS (SELECT DISTINCT b.class_name, c.node AS annotation FROM base b JOIN c_class_ann c ON c.root = b.annotation WHERE NOT starts_with(c.node, '{R.JAVA_META}') AND (b.directness = 0 OR c.node IN (SELECT annotation FROM inh)))"""
#: Classes that the values of an annotation name.
_VALUES = """list_concat(regexp_extract_all(array_to_string(list_transform(params, lambda p: coalesce(p.value_json, '')), chr(10)), '"(?:class|annotation)": ?"([^"\\[]+)"', 1),
  list_transform(regexp_extract_all(array_to_string(list_transform(params, lambda p: coalesce(p.value_json, '')), chr(10)), '"t": ?"c", ?"v": ?"(?:\\[*L)?([^";]+);?"', 1), lambda x: replace(x, '/', '.')))"""
_DEPS = f"""on_members AS (SELECT CASE target_kind WHEN 'field' THEN 'field' ELSE 'method' END AS kind, class_name, member_ord AS ord, unnest(list_append({_VALUES}, annotation)) AS dst FROM annotations_ WHERE target_kind <> 'class'),
method_names AS (
  SELECT class_name, name, descriptor, unnest({_NAMES.format('descriptor')}) AS dst FROM methods_ UNION SELECT class_name, name, descriptor, unnest({_NAMES.format('signature')}) FROM methods_ WHERE signature IS NOT NULL
  UNION SELECT class_name, name, descriptor, {sql_class_name('t')} FROM (SELECT class_name, name, descriptor, unnest(thrown) AS t FROM methods_)
  UNION SELECT class_name, name, descriptor, dst FROM methods_ JOIN (SELECT class_name, ord, dst FROM on_members WHERE kind = 'method') USING (class_name, ord)),
field_names AS (
  SELECT class_name, name, unnest({_NAMES.format('descriptor')}) AS dst FROM fields_ UNION SELECT class_name, name, dst FROM fields_ JOIN (SELECT class_name, ord, dst FROM on_members WHERE kind = 'field') USING (class_name, ord)),
deps AS (
  SELECT DISTINCT src, dst FROM (
    SELECT src, dst FROM edges_
    UNION ALL SELECT class_name, unnest({_NAMES.format('type_signature')}) FROM classes_ WHERE type_signature IS NOT NULL
    UNION ALL SELECT class_name, annotation FROM base UNION ALL SELECT class_name, annotation FROM meta
    UNION ALL SELECT class_name, unnest({_VALUES}) FROM annotations_ WHERE target_kind = 'class'
    UNION ALL SELECT n.class_name, unnest({_VALUES}) FROM nearest n JOIN w_up w ON w.root = n.class_name AND w.depth = n.depth JOIN annotations_ a ON a.class_name = w.node AND a.annotation = n.annotation AND a.target_kind = 'class'
    UNION ALL SELECT r.class_name, n.dst FROM resolved_methods r JOIN method_names n ON n.class_name = r.declared_in AND n.name = r.name AND n.descriptor = r.descriptor
    UNION ALL SELECT r.class_name, n.dst FROM resolved_fields r JOIN field_names n ON n.class_name = r.declared_in AND n.name = r.name)
  WHERE src <> dst AND dst <> '{OBJECT}' AND dst IN (SELECT class_name FROM classes_ WHERE NOT is_external) AND src IN (SELECT class_name FROM classes_ WHERE NOT is_external))"""
_MEMBERS_SQL = (SQL_METHODS, SQL_FIELDS, SQL_ANNOTATIONS)
_ALL_DEPS = (*_MEMBERS_SQL, *_MEMBER_LINES, _RESOLVED_METHODS, _RESOLVED_FIELDS, _closure("class_ann"), _INSTANCES, _DEPS)


def _flag(c: str) -> str:
    return f"class_name IN ({c})"


_ARG = """list_transform(regexp_extract_all({}, '\\[*(?:[BCDFIJSZV]|L[^;]+;)'), lambda t: CASE replace(t, '[', '') WHEN 'B' THEN 'byte' WHEN 'C' THEN 'char' WHEN 'D' THEN 'double' WHEN 'F' THEN 'float' WHEN 'I' THEN 'int' WHEN 'J' THEN 'long' WHEN 'S' THEN 'short'
  WHEN 'Z' THEN 'boolean' WHEN 'V' THEN 'void' ELSE replace(replace(regexp_replace(t, '^\\[*L', ''), ';', ''), '/', '.') END || repeat('[]', len(t) - len(replace(t, '[', ''))))"""
_ON = {k: f"SELECT DISTINCT src FROM edges_ WHERE rel = '{r}' AND (dst = '{HAS_NAMES['annotation']}' OR dst IN (SELECT root FROM c_class_ann WHERE node = '{HAS_NAMES['annotation']}'))" for k, r in (("field", "field_ann"), ("method", "method_ann"), ("param", "method_param_ann"))}

ORACLE = {
    "sig_methods": f"""WITH {SQL_METHODS} SELECT class_name, name, descriptor, '(' || array_to_string({_ARG.format("regexp_extract(descriptor, '[(](.*)[)]', 1)")}, ', ') || ') ' || {_ARG.format("regexp_extract(descriptor, '[)](.*)$', 1)")}[1] AS text, descriptor AS erased, CAST(0 AS INTEGER) AS type_params, false AS generic FROM methods_""",
    "f16_class_predicates": _with(*_MEMBERS_SQL, *_MEMBER_LINES, _RESOLVED_METHODS, _RESOLVED_FIELDS, _closure("class_ann"), _OWN_ANN) + f"""SELECT 'extends' AS predicate, root AS class_name FROM sup WHERE node = '{HAS_NAMES['superclass']}'
UNION SELECT 'implements', root FROM (SELECT root, node FROM c_implements UNION SELECT s.root, c.node FROM sup s JOIN c_implements c ON c.root = s.node) WHERE node = '{HAS_NAMES['interface']}'
UNION SELECT 'annotated', root FROM (SELECT root, node FROM own UNION SELECT s.root, o.node FROM sup s JOIN own o ON o.root = s.node WHERE o.node IN (SELECT class_name FROM classes_ WHERE inherited_meta)) WHERE node = '{HAS_NAMES['annotation']}'
UNION SELECT 'declared_method', class_name FROM methods_ WHERE name = '<init>' UNION SELECT 'method', class_name FROM resolved_methods WHERE name = '{HAS_NAMES['method']}'
UNION SELECT 'declared_field', class_name FROM fields_ WHERE name = '{HAS_NAMES['field']}' UNION SELECT 'field', class_name FROM resolved_fields WHERE name = '{HAS_NAMES['field']}'
""" + "".join(f"UNION SELECT 'declared_{k}_annotation', src FROM ({q}) UNION SELECT '{k}_annotation', root FROM method_lines WHERE node IN ({q})\n" for k, q in _ON.items()),
    "j10_effective_values": f"""WITH {SQL_ANNOTATIONS}, p AS (SELECT ann_id, annotation, target_kind, unnest(params) AS p, unnest(range(len(params))) AS i FROM annotations_),
d AS (SELECT annotation, p.name AS name, min(p.value_json) AS v FROM p GROUP BY ALL),
g AS (SELECT ann_id, annotation, p.name AS name, p.value_json AS v FROM p WHERE target_kind = 'class'),
w AS (SELECT a.ann_id, a.annotation, d.name, d.v FROM annotations_ a JOIN d USING (annotation) WHERE target_kind = 'class')
SELECT w.ann_id, w.name, coalesce(g.v, w.v) AS value_json, g.v IS NULL AS is_default FROM w LEFT JOIN g ON g.ann_id = w.ann_id AND g.name = w.name WHERE coalesce(g.v, w.v) IS NOT NULL""",
    "sig_classes": _with("""sup1 AS (SELECT src, min(dst) AS dst FROM edges_ WHERE rel = 'extends' GROUP BY src), itf1 AS (SELECT src, string_agg(dst, ' ' ORDER BY coalesce(ord, 1 << 30), dst) AS dsts FROM edges_ WHERE rel = 'implements' GROUP BY src)""")
    + r"""SELECT class_name, CASE WHEN type_signature IS NULL THEN coalesce(s.dst, 'java.lang.Object') ELSE replace(regexp_extract(type_signature, '>L([^;]+);$', 1), '/', '.') END AS superclass,
CASE WHEN type_signature IS NULL THEN coalesce(dsts, '') ELSE '' END AS interfaces, CASE WHEN type_signature IS NULL THEN 0 ELSE 1 END AS type_params, type_signature IS NOT NULL AS generic
FROM classes_ LEFT JOIN sup1 s ON s.src = class_name LEFT JOIN itf1 i ON i.src = class_name""",
    "g16_type_arguments": _with(_UP, f"""lk AS (SELECT src, min(dst) AS dst FROM edges_ WHERE rel = 'extends' GROUP BY src),
has_row AS (SELECT class_name FROM known_),
circular AS (SELECT root FROM up_ WHERE node IN (SELECT root FROM up_ WHERE root = node)),
filled(root, node, fixed) AS (SELECT src, dst, len(src) % 3 = 0 FROM lk WHERE src NOT IN (SELECT root FROM circular) AND src IN (SELECT class_name FROM has_row) AND dst IN (SELECT class_name FROM has_row)
  UNION ALL SELECT f.root, l.dst, f.fixed OR len(f.node) % 3 = 0 FROM filled f JOIN lk l ON l.src = f.node WHERE l.dst IN (SELECT class_name FROM has_row))""")
    + "SELECT root AS class_name, node AS supertype, 'T' AS variable, CASE WHEN fixed THEN 'java.lang.String' ELSE 'T' END AS argument FROM filled",
    "o_orders": _with(SQL_METHODS) + f"""SELECT 'class' AS what, class_name, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS descriptor, row_number() OVER (ORDER BY class_name) - 1 AS position FROM classes_ WHERE {sql_visible(SCOPE)}
UNION ALL SELECT 'package', package_name, NULL, NULL, row_number() OVER (ORDER BY package_name) - 1 FROM (SELECT DISTINCT package_name FROM classes_ WHERE {sql_visible(SCOPE)})
UNION ALL SELECT 'method', class_name, name, descriptor, row_number() OVER (ORDER BY class_name, name, descriptor) - 1 FROM methods_""",
    "fn_paths": """SELECT cp_idx, regexp_replace(uri, '^file:', '') AS path, uri AS url, '/' || regexp_replace(regexp_replace(regexp_replace(uri, '^file:/', ''), '/?[^/]*$', ''), '/?[^/]*$', '') || '/y z/a.jar' AS beside, regexp_replace(uri, '^.*/', '') AS leaf, true AS is_url,
uri || ':/a b:jar:' || uri || '!/c' AS list FROM cp_elements WHERE uri IS NOT NULL""",
    "g1_subclasses": _with(_UP) + _answer(f"SELECT node AS root, root AS node FROM up_ WHERE node <> '{OBJECT}' UNION ALL SELECT '{OBJECT}', class_name FROM classes_ WHERE NOT {_KIND['itf']} AND NOT {_KIND['ann']} AND class_name <> '{OBJECT}'", _one("extends", "dst", "src"), True),
    "g2_superclasses": _with(_depth("extends", "w_up")) + "SELECT root AS class_name, node AS related, min(depth) AS rank FROM w_up GROUP BY root, node",
    "g3_superclass": _with() + "SELECT src AS class_name, CASE WHEN count(*) = 1 THEN min(dst) END AS superclass, count(*) AS n FROM edges_ WHERE rel = 'extends' GROUP BY src",
    "g4_superinterfaces": _with(_depth("extends", "w_up"), _depth("implements", "w_im"), "own AS (SELECT root, node, min(depth) AS depth FROM w_im GROUP BY root, node), sup AS (SELECT root, node, min(depth) AS depth FROM w_up GROUP BY root, node)")
    + """SELECT a.root AS class_name, a.node AS related, e.src IS NOT NULL AS is_direct, r[1] AS branch, r[2] AS rank FROM (
  SELECT root, node, min([branch, depth]) AS r FROM (SELECT root, node, 0 AS branch, depth FROM own UNION ALL SELECT s.root, o.node, s.depth, o.depth FROM sup s JOIN own o ON o.root = s.node) GROUP BY root, node) a
LEFT JOIN edges_ e ON e.rel = 'implements' AND e.src = a.root AND e.dst = a.node""",
    "g5_implementing": _with(_UP, _closure("implements"), _IMPL) + _answer("SELECT root, node FROM impl", _one("implements", "dst", "src"), True),
    "g6_subinterfaces": _with(_UP, _closure("implements"), _IMPL) + "SELECT * FROM (" + _answer("SELECT root, node FROM impl", _one("implements", "dst", "src"), True) + f") WHERE related IN (SELECT class_name FROM classes_ WHERE {_KIND['itf']} OR {_KIND['ann']})",
    "g7_outer": _with(_depth("inner_of", "w")) + "SELECT root AS class_name, node AS related, min(depth) AS rank FROM w GROUP BY root, node",
    "g7_inner": _with(_closure("inner_of")) + _answer("SELECT node AS root, root AS node FROM c_inner_of", _one("inner_of", "dst", "src"), False),
    "g8_with_annotation": _with(_UP, _closure("class_ann")) + _WITH_ANN,
    "g9_annotations": _with(_UP, _closure("class_ann"), _OWN_ANN) + _answer("SELECT root, node FROM own UNION SELECT u.root, o.node FROM up_ u JOIN own o ON o.root = u.node WHERE o.node IN (SELECT class_name FROM classes_ WHERE inherited_meta)", _one("class_ann", "src", "dst"), False),
    "g10_with_method_annotation": _member("method_ann"), "g10_with_field_annotation": _member("field_ann"), "g10_with_param_annotation": _member("method_param_ann"),
    "g11_method_annotations": _on_members("method_ann"), "g11_field_annotations": _on_members("field_ann"), "g11_param_annotations": _on_members("method_param_ann"),
    "g13_package_tree": _with(f"own AS (SELECT package_name, count(*) AS n FROM classes_ WHERE {sql_visible(SCOPE)} GROUP BY package_name)")
    + """SELECT p AS package_name, sum(CASE WHEN p = package_name THEN n ELSE 0 END)::BIGINT AS n_classes, sum(n)::BIGINT AS n_in_subtree FROM (
  SELECT unnest(CASE WHEN package_name = '' THEN [''] ELSE list_concat([''], list_transform(range(1, len(string_split(package_name, '.')) + 1), lambda i: array_to_string(string_split(package_name, '.')[1:i], '.'))) END) AS p, package_name, n FROM own) GROUP BY p""",
    "w3_methods": _with(SQL_METHODS, *_MEMBER_LINES, _RESOLVED_METHODS) + "SELECT * FROM resolved_methods",
    "w4_fields": _with(SQL_FIELDS, *_MEMBER_LINES, _RESOLVED_FIELDS) + "SELECT * FROM resolved_fields",
    "k9_node_labels": _with(*_MEMBERS_SQL) + f"""SELECT c.class_name, CASE WHEN {_KIND['ann']} THEN 'oval' WHEN {_KIND['itf']} THEN 'diamond' ELSE 'box' END AS shape,
coalesce(annotations, '') AS annotations, coalesce(fields, '') AS fields, coalesce(methods, '') AS methods FROM classes_ c
LEFT JOIN (SELECT class_name, string_agg(t, ' ' ORDER BY t) AS annotations FROM (SELECT DISTINCT class_name, regexp_replace(annotation, '^.*\\.', '') AS t FROM annotations_ WHERE target_kind = 'class' AND NOT starts_with(annotation, '{R.JAVA_META}')) GROUP BY class_name) a ON a.class_name = c.class_name
LEFT JOIN (SELECT class_name, string_agg(t, ' ' ORDER BY t) AS fields FROM (SELECT DISTINCT class_name, concat_ws(':', name, descriptor) AS t FROM fields_ WHERE name <> 'serialVersionUID') GROUP BY class_name) f ON f.class_name = c.class_name
LEFT JOIN (SELECT class_name, string_agg(t, ' ' ORDER BY t) AS methods FROM (SELECT DISTINCT class_name, name || descriptor AS t FROM methods_ WHERE name <> '<clinit>' AND name || descriptor NOT IN ('hashCode()I', 'toString()Ljava/lang/String;', 'equals(Ljava/lang/Object;)Z')) GROUP BY class_name) m ON m.class_name = c.class_name
WHERE NOT is_external""",
    "g12_annotation_instances": _with(_depth("extends", "w_up"), _closure("class_ann"), SQL_ANNOTATIONS, _INSTANCES) + f""",
shown AS (SELECT class_name, annotation, array_to_string(list_transform(params, lambda p: p.name || '=' || p.value_json), ';') AS params FROM annotations_ WHERE target_kind = 'class'),
carriers AS (SELECT class_name, annotation AS carrier, directness FROM base UNION SELECT b.class_name, c.node, b.directness FROM base b JOIN c_class_ann c ON c.root = b.annotation WHERE NOT starts_with(c.node, '{R.JAVA_META}'))
SELECT DISTINCT class_name, annotation, directness, params FROM (
  SELECT class_name, annotation, 0 AS directness, params FROM shown
  UNION ALL SELECT n.class_name, n.annotation, 1, s.params FROM nearest n JOIN w_up w ON w.root = n.class_name AND w.depth = n.depth JOIN shown s ON s.class_name = w.node AND s.annotation = n.annotation
  UNION ALL SELECT c.class_name, e.dst, 2, s.params FROM carriers c JOIN edges_ e ON e.rel = 'class_ann' AND e.src = c.carrier AND NOT starts_with(e.dst, '{R.JAVA_META}') LEFT JOIN shown s ON s.class_name = c.carrier AND s.annotation = e.dst
    WHERE (c.directness = 0 OR e.dst IN (SELECT annotation FROM inh)) AND (c.class_name, e.dst) NOT IN (SELECT (class_name, annotation) FROM base))""",
    "f14_selections": f"""WITH {_RES} SELECT 'extension' AS how, cp_idx, path FROM res WHERE ends_with(lower(path), '.class') UNION ALL SELECT 'regex', cp_idx, path FROM res WHERE regexp_full_match(path, '.*/[A-C][a-zA-Z]*X[0-9a-z]+\\.class')
UNION ALL SELECT 'glob', cp_idx, path FROM res WHERE regexp_full_match(path, '[^/]*/[^/]*/[^/]*/[^/]*\\.class') UNION ALL SELECT 'leaf', cp_idx, path FROM res WHERE ends_with(path, '/RosterReaderX0.class') UNION ALL SELECT 'path', cp_idx, path FROM res WHERE path = 'fennik/tariff/intern/RosterReaderX0.class'""",
    "a3_overloads": f"WITH {SQL_METHODS} SELECT class_name, name, count(*) AS n, string_agg(descriptor, ' ' ORDER BY descriptor) AS descriptors FROM methods_ GROUP BY class_name, name",
    "a9_single_methods": f"WITH {SQL_METHODS} SELECT class_name, name, descriptor FROM (SELECT *, count(*) OVER (PARTITION BY class_name, name) AS n FROM methods_) WHERE n = 1",
    "j8_thrown": _with(SQL_METHODS) + f"SELECT * FROM (SELECT {sql_class_name('t')} AS thrown, class_name, name, descriptor, CAST(pos AS INTEGER) AS pos FROM (SELECT class_name, name, descriptor, unnest(thrown) AS t, unnest(range(len(thrown))) AS pos FROM methods_)) WHERE thrown IN (SELECT class_name FROM classes_)",
    "f2_kinds": _with() + f"""SELECT class_name, NOT {_KIND['itf']} AND NOT {_KIND['ann']} AS standard, {_KIND['itf']} AND NOT {_KIND['ann']} AS interface, {_KIND['itf']} OR {_KIND['ann']} AS interface_or_annotation,
class_name IN (SELECT dst FROM edges_ WHERE rel = 'implements') AS implemented_interface, {_KIND['ann']} AS annotation, {_KIND['enum']} AND NOT {_KIND['itf']} AND NOT {_KIND['ann']} AS enum, is_record FROM classes_""",
    "f3_visible": _with() + f"SELECT class_name FROM classes_ WHERE {sql_visible(REJECTING)}",
    "f4_path_status": f"""WITH {_RES}, d AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM res)
SELECT dir, CASE WHEN dir = 'fennik/depot' OR starts_with(dir, 'fennik/depot/') THEN 'rejected' WHEN dir = 'brenvo/atlas' OR regexp_full_match(dir, 'fennik/[^/]*') THEN 'at' WHEN dir = 'tolvik/billing' THEN 'at_class_package'
WHEN starts_with(dir, 'brenvo/atlas/') OR regexp_full_match(dir, 'fennik/[^/]*/.*') THEN 'below' WHEN dir IN ('', 'brenvo', 'fennik', 'tolvik') THEN 'above' ELSE 'outside' END AS status FROM d""",
    "f14_globs": f"""WITH {_RES} SELECT 'brenvo/*/*.class' AS glob, cp_idx, path FROM res WHERE regexp_full_match(path, 'brenvo/[^/]*/[^/]*\\.class')
UNION ALL SELECT '**/*Reader*.class', cp_idx, path FROM res WHERE regexp_full_match(path, '(?:[^/]+/)*[^/]*Reader[^/]*\\.class') UNION ALL SELECT 'fennik/**', cp_idx, path FROM res WHERE regexp_full_match(path, 'fennik(?:/.*)?')""",
    "f16_has": _with(*_MEMBERS_SQL) + f"""SELECT class_name, {_flag("SELECT class_name FROM methods_ WHERE name <> '<init>'")} AS has_methods, {_flag("SELECT class_name FROM methods_ WHERE name = '<init>'")} AS has_constructor,
{_flag("SELECT class_name FROM fields_")} AS has_fields, {_flag("SELECT class_name FROM annotations_ WHERE target_kind = 'class'")} AS has_annotations, {_flag("SELECT dst FROM edges_ WHERE rel = 'inner_of'")} AS has_inner FROM classes_""",
    "f17_modifiers": f"WITH {SQL_METHODS} SELECT class_name, name, descriptor, {M.sql_modifiers_string('method')} AS words, coalesce(modifiers & {M.ACCESS}, 0) = 0 AS package_visible, coalesce(modifiers & 8, 0) = 8 AS static FROM methods_",
    "u_set_operations": _with(_UP, _closure("class_ann"), f"car AS ({_WITH_ANN})")
    + f"""SELECT 'union' AS op, related AS class_name, bool_or(is_direct) AS is_direct FROM car WHERE class_name IN ({_LISTED}) GROUP BY related
UNION ALL SELECT 'intersect', a.related, a.is_direct AND b.is_direct FROM car a JOIN car b ON a.related = b.related WHERE a.class_name = '{SET_ANNOTATIONS[0]}' AND b.class_name = '{SET_ANNOTATIONS[1]}'
UNION ALL SELECT 'exclude', related, is_direct FROM car WHERE class_name = '{SET_ANNOTATIONS[0]}' AND related NOT IN (SELECT related FROM car WHERE class_name = '{SET_ANNOTATIONS[1]}')
UNION ALL SELECT 'direct_only', related, true FROM car WHERE class_name IN ('{SET_ANNOTATIONS[0]}', '{SET_ANNOTATIONS[1]}') GROUP BY related HAVING bool_or(is_direct)
UNION ALL SELECT 'all', related, NULL FROM car WHERE class_name IN ('{SET_ANNOTATIONS[0]}', '{SET_ANNOTATIONS[1]}') GROUP BY related HAVING count(DISTINCT class_name) = 2
UNION ALL SELECT DISTINCT 'any', related, CAST(NULL AS BOOLEAN) FROM car WHERE class_name IN ({_LISTED})""",
    "u_assignable": _with(_UP, _closure("implements"), _IMPL, "b AS (" + _answer("SELECT root, node FROM impl", _one("implements", "dst", "src"), True) + ")") + "SELECT class_name, related FROM b UNION SELECT class_name, class_name FROM b",
    "j2_placeholders": _with() + "SELECT class_name, modifiers, package_name FROM classes_ WHERE class_name NOT IN (SELECT class_name FROM raw_ WHERE class_name IS NOT NULL)",
    "j4_membership": _with() + f"SELECT module_name, package_name, count(*) AS n, min(class_name) AS first_class FROM classes_ WHERE {sql_visible(SCOPE)} GROUP BY module_name, package_name",
    "w1_masking": f"WITH {_RES} SELECT cp_idx, path, row_number() OVER (PARTITION BY path ORDER BY cp_idx NULLS LAST) > 1 AS masked FROM res",
    "a1_resources_by_path": f"WITH {_RES} SELECT path, count(*) AS n, coalesce(string_agg(CAST(cp_idx AS VARCHAR), ',' ORDER BY cp_idx), '') AS elements FROM res GROUP BY path",
    "a2_duplicate_paths": f"WITH {_RES} SELECT path, count(*) AS n FROM res GROUP BY path HAVING count(*) > 1",
    "a5_last_modified": "SELECT strftime(max(mtime), '%Y-%m-%d %H:%M:%S') AS last_modified, bool_or(mtime > TIMESTAMP '2024-06-01') AS any_modified FROM cp_elements",
    "a8_modifier_union": f"SELECT {sql_class_name('class_name')} AS class_name, bit_or(modifiers) AS modifiers FROM classes GROUP BY 1",
    "s11_element_order": """WITH RECURSIVE e AS (SELECT cp_idx, parent_idx, coalesce(idx_in_parent, cp_idx) AS i, kind = 'module' AS m FROM cp_elements),
t AS (SELECT cp_idx, m, [cp_idx] AS key FROM e WHERE parent_idx IS NULL OR parent_idx NOT IN (SELECT cp_idx FROM e) UNION ALL SELECT e.cp_idx, t.m, list_append(t.key, e.i) FROM e JOIN t ON e.parent_idx = t.cp_idx)
SELECT cp_idx, CAST(row_number() OVER (ORDER BY m DESC, key, cp_idx) - 1 AS INTEGER) AS position FROM t""",
    "g18_dependencies": _with(*_ALL_DEPS) + "SELECT src, dst FROM deps",
    "g19_reverse_dependencies": _with(*_ALL_DEPS) + "SELECT dst AS class_name, src AS other, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pos, count(*) OVER (PARTITION BY dst) AS n FROM deps",
    "g19_dependencies": _with(*_ALL_DEPS) + "SELECT src AS class_name, dst AS other, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n FROM deps",
    "k1_dot_edges": _with(*_MEMBERS_SQL) + f"""SELECT DISTINCT src, dst, kind FROM (
  SELECT src, dst, rel AS kind FROM edges_ WHERE rel IN ('extends', 'implements', 'class_ann', 'field_ann', 'method_ann')
  UNION ALL SELECT class_name, unnest({_NAMES.format('descriptor')}), 'field_type' FROM fields_ UNION ALL SELECT class_name, unnest({_NAMES.format('descriptor')}), 'method_type' FROM methods_)
WHERE (src <> dst OR kind NOT LIKE '%_type') AND dst <> '{OBJECT}' AND NOT starts_with(dst, '{R.JAVA_META}') AND src IN (SELECT class_name FROM classes_ WHERE NOT is_external) AND dst IN (SELECT class_name FROM classes_ WHERE NOT is_external)""",
}
