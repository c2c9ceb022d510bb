"""The class graph as clean tables: names in one spelling, each fact once, every end of an edge with a class row."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bytegrove.functions.globs import any_prefix, sql_any_prefix
from bytegrove.functions.modifiers import ANNOTATION, INTERFACE
from bytegrove.functions.names import class_name, descriptor, package_of, sql_class_name, sql_descriptor
from bytegrove.scratch import Scratch
from bytegrove.sources.tables import table

#: Forward relations; the reverse of each is the same edges read from dst to src.
RELATIONS = ("extends", "implements", "inner_of", "class_ann", "method_ann", "method_param_ann", "field_ann")
OBJECT = "java.lang.Object"


@dataclass(frozen=True)
class Scope:
    """Which classes answers may name. Packages are prefixes or globs and hold with all below them; empty accepts all."""

    accept_packages: tuple[str, ...] = ()
    reject_packages: tuple[str, ...] = ()
    reject_classes: tuple[str, ...] = ()
    external: bool = False
    #: Which facts were read; a query that needs one that wasn't is an error before anything is planned.
    reads: frozenset[str] = field(default_factory=lambda: frozenset({"class", "field", "method", "annotation", "refs"}))

    def need(self, *facts: str) -> None:
        missing = [f for f in facts if f not in self.reads]
        if missing:
            raise ValueError(f"this query needs {', '.join(missing)} info, which the scan left out")

    def visible(self, strict: bool = True, name: str = "class_name", is_external: str = "is_external") -> Column:
        """Whether a class may show: never a rejected one, and an external one only if asked for or not ``strict``.

        Downward queries are strict, upward ones are not, and both apply this to results only, never on the way.
        """
        ok = F.lit(True) if self.external or not strict else ~F.col(is_external)
        if self.reject_packages:
            ok = ok & ~any_prefix(package_of(name), self.reject_packages)
        if self.reject_classes:
            ok = ok & ~F.col(name).isin(*self.reject_classes)
        if self.accept_packages and strict and not self.external:
            ok = ok & any_prefix(package_of(name), self.accept_packages)
        return ok


class Catalog:
    """Lazily built tables of §1: classes, edges, methods, fields, annotations, elements."""

    def __init__(
        self, classes: DataFrame, edges: DataFrame, methods: DataFrame | None = None, fields: DataFrame | None = None, annotations: DataFrame | None = None,
        elements: DataFrame | None = None, external: DataFrame | None = None, scope: Scope = Scope(),
    ):
        self.raw = {"classes": classes, "edges": edges, "methods": methods, "fields": fields, "annotations": annotations, "elements": elements, "external": external}
        self.scope = scope
        self.spark: SparkSession = classes.sparkSession
        self._scratch: Scratch | None = None

    def pin(self) -> Catalog:
        """Classes and edges are written once when first asked for: for questions that read them many times."""
        if self._scratch is None:
            self._scratch = Scratch(self.spark, "catalog")
        return self

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return df if self._scratch is None else self._scratch.save(df, name)

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str, scope: Scope = Scope()) -> Catalog:
        t = {n: table(spark, sf_dir, n) for n in ("classes", "edges", "methods", "class_fields", "annotations", "cp_elements", "platform_classes")}
        return cls(t["classes"], t["edges"], t["methods"], t["class_fields"], t["annotations"], t["cp_elements"], t["platform_classes"], scope)

    @cached_property
    def edges(self) -> DataFrame:
        """(rel, src, dst, ord, nonprivate): forward relations only, each once, both ends known; no interface extends Object."""
        e = self.raw["edges"]
        back = F.col("rel") == "extended_by"
        src, dst = class_name(F.when(back, F.col("dst")).otherwise(F.col("src"))), class_name(F.when(back, F.col("src")).otherwise(F.col("dst")))
        rel = F.when(back, F.lit("extends")).otherwise(F.col("rel"))
        known = e.select(rel.alias("rel"), src.alias("src"), dst.alias("dst"), "ord", "nonprivate").where("src is not null and dst is not null")
        once = known.groupBy("rel", "src", "dst").agg(F.min("ord").alias("ord"), F.max(F.coalesce("nonprivate", F.lit(False))).alias("nonprivate"))
        # A class file of an interface names Object as its superclass; it is none.
        interfaces = self._rows().where(F.col("modifiers").bitwiseAND(INTERFACE) != 0).select(F.col("class_name").alias("itf")).distinct()
        return self._kept(once.join(interfaces, (F.col("src") == F.col("itf")) & (F.col("rel") == "extends") & (F.col("dst") == OBJECT), "left_anti"), "edges")

    def _rows(self) -> DataFrame:
        """Rows of classes, those of the platform included, by their clean names; a name may have several."""
        keep = ["modifiers", "is_record", "is_external", "inherited_meta", "cp_idx", "resource_path", "package_name", "module_name", "type_signature", "scanned_at"]
        rows = self.raw["classes"]
        if self.raw["external"] is not None:
            rows = rows.unionByName(self.raw["external"])
        return rows.select(class_name("class_name").alias("class_name"), *keep).where("class_name is not null")

    def rel(self, *names: str) -> DataFrame:
        """(src, dst) of relations."""
        return self.edges.where(F.col("rel").isin(*names)).select("src", "dst")

    @cached_property
    def classes(self) -> DataFrame:
        """One row per class name. Of several, the first in element order wins; names that only edges know are placeholders.

        A type that is named as an annotation or interface has these bits whether or not it was scanned.
        """
        rows = self._rows()
        keep = rows.columns[1:]
        first = F.min(F.struct(*_null_last("is_external"), *_null_last("cp_idx"), *_null_last("scanned_at"), *_null_last("modifiers"), *_null_last("type_signature"), *[k for k in keep if k not in ("is_external", "cp_idx", "scanned_at", "modifiers", "type_signature")]))
        known = rows.groupBy("class_name").agg(first.alias("f")).select("class_name", *(F.col(f"f.{k}").alias(k) for k in keep))
        bit = F.when(F.col("rel").endswith("_ann"), ANNOTATION | INTERFACE).when(F.col("rel") == "implements", INTERFACE).otherwise(0)
        ends = self.edges.select(F.col("dst").alias("class_name"), bit.alias("bits")).unionByName(self.edges.select(F.col("src").alias("class_name"), F.lit(0).alias("bits")))
        named = ends.groupBy("class_name").agg(F.bit_or("bits").alias("bits"))
        out = known.join(named, "class_name", "full")
        out = out.select(
            "class_name",
            F.coalesce("modifiers", F.lit(0)).bitwiseOR(F.coalesce("bits", F.lit(0))).alias("modifiers"),
            F.coalesce("is_record", F.lit(False)).alias("is_record"),
            F.coalesce("is_external", F.lit(True)).alias("is_external"),
            F.coalesce("inherited_meta", F.lit(False)).alias("inherited_meta"),
            "cp_idx", "resource_path",
            package_of("class_name").alias("package_name"),
            "module_name", "type_signature",
        )
        return self._kept(out, "classes")

    def show(self, df: DataFrame, column: str, strict: bool = True) -> DataFrame:
        """Rows of ``df`` whose ``column`` names a visible class."""
        ok = self.classes.where(self.scope.visible(strict)).select(F.col("class_name").alias(column))
        return df.join(ok, column, "left_semi")

    @cached_property
    def methods(self) -> DataFrame:
        """(class_name, ord, name, descriptor, modifiers, has_body, thrown, signature): a (name, descriptor) of a class once, the first by ord."""
        self.scope.need("method")
        m = self.raw["methods"].select(class_name("class_name").alias("class_name"), "ord", "name", descriptor("descriptor").alias("descriptor"), "modifiers", "has_body", "thrown", "signature", "min_line", "max_line")
        m = m.where("class_name is not null and name is not null and descriptor is not null")
        first = F.min(F.struct(*_null_last("ord"), *_null_last("modifiers"), "has_body", "thrown", "signature", "min_line", "max_line"))
        return m.groupBy("class_name", "name", "descriptor").agg(first.alias("f")).select("class_name", "name", "descriptor", *(f"f.{k}" for k in ("ord", "modifiers", "has_body", "thrown", "signature", "min_line", "max_line")))

    @cached_property
    def fields(self) -> DataFrame:
        """(class_name, name, ord, descriptor, modifiers, const_json): a name of a class once, the first by ord."""
        self.scope.need("field")
        f = self.raw["fields"].select(class_name("class_name").alias("class_name"), "ord", "name", descriptor("descriptor").alias("descriptor"), "modifiers", "const_json").where("class_name is not null and name is not null")
        first = F.min(F.struct(*_null_last("ord"), *_null_last("descriptor"), "modifiers", "const_json"))
        return f.groupBy("class_name", "name").agg(first.alias("f")).select("class_name", "name", *(f"f.{k}" for k in ("ord", "descriptor", "modifiers", "const_json")))

    @cached_property
    def annotations(self) -> DataFrame:
        """(ann_id, target_kind, class_name, member_ord, param_idx, ord, annotation, visible, params): each instance once."""
        self.scope.need("annotation")
        a = self.raw["annotations"].select("ann_id", "target_kind", class_name("class_name").alias("class_name"), "member_ord", "param_idx", "ord", class_name("annotation").alias("annotation"), "visible", "params")
        return a.where("class_name is not null and annotation is not null").dropDuplicates(["ann_id"])


def _null_last(column: str) -> list[Column]:
    """Parts of a struct that put null after every value when the smallest struct is taken."""
    return [F.col(column).isNull().alias(f"no_{column}"), F.col(column)]


SQL_EDGES = f"""edges_ AS (
  SELECT rel, src, dst, min(ord) AS ord, bool_or(coalesce(nonprivate, false)) AS nonprivate FROM (
    SELECT CASE rel WHEN 'extended_by' THEN 'extends' ELSE rel END AS rel, {sql_class_name("CASE rel WHEN 'extended_by' THEN dst ELSE src END")} AS src,
      {sql_class_name("CASE rel WHEN 'extended_by' THEN src ELSE dst END")} AS dst, ord, nonprivate FROM edges)
  WHERE src IS NOT NULL AND dst IS NOT NULL
    AND NOT (rel = 'extends' AND dst = '{OBJECT}' AND src IN (SELECT {sql_class_name("class_name")} FROM (SELECT class_name, modifiers FROM classes UNION ALL SELECT class_name, modifiers FROM platform_classes) WHERE modifiers & {INTERFACE} <> 0 AND class_name IS NOT NULL))
  GROUP BY rel, src, dst)"""

SQL_CLASSES = f"""{SQL_EDGES},
raw_ AS (
  SELECT {sql_class_name("class_name")} AS class_name, modifiers, is_record, is_external, inherited_meta, cp_idx, resource_path, module_name, type_signature, scanned_at
  FROM (SELECT * FROM classes UNION ALL BY NAME SELECT * FROM platform_classes)),
known_ AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY is_external NULLS LAST, cp_idx NULLS LAST, scanned_at NULLS LAST, modifiers NULLS LAST, type_signature NULLS LAST) AS rn
  FROM raw_ WHERE class_name IS NOT NULL) WHERE rn = 1),
named_ AS (SELECT class_name, bit_or(bits) AS bits FROM (
  SELECT dst AS class_name, CASE WHEN ends_with(rel, '_ann') THEN {ANNOTATION | INTERFACE} WHEN rel = 'implements' THEN {INTERFACE} ELSE 0 END AS bits FROM edges_
  UNION ALL SELECT src, 0 FROM edges_) GROUP BY class_name),
classes_ AS (
  SELECT coalesce(k.class_name, n.class_name) AS class_name, coalesce(modifiers, 0) | coalesce(bits, 0) AS modifiers, coalesce(is_record, false) AS is_record,
    coalesce(is_external, true) AS is_external, coalesce(inherited_meta, false) AS inherited_meta, cp_idx, resource_path, module_name, type_signature,
    CASE WHEN instr(coalesce(k.class_name, n.class_name), '.') > 0 THEN regexp_replace(coalesce(k.class_name, n.class_name), '\\.[^.]*$', '') ELSE '' END AS package_name
  FROM known_ k FULL JOIN named_ n ON k.class_name = n.class_name)"""

SQL_METHODS = f"""methods_ AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY class_name, name, descriptor ORDER BY ord NULLS LAST, modifiers NULLS LAST) AS rn FROM (
      SELECT {sql_class_name("class_name")} AS class_name, name, {sql_descriptor("descriptor")} AS descriptor, ord, modifiers, has_body, thrown, signature, min_line, max_line FROM methods)
    WHERE class_name IS NOT NULL AND name IS NOT NULL AND descriptor IS NOT NULL) WHERE rn = 1)"""

SQL_FIELDS = f"""fields_ AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY class_name, name ORDER BY ord NULLS LAST, descriptor NULLS LAST) AS rn FROM (
      SELECT {sql_class_name("class_name")} AS class_name, name, {sql_descriptor("descriptor")} AS descriptor, ord, modifiers, const_json FROM class_fields)
    WHERE class_name IS NOT NULL AND name IS NOT NULL) WHERE rn = 1)"""

SQL_ANNOTATIONS = f"""annotations_ AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT ann_id, target_kind, {sql_class_name("class_name")} AS class_name, member_ord, param_idx, ord, {sql_class_name("annotation")} AS annotation, visible, params,
      row_number() OVER (PARTITION BY ann_id) AS rn FROM annotations) WHERE rn = 1 AND class_name IS NOT NULL AND annotation IS NOT NULL)"""


def sql_visible(scope: Scope, name: str = "class_name") -> str:
    """The SQL of ``Scope.visible(strict=True)`` for package scopes."""
    ok = ["true"] if scope.external else ["NOT is_external"]
    if scope.reject_packages:
        ok.append(f"NOT {sql_any_prefix('package_name', scope.reject_packages)}")
    return " AND ".join(ok)
