"""Which class refers to which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bytegrove.catalog import OBJECT, Catalog
from bytegrove.functions.names import class_name
from bytegrove.operators.members import Members
from bytegrove.scratch import Scratch

#: Class names in a descriptor or signature.
NAMES = r"L([^;<>()\[:*+\-]+)"


def names_in(column: str) -> Column:
    """Array of dotted class names in a descriptor."""
    return F.transform(F.regexp_extract_all(column, F.lit(NAMES), F.lit(1)), lambda x: F.translate(x, "/", "."))


def value_classes(params: str) -> Column:
    """Array of class names in annotation values: nested annotations, enum constants' types and class constants."""
    text = F.array_join(F.transform(params, lambda p: F.coalesce(p["value_json"], F.lit(""))), "\n")
    return F.concat(F.regexp_extract_all(text, F.lit(r'"(?:class|annotation)": ?"([^"\[]+)"'), F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(r'"t": ?"c", ?"v": ?"(?:\[*L)?([^";]+);?"'), F.lit(1)), lambda x: F.translate(x, "/", ".")))


def dependencies(cat: Catalog, class_refs: DataFrame | None = None, members: Members | None = None, defaults: DataFrame | None = None) -> DataFrame:
    """(src, dst): distinct references of each class through its relations, its signature, its own, inherited and meta
    annotations, and the methods and fields it has after overriding, inherited ones included: their types, annotations
    with the classes in their values, and thrown exceptions.

    ``class_refs`` (src, dst) adds what a constant pool names, ``defaults`` (annotation, value_json) what values of an
    annotation's methods name. A class does not depend on itself or on java.lang.Object; classes that scope hides are left
    out on the right, as are sources that were not scanned.
    """
    m = members or Members(cat)
    cat = m.cat
    sc = m.rel.scratch
    ann = cat.annotations
    named = ann.select("target_kind", "class_name", "member_ord", F.array_union(F.array("annotation"), value_classes("params")).alias("names"))
    # What a declaration names, once for each, however many classes inherit it.
    on = named.where("target_kind <> 'class'").select(F.when(F.col("target_kind") == "field", "field").otherwise("method").alias("kind"), "class_name", F.col("member_ord").alias("ord"), F.explode("names").alias("dst"))
    thrown = F.transform(F.coalesce("thrown", F.array()), class_name)
    meth = cat.methods.select("class_name", "ord", "name", "descriptor", F.array_distinct(F.concat(names_in("descriptor"), F.coalesce(names_in("signature"), F.array()), thrown)).alias("names"))
    fld = cat.fields.select("class_name", "ord", "name", "descriptor", names_in("descriptor").alias("names"))
    method_names = meth.select("class_name", "name", "descriptor", F.explode("names").alias("dst")).unionByName(
        meth.join(on.where("kind = 'method'").drop("kind"), ["class_name", "ord"]).select("class_name", "name", "descriptor", "dst")
    )
    field_names = fld.select("class_name", "name", F.explode("names").alias("dst")).unionByName(fld.join(on.where("kind = 'field'").drop("kind"), ["class_name", "ord"]).select("class_name", "name", "dst"))
    has_m = m.rel._keep("resolved_methods", m.methods).select(F.col("class_name").alias("src"), F.col("declared_in").alias("class_name"), "name", "descriptor")
    has_f = m.rel._keep("resolved_fields", m.fields).select(F.col("class_name").alias("src"), F.col("declared_in").alias("class_name"), "name")
    inst = m.rel._keep("instances", m.rel.annotation_instances)
    parts = [
        cat.edges.select("src", "dst"),
        cat.classes.where("type_signature is not null").select(F.col("class_name").alias("src"), F.explode(names_in("type_signature")).alias("dst")),
        inst.select(F.col("class_name").alias("src"), F.col("annotation").alias("dst")),
        named.where("target_kind = 'class'").select(F.col("class_name").alias("src"), F.explode("names").alias("dst")),
        has_m.join(sc.save(method_names.distinct(), "method_names"), ["class_name", "name", "descriptor"]).select("src", "dst"),
        has_f.join(sc.save(field_names.distinct(), "field_names"), ["class_name", "name"]).select("src", "dst"),
    ]
    # Values of inherited annotations are those on the class that carries them.
    carried = inst.where("directness = 1 and params is not null").select(F.col("class_name").alias("src"), F.from_json("params", "array<struct<name:string,value_json:string>>").alias("params"))
    parts.append(carried.select("src", F.explode(value_classes("params")).alias("dst")))
    if class_refs is not None:
        parts.append(class_refs.select("src", "dst"))
    if defaults is not None:
        d = defaults.select(F.col("annotation").alias("src"), F.array(F.struct(F.lit("").alias("name"), "value_json")).alias("params"))
        parts.append(d.select("src", F.explode(value_classes("params")).alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = sc.save(out.where((F.col("src") != F.col("dst")) & (F.col("dst") != OBJECT)).distinct(), "references")
    return cat.show(cat.show(out, "dst"), "src").select("src", "dst")


def dependency_map(deps: DataFrame, reverse: bool = False) -> DataFrame:
    """(class_name, other, pos, n): the classes that each refers to, or with ``reverse`` is referred to by, numbered in name
    order from 0, with how many there are. Classes without any are left out.

    The lists stay rows: a class that all others refer to would else be one row of any size. Numbers come from ranges of
    (class, other) with the counts of the ranges before, so no task orders one class's list by itself.
    """
    key, other = ("dst", "src") if reverse else ("src", "dst")
    sc = Scratch(deps.sparkSession, "dependency_map")
    pairs = deps.select(F.col(key).alias("class_name"), F.col(other).alias("other")).repartitionByRange("class_name", "other").withColumn("part", F.spark_partition_id())
    pairs = sc.save(pairs, "ranged")
    w = Window.partitionBy("class_name")
    before = pairs.groupBy("class_name", "part").agg(F.count(F.lit(1)).alias("m"))
    before = before.select("class_name", "part", F.sum("m").over(w).alias("n"), (F.sum("m").over(w.orderBy("part")) - F.col("m")).alias("ahead"))
    within = pairs.withColumn("i", F.row_number().over(Window.partitionBy("class_name", "part").orderBy("other")))
    return within.join(before, ["class_name", "part"]).select("class_name", "other", (F.col("i") - 1 + F.col("ahead")).alias("pos"), "n")
