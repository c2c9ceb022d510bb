"""Inverted questions over the class graph, each for all classes at once: filter the result by class_name for one.

Downward answers (who extends, implements, carries this) show accepted classes only, upward ones show external classes
too. Nothing is filtered on the way: an accepted class below an external one is still found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bytegrove.catalog import OBJECT, Catalog
from bytegrove.functions.modifiers import is_interface_or_annotation, is_standard
from bytegrove.operators.closure import closure
from bytegrove.scratch import Scratch

JAVA_META = "java.lang.annotation."


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("root"), F.col(b).alias("node"))


def _flagged(cat: Catalog, reach: DataFrame, direct: DataFrame, strict: bool) -> DataFrame:
    """(class_name, related, is_direct) of (root, node) pairs; direct pairs are marked, and both sides filtered alike."""
    both = reach.select("root", "node", F.lit(False).alias("d")).unionByName(direct.select("root", "node", F.lit(True).alias("d")))
    shown = cat.show(both.groupBy("root", "node").agg(F.max("d").alias("is_direct")), "node", strict)
    return shown.select(F.col("root").alias("class_name"), F.col("node").alias("related"), "is_direct")


class Relations:
    """Questions over one catalog; the closures they share are written once."""

    def __init__(self, cat: Catalog):
        self.cat = cat.pin()
        self.scratch = Scratch(cat.spark, "relations")
        self._kept: dict[str, DataFrame] = {}

    def _keep(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            made = make()
            # A closure is written as it is made.
            self._kept[name] = made if name == "up" or name.startswith("closure_") else self.scratch.save(made, name)
        return self._kept[name]

    def up(self) -> DataFrame:
        """(root, node, depth): every superclass of every class."""
        return self._keep("up", lambda: closure(self.cat.rel("extends")))

    def closure(self, rel: str) -> DataFrame:
        """(root, node, depth) along a relation."""
        return self._keep("closure_" + rel, lambda: closure(self.cat.rel(rel)))

    # extends

    def superclasses(self) -> DataFrame:
        """(class_name, related, rank): nearest first."""
        return self.cat.show(self.up(), "node", strict=False).select(F.col("root").alias("class_name"), F.col("node").alias("related"), F.col("depth").cast("int").alias("rank"))

    def superclass(self) -> DataFrame:
        """(class_name, superclass, n): the one superclass, null where a class has several (n of them)."""
        g = self.cat.rel("extends").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("superclass"))
        return g.select(F.col("src").alias("class_name"), F.when(F.col("n") == 1, F.col("superclass")).alias("superclass"), "n")

    def subclasses(self) -> DataFrame:
        """(class_name, related, is_direct). Under java.lang.Object stand all standard classes, whether or not a link says so."""
        below = self.up().where(F.col("node") != OBJECT).select(F.col("node").alias("root"), F.col("root").alias("node"))
        every = self.cat.classes.where(is_standard() & (F.col("class_name") != OBJECT)).select(F.lit(OBJECT).alias("root"), F.col("class_name").alias("node"))
        return _flagged(self.cat, below.unionByName(every), _pairs(self.cat.rel("extends"), "dst", "src"), True)

    # implements

    def superinterfaces(self) -> DataFrame:
        """(class_name, related, is_direct, rank): own interfaces and theirs first, then those of each superclass."""
        own = self.closure("implements").select("root", "node", F.lit(0).alias("branch"), "depth")
        via = self.up().select("root", F.col("node").alias("sup"), F.col("depth").alias("branch")).join(own.select(F.col("root").alias("sup"), "node", "depth"), "sup").drop("sup")
        first = own.unionByName(via.select("root", "node", "branch", "depth")).groupBy("root", "node").agg(F.min(F.struct("branch", "depth")).alias("r"))
        direct = self.cat.rel("implements").select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(True).alias("d"))
        out = self.cat.show(first, "node", strict=False).join(direct, ["root", "node"], "left")
        return out.select(F.col("root").alias("class_name"), F.col("node").alias("related"), F.coalesce("d", F.lit(False)).alias("is_direct"), F.col("r.branch").cast("int").alias("branch"), F.col("r.depth").cast("int").alias("rank"))

    def _implementing(self) -> DataFrame:
        hit = self.closure("implements").select(F.col("node").alias("root"), F.col("root").alias("node"))
        below = hit.join(self.up().select(F.col("root").alias("sub"), "node"), "node").select("root", F.col("sub").alias("node"))
        return hit.unionByName(below)

    def implementing(self) -> DataFrame:
        """(class_name, related, is_direct): classes and interfaces that implement it, any superclass or interface between."""
        return self._keep("implementing", lambda: _flagged(self.cat, self._implementing(), _pairs(self.cat.rel("implements"), "dst", "src"), True))

    def subinterfaces(self) -> DataFrame:
        """Of ``implementing`` those that are interfaces or annotations."""
        kinds = self.cat.classes.where(is_interface_or_annotation()).select(F.col("class_name").alias("related"))
        return self.implementing().join(kinds, "related", "left_semi").select("class_name", "related", "is_direct")

    # nesting

    def outer(self) -> DataFrame:
        """(class_name, related, rank): enclosing classes, innermost first."""
        return self.cat.show(self.closure("inner_of"), "node", False).select(F.col("root").alias("class_name"), F.col("node").alias("related"), F.col("depth").alias("rank"))

    def inner(self) -> DataFrame:
        return _flagged(self.cat, self.closure("inner_of").select(F.col("node").alias("root"), F.col("root").alias("node")), _pairs(self.cat.rel("inner_of"), "dst", "src"), False)

    # annotations

    def inherited(self) -> DataFrame:
        """(node) annotations that pass to subclasses."""
        return self.cat.classes.where("inherited_meta").select(F.col("class_name").alias("node"))

    def with_annotation(self) -> DataFrame:
        """(class_name, related, is_direct): classes that carry an annotation, through others or by inheritance."""
        hit = self.closure("class_ann").select(F.col("node").alias("root"), F.col("root").alias("node"))
        kept = hit.join(self.inherited().withColumnRenamed("node", "root"), "root", "left_semi")
        below = kept.join(self.up().select(F.col("root").alias("sub"), "node"), "node").select("root", F.col("sub").alias("node"))
        return _flagged(self.cat, hit.unionByName(below), _pairs(self.cat.rel("class_ann"), "dst", "src"), True)

    def _class_annotations(self) -> DataFrame:
        """(root, node): annotations of a class and theirs; those of java.lang.annotation only where direct."""
        direct = _pairs(self.cat.rel("class_ann"), "src", "dst")
        reach = self.closure("class_ann").select("root", "node").where(~F.col("node").startswith(JAVA_META))
        return reach.unionByName(direct).distinct()

    def annotations(self) -> DataFrame:
        """(class_name, related, is_direct): annotations on a class, theirs, and inherited ones of its superclasses."""
        own = self._keep("class_annotations", self._class_annotations)
        # The drop of java.lang.annotation is per class walked, so a superclass's direct ones pass if they are inherited.
        above = self.up().select("root", F.col("node").alias("sup")).join(own.select(F.col("root").alias("sup"), "node").join(self.inherited(), "node", "left_semi"), "sup").select("root", "node")
        return _flagged(self.cat, own.unionByName(above), _pairs(self.cat.rel("class_ann"), "src", "dst"), False)

    def with_member_annotation(self, rel: str) -> DataFrame:
        """(class_name, related, is_direct): classes that declare a method, parameter or field with the annotation or one
        that carries it; subclasses too, where the member isn't private."""
        e = self.cat.edges.where(F.col("rel") == rel).select("src", "dst", "nonprivate")
        meta = self.closure("class_ann").select(F.col("root").alias("dst"), "node")
        hits = e.select(F.col("dst").alias("root"), F.col("src").alias("node"), "nonprivate").unionByName(
            e.join(meta, "dst").select(F.col("node").alias("root"), F.col("src").alias("node"), "nonprivate")
        )
        kept = hits.where("nonprivate").select("root", "node").distinct()
        below = kept.join(self.up().select(F.col("root").alias("sub"), "node"), "node").select("root", F.col("sub").alias("node"))
        return _flagged(self.cat, hits.select("root", "node").unionByName(below), e.select(F.col("dst").alias("root"), F.col("src").alias("node")), True)

    def member_annotations(self, rel: str) -> DataFrame:
        """(class_name, related, is_direct): annotations on a class's members and theirs, without java.lang.annotation."""
        e = self.cat.rel(rel)
        via = e.join(self.closure("class_ann").select(F.col("root").alias("dst"), "node").where(~F.col("node").startswith(JAVA_META)), "dst").select(F.col("src").alias("root"), "node")
        return _flagged(self.cat, _pairs(e, "src", "dst").unionByName(via), _pairs(e, "src", "dst"), False)

    def annotation_instances(self) -> DataFrame:
        """(class_name, annotation, directness, params): 0 on the class itself, 1 inherited, 2 on its annotations.

        An inherited one gives way to one of the same name on the class or a nearer superclass; the annotations of an
        annotation are those on its own declaration, at any distance, and of inherited ones only what is inherited itself.
        """
        a = self.cat.annotations.where("target_kind = 'class'").select(F.col("class_name").alias("node"), "annotation", F.to_json("params").alias("params"))
        direct = a.select(F.col("node").alias("class_name"), "annotation", F.lit(0).alias("directness"), "params")
        inherit = self.inherited().withColumnRenamed("node", "annotation")
        near = self.up().join(a.join(inherit, "annotation", "left_semi"), "node").select(F.col("root").alias("class_name"), "annotation", "depth", "params")
        nearest = near.groupBy("class_name", "annotation").agg(F.min("depth").alias("depth"))
        above = near.join(nearest, ["class_name", "annotation", "depth"]).join(direct.select("class_name", "annotation").distinct(), ["class_name", "annotation"], "left_anti")
        above = above.select("class_name", "annotation", F.lit(1).alias("directness"), "params")
        base = direct.unionByName(above).select("class_name", F.col("annotation").alias("via"), "directness").distinct()
        # What carries a meta-annotation: the annotation itself, or one on it at any distance.
        step = self.closure("class_ann").where(~F.col("node").startswith(JAVA_META)).select(F.col("root").alias("via"), F.col("node").alias("carrier"))
        carriers = base.select("class_name", F.col("via").alias("carrier"), "directness").unionByName(base.join(step, "via").select("class_name", "carrier", "directness"))
        carries = self.cat.rel("class_ann").where(~F.col("dst").startswith(JAVA_META)).select(F.col("src").alias("carrier"), F.col("dst").alias("annotation"))
        marks = inherit.withColumn("passes", F.lit(True))
        found = carriers.join(carries, "carrier").join(marks, "annotation", "left").where((F.col("directness") == 0) | F.col("passes")).select("class_name", "carrier", "annotation").distinct()
        new = found.join(direct.unionByName(above).select("class_name", "annotation").distinct(), ["class_name", "annotation"], "left_anti")
        metas = new.join(a.withColumnRenamed("node", "carrier"), ["carrier", "annotation"], "left")
        return direct.unionByName(above).unionByName(metas.select("class_name", "annotation", F.lit(2).alias("directness"), "params")).distinct()

    # packages

    def package_tree(self) -> DataFrame:
        """(package_name, n_classes, n_in_subtree): each package and parent package of a visible class."""
        own = self.cat.classes.where(self.cat.scope.visible()).groupBy("package_name").agg(F.count(F.lit(1)).alias("n"))
        parts = F.split("package_name", r"\.")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
        up = own.select(F.explode(F.when(F.col("package_name") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), heads))).alias("p"), "package_name", "n")
        return up.groupBy(F.col("p").alias("package_name")).agg(
            F.sum(F.when(F.col("p") == F.col("package_name"), F.col("n")).otherwise(0)).alias("n_classes"), F.sum("n").alias("n_in_subtree")
        )


# Set operations over (class_name, is_direct) answers.


def union(*answers: DataFrame) -> DataFrame:
    """Names of any answer; direct if direct in one."""
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out.groupBy("class_name").agg(F.max("is_direct").alias("is_direct"))


def intersect(*answers: DataFrame) -> DataFrame:
    """Names of all answers; direct if direct in all."""
    out = union(answers[0])
    for a in answers[1:]:
        out = out.join(union(a).withColumnRenamed("is_direct", "d"), "class_name").select("class_name", (F.col("is_direct") & F.col("d")).alias("is_direct"))
    return out


def exclude(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names of the left answer that the right doesn't reach; a direct one stays direct unless direct on the right."""
    return union(left).join(right, "class_name", "left_anti")


def direct_only(answer: DataFrame) -> DataFrame:
    return answer.where("is_direct")


def with_all(carriers: DataFrame, annotations: list[str]) -> DataFrame:
    """(class_name) of (class_name = annotation, related = carrier) rows: carriers of every annotation; none for no annotation."""
    hit = carriers.where(F.col("class_name").isin(*annotations) if annotations else F.lit(False))
    return hit.groupBy(F.col("related").alias("class_name")).agg(F.count_distinct("class_name").alias("n")).where(F.col("n") == len(set(annotations))).select("class_name")


def with_any(carriers: DataFrame, annotations: list[str]) -> DataFrame:
    return carriers.where(F.col("class_name").isin(*annotations) if annotations else F.lit(False)).select(F.col("related").alias("class_name")).distinct()
