"""Questions by name over one catalog.

The closures behind the answers are computed for all classes at the first question that needs them and written to the
scratch folder, so each further question is a filter that reaches the scan. Answers about classes have ``class_name`` and,
where the question has direct relatives, ``is_direct``; order by ``class_name``, or by ``rank`` where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bytegrove.catalog import Catalog
from bytegrove.functions import modifiers as M
from bytegrove.operators import relations as R
from bytegrove.operators.dependencies import dependencies, dependency_map
from bytegrove.operators.members import Members
from bytegrove.operators.relations import Relations

MEMBER_RELATIONS = {"method": "method_ann", "param": "method_param_ann", "field": "field_ann"}


class Graph:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.relations = Relations(catalog)
        self._members = Members(catalog, self.relations)

    def _of(self, name: str, make, direct: bool = False) -> DataFrame:
        key = "answer_" + "_".join(str(x) for x in make) if isinstance(make, tuple) else "answer_" + make
        method, args = (make[0], make[1:]) if isinstance(make, tuple) else (make, ())
        answer = self.relations._keep(key, lambda: getattr(self.relations, method)(*args)).where(F.col("class_name") == name).drop("class_name").withColumnRenamed("related", "class_name")
        return answer.where("is_direct") if direct else answer

    # lists of classes

    def class_info(self, name: str) -> DataFrame:
        """The row of a class, external ones included."""
        return self.catalog.classes.where(F.col("class_name") == name)

    def classes(self, kind: str = "all") -> DataFrame:
        """Visible classes of a kind: all, standard, interface, interface_or_annotation, annotation, enum, record."""
        test = {
            "all": F.lit(True), "standard": M.is_standard(), "interface": M.is_interface(), "interface_or_annotation": M.is_interface_or_annotation(),
            "annotation": M.is_annotation(), "enum": M.has(M.ENUM) & M.is_standard(), "record": F.col("is_record"),
        }[kind]
        return self.catalog.classes.where(self.catalog.scope.visible()).where(test)

    # relatives

    def subclasses(self, name: str, direct: bool = False) -> DataFrame:
        return self._of(name, "subclasses", direct)

    def superclasses(self, name: str) -> DataFrame:
        return self._of(name, "superclasses")

    def superclass(self, name: str) -> str | None:
        """The superclass, None without one; several are an error."""
        row = self._of(name, "superclass").first()
        if row is not None and row.n > 1:
            raise ValueError(f"{name} has {row.n} superclasses")
        return row.superclass if row else None

    def superinterfaces(self, name: str, direct: bool = False) -> DataFrame:
        return self._of(name, "superinterfaces", direct)

    def implementing(self, name: str, direct: bool = False) -> DataFrame:
        return self._of(name, "implementing", direct)

    def subinterfaces(self, name: str, direct: bool = False) -> DataFrame:
        return self._of(name, "subinterfaces", direct)

    def assignable_to(self, name: str) -> DataFrame:
        """Subclasses, implementing classes and the class itself; nothing for an unknown name."""
        own = self.class_info(name).select("class_name")
        return own.unionByName(self.subclasses(name).select("class_name")).unionByName(self.implementing(name).select("class_name")).distinct()

    def outer_classes(self, name: str) -> DataFrame:
        return self._of(name, "outer")

    def inner_classes(self, name: str) -> DataFrame:
        return self._of(name, "inner")

    # annotations

    def with_annotation(self, name: str, direct: bool = False) -> DataFrame:
        return self._of(name, "with_annotation", direct)

    def with_all_annotations(self, *names: str) -> DataFrame:
        return R.with_all(self.relations._keep("answer_with_annotation", self.relations.with_annotation), list(names))

    def with_any_annotation(self, *names: str) -> DataFrame:
        return R.with_any(self.relations._keep("answer_with_annotation", self.relations.with_annotation), list(names))

    def with_member_annotation(self, name: str, member: str, direct: bool = False) -> DataFrame:
        """Classes by an annotation on a ``method``, ``param`` or ``field``."""
        self.catalog.scope.need("annotation", "field" if member == "field" else "method")
        return self._of(name, ("with_member_annotation", MEMBER_RELATIONS[member]), direct)

    def annotations(self, name: str, direct: bool = False) -> DataFrame:
        return self._of(name, "annotations", direct)

    def member_annotations(self, name: str, member: str, direct: bool = False) -> DataFrame:
        return self._of(name, ("member_annotations", MEMBER_RELATIONS[member]), direct)

    def annotation_instances(self, name: str) -> DataFrame:
        return self.relations._keep("answer_instances", self.relations.annotation_instances).where(F.col("class_name") == name)

    # members

    def methods(self, name: str, declared: bool = False) -> DataFrame:
        """Methods and constructors after overriding, or as declared; never static initialisers."""
        if declared:
            return self.catalog.methods.where((F.col("class_name") == name) & (F.col("name") != "<clinit>"))
        return self.relations._keep("answer_methods", self._members.methods).where(F.col("class_name") == name)

    def constructors(self, name: str) -> DataFrame:
        return self.catalog.methods.where((F.col("class_name") == name) & (F.col("name") == "<init>"))

    def fields(self, name: str, declared: bool = False) -> DataFrame:
        if declared:
            return self.catalog.fields.where(F.col("class_name") == name)
        return self.relations._keep("answer_fields", self._members.fields).where(F.col("class_name") == name)

    # packages and dependencies

    def packages(self) -> DataFrame:
        return self.relations.package_tree()

    def package_classes(self, package: str, recursive: bool = False) -> DataFrame:
        """Visible classes of a package, with ``recursive`` of those below it too."""
        p = F.col("package_name")
        inside = (p == package) | (F.lit(package == "") if recursive else F.lit(False))
        return self.classes().where(inside | p.startswith(package + ".") if recursive else inside)

    def dependencies(self, class_refs: DataFrame | None = None) -> DataFrame:
        self.catalog.scope.need("refs")
        return self.relations._keep("answer_dependencies", lambda: dependencies(self.catalog, class_refs, self._members))

    def dependency_map(self, reverse: bool = False) -> DataFrame:
        return dependency_map(self.dependencies(), reverse)
