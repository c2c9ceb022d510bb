"""Questions of the form "has this class ...", each for all classes at once: (class_name) of those that have."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bytegrove.catalog import OBJECT
from bytegrove.functions.modifiers import is_standard
from bytegrove.operators.members import Members
from bytegrove.operators.relations import JAVA_META

MEMBER_RELATIONS = {"field": "field_ann", "method": "method_ann", "param": "method_param_ann"}


class Predicates:
    """Over one catalog; what several questions need is written once."""

    def __init__(self, members: Members):
        self.members, self.rel, self.cat = members, members.rel, members.cat

    def extends_superclass(self, name: str) -> DataFrame:
        if name == OBJECT:
            return self.cat.classes.where(is_standard() & (F.col("class_name") != OBJECT)).select("class_name")
        return self.rel.up().where(F.col("node") == name).select(F.col("root").alias("class_name")).distinct()

    def implements_interface(self, name: str) -> DataFrame:
        above = self.rel._keep("superinterfaces", self.rel.superinterfaces)
        return above.where(F.col("related") == name).select("class_name").distinct()

    def has_annotation(self, name: str) -> DataFrame:
        return self.rel._keep("annotations", self.rel.annotations).where(F.col("related") == name).select("class_name").distinct()

    def has_declared_method(self, name: str) -> DataFrame:
        return self.cat.methods.where(F.col("name") == name).select("class_name").distinct()

    def has_method(self, name: str) -> DataFrame:
        return self.rel._keep("resolved_methods", self.members.methods).where(F.col("name") == name).select("class_name").distinct()

    def has_declared_field(self, name: str) -> DataFrame:
        return self.cat.fields.where(F.col("name") == name).select("class_name").distinct()

    def has_field(self, name: str) -> DataFrame:
        return self.rel._keep("resolved_fields", self.members.fields).where(F.col("name") == name).select("class_name").distinct()

    def has_declared_member_annotation(self, member: str, name: str) -> DataFrame:
        """``member`` is field, method or param; annotations on annotations count, but for those of java.lang.annotation."""
        e = self.cat.rel(MEMBER_RELATIONS[member])
        metas = self.rel.closure("class_ann").where((F.col("node") == name) & ~F.col("node").startswith(JAVA_META)).select(F.col("root").alias("dst"))
        wanted = metas.unionByName(self.cat.spark.createDataFrame([(name,)], "dst string")).distinct()
        return e.join(wanted, "dst", "left_semi").select(F.col("src").alias("class_name")).distinct()

    def has_member_annotation(self, member: str, name: str) -> DataFrame:
        """On a member of the class or of any class or interface that its members are looked for in."""
        declared = self.has_declared_member_annotation(member, name).withColumnRenamed("class_name", "node")
        return self.members.orders().select("root", "node").join(declared, "node", "left_semi").select(F.col("root").alias("class_name")).distinct()
