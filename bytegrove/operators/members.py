"""Members after override resolution, and what hangs on them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bytegrove.catalog import Catalog
from bytegrove.functions.modifiers import is_interface_or_annotation
from bytegrove.operators.relations import Relations
from bytegrove.operators.skew import lookup_join

_ORDERS = pa.schema([("root", pa.string()), ("node", pa.string()), ("field_pos", pa.int32()), ("method_pos", pa.int32())])


def _reach(starts: list[str], links: dict[str, list[str]]) -> list[str]:
    """Names reachable from some, these first, breadth first."""
    out = list(dict.fromkeys(starts))
    seen = set(out)
    for name in out:  # grows as it is read
        for x in links.get(name, ()):
            if x not in seen:
                seen.add(x)
                out.append(x)
    return out


def field_order(root: str, supers: list[str], links: dict[str, list[str]]) -> list[str]:
    """The class, then all interfaces of it and of its superclasses, each followed by its own, then the superclasses."""
    out: dict[str, None] = {root: None}
    todo = [x for level in reversed([root, *supers]) for x in reversed(_reach(links.get(level, []), links))]
    while todo:
        name = todo.pop()
        if name not in out:
            out[name] = None
            todo.extend(reversed(_reach(links.get(name, []), links)))
    out.update(dict.fromkeys(supers))
    return list(out)


def method_order(root: str, supers: list[str], links: dict[str, list[str]], interfaces: set[str]) -> list[str]:
    """Classes first, nearest first, then interfaces, those of the topmost class first; an interface that extends some
    that are there already goes before them."""
    chain = [c for c in [root, *supers] if c not in interfaces]
    out, seen = list(chain), set(chain)
    todo = [root] if root in interfaces else [x for level in [root, *supers] for x in reversed(_reach(links.get(level, []), links))]
    if root not in interfaces:
        todo = todo + [x for x in reversed(supers) if x in interfaces]
    while todo:
        name = todo.pop()
        if name in seen:
            continue
        seen.add(name)
        above = _reach(links.get(name, []), links)
        at = min((out.index(x) for x in above if x in seen and x in out), default=len(out))
        out.insert(at, name)
        todo.extend(reversed(above))
    return out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for root, line in zip(*(c.to_pylist() for c in batch.columns)):
            supers = [x["node"] for x in line if x["depth"]]
            links: dict[str, list[str]] = {}
            for src, _, dst in sorted({(e["src"], e["rank"], e["dst"]) for x in line for e in x["links"] or ()}):
                links.setdefault(src, []).append(dst)
            interfaces = {x["node"] for x in line if x["itf"]} | {d for ds in links.values() for d in ds}
            fields = {n: i for i, n in enumerate(field_order(root, supers, links))}
            methods = method_order(root, supers, links, interfaces)
            rows.extend((root, n, fields.get(n), i) for i, n in enumerate(methods))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ORDERS)], schema=_ORDERS)


class Members:
    def __init__(self, cat: Catalog, relations: Relations | None = None):
        self.rel = relations or Relations(cat)
        self.cat = self.rel.cat

    def orders(self) -> DataFrame:
        """(root, node, field_pos, method_pos): each class with itself and all above it, in the order that members of one
        name are looked for; superclasses come nearest first, interfaces in the order they are declared.

        A row per class holds its superclasses and the interface links among all above it: as much as its ancestry.
        """
        return self.rel._keep("orders", self._make_orders)

    def _make_orders(self) -> DataFrame:
        e = self.cat.edges.where("rel = 'implements'").select("src", "dst", F.coalesce("ord", F.lit(1 << 30)).alias("ord"))
        ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst")))
        link = ranked.select(F.col("src").alias("node"), F.struct("src", "rank", "dst").alias("link"))
        among = self.rel.closure("implements").select("root", "node").join(link, "node").select(F.col("root").alias("node"), "link")
        own = link.unionByName(among).groupBy("node").agg(F.collect_set("link").alias("links"))
        kinds = self.cat.classes.select(F.col("class_name").alias("node"), is_interface_or_annotation().alias("itf"))
        about = kinds.join(own, "node", "left").where(F.col("itf") | F.col("links").isNotNull())
        line = self.cat.classes.select(F.col("class_name").alias("root"), F.col("class_name").alias("node"), F.lit(0).alias("depth")).unionByName(
            self.rel.up().where("root <> node").select("root", "node", "depth")
        )
        line = self.rel.scratch.save(line, "line")
        full = lookup_join(line, self.rel.scratch.save(about, "about"), "node", "left")
        lines = full.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("depth", "node", F.coalesce("itf", F.lit(False)).alias("itf"), "links"))).alias("line"))
        return lines.mapInArrow(_orders, "root string, node string, field_pos int, method_pos int")

    def methods(self) -> DataFrame:
        """(class_name, name, descriptor, declared_in, modifiers): what a class has after overriding.

        Of equal name and descriptor the first in method order wins. Constructors are the class's own; static initialisers
        are left out.
        """
        m = self.cat.methods.where("name <> '<clinit>'").select(F.col("class_name").alias("node"), "name", "descriptor", "modifiers")
        have = self.orders().select("root", "node", "method_pos").join(m, "node").where((F.col("name") != "<init>") | (F.col("root") == F.col("node")))
        best = F.min(F.struct("method_pos", "node", "modifiers"))
        return have.groupBy("root", "name", "descriptor").agg(best.alias("b")).select(F.col("root").alias("class_name"), "name", "descriptor", F.col("b.node").alias("declared_in"), "b.modifiers")

    def fields(self) -> DataFrame:
        """(class_name, name, descriptor, declared_in): of equal names the first in field order wins."""
        f = self.cat.fields.select(F.col("class_name").alias("node"), "name", "descriptor")
        best = F.min(F.struct("field_pos", "node", "descriptor"))
        have = self.orders().select("root", "node", "field_pos").join(f, "node")
        return have.groupBy("root", "name").agg(best.alias("b")).select(F.col("root").alias("class_name"), "name", "b.descriptor", F.col("b.node").alias("declared_in"))

    def overloads(self) -> DataFrame:
        """(class_name, name, n, descriptors): declared methods by name; descriptors sorted and joined by blanks."""
        return self.cat.methods.groupBy("class_name", "name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("descriptor")), " ").alias("descriptors"))

    def thrown(self) -> DataFrame:
        """(class_name, name, descriptor, pos, thrown): declared exceptions that are known classes."""
        from bytegrove.functions.names import class_name

        t = self.cat.methods.select("class_name", "name", "descriptor", F.posexplode("thrown").alias("pos", "t")).withColumn("thrown", class_name("t")).drop("t")
        return t.join(self.cat.classes.select(F.col("class_name").alias("thrown")), "thrown", "left_semi")

    def single(self) -> DataFrame:
        """(class_name, name, descriptor): methods that are the only one of their name in the class."""
        return self.cat.methods.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("class_name", "name"))).where("n = 1").select("class_name", "name", "descriptor")


def params_over_defaults(instances: DataFrame, defaults: DataFrame) -> DataFrame:
    """(ann_id, name, value_json, is_default): explicit values of (ann_id, annotation, params), the rest from
    (annotation, ord, name, value_json), in the order of the annotation's methods; a parameter without either is left out."""
    given = instances.select("ann_id", "annotation", F.explode("params").alias("p")).select("ann_id", "annotation", "p.name", F.col("p.value_json").alias("given"))
    wanted = instances.select("ann_id", "annotation").join(defaults, "annotation")
    both = wanted.join(given, ["ann_id", "annotation", "name"], "full")
    value = F.coalesce("given", "value_json")
    return both.where(value.isNotNull()).select("ann_id", "name", value.alias("value_json"), F.col("given").isNull().alias("is_default"), "ord")


def containers_of(annotations: DataFrame) -> DataFrame:
    """(container, component) from the components' own java.lang.annotation.Repeatable; of several the smallest component."""
    r = annotations.where("target_kind = 'class' and annotation = 'java.lang.annotation.Repeatable'")
    value = F.expr("get(filter(params, p -> p.name = 'value'), 0).value_json")
    named = F.translate(F.regexp_replace(F.get_json_object(value, "$.v"), "^L|;$", ""), "/", ".")
    return r.select(named.alias("container"), F.col("class_name").alias("component")).where("container is not null").groupBy("container").agg(F.min("component").alias("component"))


def unwrap_repeatable(instances: DataFrame, containers: DataFrame) -> DataFrame:
    """Annotation rows with those of container annotations replaced by their components.

    ``containers`` is (container, component). A container's ``value`` is a JSON array of {"annotation", "params"}; components
    take its place in order, in (.., ord, sub_ord). Containers that hold nothing vanish, other rows keep sub_ord 0.
    """
    marked = instances.join(containers.withColumnRenamed("container", "annotation"), "annotation", "left")
    plain = marked.where("component is null").drop("component").withColumn("sub_ord", F.lit(0))
    value = F.expr("get(filter(params, p -> p.name = 'value'), 0).value_json")
    items = F.from_json(F.get_json_object(value, "$.v"), "array<struct<annotation:string,params:array<struct<name:string,value_json:string>>>>")
    inner = marked.where("component is not null").select("*", F.posexplode(items).alias("sub_ord", "i"))
    return plain.unionByName(inner.withColumn("annotation", F.coalesce("i.annotation", "component")).withColumn("params", F.col("i.params")).drop("i", "component").select(*plain.columns))
