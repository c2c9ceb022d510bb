"""Class graphs and dependency graphs as GraphViz text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bytegrove.catalog import Catalog
from bytegrove.functions.modifiers import is_annotation, is_interface
from bytegrove.functions.names import simple_name
from bytegrove.operators.dependencies import names_in

JAVA_META = "java.lang.annotation."
#: Members that say nothing about a class.
PLAIN_METHODS = (("hashCode", "()I"), ("toString", "()Ljava/lang/String;"), ("equals", "(Ljava/lang/Object;)Z"))


@dataclass(frozen=True)
class DotOptions:
    """What a class graph shows."""

    size_x: float = 10.5
    size_y: float = 8.0
    fields: bool = True
    field_edges: bool = True
    methods: bool = True
    method_edges: bool = True
    annotations: bool = True
    annotation_edges: bool = True
    simple_names: bool = True
    external: bool = False


#: Characters and the HTML entities that stand for them, the ampersand first. Fixed values.
ENTITIES = {
    "&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;", "\\": "&#x5C;", "/": "&#x2F;",
    "\u2014": "&mdash;", "\u2013": "&ndash;", "\u201c": "&ldquo;", "\u201d": "&rdquo;", "\u2018": "&lsquo;", "\u2019": "&rsquo;",
    "\u00ab": "&laquo;", "\u00bb": "&raquo;", "\u00a3": "&pound;", "\u00a9": "&copy;", "\u00ae": "&reg;", "\u00a0": "&nbsp;",
}


def html_escape(c: Column | str) -> Column:
    """Label text safe within HTML-like labels; white space and control characters become blanks."""
    c = F.col(c) if isinstance(c, str) else c
    for raw, safe in ENTITIES.items():
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.regexp_replace(c, r"(?U)[\s\x00-\x1f]", " ")


def _types(df: DataFrame, kind: str) -> DataFrame:
    return df.select(F.col("class_name").alias("src"), F.explode(F.array_distinct(names_in("descriptor"))).alias("dst")).where("src <> dst").select("src", "dst", F.lit(kind).alias("kind"))


def graph_edges(cat: Catalog, options: DotOptions = DotOptions()) -> DataFrame:
    """(src, dst, kind) between visible classes: extends, implements, class_ann, field_ann, method_ann, field_type, method_type.

    Links to java.lang.Object and to annotations of java.lang.annotation are left out.
    """
    kinds = ["extends", "implements"] + (["class_ann", "field_ann", "method_ann"] if options.annotation_edges else [])
    parts = [cat.edges.where(F.col("rel").isin(*kinds)).select("src", "dst", F.col("rel").alias("kind"))]
    if options.field_edges:
        parts.append(_types(cat.fields, "field_type"))
    if options.method_edges:
        parts.append(_types(cat.methods, "method_type"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where((F.col("dst") != "java.lang.Object") & ~F.col("dst").startswith(JAVA_META)).distinct()
    strict = not options.external
    return cat.show(cat.show(out, "src", strict), "dst", strict).select("src", "dst", "kind")


def node_contents(cat: Catalog) -> DataFrame:
    """(class_name, shape, annotations, fields, methods): what a node lists; each list sorted and joined by blanks.

    Without annotations of java.lang.annotation, serialVersionUID, static initialisers and the methods all objects have.
    """
    a = cat.annotations.where((F.col("target_kind") == "class") & ~F.col("annotation").startswith(JAVA_META)).select("class_name", F.lit("a").alias("k"), simple_name("annotation").alias("t"))
    f = cat.fields.where("name <> 'serialVersionUID'").select("class_name", F.lit("f").alias("k"), F.concat_ws(":", "name", "descriptor").alias("t"))
    plain = F.lit(False)
    for name, desc in PLAIN_METHODS:
        plain = plain | ((F.col("name") == name) & (F.col("descriptor") == desc))
    m = cat.methods.where((F.col("name") != "<clinit>") & ~plain).select("class_name", F.lit("m").alias("k"), F.concat("name", "descriptor").alias("t"))
    lists = a.unionByName(f).unionByName(m).distinct().groupBy("class_name").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("t")))), " ").alias(n) for k, n in zip("afm", ("annotations", "fields", "methods"))))
    shape = F.when(is_annotation(), "oval").when(is_interface(), "diamond").otherwise("box")
    none = F.lit("")
    return cat.classes.where(cat.scope.visible()).select("class_name", shape.alias("shape")).join(lists, "class_name", "left").select("class_name", "shape", *(F.coalesce(n, none).alias(n) for n in ("annotations", "fields", "methods")))


_STYLE = {
    "extends": "arrowsize=2.5", "implements": "arrowhead=diamond, arrowsize=2.5", "class_ann": "arrowhead=dot, arrowsize=2.5", "field_ann": "arrowhead=odot, arrowsize=2.5",
    "method_ann": "arrowhead=odot, arrowsize=2.5", "field_type": "arrowhead=obox, style=dashed", "method_type": "arrowhead=obox, style=dotted", "refers": "arrowsize=1",
}


def _quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): DOT statements of (class_name, shape, label) and (src, dst, kind), to be ordered by both columns."""
    style = F.create_map(*(F.lit(x) for kv in _STYLE.items() for x in kv))
    n = nodes.select(F.lit(1).alias("part"), F.concat(_quote(F.col("class_name")), F.lit(" [shape="), "shape", F.lit(", label=<"), "label", F.lit(">];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(_quote(F.col("src")), F.lit(" -> "), _quote(F.col("dst")), F.lit(" ["), style[F.col("kind")], F.lit("];")).alias("line"))
    return n.unionByName(e)


def type_graph(cat: Catalog, options: DotOptions = DotOptions()) -> DataFrame:
    """DOT statements of the class graph; kinds of nodes are boxes, diamonds (interfaces) and ovals (annotations)."""
    c = node_contents(cat)
    name = simple_name("class_name") if options.simple_names else F.col("class_name")
    rows = [html_escape(name)]
    for show, column in ((options.annotations, "annotations"), (options.fields, "fields"), (options.methods, "methods")):
        if show:
            rows.append(F.when(F.col(column) != "", html_escape(column)))
    label = F.concat(F.lit("<table border='0'><tr><td>"), F.concat_ws("</td></tr><tr><td>", *rows), F.lit("</td></tr></table>"))
    return dot_lines(c.select("class_name", "shape", label.alias("label")), graph_edges(cat, options))


def dependency_graph(cat: Catalog, deps: DataFrame) -> DataFrame:
    """DOT statements of (src, dst) references."""
    names = deps.select(F.col("src").alias("class_name")).unionByName(deps.select(F.col("dst").alias("class_name"))).distinct()
    shape = F.when(is_annotation(), "oval").when(is_interface(), "diamond").otherwise("box")
    nodes = names.join(cat.classes, "class_name").select("class_name", shape.alias("shape"), html_escape("class_name").alias("label"))
    return dot_lines(nodes, deps.select("src", "dst", F.lit("refers").alias("kind")))


def write_dot(lines: DataFrame, path: str, options: DotOptions = DotOptions()) -> int:
    """Writes statements as one DOT file, streamed partition by partition in order; gives the number of statements."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'digraph {{\nsize="{options.size_x},{options.size_y}";\nlayout=dot;\nrankdir="BT";\noverlap=false;\nsplines=true;\npack=true;\n')
        for row in lines.orderBy("part", "line").toLocalIterator():
            f.write(row.line + "\n")
            n += 1
        f.write("}\n")
    return n


