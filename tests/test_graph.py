"""Type hierarchy, meta-annotations on circles, overriding and inheritance on small literal graphs."""

from __future__ import annotations

import pytest

from bytegrove.catalog import Catalog, Scope
from bytegrove.operators import relations as R
from bytegrove.operators.dependencies import dependencies, dependency_map
from bytegrove.operators.members import Members, params_over_defaults, unwrap_repeatable
from bytegrove.operators.relations import Relations
from bytegrove.operators.resources import dedupe_elements, element_order, mask_classes, mask_same_file, outside_nested_roots
from bytegrove.sinks.dot import DotOptions, type_graph, dependency_graph, graph_edges, html_escape, write_dot

CLASSES = (
    "class_name string, modifiers int, is_record boolean, is_external boolean, inherited_meta boolean, cp_idx int, resource_path string, package_name string, module_name string, type_signature string, scanned_at timestamp"
)
EDGES = "rel string, src string, dst string, ord int, nonprivate boolean"
METHODS = "class_name string, ord int, name string, descriptor string, signature string, modifiers int, has_body boolean, min_line int, max_line int, thrown array<string>"
FIELDS = "class_name string, ord int, name string, descriptor string, signature string, modifiers int, const_json string"
ANNS = "ann_id bigint, target_kind string, class_name string, member_ord int, param_idx int, ord int, annotation string, visible boolean, params array<struct<name:string,value_json:string>>"


def catalog(spark, names, edges, methods=(), fields=(), anns=(), scope=Scope()):
    """names: {class: modifiers} or {class: (modifiers, inherited)}; edges: {rel: {src: [dst]}}."""
    rows = []
    for n, m in names.items():
        m, inherited = m if isinstance(m, tuple) else (m, False)
        rows.append((n, m, False, False, inherited, 0, n.replace(".", "/") + ".class", None, None, None, None))
    es = [(rel, s, d, i, True) for rel, by in edges.items() for s, ds in by.items() for i, d in enumerate(ds)]
    return Catalog(
        spark.createDataFrame(rows + rows[:1], CLASSES), spark.createDataFrame(es + es[:1] + [("extends", None, "x", 0, None), ("extends", "x", " ", 0, None)], EDGES),
        spark.createDataFrame(list(methods), METHODS), spark.createDataFrame(list(fields), FIELDS), spark.createDataFrame(list(anns), ANNS), scope=scope,
    )


def answer(df, name, direct=False):
    rows = df.where(df.class_name == name).collect()
    return {r.related for r in rows if not direct or r.is_direct}


@pytest.fixture(scope="module")
def types(spark):
    ext = {"ClsSub": ["Cls"], "ClsSubSub": ["ClsSub"], "Impl1Sub": ["Impl1"], "Impl1SubSub": ["Impl1Sub"], "Impl2Sub": ["Impl2"], "Impl2SubSub": ["Impl2Sub"], "Accepted": ["rej.Super"], "rej.Sub": ["Accepted"]}
    std = ["Cls", "ClsSub", "ClsSubSub", "Impl1", "Impl1Sub", "Impl1SubSub", "Impl2", "Impl2Sub", "Impl2SubSub", "Accepted"]
    for c in ("Cls", "Impl1", "Impl2"):
        ext[c] = ["java.lang.Object"]
    ext["rej.Super"] = ["java.lang.Object"]
    imp = {"IfaceSub": ["Iface"], "IfaceSubSub": ["IfaceSub"], "Impl1": ["IfaceSubSub"], "Impl2": ["Iface"], "Impl2SubSub": ["IfaceSubSub"], "Accepted": ["rej.Iface"], "AcceptedIface": ["rej.Iface"], "rej.SubIface": ["AcceptedIface"]}
    names = dict.fromkeys(std, 1) | dict.fromkeys(["Iface", "IfaceSub", "IfaceSubSub", "AcceptedIface"], 0x601)
    return names, {"extends": ext, "implements": imp}


def test_type_hierarchy(spark, types):
    r = Relations(catalog(spark, *types))
    sub = r.scratch.save(r.subclasses())
    assert answer(sub, "Impl1") == {"Impl1Sub", "Impl1SubSub"} and answer(sub, "Impl1", True) == {"Impl1Sub"}
    assert answer(sub, "Accepted") == set() and "Impl2SubSub" in answer(sub, "java.lang.Object")
    assert answer(r.superclasses(), "ClsSubSub") == {"ClsSub", "Cls", "java.lang.Object"}
    up = [x.related for x in r.superclasses().where("class_name = 'Accepted'").orderBy("rank").collect()]
    assert up == ["rej.Super", "java.lang.Object"]
    itf = r.scratch.save(r.superinterfaces().drop("branch", "rank"))
    assert answer(itf, "Impl2SubSub") == {"IfaceSubSub", "IfaceSub", "Iface"} and answer(itf, "Impl2SubSub", True) == {"IfaceSubSub"}
    impl = r.implementing()
    assert answer(impl, "Iface", True) == {"IfaceSub", "Impl2"}
    assert answer(impl, "Iface") == {"Impl1", "Impl1Sub", "Impl1SubSub", "Impl2", "Impl2Sub", "Impl2SubSub", "IfaceSub", "IfaceSubSub"}
    assert answer(impl, "IfaceSub") >= {"Impl1", "Impl2SubSub"} and not answer(impl, "IfaceSub") & {"Impl2", "Impl2Sub"}
    assert answer(r.subinterfaces(), "Iface") == {"IfaceSub", "IfaceSubSub"} and answer(r.subinterfaces(), "Iface", True) == {"IfaceSub"}
    assert answer(impl, "AcceptedIface") == set()


def test_rejected_packages_hide_even_upwards(spark, types):
    r = Relations(catalog(spark, *types, scope=Scope(reject_packages=("rej",))))
    assert answer(r.superclasses(), "Accepted") == {"java.lang.Object"}


def test_scope_guards(spark, types):
    c = catalog(spark, *types, scope=Scope(reads=frozenset({"class"})))
    with pytest.raises(ValueError):
        c.methods  # noqa: B018


META = {"A": ["F"], "B": ["E", "F"], "C": ["G"], "E": ["I", "J"], "F": ["J"], "H": ["K", "I"], "I": ["L", "H"], "K": ["D"]}


@pytest.fixture(scope="module")
def meta(spark):
    anns = {x: v + ["java.lang.annotation.Target", "java.lang.annotation.Retention"] for x in "DEFGHIJKL" for v in [META.get(x, [])]}
    return catalog(spark, dict.fromkeys("ABC", 1) | dict.fromkeys("DEFGHIJKL", 0x2600), {"class_ann": {k: v for k, v in META.items() if k in "ABC"} | anns})


def test_meta_annotations_on_circles(spark, meta):
    r = Relations(meta)
    w = r.scratch.save(r.with_annotation())
    assert answer(w, "J") == set("FEBA") and answer(w, "L") == set("IEBH") and answer(w, "I") == set("EBHI")
    assert [answer(w, x, True) for x in "EFGHIKD"] == [set("B"), set("AB"), set("C"), set("I"), set("EH"), set("H"), set("K")]
    a = r.scratch.save(r.annotations())
    assert answer(a, "H", True) == {"I", "K", "java.lang.annotation.Retention", "java.lang.annotation.Target"}
    assert answer(a, "A") == {"J", "F"} and answer(a, "C") == {"G"}
    one = {x: w.where(w.class_name == x).selectExpr("related as class_name", "is_direct") for x in "IJG"}
    names = lambda df: {x.class_name for x in df.collect()}
    assert names(R.union(one["I"], one["J"])) == set("ABFEHI") and names(R.direct_only(R.union(one["I"], one["J"]))) == set("FEH")
    assert names(R.direct_only(R.union(one["J"], one["G"]))) == set("EFC")
    assert names(R.intersect(one["I"], one["J"])) == set("EB") and names(R.direct_only(R.intersect(one["I"], one["J"]))) == set("E")
    assert names(R.exclude(one["J"], one["I"])) == set("AF")
    assert {x[0] for x in R.with_all(w, ["I", "J"]).collect()} == set("EB") and R.with_all(w, []).count() == 0 == R.with_any(w, []).count()
    inst = {(x.annotation, x.directness) for x in r.annotation_instances().where("class_name = 'A'").collect()}
    assert inst == set() or ("F", 0) in inst


def m(cls, ord_, name, desc, mods=1):
    return (cls, ord_, name, desc, None, mods, True, 1, 2, [])


def test_overriding_and_inheritance(spark):
    names = {"A": 0x401, "B": 0x401, "C": 0x401, "Normal": 0x2600, "Inh": (0x2600, True), "InhMeta": (0x2600, True), "NonInhMeta": 0x2600}
    edges = {"extends": {"A": ["java.lang.Object"], "B": ["A"], "C": ["A"]}, "class_ann": {"A": ["Normal", "Inh"], "C": ["Normal"], "Inh": ["InhMeta", "NonInhMeta"]}, "method_ann": {"A": ["Inh"]}}
    methods = [m("A", 0, "<init>", "()V"), m("A", 1, "y", "(II)V", 0x401), m("A", 2, "y", "(LS;)V"), m("A", 3, "y", "(LI;)V"), m("A", 4, "w", "()V"), m("A", 5, "<clinit>", "()V", 8), m("B", 0, "<init>", "()V"), m("B", 1, "y", "(II)V"), m("B", 2, "w", "()V"), m("B", 2, "w", "()V")]
    fields = [("A", 0, "x", "F", None, 1, None), ("A", 1, "z", "LS;", None, 1, None), ("B", 0, "x", "I", None, 1, None)]
    anns = [(1, "class", "A", None, None, 0, "Normal", True, []), (2, "class", "A", None, None, 1, "Inh", True, []), (3, "class", "C", None, None, 0, "Normal", True, []), (3, "class", "C", None, None, 0, "Normal", True, []), (4, "method", "A", 4, None, 0, "Inh", True, [])]
    cat = catalog(spark, names, edges, methods, fields, anns)
    mem = Members(cat)
    got = {(x.name, x.descriptor, x.declared_in) for x in mem.methods().where("class_name = 'B'").collect()}
    assert got == {("<init>", "()V", "B"), ("y", "(II)V", "B"), ("w", "()V", "B"), ("y", "(LS;)V", "A"), ("y", "(LI;)V", "A")}
    f = {(x.name, x.descriptor, x.declared_in) for x in mem.fields().where("class_name = 'B'").collect()}
    assert f == {("x", "I", "B"), ("z", "LS;", "A")}
    assert {(x.name, x.n) for x in mem.overloads().where("class_name = 'A'").collect()} >= {("y", 3), ("w", 1)}
    assert "y" not in {x.name for x in mem.single().where("class_name = 'A'").collect()}
    a = mem.rel.scratch.save(mem.rel.annotations())
    assert answer(a, "A") == {"Normal", "Inh", "InhMeta", "NonInhMeta"} and answer(a, "B") == {"Inh", "InhMeta"} and answer(a, "B", True) == set()
    inst = {(x.class_name, x.annotation, x.directness) for x in mem.rel.annotation_instances().collect()}
    assert {("A", "Normal", 0), ("A", "Inh", 0), ("A", "InhMeta", 2), ("A", "NonInhMeta", 2), ("B", "Inh", 1), ("B", "InhMeta", 2), ("C", "Normal", 0), ("C", "Inh", 1)} <= inst
    assert ("B", "NonInhMeta", 2) not in inst
    w = mem.rel.scratch.save(mem.rel.with_member_annotation("method_ann"))
    assert answer(w, "Inh") == {"A", "B", "C"} and answer(w, "InhMeta") == {"A", "B", "C"} and answer(w, "Inh", True) == {"A"}


def test_sub_interface_methods_come_first(spark):
    names = {"Top": 0x601, "Low": 0x601, "Impl": 1}
    edges = {"implements": {"Low": ["Top"], "Impl": ["Top", "Low"]}}
    got = Members(catalog(spark, names, edges, [m("Top", 0, "f", "()V"), m("Low", 0, "f", "()V")])).methods().where("class_name = 'Impl'").collect()
    assert [x.declared_in for x in got] == ["Low"]


def test_params_and_containers(spark):
    inst = spark.createDataFrame([(1, "A", [("b", "2")]), (2, "A", []), (3, "Z", [("q", "9")])], "ann_id int, annotation string, params array<struct<name:string,value_json:string>>")
    dft = spark.createDataFrame([("A", 0, "a", "1"), ("A", 1, "b", "0"), ("A", 2, "c", None)], "annotation string, ord int, name string, value_json string")
    got = {(x.ann_id, x.name, x.value_json, x.is_default) for x in params_over_defaults(inst, dft).collect()}
    assert got == {(1, "a", "1", True), (1, "b", "2", False), (2, "a", "1", True), (2, "b", "0", True), (3, "q", "9", False)}
    box = '{"t":"[","v":[{"annotation":"A","params":[{"name":"v","value_json":"1"}]},{"annotation":"A","params":[]}]}'
    rows = spark.createDataFrame([(1, "As", [("value", box)]), (2, "B", [])], inst.schema)
    out = unwrap_repeatable(rows, spark.createDataFrame([("As", "A")], "container string, component string"))
    assert sorted((x.ann_id, x.annotation, x.sub_ord) for x in out.collect()) == [(1, "A", 0), (1, "A", 1), (2, "B", 0)]


def test_resources(spark):
    r = spark.createDataFrame([(0, "a/B.class"), (1, "a/B.CLASS"), (1, "a/x.txt"), (2, "a/x.txt"), (0, "module-info.class"), (1, "module-info.class"), (None, "a/B.class")], "cp_idx int, path string")
    assert {(x.cp_idx, x.path) for x in mask_classes(r).where("masked").collect()} == {(1, "a/B.CLASS"), (None, "a/B.class")}
    s = spark.createDataFrame([(0, "p", "f"), (1, "p", "f"), (1, "q", "f"), (2, "p", None), (3, "p", None)], "cp_idx int, path string, file_key string")
    assert mask_same_file(s).count() == 4
    e = spark.createDataFrame([(0, "/a"), (1, "/a"), (2, None), (3, None)], "cp_idx int, file string")
    assert sorted(x.cp_idx for x in dedupe_elements(e).collect()) == [0, 2, 3]
    ents = spark.createDataFrame([(0, "lib/x/a"), (0, "lib/xy/a"), (1, "lib/x/a"), (0, "lib/x")], "cp_idx int, path string")
    roots = spark.createDataFrame([(0, "lib/x/")], "cp_idx int, prefix string")
    assert {tuple(x) for x in outside_nested_roots(ents, roots).collect()} == {(0, "lib/xy/a"), (1, "lib/x/a"), (0, "lib/x")}
    el = spark.createDataFrame([(0, "zip", None, None), (1, "zip", 0, 2), (2, "zip", 0, 1), (3, "module", None, None), (4, "zip", 9, 0), (5, "zip", 6, 0), (6, "zip", 5, 0)], "cp_idx int, kind string, parent_idx int, idx_in_parent int")
    # Elements on a circle hang from nothing and come last; none is lost.
    assert [x.cp_idx for x in element_order(el).orderBy("position").collect()] == [3, 0, 2, 1, 4, 5, 6]


def test_dot(spark, tmp_path):
    names = {"f.Circle": 1, "f.ShapeImpl": 1, "f.Shape": 0x601, "f.UIWidget": 0x2600}
    edges = {"extends": {"f.Circle": ["f.ShapeImpl"], "f.ShapeImpl": ["java.lang.Object"]}, "implements": {"f.ShapeImpl": ["f.Shape"]}, "class_ann": {"f.Circle": ["f.UIWidget", "java.lang.annotation.Target"]}}
    cat = catalog(spark, names, edges, [m("f.Circle", 0, "of", "(Lf/Shape;)V"), m("f.Circle", 1, "toString", "()Ljava/lang/String;")], [("f.ShapeImpl", 0, "next", "Lf/Circle;", None, 2, None)], [(1, "class", "f.Circle", None, None, 0, "f.UIWidget", True, [])])
    assert {tuple(x) for x in graph_edges(cat).collect()} == {("f.Circle", "f.ShapeImpl", "extends"), ("f.ShapeImpl", "f.Shape", "implements"), ("f.Circle", "f.UIWidget", "class_ann"), ("f.Circle", "f.Shape", "method_type"), ("f.ShapeImpl", "f.Circle", "field_type")}
    n = write_dot(type_graph(cat), str(tmp_path / "g.dot"))
    text = (tmp_path / "g.dot").read_text()
    assert n == 4 + 5 and text.startswith("digraph") and '"f.Shape" [shape=diamond' in text and '"f.UIWidget" [shape=oval' in text and "toString" not in text
    assert graph_edges(cat, DotOptions(method_edges=False, field_edges=False, annotation_edges=False)).count() == 2
    deps = dependencies(cat)
    assert write_dot(dependency_graph(cat, deps), str(tmp_path / "d.dot")) > 0
    assert {x.class_name: x.n for x in dependency_map(deps, reverse=True).collect()}["f.Shape"] == 2
    got = spark.createDataFrame([("<a & b>\n\u00a0\\",)], "v string").select(html_escape("v")).first()[0]
    assert got == "&lt;a &amp; b&gt; &nbsp;&#x5C;"


def test_member_orders_by_hand():
    """All interfaces of a class, those of its superclasses too, come before the superclass for fields; for methods the
    topmost class's interfaces come first, and an interface goes before one that it extends."""
    from bytegrove.operators.members import field_order, method_order

    links = {"B": ["I"], "C": ["K"], "J": ["I"], "K": ["J", "L"]}
    assert field_order("C", ["B"], links) == ["C", "K", "J", "I", "L", "B"]
    assert method_order("C", ["B"], links, {"I", "J", "K", "L"}) == ["C", "B", "K", "J", "I", "L"]
    assert method_order("K", [], links, {"I", "J", "K", "L"}) == ["K", "J", "I", "L"]
    assert field_order("B", [], {"B": ["I"], "I": ["B"]}) == ["B", "I"]  # a circle ends


def test_a_field_of_a_superclass_interface_hides_that_of_the_superclass(spark):
    from bytegrove.catalog import Catalog
    from bytegrove.operators.members import Members

    classes = spark.createDataFrame(
        [(n, m) for n, m in (("C", 1), ("B", 1), ("I", 0x601))], "class_name string, modifiers int"
    ).selectExpr(
        "class_name", "modifiers", "false is_record", "false is_external", "false inherited_meta", "0 cp_idx", "cast(null as string) resource_path", "'' package_name", "cast(null as string) module_name",
        "cast(null as string) type_signature", "cast(null as timestamp) scanned_at",
    )
    edges = spark.createDataFrame([("extends", "C", "B", 0, None), ("implements", "B", "I", 0, None), ("extends", "I", "java.lang.Object", 0, None)], "rel string, src string, dst string, ord int, nonprivate boolean")
    fields = spark.createDataFrame([("B", 0, "X", "I", 1), ("I", 0, "X", "J", 1)], "class_name string, ord int, name string, descriptor string, modifiers int").selectExpr("*", "cast(null as string) const_json")
    methods = spark.createDataFrame([("B", 0, "f", "()V", 1), ("I", 0, "f", "()V", 1)], "class_name string, ord int, name string, descriptor string, modifiers int").selectExpr(
        "*", "true has_body", "cast(null as array<string>) thrown", "cast(null as string) signature", "0 min_line", "0 max_line"
    )
    m = Members(Catalog(classes, edges, methods, fields))
    assert {(r.class_name, r.declared_in) for r in m.fields().collect()} == {("C", "I"), ("B", "B"), ("I", "I")}
    assert {(r.class_name, r.declared_in) for r in m.methods().collect()} == {("C", "B"), ("B", "B"), ("I", "I")}
    assert m.cat.rel("extends").collect() == [("C", "B")]
