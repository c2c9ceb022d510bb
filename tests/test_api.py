from __future__ import annotations

import pytest

from bytegrove.api import Graph
from bytegrove.catalog import Scope
from tests.test_graph import META, catalog, m

NAMES = {"p.Top": 1, "p.Mid": 1, "p.q.Low": 0x4001, "p.I": 0x601, "p.J": 0x601, "p.A": (0x2600, True)}
EDGES = {"extends": {"p.Mid": ["p.Top"], "p.q.Low": ["p.Mid"], "p.Top": ["java.lang.Object"], "two": ["p.Top", "p.Mid"]}, "implements": {"p.J": ["p.I"], "p.Mid": ["p.J"]}, "class_ann": {"p.Top": ["p.A"]}, "method_ann": {"p.Mid": ["p.A"]}, "inner_of": {"p.q.Low": ["p.Mid"], "p.Mid": ["p.Top"]}}


def names(df):
    return sorted(r.class_name for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    methods = [m("p.Top", 0, "f", "()V"), m("p.Mid", 0, "f", "()V"), m("p.Mid", 1, "<init>", "()V"), m("p.Mid", 2, "<clinit>", "()V")]
    fields = [("p.Top", 0, "x", "Lp/q/Low;", None, 1, None)]
    return Graph(catalog(spark, NAMES, EDGES, methods, fields, [(1, "class", "p.Top", None, None, 0, "p.A", True, [])]))


def test_questions_by_name(graph):
    assert names(graph.subclasses("p.Top")) == ["p.Mid", "p.q.Low"] and names(graph.subclasses("p.Top", direct=True)) == ["p.Mid"]
    assert names(graph.superclasses("p.q.Low")) == ["java.lang.Object", "p.Mid", "p.Top"] and graph.superclass("p.Mid") == "p.Top" and graph.superclass("p.I") is None
    with pytest.raises(ValueError):
        graph.superclass("two")
    assert names(graph.superinterfaces("p.q.Low")) == ["p.I", "p.J"] and names(graph.implementing("p.I")) == ["p.J", "p.Mid", "p.q.Low"] and names(graph.subinterfaces("p.I")) == ["p.J"]
    assert names(graph.assignable_to("p.I")) == ["p.I", "p.J", "p.Mid", "p.q.Low"] and names(graph.assignable_to("none")) == []
    assert names(graph.outer_classes("p.q.Low")) == ["p.Mid", "p.Top"] and names(graph.inner_classes("p.Top")) == ["p.Mid", "p.q.Low"]
    assert names(graph.with_annotation("p.A")) == ["p.Mid", "p.Top", "p.q.Low"] == names(graph.with_all_annotations("p.A")) == names(graph.with_any_annotation("p.A", "no"))
    assert names(graph.annotations("p.q.Low")) == ["p.A"] and names(graph.annotations("p.q.Low", direct=True)) == []
    assert names(graph.with_member_annotation("p.A", "method")) == ["p.Mid", "p.q.Low"] and names(graph.member_annotations("p.Mid", "method")) == ["p.A"]
    assert [(r.annotation, r.directness) for r in graph.annotation_instances("p.Mid").collect()] == [("p.A", 1)]


def test_lists_members_packages(graph):
    assert names(graph.classes("interface")) == ["p.I", "p.J"] and names(graph.classes("enum")) == ["p.q.Low"] and names(graph.classes("annotation")) == ["p.A"] and graph.classes("record").count() == 0
    assert len(names(graph.classes("standard"))) == 3 and len(names(graph.classes())) == 6 and graph.class_info("java.lang.Object").first().is_external
    got = {(r.name, r.declared_in) for r in graph.methods("p.q.Low").collect()}
    assert got == {("f", "p.Mid")} and graph.methods("p.Mid", declared=True).count() == 2 and graph.constructors("p.Mid").count() == 1
    assert [r.declared_in for r in graph.fields("p.q.Low").collect()] == ["p.Top"] and graph.fields("p.q.Low", declared=True).count() == 0
    assert len(names(graph.package_classes("p"))) == 5 and len(names(graph.package_classes("p", recursive=True))) == 6 == graph.package_classes("", recursive=True).count()
    assert {r.package_name: r.n_in_subtree for r in graph.packages().collect()} == {"": 6, "p": 6, "p.q": 1}
    assert {("p.Top", "p.q.Low")} <= {tuple(r) for r in graph.dependencies().collect()} and graph.dependency_map(reverse=True).count() > 0


def test_facts_that_were_not_read(spark):
    g = Graph(catalog(spark, dict.fromkeys("ABC", 1), {"class_ann": META}, scope=Scope(reads=frozenset({"class", "annotation"}))))
    for ask in (lambda: g.methods("A"), lambda: g.fields("A"), lambda: g.with_member_annotation("A", "field"), lambda: g.dependencies()):
        with pytest.raises(ValueError):
            ask()
