from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from bytegrove.functions import globs, modifiers, names, paths
from bytegrove.functions import signatures as S
from bytegrove.sources.manifest import child_paths, module_name, parse_manifest


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_names(spark):
    given = ["La/b/C;", "a/b/C$D.class", "  a.b.C ", "a.b.c", "", "  ", None, "C"]
    assert column(spark, given, names.class_name) == ["a.b.C", "a.b.C$D", "a.b.C", "a.b.c", None, None, None, "C"]
    assert column(spark, [" (I La.b.C; ) V", "", None], names.descriptor) == ["(ILa/b/C;)V", None, None]
    assert column(spark, ["a.b.C", "C", None], names.package_of) == ["a.b", "", None]
    assert column(spark, ["a.b.C$D", "C", "a.X$"], names.simple_name) == ["D", "C", "X$"]
    assert column(spark, ["a/B.class", "a/B.CLASS", "a/.class", "x.txt"], names.path_to_class) == ["a.B", "a.B", None, None]


GLOBS = {
    "*.txt": ["a.txt"], "sub/*.txt": ["sub/b.txt"], "**/*.txt": ["a.txt", "sub/b.txt", "sub/deep/c.txt"], "sub/**": ["sub/b.txt", "sub/deep/c.txt"], "**": ["a.txt", "sub/b.txt", "sub/deep/c.txt"],
    "sub/**/c.txt": ["sub/deep/c.txt"], "?.txt": ["a.txt"], "sub/d*/?.txt": ["sub/deep/c.txt"], "a+.txt": [],
}


@pytest.mark.parametrize("glob", GLOBS)
def test_globs(spark, glob):
    files = ["a.txt", "sub/b.txt", "sub/deep/c.txt"]
    r = globs.glob_to_regex(glob)
    assert [f for f in files if re.search(r, f)] == GLOBS[glob]
    assert [f for f, ok in zip(files, column(spark, files, lambda c: c.rlike(r))) if ok] == GLOBS[glob]


def test_bad_glob():
    with pytest.raises(ValueError):
        globs.glob_to_regex("a**.txt")


def test_filters(spark):
    f = globs.Filter("prefix", ("com.x", "org.*.api"), ("com.x.internal",), ".")
    given = ["com.x", "com.x.y", "com.xy", "com.x.internal.z", "org.a.api.b", "org.a.b.api"]
    assert column(spark, given, f.accepted) == [True, True, False, False, True, False]
    assert column(spark, ["a/Lib.JAR", "b/other.jar"], globs.Filter("leaf", ("lib*.jar",)).accepted) == [True, False]
    assert column(spark, ["a", "b"], globs.Filter("whole", (), ("b",)).accepted) == [True, False]
    for bad in (("leaf", ("a/b.jar",), ()), ("prefix", (), ("",))):
        with pytest.raises(ValueError):
            globs.Filter(*bad)
    status = column(spark, ["com/x", "com/x/y", "com", "com/z", "rej", "rej/a", "p"], lambda c: globs.path_status(c, ("com/x",), ("rej",), ("p",)))
    assert status == ["at", "below", "above", "outside", "rejected", "rejected", "at_class_package"]


def test_modifiers(spark):
    df = spark.createDataFrame([(0x2608, "a"), (0x601, "i"), (0x4031, "e"), (None, "n"), (0x9, "m")], "modifiers int, k string")
    r = {x.k: x for x in df.select("k", modifiers.is_annotation().alias("a"), modifiers.is_interface().alias("i"), modifiers.is_standard().alias("s"), modifiers.modifiers_string("method").alias("w")).collect()}
    assert (r["a"].a, r["a"].i) == (True, False) and (r["i"].i, r["i"].s) == (True, False) and r["e"].s and r["n"].s
    assert r["m"].w == "public static" and r["n"].w == ""


def test_paths(spark):
    assert paths.sanitize("/a//./b/../c/") == "a/c/" and paths.sanitize("../../x") == "x" and paths.sanitize("a.jar!/../b") == "a.jar!/b"
    given = ["/a//b/./c", "../x/..", "a\\b", ""]
    assert column(spark, given, paths.sanitize_column) == ["a/b/c", "", "a/b", ""]
    assert paths.resolve("/base", "x/../y.jar") == "/base/y.jar" and paths.resolve("/b", "file:///a%20b.jar") == "/a b.jar" and paths.resolve("/b", "jar:file:/a.jar!/c/") == "/a.jar!/c"
    assert paths.split_path_list("/a:/b.jar::file:/c") == ["/a", "/b.jar", "file:/c"] and paths.split_path_list("a;b", ";") == ["a", "b"]
    assert paths.split_path_list("jar:file:/x.jar!/y:http://h:80/z.jar") == ["jar:file:/x.jar!/y", "http://h:80/z.jar"]
    assert paths.leaf("a/b!/c/d.txt") == "d.txt" and paths.nested_separator("a.jar!/b.jar!/c") == 12 and paths.nested_separator("a!b") == -1
    assert paths.decode_url("a%20b+c%C3%BC") == "a b+cü" and paths.encode_url("a b/ü!/c") == "a%20b/%C3%BC!/c"
    assert paths.normalize_url("/a b.jar!/c") == "jar:file:/a%20b.jar!/c"
    for file, name in (("/x/my-lib_core-1.2.3.jar", "my.lib.core"), ("foo-2.jar", "foo"), ("a--b.jar", "a.b"), ("plain.jar", "plain")):
        assert paths.automatic_module_name(file) == name
        assert column(spark, [file], paths.automatic_module_name_column) == [name]
    df = spark.createDataFrame([(0o754,), (None,)], "m int").select(paths.posix_permissions("m").alias("p")).collect()
    assert df[0].p == ["OWNER_READ", "OWNER_WRITE", "OWNER_EXECUTE", "GROUP_READ", "GROUP_EXECUTE", "OTHERS_READ"] and df[1].p is None


def test_manifest():
    m = parse_manifest(b"Manifest-Version: 1.0\r\nClass-Path: a.jar li\r\n b/b.jar\r\nBad line\r\nMULTI-RELEASE: true\r\nMulti-Release: false\r\n\r\nName: x\r\nClass-Path: no\r\n")
    assert m["class-path"] == "a.jar lib/b.jar" and m["multi-release"] == "true" and "name" not in m
    assert child_paths(m | {"bundle-classpath": ".,inner.jar;x=1, lib/c.jar"}) == ["a.jar", "lib/b.jar", "inner.jar", "lib/c.jar"]
    assert module_name({}, "m.x", "a.jar") == ("m.x", True) and module_name({"automatic-module-name": "q"}, None, "a.jar") == ("q", True) and module_name({}, None, "a-1.0.jar") == ("a", False)


def test_signatures():
    m = S.parse_method("<T:Ljava/lang/Object;:Ljava/lang/Comparable<-TT;>;>(Ljava/util/Map<TT;*>.Entry<[I+Lx/Y;>;TT;[[J)TT;^Lx/E;^TX;")
    assert S.render(m["args"][0]) == "java.util.Map<T, ?>$Entry<int[], ? extends x.Y>" and S.render(m["args"][0], simple=True) == "Entry<int[], ? extends Y>"
    assert S.render_params(m["params"]) == "<T extends java.lang.Comparable<? super T>>" and len(m["throws"]) == 2
    assert S.erase_method(m) == "(Ljava/util/Map$Entry;Ljava/lang/Object;[[J)Ljava/lang/Object;"
    assert S.to_signature(m["args"][2]) == "[[J" and S.parse_method("<init>")["result"]["name"] == "void"
    c = S.parse_class("<K::Ljava/lang/Runnable;V:TK;>Lx/Base<TK;>;Lx/I<TV;>;^Lx/E;")
    assert c["params"][0]["cb"] is None and len(c["interfaces"]) == 1
    assert S.parse_type("La/b$$c;")["name"] == "a.b$$c" and S.parse_type("La/b$;")["suffixes"] == []
    assert S.parse_type("La/b$c;")["suffixes"][0]["name"] == "c"
    for bad in ("", "Lx", "Lx;y", "[", "Q", "L;", "T;", "Lx<TT;"):
        with pytest.raises(S.SignatureError):
            S.parse_type(bad)
    assert S.same_ignoring_arguments(S.parse_type("Lx/A<TT;>;"), S.parse_type("Lx/A<*>;"))
    b = S.supertype_bindings({"C": "LB<Ljava/lang/String;>;", "B": "<T:Ljava/lang/Object;>LA<[TT;>;LI<+TT;>;", "A": "<U:Ljava/lang/Object;>Ljava/lang/Object;", "I": "<W:Ljava/lang/Object;>Ljava/lang/Object;"}, "C")
    assert S.render(b["A"]["U"]["t"]) == "java.lang.String[]" and b["I"]["W"]["w"] == "+" and S.render(S.substitute(S.parse_type("TW;"), b["I"])) == "java.lang.String"
    assert S.substitute(S.parse_type("TW;"), {"W": {"w": "-", "t": S.parse_type("Lx/Y;")}}) == S.parse_type("TW;")
    assert S.declaring_parameter("Q", m["params"], c["params"]) == {"name": "Q", "cb": None, "ib": []}


def test_lists(spark):
    from bytegrove.operators import lists

    df = spark.createDataFrame([("b", 2), ("a", 1), ("a", 3), (None, 4)], "class_name string, n int")
    assert lists.filter_rows(df, df.n > 2).count() == 2 == lists.filter_rows(df, lambda r: r.n % 2 == 0).count()
    assert [r[0] for r in lists.names(df).collect()] == [None, "a", "b"]
    assert {r.text for r in lists.as_strings(df, "class_name", "n").collect()} == {"b 2", "a 1", "a 3", "4"}
    assert lists.only(df.where("n = 2")).class_name == "b" and lists.only(df.where("n = 9")) is None
    with pytest.raises(ValueError):
        lists.only(df)
