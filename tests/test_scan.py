"""Archives written here byte by byte, and classes that javac compiles here."""

from __future__ import annotations

import io
import shutil
import struct
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from bytegrove.operators.members import Members
from bytegrove.operators.relations import Relations
from bytegrove.sources.archives import ArchiveOptions, check_scheme, directory_entries, list_archive, open_file
from bytegrove.sources.classfile import ClassFile, ClassFormatError, modified_utf8
from bytegrove.sources.scan import ScanConfig, scan

SOURCES = {
    "p/Mark.java": '''package p; import java.lang.annotation.*;
@Retention(RetentionPolicy.RUNTIME) @Inherited public @interface Mark { String name() default "d\\u00fc\\uD83D\\uDE00"; int[] nums() default {1, 2}; Class<?> type() default Object.class; Thread.State state() default Thread.State.NEW; double d() default Double.NaN; }''',
    "p/Hidden.java": "package p; import java.lang.annotation.*; @Retention(RetentionPolicy.CLASS) @Target({ElementType.TYPE_USE, ElementType.TYPE}) @interface Hidden {}",
    "p/Base.java": '''package p;
@Mark(name = "x", nums = 7) public abstract class Base<T extends Comparable<T>> implements java.io.Serializable {
  public static final long L = 5L; static final String S = "s\\0t"; static final char C = 'c'; static final float F = 1f / 0; final boolean b = true;
  @Deprecated protected T value; abstract T get(@Mark int a, T b) throws java.io.IOException;
  public void run() { int x = 1;
    x++; } private static class In { } public @Hidden String use(java.util.List<@Hidden String> l) { return null; } }''',
    "p/Impl.java": "package p; public class Impl extends Base<String> implements Runnable { Impl(int q) {} String get(int a, String b) { Runnable r = new Runnable() { public void run() {} }; return q.Out.NAME + r; } public enum E { A } }",
    "p/Rec.java": "package p; record Rec(int a, String b) {}",
    "p/Tag.java": "package p; import java.lang.annotation.*; @Retention(RetentionPolicy.RUNTIME) @Repeatable(Tag.Many.class) public @interface Tag { String value(); @Retention(RetentionPolicy.RUNTIME) @interface Many { Tag[] value(); } }",
    "p/Tagged.java": "package p; @Tag(\"a\") @Tag(\"b\") public class Tagged {}",
    "q/Out.java": "package q; public class Out extends Far { public static String NAME = Thread.currentThread().getName(); }",
    "q/Far.java": "package q; public class Far implements Deep {}", "q/Deep.java": "package q; public interface Deep {}",
}


@pytest.fixture(scope="module")
def compiled(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no javac")
    root = tmp_path_factory.mktemp("src")
    for name, text in SOURCES.items():
        f = root / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    out = root / "out"
    subprocess.run(["javac", "-g", "-parameters", "-d", out, *map(str, root.rglob("*.java"))], check=True, capture_output=True)
    return {str(f.relative_to(out)): f.read_bytes() for f in sorted(out.rglob("*.class"))}


def jar(entries, path=None) -> bytes:
    """entries: (name, bytes) or (ZipInfo, bytes)."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    if path:
        path.write_bytes(buf.getvalue())
    return buf.getvalue()


def listed(data: bytes, **options):
    return list(list_archive(io.BytesIO(data), "x.jar", "", ArchiveOptions(**options)))


def test_parser(compiled):
    base = ClassFile(compiled["p/Base.class"])
    assert (base.name, base.superclass, base.interfaces) == ("p.Base", "java.lang.Object", ["java.io.Serializable"])
    assert base.signature == "<T::Ljava/lang/Comparable<TT;>;>Ljava/lang/Object;Ljava/io/Serializable;" and base.source_file == "Base.java"
    consts = {f["name"]: f["const_json"] for f in base.fields}
    assert consts["L"] == '{"t":"J","v":5}' and consts["S"] == '{"t":"s","v":"s\\u0000t"}' and consts["C"] == '{"t":"C","v":99}' and consts["F"] == '{"t":"F","v":"Infinity"}'
    get = next(m for m in base.methods if m["name"] == "get")
    assert get["thrown"] == ["java.io.IOException"] and not get["has_body"] and get["signature"].startswith("(ITT;)TT;")
    run = next(m for m in base.methods if m["name"] == "run")
    assert run["has_body"] and 0 < run["min_line"] < run["max_line"]
    kinds = {(a["target_kind"], a["annotation"], a["param_idx"]) for a in base.annotations}
    assert {("class", "p.Mark", None), ("param", "p.Mark", 0)} <= kinds
    assert next(a for a in base.annotations if a["target_kind"] == "class")["params"] == [{"name": "name", "value_json": '{"t":"s","v":"x"}'}, {"name": "nums", "value_json": '{"t":"[","v":[{"t":"I","v":7}]}'}]
    assert [(p["name"], p["signature"]) for p in base.params if p["method_ord"] == get["ord"]] == [("a", "I"), ("b", "TT;")]
    assert {t["target_type"] for t in base.type_annotations} == {0x14, 0x16} and any(t["path"] == [{"kind": 3, "arg": 0}] for t in base.type_annotations)
    assert not ClassFile(compiled["p/Base.class"], invisible=False).type_annotations
    mark = {d["name"]: d["value_json"] for d in ClassFile(compiled["p/Mark.class"]).defaults}
    assert mark["name"] == '{"t":"s","v":"dü😀"}' and mark["d"] == '{"t":"D","v":"NaN"}' and "Thread$State" in mark["state"] and mark["type"] == '{"t":"c","v":"Ljava/lang/Object;"}'
    impl = ClassFile(compiled["p/Impl.class"])
    assert "q.Out" in impl.refs and "p.Impl" not in impl.refs and {"inner": "p.Impl$E", "outer": "p.Impl", "modifiers": 0x4019} in impl.inner
    anon = ClassFile(compiled["p/Impl$1.class"])
    assert anon.defining_method == "p.Impl.get" and ClassFile(compiled["p/Rec.class"]).is_record
    assert modified_utf8(b"\xed\xa0\xbd\xed\xb8\x80\xc0\x80") == "😀\0"


def test_bad_classes(compiled):
    good = compiled["p/Base.class"]
    for bad in (b"", b"\xca\xfe\xba\xbe", b"PK", *(good[:n] for n in range(12, len(good) - 1, 97))):
        with pytest.raises(ClassFormatError):
            ClassFile(bad)
    with pytest.raises(ClassFormatError):
        ClassFile(good[:10] + b"\x63" + good[11:])


def test_archive_listing(compiled):
    c = compiled["p/Rec.class"]
    multi = [("META-INF/MANIFEST.MF", "Multi-Release: true\n"), ("p/Rec.class", c), ("META-INF/versions/9/p/Rec.class", c), ("META-INF/versions/11/p/Rec.class", c), ("META-INF/versions/99/p/Rec.class", c)]
    rows = {r["path"]: r for r in listed(jar(multi))}
    assert rows["p/Rec.class"]["version"] == 11 and len(rows) == 2 and dict(rows["META-INF/MANIFEST.MF"]["manifest"])["multi-release"] == "true"
    assert len(listed(jar(multi), all_versions=True)) == 5
    # Without the flag versions are stripped too, and the first entry of a path counts.
    assert [(r["path"], r["version"]) for r in listed(jar(multi[1:]))] == [("p/Rec.class", 8)]
    assert [(r["path"], r["version"]) for r in listed(jar(multi[:1:-1]))] == [("p/Rec.class", 11)]
    assert {r["version"] for r in listed(jar(multi), all_versions=True)} == {8, 9, 11}
    inner = jar([("p/Rec.class", c)])
    boot = listed(jar([("BOOT-INF/classes/p/Rec.class", c), ("BOOT-INF/lib/in.jar", inner), ("BOOT-INF/lib/bad.jar", b"no zip"), ("a/./b/../x.txt", b"1"), ("dup", b"1"), ("/dup", b"22")]))
    by = {(r["nested"], r["path"]): r for r in boot}
    assert by["", "p/Rec.class"]["root"] == "BOOT-INF/classes/" and ("BOOT-INF/lib/in.jar", "p/Rec.class") in by and ("", "a/x.txt") in by and by["", "dup"]["length"] == 1
    assert by["BOOT-INF/lib/bad.jar", None]["error"]
    assert not any(r["nested"] for r in listed(jar([("BOOT-INF/lib/in.jar", inner)]), nested=False))
    assert not any(r["nested"] for r in listed(jar([("BOOT-INF/lib/in.jar", inner)]), reject_names=("IN*.jar",)))
    assert listed(jar([("META-INF/MANIFEST.MF", "Spring-Boot-Classes: odd/\n")]))[0]["error"]
    mode = zipfile.ZipInfo("m.txt")
    mode.external_attr, mode.create_system, mode.extra = 0o754 << 16, 3, struct.pack("<HHBi", 0x5455, 5, 1, 86400)
    r = listed(jar([(mode, b"x")]))[0]
    assert r["posix_mode"] == 0o754 and r["mtime"].isoformat().startswith("1970-01-02") and not r["is_classfile"]


def test_broken_archives():
    good = jar([("a", b"1"), ("b", b"2")])
    for bad in (b"", good[: len(good) // 2], good[:-4]):
        rows = listed(bad)
        assert len(rows) == 1 and rows[0]["error"]
    at = good.rfind(b"PK\x05\x06")
    crypt = bytearray(good)
    crypt[good.find(b"PK\x01\x02") + 8] |= 1
    assert [r["path"] for r in listed(bytes(crypt))] == ["b"] and at > 0
    with pytest.raises(ValueError):
        check_scheme("http://x/y.jar", ArchiveOptions())
    check_scheme("http://x/y.jar", ArchiveOptions(allow_remote=True))


@pytest.fixture(scope="module")
def jars(compiled, tmp_path_factory):
    d = tmp_path_factory.mktemp("jars")
    p = {k: v for k, v in compiled.items() if k.startswith("p/")}
    jar([("META-INF/MANIFEST.MF", "Class-Path: b.jar\n"), *p.items(), ("p/broken.class", b"\xca\xfe"), ("p/Lost.class", compiled["p/Rec.class"]), ("p/x.txt", b"t"), ("module-info.class", b"")], d / "a.jar")
    jar([*((k, v) for k, v in compiled.items() if k.startswith("q/")), ("p/Rec.class", compiled["p/Rec.class"])], d / "b.jar")
    (d / "c.jar").write_bytes(b"nothing")
    return d


def test_scan(spark, jars):
    s = scan(spark, [str(jars)], ScanConfig(accept_packages=("p",)))
    assert {(r.path, bool(r.error)) for r in s.errors.collect()} == {("p/broken.class", True), ("p/Lost.class", True), (None, True)}
    cat = s.catalog()
    c = {r.class_name: r for r in cat.classes.collect()}
    assert not c["p.Rec"].is_external and c["p.Rec"].cp_idx == 0 and c["p.Rec"].is_record
    assert c["p.Mark"].inherited_meta and c["java.io.Serializable"].is_external and c["java.io.Serializable"].modifiers & 0x200
    assert "q.Out" not in c and c["p.Base$In"].modifiers & 0x2 and not c["p.Base$In"].modifiers & 0x1
    r = Relations(cat)
    assert {x.related for x in r.subclasses().where("class_name = 'p.Base'").collect()} == {"p.Impl"}
    assert {x.related for x in r.implementing().where("class_name = 'java.io.Serializable'").collect()} == {"p.Base", "p.Impl"}
    carriers = {x.related for x in r.with_annotation().where("class_name = 'p.Mark'").collect()}
    assert carriers == {"p.Base", "p.Impl"}
    got = {(x.name, x.declared_in) for x in Members(cat, r).methods().where("class_name = 'p.Impl' AND name IN ('run', 'get')").collect()}
    assert ("run", "p.Base") in got and ("get", "p.Impl") in got
    assert {x.path for x in s.resources.where("not is_classfile").collect()} == {"p/x.txt"} and s.resources.where("path = 'p/Rec.class'").count() == 2
    assert s.params.count() > 3 and s.defaults.count() == 5 and s.type_annotations.count() >= 2 and s.class_refs.where("src = 'p.Impl' and dst = 'q.Out'").count() == 1


def test_extension_to_external_classes(spark, jars):
    s = scan(spark, [str(jars)], ScanConfig(accept_packages=("q.none",), accept_classes=("q.Out",)))
    c = {r.class_name: r.is_external for r in s.catalog().classes.collect()}
    assert (c["q.Out"], c["q.Far"], c["q.Deep"]) == (False, True, True)
    t = scan(spark, [str(jars)], ScanConfig(accept_classes=("q.Out",), extend_to_external=False))
    assert "q.Deep" not in {r.class_name for r in t.catalog().classes.collect()}


def test_class_path_is_followed(spark, compiled, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    jar([("META-INF/MANIFEST.MF", "Class-Path: ../two/far.jar missing.jar http://no/where\n"), ("BOOT-INF/lib/in.jar", jar([("q/Deep.class", compiled["q/Deep.class"])]))], one / "a.jar")
    jar([("q/Far.class", compiled["q/Far.class"])], two / "far.jar")
    jar([("q/Out.class", compiled["q/Out.class"])], one / "b.jar")
    s = scan(spark, [str(one)])
    got = [(r.element.rsplit("/", 1)[-1], r.nested) for r in s.elements.orderBy("cp_idx").collect()]
    assert got == [("a.jar", ""), ("far.jar", ""), ("a.jar", "BOOT-INF/lib/in.jar"), ("b.jar", "")]
    assert s.errors.count() == 0 and {r.class_name for r in s.parsed.collect()} == {"q.Deep", "q.Far", "q.Out"}
    assert scan(spark, [str(one)], ScanConfig(follow_class_path=False)).elements.count() == 3


def test_directories_modules_and_visibility(spark, compiled, tmp_path):
    root = tmp_path / "classes"
    for name, data in compiled.items():
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    s = scan(spark, [str(root)], ScanConfig(accept_packages_flat=("p",), ignore_member_visibility=False))
    cat = s.catalog()
    own = {r.class_name for r in cat.classes.where("not is_external").collect()}
    assert {"p.Base", "p.Rec", "p.Impl$1"} <= own and not any(n.startswith("q.") for n in own)
    assert {r.name for r in cat.fields.where("class_name = 'p.Base'").collect()} == {"L"} and {r.name for r in cat.methods.where("class_name = 'p.Base'").collect()} == {"<init>", "run", "use"}
    assert scan(spark, [str(root)], ScanConfig(directories=False)).entries.count() == 0
    (tmp_path / "src").mkdir()
    (tmp_path / "src/module-info.java").write_text("module m.one { }")
    subprocess.run(["javac", "-d", tmp_path / "m", tmp_path / "src/module-info.java"], check=True, capture_output=True)
    jars = tmp_path / "jars"
    jars.mkdir()
    jar([("module-info.class", (tmp_path / "m/module-info.class").read_bytes()), ("p/Rec.class", compiled["p/Rec.class"]), ("Loose.class", b"x")], jars / "m.jar")
    jar([("META-INF/MANIFEST.MF", "Automatic-Module-Name: m.two\n"), ("q/Deep.class", compiled["q/Deep.class"])], jars / "n-1.0.jar")
    t = scan(spark, [str(jars)])
    assert {r.name for r in t.modules.collect()} == {"m.one", "m.two"} and t.errors.count() == 0
    assert {(r.class_name, r.module_name) for r in t.catalog().classes.where("not is_external").collect()} == {("p.Rec", "m.one"), ("q.Deep", "m.two")}
    one = scan(spark, [str(jars)], ScanConfig(reject_modules=("m.*",), element_filter=F.col("element").like("%.jar")))
    assert one.elements.count() == 0
    for bad in (ScanConfig(accept_packages_flat=("a.*",)), ScanConfig(archives=ArchiveOptions(all_versions=True))):
        with pytest.raises(ValueError):
            scan(spark, [str(jars)], bad)


def test_contents(spark, tmp_path):
    from bytegrove.sources.archives import archive_files, list_entries, map_contents

    jar([("a.txt", b"one"), ("b/c.txt", b"three")], tmp_path / "x.jar")
    entries = list_entries(archive_files(spark, [str(tmp_path)]))
    got = map_contents(entries, lambda path, data: [(path, len(data))], "path string, n int").collect()
    assert {tuple(r) for r in got} == {("a.txt", 3), ("b/c.txt", 5)}
    gone = entries.selectExpr("element", "nested", "path", "'none' as path_in_element", "ord")
    assert map_contents(gone, lambda p, d: [(p, 0)], "path string, n int", strict=False).count() == 0
    with pytest.raises(Exception, match="a.txt|c.txt"):
        map_contents(gone, lambda p, d: [(p, 0)], "path string, n int").count()


def test_type_arguments(spark, jars):
    from bytegrove.operators.signatures import method_signatures, supertype_arguments

    cat = scan(spark, [str(jars)], ScanConfig(accept_packages=("p",))).catalog()
    got = {(r.class_name, r.supertype, r.variable, r.argument) for r in supertype_arguments(Relations(cat)).collect()}
    assert ("p.Impl", "p.Base", "T", "java.lang.String") in got
    text = {(r.name, r.text, r.erased) for r in method_signatures(cat).where("class_name = 'p.Base'").collect()}
    assert ("get", "(int, T) T", "(ILjava/lang/Object;)Ljava/lang/Object;") in text


def test_directory_order(spark, tmp_path):
    for f in ("b/z.txt", "b/a/A.class", "a.txt", "c.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"1")
    got = [(r.path, r.is_classfile) for r in directory_entries(spark, str(tmp_path)).orderBy("order_key").collect()]
    assert got == [("a.txt", False), ("c.txt", False), ("b/z.txt", False), ("b/a/A.class", True)]
    with open_file((tmp_path / "a.txt").as_uri()) as f:
        assert f.read() == b"1"


def test_parsed_classes_are_those_of_every_archive(spark, compiled, tmp_path):
    from bytegrove.sources.archives import archive_files, list_entries
    from bytegrove.sources.scan import parse_classes

    jar([("p/Base.class", compiled["p/Base.class"])], tmp_path / "a.jar")
    jar([("q/Far.class", compiled["q/Far.class"]), ("BOOT-INF/lib/in.jar", jar([("q/Deep.class", compiled["q/Deep.class"])]))], tmp_path / "other-1.jar")
    got = parse_classes(list_entries(archive_files(spark, [str(tmp_path)])).where("is_classfile and error is null")).collect()
    assert {r.class_name for r in got} == {"p.Base", "q.Far", "q.Deep"} and not any(r.parse_error for r in got)


def test_flipped_bytes_never_end_a_scan(compiled):
    """Whatever a damaged file holds, parsing ends with a class or with an error that becomes a row."""
    import random

    rng = random.Random(2)
    for data in list(compiled.values())[:12]:
        for _ in range(150):
            bad = bytearray(data)
            for _ in range(rng.randrange(1, 4)):
                bad[rng.randrange(8, len(bad))] = rng.randrange(256)
            try:
                ClassFile(bytes(bad)).record()
            except (ClassFormatError, ValueError, IndexError, KeyError, struct.error, RecursionError):
                pass


def test_repeated_annotations_and_roots_within_roots(spark, compiled, tmp_path):
    for name, data in compiled.items():
        f = tmp_path / "root" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    jar([(n, d) for n, d in compiled.items() if n.startswith("q/")], tmp_path / "root" / "q.jar")
    root = str(tmp_path / "root")
    s = scan(spark, [root, root + "/q.jar", root + "/q"], ScanConfig())
    assert s.elements.where("element like '%q.jar'").count() == 1
    assert not [r.path for r in s.entries.collect() if r.element.endswith("/root/") and r.path.startswith("q/")]
    a = s.catalog().annotations.where("class_name = 'p.Tagged'").collect()
    assert sorted((r.annotation, r.params[0].value_json.replace(" ", "")) for r in a) == [("p.Tag", '{"t":"s","v":"a"}'), ("p.Tag", '{"t":"s","v":"b"}')]
    assert {r.dst for r in s.edges().where("rel = 'class_ann' and src = 'p.Tagged'").collect()} == {"p.Tag", "p.Tag$Many"}
    few = scan(spark, [root], ScanConfig(class_path_only=True, accept_element_paths=("q/*.class",)))
    assert not hasattr(few, "parsed") and few.entries.count() > 0


def test_contents_are_read_from_the_place_that_was_listed(spark, tmp_path):
    """The directory of an archive is read once, by the listing; reading goes on without it, and damage is a row."""
    from bytegrove.sources.archives import archive_files, list_entries, map_contents

    data = jar([("a.txt", b"one" * 50), ("b.txt", b"two" * 50), ("ü.txt", b""), ("c.txt", b"six" * 50)], tmp_path / "x.jar")
    entries = list_entries(archive_files(spark, [str(tmp_path)])).cache()
    assert {r.path: r.place.at for r in entries.collect()} == {i.filename: i.header_offset for i in zipfile.ZipFile(io.BytesIO(data)).infolist()}
    bad = bytearray(data[: data.find(b"PK\x01\x02")])
    bad[bad.find(b"b.txt") + 5] = 0xFF  # no deflated block begins so
    (tmp_path / "x.jar").write_bytes(bytes(bad))
    got = map_contents(entries, lambda path, text: [(path, len(text))], "path string, n int", strict=False).collect()
    assert {tuple(r) for r in got} == {("a.txt", 150), ("ü.txt", 0), ("c.txt", 150)}


def test_long_chains_take_two_tables_a_round(spark, tmp_path, monkeypatch):
    from bytegrove.scratch import Scratch
    from bytegrove.sinks.archives import class_bytes

    blank = {"modifiers": 1, "minor": 0, "major": 52, "interfaces": [], "type_signature": None, "source_file": None, "is_record": False, "outer": None, "fields": [], "methods": [], "annotations": []}
    chain = [f"p{i}.C" for i in range(11)]
    jar([(f"p{i}/C.class", class_bytes(blank | {"class_name": c, "superclass": chain[i + 1] if i < 10 else "java.lang.Object"})) for i, c in enumerate(chain)], tmp_path / "x.jar")
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": (saved.append(name), save(self, df, name))[1])
    s = scan(spark, [str(tmp_path)], ScanConfig(accept_packages=("p0",)))
    assert {(r.class_name, r.is_external) for r in s.parsed.collect()} == {(c, i > 0) for i, c in enumerate(chain)} and s.errors.count() == 0
    assert len(saved) - saved.index("parsed") - 1 <= 2 * len(chain) + 4


def test_archives_of_more_entries_than_16_bits_count(tmp_path):
    from bytegrove.sinks.archives import DAMAGED, VERSIONED, _write_archive

    n = _write_archive(str(tmp_path / "x.jar"), ((f"p/C{i}.class", (VERSIONED | DAMAGED) * (i < 2), b"%d" % i) for i in range(66_000)))
    with zipfile.ZipFile(tmp_path / "x.jar") as z:
        names = z.namelist()
        assert n == len(names) == len(set(names)) == 66_008 and z.read("p/C65999.class") == b"65999" and z.testzip() is None
        assert names[66_000:] == [f"{p}p/C{i}.class" for p in ("META-INF/versions/11/", "META-INF/versions/99/", "broken/", "moved/") for i in (0, 1)]
    with (tmp_path / "x.jar").open("rb") as f:
        # Without the flag the files of other versions have the path of their base.
        assert sum(1 for _ in list_archive(f, "x.jar", "", ArchiveOptions())) == 66_004


def test_repeated_members_and_instances_are_written_once(spark):
    from bytegrove.catalog import Catalog
    from bytegrove.sinks.archives import class_bytes, class_records

    schema = {
        "classes": "class_name string, modifiers int, is_record boolean, is_external boolean, inherited_meta boolean, cp_idx int, resource_path string, package_name string, module_name string, type_signature string, scanned_at timestamp, major int, minor int, source_file string",
        "edges": "rel string, src string, dst string, ord int, nonprivate boolean", "methods": "class_name string, ord int, name string, descriptor string, modifiers int, has_body boolean, thrown array<string>, signature string, min_line int, max_line int",
        "fields": "class_name string, ord int, name string, descriptor string, modifiers int, const_json string", "annotations": "ann_id bigint, target_kind string, class_name string, member_ord int, param_idx int, ord int, annotation string, visible boolean, params array<struct<name:string,value_json:string>>",
    }
    one = lambda c: (c, 1, None, False, None, 0, f"{c.replace('.', '/')}.class", None, None, None, None, 52, 0, "x")
    rows = {
        "classes": [one("p.A"), one("p.B")], "edges": [("extends", "p.A", "p.B", 0, None), ("implements", "p.A", "p.J", 1, None), ("implements", "p.A", "p.I", 0, None)],
        "methods": [("p.A", 1, "m", "()V", 1, None, None, None, None, None), ("p.A", 0, "n", "()V", 2, None, None, None, None, None), ("p.A", 3, "m", "()V", 4, None, None, None, None, None), ("p.A", 1, "k", "(I)V", None, None, None, None, None, None)],
        "fields": [("p.A", 0, "f", None, 1, None), ("p.A", 1, "f", "I", 1, None), ("p.A", None, "g", "I", None, '{"t":"I","v":7}')],
        "annotations": [(1, "method", "p.A", 1, None, 0, "q.M", True, None), (1, "method", "p.A", 1, None, 0, "q.M", True, None), (2, "field", "p.A", None, None, 0, "q.N", True, None), (3, "class", "p.A", None, None, 0, "q.C", True, None), (3, "class", "p.B", None, None, 0, "q.C", True, None)],
    }
    t = {k: spark.createDataFrame(v, schema[k]) for k, v in rows.items()}
    records = class_records(Catalog(t["classes"], t["edges"], t["methods"], t["fields"], t["annotations"]))
    from bytegrove.sinks.archives import _plain

    columns = [_plain(c) for c in records.toArrow().combine_chunks().to_batches()[0].columns]
    got = {(c := ClassFile(class_bytes(dict(zip(records.columns, r))))).name: c for r in zip(*columns)}
    a, b = got["p.A"], got["p.B"]
    assert (a.superclass, a.interfaces, b.superclass) == ("p.B", ["p.I", "p.J"], "java.lang.Object")
    assert [(m["name"], m["modifiers"]) for m in a.methods] == [("n", 2), ("k", 0), ("m", 1)] and [(f["name"], f["const_json"]) for f in a.fields] == [("g", '{"t":"I","v":7}')]
    assert [(x["target_kind"], x["member_ord"], x["annotation"]) for x in a.annotations if x["target_kind"] != "class"] == [("method", 1, "q.M")]
    assert sum(x["annotation"] == "q.C" for c in (a, b) for x in c.annotations) == 1
