from __future__ import annotations

import json
import re

from bytegrove.operators.shred import entities, parse, shred

NAMES = {"classinfo": "classInfo", "fieldinfo": "fieldInfo", "methodinfo": "methodInfo", "annotationinfo": "annotationInfo", "parameterinfo": "parameterInfo", "annotationparamvalues": "annotationParamValues"}
OWN = {"fieldInfo": "fieldname", "methodInfo": "methodname", "annotationInfo": "annotationname"}


def fold(k: str) -> str:
    return re.sub(r"[_\-\W]", "", k).lower()


def brute(text: str) -> set[tuple[str, str | None]]:
    """(path, name) of field, method and annotation objects by plain recursion."""
    try:
        top = json.loads(text.lstrip("﻿"))
    except ValueError:
        return set()
    out = set()

    def visit(obj: dict, path: str) -> None:
        counts: dict[str, int] = {}
        for k, v in obj.items():
            name = NAMES.get(fold(k))
            if not name:
                continue
            if isinstance(v, str):
                try:
                    v = json.loads(v)
                except ValueError:
                    continue
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict):
                    i = counts[name] = counts.get(name, -1) + 1
                    p = f"{path}.{name}[{i}]" if path else f"{name}[{i}]"
                    if name in OWN:
                        out.add((p, next((y for kk, y in x.items() if fold(kk) == OWN[name]), None)))
                    visit(x, p)

    if isinstance(top, dict):
        visit(top, "")
    return out


RECORDS = [
    '{"className":"a.B","fieldInfo":[null,{"fieldName":"x"},null,{"fieldName":"y","annotationInfo":{"annotationName":"A"}}]}',
    '{"class_info":[{"class_name":"a.B","method_info":[{"method_name":"<init>","parameter_info":[{},{"annotation_info":[{"annotation_name":"P"}]}]}]}],"format":"11"}',
    '﻿{"MethodInfo":{"MethodName":"m","AnnotationInfo":[{"AnnotationName":"N","AnnotationParamValues":[{"Name":"v","AnnotationInfo":[{"AnnotationName":"O"}]}]}]}}',
    '{"methodInfo":"[{\\"methodName\\":\\"s\\",\\"annotationInfo\\":null}]"}',
    '{"fieldInfo":[{"fieldName":"cut"',
    "", " ", "null", "[]", "7", '{"fieldInfo":[]}', '{"fieldInfo":[{}]}',
    '{"annotationInfo":[{"annotationName":"V","annotationParamValues":[{"name":"value","value":{"t":"[","v":["a","b"]}}]}]}',
]


def run(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, record string, path string, node int")
    n = shred(df)
    e = entities(n, list(OWN), {"fieldName": "f", "methodName": "m", "annotationName": "a"})
    return {(r.record_id, r.path, r.f if r.label == "fieldInfo" else r.m if r.label == "methodInfo" else r.a) for r in e.collect()}


def test_against_recursion(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(RECORDS)]
    want = {(i, p, n) for i, t in enumerate(RECORDS) for p, n in brute(t)}
    assert len(want) > 10
    assert run(spark, rows + rows + [(None, None, None, None), (99, None, "y", 2)]) == want


def test_given_records(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/class_records.parquet")
    want = {(r.record_id, p, n) for r in raw.collect() if r.record for p, n in brute(r.record)}
    n = entities(shred(raw), list(OWN), {"fieldName": "f", "methodName": "m", "annotationName": "a"})
    assert {(r.record_id, r.path, r.f or r.m or r.a) for r in n.collect()} == want


def test_links_lead_to_parents(spark):
    df = spark.createDataFrame([(1, RECORDS[1])], "record_id long, record string")
    n = shred(df)
    e = entities(n, ["annotationInfo"], {"annotationName": "a"}).first()
    assert e.parent_path == "classInfo[0].methodInfo[0].parameterInfo[1]"
    assert n.where(n.node == e.parent).first().path == e.parent_path


def test_deep_wide_and_empty(spark):
    deep = '{"annotationInfo":[' * 400 + '{"annotationName":"end"}' + "]}" * 400
    wide = json.dumps({"fieldInfo": [{"fieldName": f"f{i}"} for i in range(30_000)]})
    got = run(spark, [(1, deep, "", 0), (2, wide, "", 0)])
    assert sum(x[0] == 1 for x in got) == 400 and sum(x[0] == 2 for x in got) == 30_000
    assert run(spark, []) == set()
    assert parse("[" * 100_000) is None
    twice = run(spark, [(1, '{"fieldInfo":{"fieldName":"a"},"fieldInfo":{"fieldName":"b"}}', "", 0)])
    assert {x[1:] for x in twice} == {("fieldInfo[0]", "a"), ("fieldInfo[1]", "b")}


def test_values_are_whole(spark):
    df = spark.createDataFrame([(1, RECORDS[-1])], "record_id long, record string")
    e = entities(shred(df), ["annotationParamValues"], {"name": "n", "value": "v"}).first()
    assert (e.n, json.loads(e.v)) == ("value", {"t": "[", "v": ["a", "b"]})


def test_valid_json_of_any_depth_and_length():
    from bytegrove.operators.shred import _json, _parse_deep, parse, walk

    deep = '{"x":[' * 50_000 + '{"fieldInfo":{"fieldName":"f"}}' + "]}" * 50_000
    maps = ({"fieldinfo": "fieldInfo"}, {"fieldname": "fieldName"}, {})
    assert [s for *_, s, _ in walk(parse('{"x":[' * 300 + '{"fieldInfo":{"fieldName":"f"}}' + "]}" * 300), *maps) if s] == ["f"]
    v, n = parse(deep), 0
    while "x" in v:
        v, n = v["x"][0], n + 1
    assert n == 50_000 and v == {"fieldInfo": {"fieldName": "f"}}
    long = "9" * 10_000
    assert parse('{"modifiers":' + long + "}") == {"modifiers": long}
    assert parse("NaN") is None and parse("[1,Infinity]") is None and parse('{"a":1') is None and parse("[1,]") is None
    for text in ('{"a": [1.50, {"b": "c\\n"}, null, true, []], "d": {}}', '"x"', "-0.5e3", "[[], [[]]]"):
        assert _parse_deep(text) == parse(text) and json.loads(_json(parse(text))) == json.loads(text)
    for text in ("{", "[1 2]", '{"a" 1}', "{1: 2}", "1 2", '{"a":1,}', "tru", '"a', "01"):
        assert _parse_deep(text) is None and parse(text) is None


def test_escapes_that_no_text_can_hold(spark):
    df = spark.createDataFrame([(1, '{"fieldInfo": [{"fieldName": "a\\ud800b", "\\udc00": {"fieldInfo": {"fieldName": "c"}}}]}')], "record_id long, record string")
    names = [r.fieldName for r in entities(shred(df), ["fieldInfo"], {"fieldName": "fieldName"}).collect()]
    assert sorted(names) == ["a\\ud800b", "c"]
