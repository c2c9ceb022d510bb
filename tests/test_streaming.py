from __future__ import annotations

import io
import zipfile

from bytegrove.streaming.rescan import rescan


def put(path, entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, d in entries:
            z.writestr(n, d)
    path.write_bytes(buf.getvalue())


def test_new_archives_come_once(spark, tmp_path):
    seen = []
    src = tmp_path / "in"
    src.mkdir()
    handle = lambda df, i: seen.append(sorted((r.path, bool(r.parse_error)) for r in df.select("path", "parse_error").collect()))
    put(src / "a.jar", [("p/A.class", b"bad"), ("x.txt", b"")])
    (src / "note.txt").write_text("no archive")
    for _ in range(2):
        rescan(spark, str(src), handle, str(tmp_path / "cp")).awaitTermination(120)
    put(src / "b.jar", [("p/B.class", b"bad")])
    rescan(spark, str(src), handle, str(tmp_path / "cp")).awaitTermination(120)
    assert [x for x in seen if x] == [[("p/A.class", True)], [("p/B.class", True)]]
