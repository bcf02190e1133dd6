"""Readers and writers on files made here."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from studylake.sources import files

PACKAGE = {
    "schemaVersion": 1, "packageKey": "demo", "title": "Demo", "version": "1.0.0",
    "questions": [{"questionKey": "q1", "type": "SINGLE", "content": "One?", "options": [{"key": "A", "text": "a"}, {"key": "B", "text": "b"}], "answerKeys": "A", "score": 1.0}, {"questionKey": "q2", "type": "SUBJECTIVE", "content": "Why?", "materialKey": "m1"}],
    "materials": [{"materialKey": "m1", "content": "text"}], "images": {"a.png": "aGk="},
}


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_packages(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(PACKAGE))
    (tmp_path / "bare.json").write_text(json.dumps(PACKAGE | {"questions": [PACKAGE["questions"][0] | {"options": []}]}))
    (tmp_path / "lost.json").write_text(json.dumps(PACKAGE | {"materials": []}))
    (tmp_path / "twice.json").write_text(json.dumps(PACKAGE | {"questions": [PACKAGE["questions"][0]] * 2}))
    (tmp_path / "none.json").write_text("not json")
    rows = files.read_packages(spark, str(tmp_path))
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows.collect()}
    assert errors == {"good.json": None, "bare.json": "objective question without options", "lost.json": "unknown material", "twice.json": "question keys repeat", "none.json": "not a package"}
    good = rows.filter("error IS NULL")
    assert [tuple(r) for r in files.inspect(good).collect()] == [("demo", "1.0.0", "Demo", 2, 1, 1)]
    path = files.write_packages(files.questions_of(good), str(tmp_path / "out"), "packageKey", "version")
    back = spark.read.json(path).first()
    assert [q["questionKey"] for q in back["questions"]] == ["q1", "q2"]


def test_records_round_trip(spark, tmp_path):
    record = {"packageKey": "demo", "packageVersion": "1", "questionKey": "q1", "selectedKeys": "A", "isCorrect": True, "answeredAt": "2024-03-01T08:00:00"}
    (tmp_path / "r.json").write_text(json.dumps({"schemaVersion": 1, "records": [record, record | {"questionKey": "q2", "answeredAt": "2024-02-01T08:00:00"}]}))
    rows = files.read_records(spark, str(tmp_path / "r.json"))
    path = files.write_records(rows, str(tmp_path / "out"))
    back = spark.read.schema(rows.schema).json(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_overrides_in_both_shapes(spark, tmp_path):
    node = {"id": "x", "name": "X", "prereq": ["y"]}
    (tmp_path / "a.json").write_text(json.dumps([node]))
    (tmp_path / "b.json").write_text(json.dumps({"nodes": [node | {"id": "z", "prereq": None}]}))
    assert sorted(map(tuple, files.read_overrides(spark, str(tmp_path)).collect())) == [("x", "X", ["y"]), ("z", "X", [])]


def test_containers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.zip").write_bytes(_zip({"manifest.json": json.dumps(PACKAGE), "media/a.png": b"hi"}))
    (folder / "evil.zip").write_bytes(_zip({"manifest.json": "{}", "../up": b"x"}))
    (folder / "text.zip").write_bytes(b"plain text")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_containers(spark, str(folder)).collect()}
    assert rows["good.zip"]["package"]["packageKey"] == "demo" and rows["good.zip"]["names"] == ["media/a.png"]
    assert (rows["evil.zip"]["error"], rows["text.zip"]["error"]) == ("unsafe entry", "not an archive")
    one = files.read_entry(spark, str(folder / "good.zip"), "media/a.png").first()
    assert bytes(one["content"]) == b"hi"
    made = spark.createDataFrame([("demo", "1", json.dumps(PACKAGE), {"b": b"2", "a": b"1"})], "packageKey string, version string, manifest string, media map<string,binary>")
    first, again = (bytes(files.containers(made).first()["content"]) for _ in range(2))
    assert first == again and zipfile.ZipFile(io.BytesIO(first)).namelist() == ["manifest.json", "a", "b"]


def test_office_files(spark, tmp_path):
    w, a = 'xmlns:w="w"', 'xmlns:a="a"'
    (tmp_path / "d.docx").write_bytes(_zip({"word/document.xml": f"<w:doc {w}><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:t>Bye</w:t></w:p></w:doc>"}))
    (tmp_path / "s.pptx").write_bytes(_zip({f"ppt/slides/slide{i}.xml": f"<s {a}><a:p><a:t>Slide {i}</a:t></a:p></s>" for i in (10, 2)}))
    (tmp_path / "x.xlsx").write_bytes(_zip({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<ws><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></ws>'}))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_office(spark, str(tmp_path)).collect()}
    assert rows["d.docx"]["text"] == "Hello there\nBye"
    assert rows["s.pptx"]["text"] == "# 1\nSlide 2\n\n# 2\nSlide 10"
    assert rows["x.xlsx"]["text"] == "# 1\nname | 5"
    assert rows["bad.docx"]["text"] is None and rows["bad.docx"]["error"]


def test_texts_images_backup_and_lookup(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path / "a.md")).first()["text"] == "one\ntwo"
    (tmp_path / "i.png").write_bytes(b"x" * 10)
    assert files.read_images(spark, str(tmp_path / "i.png")).first()["error"] is None
    rows = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", None)], "id long, name string, deleted boolean")
    path = files.backup({"bank": rows}, str(tmp_path / "backup"))
    back = files.restore(spark, path, {"bank": "id long, name string, deleted boolean"})["bank"]
    assert files.live(back).agg(F.collect_set("id")).first()[0].sort() is None and files.live(back).count() == 2
    assert files.lookup(back, "id", 1).first()["name"] == "a"
    with pytest.raises(Exception, match="no row with id 9"):
        files.lookup(back, "id", 9).collect()
    with pytest.raises(ValueError):
        files.restore(spark, path, {"../x": "id long"})


def test_packages_are_counted_as_a_stream():
    """Any cut of the bytes gives the same counts, and a long array takes no memory."""
    import json
    import tracemalloc

    from studylake.sources import streams

    package = {"schemaVersion": 1, "packageKey": 'a"\\[{', "title": "t", "questions": [{"q": [1, 2, {"x": "]},"}]}, {}, "s,", 5, None], "materials": [], "images": {"a": "{", "b": [1, 2]}, "version": "1", "more": {"questions": [1, 2, 3]}}
    data = json.dumps(package, indent=1).encode()
    for size in (1, 2, 3, 7, 50, len(data)):
        assert streams.count_package(data[i : i + size] for i in range(0, len(data), size)) == ('a"\\[{', "1", "t", 5, 0, 2)
    for bad in (b"", b"[]", b'{"packageKey": "x"', b'{"packageKey": "x"}}', b'{"version": "1"}', b'{"packageKey": "x", "questions": [}'):
        with pytest.raises(ValueError):
            streams.count_package([bad])

    def long(n):
        yield b'{"packageKey": "x", "questions": ['
        for i in range(n):
            yield b'{"content": "' + b"y" * 2000 + b'"}' + (b"," if i < n - 1 else b"")
        yield b"]}"

    tracemalloc.start()
    assert streams.count_package(long(20_000))[3] == 20_000
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_entries_are_read_by_range(spark, tmp_path):
    import os
    import zipfile

    from studylake.sources import streams

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(50):
            z.writestr(f"e{i}", os.urandom(20_000))
        z.writestr("small", b"here")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    wanted = [(f"file://{path}", "small"), (f"file://{path}", "none"), (f"file://{tmp_path}/b.zip", "x"), (f"file://{tmp_path}/c.zip", "x"), (f"file://{path}", "e7")]
    got = {(r["path"][-5:], r["name"]): r for r in streams.read_entries(spark.createDataFrame(wanted, "path string, name string")).collect()}
    assert bytes(got["a.zip", "small"]["content"]) == b"here" and len(got["a.zip", "e7"]["content"]) == 20_000
    assert [got[k]["error"] for k in (("a.zip", "none"), ("b.zip", "x"), ("c.zip", "x"))] == ["no such entry", "not an archive", "no such file"]
    directory = 51 * 60
    assert got["a.zip", "small"]["bytes_read"] < 2 * directory + 200
    assert got["a.zip", "e7"]["bytes_read"] < 2 * directory + 20_200


def test_a_restore_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    """Broken off between the steps it leaves the old tables in use, and goes on where it stopped."""
    schemas = {"bank": "id long, name string", "card": "id long"}
    table = lambda n: {"bank": spark.range(n).selectExpr("id", "concat('b', id) AS name"), "card": spark.range(n)}
    old, new = (files.backup(table(n), str(tmp_path / f"backup{n}")) for n in (3, 5))
    target = str(tmp_path / "live")
    sizes = lambda: [files.restored(spark, target, schemas)[n].count() for n in schemas]
    files.restore_into(spark, old, schemas, target)
    assert sizes() == [3, 3]
    swap = files._swap
    monkeypatch.setattr(files, "_swap", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        files.restore_into(spark, new, schemas, target)
    assert sizes() == [3, 3]
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "live").rglob("*.parquet")}
    monkeypatch.setattr(files, "_swap", swap)
    files.restore_into(spark, new, schemas, target)
    assert sizes() == [5, 5] and written == {p: p.stat().st_mtime_ns for p in (tmp_path / "live").rglob("*.parquet")}
    # A table that isn't what the list says is refused before anything is replaced.
    spark.range(7).write.mode("overwrite").parquet(f"{old}/card")
    third = str(tmp_path / "third")
    with pytest.raises(ValueError, match="card differs"):
        files.restore_into(spark, old, schemas, third)
    assert not (tmp_path / "third" / "current").exists()
