"""Files in and out."""

import gzip
import json
import os
import urllib.error
import zipfile

import pytest

from waylake.sources import files, sinks, web

ROW = "{}\tCity\tCity\t\t31.2\t121.5\tP\tPPL\tCN\t\t01\t\t\t\t1000\t\t\tAsia/Shanghai\t2026-07-30"


def test_gazetteer_plain_and_zip(spark, tmp_path):
    text = "﻿" + ROW.format(1) + "\n\n" + ROW.format(2).replace("City", '"open', 1) + "\nbad\n"
    (tmp_path / "cities500.txt").write_text(text, encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "cities500.zip", "w") as z:
        z.writestr("dir/cities500.txt", text)
        z.writestr("readme.txt", "x")
    for name in ("cities500.txt", "cities500.zip"):
        good, bad = files.gazetteer(spark, str(tmp_path / name), "cities500")
        assert sorted(r["geonameid"] for r in good.collect()) == ["1", "2"]
        assert [(r["line_id"], r["reason"]) for r in bad.collect()] == [(4, "column_count")]  # blank lines count as lines


def test_line_numbers_over_several_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(1, 20001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.numbered_lines(spark, str(tmp_path / "big.txt"))
        assert df.rdd.getNumPartitions() > 1 and df.where("raw_line <> concat('line ', file_line)").count() == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pointers_and_wrong_archives_are_refused(spark, tmp_path):
    (tmp_path / "a.zip").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n")
    with pytest.raises(files.SourceError, match="pointer"):
        files.numbered_lines(spark, str(tmp_path / "a.zip"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.txt", "1")
    with pytest.raises(Exception, match="expected one member"):
        files.numbered_lines(spark, str(tmp_path / "b.zip"), "y.txt").count()


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿id,name,note\n1,"a ""q""\nb",\n,,\n2\n3,c,d,extra\n', encoding="utf-8")
    got = files.csv_table(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["id", "name", "note"]
    assert sorted(tuple(r) for r in got.collect()) == [("1", 'a "q"\nb', ""), ("2", "", ""), ("3", "c", "d")]
    assert files.csv_table(spark, str(tmp_path / "t.csv"), ["name"]).columns == ["name"]
    (tmp_path / "c.txt").write_text("# about\n#ISO\tName\nCN\tChina\n\nFR\tFrance\n")
    assert sorted(tuple(r) for r in files.commented_tsv(spark, str(tmp_path / "c.txt")).collect()) == [("CN", "China"), ("FR", "France")]


def test_markdown_tree(spark, tmp_path):
    for p in ("中国/a b+c.md", "中国/README.md", "raw/x.md", ".git/y.md", "z.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("# t\n")
    assert sorted(r["path"] for r in files.markdown_tree(spark, str(tmp_path)).collect()) == ["中国/README.md", "中国/a b+c.md"]
    assert [r["path"] for r in files.markdown_tree(spark, str(tmp_path), readme=False).collect()] == ["中国/a b+c.md"]


def test_gzip_and_json(spark, tmp_path):
    payload = json.dumps({"status": 200}).encode()
    (tmp_path / "11.json.gz").write_bytes(sinks.deterministic_gzip(payload))
    (tmp_path / "12.json.gz").write_bytes(b"no gzip")
    rows = {r["source"]: r for r in files.gzip_documents(spark, str(tmp_path / "*.gz")).collect()}
    assert rows["11.json.gz"]["payload_sha256"] == sinks.sha256(payload) and rows["12.json.gz"]["payload"] is None
    assert sinks.deterministic_gzip(payload) == sinks.deterministic_gzip(payload) and gzip.decompress(sinks.deterministic_gzip(payload)) == payload
    (tmp_path / "a.json").write_text('{"a": [1]}')
    assert files.json_documents(spark, str(tmp_path / "a.json")).selectExpr("try_variant_get(document, '$.a[0]', 'int') as x").first()["x"] == 1


def test_whole_files(spark, tmp_path):
    df = spark.createDataFrame([("2", True, None), ("1", False, 'a,"b"')], "id string, flag boolean, note string")
    path = str(tmp_path / "out.csv")
    sinks.write_csv_file(df, path, ["id"])
    assert open(path, newline="").read() == 'id,flag,note\n1,false,"a,""b"""\n2,true,\n'
    with pytest.raises(ZeroDivisionError):
        sinks.write_whole(path, (str(1 // (1 - i)) for i in range(3)))
    assert open(path).read().startswith("id") and os.listdir(tmp_path) == ["out.csv"]
    sinks.write_json_file({"b": "城", "a": 1}, str(tmp_path / "r.json"))
    assert open(tmp_path / "r.json").read() == '{\n  "a": 1,\n  "b": "城"\n}\n'


def test_tables_are_swapped(spark, tmp_path):
    target = str(tmp_path / "t")
    for n in (1, 2):
        sinks.write_table(spark.range(n), target)
    assert spark.read.parquet(target).count() == 2 and sorted(os.listdir(tmp_path)) == ["t"]
    with pytest.raises(OSError):
        sinks.swap_directory(str(tmp_path / "missing"), target, str(tmp_path / "b"))
    assert spark.read.parquet(target).count() == 2


def test_guards(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.guard(a, [b], root=str(tmp_path))
    for kw in ({"inputs": [a]}, {"others": [a]}, {"root": b}):
        with pytest.raises(sinks.SinkRefused):
            sinks.guard(a, **kw)


def test_documents_and_features(spark, tmp_path):
    df = spark.createDataFrame([("a-1", '{"x": 1}'), ("b", None)], "n string, v string")
    assert sinks.write_documents(df, str(tmp_path / "d"), "n", "v") == 2 and json.load(open(tmp_path / "d/a-1.json")) == {"x": 1}
    with pytest.raises(Exception, match="not a file name"):
        sinks.write_documents(spark.createDataFrame([("../x", "1")], "n string, v string"), str(tmp_path / "d"), "n", "v")
    f = sinks.feature_collection(spark.createDataFrame([("p", 1.5, 2.5, "x")], "id string, lon double, lat double, name string"), ["name"]).first()["feature"]
    assert json.loads(f) == {"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"name": "x"}}


class Response:
    def __init__(self, body, status=200):
        self.body, self.status = body, status

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.body


def test_fetch_retries_and_fails():
    waits, calls = [], []

    def opener(request, timeout):
        calls.append(1)
        if len(calls) < 4:
            raise urllib.error.URLError("down")
        return Response(b"ok")

    assert web.fetch("http://x", opener=opener, sleep=waits.append) == b"ok" and waits == [1, 2, 4]
    with pytest.raises(files.SourceError, match="status 503"):
        web.fetch("http://x", opener=lambda *_, **__: Response(b"", 503))


def test_snapshot_is_published_whole(tmp_path):
    pages = {"v": "<p>截止2025年12月31日</p>".encode(), "u1": b"{}", "u2": b"[]"}
    where = str(tmp_path / "snap")
    with pytest.raises(files.SourceError, match="not 2026-01-01"):
        web.land_snapshot(where, {"11": "u1"}, "v", "2026-01-01", get=pages.__getitem__)
    with pytest.raises(KeyError):
        web.land_snapshot(where, {"11": "u1", "12": "gone"}, "v", "2025-12-31", get=pages.__getitem__)
    assert os.listdir(tmp_path) == []
    m = web.land_snapshot(where, {"11": "u1", "12": "u2"}, "v", "2025-12-31", get=pages.__getitem__)
    assert sorted(os.listdir(where)) == ["11.json.gz", "12.json.gz", "manifest.json"] and m["sources"][0]["payload_sha256"] == sinks.sha256(b"{}")
    with pytest.raises(files.SourceError, match="exists"):
        web.land_snapshot(where, {}, "v", "2025-12-31", get=pages.__getitem__)
    assert web.revision(str(tmp_path), "kept") == "kept"
