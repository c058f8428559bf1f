"""Readers and sinks on files made here."""

import io
import json
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import types as T

from strataloom.sources import files, publish

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x", "more": 2}\n\n{"id": "no number"}\n{"id": 2\n')
    rows, bad = files.json_lines(spark, str(tmp_path / "a.jsonl"), ROW)
    assert [tuple(r) for r in rows.collect()] == [(1, "x")] and bad.count() == 2


def test_json_array(spark, tmp_path):
    values = [{"id": i, "name": 'a]"},{\\ ' + "x" * i} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(values, indent=1))
    (tmp_path / "b.json").write_text("[]")
    assert [json.loads(x) for x in files.array_elements(str(tmp_path / "a.json"), 7)] == values
    got = files.json_array(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], ROW)
    assert sorted(r.id for r in got.collect()) == list(range(30))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / "a.csv"), ROW).collect()] == [(1, "x"), (2, None)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/a.csv", "v,w\n1,NA\n")
        z.writestr("skip.txt", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("c.csv")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = {(r.member, r.text, r.error is not None) for r in files.archive_members(spark, str(tmp_path), "*.csv").collect()}
    assert got == {("in/a.csv", "v,w\n1,NA\n", False), ("c.csv", "abc", False), (None, None, True)}


def test_bounds(spark, tmp_path):
    doc = {"scenes": [{"nodes": [0]}], "nodes": [{"translation": [1, 0, 0], "children": [1]}, {"scale": [2, 1, 1], "mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"min": [0, 0, 0], "max": [1, 2, 3]}]}
    body = json.dumps(doc).encode()
    (tmp_path / "a.glb").write_bytes(struct.pack("<4sII", b"glTF", 2, 20 + len(body)) + struct.pack("<I4s", len(body), b"JSON") + body)
    (tmp_path / "b.urdf").write_text('<robot><link name="base"/><link name="door"><visual><origin xyz="0 0 1"/><geometry><box size="2 2 2"/></geometry></visual></link><joint><parent link="base"/><child link="door"/><origin xyz="5 0 0"/></joint></robot>')
    (tmp_path / "c.glb").write_bytes(b"broken")
    got = {r.file.rsplit("/", 1)[-1]: (r.low, r.high, r.error is not None) for r in files.bounds(spark, str(tmp_path)).collect()}
    assert got["a.glb"] == ([1, 0, 0], [3, 2, 3], False) and got["b.urdf"] == ([4, -1, 0], [6, 1, 2], False) and got["c.glb"][2]


def test_inventory_and_listing(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = files.inventory(spark, str(tmp_path)).collect()[0]
    assert row.name == "x.bin" and row.bytes == 3 and row.sha256.startswith("ba7816bf")
    names = spark.createDataFrame([("a/b.json",), ("a/b.glb",), ("c.json",)], "name string")
    assert [r.name for r in files.listed(names, "name", ["*.json"], ["c*"]).collect()] == ["a/b.json"]


def test_publish_is_final_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "a"), (2, None, "b")], "id long, name string, part string")
    path = str(tmp_path / "out")
    assert {(r.output, r.rows) for r in publish.publish(df, "part", path).collect()} == {("a", 1), ("b", 1)}
    assert {r.state for r in publish.verified(spark, path, df.schema, "part").collect()} == {"same"}
    with pytest.raises(Exception, match="(?i)exists"):
        publish.publish(df, "part", path)
    spark.createDataFrame([(9, "y", "a"), (3, "z", "c")], "id long, name string, part string").write.mode("append").partitionBy("part").parquet(f"{path}/rows")
    assert {(r.output, r.state) for r in publish.verified(spark, path, df.schema, "part").collect()} == {("a", "differs"), ("b", "same"), ("c", "extra")}
