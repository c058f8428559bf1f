"""Readers under explicit schemas: JSON lines, JSON arrays of any size, CSV, archives, meshes, inventories.

Nothing is inferred. Lines that don't fit the schema come out with their text in ``_bad``. Archives and meshes are read
whole, one file a record, so they must fit a task; tables never are.

Defined cases: an empty file gives no rows; a broken archive or mesh gives one row with its ``error``; extra fields are ignored; a
repeated member comes out as often as it occurs.
"""

from __future__ import annotations

import codecs
import fnmatch
import io
import json
import re
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataloom.runtime import map_records, ship

BAD = "_bad"


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, refused lines) of a file or folder of JSON lines."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return parsed.where(F.col(BAD).isNull()).drop(BAD), parsed.where(F.col(BAD).isNotNull()).select(BAD)


def csv_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A CSV file with a header, columns by name of the header."""
    return spark.read.csv(path, header=True, schema=schema, sep=sep, enforceSchema=False, mode="FAILFAST")


class JsonArraySource(DataSource):
    """``format("jsonarray")``: the elements of a top-level JSON array as texts, decoded piece by piece; a file is never held whole."""

    @classmethod
    def name(cls):
        return "jsonarray"

    def schema(self):
        return "file string, at bigint, value string"

    def reader(self, schema):
        return JsonArrayReader(self.options)


class JsonArrayReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for at, text in enumerate(array_elements(partition.value)):
            yield partition.value, at, text


_MARKS = re.compile(r'["\\\[\]{},]')


def opened(path):
    """A byte stream of a file on any store that pyarrow knows by its URI; a path without scheme lies on this machine."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_stream(at)


def array_elements(path, piece=1 << 20):
    """Texts of the elements of the array in a file, read ``piece`` bytes at a time; only signs that matter are looked at."""
    decode = codecs.getincrementaldecoder("utf-8-sig")()
    depth, quoted, skip, held, at, start = 0, False, -1, "", 0, 0
    with opened(path) as file:
        while more := file.read(piece):
            held += decode.decode(more)
            for m in _MARKS.finditer(held, at):
                c, i = m.group(), m.start()
                if i == skip:
                    continue
                if quoted:
                    if c == "\\":
                        skip = i + 1
                    quoted = c != '"'
                elif c == '"':
                    quoted = True
                elif c in "[{":
                    depth += 1
                    start = i + 1 if depth == 1 else start
                elif depth == 1 and c in "],":
                    if text := held[start:i].strip():
                        yield text
                    if c == "]":
                        return
                    start = i + 1
                elif c in "]}":
                    depth -= 1
            # what was handed on is let go
            at, skip = len(held) - start, skip - start
            held, start = held[start:], 0


def array_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, at, value) of the elements of JSON arrays."""
    ship(spark)
    spark.dataSource.register(JsonArraySource)
    return spark.read.format("jsonarray").option("paths", json.dumps(paths)).load()


def json_array(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The records of JSON arrays under a schema."""
    return array_texts(spark, paths).select(F.from_json("value", schema).alias("r")).select("r.*")


def archive_members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, member, text, error) of the members of zip and tar archives whose name matches."""

    def make():
        def act(record):
            file, content = record
            try:
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if fnmatch.fnmatch(name, pattern) and not name.endswith("/"):
                                yield file, name, z.read(name).decode("utf-8", "replace"), None
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        for member in t:
                            if member.isfile() and fnmatch.fnmatch(member.name, pattern):
                                yield file, member.name, t.extractfile(member).read().decode("utf-8", "replace"), None
            except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError) as e:
                yield file, None, None, type(e).__name__

        return act

    ship(spark)
    return map_records(spark.read.format("binaryFile").load(path).select("path", "content"), "file string, member string, text string, error string", make, 64)


def times(a, b):
    """Product of two 4 x 4 matrices in rows."""
    return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def node_matrix(node):
    """Matrix of a scene node: given whole, or as shift, turn and scale."""
    if "matrix" in node:
        m = node["matrix"]
        return [[m[4 * j + i] for j in range(4)] for i in range(4)]
    x, y, z, w = node.get("rotation", [0, 0, 0, 1])
    s, t = node.get("scale", [1, 1, 1]), node.get("translation", [0, 0, 0])
    turn = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return [[turn[i][j] * s[j] for j in range(3)] + [t[i]] for i in range(3)] + [[0, 0, 0, 1]]


def mesh_bounds(content: bytes):
    """(low, high) corner of a binary scene file, from the bounds of its meshes through their nodes."""
    magic, _, _ = struct.unpack_from("<4sII", content)
    size, kind = struct.unpack_from("<I4s", content, 12)
    if magic != b"glTF" or kind != b"JSON":
        raise ValueError("no binary scene")
    doc = json.loads(content[20 : 20 + size])
    nodes, points = doc.get("nodes", []), []
    roots = doc["scenes"][doc.get("scene", 0)]["nodes"] if doc.get("scenes") else range(len(nodes))
    one = [[float(i == j) for j in range(4)] for i in range(4)]
    stack = [(r, one) for r in roots]
    while stack:
        at, above = stack.pop()
        m = times(above, node_matrix(nodes[at]))
        stack.extend((c, m) for c in nodes[at].get("children", []))
        if "mesh" in nodes[at]:
            for part in doc["meshes"][nodes[at]["mesh"]]["primitives"]:
                box = doc["accessors"][part["attributes"]["POSITION"]]
                for k in range(8):
                    p = [box["max" if k >> i & 1 else "min"][i] for i in range(3)]
                    points.append([sum(m[i][j] * p[j] for j in range(3)) + m[i][3] for i in range(3)])
    return [min(p[i] for p in points) for i in range(3)], [max(p[i] for p in points) for i in range(3)]


def model_bounds(content: bytes):
    """(low, high) corner of the boxes of an articulated model, every joint at zero and unturned."""
    root, shift = ET.fromstring(content), {}
    triple = lambda e, name, default: [float(v) for v in (e.get(name) if e is not None and e.get(name) else default).split()]
    for joint in root.findall("joint"):
        shift[joint.find("child").get("link")] = (joint.find("parent").get("link"), triple(joint.find("origin"), "xyz", "0 0 0"))
    points = []
    for link in root.findall("link"):
        at, name, seen = [0.0, 0.0, 0.0], link.get("name"), set()
        while name in shift and name not in seen:
            seen.add(name)
            name, move = shift[name][0], shift[name][1]
            at = [a + b for a, b in zip(at, move)]
        for body in link.findall("visual") + link.findall("collision"):
            box = body.find("geometry/box")
            if box is not None:
                size, middle = triple(box, "size", "0 0 0"), triple(body.find("origin"), "xyz", "0 0 0")
                points += [[a + m + sign * s / 2 for a, m, s in zip(at, middle, size)] for sign in (-1, 1)]
    return [min(p[i] for p in points) for i in range(3)], [max(p[i] for p in points) for i in range(3)]


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """(file, low, high, error) of scene files (.glb) and articulated models (.urdf)."""

    def make():
        def act(record):
            file, content = record
            try:
                low, high = model_bounds(content) if file.endswith(".urdf") else mesh_bounds(content)
                return [(file, low, high, None)]
            except Exception as e:  # any broken file is a row, not a failed job
                return [(file, None, None, type(e).__name__)]

        return act

    ship(spark)
    return map_records(spark.read.format("binaryFile").load(path).select("path", "content"), "file string, low array<double>, high array<double>, error string", make, 64)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def listed(names: DataFrame, column: str, want: list[str], leave: list[str] = ()) -> DataFrame:
    """Rows whose name matches one of the wanted patterns and none of the left ones."""
    patterns = lambda ps: "|".join(f"(?:{p})" for p in (fnmatch.translate(x).replace("(?s:", "(?:").replace("\\Z", "$").replace("\\z", "$") for x in ps))
    kept = names.where(F.col(column).rlike(patterns(want))) if want else names.limit(0)
    return kept.where(~F.col(column).rlike(patterns(leave))) if leave else kept
