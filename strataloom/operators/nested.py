"""Deeply nested records to related flat tables in a single pass.

A depth-first visitor walks each record once and emits, for every element it
meets, a tagged row ``(tag, record_key, pk, parent_key, depth, payload)``. All tables
leave the same pass; the tag says to which one a row belongs. ``write_tables``
stores the rows partitioned by tag, ``read_table`` applies a schema to one tag.

Scale: the pass is a narrow ``mapInArrow`` (no shuffle; a record never leaves its
task, so a hot house or source is split like any other rows). The only shuffle is
the one that folds rows delivered twice, on the full row, with map-side combine.

Defined cases: NULL, empty or unreadable text gives no rows; a NULL record key
falls back to the record's own ``uid``; lists given as maps use the key as id;
elements without an id are walked but emit nothing; the holder of an element
is the nearest element above it through ``members`` that has an id, else the record;
integer ids become text; repeated rows fold into one; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.jsontext import elements, id_text, read_json
from strataloom.runtime import map_records, spread

SCHEMA = "tag string, record_key string, pk string, parent_key string, depth int, payload string"
#: Names under which an element may carry its own id, first match wins.
ID_FIELDS = ("id", "furniture_instance_id", "object_id")


def own_id(key, element):
    if key is not None:
        return id_text(key)
    if isinstance(element, dict):
        for name in ID_FIELDS:
            if (found := id_text(element.get(name))) is not None:
                return found
    return None


def visit(tag, record_key, container, payload):
    """Depth-first over a container and the ``members`` of its elements, without recursion."""
    stack = [(key, x, record_key, 0) for key, x in reversed(elements(container))]
    while stack:
        key, element, holder, depth = stack.pop()
        own = own_id(key, element)
        if own is not None:
            yield tag, record_key, own, holder, depth, json.dumps({k: v for k, v in element.items() if k != "members"} if isinstance(element, dict) else element, ensure_ascii=False, sort_keys=True) if payload else None
        if isinstance(element, dict) and element.get("members"):
            below = holder if own is None else own
            stack.extend((k, x, below, depth + 1) for k, x in reversed(elements(element["members"])))


def scene_sections(value):
    """(tag, container) of a room record, in either of its two forms."""
    if isinstance(value, dict):
        yield "objects", value.get("objects")
        yield "fixed", value.get("fixed")
        for _, room in elements(value.get("rooms")):
            if isinstance(room, dict):
                yield "objects", room.get("furniture")
                yield "objects", room.get("objects")
                yield "fixed", room.get("fixed")


def dialogue_sections(value):
    """(tag, container) of a training row: the request of the user, the placements of the assistant."""
    if not isinstance(value, dict):
        return
    for _, message in elements(value.get("messages")):
        if not isinstance(message, dict):
            continue
        content = read_json(message.get("content")) if message.get("role") in ("user", "assistant") else None
        if isinstance(content, dict):
            if message["role"] == "user":
                yield "request", content.get("objects")
            else:
                yield "placements", content.get("placements")


SECTIONS = {"scene": scene_sections, "dialogue": dialogue_sections}


def emit(df: DataFrame, key: str, text: str, kind: str, payload: bool = True) -> DataFrame:
    """Tagged rows of every element of every record of ``df``; repeated rows are kept."""
    sections = SECTIONS[kind]

    def make():
        def act(record):
            value = read_json(record[1])
            own = record[0] if record[0] is not None else id_text(value.get("uid")) if isinstance(value, dict) else None
            if value is None or own is None:
                return
            for tag, container in sections(value):
                yield from visit(tag, own, container, payload)

        return act

    return map_records(spread(df.select(F.col(key).cast("string"), F.col(text).cast("string"))), SCHEMA, make)


def emit_all(raw: DataFrame, selected: DataFrame, payload: bool = False) -> DataFrame:
    """Distinct elements of room records and training rows, as one tagged table."""
    return emit(raw, "uid", "row", "scene", payload).unionByName(emit(selected, "uid", "row", "dialogue", payload)).distinct()


def found(raw: DataFrame, selected: DataFrame) -> DataFrame:
    """``(uid, section, item_id, holder_id)`` of every element with an id."""
    rows = emit(raw, "uid", "row", "scene", False).unionByName(emit(selected, "uid", "row", "dialogue", False))
    return rows.select(F.col("record_key").alias("uid"), F.col("tag").alias("section"), F.col("pk").alias("item_id"), F.col("parent_key").alias("holder_id")).distinct()


def write_tables(emitted: DataFrame, path: str) -> None:
    """All flat tables in one write, one folder a tag."""
    emitted.write.mode("overwrite").partitionBy("tag").parquet(path)


def apply_schema(emitted: DataFrame, tag: str, schema: T.StructType | str) -> DataFrame:
    """The table of one tag: its keys, and its payload under ``schema``."""
    typed: Column = F.from_json("payload", schema)
    return emitted.where(F.col("tag") == tag).select("record_key", "pk", "parent_key", "depth", typed.alias("p")).select("record_key", "pk", "parent_key", "depth", "p.*")


def read_table(spark, path: str, tag: str, schema: T.StructType | str) -> DataFrame:
    """One tag of a stored emission; the folder of other tags isn't read."""
    return apply_schema(spark.read.schema(SCHEMA).parquet(path), tag, schema)
