"""Queries of the operators on nested records and hierarchies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import hierarchy, nested
from strataloom.runtime import checkpoint_dir, cut, table

OBJECT = "category string, size array<double>, pos array<double>, yaw double, anchor string, parent string, desc string"
#: Schema of the payload of each tag.
TAGS = {"objects": OBJECT, "fixed": OBJECT, "request": "category string, size array<double>, desc string", "placements": "pos array<double>, yaw double, `on` string"}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return nested.found(table(spark, root, "raw"), table(spark, root, "selected"))


def p1_links(spark: SparkSession, root: str) -> DataFrame:
    """Every element with its table, keys, depth below its record and payload."""
    return nested.emit_all(table(spark, root, "raw"), table(spark, root, "selected"), payload=True)


def _stored(spark: SparkSession, root: str) -> str:
    """All flat tables, written once by tag into the shared folder; the path."""
    path = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    nested.write_tables(p1_links(spark, root), path)
    return path


def p1_objects(spark: SparkSession, root: str) -> DataFrame:
    """The typed table of the tag ``objects``, read back from the tables written by tag; rows that differ in spelling only fold."""
    return nested.read_table(spark, _stored(spark, root), "objects", OBJECT).distinct()


def p1_tables(spark: SparkSession, root: str) -> DataFrame:
    """Elements and records of each flat table, after all were written by tag and read back under their schemas."""
    path = _stored(spark, root)
    parts = [nested.read_table(spark, path, tag, schema).groupBy(F.lit(tag).alias("tag")).agg(F.count_distinct("record_key", "parent_key", "pk").alias("elements"), F.count_distinct("record_key").alias("records")) for tag, schema in TAGS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_paths(spark, root).select("uid", "object_id", "root_id", "depth")


def p4_paths(spark: SparkSession, root: str) -> DataFrame:
    """Path, depth and root of every object."""
    return hierarchy.resolve_checked(hierarchy.room_edges(table(spark, root, "rooms")), "uid", "object_id", "parent_id")


def p4_descendants(spark: SparkSession, root: str) -> DataFrame:
    """All (ancestor, descendant) pairs of each room."""
    return hierarchy.descendants(p4_paths(spark, root), "uid", "object_id")


def p4_circles(spark: SparkSession, root: str) -> DataFrame:
    """Objects whose links never end: on a circle, or only hanging on one."""
    edges = cut(hierarchy.room_edges(table(spark, root, "rooms")))
    return hierarchy.circle_states(hierarchy.resolve_checked(edges, "uid", "object_id", "parent_id"), edges, "uid", "object_id", "parent_id")


def p4_rooms(spark: SparkSession, root: str) -> DataFrame:
    """Objects per room: all, those that never reach a root, and the greatest depth."""
    return p4_paths(spark, root).groupBy("uid").agg(F.count(F.when(F.col("depth") < 0, 1)).alias("caught"), F.count(F.lit(1)).alias("objects"), F.max("depth").alias("deepest"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p1_objects, p1_tables, p4_found, p4_paths, p4_descendants, p4_circles, p4_rooms)}
# SQL of the hierarchies: the links, then a recursive walk down from the roots
_WALK = """
    WITH RECURSIVE r AS (SELECT DISTINCT uid, request, target, parents FROM rooms)
    , i AS (SELECT DISTINCT uid, unnest(list_concat(coalesce(json_extract_string(request, '$.objects[*].id'), []), coalesce(json_extract_string(request, '$.fixed[*].id'), []))) AS id FROM r)
    , m AS (SELECT uid, parents, unnest(json_keys(parents)) AS k FROM r WHERE json_type(parents) = 'OBJECT')
    , a AS (SELECT uid, unnest(json_extract(parents, '$[*]')) AS x FROM r WHERE json_type(parents) = 'ARRAY')
    , e AS (SELECT DISTINCT uid, k AS id, json_extract_string(parents, '$."' || k || '"') AS p FROM m UNION SELECT uid, json_extract_string(x, '$.id'), json_extract_string(x, '$.parent') FROM a)
    , t AS (SELECT uid, unnest(json_extract(target, '$.placements[*]')) AS x FROM r)
    , o AS (SELECT DISTINCT uid, json_extract_string(x, '$.id') AS id, json_extract_string(x, '$.on') AS p FROM t)
    , l AS (SELECT i.uid, i.id, CASE WHEN e.id IS NOT NULL THEN e.p ELSE o.p END AS p FROM i LEFT JOIN e ON e.uid = i.uid AND e.id = i.id LEFT JOIN o ON o.uid = i.uid AND o.id = i.id)
    , k AS (SELECT DISTINCT l.uid, l.id, CASE WHEN j.id IS NOT NULL THEN l.p END AS p FROM l LEFT JOIN i j ON j.uid = l.uid AND j.id = l.p)
    , w AS (SELECT uid, id, id AS root, CAST(0 AS INTEGER) AS depth, [id] AS path FROM k WHERE p IS NULL UNION ALL SELECT k.uid, k.id, w.root, w.depth + 1, list_append(w.path, k.id) FROM w JOIN k ON k.uid = w.uid AND k.p = w.id)
    , f AS (SELECT k.uid, k.id AS object_id, coalesce(w.root, '') AS root_id, coalesce(w.depth, -1) AS depth, coalesce(w.path, []) AS path FROM k LEFT JOIN w ON w.uid = k.uid AND w.id = k.id)"""
# SQL of the elements: texts read again where they hold a text, lists and maps opened alike, members walked down
_OPEN = "SELECT uid, section, holder, CAST(NULL AS VARCHAR) AS key, unnest(json_extract(c, '$[*]')) AS x FROM {t} WHERE json_type(c) = 'ARRAY' UNION ALL SELECT uid, section, holder, k, json_extract(c, '$.\"' || k || '\"') FROM (SELECT uid, section, holder, c, unnest(json_keys(c)) AS k FROM {t} WHERE json_type(c) = 'OBJECT')"
READ = "CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({c}, '$')) THEN json_extract_string({c}, '$') END ELSE {c} END END"
_ID = "coalesce(key, json_extract_string(x, '$.id'), json_extract_string(x, '$.furniture_instance_id'))"
ELEMENTS = f"""
    WITH RECURSIVE raw1 AS (SELECT DISTINCT uid, {READ.format(c='"row"')} AS j FROM raw), sel1 AS (SELECT DISTINCT uid, {READ.format(c='"row"')} AS j FROM selected)
    , s1 AS (SELECT uid, unnest(json_extract(j, '$.messages[*]')) AS m FROM sel1)
    , s2 AS (SELECT uid, json_extract_string(m, '$.role') AS role, regexp_replace(regexp_replace(json_extract_string(m, '$.content'), '^\\s*```[a-z]*\\s*', ''), '\\s*```\\s*$', '') AS t FROM s1)
    , c AS (SELECT uid, 'objects' AS section, uid AS holder, json_extract(j, '$.objects') AS c FROM raw1 UNION ALL SELECT uid, 'fixed', uid, json_extract(j, '$.fixed') FROM raw1
      UNION ALL SELECT uid, 'objects', uid, unnest(json_extract(j, '$.rooms[*].furniture')) FROM raw1
      UNION ALL SELECT uid, 'request', uid, json_extract(t, '$.objects') FROM s2 WHERE role = 'user' AND json_valid(t) UNION ALL SELECT uid, 'placements', uid, json_extract(t, '$.placements') FROM s2 WHERE role = 'assistant' AND json_valid(t))
    , e AS ({_OPEN.format(t='c')})
    , w(uid, section, holder, key, x, own, depth) AS (SELECT uid, section, holder, key, x, {_ID}, 0 FROM e
      UNION ALL SELECT uid, section, holder, key, x, {_ID}, depth FROM (
        SELECT uid, section, coalesce(own, holder) AS holder, CAST(NULL AS VARCHAR) AS key, unnest(json_extract(x, '$.members[*]')) AS x, depth + 1 AS depth FROM w WHERE json_type(x, '$.members') = 'ARRAY'
        UNION ALL SELECT uid, section, holder, k, json_extract(x, '$.members."' || k || '"'), depth FROM (SELECT uid, section, coalesce(own, holder) AS holder, x, depth + 1 AS depth, unnest(json_keys(x, '$.members')) AS k FROM w WHERE json_type(x, '$.members') = 'OBJECT')))"""
ORACLES = {
    "p1_found": ELEMENTS + " SELECT DISTINCT uid, section, own AS item_id, holder AS holder_id FROM w WHERE own IS NOT NULL",
    "p4_found": _WALK + " SELECT uid, object_id, root_id, depth FROM f",
    "p4_paths": _WALK + " SELECT uid, object_id, root_id, depth, path FROM f",
    "p4_descendants": _WALK + ", d AS (SELECT uid, object_id AS descendant, depth, path, unnest(range(0, depth)) AS n FROM f WHERE depth > 0) SELECT uid, path[n + 1] AS ancestor, descendant, CAST(depth - n AS INTEGER) AS distance FROM d",
    "p1_objects": ELEMENTS + """ SELECT DISTINCT uid AS record_key, own AS pk, holder AS parent_key, CAST(depth AS INTEGER) AS depth, json_extract_string(x, '$.category') AS category, TRY_CAST(json_extract(x, '$.size') AS DOUBLE[]) AS size, TRY_CAST(json_extract(x, '$.pos') AS DOUBLE[]) AS pos, TRY_CAST(json_extract(x, '$.yaw') AS DOUBLE) AS yaw, json_extract_string(x, '$.anchor') AS anchor, json_extract_string(x, '$.parent') AS parent, json_extract_string(x, '$.desc') AS "desc" FROM w WHERE own IS NOT NULL AND section = 'objects'""",
    "p1_tables": ELEMENTS + " SELECT section AS tag, count(DISTINCT {'a': uid, 'b': holder, 'c': own}) AS elements, count(DISTINCT uid) AS records FROM w WHERE own IS NOT NULL GROUP BY 1",
    "p4_circles": _WALK + ", c AS (SELECT k.uid, k.id, k.p FROM k JOIN f ON f.uid = k.uid AND f.object_id = k.id AND f.depth < 0), s(uid, id, spot) AS (SELECT uid, id, p FROM c UNION SELECT s.uid, s.id, c.p FROM s JOIN c ON c.uid = s.uid AND c.id = s.spot) SELECT uid, id AS object_id, CASE WHEN bool_or(spot = id) THEN 'circle' ELSE 'below_circle' END AS state FROM s GROUP BY 1, 2",
    "p4_rooms": _WALK + " SELECT uid, count(*) FILTER (depth < 0) AS caught, count(*) AS objects, max(depth) AS deepest FROM f GROUP BY 1",
}
