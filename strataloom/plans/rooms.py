"""Queries of the operators on whole rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import geometry as G
from strataloom.functions import text
from strataloom.operators import curate, nested
from strataloom.operators import rooms as R
from strataloom.plans.structure import ELEMENTS, READ
from strataloom.runtime import table
from strataloom.sources import scenes


def room_checks(spark: SparkSession, root: str) -> DataFrame:
    return R.checks(table(spark, root, "raw"))


def room_heights(spark: SparkSession, root: str) -> DataFrame:
    """Objects of each room and those above its ceiling."""
    return room_checks(spark, root).select("uid", "objects", "above")


def room_labels(spark: SparkSession, root: str) -> DataFrame:
    """Every label of an object, its plain name and last word."""
    rows = nested.emit(table(spark, root, "raw"), "uid", "row", "scene").where("tag = 'objects'")
    label = F.coalesce(F.get_json_object("payload", "$.category"), F.get_json_object("payload", "$.furniture_category"))
    return rows.select(label.alias("label")).where("label is not null").distinct().select("label", text.category(F.col("label")).alias("category"), text.head(F.col("label")).alias("head"), text.slug(F.col("label")).alias("slug"))


def room_order(spark: SparkSession, root: str) -> DataFrame:
    """Place of every object in the order in which its room is shown."""
    act = lambda uid, source, room: [(uid, i, o["id"]) for i, (part, o) in enumerate(curate.in_order({**room, "fixed": []}))]
    return R.over_rooms(table(spark, root, "raw"), "uid string, place int, object_id string", act).distinct()


def room_quarters(spark: SparkSession, root: str) -> DataFrame:
    """Sums of the places of the objects of each room after one to three quarter turns."""

    def act(uid, source, room):
        boxes = [(o["x"], o["y"], o["w"], o["d"], o["yaw"]) for o in room["objects"]]
        for k in (1, 2, 3):
            if room["outline"] and boxes:
                _, moved = G.quarter(room["outline"], boxes, k)
                yield uid, k, round(sum(m[0] for m in moved), 3), round(sum(m[1] for m in moved), 3)

    return R.over_rooms(table(spark, root, "raw"), "uid string, turns int, x double, y double", act).distinct()


def room_check_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of rooms of each source that pass every check."""
    c = room_checks(spark, root)
    clean = sum((F.col(k) for k in ("outside", "above", "unsupported", "main", "fixed_hits")), F.lit(0)) == 0
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("rooms"), F.round(F.avg(clean.cast("int")), 6).alias("clean"), F.round(F.avg("overlap"), 6).alias("overlap"))


def room_anchors(spark: SparkSession, root: str) -> DataFrame:
    return R.anchors(table(spark, root, "raw"))


def room_relations(spark: SparkSession, root: str) -> DataFrame:
    return R.relations(table(spark, root, "raw"))


def relation_counts(spark: SparkSession, root: str) -> DataFrame:
    return room_relations(spark, root).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("rooms"))


def room_layout_twins(spark: SparkSession, root: str) -> DataFrame:
    """Rooms of one layout in some orientation, one row for each class of more than one room."""
    k = R.keys(table(spark, root, "raw")).where("layout_key is not null")
    return k.groupBy("layout_key").agg(F.count_distinct("uid").alias("rooms"), F.count_distinct("source").alias("sources"), F.min("uid").alias("first_uid")).where("rooms > 1")


def room_content_twins(spark: SparkSession, root: str) -> DataFrame:
    """Sets of sizes that stand in more than one source."""
    k = R.keys(table(spark, root, "raw")).where("content_key is not null")
    return k.groupBy("content_key").agg(F.count_distinct("uid").alias("rooms"), F.count_distinct("source").alias("sources")).where("sources > 1")


def room_content_classes(spark: SparkSession, root: str) -> DataFrame:
    """Rooms with the same set of sizes: one row for each class of more than one room."""
    k = R.keys(table(spark, root, "raw")).where("content_key is not null")
    return k.groupBy("content_key").agg(F.min("uid").alias("first_uid"), F.count_distinct("uid").alias("rooms"), F.count_distinct("source").alias("sources")).where("rooms > 1").drop("content_key")


def room_outlines(spark: SparkSession, root: str) -> DataFrame:
    return R.outlines(table(spark, root, "raw"))


def room_settled(spark: SparkSession, root: str) -> DataFrame:
    return R.settle(table(spark, root, "raw"))


def room_walkways(spark: SparkSession, root: str) -> DataFrame:
    return R.walkways(table(spark, root, "raw"))


def answer_states(spark: SparkSession, root: str) -> DataFrame:
    return R.answer_states(table(spark, root, "placer_generate"), table(spark, root, "rooms"))


def answer_state_counts(spark: SparkSession, root: str) -> DataFrame:
    return answer_states(spark, root).groupBy(F.coalesce("state", F.lit("sound")).alias("state")).agg(F.count(F.lit(1)).alias("answers"), F.round(F.avg("placed"), 4).alias("placed"))


def exported_rooms(spark: SparkSession, root: str) -> DataFrame:
    """Rooms that came in the export form, in the form of the others."""
    return scenes.from_export(table(spark, root, "raw").select("uid", "row").distinct(), "row", ["uid"])


def room_hulls(spark: SparkSession, root: str) -> DataFrame:
    """Convex hull of the object centres of each room, and its area."""
    boxes = R.over_rooms(table(spark, root, "raw"), "uid string, x double, y double", lambda uid, source, room: [(uid, o["x"], o["y"]) for o in room["objects"]])
    ring = scenes.hulls(boxes, "uid")
    return ring.select("uid", F.size("ring").alias("corners"), F.round(scenes.ring_area(F.col("ring")), 4).alias("area"))


QUERIES = {f.__name__: f for f in (room_checks, room_heights, room_labels, room_order, room_quarters, room_check_rates, room_anchors, room_relations, relation_counts, room_layout_twins, room_content_twins, room_content_classes, room_outlines, room_settled, room_walkways, answer_states, answer_state_counts, exported_rooms, room_hulls)}
# boxes of every readable room, lists and maps alike
_BOXES = f"""
        WITH r AS (SELECT DISTINCT uid, source, {READ.format(c='"row"')} AS j FROM raw WHERE uid IS NOT NULL)
        , v AS (SELECT row_number() OVER () AS n, uid, source, j, TRY_CAST(CASE WHEN json_type(j, '$.height') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN json_extract_string(j, '$.height') END AS DOUBLE) AS height FROM r WHERE json_type(j) = 'OBJECT')
        , c AS (SELECT n, height, CASE WHEN json_type(j, '$.objects') IN ('ARRAY', 'OBJECT') AND CAST(json_extract(j, '$.objects') AS VARCHAR) NOT IN ('[]', '{{}}') THEN json_extract(j, '$.objects') ELSE json_extract(j, '$.rooms[0].furniture') END AS c FROM v)
        , e AS (SELECT n, height, unnest(json_extract(c, '$[*]')) AS x, NULL AS k FROM c WHERE json_type(c) = 'ARRAY' UNION ALL SELECT n, height, json_extract(c, '$."' || k || '"'), k FROM (SELECT n, height, c, unnest(json_keys(c)) AS k FROM c WHERE json_type(c) = 'OBJECT'))
        , b AS (SELECT n, height, lower(trim(coalesce(CASE WHEN json_type(x, '$.category') = 'VARCHAR' THEN json_extract_string(x, '$.category') END, CASE WHEN json_type(x, '$.furniture_category') = 'VARCHAR' THEN json_extract_string(x, '$.furniture_category') END, ''))) AS kind, coalesce(k, json_extract_string(x, '$.id'), json_extract_string(x, '$.furniture_instance_id')) AS id,
            CASE WHEN json_type(x, '$.size') = 'ARRAY' THEN [TRY_CAST(json_extract(x, '$.size[' || i || ']') AS DOUBLE) for i in [0, 1, 2]] ELSE [TRY_CAST(json_extract(x, '$.furniture_size.' || f) AS DOUBLE) for f in ['width', 'length', 'height']] END AS s,
            CASE WHEN json_type(x, '$.pos') = 'ARRAY' THEN [TRY_CAST(json_extract(x, '$.pos[' || i || ']') AS DOUBLE) for i in [0, 1, 2]] ELSE [TRY_CAST(json_extract(x, '$.furniture_position.' || f) AS DOUBLE) for f in ['x', 'y', 'z']] END AS p,
            coalesce(TRY_CAST(json_extract(x, '$.yaw') AS DOUBLE), TRY_CAST(json_extract(x, '$.furniture_rotation.z') AS DOUBLE)) AS yaw FROM e WHERE json_type(x) = 'OBJECT')
        , g AS (SELECT * FROM b WHERE id IS NOT NULL AND yaw IS NOT NULL AND s[1] > 0 AND s[2] > 0 AND s[3] > 0 AND p[1] IS NOT NULL AND p[2] IS NOT NULL AND p[3] IS NOT NULL)"""
_LABEL = "coalesce(json_extract_string(x, '$.category'), json_extract_string(x, '$.furniture_category'))"
ORACLES = {
    "room_heights": _BOXES + """
        , t AS (SELECT n, count(*) AS objects, count(*) FILTER (height <> 0 AND p[3] + s[3] > height + 0.05) AS above FROM g GROUP BY 1)
        SELECT DISTINCT v.uid, CAST(coalesce(objects, 0) AS INTEGER) AS objects, CAST(coalesce(above, 0) AS INTEGER) AS above FROM v LEFT JOIN t USING (n)""",
    "room_order": _BOXES + """
        , o AS (SELECT g.*, v.uid, row_number() OVER (PARTITION BY g.n ORDER BY -round(s[1] * s[2], 6), kind, -s[3], p[3], p[1], p[2], id) - 1 AS place FROM g JOIN v USING (n))
        SELECT DISTINCT uid, CAST(place AS INTEGER) AS place, id AS object_id FROM o""",
    "room_quarters": _BOXES + """
        , b1 AS (SELECT n, CASE WHEN json_type(j, '$.boundary') = 'ARRAY' AND json_array_length(j, '$.boundary') > 0 THEN json_extract(j, '$.boundary[*]') ELSE json_extract(j, '$.rooms[0].room_boundary[*]') END AS b FROM v)
        , b2 AS (SELECT n, TRY_CAST(json_extract(q, '$[0]') AS DOUBLE) AS x, TRY_CAST(json_extract(q, '$[1]') AS DOUBLE) AS y FROM (SELECT n, unnest(b) AS q FROM b1))
        , b3 AS (SELECT n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM b2 WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) > 2)
        , q AS (SELECT v.uid, g.n, t, CASE t WHEN 1 THEN y1 - p[2] WHEN 2 THEN x1 - p[1] ELSE p[2] - y0 END AS x, CASE t WHEN 1 THEN p[1] - x0 WHEN 2 THEN y1 - p[2] ELSE x1 - p[1] END AS y FROM g JOIN b3 USING (n) JOIN v USING (n), (SELECT unnest([1, 2, 3]) AS t))
        SELECT DISTINCT uid, t AS turns, x, y FROM (SELECT uid, n, t, round(sum(x), 3) AS x, round(sum(y), 3) AS y FROM q GROUP BY 1, 2, 3)""",
    "room_content_classes": _BOXES + """
        , k1 AS (SELECT n, list_sort(list(list_sort([round_even(x / 0.05, 0) for x in s]))) AS key FROM g GROUP BY n HAVING count(*) >= 3)
        SELECT min(v.uid) AS first_uid, count(DISTINCT v.uid) AS rooms, count(DISTINCT v.source) AS sources FROM k1 JOIN v USING (n) GROUP BY key HAVING count(DISTINCT v.uid) > 1""",
    "room_labels": ELEMENTS + f"""
        , l1 AS (SELECT DISTINCT {_LABEL} AS label FROM w WHERE section = 'objects' AND {_LABEL} IS NOT NULL AND own IS NOT NULL)
        , l2 AS (SELECT label, coalesce((SELECT MAP {{'corner/side table': 'side table', 'three-seat / multi-seat sofa': 'three seat sofa', 'three-seat / multi-person sofa': 'three seat sofa', 'coffeetablefactory': 'coffee table', 'sidetablefactory': 'side table', 'boxcomforterfactory': 'comforter', 'comforterfactory': 'comforter'}}[trim(split_part(lower(label), '(', 1))]), lower(label)) AS n FROM l1)
        , l3 AS (SELECT label, trim(regexp_replace(regexp_extract(n, '^[^,(/]*'), '[^a-z0-9]+', ' ', 'g')) AS n FROM l2)
        , l4 AS (SELECT label, trim(regexp_replace(list_aggregate([CASE WHEN length(x) >= 8 AND regexp_matches(x, '[0-9a-f]{{8}}$') AND regexp_matches(right(x, 8), '[0-9]') THEN left(x, -8) ELSE x END for x in string_split(n, ' ')], 'string_agg', ' '), ' +', ' ', 'g')) AS n FROM l3)
        , l5 AS (SELECT label, split_part(n, ' or ', 1) AS n FROM l4)
        , l6 AS (SELECT label, CASE WHEN regexp_matches(n, '[a-z]( *[0-9]+)+$') THEN regexp_replace(n, '( *[0-9]+)+$', '') ELSE n END AS category FROM l5)
        SELECT label, category, string_split(category, ' ')[-1] AS head, CASE WHEN category = '' OR regexp_matches(category, '^(other[a-z0-9_]*|objects?|unknown)( |$)') THEN 'object' ELSE replace(category, ' ', '_') END AS slug FROM l6""",
}
