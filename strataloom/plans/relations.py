"""Queries of joins, spatial pairs, filters with reasons and reconciliation.

Rooms and boxes are made of lineitem: an order is a room, a line a box with whole centimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import hierarchy
from strataloom.operators import relate as R
from strataloom.operators.ranking import ordered
from strataloom.runtime import table


def boxes(spark: SparkSession, root: str) -> DataFrame:
    """(room, box, kind, x0, y0, x1, y1, z0, z1, area) in whole centimetres."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).distinct()
    x, y, z = F.col("l_partkey") * 7 % 500, F.col("l_suppkey") * 13 % 400, (F.col("l_partkey") % 3) * 40
    w, d, h = 20 + F.col("q") * 2, 20 + F.col("l_linenumber").cast("long") * 10, 40 + F.col("l_linenumber").cast("long") * 5
    name = F.format_string("%d-%d-%d-%d", F.col("l_linenumber").cast("long"), "l_partkey", "l_suppkey", "q")
    return lines.select(F.col("l_orderkey").alias("room"), name.alias("box"), (F.col("l_partkey") % 11).alias("kind"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + d).alias("y1"), z.alias("z0"), (z + h).alias("z1"), (w * d).alias("area"))


def room_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Share of the footprint of a room that overlaps, in whole millionths (rounded half up on whole numbers), and its collisions (overlap in height too)."""
    b = boxes(spark, root)
    pairs = R.overlapping_pairs(b.drop("area"), "room", "box", 200, keep=["z0", "z1"])
    tall = F.least("z1_a", "z1_b") - F.greatest("z0_a", "z0_b") > 5
    per = pairs.groupBy("room").agg(F.sum("area").alias("shared"), F.count(F.when(tall & (F.col("area") > 100), 1)).alias("collisions"))
    both = b.groupBy("room").agg(F.sum("area").alias("whole"), F.count(F.lit(1)).alias("boxes")).join(per, "room", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return both.select("room", "boxes", F.coalesce("collisions", F.lit(0)).alias("collisions"), F.expr("(shared * 2000000 + whole) div (2 * whole)").alias("overlap_millionths"))


def same_kind_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Boxes of one kind that share more than 30% of the smaller one, within a factor three of size."""
    b = boxes(spark, root).withColumnRenamed("area", "size")
    pairs = R.overlapping_pairs(b, "room", "box", 200, keep=["kind", "size"]).where("kind_a = kind_b")
    small, big = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    return pairs.where((F.col("area") > 0.3 * small) & (big <= 3 * small)).select("room", "box_a", "box_b", "area")


def support_below(spark: SparkSession, root: str) -> DataFrame:
    """The highest box under the centre of each box whose top lies within 15 cm of its bottom and that covers half of it."""
    b = boxes(spark, root).withColumnRenamed("area", "size")
    pairs = R.overlapping_pairs(b, "room", "box", 200, keep=["z0", "z1", "size"])
    ab = pairs.select("room", F.col("box_a").alias("box"), F.col("z0_a").alias("bottom"), F.col("size_a").alias("size"), F.col("box_b").alias("support"), F.col("z1_b").alias("top"), "area")
    ba = pairs.select("room", F.col("box_b"), F.col("z0_b"), F.col("size_b"), F.col("box_a"), F.col("z1_a"), "area")
    fits = ab.union(ba).where((F.abs(F.col("bottom") - F.col("top")) <= 15) & (F.col("bottom") > 0) & (F.col("area") * 2 >= F.col("size")))
    return R.best_candidate(fits, ["room", "box"], F.struct("top", "support"), ["support", "top"], largest=True)


def support_chains(spark: SparkSession, root: str) -> DataFrame:
    """Root and depth of every part, if part k rests on part k / 3."""
    edges = table(spark, root, "part").select(F.lit("all").alias("g"), F.col("p_partkey").cast("string").alias("n"), F.when(F.col("p_partkey") % 7 != 0, F.floor(F.col("p_partkey") / 3)).cast("string").alias("p"))
    done = hierarchy.resolve(edges, "g", "n", "p")
    return done.select(F.col("n").cast("long").alias("part"), F.col("root_id").cast("long").alias("top"), F.col("depth").cast("long").alias("depth"))


def drop_dependants(spark: SparkSession, root: str) -> DataFrame:
    """Parts that stay when bad parts go with everything that rests on them."""
    parts = table(spark, root, "part").select(F.lit("all").alias("g"), F.col("p_partkey").cast("string").alias("n"), F.when(F.col("p_partkey") % 7 != 0, F.floor(F.col("p_partkey") / 3)).cast("string").alias("p"), (F.col("p_size") == 13).alias("bad"))
    paths = hierarchy.resolve(parts, "g", "n", "p").select("n", F.explode("path").alias("above"))
    gone = paths.join(parts.where("bad").select(F.col("n").alias("above")), "above", "left_semi").select("n").distinct()
    return parts.join(gone, "n", "left_anti").groupBy().agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("n").cast("long")).alias("checksum"))


def nearest_size(spark: SparkSession, root: str) -> DataFrame:
    """For every part the nearest other part of its name, by the sum of log ratios; the search widens until each nearest is proven."""
    return R.nearest_by_log_size(table(spark, root, "part"), "p_partkey", "p_name", ("p_size", "p_retailprice"))


def offset_votes(spark: SparkSession, root: str) -> DataFrame:
    """The shift between all placements of two sets that most of the first agree on, within 25 of it; ties go to the smaller shift."""
    left = table(spark, root, "supplier").select(F.col("s_nationkey").alias("asset"), F.floor("s_acctbal").alias("x"))
    right = table(spark, root, "customer").select(F.col("c_nationkey").alias("asset"), F.floor("c_acctbal").alias("x2"))
    votes = R.shift_votes(left, right, "asset", "x", "x2", 25)
    return votes.agg(F.max_by("shift", F.struct("votes", -F.col("shift"))).alias("shift"), F.max("votes").alias("votes"), F.count(F.lit(1)).alias("shifts"))


def line_forest(spark: SparkSession, root: str) -> DataFrame:
    """Trees of all order lines in one locality, larger than a fragment: a line rests on the line before it, the first of an order on the first of order k / 3."""
    lines = table(spark, root, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).distinct()
    name = lambda order, n: F.concat_ws("-", order.cast("string"), n.cast("string"))
    up = F.when(F.col("n") > 1, name(F.col("l_orderkey"), F.col("n") - 1)).when(F.col("l_orderkey") > 0, name(F.floor(F.col("l_orderkey") / 3), F.lit(1)))
    done = hierarchy.resolve(lines.select(F.lit("all").alias("g"), name(F.col("l_orderkey"), F.col("n")).alias("line"), up.alias("up")), "g", "line", "up")
    return done.select("line", "root_id", F.col("depth").cast("long").alias("depth"))


def reject_reasons(spark: SparkSession, root: str) -> DataFrame:
    """First rule that refuses a line, counted."""
    reason = F.when(F.col("l_quantity").isNull(), "bad_numbers").when(F.col("l_extendedprice") <= 0, "bad_numbers").when(F.col("l_quantity") > 48, "object_count").when(F.col("l_discount") >= 0.1, "flagged:discount").when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06), "flagged:return")
    return table(spark, root, "lineitem").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def flag_filter(spark: SparkSession, root: str) -> DataFrame:
    """Documents none of whose flags is excluded; flags are a map, a flag counts if it isn't zero."""
    flags = F.create_map(F.lit("long"), (F.col("n_chars") > 800).cast("double"), F.lit("no_lang"), F.col("lang").isNull().cast("double"), F.lit("words"), F.col("n_chars") / 1000)
    held = F.map_keys(F.map_filter(flags, lambda k, v: v != 0))
    return table(spark, root, "documents").where(~F.arrays_overlap(held, F.array(F.lit("long"), F.lit("no_lang")))).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


def mask_journal(spark: SparkSession, root: str) -> DataFrame:
    """Fields whose validity is taken back, one row for each change."""
    before = F.struct((F.col("l_discount") >= 0).alias("position"), (F.col("l_quantity") > 2).alias("size"), (F.col("l_linenumber") < 7).alias("yaw"))
    after = F.struct(((F.col("l_discount") >= 0) & (F.col("l_tax") < 0.07)).alias("position"), ((F.col("l_quantity") > 2) & (F.col("l_returnflag") != "R")).alias("size"), (F.col("l_linenumber") < 7).alias("yaw"))
    rows = table(spark, root, "lineitem").select("l_linestatus", before.alias("before"), after.alias("after"))
    changes = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"before.{c}").alias("was"), F.col(f"after.{c}").alias("now")) for c in ("position", "size", "yaw")]), lambda s: s["was"] != s["now"])
    return rows.select("l_linestatus", F.explode(changes).alias("c")).groupBy("l_linestatus", F.col("c.field").alias("field")).agg(F.count(F.lit(1)).alias("changes"))


def unique_keys(spark: SparkSession, root: str) -> DataFrame:
    """Keys that aren't unique, by how often they occur."""
    counts = table(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("times"))
    return counts.groupBy("times").agg(F.count(F.lit(1)).alias("keys"))


def id_sets(spark: SparkSession, root: str) -> DataFrame:
    """Orders whose set of parts differs between returned and other lines."""
    sets = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("b"))
    missing, extra = F.size(F.array_except("b", "a")).cast("long"), F.size(F.array_except("a", "b")).cast("long")
    return sets.select(missing.alias("missing"), extra.alias("extra")).groupBy("missing", "extra").agg(F.count(F.lit(1)).alias("orders"))


def height_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Boxes that reach above the ceiling of their room, and by how much."""
    ceiling = 110 + F.col("room") % 20
    return boxes(spark, root).groupBy("room").agg(F.count(F.when(F.col("z1") > ceiling, 1)).alias("above"), F.max(F.col("z1") - ceiling).alias("excess")).where("above > 0")


def range_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Lines whose quantity leaves reference * exp(+-1.2), by part class."""
    rows = table(spark, root, "lineitem").join(table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    out = F.abs(F.log(F.col("l_quantity") / F.col("p_size"))) > 1.2
    return rows.groupBy((F.col("l_partkey") % 5).alias("part_class")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(out, 1)).alias("conflicts"))


def full_reconciliation(spark: SparkSession, root: str) -> DataFrame:
    """States of two views of the orders."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 0).alias("price"))
    a = orders.where("o_orderkey % 17 <> 0")
    b = orders.where("o_orderkey % 13 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 11 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return R.reconciled(a, b, ["o_orderkey"], ["o_orderstatus", "price"]).groupBy("state").agg(F.count(F.lit(1)).alias("orders"))


def patch_overlay(spark: SparkSession, root: str) -> DataFrame:
    """Recorded corrections put over suppliers."""
    rows = table(spark, root, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    patches = rows.where("s_suppkey % 4 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 8 == 0, F.col("s_nationkey") + 100).alias("s_nationkey"), F.col("s_acctbal"))
    return R.patched(rows, patches, ["s_suppkey"], ["s_nationkey", "s_acctbal"])


def aligned_arrays(spark: SparkSession, root: str) -> DataFrame:
    """Arrays joined by position: lines of an order against the order's own list, with proof of equality."""
    lines = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    zipped = lines.select("l_orderkey", F.posexplode(F.arrays_zip(F.col("a.l_partkey").alias("p"), F.transform("a", lambda x: x["l_suppkey"]).alias("s"))).alias("at", "v"))
    return zipped.groupBy("at").agg(F.count(F.lit(1)).alias("rows"), F.sum("v.p").alias("parts"), F.sum("v.s").alias("suppliers")).withColumn("at", F.col("at").cast("long"))


def positional_zip(spark: SparkSession, root: str) -> DataFrame:
    """Rows of two streams joined by split and place in it; how many differ in anything but one field."""
    base = ordered(table(spark, root, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority"), ["o_orderstatus"], ["o_orderkey"]).withColumnRenamed("rank", "at")
    a = base.select("o_orderstatus", "at", "o_orderkey", "o_orderpriority")
    b = base.select("o_orderstatus", "at", F.col("o_orderkey").alias("k2"), F.when(F.col("at") % 50 == 0, F.lit("changed")).otherwise(F.col("o_orderpriority")).alias("p2"))
    return a.join(b, ["o_orderstatus", "at"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("o_orderkey") != F.col("k2"), 1)).alias("moved"), F.count(F.when(F.col("o_orderpriority") != F.col("p2"), 1)).alias("changed"))


def shared_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of 20 cm that more than one box of a room fills."""
    b = boxes(spark, root)
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / 20), F.floor((F.col(hi) - 1) / 20))
    cells = b.withColumn("cx", F.explode(steps("x0", "x1"))).withColumn("cy", F.explode(steps("y0", "y1")))
    filled = cells.groupBy("room", "cx", "cy").agg(F.count(F.lit(1)).alias("held"))
    return filled.groupBy("room").agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("held") > 1, 1)).alias("shared"))


QUERIES = {f.__name__: f for f in (room_overlap, same_kind_overlap, support_below, support_chains, drop_dependants, nearest_size, offset_votes, line_forest, reject_reasons, flag_filter, mask_journal, unique_keys, id_sets, height_conflicts, range_conflicts, full_reconciliation, patch_overlay, aligned_arrays, positional_zip, shared_cells)}

_B = """WITH l AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
, b AS (SELECT l_orderkey AS room, format('{}-{}-{}-{}', ln, l_partkey, l_suppkey, q) AS box, l_partkey % 11 AS kind, l_partkey * 7 % 500 AS x0, l_suppkey * 13 % 400 AS y0, l_partkey * 7 % 500 + 20 + q * 2 AS x1, l_suppkey * 13 % 400 + 20 + ln * 10 AS y1, l_partkey % 3 * 40 AS z0, l_partkey % 3 * 40 + 40 + ln * 5 AS z1, (20 + q * 2) * (20 + ln * 10) AS area FROM l)
, p AS (SELECT a.room, a.box AS box_a, b.box AS box_b, a.kind AS kind_a, b.kind AS kind_b, a.area AS size_a, b.area AS size_b, a.z0 AS z0_a, a.z1 AS z1_a, b.z0 AS z0_b, b.z1 AS z1_b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM b a JOIN b ON a.room = b.room AND a.box < b.box AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))"""
_CHAIN = "WITH RECURSIVE e AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey // 3 END AS p, p_size = 13 AS bad FROM part)"
ORACLES = {
    "room_overlap": _B + ", s AS (SELECT room, sum(area) AS shared, count(*) FILTER (least(z1_a, z1_b) - greatest(z0_a, z0_b) > 5 AND area > 100) AS collisions FROM p GROUP BY 1), w AS (SELECT room, sum(area) AS whole, count(*) AS boxes FROM b GROUP BY 1) SELECT room, boxes, coalesce(collisions, 0) AS collisions, CAST((coalesce(shared, 0) * 2000000 + whole) // (2 * whole) AS BIGINT) AS overlap_millionths FROM w LEFT JOIN s USING (room)",
    "same_kind_overlap": _B + " SELECT room, box_a, box_b, area FROM p WHERE kind_a = kind_b AND area > 0.3 * least(size_a, size_b) AND greatest(size_a, size_b) <= 3 * least(size_a, size_b)",
    "support_below": _B + ", c AS (SELECT room, box_a AS box, z0_a AS bottom, size_a AS size, box_b AS support, z1_b AS top, area FROM p UNION ALL SELECT room, box_b, z0_b, size_b, box_a, z1_a, area FROM p), f AS (SELECT * FROM c WHERE abs(bottom - top) <= 15 AND bottom > 0 AND area * 2 >= size) SELECT room, box, first(support ORDER BY top DESC, support DESC) AS support, max(top) AS top FROM f GROUP BY 1, 2",
    "support_chains": _CHAIN + ", r AS (SELECT n, n AS top, CAST(0 AS BIGINT) AS depth FROM e WHERE p IS NULL UNION ALL SELECT e.n, r.top, r.depth + 1 FROM r JOIN e ON e.p = r.n) SELECT n AS part, top, depth FROM r",
    "drop_dependants": _CHAIN + ", g AS (SELECT n FROM e WHERE bad UNION SELECT e.n FROM g JOIN e ON e.p = g.n) SELECT count(*) AS kept, CAST(sum(n) AS BIGINT) AS checksum FROM e WHERE n NOT IN (SELECT n FROM g)",
    "nearest_size": "WITH c AS (SELECT a.p_partkey, b.p_partkey AS ref, round(abs(ln(a.p_size) - ln(b.p_size)) + abs(ln(a.p_retailprice) - ln(b.p_retailprice)), 9) AS cost FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey) SELECT p_partkey, first(ref ORDER BY cost, ref) AS ref, min(cost) AS cost FROM c GROUP BY 1",
    "offset_votes": "WITH a AS (SELECT s_suppkey AS k, s_nationkey AS asset, floor(s_acctbal) AS x FROM supplier), b AS (SELECT DISTINCT c_nationkey AS asset, floor(c_acctbal) AS x2 FROM customer), m AS (SELECT k, x2 - x AS d FROM a JOIN b USING (asset)), c AS (SELECT DISTINCT d AS shift FROM m), v AS (SELECT DISTINCT k, d + o AS shift FROM m, (SELECT unnest(range(-24, 25)) AS o)), s AS (SELECT c.shift, count(*) AS votes FROM c JOIN v ON v.shift = c.shift GROUP BY 1) SELECT CAST(first(shift ORDER BY votes DESC, shift) AS BIGINT) AS shift, max(votes) AS votes, count(*) AS shifts FROM s",
    "line_forest": "WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n FROM lineitem), e AS (SELECT o || '-' || n AS line, CASE WHEN n > 1 THEN o || '-' || (n - 1) WHEN o > 0 THEN (o // 3) || '-1' END AS up FROM l), r AS (SELECT line, line AS root_id, CAST(0 AS BIGINT) AS depth FROM e WHERE up IS NULL OR up NOT IN (SELECT line FROM e) UNION ALL SELECT e.line, r.root_id, r.depth + 1 FROM r JOIN e ON e.up = r.line) SELECT * FROM r",
    "reject_reasons": "SELECT CASE WHEN l_quantity IS NULL OR l_extendedprice <= 0 THEN 'bad_numbers' WHEN l_quantity > 48 THEN 'object_count' WHEN l_discount >= 0.1 THEN 'flagged:discount' WHEN l_returnflag = 'R' AND l_tax > 0.06 THEN 'flagged:return' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem GROUP BY 1",
    "flag_filter": "SELECT source, count(*) AS kept FROM documents WHERE NOT coalesce(n_chars > 800, false) AND lang IS NOT NULL GROUP BY 1",
    "mask_journal": "WITH c AS (SELECT l_linestatus, 'position' AS field FROM lineitem WHERE l_discount >= 0 AND l_tax >= 0.07 UNION ALL SELECT l_linestatus, 'size' FROM lineitem WHERE l_quantity > 2 AND l_returnflag = 'R') SELECT l_linestatus, field, count(*) AS changes FROM c GROUP BY 1, 2",
    "unique_keys": "SELECT times, count(*) AS keys FROM (SELECT count(*) AS times FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1",
    "id_sets": "WITH s AS (SELECT l_orderkey, l_suppkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey, count(*) FILTER (b AND NOT a) AS missing, count(*) FILTER (a AND NOT b) AS extra FROM s GROUP BY 1) SELECT missing, extra, count(*) AS orders FROM o GROUP BY 1, 2",
    "height_conflicts": _B + " SELECT room, count(*) FILTER (z1 > 110 + room % 20) AS above, max(z1 - (110 + room % 20)) AS excess FROM b GROUP BY 1 HAVING above > 0",
    "range_conflicts": "SELECT l_partkey % 5 AS part_class, count(*) AS n, count(*) FILTER (abs(ln(l_quantity / p_size)) > 1.2) AS conflicts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "full_reconciliation": "SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'only_left' WHEN o_orderkey % 17 = 0 THEN 'only_right' WHEN o_orderkey % 11 = 0 THEN 'differs' ELSE 'same' END AS state, count(*) AS orders FROM orders WHERE o_orderkey % 17 <> 0 OR o_orderkey % 13 <> 0 GROUP BY 1",
    "patch_overlay": "SELECT s_suppkey, CASE WHEN s_suppkey % 8 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey, s_acctbal, s_suppkey % 8 = 0 AS patched FROM supplier",
    "aligned_arrays": "SELECT i - 1 AS at, count(*) AS rows, CAST(sum(p) AS BIGINT) AS parts, CAST(sum(s) AS BIGINT) AS suppliers FROM (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey AS p, l_suppkey AS s FROM lineitem) GROUP BY 1",
    "positional_zip": "SELECT o_orderstatus, count(*) AS rows, CAST(0 AS BIGINT) AS moved, count(*) FILTER (i % 50 = 0) AS changed FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM orders) GROUP BY 1",
    "shared_cells": _B + ", x AS (SELECT room, unnest(range(x0 // 20, (x1 - 1) // 20 + 1)) AS cx, y0, y1 FROM b), c AS (SELECT room, cx, unnest(range(y0 // 20, (y1 - 1) // 20 + 1)) AS cy FROM x), f AS (SELECT room, cx, cy, count(*) AS held FROM c GROUP BY 1, 2, 3) SELECT room, count(*) AS cells, count(*) FILTER (held > 1) AS shared FROM f GROUP BY 1",
}
