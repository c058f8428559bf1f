"""Exports of scenes to one room form: shared steps of the readers of many sources.

Steps are column expressions or joins wherever they can be; rings and hulls go through Arrow passes. Hulls are merged from
the hulls of tasks, so no scene is held whole.

Defined cases: boxes without size or place are counted as incomplete and left out; a ring of no area gives NULL; points on no region are ``outside``,
points on several ``ambiguous``; repeated ids get a running suffix; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import geometry as G
from strataloom.operators.relate import best_candidate, overlapping_pairs
from strataloom.runtime import map_records

EXPORT = "rooms array<struct<room_id:string,room_type:string,room_boundary:array<array<double>>,furniture:array<struct<furniture_instance_id:string,furniture_category:string,furniture_position:struct<x:double,y:double,z:double>,furniture_rotation:struct<x:double,y:double,z:double>,furniture_size:struct<width:double,length:double,height:double>>>>>"


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of points, by the products of neighbours."""
    turn = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring), F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    return F.aggregate(F.zip_with(ring, turn, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, v: s + v) / 2


def from_export(rows: DataFrame, text: str, key: list[str], center_z: bool = False, front_offset: int = 0) -> DataFrame:
    """Rooms of the export form: anchored at the lower corner, counter-clockwise, bottoms instead of centres, fronts turned to +x.

    A front offset of a quarter turn swaps width and depth. Counts of tilted and incomplete boxes come along. No Python is involved.
    """
    room = F.explode(F.from_json(text, EXPORT)["rooms"])
    opened = rows.select(*key, room.alias("r")).select(*key, "r.*")
    low = lambda i: F.array_min(F.transform("room_boundary", lambda p: p[i]))
    moved = opened.withColumn("x0", low(0)).withColumn("y0", low(1))
    ring = F.transform("room_boundary", lambda p: F.array(F.round(p[0] - F.col("x0"), 6), F.round(p[1] - F.col("y0"), 6)))
    whole = lambda f: f["furniture_size"].isNotNull() & f["furniture_position"].isNotNull() & (F.least(f["furniture_size"]["width"], f["furniture_size"]["length"], f["furniture_size"]["height"]) > 0)
    swap = front_offset % 180 != 0

    def box(f):
        w, d = (f["furniture_size"]["length"], f["furniture_size"]["width"]) if swap else (f["furniture_size"]["width"], f["furniture_size"]["length"])
        z = f["furniture_position"]["z"] - (f["furniture_size"]["height"] / 2 if center_z else F.lit(0.0))
        yaw = F.radians(F.pmod(f["furniture_rotation"]["z"] + F.lit(float(front_offset)), F.lit(360.0)))
        return F.struct(f["furniture_instance_id"].alias("id"), F.lower(f["furniture_category"]).alias("kind"), (f["furniture_position"]["x"] - F.col("x0")).alias("x"), (f["furniture_position"]["y"] - F.col("y0")).alias("y"), z.alias("z"), w.alias("w"), d.alias("d"), f["furniture_size"]["height"].alias("h"), yaw.alias("yaw"))

    boxes = F.transform(F.filter("furniture", whole), box)
    tilted = F.size(F.filter("furniture", lambda f: (F.abs(f["furniture_rotation"]["x"]) > 1) | (F.abs(f["furniture_rotation"]["y"]) > 1)))
    out = moved.select(*key, "room_id", "room_type", ring.alias("ring"), boxes.alias("objects"), tilted.alias("n_tilted"), (F.size("furniture") - F.size(F.filter("furniture", whole))).alias("n_incomplete"))
    return out.withColumn("ring", F.when(ring_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring")))


def floor_height(boxes: DataFrame, scene: str, bottom: str, share: float = 0.05, snap: float = 0.02) -> DataFrame:
    """Floor of each scene: the bottom at position int(share * n) of the sorted bottoms, 0 where it lies within ``snap`` of it."""
    from strataloom.operators.aggregate import nearest_rank

    return nearest_rank(boxes, [scene], bottom, {"floor": share}).withColumn("floor", F.when(F.abs("floor") <= snap, F.lit(0.0)).otherwise(F.col("floor")))


def located(points: DataFrame, regions: DataFrame, scene: str, key: str, region: str, cell: float = 2.0) -> DataFrame:
    """(scene, key, region, reason) of points (x, y) in regions (ring): inside exactly one, else NULL and why.

    Points meet only the regions whose bounds touch their cell of a grid.
    """
    bound = lambda f, i: f(F.transform("ring", lambda p: p[i]))
    spread = regions.select(scene, F.col(region).alias("_region"), "ring", F.explode(F.sequence(F.floor(bound(F.array_min, 0) / cell), F.floor(bound(F.array_max, 0) / cell))).alias("_cx"), F.floor(bound(F.array_min, 1) / cell).alias("_y0"), F.floor(bound(F.array_max, 1) / cell).alias("_y1")).withColumn("_cy", F.explode(F.sequence("_y0", "_y1")))
    celled = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    met = celled.join(spread, [scene, "_cx", "_cy"]).select(F.col(scene).cast("string").alias("s"), F.col(key).cast("string").alias("k"), "x", "y", F.col("_region").cast("string").alias("r"), "ring")

    def make():
        return lambda v: [(v[0], v[1], v[4])] if G.inside((v[2], v[3]), v[5]) else []

    hits = map_records(met, "s string, k string, r string", make).groupBy("s", "k").agg(F.min("r").alias("r"), F.count_distinct("r").alias("n"))
    ids = points.select(F.col(scene).cast("string").alias("s"), F.col(key).cast("string").alias("k")).distinct()
    found = ids.join(hits, ["s", "k"], "left")
    return found.select(F.col("s").alias(scene), F.col("k").alias(key), F.when(F.col("n") == 1, F.col("r")).alias(region), F.when(F.col("n").isNull(), "outside").when(F.col("n") > 1, "ambiguous").alias("reason"))


def twins(boxes: DataFrame, scene: str, key: str, share: float = 0.3, cell: int = 2) -> DataFrame:
    """Pairs of upright boxes of a scene that share more than ``share`` of the smaller volume; columns x0..z1."""
    pairs = overlapping_pairs(boxes, scene, key, cell, keep=["z0", "z1"])
    tall = F.least("z1_a", "z1_b") - F.greatest("z0_a", "z0_b")
    volume = lambda s: (F.col(f"x1_{s}") - F.col(f"x0_{s}")) * (F.col(f"y1_{s}") - F.col(f"y0_{s}")) * (F.col(f"z1_{s}") - F.col(f"z0_{s}"))
    shared = F.col("area") * tall
    return pairs.where((tall > 0) & (shared > share * F.least(volume("a"), volume("b")))).select(scene, F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), shared.alias("volume"))


def hulls(points: DataFrame, scene: str) -> DataFrame:
    """Convex hull of the points (x, y) of each scene: hulls of what each task saw, then the hull of those."""
    schema = f"{scene} string, x double, y double"

    def partial(frames):
        import pandas as pd

        held: dict = {}
        for pdf in frames:
            for key, part in pdf.groupby(scene):
                held[key] = G.hull([*held.get(key, []), *zip(part["x"], part["y"])])
            if len(held) > 5000:
                yield pd.DataFrame([(k, x, y) for k, r in held.items() for x, y in r], columns=[scene, "x", "y"])
                held = {}
        yield pd.DataFrame([(k, x, y) for k, r in held.items() for x, y in r], columns=[scene, "x", "y"])

    few = points.select(F.col(scene).cast("string").alias(scene), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null").mapInPandas(partial, schema)
    grouped = few.groupBy(scene).agg(F.collect_list(F.array("x", "y")).alias("points"))

    def make():
        return lambda v: [(v[0], [list(p) for p in G.hull(v[1])])]

    return map_records(grouped, f"{scene} string, ring array<array<double>>", make)


def by_occurrence(left: DataFrame, right: DataFrame, on: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of a key on one side with the n-th on the other; rows without partner keep NULLs."""
    number = lambda order: F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return left.withColumn("nth", number(left_order)).join(right.withColumn("nth", number(right_order)), [*on, "nth"], "left")


def unique_ids(rows: DataFrame, scene: str, key: str, order: list[str]) -> DataFrame:
    """Repeated ids of a scene with a suffix #k from the second on; ``single`` tells whether the id occurs once, as a parent must."""
    own = Window.partitionBy(scene, key)
    k = F.row_number().over(own.orderBy(*order))
    return rows.withColumn("single", F.count(F.lit(1)).over(own) == 1).withColumn("_k", k).withColumn(key, F.when(F.col("_k") == 1, F.col(key)).otherwise(F.concat(F.col(key).cast("string"), F.lit("#"), F.col("_k").cast("string")))).drop("_k")


def opening_links(incidence: DataFrame, walls: DataFrame) -> DataFrame:
    """(scene, room, opening) of openings that share a line with a wall plane of a room.

    ``incidence`` holds (scene, opening, line) and ``walls`` (scene, room, plane, line).
    """
    return incidence.join(walls.select("scene", "room", "line").distinct(), ["scene", "line"]).select("scene", "room", "opening").distinct()


def shift_votes(placed: DataFrame, source: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """For each house the offset (dx, dy) that most placements of an asset agree on, within the tolerance; first offset on ties.

    Offsets are counted in cells of the tolerance, then once more over the nine cells around each, so no border splits a vote.
    """
    both = placed.select("house", "asset", F.col("x").alias("x1"), F.col("y").alias("y1")).join(source.select("house", "asset", F.col("x").alias("x2"), F.col("y").alias("y2")), ["house", "asset"])
    cells = both.groupBy("house", F.floor((F.col("x1") - F.col("x2")) / tolerance).alias("cx"), F.floor((F.col("y1") - F.col("y2")) / tolerance).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x1") - F.col("x2")).alias("dx"), F.avg(F.col("y1") - F.col("y2")).alias("dy"))
    around = cells.select("house", "n", F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).groupBy("house", "c.cx", "c.cy").agg(F.sum("n").alias("votes"))
    voted = cells.join(around, ["house", "cx", "cy"])
    return best_candidate(voted, ["house"], F.struct(-F.col("votes"), -F.col("n"), "cx", "cy"), ["dx", "dy", "votes"])


def upright(center, half, axes, tolerance=math.radians(5)):
    """(size, bottom centre, yaw) of an oriented box one of whose axes stands upright; None if none does within the tolerance."""
    up = max(range(3), key=lambda i: abs(axes[i][2]))
    if abs(axes[up][2]) < math.cos(tolerance):
        return None
    front, side = [i for i in range(3) if i != up]
    size = [2 * half[front], 2 * half[side], 2 * half[up]]
    return size, [center[0], center[1], center[2] - half[up]], math.atan2(axes[front][1], axes[front][0])


def box_bounds(size, linear, yaw_deg):
    """Extents of a box under a linear map, along axes turned by ``yaw_deg`` about z; None for unusable numbers or a map without volume."""
    if not (isinstance(size, list) and len(size) == 3 and isinstance(yaw_deg, (int, float)) and all(isinstance(v, (int, float)) and math.isfinite(v) for v in [*size, yaw_deg, *(v for row in linear for v in row)])) or min(size) <= 0:
        return None
    (a, b, c), (d, e, f), (g, h, i) = linear
    lengths = [math.hypot(*column) for column in zip(*linear)]
    if min(lengths) == 0 or abs(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)) <= 1e-12 * math.prod(lengths):
        return None
    co, si = math.cos(math.radians(yaw_deg)), math.sin(math.radians(yaw_deg))
    rows = [[co * x + si * y for x, y in zip(linear[0], linear[1])], [co * y - si * x for x, y in zip(linear[0], linear[1])], linear[2]]
    return [sum(abs(v) * s for v, s in zip(row, size)) for row in rows]
