"""Shared steps of scene readers on small fixtures."""

import json
import math
import random

from strataloom.functions import geometry as G
from strataloom.sources import scenes


def test_from_export(spark):
    item = lambda i, **kw: {"furniture_instance_id": i, "furniture_category": "Desk", "furniture_position": {"x": 2, "y": 3, "z": 1}, "furniture_rotation": {"x": 0, "y": 0, "z": 90}, "furniture_size": {"width": 1, "length": 2, "height": 1}, **kw}
    text = json.dumps({"rooms": [{"room_id": "r", "room_type": "study", "room_boundary": [[1, 1], [1, 4], [5, 4], [5, 1]], "furniture": [item("a"), item("b", furniture_size=None), item("c", furniture_rotation={"x": 30, "y": 0, "z": 0})]}]})
    df = spark.createDataFrame([("u", text), ("v", None), ("w", "{")], "uid string, row string")
    r = scenes.from_export(df, "row", ["uid"], center_z=True, front_offset=90).collect()
    assert len(r) == 1 and r[0].n_incomplete == 1 and r[0].n_tilted == 1
    assert G.signed_area([tuple(p) for p in r[0].ring]) == 12
    a = r[0].objects[0]
    assert (a.x, a.y, a.z, a.w, a.d) == (1, 2, 0.5, 2, 1) and math.isclose(a.yaw, math.pi)


def test_floor_and_ids(spark):
    boxes = spark.createDataFrame([("s", 0.01), ("s", 0.5), ("s", 2.0), ("t", -0.4), ("t", 1.0)], "scene string, bottom double")
    assert {r.scene: r.floor for r in scenes.floor_height(boxes, "scene", "bottom").collect()} == {"s": 0.0, "t": -0.4}
    rows = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "b", 3)], "scene string, id string, n int")
    assert {(r.id, r.n, r.single) for r in scenes.unique_ids(rows, "scene", "id", ["n"]).collect()} == {("a", 1, False), ("a#2", 2, False), ("b", 3, True)}


def test_located(spark):
    regions = spark.createDataFrame([("s", "A", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]), ("s", "B", [[3.0, 0.0], [9.0, 0.0], [9.0, 4.0], [3.0, 4.0]]), ("t", "C", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])], "scene string, region string, ring array<array<double>>")
    points = spark.createDataFrame([("s", "p", 1.0, 1.0), ("s", "q", 3.5, 1.0), ("s", "r", 20.0, 1.0), ("t", "p", 0.9, 0.2)], "scene string, id string, x double, y double")
    got = {(r.scene, r.id): (r.region, r.reason) for r in scenes.located(points, regions, "scene", "id", "region").collect()}
    assert got == {("s", "p"): ("A", None), ("s", "q"): (None, "ambiguous"), ("s", "r"): (None, "outside"), ("t", "p"): ("C", None)}


def test_twins_and_hulls(spark):
    boxes = spark.createDataFrame([("s", 1, 0, 0, 2, 2, 0, 2), ("s", 2, 0, 0, 2, 2, 1, 3), ("s", 3, 9, 9, 10, 10, 0, 1), ("s", 4, 0, 0, 1, 1, 3, 4)], "scene string, id long, x0 long, y0 long, x1 long, y1 long, z0 long, z1 long")
    assert [(r.a, r.b, r.volume) for r in scenes.twins(boxes, "scene", "id").collect()] == [(1, 2, 4)]
    pick = random.Random(1)
    points = [(f"s{i % 3}", pick.random(), pick.random()) for i in range(300)]
    got = {r.scene: [tuple(p) for p in r.ring] for r in scenes.hulls(spark.createDataFrame(points, "scene string, x double, y double").repartition(4), "scene").collect()}
    for s in ("s0", "s1", "s2"):
        assert sorted(got[s]) == sorted(G.hull([(x, y) for k, x, y in points if k == s]))


def test_occurrence_links_and_votes(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30)], "k string, m int")
    assert {(r.n, r.m) for r in scenes.by_occurrence(left, right, ["k"], ["n"], ["m"]).collect()} == {(1, 10), (2, 20), (3, None)}
    walls = spark.createDataFrame([("s", "r1", "p", 7), ("s", "r1", "q", 7), ("s", "r2", "p", 8)], "scene string, room string, plane string, line long")
    holes = spark.createDataFrame([("s", "door", 7), ("s", "door", 9), ("s", "win", 9)], "scene string, opening string, line long")
    assert {tuple(r) for r in scenes.opening_links(holes, walls).collect()} == {("s", "r1", "door")}
    source = [("h", f"a{i}", i * 1.7, i * 0.9) for i in range(8)]
    placed = [("h", a, x + 2.0 + (0.009 if i % 2 else -0.009), y - 1.0) for i, (_, a, x, y) in enumerate(source)] + [("h", "a1", 50.0, 50.0)]
    r = scenes.shift_votes(spark.createDataFrame(placed, "house string, asset string, x double, y double"), spark.createDataFrame(source, "house string, asset string, x double, y double")).collect()[0]
    assert r.votes == 8 and abs(r.dx - 2) < 0.02 and abs(r.dy + 1) < 0.02


def test_upright():
    size, bottom, yaw = scenes.upright([2, 3, 1], [0.4, 0.5, 0.2], [[0, -1, 0], [0, 0, 1], [1, 0, 0]])
    assert size == [0.8, 0.4, 1.0] and bottom == [2, 3, 0.5] and math.isclose(yaw, -math.pi / 2)
    s = math.sqrt(0.5)
    assert scenes.upright([0, 0, 0], [1, 1, 1], [[s, 0, s], [0, 1, 0], [-s, 0, s]]) is None
