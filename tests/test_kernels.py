"""Geometry, room operators, statistics and stateful pieces against closed forms and brute force."""

import json
import math
import random

import numpy as np
import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.functions import geometry as G
from strataloom.functions import labels as plain_labels
from strataloom.functions import text
from strataloom.operators import aggregate as A
from strataloom.operators import relate, rooms
from strataloom.operators import sampling as S
from strataloom.operators import statistics as stats
from strataloom.streaming import ledger

SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_areas_and_overlaps():
    turned = G.corners(1, 1, 2, 2, math.pi / 4)
    assert math.isclose(G.area(turned), 4) and math.isclose(G.shared_area(SQUARE, turned), 8 * (math.sqrt(2) - 1), rel_tol=1e-9)
    assert G.shared_area(SQUARE, [(2, 0), (3, 0), (3, 1), (2, 1)]) == 0 and G.shared_area(SQUARE, [(5, 5), (6, 5), (6, 6), (5, 6)]) == 0
    inner = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)]
    assert math.isclose(G.shared_area(SQUARE, inner), 0.25) and math.isclose(G.overlap_ratio(SQUARE, inner), 0.0625)
    assert math.isclose(G.general_overlap(SQUARE, SQUARE), 1) and G.general_overlap(SQUARE, [(9, 9), (10, 9), (10, 10), (9, 10)]) < 0
    assert math.isclose(G.covered_area([SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)], inner]), 7) and G.covered_area([]) == 0


def test_distances_and_rings():
    assert G.inside((1, 1), SQUARE) and not G.inside((3, 1), SQUARE) and G.outside_by((3, 1), SQUARE) == 1
    assert math.isclose(G.box_distance((3, 3), 1, 1, 2, 2, 0), math.sqrt(2)) and G.box_distance((1, 1), 1, 1, 2, 2, 0.3) == 0
    assert math.isclose(G.gap(SQUARE, [(3, 0), (4, 0), (4, 1), (3, 1)]), 1) and G.gap(SQUARE, [(1, 1), (4, 1), (4, 2), (1, 2)]) == 0
    assert G.clean_ring([(2, 2), (0, 2), (0, 1.004), (0, 0), (2, 0), (2.001, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert G.clean_ring([(0, 0), (1, 0), (2, 0)]) is None
    assert len(G.triangles([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])) == 3
    assert math.isclose(G.least_rectangle(G.corners(5, 5, 3, 1, 0.4))[0], 3)
    assert G.reachable({(0, 0), (0, 1), (2, 2)}, (0, 0)) == {(0, 0), (0, 1)} and G.reachable(set(), (0, 0)) == set()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), min_size=1, max_size=5))
def test_layout_key_ignores_orientation(k, places):
    room = {"outline": [(0, 0), (5, 0), (5, 3), (0, 3)], "objects": [{"x": x / 100, "y": y / 100, "w": 1, "d": 1, "h": 1, "yaw": 0.0} for x, y in places]}
    ring, moved = G.quarter(room["outline"], [(o["x"], o["y"], 1, 1, 0.0) for o in room["objects"]], k)
    other = {"outline": ring, "objects": [{"x": x, "y": y, "w": 1, "d": 1, "h": 1, "yaw": yaw} for x, y, _, _, yaw in moved[::-1]]}
    assert rooms.keys_of(room)[0] == rooms.keys_of(other)[0]


def test_near_pairs_is_complete():
    pick = random.Random(1)
    rings = [G.corners(pick.uniform(0, 9), pick.uniform(0, 9), pick.uniform(0.2, 2), pick.uniform(0.2, 2), pick.uniform(0, 3)) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if G.shared_area(rings[i], rings[j]) > 0}
    assert want <= set(rooms.near_pairs(rings))


def box(name, x, y, z=0.0, size=(1.0, 1.0, 1.0), kind="box", parent=None, anchor=None, yaw=0.0):
    return {"id": name, "category": kind, "size": list(size), "pos": [x, y, z], "yaw": yaw, "parent": parent, "anchor": anchor}


def room(*objects, fixed=(), height=3.0):
    return json.dumps({"boundary": [[0, 0], [5, 0], [5, 5], [0, 5]], "boundary_type": "polygon", "height": height, "objects": list(objects), "fixed": list(fixed)})


def test_room_checks_and_anchors():
    bad = rooms.read_room(room(box("a", 1, 1), box("b", 1.5, 1), box("c", 4.9, 2), box("d", 3, 3, 2.5), box("e", 1, 1, 1.0, (0.2, 0.2, 0.2), parent="a"), box("f", 3, 1, 0.0, (1, 1, 0.02), "rug")))
    n, out, _ = rooms.checked(bad)
    assert n == 6 and out["main"] == 1 and out["severe"] == 1 and out["outside"] == 1 and out["above"] == 1 and out["unsupported"] == 1
    seat = rooms.read_room(room(box("t", 2, 2, kind="table"), box("s", 2.6, 2, kind="chair"), fixed=[box("door", 2, 2.2, kind="door")]))
    assert rooms.checked(seat)[1]["tuck"] == 1 and rooms.checked(seat)[1]["fixed_hits"] == 2
    got = {i: (a, p) for i, a, p, _ in rooms.anchored(rooms.read_room(room(box("a", 1, 1), box("b", 1, 1, 1.0, (0.3, 0.3, 0.3)), box("c", 1, 1, 1.3, (0.1, 0.1, 0.1)), box("l", 3, 3, 2.0, kind="pendant light"), box("p", 3, 1, 1.5, (0.1, 1, 1), "painting"))))}
    assert got == {"a": ("floor", None), "b": ("object", "a"), "c": ("object", "b"), "l": ("ceiling", None), "p": ("wall", None)}


def test_room_relations():
    found = set(rooms.relations_of(rooms.read_room(room(box("chair_1", 1, 1, kind="chair"), box("desk_1", 2.2, 1, kind="desk"), box("w", 0.5, 4, size=(1, 1, 1)), box("m", 3, 4), box("x", 2, 4, size=(0.4, 0.4, 1), kind="crate"), box("x2", 4.2, 4, size=(0.4, 0.4, 1), kind="crate")))))
    assert ("faces", "chair_1", "desk_1", None, None) in found and ("near", "chair_1", "desk_1", None, 0.2) in found
    assert ("against_wall", "w", None, None, None) in found and ("between", "m", "x", "x2", None) in found


def test_settled_keeps_rooms_no_worse():
    before = rooms.read_room(room(box("a", 4.634, 2), box("b", 2.004, 2.006), box("c", 3.0, 2.0)))
    moves = {i: (dx, dy, s) for i, dx, dy, s in rooms.settled(before)}
    assert moves["a"][2] == "pushed" and moves["a"][0] < -0.1 and moves["b"][2] in ("rounded", "kept")


def test_answer_states():
    good = {"placements": [{"id": "a", "pos": [1, 2, 0], "yaw": 0}, {"id": "b", "pos": [1, 2, 1], "yaw": 90, "on": "a"}]}
    say = lambda **kw: json.dumps({"placements": [{**good["placements"][0], **kw}, good["placements"][1]]})
    state = lambda t: rooms.answer_state(t, ["a", "b"])[0]
    assert state(json.dumps(good)) is None and state("<think>x</think> " + json.dumps(good) + " tail") is None
    assert state(None) == state("") == state(json.dumps(good)[:40]) == "truncated_or_bad_json"
    assert state('{"placements": 3}') == "bad_json" and state(say(pos=[1, 2])) == state(say(yaw=True)) == "bad_item"
    assert state(say(pos=[1, 2, 5000])) == "bad_number" and state(say(id="b")) == "duplicate_id" and state(say(id="z")) == "missing_ids"
    assert state(json.dumps({"placements": good["placements"] + [{"id": "c", "pos": [0, 0, 0], "yaw": 0}]})) == "extra_ids" and state(say(on="b")) == "bad_support_ref" and state(say(on="q")) == "bad_support_ref"


def test_label_functions(spark):
    rows = ["Corner/Side Table", "Lounge Chair / Cafe Chair", "glassnightstand5c8f77c6", "TV stand or console", "chair 12", None, "Other furniture"]
    df = spark.createDataFrame([(r,) for r in rows], "c string").select(text.category(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == ["side table", "lounge chair", "glassnightstand", "tv stand", "chair", "", "other furniture"]


def test_spatial_pairs_equal_all_pairs(spark):
    pick = random.Random(2)
    boxes = [(f"r{i % 2}", i, x, y, x + pick.randrange(1, 90), y + pick.randrange(1, 90)) for i, (x, y) in enumerate((pick.randrange(-200, 200), pick.randrange(-200, 200)) for _ in range(80))]
    df = spark.createDataFrame(boxes, "room string, box long, x0 long, y0 long, x1 long, y1 long")
    got = {(r.box_a, r.box_b, r.area) for r in relate.overlapping_pairs(df, "room", "box", 50).collect()}
    want = set()
    for a in boxes:
        for b in boxes:
            w, d = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if a[0] == b[0] and a[1] < b[1] and w > 0 and d > 0:
                want.add((a[1], b[1], w * d))
    assert got == want


def test_aggregate_conventions(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10)] + [("b", None)], "k string, v long")
    got = {r.k: (r.p50, r.top) for r in A.nearest_rank(df, ["k"], "v", {"p50": 0.5, "top": 1.0}).collect()}
    assert got == {"a": (3, 10)}
    row = df.agg(A.rate(F.col("v") > 2).alias("r"), A.rate(F.col("v") > 2, F.col("v") > 100).alias("none")).collect()[0]
    assert math.isclose(row.r, 0.4) and row.none is None


def test_quotas_and_replicas(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 19), ("d", 1)], "k string, n long")
    got = {r.k: r.quota for r in S.largest_remainder(sizes, ["k"], "n", 10).collect()}
    assert got == {"a": 5, "b": 3, "c": 2, "d": 0} and sum(got.values()) == 10
    one = spark.createDataFrame([(0.0,), (0.9,)], "h double")
    assert sorted(r.h for r in S.replicated(one, F.lit(1.5), F.col("h")).collect()) == [0.0, 0.0, 0.9]


def test_statistics(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.03), (3, 0.04), (4, 0.5)], "k long, p double")
    assert [round(r.adjusted, 6) for r in stats.holm(p, "p", "k").orderBy("k").collect()] == [0.04, 0.09, 0.09, 0.5]
    s = spark.createDataFrame([(8, 2), (0, 0), (5, 5), (900, 700)], "w long, l long").select(stats.sign_p(F.col("w"), F.col("l")).alias("p")).collect()
    assert round(s[0].p, 7) == 0.109375 and s[1].p == 1 and s[2].p == 1 and 0 < s[3].p < 1e-5
    tau = stats.kendall(spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 2)], "k long, a long, b long"), "k", "a", "b").collect()[0].tau
    assert math.isclose(tau, 2 / math.sqrt(6))


def test_frechet_against_direct(spark):
    pick = np.random.default_rng(0)
    x = pick.normal(size=(40, 4))
    y = pick.normal(1, 2, size=(60, 4))
    df = spark.createDataFrame([("x", r.tolist()) for r in x] + [("y", r.tolist()) for r in y], "g string, v array<double>")
    got = {r["group"]: r.distance for r in stats.frechet(df, "g", "v").collect()}
    values = np.linalg.eigvals(np.cov(x.T) @ np.cov(y.T))
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(np.cov(x.T)) + np.trace(np.cov(y.T)) - 2 * np.sqrt(values.astype(complex)).real.sum()
    assert math.isclose(got["x"], want, rel_tol=1e-6) and math.isclose(got["y"], want, rel_tol=1e-6)


def test_versioned_commits(spark):
    rows = [("k", 0, "t1", "a"), ("k", 0, "t2", "lost"), ("k", 1, "t3", "b"), ("k", 1, "t3", "b"), ("k", 5, "t4", "gap"), ("m", 1, "t5", "early")]
    got = {(r.key, r.version, r.what) for r in ledger.committed(spark.createDataFrame(rows, "key string, expected long, token string, what string"), "key", "version", "expected", "token").collect()}
    assert got == {("k", 1, "a"), ("k", 2, "b")}


def test_labels_on_one_value_and_on_columns_agree(spark):
    labels = ["Corner/Side Table", "toilet, can, commode", "ceiling lamp(traffic light)", "pen_1", "2 seat sofa", "Lounge Chair / Cafe Chair", "King-size Bed", "glassnightstand5c8f77c6", "plant_or_flower_pot", "TV stand or console", "chair 12", "or chair", "chair or", "1 2", "a1b2 3", "", None, "Other furniture", "CoffeeTableFactory(12)", "bed 0a1b2c3d 7", "désk 3"]
    df = spark.createDataFrame([(r,) for r in labels], "c string").select("c", text.category(F.col("c")).alias("n"), text.head(F.col("c")).alias("h"), text.slug(F.col("c")).alias("s"))
    for r in df.collect():
        assert (r.n, r.h) == (plain_labels.plain(r.c), plain_labels.last_word(r.c)), r.c
        assert (r.s == "object") == plain_labels.says_nothing(r.c) or r.n == "object"
    want = {"toilet, can, commode": "toilet", "ceiling lamp(traffic light)": "ceiling lamp", "pen_1": "pen", "2 seat sofa": "2 seat sofa", "King-size Bed": "king size bed", "plant_or_flower_pot": "plant"}
    assert {k: plain_labels.plain(k) for k in want} == want
    kinds = [("Bedroom / Hotel", "bedroom/hotel"), ("Misc.", None), ("Meeting Room 1", "meeting room"), ("Restrooms F2", "restroom"), ("Apartment 2 Storage", "storage"), ("LivingRoom_4p", "living room"), (None, None)]
    got = spark.createDataFrame(kinds, "c string, want string").select(text.room_type(F.col("c")).alias("n"), "want").collect()
    assert [r.n for r in got] == [r.want for r in got]


def test_kinds_of_labels():
    L = plain_labels
    assert L.is_structure("wall") and L.is_structure("Wall design") and L.is_structure("french doors") and not L.is_structure("floor lamp") and not L.is_structure("fireplace_console") and not L.is_structure("plant floor") and not L.is_structure(None)
    assert L.hangs("Pendant light") and L.hangs("ceiling fan") and not L.hangs("hanging chair") and L.ends_as("placemats", "flat") and L.is_bedside("Bedside Table") and L.is_art("wall paintings")
    assert L.is_finish("floor tiles") and not L.is_finish("partition panel") and L.says_nothing("other prop") and L.says_nothing("") and not L.says_nothing("otter")


def test_bedside_tables_are_tucked_and_copies_are_not():
    bed = box("b", 2, 2, size=(2.0, 1.6, 0.5), kind="bed")
    for kind in ("nightstand", "bedside table", "night table"):
        seen = rooms.read_room(room(bed, box("n", 2.9, 2.9, size=(0.5, 0.5, 0.5), kind=kind)))
        assert rooms.checked(seen)[1]["tuck"] == 1, kind
    inside = rooms.read_room(room(box("w", 2, 2, size=(2, 2, 2), kind="wardrobe"), box("x", 2, 2, size=(0.5, 0.5, 0.5), kind="crate")))
    assert rooms.checked(inside)[1]["contained"] == 1
    copies = rooms.read_room(room(box("w", 2, 2, size=(2, 1, 2), kind="wardrobe"), box("x", 2.1, 2, size=(2, 1, 2), kind="wardrobe")))
    assert rooms.checked(copies)[1]["main"] == 1


def test_short_descriptions():
    L = plain_labels
    assert L.short_description("A walnut desk with two drawers, placed next to the window. It is old.") == "walnut desk with two drawers"
    assert L.short_description("The lamp on the floor") == "lamp" and L.short_description(None) == "" and L.short_description("an armchair.") == "armchair"
    long = "tall narrow cabinet of dark oak with brass handles, three glass doors and many small shelves for books, plates and other things"
    assert L.short_description(long) == "tall narrow cabinet of dark oak with brass handles, three glass doors" and len(L.short_description("word " * 40).split()) == 16


def test_decisions(spark):
    rows = [(0.1, 0.2, True, [1.0, 2.0, 1.0], [2.0, 2.0, 1.0]), (-0.2, -0.1, True, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]), (0.1, 0.2, False, [1.0, 0.0, 1.0], [1.0, 1.0, 1.0]), (-0.1, 0.1, True, [1.0], [1.0, 1.0, 1.0]), (None, None, True, None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "low double, high double, up boolean, a array<double>, b array<double>")
    iou, mae = stats.size_agreement(F.col("a"), F.col("b"))
    got = df.select(stats.verdict(F.col("low"), F.col("high"), F.col("up")).alias("v"), stats.delivered(F.col("low"), F.col("high"), F.col("low"), -0.3).alias("d"), iou.alias("iou"), mae.alias("mae")).collect()
    assert [r.v for r in got] == ["a_better", "a_worse", "a_worse", None, None] and [r.d for r in got] == [False, True, False, False, False]
    assert [r.iou for r in got] == [0.5, 1.0, None, None, None] and math.isclose(got[0].mae, math.log(2) / 3) and got[1].mae == 0
