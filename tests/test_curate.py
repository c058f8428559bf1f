"""Preparation, rendering, scoring and edits on small rooms."""

import itertools
import json
import random

from strataloom.operators import curate
from strataloom.operators import rooms as R

RAW = "source string, uid string, row string, state string"


def box(name, x, y, z=0.0, size=(1.0, 1.0, 1.0), kind="box", **more):
    return {"id": name, "category": kind, "size": list(size), "pos": [x, y, z], "yaw": 0.0, **more}


def record(objects, **more):
    """A furnished corner room of 6.4 m by 4.8 m in the own form of records."""
    return {"group": "villa-27", "boundary": [[0, 0], [6.4, 0], [6.4, 4.8], [0, 4.8]], "boundary_type": "polygon", "height": 2.6, "objects": objects, "meta": {"front_known": True, "n_incomplete": 0}, **more}


def test_assignment_is_the_cheapest():
    pick = random.Random(3)
    for n in (0, 1, 2, 4, 5):
        for _ in range(20):
            cost = [[pick.randrange(20) for _ in range(n)] for _ in range(n)]
            got = curate.assignment(cost)
            assert sorted(got) == list(range(n))
            assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))


def test_reasons(spark):
    crate = box("crate-7", 2.1, 1.4, size=(0.9, 0.7, 0.8), kind="crate")
    vase = box("vase-1", 2.0, 1.5, 0.83, (0.2, 0.2, 0.3), "vase")
    good = [crate, vase]
    line = [[0, 0], [3, 0], [6, 0], [4, 0]]
    rows = {
        "sound": (record(good), None),
        "front": (record(good, meta={"n_incomplete": 0}), "front_unknown"),
        "gaps": (record(good, meta={"front_known": True, "n_incomplete": 3}), "incomplete_objects"),
        "ids": (record([*good, vase]), "duplicate_source_ids"),
        "form": (record(good, boundary_type="sketch"), "boundary"),
        "line": (record(good, boundary=line), "boundary_shape"),
        "tiny": (record(good, boundary=[[0, 0], [0.6, 0], [0.6, 0.6], [0, 0.6]]), "boundary_shape"),
        "height": (record(good, height=-2), "bad_numbers"),
        "word": (record([{**crate, "size": [0.9, "wide", 0.8]}]), "bad_numbers"),
        "bare": (record([]), "object_count"),
    }
    raw = spark.createDataFrame([("s", k, json.dumps(v), "x") for k, (v, _) in rows.items()] + [("s", "sound", json.dumps(json.dumps(rows["sound"][0])), "x"), ("s", "null", None, "x"), ("s", None, json.dumps(rows["sound"][0]), "x")], RAW)
    got = {r.uid: r for r in curate.prepare(raw).collect()}
    assert {k: r.reason for k, r in got.items()} == {k: reason for k, (_, reason) in rows.items()}
    assert got["sound"].flags == [] and got["sound"].objects == 2
    answer = json.loads(got["sound"].assistant)["placements"]
    assert answer[1]["on"] == answer[0]["id"] == "crate_1" and answer[1]["pos"] == [2, 1.5, 0.8]
    assert [o["id"] for o in json.loads(got["sound"].user)["objects"]] == ["crate_1", "vase_1"]
    assert curate.prepare(raw.limit(0)).count() == 0


def prepared(*objects, fixed=(), **more):
    room, flags = curate.prepared(R.read_room(json.dumps(record(list(objects), fixed=list(fixed), **more))))
    return {o["id"]: o for o in room["objects"]}, {f["id"]: f["what"] for f in room["fixed"]}, flags


def test_parts_of_the_building_are_told_or_left_out():
    door = box("d", 3.0, 0.0, 0, (1.0, 0.1, 2.0), "door")
    inner_wall = box("w", 3.0, 2.4, 0, (2.0, 0.2, 2.5), "wall")
    own_wall = box("o", 3.2, 4.8, 0, (6.4, 0.1, 2.5), "wall")
    beam = box("b", 3.0, 2.0, 2.2, (3.0, 0.2, 0.2), "ceiling beam")
    skirting = box("k", 0.05, 2.0, 0, (0.1, 3.0, 0.2), "baseboard")
    objects, fixed, flags = prepared(door, inner_wall, own_wall, beam, skirting, box("a", 1, 1, kind="desk"))
    assert set(objects) == {"a"} and fixed == {"d": "structure", "w": "structure"} and flags == ["single_object"]
    lamp = box("l", 4, 2, 0, (0.3, 0.3, 1.5), "floor lamp")
    assert set(prepared(lamp, box("a", 1, 1, kind="desk"))[0]) == {"l", "a"}


def test_what_cannot_be_placed_is_told_as_fixed():
    objects, fixed, flags = prepared(box("g", 4, 2, kind="unknown"), box("n", 2, 3, kind="cabinet", front_known=False), box("v", 5.5, 4.3, 0.4, (0.8, 0.5, 0.5), "vanity cabinet"), box("t", 1, 1, kind="table"))
    assert set(objects) == {"t"} and fixed == {"g": "generic", "n": "frontless", "v": "floating"} and flags == ["front_fixed", "single_object"]
    # a second box of a placed object isn't told, and what stands on a dropped one goes with it
    objects, fixed, _ = prepared(box("t", 2, 2, kind="table"), box("g", 2, 2, 0, (0.9, 0.9, 0.9), "object"), box("c", 4, 3, kind="unknown"), box("e", 4, 3, 1.0, (0.2, 0.2, 0.2), "cup"))
    assert set(objects) == {"t"} and fixed == {"c": "generic"}


def test_heights_are_snapped():
    objects, _, flags = prepared(box("s", 2, 2, 0.42, (2.0, 0.9, 0.8), "sofa"), box("p", 5, 3, kind="plant"))
    assert objects["s"]["z"] == 0 and flags == ["z_snapped"]
    # over a box it would sink into, it is put on that box instead
    objects, _, flags = prepared(box("b", 2, 2, 0, (2.2, 1.2, 0.3), "platform"), box("s", 2, 2, 0.42, (2.0, 0.9, 0.8), "sofa"))
    assert (objects["s"]["parent"], objects["s"]["z"]) == ("b", 0.3) and flags == ["support_lowered"]
    assert set(prepared(box("s", 2, 2, -0.4, kind="sofa"), box("p", 5, 3, kind="plant"))[0]) == {"p"}


def test_flags():
    desk = box("a", 1, 1, kind="desk")
    assert "oob_far" in prepared(desk, box("x", 8, 2, kind="desk"))[2]
    assert "hidden_obstacle" in prepared(desk, box("x", 4, 3, -0.35, (1.2, 1.2, 1.2), "sofa"))[2]
    assert prepared(desk, box("r", 4, 3, 0, (2, 2, 0.01), "rug"), box("u", 4, 3, 0, (1, 2, 0.5), "duvet"))[2] == []
    assert "height_dropped" in prepared(desk, box("x", 4, 3, 0, (1, 1, 2.9), "wardrobe"))[2]
    assert "room_filling_object" in prepared(box("x", 3.2, 2.4, 0, (6.2, 4.7, 2.0), "kitchen"))[2]


def test_canonical_is_stable():
    room = R.read_room(json.dumps(record([box("x", 1, 1), box("y", 3, 3, size=(2, 1, 1), kind="desk, wide"), box("z", 2, 4)])))
    shuffled = {**room, "objects": room["objects"][::-1]}
    assert curate.canonical(room) == curate.canonical(shuffled)
    assert [o["id"] for o in curate.canonical(room)["objects"]] == ["desk_1", "box_1", "box_2"]


def test_scored(spark):
    request = json.dumps({"boundary": [[0, 0], [5, 0], [5, 5], [0, 5]], "boundary_type": "polygon", "objects": [{"id": "a", "category": "chair"}, {"id": "b", "category": "chair"}]})
    target = json.dumps({"placements": [{"id": "a", "pos": [1, 1, 0], "size": [1, 1, 1]}, {"id": "b", "pos": [3, 1, 0], "size": [1, 1, 1]}]})
    swapped = json.dumps({"placements": [{"id": "a", "pos": [3, 1, 0], "yaw": 0}, {"id": "b", "pos": [1, 1, 0], "yaw": 0}]})
    answers = spark.createDataFrame([("o1", "u", swapped), ("o1", "u", swapped), ("o2", "u", "{"), ("o3", "none", swapped), ("o4", "u", None)], "output_id string, uid string, raw string")
    rooms = spark.createDataFrame([("u", request, target)], "uid string, request string, target string")
    got = {r.output_id: r for r in curate.scored(answers, rooms).collect()}
    assert set(got) == {"o1", "o2", "o4"} and got["o2"].state == got["o4"].state == "truncated_or_bad_json"
    assert (got["o1"].main, got["o1"].outside, got["o1"].moved, got["o1"].moved_matched) == (0, 0, 2.0, 0.0)


def test_edits(spark):
    prompt = "Review.\ndesk_1 | 1x1x1 | 0,0,0 | 0\nlamp_1 | 1x1x1 | 0,0,0 | 0"
    answer = '<think></think>```json\n{"scores":{},"edits":[{"id":"desk_1","op":"move","x":1,"y":2},{"id":"desk_1","op":"face","target":"desk_1"},{"id":"zzz","op":"rotate","yaw_deg":1},{"id":"lamp_1","op":"rotate","yaw_deg":"x"},{"id":"lamp_1","op":"sell"},7]}\n```'
    calls = spark.createDataFrame([("c", prompt, answer), ("d", prompt, None), ("e", None, "{")], "call_id string, prompt string, raw_final_text string")
    assert [r.state for r in curate.edits(calls).orderBy("at").collect()] == ["ok", "bad_target", "unknown_id", "bad_number", "unknown_op", "bad_item"]


def test_perturbed_moves_what_rests_on_it(spark):
    target = json.dumps({"placements": [{"id": "a", "pos": [1, 1, 0]}, {"id": "b", "pos": [1, 1, 1], "on": "a"}, {"id": "c", "pos": [1, 1, 2], "on": "b"}]})
    rooms = spark.createDataFrame([(f"u{i}", target) for i in range(12)] + [("v", None), ("w", "{}")], "uid string, target string")
    got = curate.perturbed(rooms).collect()
    assert len(got) == 12 and {(r.object_id, tuple(r.moved)) for r in got} <= {("a", ("a", "b", "c")), ("b", ("b", "c")), ("c", ("c",))}
    assert all(0.2 < (r.dx**2 + r.dy**2) < 2.4 for r in got)
