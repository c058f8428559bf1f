"""Readers of scene exports on files made here."""

import json
import math

import pytest

from strataloom.functions import geometry as G
from strataloom.operators import curate
from strataloom.sources import files, readers, scenes


def thing(name, kind="desk", pos=(2, 3, 1), size=(1, 2, 0.8), turn=90, **more):
    return {"furniture_instance_id": name, "furniture_category": kind, "furniture_position": dict(zip("xyz", pos)), "furniture_rotation": {"x": 0, "y": 0, "z": turn}, "furniture_size": dict(zip(("width", "length", "height"), size)), **more}


RING = [[1, 1], [1, 5], [7, 5], [7, 1]]
WALLS = [{"start": {"x": 1, "y": 1}, "end": {"x": 7, "y": 1}, "thickness": 0.2}]
CASES = {
    "ASE": {"scene_id": "ase_train_1", "source_subset": "train", "rooms": [{"room_id": "r", "room_type": "study", "room_boundary": RING, "source_fields": {"make_wall": [1, 2, 3, 4]}, "furniture": [thing("a", None, source_fields={"obb3_gt": {"k": {"category_names": ["sofa"]}}}), thing("b", size=(1, 1, None))]}]},
    "SpatialLM": {"scene_id": "s1", "rooms": [{"room_id": 0, "room_boundary": RING, "walls": WALLS, "doors": [{"wall_index": 0, "position": {"x": 3, "y": 1, "z": 1}, "width": 0.9, "height": 2}, {"wall_index": 7}], "furniture": [thing("a", "coffee_table", (2, 3, 0.4))]}]},
    "SpatialGen": {"scene_id": "g1", "rooms": [{"room_id": "g1r", "room_boundary": RING, "furniture": [thing("a", turn=0, source_fields={"size": [1, 2, 3], "transform": [0, -1, 0, 4, 1, 0, 0, 2, 0, 0, 1, 1.5, 0, 0, 0, 1]}), thing("b", source_fields={})]}]},
    "SceneSmith": {"scene_id": "m1", "parent_scene_id": "m", "provenance": {"subset": "x"}, "rooms": [{"room_boundary": RING, "furniture": [thing("a", source_fields={"asset_group": "furniture"})]}]},
    "OptiScene_holodeck": {"scene_id": "h1", "rooms": [{"room_boundary": RING, "furniture": [{"furniture_category": "lamp", "source_fields": {"layout_object": {"position": {"x": 2, "y": 0, "z": 3}, "rotation": {"x": 0, "y": 90, "z": 0}, "bbox": [150, 60, 80]}}}]}]},
    "SAGE-10k": {"scene_id": "q", "room_index": 2, "room_boundary": [{"x": x, "y": y} for x, y in RING], "furniture": [thing("a", place_id="floor"), thing("b", place_id="a"), thing("b", place_id="b")]},
    "M3DLayout_infinigen": {"sample_id": "i", "scene_id": "infinigen_12", "rooms": [{"room_type": "living_room", "room_height": 3, "room_boundary": RING, "furniture": [thing("a", "arm_chair")]}]},
    "ScanNetpp": {"scene_id": "scannetpp_ab", "rooms": [{"room_boundary": RING, "furniture": [thing("a", pos=(2, 3, 1.46), source_fields={"vertical_axis_dot_z": 0.99}), thing("b", pos=(2, 3, 3), source_fields={"vertical_axis_dot_z": 0.5}, furniture_rotation={"x": 40, "y": 0, "z": 0})]}]},
    "Structured3D": {"sample_id": "t", "provenance": {"source_house_id": "9", "split": "train"}, "room_context": {"floor_polygon": RING, "room_type": "undefined", "ceiling_height_m": 2.8, "doors": [{"position": {"x": 1.0, "y": 3.0, "z": 1.0}, "width": 0.9, "height": 2.0}]}, "layout": {"floor_layout": {"objects": [{"id": "a", "category": "bed", "position": {"x": 3, "y": 3, "z": 0.5}, "rotation": {"x": 0, "y": 0, "z": 0}, "size": {"width": 2, "length": 1, "height": 1}}, {"id": "b", "category": "bed", "assignment_method": "nearest", "position": {"x": 30, "y": 3, "z": 0.5}}]}}},
}


@pytest.fixture
def rooms(spark, tmp_path):
    def read(name):
        reader = readers.READERS[name]
        for k, p in enumerate(reader.paths):
            path = tmp_path / p
            path.parent.mkdir(parents=True, exist_ok=True)
            held = [CASES[name], {"bad": 1}, "text"] if k == 0 else []
            path.write_text(json.dumps(held) if reader.array else "\n".join(map(json.dumps, held)) + "\n{broken")
        return {r.uid: json.loads(r.row) for r in readers.load(spark, str(tmp_path), name).collect()}

    return read


def test_every_reader_gives_rooms(rooms):
    for name in readers.READERS:
        (room,) = rooms(name).values()
        assert room["source"] == name and room["boundary"] == [[6, 0], [6, 4], [0, 4], [0, 0]] and G.signed_area(room["boundary"]) == 24, name


def test_frames_and_fields(rooms):
    (ase,) = rooms("ASE").values()
    assert [(o["id"], o["category"], o["size"], o["pos"], o["yaw"]) for o in ase["objects"]] == [("a", "sofa", [2, 1, 0.8], [1, 2, 0.6], 0)] and ase["meta"]["n_incomplete"] == 1 and ase["group"] == "ase:train_1"
    (lm,) = rooms("SpatialLM").values()
    assert [(o["category"], o.get("structure")) for o in lm["objects"]] == [("coffee table", None), ("door", True)]
    assert lm["objects"][1]["size"] == [0.9, 0.2, 2] and math.isclose(lm["objects"][1]["yaw"] % math.pi, 0, abs_tol=1e-9) and lm["objects"][1]["pos"] == [2, 0, 0]
    (gen,) = rooms("SpatialGen").values()
    assert [round(v, 9) for v in gen["objects"][0]["size"]] == [1, 2, 3] and gen["objects"][0]["pos"] == [3, 1, 0] and gen["meta"]["eval_only"] and gen["meta"]["n_incomplete"] == 1
    (smith,) = rooms("SceneSmith").values()
    assert smith["objects"][0]["anchor"] == "floor" and smith["objects"][0]["yaw"] == math.pi
    (deck,) = rooms("OptiScene_holodeck").values()
    assert [round(v, 9) for v in deck["objects"][0]["size"]] == [0.7, 0.5, 1.5] and deck["objects"][0]["yaw"] == math.pi and deck["objects"][0]["pos"] == [1, 2, 0]
    (sage,) = rooms("SAGE-10k").values()
    assert [(o["id"], o["anchor"], o["parent"]) for o in sage["objects"]] == [("a", "floor", None), ("b", "object", "a"), ("b#2", None, None)]
    (infinigen,) = rooms("M3DLayout_infinigen").values()
    assert (infinigen["group"], infinigen["room_type"], infinigen["height"], infinigen["boundary_type"], infinigen["objects"][0]["category"]) == ("infinigen:12", "living room", None, "proxy", "arm chair")
    (pp,) = rooms("ScanNetpp").values()
    assert [(o["tilted"], round(o["pos"][2], 6)) for o in pp["objects"]] == [(False, 0.0), (True, 1.54)] and pp["meta"]["front_known"] is False and pp["boundary_type"] == "hull"
    (s3d,) = rooms("Structured3D").values()
    assert [o["id"] for o in s3d["objects"]] == ["a", "door_0"] and s3d["meta"]["n_nearest_outside_dropped"] == 1 and s3d["room_type"] is None and s3d["height"] == 2.8


def test_rooms_go_on_to_preparation(spark, rooms):
    rows = [(room["source"], uid, json.dumps(room)) for name in ("SpatialLM", "Structured3D", "SAGE-10k") for uid, room in rooms(name).items()]
    got = {r.uid: r.reason for r in curate.prepare(spark.createDataFrame(rows, "source string, uid string, row string")).collect()}
    assert got["spatiallm:s1::0"] is None and got["t"] is None and len(got) == 3


def test_multiscan(spark, tmp_path):
    head = "object_id,scan_id,category,obb_center,obb_half_extents,obb_axes,front,up,is_architectural,is_opening"
    quoted = lambda v: '"' + json.dumps(v) + '"'
    rows = [["7", "s", "arm_chair", quoted([2, 3, 1]), quoted([0.4, 0.5, 0.2]), quoted([0, -1, 0, 0, 0, 1, 1, 0, 0]), quoted([0, -1, 0]), quoted([0, 0, 1]), "False", "False"], ["8", "s", "wall", quoted([0, 0, 1]), quoted([1, 1, 1]), quoted([1, 0, 0, 0, 0.8, 0.6, 0, -0.6, 0.8]), quoted([1, 0, 0]), quoted([0, 0, 1]), "True", "False"]]
    (tmp_path / "objects.csv").write_text("\n".join([head, *(",".join(r) for r in rows)]))
    (tmp_path / "regions.csv").write_text("scan_id,poly_loop,floor_height,ceiling_height,height_reliable,room_type\n" + f's,{quoted([[0, 0], [4, 0], [4, 4], [0, 4]])},0.0,2.5,True,Bedroom\n')
    (tmp_path / "scans.csv").write_text("scan_id,scene_id,device\ns,sc,x\n")
    (row,) = readers.multiscan(spark, str(tmp_path)).collect()
    room = json.loads(row.row)
    assert (room["uid"], room["group"], room["room_type"], room["height"], room["boundary_type"]) == ("MultiScan::s", "multiscan:sc", "bedroom", 2.5, "hull")
    (chair,) = room["objects"]
    # half extents with permuted axes: front first, upright last
    assert [round(v, 9) for v in chair["size"]] == [0.8, 0.4, 1.0] and [round(v, 9) for v in chair["pos"]] == [2, 3, 0.5] and math.isclose(chair["yaw"], 3 * math.pi / 2) and chair["category"] == "arm chair"


def test_box_bounds():
    one = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    assert scenes.box_bounds([1, 2, 3], one, 0) == [1, 2, 3] and [round(v, 9) for v in scenes.box_bounds([1, 2, 3], one, 90)] == [2, 1, 3]
    assert [round(v, 9) for v in scenes.box_bounds([1, 1, 1], [[2, 0, 0], [0, 2, 0], [0, 0, 2]], 45)] == [round(2 * math.sqrt(2), 9)] * 2 + [2]
    assert scenes.box_bounds([1, 2, 3], [[1, 1, 0], [1, 1, 0], [0, 0, 1]], 0) is None and scenes.box_bounds([0, 1, 1], one, 0) is None and scenes.box_bounds(None, one, 0) is None


def test_arrays_are_read_by_uri(tmp_path):
    values = [{"a": "é" * i, "b": ["]", "\\"]} for i in range(20)]
    (tmp_path / "x.json").write_text("  " + json.dumps(values, ensure_ascii=False))
    for piece in (1, 3, 64, 1 << 20):
        assert [json.loads(t) for t in files.array_elements((tmp_path / "x.json").as_uri(), piece)] == values
