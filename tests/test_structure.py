"""Nested records and hierarchies on small hand-made cases."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.functions.jsontext import id_text, read_json
from strataloom.operators import hierarchy, nested

RAW = "source string, uid string, row string, row_2 string"


def row(uid, record, source="s"):
    return (source, uid, record if record is None or isinstance(record, str) else json.dumps(record), "extra")


def test_read_json_unwraps():
    value = {"a": [1]}
    assert read_json(json.dumps(json.dumps(value))) == value
    assert read_json("```json\n" + json.dumps(value) + "\n```") == value
    assert read_json('{"a": [1') is None and read_json("") is None and read_json(None) is None and read_json('"text"') is None
    assert id_text(7) == "7" and id_text(True) is None and id_text(None) is None and id_text(2.0) == "2"


def test_found_covers_all_forms(spark):
    record = {"objects": [{"id": "a", "members": [{"id": "b", "members": {"c": {"x": 1}}}]}, {"category": "no id", "members": [{"id": "d"}]}], "fixed": {"7": {"size": [1]}}}
    export = {"rooms": [{"furniture": [{"furniture_instance_id": 3}]}]}
    raw = spark.createDataFrame([row("u1", record), row("u1", json.dumps(json.dumps(record))), row("u2", export), row("u3", None), row("u4", '{"objects": ['), row("u5", ""), row("u6", {"objects": None})], RAW)
    talk = {"messages": [{"role": "user", "content": json.dumps({"objects": [{"id": "q"}]})}, {"role": "assistant", "content": '```json\n{"placements":[{"id":"q"},{"id":null}]}\n```'}]}
    selected = spark.createDataFrame([("u9", "train", json.dumps(talk), 1)], "uid string, split string, row string, seen int")
    got = {tuple(r) for r in nested.found(raw, selected).collect()}
    assert got == {("u1", "objects", "a", "u1"), ("u1", "objects", "b", "a"), ("u1", "objects", "c", "b"), ("u1", "objects", "d", "u1"), ("u1", "fixed", "7", "u1"), ("u2", "objects", "3", "u2"), ("u9", "request", "q", "u9"), ("u9", "placements", "q", "u9")}
    empty = nested.found(raw.limit(0), selected.limit(0))
    assert empty.count() == 0 and empty.columns == ["uid", "section", "item_id", "holder_id"]


def test_tables_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([row("u1", {"objects": [{"id": "a", "size": [1.0, 2.0], "category": "x"}], "fixed": [{"id": "f"}]})], RAW)
    rows = nested.emit(raw, "uid", "row", "scene")
    nested.write_tables(rows, str(tmp_path / "t"))
    one = nested.read_table(spark, str(tmp_path / "t"), "objects", "category string, size array<double>").collect()
    assert [(r.record_key, r.pk, r.parent_key, r.category, r.size) for r in one] == [("u1", "a", "u1", "x", [1.0, 2.0])]


def test_deep_nesting_and_long_text(spark):
    deep = {"id": "0"}
    for i in range(1, 400):
        deep = {"id": str(i), "members": [deep], "text": "x" * 50}
    raw = spark.createDataFrame([row("u", {"objects": [deep]})], RAW)
    assert nested.emit(raw, "uid", "row", "scene").count() == 400


def answers(links):
    out = set()
    for node in links:
        seen, at, path = set(), node, [node]
        while at not in seen and links.get(at) in links:
            seen.add(at)
            at = links[at]
            path.append(at)
        out.add((node, "", -1, ()) if at in seen else (node, at, len(path) - 1, tuple(reversed(path))))
    return out


def test_resolve_against_brute_force(spark):
    pick = random.Random(3)
    for n, rows in ((60, 7), (60, 1000)):
        links = {f"n{i}": (f"n{i - 1}" if i % 9 else f"n{pick.randrange(n)}") if pick.random() < 0.95 else None for i in range(n)}
        links["lost"] = "nobody"
        edges = spark.createDataFrame([("g", k, v) for k, v in links.items()] + [("g", None, "n1"), ("g", "n0", links["n0"])], "g string, n string, p string")
        got = {(r.n, r.root_id, r.depth, tuple(r.path)) for r in hierarchy.resolve(edges, "g", "n", "p", fragment_rows=rows).collect()}
        assert got == answers({k: v if v in links else None for k, v in links.items()})


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 12).map(str), st.one_of(st.none(), st.integers(0, 14).map(str)), max_size=13))
def test_contract_is_exact_on_one_fragment(links):
    got = {n: (x, d, s) for _, n, _, _, x, d, _, s in hierarchy.contract([("g", n, p if p in links else None, 1, [p] if p in links else []) for n, p in links.items()])}
    for node, root, depth, _ in answers(links):
        assert got[node] == ((None, 0, "ring") if depth < 0 else (root, depth, "root"))


def test_room_edges(spark):
    request = json.dumps({"objects": [{"id": "a"}, {"id": "b"}, {"id": "c"}, {"id": "d"}], "fixed": [{"id": "f"}]})
    target = json.dumps({"placements": [{"id": "b", "on": "a"}, {"id": "c", "on": "b"}, {"id": "d", "on": "wall"}]})
    rooms = spark.createDataFrame([("u", request, target, '{"b": null, "d": "c"}', 1), ("v", request, target, None, 1), ("w", request, target, '[{"id":"a","parent":"a"},{"id":"b","parent":"f"}]', 1), ("x", None, target, None, 1), ("u", request, target, '{"b": null, "d": "c"}', 1)], "uid string, request string, target string, parents string, extra int")
    got = {(r.uid, r.object_id): (r.root_id, r.depth) for r in hierarchy.resolve_checked(hierarchy.room_edges(rooms), "uid", "object_id", "parent_id").collect()}
    assert got["u", "b"] == ("b", 0) and got["u", "c"] == ("b", 1) and got["u", "d"] == ("b", 2) and got["u", "f"] == ("f", 0)
    assert got["v", "c"] == ("a", 2) and got["v", "d"] == ("d", 0)
    assert got["w", "a"] == ("", -1) and got["w", "b"] == ("f", 1)
    assert len(got) == 15


def test_circle_states_against_brute_force(spark):
    pick = random.Random(4)
    for n in (12, 60):
        links = {f"n{i}": f"n{pick.randrange(n)}" if pick.random() < 0.9 else None for i in range(n)} | {"a0": "a0", **{f"a{i}": f"a{i - 1}" for i in range(1, 9)}}
        edges = spark.createDataFrame([(g, k, v) for g in ("g", "h") for k, v in links.items()], "g string, n string, p string")
        want = set()
        for node in links:
            trail, at = [], node
            while at is not None and at not in trail:
                trail.append(at)
                at = links[at]
            if at is not None:
                want.add((node, "circle" if at == node else "below_circle"))
        got = hierarchy.circle_states(hierarchy.resolve(edges, "g", "n", "p"), edges, "g", "n", "p").collect()
        assert {(r.n, r.state) for r in got if r.g == "h"} == want and len(got) == 2 * len(want)
    none = edges.limit(0)
    assert hierarchy.circle_states(hierarchy.resolve(none, "g", "n", "p"), none, "g", "n", "p").count() == 0


def test_descendants(spark):
    edges = spark.createDataFrame([("g", "a", None), ("g", "b", "a"), ("g", "c", "b"), ("g", "x", "x")], "g string, n string, p string")
    got = {tuple(r) for r in hierarchy.descendants(hierarchy.resolve(edges, "g", "n", "p"), "g", "n").collect()}
    assert got == {("g", "a", "b", 1), ("g", "a", "c", 2), ("g", "b", "c", 1)}
