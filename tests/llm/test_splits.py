"""Families and their splits."""

import itertools
import json
import random

from strataloom.llm import splits

RAW = "source string, uid string, row string"


def room(group=None, aliases=None):
    return json.dumps({"group": group, "meta": {"group_aliases": aliases}})


def test_names():
    assert splits.house_number("House 000412") == splits.house_number("HOUSE-412") == splits.house_number("house.00000412") == "412"
    assert splits.plain_name("visit:0000009") == splits.plain_name("VISIT-00009") == "visit9"
    assert splits.room_keys("s", "p:00012:3", None) == ["h|s|12"]
    assert splits.room_keys("s", "p:00012:3", '{"group": "scan_7"') == ["h|s|12"]


def test_broken_families(spark):
    raw = spark.createDataFrame([("s", "p:1:0", room("house_01")), ("s", "p:1:1", room("House 1")), ("t", "q:5:0", room("plan_5", ["visit:01"])), ("s", "p:2:0", room("house_2", ["VISIT-1"])), ("u", "r:9:0", room(None, ["Visit:1"])), ("u", "r:8:0", None), ("u", "r:8:1", "{bad"), ("s", "p:1:0", room("house_01"))], RAW)
    chosen = spark.createDataFrame([("p:1:0", "train", "x", 1), ("p:1:1", "dev", "x", None), ("p:1:0", "train", "y", 1), ("q:5:0", "train", "", 1), ("r:9:0", "test", "", 1), ("r:8:0", "dev", "", 1), ("r:8:1", "validation", "", 1), ("z:1:0", "test", "", 1)], "uid string, split string, row string, seen int")
    got = {tuple(r) for r in splits.broken(splits.families(raw, chosen)).collect()}
    assert got == {("p:1:0", "p:1:0"), ("p:1:1", "p:1:0"), ("q:5:0", "q:5:0"), ("r:9:0", "q:5:0")}
    assert splits.broken(splits.families(raw.limit(0), chosen.limit(0))).count() == 0


def test_closest_against_brute_force():
    pick = random.Random(2)
    for _ in range(60):
        sizes = {pick.randrange(1, 9): pick.randrange(1, 4) for _ in range(3)}
        total = sum(s * n for s, n in sizes.items())
        goal = pick.randrange(0, total + 1)
        best = min(abs(sum(s * n for s, n in zip(sizes, take)) - goal) for take in itertools.product(*(range(n + 1) for n in sizes.values())))
        taken = splits.closest(sizes, goal)
        assert all(0 <= taken[s] <= sizes[s] for s in sizes)
        assert abs(sum(s * n for s, n in taken.items()) - goal) == best


def test_closest_with_many_families():
    sizes = {1: 5000, 3: 900, 17: 40}
    taken = splits.closest(sizes, 4000)
    assert sum(s * n for s, n in taken.items()) == 4000 and all(taken[s] <= sizes[s] for s in sizes)
    # no piece of size one: the closest total isn't the goal
    taken = splits.closest({6: 400_000, 10: 300_000}, 1_000_001)
    assert 6 * taken[6] + 10 * taken[10] == 1_000_000
    assert splits.mirrored(0b0011, 3) == 0b1100 and splits.closest({}, 5) == {} and splits.closest({4: 1}, 2) == {4: 0}


def test_hot_houses_are_spread(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"h{i}") for i in range(60)], "uid long, house string")
    small = spark.createDataFrame([("hot", "r")] + [(f"h{i}", f"r{i}") for i in range(0, 60, 4)], "house string, root string")
    whole = {tuple(r) for r in splits.salted_lookup(rows, small, "house").select("uid", "house", "root").collect()}
    monkeypatch.setattr(splits, "HEAVY", 7)
    assert {tuple(r) for r in splits.salted_lookup(rows, small, "house").select("uid", "house", "root").collect()} == whole and len(whole) == 60


def test_assign_keeps_families(spark):
    raw = spark.createDataFrame([("s", f"p:{i // 3}:{i % 3}", room(f"house_{i // 3}")) for i in range(300)] + [("only", "o:1:0", room("house_1"))], RAW)
    chosen = spark.createDataFrame([(f"p:{i // 3}:{i % 3}", "train") for i in range(300)] + [("o:1:0", "test")], "uid string, split string")
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    catalog = spark.createDataFrame([("s", "train_family"), ("only", "evaluation_only")], "source string, role string")
    got = splits.assign(splits.families(raw, chosen), plan, catalog).collect()
    assert len(got) == 301
    by: dict = {}
    for r in got:
        by.setdefault(r.family_uid, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    count = {s: sum(r.split == s for r in got) for s in ("train", "validation", "test")}
    assert abs(count["validation"] - 30) <= 2 and abs(count["test"] - 30) <= 2
    assert next(r.split for r in got if r.uid == "o:1:0") == "test"
