"""Rooms on both sides of a split, against a direct comparison of all pairs."""

import json
import random

import numpy as np

from strataloom.llm import overlap


def room(objects, outline=((0, 0), (5, 0), (5, 4), (0, 4))):
    talk = [{"role": "system", "content": "s"}, {"role": "user", "content": json.dumps({"boundary": outline, "objects": [{"id": f"o{i}", "size": o[3:]} for i, o in enumerate(objects)]})}, {"role": "assistant", "content": json.dumps({"placements": [{"id": f"o{i}", "pos": o[:3]} for i, o in enumerate(objects)]})}]
    return json.dumps({"messages": talk})


def scatter(pick, n):
    return [[round(pick.uniform(0.2, 4.5), 2), round(pick.uniform(0.2, 3.5), 2), 0.0, *(round(pick.uniform(0.3, 2), 2) for _ in range(3))] for _ in range(n)]


def shaken(pick, objects, far=0.04):
    return [[v + pick.uniform(-far, far) for v in o] for o in objects]


def turned_text(objects, quarter):
    outline, moved = overlap.turned([[0, 0], [5, 0], [5, 4], [0, 4]], objects, quarter)
    return room(moved, outline)


def cases():
    pick = random.Random(4)
    rows = []
    for i in range(40):
        base = scatter(pick, pick.randrange(4, 9))
        rows.append((f"t{i}", "train", room(base)))
        if i % 2:
            rows.append((f"e{i}", pick.choice(["dev", "test", "validation"]), turned_text(shaken(pick, base), i % 4)))
        else:  # half of the furniture moved: no case
            rows.append((f"e{i}", "test", turned_text([o if k % 2 else [o[0] + 0.5, *o[1:]] for k, o in enumerate(base)], i % 4)))
    copy = scatter(pick, 5)
    rows += [("c1", "train", room(copy)), ("c2", "train", room(copy[::-1])), ("c3", "test", room(copy)), ("c3", "test", json.dumps(room(copy))), ("c4", "test", room(copy, [[0, 0], [5, 0], [5, 3], [0, 3]])), ("n1", None, room(copy)), ("n2", "test", None), (None, "test", room(copy)), ("n3", "train", "{"), ("one", "train", room(copy[:1])), ("two", "test", room(copy[:1]))]
    return rows


def test_found_equals_all_pairs(spark):
    rows = cases()
    parsed = {}
    for uid, split, text in rows:
        if uid and split and (found := overlap.room_of(text)):
            parsed[uid] = (split, found)
    want = set()
    for a, (sa, ra) in parsed.items():
        for b, (sb, rb) in parsed.items():
            if sa != "train" and sb == "train" and any(overlap.same_room((*overlap.turned(ra[0], ra[1], q), ra[2]), rb) for q in range(4)):
                want.add((min(a, b), max(a, b)))
    df = spark.createDataFrame(rows, "uid string, split string, row string")
    got = {tuple(r) for r in overlap.found(df).collect()}
    assert got == want and len([p for p in got if p[0].startswith("e")]) == 20 and ("c1", "c3") in got and ("c2", "c3") in got
    assert not any("c4" in p for p in got) and ("one", "two") in got
    assert overlap.found(df.limit(0)).count() == 0


def test_partners_is_a_matching():
    a = [[0, 0, 0, 1, 1, 1], [0.04, 0, 0, 1, 1, 1]]
    assert overlap.partners(a, [[0.08, 0, 0, 1, 1, 1], [-0.04, 0, 0, 1, 1, 1]]) == 2
    assert overlap.partners(a, [[0.02, 0, 0, 1, 1, 1]]) == 1
    assert overlap.partners(a, []) == 0


def test_near_words_hold_every_partner():
    pick = random.Random(9)
    for _ in range(300):
        v = [pick.uniform(0, 6) for _ in range(8)]
        w = [x + pick.uniform(-1, 1) * (overlap.FRAME if i < 2 else overlap.TOLERANCE) for i, x in enumerate(v)]
        row, words = overlap.near_words(np.array([v, v]))
        mine = overlap.as_words(overlap.letters(overlap.base_cells(np.array([w]))))[0]
        assert mine in words[row == 0] and mine in words[row == 1] and len(set(words[row == 0])) == (row == 0).sum()


def test_frame_off_by_more_than_the_tolerance_of_places(spark):
    """6 cm of difference between two frames pass the exact check and must be asked for across a cell border."""
    pick = random.Random(11)
    for border in (4.5, 5.1):  # borders of cells of 0.6 m that begin half a cell lower
        base = scatter(pick, 6)
        a, b = border - 0.015, border + 0.045
        rows = [("a", "train", room(base, [[0, 0], [a, 0], [a, 4], [0, 4]])), ("b", "test", room(base, [[0, 0], [b, 0], [b, 4], [0, 4]]))]
        assert [tuple(r) for r in overlap.found(spark.createDataFrame(rows, "uid string, split string, row string")).collect()] == [("a", "b")]


def test_hot_words_are_split_on_both_sides(spark, monkeypatch):
    pick = random.Random(12)
    shared = scatter(pick, 2)
    rows = [(f"{side[0]}{i}", side, room(shared + scatter(pick, 1 + i % 2))) for side in ("train", "test") for i in range(20)]
    twin = scatter(pick, 3)
    rows += [("t-twin", "train", room(shared + twin)), ("e-twin", "test", room(shaken(pick, shared + twin)))]
    df = spark.createDataFrame(rows, "uid string, split string, row string")
    whole = sorted(tuple(r) for r in overlap.overlaps(df).collect())
    assert ("e-twin", "t-twin") in [w[:2] for w in whole]
    monkeypatch.setattr(overlap, "HEAVY", 3)
    assert sorted(tuple(r) for r in overlap.overlaps(df).collect()) == whole


def test_spans_come_from_sorted_neighbours(spark):
    """Suffixes that don't stand beside each other aren't read as one run: the order decides."""
    v = overlap.pack(np.ones(8))
    rows = [(7, 0, 0, b"", True, 1, 0, 0, 1, v), (8, 0, 0, b"", False, 3, 0, 0, 0, v), (7, 0, 0, b"", False, 2, 0, 0, 0, v)]
    df = spark.createDataFrame(rows, overlap.SUFFIX).select("word", "block", "other", "rest", "asks", "room", "turn", "at", "need", "vals").coalesce(1)
    assert overlap.spans(df).count() == 0
    got = overlap.spans(df.sortWithinPartitions("word", "block", "other", "rest")).collect()
    assert [(r.room_e, r.room_t, r.span) for r in got] == [(1, 2, 1)]


def test_coverage_merges_spans(spark):
    pick = random.Random(13)
    base = scatter(pick, 12)
    rows = [("a", "train", room(base)), ("b", "test", room(base))]
    (pair,) = overlap.overlaps(spark.createDataFrame(rows, "uid string, split string, row string")).collect()
    assert overlap.MEET <= pair.covered <= 12
