"""What a release holds and what it leaves out, on small tables of raw rooms."""

import json

from test_curate import RAW, box, record

from strataloom.plans import release


def written(spark, folder, rows):
    spark.createDataFrame([(s, u, json.dumps(r), "x") for s, u, r in rows], RAW).write.parquet(f"{folder}/raw.parquet")
    return str(folder)


def test_caps_are_optional_and_count_train_rooms(spark, tmp_path):
    rows = [("s", f"u{i}", record([box("a", 1 + i % 30 / 10, 1 + i // 30 / 10)], group=f"h{i}")) for i in range(450)]
    root = written(spark, tmp_path, rows)
    free = release.release_rows(spark, root).groupBy("split").count().collect()
    assert sum(r["count"] for r in free) == 450 and {r.split for r in free} == {"train", "dev", "test"}
    fates = {(r.fate, r.split): r.rooms for r in release.release_counters(spark, root, caps={"s": 100, "other": 1}).collect()}
    held = {r.split: r["count"] for r in free}
    assert fates == {("kept", "train"): 100, ("capped", "train"): held["train"] - 100, ("kept", "dev"): held["dev"], ("kept", "test"): held["test"]}


def test_copies_agree_in_kind_size_pose_and_fixed_boxes(spark, tmp_path):
    turned = {"boundary": [[0, 0], [4, 0], [4, 5], [0, 5]]}
    flat = {"boundary": [[0, 0], [5, 0], [5, 4], [0, 4]]}
    door = [box("d", 0.5, 0.1, kind="door")]
    rows = {
        "a": record([box("a", 1, 1, kind="chair")], **flat),
        "a_again": record([box("x", 1, 1, kind="Chair (2)")], **flat),
        "a_turned": record([{**box("a", 3, 1, kind="chair"), "yaw": 1.5707963267948966}], **turned),
        "kind": record([box("a", 1, 1, kind="bench")], **flat),
        "size": record([box("a", 1, 1, size=(1, 1, 0.5), kind="chair")], **flat),
        "fixed": record([box("a", 1, 1, kind="chair")], fixed=door, **flat),
    }
    root = written(spark, tmp_path, [("s", u, {**r, "group": "h"}) for u, r in rows.items()])
    kept = {r.uid for r in release.release_rows(spark, root).collect()}
    assert len(kept) == 4 and len(kept & {"a", "a_again", "a_turned"}) == 1 and kept >= {"kind", "size", "fixed"}


def test_large_rooms_are_released(spark, tmp_path):
    def rows(n):
        return record([box(f"o{i}", 0.1 + i % 20 / 4.2, 0.1 + i // 20 / 4.2, size=(0.1, 0.1, 0.1)) for i in range(n)], group=f"h{n}")

    root = written(spark, tmp_path, [("s", f"u{n}", rows(n)) for n in (0, 60, 61, 200)])
    counters = {(r.counter, r.rooms) for r in release.room_preparation(spark, root).collect()}
    assert ("rejected:object_count", 1) in counters and ("kept", 3) in counters
    sizes = {r.uid: len(json.loads(json.loads(r.messages)[2]["content"])["placements"]) for r in release.release_rows(spark, root).collect()}
    assert sizes == {"u60": 60, "u61": 61, "u200": 200}


def test_no_room_is_left_to_another_source(spark, tmp_path):
    linked = {"front_known": True, "n_incomplete": 0, "group_aliases": ["visit:1"]}
    rows = [(s, f"u{i}", record([box("a", 1 + i, 1)], meta=linked)) for i, s in enumerate(("s", "t", None))]
    root = written(spark, tmp_path, rows)
    released = release.release_rows(spark, root).collect()
    assert {r.uid for r in released} == {"u0", "u1", "u2"} and len({r.split for r in released}) == 1
