"""Packing and mixing."""

import itertools
import random
from collections import Counter

from strataloom.llm import mixing, packing, sizes


def test_fill_is_the_best_subset():
    pick = random.Random(8)
    for _ in range(80):
        counts = {pick.randrange(1, 12): pick.randrange(1, 4) for _ in range(4)}
        room = pick.randrange(0, 40)
        best = max(t for t in (sum(s * n for s, n in zip(counts, take)) for take in itertools.product(*(range(n + 1) for n in counts.values()))) if t <= room)
        used = packing.fill(counts, room)
        assert sum(s * n for s, n in used.items()) == best and all(n <= counts[s] for s, n in used.items())


def test_patterns_use_everything_up():
    pick = random.Random(6)
    histogram = {pick.randrange(1, 500): pick.randrange(1, 200) for _ in range(150)}
    left = dict(histogram)
    for used, times in packing.patterns(histogram, 512):
        assert sum(s * n for s, n in used.items()) <= 512
        for s, n in used.items():
            left[s] -= n * times
    assert all(v == 0 for v in left.values())
    assert list(packing.patterns({}, 10)) == []


def first_fit(sizes, capacity):
    """Containers that first-fit decreasing needs."""
    room: list[int] = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= s), None)
        if at is None:
            room.append(capacity - s)
        else:
            room[at] -= s
    return len(room)


def documents(spark, n=300):
    pick = random.Random(7)
    rows = [(i, " ".join(["room"] * pick.choice([0, 1, 3, 50, 400, 700])) or None, "a" if i % 2 else "b") for i in range(n)]
    rows += [(1000, "chair " * 5000, None), (1001, "", "a"), (None, "x", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("extra", "rank")


def test_packed_places_each_text_once(spark):
    docs = documents(spark)
    bins = spark.createDataFrame([("s", 512), ("l", 2048), ("bad", 0), (None, 5)], "profile string, capacity_tokens int")
    items = packing.packed(docs, bins).collect()
    sizes = {r.doc_id: r.tokens for r in packing.sized(docs).collect()}
    for profile, capacity in (("s", 512), ("l", 2048)):
        mine = [r for r in items if r.profile == profile]
        total: dict = {}
        filled: dict = {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r["size"]
            filled[r.container_id] = filled.get(r.container_id, 0) + r["size"]
            assert sizes[r.doc_id] > capacity or r.piece == 0
        assert total == {d: n for d, n in sizes.items() if n > 0}
        assert max(filled.values()) <= capacity
        # closest fills of five coarse sizes: within a tenth of the least number
        assert len(filled) <= 1.1 * -(-sum(total.values()) // capacity) + 1
        histogram = Counter(r["size"] for r in mine)
        assert sum(times for _, times in packing.largest_first(histogram, capacity)) <= first_fit([r["size"] for r in mine], capacity)
        assert sorted(filled) == list(range(len(filled)))
    assert {r.profile for r in items} == {"s", "l"}
    assert packing.packed(docs.limit(0), bins).count() == 0


def test_plan_meets_shares():
    groups = {("a",): 1000, ("b",): 100, ("a", "b"): 50, ("c",): 400}
    total, flows = mixing.plan(groups, {"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.4}, {"a": 1, "b": 3, "c": 2, "none": 9})
    sums = {s: sum(v for (_, x), v in flows.items() if x == s) for s in "abc"}
    assert total > 0 and all(abs(sums[s] - total * w) <= 1 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    for key, n in groups.items():
        assert sum(v for (k, _), v in flows.items() if k == key) <= n * min({"a": 1, "b": 3, "c": 2}[s] for s in key)
    assert mixing.plan({}, {"a": 1.0}, {"a": 1}) == (0, {}) and mixing.plan(groups, {}, {}) == (0, {})


def test_mixed_respects_repeats(spark):
    pick = random.Random(3)
    rows = [(i, f"text number {i} " + "word " * pick.randrange(1, 20), "a") for i in range(400)] + [(1000 + i, f"other {i} " + "word " * 10, "b") for i in range(40)] + [(2000 + i, f"text number {i} shared", s) for i in range(30) for s in ("a", "b")]
    docs = spark.createDataFrame([(i * 10 + k, t, s) for k, (i, t, s) in enumerate(rows)] + [(None, "x", "a"), (5, None, "a"), (6, "x", "unknown")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, targets)
    chosen = mix.collect()
    assert chosen and max(r.repeats for r in chosen if r.source == "a") == 1 and max(r.repeats for r in chosen if r.source == "b") <= 3
    shares = {r.source: r.share for r in mixing.reached(mix, targets).collect()}
    assert abs(shares["a"] - 0.7) < 0.02 and abs(shares["b"] - 0.3) < 0.02
    assert mixing.mixed(docs.limit(0), targets).count() == 0 and mixing.mixed(docs, targets.limit(0)).count() == 0


def test_both_tokenizers_count_alike():
    pick = random.Random(5)
    texts = ["", " ", "<|endoftext|>", "沙发 can't 12.5 m\n\n  end ", "naïve café"] + ["".join(pick.choice("ab 12é家.,'\n") for _ in range(200)) for _ in range(20)]
    assert sizes.counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts) == sizes.counter("/opt/tokenizers/byte_bpe_50k.json")(texts)
