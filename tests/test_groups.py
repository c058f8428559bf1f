"""Components and ranks against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strataloom.operators import aggregate, ranking
from strataloom.operators.components import components
from strataloom.operators.ranking import ranked


def test_components_match_union_find(spark):
    pick = random.Random(5)
    edges = [(f"k{pick.randrange(60):02d}", f"k{pick.randrange(60):02d}") for _ in range(45)] + [("k01", "k01"), (None, "k02"), ("hot", "k03")] + [("hot", f"h{i:02d}") for i in range(30)] * 2
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {k: find(k) for k in parent}


def test_components_of_a_long_chain(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    got = components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.root for r in got} == {"n000"} and len(got) == 121


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_ranked_counts_and_sums(spark):
    rows = [("g" if i % 3 else None, i, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, size long")
    got = ranked(df, ["k"], ["id"], seed=1, size="size", width=5).collect()
    for key in ("g", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        total = 0
        for r in mine:
            total += r["size"]
            assert r["upto"] == total
    assert ranked(df.limit(0), ["k"], ["id"]).count() == 0


def test_ordered_equals_a_window(spark):
    pick = random.Random(9)
    rows = [(pick.choice(["a", "a", "a", "b", None]), pick.randrange(50), i, pick.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, i long, s long")
    got = {(r.g, r.i): (r["rank"], r.every, r.upto, r.whole) for r in ranking.ordered(df, ["g"], [F.desc("v"), "i"], "s").collect()}
    for g in ("a", "b", None):
        mine, total = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 0
        for n, r in enumerate(mine, 1):
            total += r[3]
            assert got[g, r[2]] == (n, len(mine), total, sum(x[3] for x in mine))
    assert ranking.ordered(df.limit(0), ["g"], ["v"]).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 2])
def test_medians_at_levels(spark, monkeypatch, few):
    monkeypatch.setattr(aggregate, "FEW", few)
    pick = random.Random(10)
    rows = [(pick.choice("ab"), pick.choice("xyz"), pick.choice([None, -1.0, 0.5, 2.0, 3.0, 7.0])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, t string, v double")
    got = {(r.level, r.k, r.t): (r.n, r.v) for r in aggregate.medians_at_levels(df, [["k", "t"], ["k"], []], ["k", "t"], ["v"]).collect()}
    for level, key in ((0, lambda r: (r[0], r[1])), (1, lambda r: (r[0], None)), (2, lambda r: (None, None))):
        for k in {key(r) for r in rows}:
            mine = [r for r in rows if key(r) == k]
            logs = [math.log(r[2]) for r in mine if r[2] and r[2] > 0]
            n, v = got[level, *k]
            assert n == len(mine) and math.isclose(v, math.exp(statistics.median(logs)))
