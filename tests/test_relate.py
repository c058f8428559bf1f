"""Joins that answer for every row, against direct comparison."""

import math
import random

from strataloom.operators import relate
from strataloom.plans import relations


def direct_votes(left, right, tolerance):
    shifts = {q - p for a, p in left for b, q in right if a == b}
    return {s: sum(any(a == b and abs(q - p - s) < tolerance for b, q in right) for a, p in left) for s in shifts}


def test_every_row_votes_within_the_tolerance(spark):
    pick = random.Random(5)
    left = [(pick.randrange(3), pick.randrange(40)) for _ in range(30)]
    right = [(pick.randrange(4), pick.randrange(200)) for _ in range(30)]
    frames = spark.createDataFrame(left, "asset long, x long"), spark.createDataFrame([*right, (1, None)], "asset long, x2 long")
    for tolerance in (1, 2, 7):
        got = {r["shift"]: r.votes for r in relate.shift_votes(*frames, "asset", "x", "x2", tolerance).collect()}
        assert got == direct_votes(left, right, tolerance)


def test_offset_votes_counts_all_customers_and_no_bins(spark, tmp_path):
    places = [(n, 100.0 * n * n) for n in range(6)]
    spark.createDataFrame(places, "s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    # 48 and 52 lie in two bins of 50; all customers are beyond number 400
    spark.createDataFrame([(500 + n, n, x + 48 + 4 * (n % 2)) for n, x in places], "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert relations.offset_votes(spark, str(tmp_path)).collect() == [(48, 6, 2)]


def test_every_part_gets_its_nearest(spark, tmp_path):
    pick = random.Random(9)
    parts = [(k, pick.choice("ab"), pick.choice((1, 2, 3, 9, 50)), pick.choice((900.0, 901.5, 950.0, 999.9))) for k in range(1, 61)]
    # twins, a lonely name, names of two parts far apart, parts without name or size
    parts += [(71, "t", 5, 910.0), (72, "t", 5, 910.0), (73, "t", 5, 910.0), (80, "alone", 5, 910.0), (85, "far", 1, 900.0), (90, "far", 50, 999.9), (95, None, 5, 910.0), (96, "a", None, 910.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    good = [p for p in parts if p[1] and p[2]]
    cost = lambda p, q: round(abs(math.log(p[2]) - math.log(q[2])) + abs(math.log(p[3]) - math.log(q[3])), 9)
    want = {p[0]: min((cost(p, q), q[0]) for q in good if q[1] == p[1] and q[0] != p[0]) for p in good if p[1] != "alone"}
    rows = relations.nearest_size(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {r.p_partkey: (r.cost, r.ref) for r in rows} == want


def test_nearest_broadcasts_no_points(spark, tmp_path):
    parts = [(k, "ab"[k % 2], 1 + k % 7, 900.0 + k % 11) for k in range(200)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    bus, held = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = held.executionsCount()
    assert len(relations.nearest_size(spark, str(tmp_path)).collect()) == 200
    bus.waitUntilEmpty(30_000)
    ran = held.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
