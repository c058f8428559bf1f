"""Joins of objects inside rooms: bands, boxes, best candidates, patches, reconciliation.

A room can hold thousands of objects, so pairs are never made from all objects of a room: boxes are cut into cells
of a grid and meet only in a shared cell, each pair in exactly one (the cell of the larger lower corner). Offsets and sizes meet the same way in bands.

Defined cases: rows with NULL keys or coordinates meet nothing; a box of no extent meets nothing; repeated rows pair like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.runtime import cut


def overlapping_pairs(boxes: DataFrame, room: str, key: str, cell: int, low: tuple[str, str] = ("x0", "y0"), high: tuple[str, str] = ("x1", "y1"), keep: list[str] = ()) -> DataFrame:
    """Pairs a < b of boxes of one room whose footprints share area, with the area; each pair once.

    Columns of ``keep`` come along with suffixes _a and _b.
    """
    (x0, y0), (x1, y1) = low, high
    spread = boxes.withColumn("_cx", F.explode(F.sequence(F.floor(F.col(x0) / cell), F.floor(F.col(x1) / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col(y0) / cell), F.floor(F.col(y1) / cell))))
    cols = [key, x0, y0, x1, y1, *keep]
    a = spread.select(room, "_cx", "_cy", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = spread.select(room, "_cx", "_cy", *[F.col(c).alias(f"{c}_b") for c in cols])
    wide = F.least(f"{x1}_a", f"{x1}_b") - F.greatest(f"{x0}_a", f"{x0}_b")
    deep = F.least(f"{y1}_a", f"{y1}_b") - F.greatest(f"{y0}_a", f"{y0}_b")
    own_cell = (F.col("_cx") == F.floor(F.greatest(f"{x0}_a", f"{x0}_b") / cell)) & (F.col("_cy") == F.floor(F.greatest(f"{y0}_a", f"{y0}_b") / cell))
    met = a.join(b, [room, "_cx", "_cy"]).where((F.col(f"{key}_a") < F.col(f"{key}_b")) & own_cell & (wide > 0) & (deep > 0))
    return met.withColumn("area", wide * deep).drop("_cx", "_cy")


def best_candidate(pairs: DataFrame, by: list[str], order: Column, pick: list[str], largest: bool = False) -> DataFrame:
    """The candidate with the smallest (or largest) order of each row; ``order`` should end with a key, so ties are settled."""
    chosen = F.max_by if largest else F.min_by
    return pairs.groupBy(*by).agg(chosen(F.struct(*pick), order).alias("_best")).select(*by, "_best.*")


def banded_join(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, width: float) -> DataFrame:
    """Rows of equal keys with |a - b| <= width. Each right row stands in three bands, so every pair meets in exactly one."""
    bands = left.withColumn("_band", F.floor(F.col(a) / width))
    near = right.withColumn("_band", F.explode(F.array(*[(F.floor(F.col(b) / width) + d) for d in (-1, 0, 1)])))
    return bands.join(near, [*on, "_band"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_band")


def nearest_by_log_size(rows: DataFrame, key: str, kind: str, sizes: tuple[str, str]) -> DataFrame:
    """(key, ref, cost) of every row: the other row of its kind with the least sum of |log ratios| of two sizes, of equal ones the smaller key.

    Rows of equal kind and sizes are one point. Points stand in a lattice of squares by the logarithms of both sizes and ask the nine
    squares around theirs; an answer is proven once its cost is less than the side of a square, and points without proof ask again in
    squares twice as wide, until squares are as wide as the table. Only rows alone in their kind, or without kind or sizes above 0, get none.
    ``key`` is unique. Every join is asked to sort and merge: Spark judges sizes by the bytes of packed files and would broadcast all points.
    """
    good = rows.where(F.col(key).isNotNull() & F.col(kind).isNotNull() & (F.col(sizes[0]) > 0) & (F.col(sizes[1]) > 0))
    at = cut(good.select(F.col(key).alias("_k"), F.col(kind).alias("_g"), F.log(F.col(sizes[0]).cast("double")).alias("_a"), F.log(F.col(sizes[1]).cast("double")).alias("_b")).distinct())
    place = ["_g", "_a", "_b"]
    points = cut(at.groupBy(*place).agg(F.min("_k").alias("_p")))
    spans = points.agg(F.max("_a") - F.min("_a"), F.max("_b") - F.min("_b"), F.count(F.lit(1))).first()
    reach = (spans[0] or 0.0) + (spans[1] or 0.0)
    width = max(reach / max(spans[2], 1) ** 0.5, 1e-6)
    cost = F.round(F.abs(F.col("_a") - F.col("_a2")) + F.abs(F.col("_b") - F.col("_b2")), 9)
    other = points.select("_g", F.col("_a").alias("_a2"), F.col("_b").alias("_b2"), F.col("_p").alias("ref"))
    found, left = None, points
    while found is None or not left.isEmpty():
        last = width > reach
        if last:
            met = left.join(other.hint("merge"), "_g")
        else:
            cell = lambda c, step=0: F.floor(F.col(c) / width) + step
            around = F.array(*[F.struct(cell("_a", i).alias("i"), cell("_b", j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
            met = left.withColumn("_c", F.explode(around)).join(other.withColumn("_c", F.struct(cell("_a2").alias("i"), cell("_b2").alias("j"))).hint("merge"), ["_g", "_c"])
        best = best_candidate(met.where("_p <> ref").withColumn("cost", cost), ["_p"], F.struct("cost", "ref"), ["cost", "ref"])
        done = cut(best if last else best.where(F.col("cost") < width - 1e-9))
        found = done if found is None else found.unionByName(done)
        if last:
            break
        left = cut(left.join(done.select("_p").hint("merge"), "_p", "left_anti"))
        width *= 2
    placed = at.join(points.hint("merge"), place)
    second = placed.where("_k <> _p").groupBy("_p").agg(F.min("_k").alias("_q"))
    near = placed.join(second.hint("merge"), "_p", "left").join(found.hint("merge"), "_p", "left")
    twin = F.when(F.col("_k") != F.col("_p"), F.col("_p")).otherwise(F.col("_q"))
    own = F.when(twin.isNotNull(), F.struct(F.lit(0.0).alias("cost"), twin.alias("ref")))
    answer = F.least(own, F.when(F.col("ref").isNotNull(), F.struct("cost", "ref")))
    return near.select(F.col("_k").alias(key), answer.alias("_r")).where("_r is not null").select(key, "_r.ref", "_r.cost")


def shift_votes(left: DataFrame, right: DataFrame, asset: str, x: str, x2: str, tolerance: int) -> DataFrame:
    """(shift, votes) of every whole-number shift x2 - x between rows of one asset: the left rows with a right row less than ``tolerance`` from where the shift puts them.

    Equal places of an asset are counted before the join. Around the shifts of a place the tolerances are merged to runs, so it votes
    once however many right rows are near; votes are the running sum of the starts and ends of runs. That sum sorts one row for each
    end, at most two for each whole number in the range of shifts.
    """
    reach = tolerance - 1
    a = left.where(F.col(x).isNotNull()).groupBy(asset, x).agg(F.count(F.lit(1)).alias("_n"))
    b = right.select(asset, x2).where(F.col(x2).isNotNull()).distinct()
    met = cut(a.join(b, asset).select(asset, x, "_n", (F.col(x2) - F.col(x)).alias("shift")))
    order = Window.partitionBy(asset, x).orderBy("shift")
    ends = met.withColumn("_before", F.lag("shift").over(order)).withColumn("_after", F.lead("shift").over(order))
    starts = ends.where(F.col("_before").isNull() | (F.col("shift") - F.col("_before") > 2 * reach + 1)).select((F.col("shift") - reach).alias("_at"), F.col("_n").alias("_d"))
    stops = ends.where(F.col("_after").isNull() | (F.col("_after") - F.col("shift") > 2 * reach + 1)).select((F.col("shift") + reach + 1).alias("_at"), (-F.col("_n")).alias("_d"))
    events = starts.unionByName(stops).unionByName(met.select(F.col("shift").alias("_at"), F.lit(0).cast("long").alias("_d")).distinct())
    summed = events.groupBy("_at").agg(F.sum("_d").alias("_d"))
    votes = summed.select(F.col("_at").alias("shift"), F.sum("_d").over(Window.orderBy("_at")).alias("votes"))
    return votes.join(met.select("shift").distinct(), "shift", "left_semi")


def patched(rows: DataFrame, patches: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with values of a patch put over them; NULL in a patch leaves the value. ``patched`` tells which rows changed."""
    over = patches.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = rows.join(over, key, "left")
    changed = [F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)) for c in columns]
    any_changed = changed[0]
    for c in changed[1:]:
        any_changed = any_changed | c
    return joined.select(*[c for c in rows.columns if c not in columns], *[F.coalesce(f"_{c}", c).alias(c) for c in columns], (F.coalesce(F.col("_hit"), F.lit(False)) & any_changed).alias("patched"))


def reconciled(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Key and state (same, differs, only_left, only_right) of every key of two tables."""
    a = left.select(*key, F.struct(*columns).alias("_a"), F.lit(1).alias("_ha"))
    b = right.select(*key, F.struct(*columns).alias("_b"), F.lit(1).alias("_hb"))
    state = F.when(F.col("_hb").isNull(), "only_left").when(F.col("_ha").isNull(), "only_right").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("differs")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))
