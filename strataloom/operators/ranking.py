"""Ranks and running sums inside groups of any size.

A window over a whole group sorts the group in one task. Here the order is a
64-bit hash, cut into ``width`` equal ranges: a row's rank is the count of the lower ranges
of its group plus its rank inside its range. No task holds more than a range
of a group, and the table of range totals has at most ``width`` rows a group.

``ordered`` does the same for an order by values: rows are laid out by range of (group, order), and a row's rank is the count of its group in the parts before its own plus its
rank in its part.

Defined cases: an empty input gives an empty result; rows whose key is NULL order as the
hash of NULL; equal hashes are ordered by the key columns themselves; rows equal in all of them get
different ranks in no defined order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.runtime import cut, shuffle_width

#: Buckets per group, at least; four for each shuffle partition where that is more.
WIDTH = 256


def spread_hash(*columns: str, seed: int = 0):
    """A signed 64-bit hash that depends on ``seed``."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def ranked(df: DataFrame, by: list[str], key: list[str], seed: int = 0, size: str | None = None, width: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1) and, with ``size``, ``upto``: the running sum of ``size`` up to and with the row."""
    width = width or max(WIDTH, 4 * shuffle_width(df.sparkSession))
    marked = df.withColumn("_h", spread_hash(*key, seed=seed)).withColumn("_r", F.pmod(F.shiftrightunsigned(F.col("_h"), 40), F.lit(width)))
    weight = F.col(size) if size else F.lit(0)
    totals = marked.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_r").alias("_kr"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum"))
    inside = Window.partitionBy(*by, "_r").orderBy("_h", *key)
    local = marked.withColumn("_i", F.row_number().over(inside))
    if size:
        local = local.withColumn("_u", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = [F.col("_r") == F.col("_kr"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))]
    joined = local.join(offsets, on).withColumn("rank", (F.col("_i") + F.col("_before")).cast("long"))
    if size:
        joined = joined.withColumn("upto", F.col("_u") + F.col("_sum"))
    extra = ["_h", "_r", "_i", "_u", "_kr", "_before", "_sum", *(f"_k{i}" for i in range(len(by)))]
    return joined.drop(*extra)


def ordered(df: DataFrame, by: list[str], order: list, size: str | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1) in the order of ``order`` inside its group, ``every`` (rows of the group) and, with ``size``, ``upto`` (running sum up to and with the row) and
    ``whole`` (sum of the group).

    ``order`` holds names or sort columns and must tell all rows of a group apart; ties get different ranks in no defined order. The layout by range is written before it is
    counted, as its borders are drawn from a sample.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    laid = df.repartitionByRange(shuffle_width(df.sparkSession), *[F.col(c) for c in by], *keys)
    laid = cut(laid.withColumn("_p", F.spark_partition_id()))
    weight = F.col(size) if size else F.lit(0)
    totals = laid.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_s"))
    group = Window.partitionBy(*by)  # at most one row for each part
    before = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_kp"), zero(F.sum("_n").over(before)).alias("_before"), zero(F.sum("_s").over(before)).alias("_sum"), F.sum("_n").over(group).alias("every"), F.sum("_s").over(group).alias("_whole"))
    inside = Window.partitionBy(*by, "_p").orderBy(*keys)
    local = laid.withColumn("_i", F.row_number().over(inside))
    if size:
        local = local.withColumn("_u", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = [F.col("_p") == F.col("_kp"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))]
    joined = local.join(offsets, on).withColumn("rank", (F.col("_i") + F.col("_before")).cast("long"))
    if size:
        joined = joined.withColumn("upto", F.col("_u") + F.col("_sum")).withColumn("whole", F.col("_whole"))
    return joined.drop("_p", "_i", "_u", "_kp", "_before", "_sum", "_whole", *(f"_k{i}" for i in range(len(by))))
