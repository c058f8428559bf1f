"""Aggregates with the conventions that matter: null denominators, nearest ranks, back-off levels, out-of-fold fits.

Every function takes and gives DataFrames; partial aggregation is Spark's. Empty inputs give empty results, or one row of NULLs
where there is no grouping; a rate with no cases is NULL, never 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.ranking import ordered
from strataloom.runtime import cut


def rate(hit: Column, among: Column | None = None) -> Column:
    """Share of hits among the rows where ``among`` holds; NULL hits count as misses, no rows give NULL."""
    cases = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    return F.try_divide(F.count(F.when(cases & F.coalesce(hit, F.lit(False)), 1)), F.count(F.when(cases, 1)))


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Value at 0-based position int(share * n) of the sorted non-null values, by a running count over the histogram.

    The histogram combines map-side and its running count goes over ranges of values, so neither a group of many rows nor one of many distinct values is a task of its own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = ordered(counts, by, [value], "_n")
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(q) * F.col("whole")), F.col("whole") - 1), F.col(value)))
    return run.groupBy(*by).agg(*[at(q).alias(name) for name, q in shares.items()])


def histogram(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, name, value, n): how often each positive value stands at the finest level."""
    held = [F.struct(F.lit(i).cast("byte").alias("name"), F.when(F.col(v) > 0, F.col(v).cast("double")).alias("value")) for i, v in enumerate(values)]
    return df.select(*keys, F.inline(F.array(*held))).where("value is not null").groupBy(*keys, "name", "value").agg(F.count(F.lit(1)).alias("n"))


#: Distinct values of a group that are ordered in one task, and parts of a doubling of values by which the middle of larger groups is located.
FEW, PARTS = 1_000_000, 1024


def geometric_medians(cells: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, exp(median(log)) of each value) from the cells of a histogram.

    The two middle values of a group are found by a running count over its values. In groups of more than FEW distinct values, counts in narrow bands of the logarithm
    (PARTS for each doubling) tell the bands that hold them, and only the values of these are ordered, so no task orders a large group.
    """
    keys = [*by, "name"]
    alike = lambda: reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.lit(True))
    named = lambda df: df.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in df.columns if c not in keys])
    summed = cut(cells.groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    large = summed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") > FEW).drop("_values")
    large = F.broadcast(named(large))  # at most one group for FEW cells
    low, high = F.floor((F.col("whole") - 1) / 2), F.floor(F.col("whole") / 2)
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("value")
    small = summed.join(large, alike(), "left_anti").withColumn("at", F.sum("n").over(order)).withColumn("whole", F.sum("n").over(group))
    banded = summed.join(large, alike(), "left_semi").withColumn("band", F.floor(F.log2("value") * PARTS))
    run = banded.groupBy(*keys, "band").agg(F.sum("n").alias("held")).withColumn("upto", F.sum("held").over(Window.partitionBy(*keys).orderBy("band"))).withColumn("whole", F.sum("held").over(group))
    spots = named(run.where((F.col("upto") > low) & (F.col("upto") - F.col("held") <= high)).select(*keys, F.col("band").alias("_band"), (F.col("upto") - F.col("held")).alias("base"), "whole"))
    near = banded.join(spots, alike() & (F.col("band") == F.col("_band")))
    part = near.withColumn("at", F.sum("n").over(Window.partitionBy(*keys, "band").orderBy("value")) + F.col("base"))
    both = small.select(*keys, "value", "at", "whole").unionByName(part.select(*keys, "value", "at", "whole"))
    pick = lambda p: F.log(F.min(F.when(F.col("at") > p, F.col("value"))))
    found = both.groupBy(*keys).agg(F.exp((pick(low) + pick(high)) / 2).alias("median"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == i, F.col("median"))).alias(v) for i, v in enumerate(values)))


def medians_at_levels(df: DataFrame, levels: list[list[str]], keys: list[str], values: list[str]) -> DataFrame:
    """(keys, level, n, geometric medians) at every level; the values are counted once at the finest level and the counts rolled up. Keys not grouped by are NULL."""
    cells = histogram(df, keys, values)
    rolled = hierarchical(cells, [[*level, "name", "value"] for level in levels], [*keys, "name", "value"], [F.sum("n").alias("n")])
    sizes = hierarchical(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), levels, keys, [F.sum("n").alias("n")])
    medians = geometric_medians(rolled, [*keys, "level"], values)
    right = medians.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "level")], *values)
    return sizes.join(right, reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("level") == F.col("_level")), "left").select(*keys, "level", "n", *values)


def hierarchical(df: DataFrame, levels: list[list[str]], keys: list[str], aggregates: list[Column]) -> DataFrame:
    """The aggregates at every level in one pass; ``level`` numbers the grouping sets, keys not grouped by are NULL."""
    sets = df.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(k) for k in keys])
    ids = {sum(2 ** (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in level): n for n, level in enumerate(levels)}
    level = reduce(lambda out, kv: out.when(F.col("_g") == kv[0], kv[1]), list(ids.items())[1:], F.when(F.col("_g") == list(ids)[0], ids[list(ids)[0]]))
    return sets.agg(F.grouping_id().alias("_g"), *aggregates).withColumn("level", level).drop("_g")


def backed_off(df: DataFrame, fitted: DataFrame, levels: list[list[str]], count: str, values: list[str], least: int) -> DataFrame:
    """Each row with the values of its first level that holds at least ``least`` cases, and that level's number.

    The fitted tables are small only by their keys, so no side is forced: Spark broadcasts what its own size estimate allows.
    """
    out = df
    for n, level in enumerate(levels):
        own = fitted.where((F.col("level") == n) & (F.col(count) >= least)) if n + 1 < len(levels) else fitted.where(F.col("level") == n)
        own = own.select(*level, *[F.col(v).alias(f"_{v}{n}") for v in values], F.lit(n).alias(f"_l{n}"))
        if level:
            out = out.join(own, level, "left")
        else:
            # one global row
            out = out.withColumn("_one", F.lit(1)).join(own.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    ns = range(len(levels))
    picked = [F.coalesce(*[F.col(f"_{v}{n}") for n in ns]).alias(v) for v in values]
    return out.select(*df.columns, *picked, F.coalesce(*[F.col(f"_l{n}") for n in ns]).alias("level"))


def without_own(df: DataFrame, by: list[str], value: str, total: str = "_t") -> Column:
    """Mean of the other rows of the group; NULL for a group of one."""
    group = Window.partitionBy(*by)
    return F.try_divide(F.sum(value).over(group) - F.coalesce(F.col(value), F.lit(0)), F.count(value).over(group) - F.when(F.col(value).isNull(), 0).otherwise(1))


def in_scopes(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """One row for each scope that a row belongs to; scopes may overlap."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in scopes.items()]))
    return df.withColumn("scope", F.explode(names))
