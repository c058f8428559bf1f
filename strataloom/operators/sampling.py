"""Deterministic ranks, quotas, batches and shards.

Order is always a digest of the key, so results don't depend on the layout of the data. Windows run over a stratum;
where a stratum may be large, ``top_by_digest`` keeps the best rows of each salt first, so no task sorts a whole stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.runtime import as_batch


def digest_of(*parts: Column | str) -> Column:
    """sha256 of the parts, separated by a zero byte."""
    return F.sha2(F.concat_ws("\x00", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def top_by_digest(df: DataFrame, by: list[str], order: Column, n: int, ties: list[str], salts: int = 16) -> DataFrame:
    """The n rows of each group with the smallest order; at most n rows of each salt of a group reach the last sort."""
    marked = df.withColumn("_o", order).withColumn("_salt", F.pmod(F.xxhash64("_o", *ties), F.lit(salts)))
    first = Window.partitionBy(*by, "_salt").orderBy("_o", *ties)
    last = Window.partitionBy(*by).orderBy("_o", *ties)
    few = marked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    return few.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n).drop("_o", "_salt", "_r")


def largest_remainder(groups: DataFrame, by: list[str], weight: str, total: int, least: int = 0) -> DataFrame:
    """``quota`` rows for each group, in proportion to ``weight``, summing to ``total``; leftovers go to the largest remainders.

    One row a group enters; groups of equal remainder are ordered by name.
    """
    every = Window.partitionBy(F.lit(1))
    exact = F.col(weight) * F.lit(total) / F.sum(weight).over(every)
    floors = groups.withColumn("_e", exact).withColumn("_f", F.greatest(F.floor("_e"), F.lit(least)))
    left = F.lit(total) - F.sum("_f").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("_e") - F.floor("_e"), 9)), *by))
    return floors.withColumn("_left", left).withColumn("_rank", rank).withColumn("quota", (F.col("_f") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_e", "_f", "_left", "_rank")


def replicated(df: DataFrame, weight: Column, share: Column) -> DataFrame:
    """Each row int(weight) times, and once more where its hash share lies under the rest of the weight; ``copy`` counts from 1."""
    times = F.floor(weight) + F.when(share < weight - F.floor(weight), 1).otherwise(0)
    return df.withColumn("_n", times.cast("int")).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def budget_chunks(df: DataFrame, by: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """``chunk`` numbers for consecutive rows of a group: a chunk ends before the row that would pass ``budget``; every chunk holds a row.

    A running sum with reset isn't a window function. The fold runs over rows sorted inside their partition and carries two numbers,
    so a group is streamed, never held.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())])
    arrow = to_arrow_schema(schema)
    names = df.columns
    at, what = names.index(by), names.index(cost)

    def run(batches):
        group, chunk, used, fresh = None, 0, 0, True
        for batch in batches:
            out = []
            for record in zip(*(c.to_pylist() for c in batch.columns)):
                if fresh or record[at] != group:
                    group, chunk, used, fresh = record[at], 0, 0, False
                elif used + record[what] > budget:
                    chunk, used = chunk + 1, 0
                used += record[what]
                out.append((*record, chunk))
            if out:
                yield as_batch(out, arrow)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def shard_of(rank: Column, shards: int) -> Column:
    """Round-robin shard of a rank from 1."""
    return F.pmod(rank - 1, F.lit(shards))
