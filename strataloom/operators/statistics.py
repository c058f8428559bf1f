"""Inference on tables: resampling, adjustments, rank correlations, distances of distributions.

Resampling works on sufficient statistics (sum, count) of clusters. The weight of a cluster in a replicate is a Poisson(1)
draw read off sha256(replicate, cluster), so a result doesn't depend on the layout of the data, and a replicate needs no pass of its own.

Defined cases: a replicate without cases is NULL and left out of the interval; an interval is NULL where fewer than ``needed`` draws are defined; groups of one give NULL
correlations; empty inputs give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.text import sha256_share

# cumulated Poisson(1): P(X <= 0), P(X <= 1), ...
POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(7)]


def poisson_weight(share: Column) -> Column:
    """The Poisson(1) quantile of a share, at most 7."""
    return sum(((share >= p).cast("int") for p in POISSON), F.lit(0))


def replicates(clusters: DataFrame, by: list[str], key: str, num: str, den: str, draws: int) -> DataFrame:
    """(by, draw, value) of the ratio sum(num) / sum(den) in each replicate.

    Each cluster goes to its draws inside the task; partial sums by (group, draw) are all that is shuffled.
    """
    spread = clusters.select(*by, F.col(key).cast("string").alias("_k"), num, den, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    weighted = spread.withColumn("_w", poisson_weight(sha256_share(F.concat_ws("|", F.col("draw").cast("string"), "_k"))))
    return weighted.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("_w") * F.col(num)), F.sum(F.col("_w") * F.col(den))).alias("value"))


def interval(drawn: DataFrame, by: list[str], needed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval and two-sided sign share of the draws of each group."""
    n = F.count("value")
    ok = n >= needed
    p = F.least(F.lit(1.0), 2 * F.least(F.count(F.when(F.col("value") <= 0, 1)), F.count(F.when(F.col("value") >= 0, 1))) / n)
    return drawn.groupBy(*by).agg(F.when(ok, F.percentile("value", F.lit(low))).alias("low"), F.when(ok, F.percentile("value", F.lit(high))).alias("high"), F.when(ok, p).alias("p"), n.alias("draws"))


def holm(df: DataFrame, p: str, key: str, by: list[str] = ()) -> DataFrame:
    """Step-down adjusted values of a family of tests, as ``adjusted``."""
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    order = whole.orderBy(p, key)
    scaled = F.col(p) * (F.count(p).over(whole) - F.row_number().over(order) + 1)
    return df.withColumn("_s", scaled).withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def sign_p(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial value of a sign test; 1 for no untied pair. Sums run in logs, so large counts don't vanish."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct((-n * F.lit(math.log(2.0))).cast("double").alias("log"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct((acc["log"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step, lambda acc: acc["sum"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(F.lit(1.0))


#: Systems whose scores are compared pair by pair, at most.
MOST_SYSTEMS = 5000


def mid_rank(c: str, by: list[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2


def kendall(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Tau-b of two scores over few systems; each pair of systems once. More than MOST_SYSTEMS are refused: all pairs of them would be formed."""
    if df.limit(MOST_SYSTEMS + 1).count() > MOST_SYSTEMS:
        raise ValueError(f"more than {MOST_SYSTEMS} systems")
    right = df.select(F.col(key).alias("_k"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    x, y = F.signum(F.col(a) - F.col("_a")), F.signum(F.col(b) - F.col("_b"))
    pairs = df.join(right, F.col(key) < F.col("_k")).select(x.alias("x"), y.alias("y"))
    return pairs.agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.abs("x")) * F.sum(F.abs("y")))).alias("tau"), F.count(F.lit(1)).alias("pairs"))


def moments(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, total, gram): sums and products of the vectors of each group.

    Tasks add up their own rows; what is shuffled is one row for each task and group, whatever the number of vectors.
    """
    schema = T.StructType([df.schema[by], T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def partial(frames):
        import numpy as np
        import pandas as pd

        held: dict = {}
        for pdf in frames:
            for key, part in pdf.groupby(by, dropna=False):
                rows = np.stack(part[vector].to_numpy()).astype(float)
                n, total, gram = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(rows), total + rows.sum(0), gram + rows.T @ rows)
        if held:
            yield pd.DataFrame([(k, n, t.tolist(), g.ravel().tolist()) for k, (n, t, g) in held.items()], columns=[by, "n", "total", "gram"])

    return df.where(F.col(vector).isNotNull()).select(by, vector).mapInPandas(partial, schema)


def frechet(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Frechet distance of the vectors of each group to those of all other groups."""
    parts = moments(df, by, vector)
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("n", T.LongType()), T.StructField("distance", T.DoubleType())])

    def solve(pdf):
        import numpy as np
        import pandas as pd

        size = len(pdf["total"].iloc[0])
        held: dict = {}
        for key, n, total, gram in zip(pdf[by], pdf["n"], pdf["total"], pdf["gram"]):
            a = held.setdefault(str(key), [0, np.zeros(size), np.zeros((size, size))])
            a[0] += n
            a[1] = a[1] + np.asarray(total)
            a[2] = a[2] + np.asarray(gram).reshape(size, size)
        whole = [sum(v[i] for v in held.values()) for i in range(3)]

        def shape(n, total, gram):
            mean = total / n
            return mean, (gram - n * np.outer(mean, mean)) / max(n - 1, 1)

        rows = []
        for key, own in sorted(held.items()):
            other = [w - o for w, o in zip(whole, own)]
            if own[0] < 2 or other[0] < 2:
                rows.append((key, int(own[0]), None))
                continue
            (m1, c1), (m2, c2) = shape(*own), shape(*other)
            values, vectors = np.linalg.eigh(c1)
            root = vectors * np.sqrt(np.clip(values, 0, None)) @ vectors.T
            cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ c2 @ root), 0, None)).sum()
            rows.append((key, int(own[0]), float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)))
        return pd.DataFrame(rows, columns=["group", "n", "distance"])

    def merge(pdf):
        import numpy as np
        import pandas as pd

        total, gram = (np.sum(np.stack(pdf[c].to_numpy()), axis=0) for c in ("total", "gram"))
        return pd.DataFrame([(pdf[by].iloc[0], int(pdf["n"].sum()), total.tolist(), gram.tolist())], columns=[by, "n", "total", "gram"])

    # what the tasks added up is added up for each group first; the last step sees one row a group
    merged = parts.groupBy(by).applyInPandas(merge, parts.schema)
    return merged.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(solve, schema)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def verdict(low: Column, high: Column, higher_is_better: Column) -> Column:
    """``a_better`` or ``a_worse`` where an interval of a difference a - b leaves 0 out, else NULL."""
    above = F.when(low > 0, True).when(high < 0, False)
    return F.when(above.isNotNull(), F.when(above == higher_is_better, "a_better").otherwise("a_worse"))


def delivered(estimate: Column, size_high: Column, success_low: Column, margin: float) -> Column:
    """Whether a joint arm may be delivered: its size error is lower with its whole interval, and its success isn't worse by more than the margin; unknown intervals refuse."""
    smaller = F.coalesce((estimate < 0) & (size_high < 0), F.lit(False))
    return smaller & F.coalesce(success_low >= F.lit(margin), F.lit(False))


def size_agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """(overlap ratio of two boxes at one corner, mean absolute log ratio of their sizes) of arrays of three positive numbers; NULL where one isn't."""
    whole = F.forall(F.concat(a, b), lambda v: v.isNotNull() & (v > 0)) & (F.size(a) == 3) & (F.size(b) == 3)
    volume = lambda v: v[0] * v[1] * v[2]
    both = volume(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    logs = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(F.log(x / y))), F.lit(0.0), lambda s, v: s + v) / 3
    return F.when(whole, both / (volume(a) + volume(b) - both)), F.when(whole, logs)
