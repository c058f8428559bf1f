"""Queries of aggregates, priors and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import aggregate as A
from strataloom.runtime import cut, table


def conditional_rates(spark: SparkSession, root: str) -> DataFrame:
    """Rates with three denominators, per priority and over all."""
    orders = table(spark, root, "orders").withColumn("big", F.col("o_totalprice") > 250000)
    done = F.col("o_orderstatus") == "F"
    sets = orders.groupingSets([[F.col("o_orderpriority")], []], F.col("o_orderpriority"))
    r = lambda c: F.round(c, 6)
    return sets.agg(F.count(F.lit(1)).alias("n"), r(A.rate(done)).alias("done"), r(A.rate(done, F.col("big"))).alias("done_if_big"), r(A.rate(F.col("big"), done)).alias("big_if_done"), r(A.rate(done, F.col("o_totalprice") < 0)).alias("never"))


def macro_micro(spark: SparkSession, root: str) -> DataFrame:
    """Mean over all orders, and mean of the means of segments."""
    joined = table(spark, root, "orders").join(table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    per = joined.groupBy("c_mktsegment").agg(F.avg("o_totalprice").alias("m"), F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.avg("m"), 4).alias("macro"), F.round(F.sum("s") / F.sum("n"), 4).alias("micro"), F.count(F.lit(1)).alias("segments"))


def nearest_rank_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return A.nearest_rank(table(spark, root, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "top": 1.0})


def latency_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Interpolated median and 95th percentile of event values."""
    return table(spark, root, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").join(parts, "l_partkey")


LEVELS, KEYS = [["p_brand", "p_type"], ["p_brand"], []], ["p_brand", "p_type"]


def size_prior(spark: SparkSession, root: str) -> DataFrame:
    """Geometric medians by brand and type, by brand, and over all."""
    fitted = A.medians_at_levels(_sizes(spark, root), LEVELS, KEYS, ["l_quantity", "l_extendedprice"])
    return fitted.select("p_brand", "p_type", "level", "n", F.round("l_quantity", 6).alias("quantity"), F.round("l_extendedprice", 4).alias("price"))


def prior_backoff(spark: SparkSession, root: str) -> DataFrame:
    """Which level serves how many parts, if a level needs 500 cases."""
    fitted = A.medians_at_levels(_sizes(spark, root), LEVELS, KEYS, ["l_quantity"]).withColumnRenamed("l_quantity", "quantity")
    parts = table(spark, root, "part").select("p_partkey", "p_brand", "p_type")
    served = A.backed_off(parts, fitted, LEVELS, "n", ["quantity"], 500)
    return served.groupBy("level").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("quantity"), 6).alias("quantity"))


def oof_prior(spark: SparkSession, root: str) -> DataFrame:
    """Geometric medians of a brand from the orders outside each of five folds.

    The statistic isn't additive, so each count of a value enters the four folds it doesn't belong to; the fold comes from the order, so orders stay whole.
    """
    fold = text.sha1_modulo(F.col("l_orderkey").cast("string"), 5)
    rows = cut(_sizes(spark, root).withColumn("own", fold).groupBy("own", "p_brand", "l_quantity").agg(F.count(F.lit(1)).alias("n")))
    folds = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda f: f != F.col("own")))
    others = rows.withColumn("fold", folds)
    cells = others.where("l_quantity > 0").select("fold", "p_brand", F.lit(0).cast("byte").alias("name"), F.col("l_quantity").cast("double").alias("value"), "n")
    fitted = A.geometric_medians(cells, ["fold", "p_brand"], ["l_quantity"])
    return others.groupBy("fold", "p_brand").agg(F.sum("n").alias("n")).join(fitted, ["fold", "p_brand"]).select("fold", "p_brand", "n", F.round("l_quantity", 6).alias("quantity"))


def loo_means(spark: SparkSession, root: str) -> DataFrame:
    """Error of predicting a quantity by the mean of the other lines of its part."""
    lines = table(spark, root, "lineitem").select("l_partkey", "l_quantity")
    guessed = lines.withColumn("guess", A.without_own(lines, ["l_partkey"], "l_quantity"))
    return guessed.groupBy((F.col("l_partkey") % 10).alias("part_class")).agg(F.count("guess").alias("n"), F.round(F.avg(F.abs(F.col("l_quantity") - F.col("guess"))), 6).alias("mae"))


def pooled_means(spark: SparkSession, root: str) -> DataFrame:
    """Exact mean of a stratum from the sums and counts of its parts."""
    per = table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("m"), F.count("l_discount").alias("n"))
    return per.groupBy("l_returnflag").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 8).alias("discount"), F.sum("n").alias("n"))


def check_status_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Counts by code and tri-state status."""
    status = F.when(F.col("value").isNull() | (F.col("value") < 1), "unknown").when(F.col("value") > 20, "violation").otherwise("pass")
    return table(spark, root, "events").withColumn("status", status).groupBy(F.col("event_type").alias("code")).pivot("status", ["pass", "violation", "unknown"]).agg(F.count(F.lit(1))).na.fill(0)


def copies_lag(spark: SparkSession, root: str) -> DataFrame:
    """Events that repeat the type of the event before, of the same user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, root, "events").withColumn("before", F.lag("event_type").over(order))
    return pairs.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("before") == F.col("event_type"), 1)).alias("repeats"))


def scoped_means(spark: SparkSession, root: str) -> DataFrame:
    """Overlapping scopes in one aggregate."""
    orders = table(spark, root, "orders")
    scopes = {"all": F.lit(True), "urgent": F.col("o_orderpriority").startswith("1"), "large": F.col("o_totalprice") > 300000, "open": F.col("o_orderstatus") == "O"}
    return A.in_scopes(orders, scopes).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def long_counters(spark: SparkSession, root: str) -> DataFrame:
    """Counters of each source as (source, counter, value)."""
    docs = table(spark, root, "documents")
    flags = F.array(F.lit("texts"), F.when(F.col("lang").isNull(), F.lit("no_lang")), F.when(F.col("uid").isNotNull(), F.lit("with_room")), F.when(F.col("n_chars") > 1000, F.lit("long")), F.concat(F.lit("lang_"), "lang"))
    return docs.select("source", F.explode(F.array_compact(flags)).alias("counter")).groupBy("source", "counter").agg(F.count(F.lit(1)).alias("value"))


def rule_shares(spark: SparkSession, root: str) -> DataFrame:
    """Share of lines that fail each rule."""
    failed = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, F.lit("discount")), F.when(F.col("l_quantity") < 3, F.lit("few")), F.when(F.col("l_tax") == 0, F.lit("no_tax"))))
    lines = table(spark, root, "lineitem").select(failed.alias("failed"))
    per = lines.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("total", total).select(F.explode("failed").alias("rule"), "n", "total").groupBy("rule").agg(F.sum("n").alias("lines"), F.round(F.sum("n") / F.max("total"), 6).alias("share"))


def length_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Texts in buckets of doubling length."""
    chars = F.length("text")
    return table(spark, root, "documents").where("text is not null").groupBy("source", F.floor(F.log2(F.greatest(chars, F.lit(1)))).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("texts"), F.max(chars).cast("long").alias("longest"))


def top_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The five most frequent part names of each brand, with the number of distinct names."""
    counts = table(spark, root, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_name")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("names", F.count(F.lit(1)).over(Window.partitionBy("p_brand"))).where("rank <= 5")


def moving_split(spark: SparkSession, root: str) -> DataFrame:
    """Median and 95th percentile over all and over moved cases."""
    moved = F.when(F.col("value") > 5, F.col("value"))
    return table(spark, root, "events").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(moved, F.lit(0.5)), 6).alias("p50_moved"), F.round(F.percentile(moved, F.lit(0.95)), 6).alias("p95_moved"), F.round(F.count(moved) / F.count(F.lit(1)), 6).alias("share_moved"), F.max("value").alias("most"))


def smoothed_logp(spark: SparkSession, root: str) -> DataFrame:
    """Smoothed log probability of a quantity cell given the type, backed off to all lines."""
    rows = _sizes(spark, root).select("p_type", F.floor(F.col("l_quantity") / 5).cast("long").alias("cell"))
    cells = rows.groupBy("p_type", "cell").agg(F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy("cell").agg(F.sum("n").alias("all_n")).withColumn("all_total", F.sum("all_n").over(Window.partitionBy(F.lit(1))))
    totals = cells.withColumn("total", F.sum("n").over(Window.partitionBy("p_type")))
    base = F.col("all_n") / F.col("all_total")
    return totals.join(whole, "cell").select("p_type", "cell", F.round(F.log((F.col("n") + 10 * base) / (F.col("total") + 10)), 8).alias("logp"))


QUERIES = {f.__name__: f for f in (conditional_rates, macro_micro, nearest_rank_percentiles, latency_percentiles, size_prior, prior_backoff, oof_prior, loo_means, pooled_means, check_status_pivot, copies_lag, scoped_means, long_counters, rule_shares, length_histogram, top_kinds, moving_split, smoothed_logp)}


def _modulo(key: str, modulus: int) -> str:
    acc = "0"
    for i in range(5):
        acc = f"(({acc}) * {4294967296 % modulus} + CAST(('0x' || substr(sha1({key}), {1 + 8 * i}, 8)) AS BIGINT)) % {modulus}"
    return acc


_S = "WITH s AS (SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey)"
ORACLES = {
    "conditional_rates": """
        WITH o AS (SELECT *, o_totalprice > 250000 AS big, o_orderstatus = 'F' AS done FROM orders)
        SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (done) / count(*), 6) AS done, round(count(*) FILTER (done AND big) / nullif(count(*) FILTER (big), 0), 6) AS done_if_big,
        round(count(*) FILTER (done AND big) / nullif(count(*) FILTER (done), 0), 6) AS big_if_done, CAST(NULL AS DOUBLE) AS never FROM o GROUP BY GROUPING SETS ((o_orderpriority), ())""",
    "macro_micro": "WITH p AS (SELECT c_mktsegment, avg(o_totalprice) AS m, sum(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT round(avg(m), 4) AS macro, round(sum(s) / sum(n), 4) AS micro, count(*) AS segments FROM p",
    "nearest_rank_percentiles": "WITH l AS (SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, v[CAST(floor(0.5 * len(v)) AS BIGINT) + 1] AS p50, v[CAST(floor(0.9 * len(v)) AS BIGINT) + 1] AS p90, v[CAST(floor(0.99 * len(v)) AS BIGINT) + 1] AS p99, v[len(v)] AS top FROM l",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "size_prior": _S + " SELECT p_brand, p_type, CASE WHEN grouping(p_brand) = 1 THEN 2 WHEN grouping(p_type) = 1 THEN 1 ELSE 0 END AS level, count(*) AS n, round(exp(median(ln(l_quantity))), 6) AS quantity, round(exp(median(ln(l_extendedprice))), 4) AS price FROM s GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())",
    "prior_backoff": _S + """, a AS (SELECT p_brand, p_type, count(*) AS n, exp(median(ln(l_quantity))) AS q FROM s GROUP BY 1, 2), b AS (SELECT p_brand, count(*) AS n, exp(median(ln(l_quantity))) AS q FROM s GROUP BY 1), c AS (SELECT exp(median(ln(l_quantity))) AS q FROM s)
        , r AS (SELECT CASE WHEN a.n >= 500 THEN 0 WHEN b.n >= 500 THEN 1 ELSE 2 END AS level, CASE WHEN a.n >= 500 THEN a.q WHEN b.n >= 500 THEN b.q ELSE (SELECT q FROM c) END AS q FROM part p LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_type = p.p_type LEFT JOIN b ON b.p_brand = p.p_brand)
        SELECT level, count(*) AS parts, round(avg(q), 6) AS quantity FROM r GROUP BY 1""",
    "oof_prior": _S + f", f AS (SELECT *, {_modulo('CAST(l_orderkey AS VARCHAR)', 5)} AS own FROM s) SELECT CAST(k.fold AS BIGINT) AS fold, p_brand, count(*) AS n, round(exp(median(ln(l_quantity))), 6) AS quantity FROM f JOIN (SELECT unnest(range(0, 5)) AS fold) k ON k.fold <> f.own GROUP BY 1, 2",
    "loo_means": "WITH w AS (SELECT l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_partkey) AS s, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem), g AS (SELECT *, (s - l_quantity) / nullif(n - 1, 0) AS guess FROM w) SELECT l_partkey % 10 AS part_class, count(guess) AS n, round(avg(abs(l_quantity - guess)), 6) AS mae FROM g GROUP BY 1",
    "pooled_means": "SELECT l_returnflag, round(avg(l_discount), 8) AS discount, count(l_discount) AS n FROM lineitem GROUP BY 1",
    "check_status_pivot": "SELECT event_type AS code, count(*) FILTER (value >= 1 AND value <= 20) AS pass, count(*) FILTER (value > 20) AS violation, count(*) FILTER (value IS NULL OR value < 1) AS unknown FROM events GROUP BY 1",
    "copies_lag": "SELECT event_type, count(*) AS n, count(*) FILTER (before = event_type) AS repeats FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1",
    "scoped_means": """
        WITH s AS (SELECT 'all' AS scope, * FROM orders UNION ALL SELECT 'urgent', * FROM orders WHERE starts_with(o_orderpriority, '1') UNION ALL SELECT 'large', * FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'open', * FROM orders WHERE o_orderstatus = 'O')
        SELECT scope, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM s GROUP BY 1""",
    "long_counters": """
        WITH c AS (SELECT source, 'texts' AS counter FROM documents UNION ALL SELECT source, 'no_lang' FROM documents WHERE lang IS NULL UNION ALL SELECT source, 'with_room' FROM documents WHERE uid IS NOT NULL UNION ALL SELECT source, 'long' FROM documents WHERE n_chars > 1000 UNION ALL SELECT source, 'lang_' || lang FROM documents WHERE lang IS NOT NULL)
        SELECT source, counter, count(*) AS value FROM c GROUP BY 1, 2""",
    "rule_shares": """
        WITH n AS (SELECT count(*) AS t FROM lineitem), f AS (SELECT 'discount' AS rule FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT 'few' FROM lineitem WHERE l_quantity < 3 UNION ALL SELECT 'no_tax' FROM lineitem WHERE l_tax = 0)
        SELECT rule, count(*) AS lines, round(count(*) / (SELECT t FROM n), 6) AS share FROM f GROUP BY 1""",
    "length_histogram": "SELECT source, CAST(floor(log2(greatest(length(text), 1))) AS BIGINT) AS bucket, count(*) AS texts, max(length(text)) AS longest FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "top_kinds": "WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rank, count(*) OVER (PARTITION BY p_brand) AS names FROM c) SELECT * FROM r WHERE rank <= 5",
    "moving_split": "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.5) FILTER (value > 5), 6) AS p50_moved, round(quantile_cont(value, 0.95) FILTER (value > 5), 6) AS p95_moved, round(count(*) FILTER (value > 5) / count(*), 6) AS share_moved, max(value) AS most FROM events",
    "smoothed_logp": _S + ", c AS (SELECT p_type, CAST(floor(l_quantity / 5) AS BIGINT) AS cell, count(*) AS n FROM s GROUP BY 1, 2), w AS (SELECT cell, sum(n) AS a, sum(sum(n)) OVER () AS t FROM c GROUP BY 1), x AS (SELECT *, sum(n) OVER (PARTITION BY p_type) AS total FROM c) SELECT p_type, cell, round(ln((n + 10 * (a / t)) / (total + 10)), 8) AS logp FROM x JOIN w USING (cell)",
}
