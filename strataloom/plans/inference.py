"""Queries of statistics, selection, derivations, publication and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import statistics as S
from strataloom.runtime import checkpoint_dir, table
from strataloom.streaming import ledger


def _clusters(spark: SparkSession, root: str) -> DataFrame:
    """(segment, customer, sum, n) of orders in whole units."""
    customers = table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, root, "orders").join(customers, "o_custkey").groupBy("c_mktsegment", "o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("s"), F.count(F.lit(1)).alias("n"))


def cluster_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Interval of the mean order of each segment, customers drawn whole."""
    drawn = S.replicates(_clusters(spark, root), ["c_mktsegment"], "o_custkey", "s", "n", 100)
    return S.interval(drawn, ["c_mktsegment"], 95).select("c_mktsegment", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "draws")


def paired_delta(spark: SparkSession, root: str) -> DataFrame:
    """Per segment: mean difference of two arms on customers that have both, and its bootstrap sign share."""
    customers = table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, root, "orders").join(customers, "o_custkey")
    arms = orders.groupBy("c_mktsegment", "o_custkey").agg(F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice"))).alias("a"), F.avg(F.when(F.col("o_orderkey") % 2 == 1, F.floor("o_totalprice"))).alias("b")).where("a is not null and b is not null")
    clusters = arms.select("c_mktsegment", "o_custkey", F.round(F.col("a") - F.col("b"), 6).alias("delta"), F.lit(1).alias("one"))
    point = clusters.groupBy("c_mktsegment").agg(F.round(F.avg("delta"), 4).alias("delta"), F.count(F.lit(1)).alias("pairs"))
    drawn = S.replicates(clusters, ["c_mktsegment"], "o_custkey", "delta", "one", 60)
    return point.join(S.interval(drawn, ["c_mktsegment"], 50), "c_mktsegment").select("c_mktsegment", "delta", "pairs", F.round("p", 6).alias("p"))


def _wins(spark: SparkSession, root: str) -> DataFrame:
    customers = table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, root, "orders").join(customers, "o_custkey").groupBy("c_nationkey").agg(F.count(F.when(F.col("o_totalprice") > 250000, 1)).alias("wins"), F.count(F.when(F.col("o_totalprice") <= 250000, 1)).alias("losses"))


def sign_test(spark: SparkSession, root: str) -> DataFrame:
    return _wins(spark, root).select("c_nationkey", "wins", "losses", F.round(S.sign_p(F.col("wins"), F.col("losses")), 9).alias("p"))


def holm_adjusted(spark: SparkSession, root: str) -> DataFrame:
    return S.holm(sign_test(spark, root).select("c_nationkey", "p"), "p", "c_nationkey").select("c_nationkey", "p", F.round("adjusted", 8).alias("adjusted"))


def kendall_tau(spark: SparkSession, root: str) -> DataFrame:
    """Agreement of two rankings of nations."""
    scores = _wins(spark, root).select("c_nationkey", (F.col("wins") % 20).alias("a"), (F.col("losses") % 20).alias("b"))
    return S.kendall(scores, "c_nationkey", "a", "b").select(F.round("tau", 8).alias("tau"), "pairs")


def spearman(spark: SparkSession, root: str) -> DataFrame:
    """Rank correlation of size and price within each brand."""
    parts = table(spark, root, "part").select("p_brand", "p_size", "p_retailprice")
    ranked = parts.select("p_brand", S.mid_rank("p_size", ["p_brand"]).alias("a"), S.mid_rank("p_retailprice", ["p_brand"]).alias("b"))
    return ranked.groupBy("p_brand").agg(F.round(F.corr("a", "b"), 8).alias("rho"), F.count(F.lit(1)).alias("n"))


def kernel_distance(spark: SparkSession, root: str) -> DataFrame:
    """Unbiased kernel distance of the two halves of each label, over pairs of places in the halves."""
    order = Window.partitionBy("label", "half").orderBy("vec_id")
    rows = table(spark, root, "embeddings").withColumn("half", F.col("vec_id") % 2).withColumn("at", F.row_number().over(order))
    pairs = rows.where("half = 0").select("label", "at", F.col("embedding").alias("x")).join(rows.where("half = 1").select("label", "at", F.col("embedding").alias("y")), ["label", "at"])
    other = pairs.select("label", F.col("at").alias("at2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    k = lambda a, b: F.pow(S.dot(a, b) / 64 + 1, 3)
    h = k("x", "x2") + k("y", "y2") - k("x", "y2") - k("x2", "y")
    return pairs.join(other, "label").where("at < at2").groupBy("label").agg(F.round(F.avg(h), 8).alias("kid"), F.count(F.lit(1)).alias("pairs"))


def kernel_distance_whole(spark: SparkSession, root: str) -> DataFrame:
    """Kernel distance of the two halves of each label with its standard error, 2 * sqrt(var(h1) / n) with h1 the mean of a place over the others.

    The halves share no key, so vectors meet by place; those of the larger half without partner are counted as ``unpaired``.
    """
    order = Window.partitionBy("label", "half").orderBy("vec_id")
    rows = table(spark, root, "embeddings").withColumn("half", F.pmod("vec_id", F.lit(2))).withColumn("at", F.row_number().over(order))
    held = rows.groupBy("label").agg(F.count(F.when(F.col("half") == 0, 1)).alias("a"), F.count(F.when(F.col("half") == 1, 1)).alias("b"))
    pairs = rows.where("half = 0").select("label", "at", F.col("embedding").alias("x")).join(rows.where("half = 1").select("label", "at", F.col("embedding").alias("y")), ["label", "at"])
    other = pairs.select("label", F.col("at").alias("at2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    k = lambda a, b: F.pow(S.dot(a, b) / F.size(a) + 1, 3)
    h = k("x", "x2") + k("y", "y2") - k("x", "y2") - k("x2", "y")
    means = pairs.join(other, "label").where("at <> at2").groupBy("label", "at").agg(F.avg(h).alias("h1"))
    kid = means.groupBy("label").agg(F.round(F.avg("h1"), 8).alias("kid"), F.round(2 * F.sqrt(F.var_samp("h1") / F.count(F.lit(1))), 8).alias("se"))
    return held.join(kid, "label", "left").select("label", F.least("a", "b").alias("n"), "kid", "se", F.abs(F.col("a") - F.col("b")).alias("unpaired"))


def frechet_by_label(spark: SparkSession, root: str) -> DataFrame:
    d = S.frechet(table(spark, root, "embeddings"), "label", "embedding")
    return d.select(F.col("group").alias("label"), "n", F.round("distance", 6).alias("distance"))


def daily_slope(spark: SparkSession, root: str) -> DataFrame:
    """Least-squares slope of the mean value over the hour of day, per type."""
    hourly = table(spark, root, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    return hourly.groupBy("event_type").agg(F.round(F.regr_slope("v", "h"), 8).alias("slope"), F.count(F.lit(1)).alias("points"))


def crossing_points(spark: SparkSession, root: str) -> DataFrame:
    """Where the curve of mean values by hour crosses its own mean, nearest to noon, by linear interpolation."""
    hourly = table(spark, root, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    level = F.avg("v").over(Window.partitionBy("event_type"))
    order = Window.partitionBy("event_type").orderBy("h")
    steps = hourly.withColumn("d", F.col("v") - level).withColumn("d2", F.lead("d").over(order)).withColumn("h2", F.lead("h").over(order))
    at = F.col("h") + (F.col("h2") - F.col("h")) * F.col("d") / (F.col("d") - F.col("d2"))
    return steps.where((F.col("d") * F.col("d2")) < 0).withColumn("at", F.round(at, 6)).groupBy("event_type").agg(F.min_by("at", F.struct(F.abs(F.col("at") - 12), "at")).alias("at"), F.count(F.lit(1)).alias("crossings"))


def best_of_n(spark: SparkSession, root: str) -> DataFrame:
    """The first candidate with fewest violations among eight events of a user, and the gain over the first."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    few = table(spark, root, "events").select("user_id", "event_id", "ts", F.floor("value").alias("violations")).withColumn("k", F.row_number().over(order) - 1).where("k < 8")
    best = few.groupBy("user_id").agg(F.min_by("k", F.struct("violations", "k")).cast("long").alias("k"), F.min("violations").alias("violations"), F.max(F.when(F.col("k") == 0, F.col("violations"))).alias("first"))
    return best.select("user_id", "k", "violations", (F.col("first") - F.col("violations")).alias("gain"))


def policy_simulation(spark: SparkSession, root: str) -> DataFrame:
    """Outcome of asking a large model only where a small one fails, for three policies."""
    rows = table(spark, root, "orders").select((F.col("o_totalprice") < 300000).alias("small"), (F.col("o_totalprice") % 7 < 6).alias("big"), F.col("o_orderpriority").startswith("1").alias("hard"))
    policies = F.explode(F.array(F.struct(F.lit("never").alias("policy"), F.lit(False).alias("ask")), F.struct(F.lit("on_failure").alias("policy"), (~F.col("small")).alias("ask")), F.struct(F.lit("hard_or_failed").alias("policy"), (F.col("hard") | ~F.col("small")).alias("ask"))))
    return rows.select("small", "big", policies.alias("p")).groupBy("p.policy").agg(F.round(F.avg(F.col("p.ask").cast("int")), 6).alias("asked"), F.round(F.avg(F.when(F.col("p.ask"), F.col("big")).otherwise(F.col("small")).cast("int")), 6).alias("success"))


def tie_band(spark: SparkSession, root: str) -> DataFrame:
    """Of the brands within 2% of the best mean price, the one with fewest parts."""
    brands = table(spark, root, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.count(F.lit(1)).alias("n"))
    banded = brands.withColumn("best", F.max("m").over(Window.partitionBy(F.lit(1)))).where(F.col("m") >= 0.98 * F.col("best"))
    return banded.agg(F.min_by("p_brand", F.struct("n", "p_brand")).alias("p_brand"), F.count(F.lit(1)).alias("eligible"))


def preference_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Highest and lowest order of each customer, if they are far enough apart."""
    ends = table(spark, root, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("chosen"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("rejected"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    return ends.where("chosen <> rejected and hi >= 1.5 * lo").select("o_custkey", "chosen", "rejected")


def quarter_turns(spark: SparkSession, root: str) -> DataFrame:
    """Boxes of an order after k quarter turns, moved so that their lower corner is the origin."""
    lines = table(spark, root, "lineitem").select("l_orderkey", (F.col("l_partkey") % 400).alias("x"), (F.col("l_suppkey") * 3 % 300).alias("y"), (F.col("l_orderkey") % 4).alias("k"))
    tx = F.when(F.col("k") == 0, F.col("x")).when(F.col("k") == 1, -F.col("y")).when(F.col("k") == 2, -F.col("x")).otherwise(F.col("y"))
    ty = F.when(F.col("k") == 0, F.col("y")).when(F.col("k") == 1, F.col("x")).when(F.col("k") == 2, -F.col("y")).otherwise(-F.col("x"))
    moved = lines.select("l_orderkey", "k", tx.alias("x"), ty.alias("y"))
    return moved.groupBy("l_orderkey", "k").agg((F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("depth"), (F.sum("x") - F.count("x") * F.min("x")).alias("checksum"))


def bound_ids(spark: SparkSession, root: str) -> DataFrame:
    """Neutral ids of the lines of an order, numbered in the order of a keyed digest."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    lines = table(spark, root, "lineitem").select("l_orderkey", name.alias("name")).distinct()
    inner = F.sha2(F.concat(F.lit("inner-key|"), "name"), 256)
    order = Window.partitionBy("l_orderkey").orderBy(F.sha2(F.concat(F.lit("outer-key|"), inner), 256), "name")
    return lines.select("name", F.format_string("obj_%04d", F.row_number().over(order)).alias("bound"))


def expanded_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Counted items as single objects with running ids, counted back."""
    items = table(spark, root, "part").select("p_brand", "p_name", (F.col("p_size") % 4 + 1).alias("count"))
    single = items.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("count"))))
    order = Window.partitionBy("p_brand", "p_name").orderBy("count", "i")
    named = single.select("p_brand", F.concat(text.slug(F.col("p_name")), F.lit("_"), F.row_number().over(order).cast("string")).alias("id"))
    return named.groupBy("p_brand").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("id").alias("ids"), F.max("id").alias("last_id"))


def canonical_order(spark: SparkSession, root: str) -> DataFrame:
    """Objects renumbered per brand and slug by area, size and key."""
    parts = table(spark, root, "part").select("p_brand", "p_partkey", text.slug(F.col("p_name")).alias("slug"), "p_size")
    order = Window.partitionBy("p_brand", "slug").orderBy(F.desc("p_size"), "p_partkey")
    return parts.select("p_partkey", F.concat("slug", F.lit("_"), F.row_number().over(order).cast("string")).alias("id"))


def aligned_masks(spark: SparkSession, root: str) -> DataFrame:
    """Counts over validity arrays that run along the objects; arrays are zipped before they are opened."""
    rows = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_tax") > 0.02).alias("ok"), F.col("l_quantity").alias("q"))).alias("o"))
    zipped = rows.select(F.explode(F.arrays_zip(F.transform("o", lambda s: s["ok"]).alias("ok"), F.transform("o", lambda s: s["q"]).alias("q"))).alias("z"))
    return zipped.groupBy("z.ok").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z.q").cast("long")).alias("q"))


def table_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Order-free fingerprint of tables: rows, and the exclusive or of row digests."""

    def one(name: str, cols: list[str]) -> DataFrame:
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])), 1, 15), 16, 10).cast("long")
        return table(spark, root, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.bit_xor(digest).alias("fingerprint"))

    return one("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]).union(one("part", ["p_partkey", "p_name", "p_brand"])).union(one("documents", ["doc_id", "source"]))


def stream_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Events of a file stream kept once a key in a ledger, over several micro-batches."""
    out = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    source = ledger.stream(spark, root, "events", table(spark, root, "events").schema).select("event_id", (F.col("event_id") % 5000).alias("key"))
    ledger.append_once(source, out, ["key"])
    return spark.read.parquet(f"{out}/rows").agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("receipts"))


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Sums of six-hour windows of a stream with a watermark."""
    out = f"{checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    source = ledger.stream(spark, root, "events", table(spark, root, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    ledger.windowed(source, out, "ts", "6 hours", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{out}/rows").select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (cluster_bootstrap, paired_delta, sign_test, holm_adjusted, kendall_tau, spearman, kernel_distance, kernel_distance_whole, frechet_by_label, daily_slope, crossing_points, best_of_n, policy_simulation, tie_band, preference_pairs, quarter_turns, bound_ids, expanded_inventory, canonical_order, aligned_masks, table_fingerprints, stream_ledger, stream_windows)}

_W = "CAST(CAST(('0x' || substr(sha256(CAST(draw AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"
_P = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in S.POISSON)
_WINS = "WITH w AS (SELECT c_nationkey, count(*) FILTER (o_totalprice > 250000) AS wins, count(*) FILTER (o_totalprice <= 250000) AS losses FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)"
_SIGN = _WINS + ", s AS (SELECT c_nationkey, wins, losses, round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))), 9) AS p FROM w)"
_HOUR = "WITH h AS (SELECT event_type, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2)"
ORACLES = {
    "cluster_bootstrap": f"""
        WITH c AS (SELECT c_mktsegment, o_custkey, CAST(sum(floor(o_totalprice)) AS BIGINT) AS s, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
        , u AS (SELECT c_mktsegment, s, n, draw, {_W} AS u FROM c, (SELECT unnest(range(0, 100)) AS draw)), w AS (SELECT *, {_P} AS w FROM u)
        , d AS (SELECT c_mktsegment, draw, CAST(sum(w * s) AS DOUBLE) / CAST(sum(w * n) AS DOUBLE) AS v FROM w GROUP BY 1, 2)
        SELECT c_mktsegment, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high, count(v) AS draws FROM d GROUP BY 1""",
    "paired_delta": f"""
        WITH a AS (SELECT c_mktsegment, o_custkey, avg(floor(o_totalprice)) FILTER (o_orderkey % 2 = 0) AS a, avg(floor(o_totalprice)) FILTER (o_orderkey % 2 = 1) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
        , c AS (SELECT c_mktsegment, o_custkey, round(a - b, 6) AS delta FROM a WHERE a IS NOT NULL AND b IS NOT NULL)
        , u AS (SELECT c_mktsegment, delta, draw, {_W} AS u FROM c, (SELECT unnest(range(0, 60)) AS draw)), w AS (SELECT *, {_P} AS w FROM u)
        , d AS (SELECT c_mktsegment, draw, sum(w * delta) / sum(w) AS v FROM w GROUP BY 1, 2)
        , p AS (SELECT c_mktsegment, least(1.0, 2 * least(count(*) FILTER (v <= 0), count(*) FILTER (v >= 0)) / count(v)) AS p FROM d GROUP BY 1)
        SELECT c_mktsegment, round(avg(delta), 4) AS delta, count(*) AS pairs, round(any_value(p), 6) AS p FROM c JOIN p USING (c_mktsegment) GROUP BY 1""",
    "sign_test": _SIGN + " SELECT * FROM s",
    "holm_adjusted": _SIGN + ", r AS (SELECT c_nationkey, p, row_number() OVER (ORDER BY p, c_nationkey) AS i, count(*) OVER () AS m FROM s) SELECT c_nationkey, p, round(least(1.0, max(p * (m - i + 1)) OVER (ORDER BY i)), 8) AS adjusted FROM r",
    "kendall_tau": _WINS + ", s AS (SELECT c_nationkey AS k, wins % 20 AS a, losses % 20 AS b FROM w), p AS (SELECT sign(x.a - y.a) AS x, sign(x.b - y.b) AS y FROM s x JOIN s y ON x.k < y.k) SELECT round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 8) AS tau, count(*) AS pairs FROM p",
    "spearman": "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) SELECT p_brand, round(corr(a, b), 8) AS rho, count(*) AS n FROM r GROUP BY 1",
    "kernel_distance": """
        WITH r AS (SELECT label, vec_id % 2 AS half, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) AS at FROM embeddings)
        , p AS (SELECT a.label, a.at, a.e AS x, b.e AS y FROM r a JOIN r b ON a.label = b.label AND a.at = b.at AND a.half = 0 AND b.half = 1)
        SELECT p.label, round(avg(pow(list_dot_product(p.x, q.x) / 64 + 1, 3) + pow(list_dot_product(p.y, q.y) / 64 + 1, 3) - pow(list_dot_product(p.x, q.y) / 64 + 1, 3) - pow(list_dot_product(q.x, p.y) / 64 + 1, 3)), 8) AS kid, count(*) AS pairs FROM p JOIN p q ON p.label = q.label AND p.at < q.at GROUP BY 1""",
    "daily_slope": _HOUR + " SELECT event_type, round(regr_slope(v, h), 8) AS slope, count(*) AS points FROM h GROUP BY 1",
    "crossing_points": _HOUR + ", d AS (SELECT event_type, h, v - avg(v) OVER (PARTITION BY event_type) AS d FROM h), s AS (SELECT event_type, h, d, lead(d) OVER w AS d2, lead(h) OVER w AS h2 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY h)), c AS (SELECT event_type, round(h + (h2 - h) * d / (d - d2), 6) AS a FROM s WHERE d * d2 < 0) SELECT event_type, first(a ORDER BY abs(a - 12), a) AS \"at\", count(*) AS crossings FROM c GROUP BY 1",
    "best_of_n": "WITH e AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), f AS (SELECT * FROM e WHERE k < 8) SELECT user_id, first(k ORDER BY v, k) AS k, min(v) AS violations, max(v) FILTER (k = 0) - min(v) AS gain FROM f GROUP BY 1",
    "policy_simulation": """
        WITH r AS (SELECT o_totalprice < 300000 AS small, o_totalprice % 7 < 6 AS big, starts_with(o_orderpriority, '1') AS hard FROM orders)
        , p AS (SELECT 'never' AS policy, false AS ask, small, big FROM r UNION ALL SELECT 'on_failure', NOT small, small, big FROM r UNION ALL SELECT 'hard_or_failed', hard OR NOT small, small, big FROM r)
        SELECT policy, round(avg(CAST(ask AS INT)), 6) AS asked, round(avg(CAST(CASE WHEN ask THEN big ELSE small END AS INT)), 6) AS success FROM p GROUP BY 1""",
    "tie_band": "WITH b AS (SELECT p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1), e AS (SELECT * FROM b WHERE m >= 0.98 * (SELECT max(m) FROM b)) SELECT first(p_brand ORDER BY n, p_brand) AS p_brand, count(*) AS eligible FROM e",
    "preference_pairs": "WITH e AS (SELECT o_custkey, last(o_orderkey ORDER BY o_totalprice, o_orderkey) AS chosen, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS rejected, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY 1) SELECT o_custkey, chosen, rejected FROM e WHERE chosen <> rejected AND hi >= 1.5 * lo",
    "quarter_turns": """
        WITH l AS (SELECT l_orderkey, l_partkey % 400 AS x, l_suppkey * 3 % 300 AS y, l_orderkey % 4 AS k FROM lineitem)
        , m AS (SELECT l_orderkey, k, CASE k WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END AS x, CASE k WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END AS y FROM l)
        SELECT l_orderkey, k, max(x) - min(x) AS width, max(y) - min(y) AS depth, CAST(sum(x) - count(*) * min(x) AS BIGINT) AS checksum FROM m GROUP BY 1, 2""",
    "bound_ids": "WITH l AS (SELECT DISTINCT l_orderkey, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS name FROM lineitem) SELECT name, format('obj_{:04d}', row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('outer-key|' || sha256('inner-key|' || name)), name)) AS bound FROM l",
    "expanded_inventory": "WITH i AS (SELECT p_brand, p_name, p_size % 4 + 1 AS c FROM part), s AS (SELECT p_brand, p_name, c, unnest(range(1, c + 1)) AS i FROM i), n AS (SELECT p_brand, replace(p_name, ' ', '_') || '_' || row_number() OVER (PARTITION BY p_brand, p_name ORDER BY c, i) AS id FROM s) SELECT p_brand, count(*) AS objects, count(DISTINCT id) AS ids, max(id) AS last_id FROM n GROUP BY 1",
    "canonical_order": "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size DESC, p_partkey) AS id FROM part",
    "aligned_masks": "SELECT l_tax > 0.02 AS ok, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1",
    "stream_ledger": "SELECT count(DISTINCT event_id % 5000) AS keys, count(DISTINCT event_id % 5000) AS receipts FROM events",
    "stream_windows": "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "table_fingerprints": """
        SELECT 'orders' AS name, count(*) AS rows, bit_xor(CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), 1, 15)) AS BIGINT)) AS fingerprint FROM orders
        UNION ALL SELECT 'part', count(*), bit_xor(CAST(('0x' || substr(md5(concat_ws('|', p_partkey, p_name, p_brand)), 1, 15)) AS BIGINT)) FROM part
        UNION ALL SELECT 'documents', count(*), bit_xor(CAST(('0x' || substr(md5(concat_ws('|', doc_id, source)), 1, 15)) AS BIGINT)) FROM documents""",
}
