"""Queries of ranks, quotas, splits and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import sampling as S
from strataloom.operators.components import components
from strataloom.operators.ranking import ordered
from strataloom.runtime import table


def top_per_source(spark: SparkSession, root: str) -> DataFrame:
    """The 20 documents of each source with the smallest digest."""
    docs = table(spark, root, "documents").select("doc_id", "source")
    return S.top_by_digest(docs, ["source"], S.digest_of(F.lit("7"), F.col("doc_id").cast("string")), 20, ["doc_id"]).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def stratum_sample(spark: SparkSession, root: str) -> DataFrame:
    """At most 30 parts a brand, with the chance of each to be drawn."""
    parts = table(spark, root, "part").select("p_partkey", "p_brand")
    sizes = parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    drawn = S.top_by_digest(parts, ["p_brand"], S.digest_of(F.col("p_partkey").cast("string")), 30, ["p_partkey"])
    return drawn.join(sizes, "p_brand").select("p_partkey", "p_brand", F.round(F.least(F.lit(1.0), F.lit(30.0) / F.col("n")), 6).alias("chance"))


def quota_allocation(spark: SparkSession, root: str) -> DataFrame:
    """1000 draws shared over the sources in proportion to their size, each at least one."""
    sizes = table(spark, root, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.largest_remainder(sizes, ["source"], "n", 1000, 1).select("source", "n", "quota")


def quota_sample(spark: SparkSession, root: str) -> DataFrame:
    """200 orders, in proportion to the priorities, lowest digests first."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    sizes = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    quotas = S.largest_remainder(sizes, ["o_orderpriority"], "n", 200)
    few = S.top_by_digest(orders, ["o_orderpriority"], S.digest_of(F.col("o_orderkey").cast("string")), 200, ["o_orderkey"])
    return few.join(quotas.select("o_orderpriority", "quota"), "o_orderpriority").where("rank <= quota").select("o_orderkey", "o_orderpriority")


def weighted_replicas(spark: SparkSession, root: str) -> DataFrame:
    """Documents repeated by a weight of their source, fractions drawn by hash."""
    docs = table(spark, root, "documents").select("doc_id", "source")
    weight = F.when(F.col("source") == "field_diary", 2.5).when(F.col("source") == "handbook", 1.25).when(F.col("source") == "run_logs", 0.5).otherwise(1.0)
    return S.replicated(docs, weight, text.sha256_share(F.col("doc_id").cast("string"))).select("doc_id", F.col("copy").cast("long").alias("copy"))


def grouped_split(spark: SparkSession, root: str) -> DataFrame:
    """Customers to 80/10/10 by the digest of their group, so groups stay together."""
    share = text.sha256_share(F.concat(F.lit("0|"), "c_mktsegment", F.lit("|"), F.col("c_nationkey").cast("string")))
    return table(spark, root, "customer").select("c_custkey", F.when(share < 0.8, "train").when(share < 0.9, "dev").otherwise("test").alias("split"))


def split_leakage_safe(spark: SparkSession, root: str) -> DataFrame:
    """Documents linked by their text, their room or their house get one split, by the digest of the smallest key."""
    docs = table(spark, root, "documents").select("doc_id", F.concat(F.lit("t:"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("t"), F.concat(F.lit("u:"), "uid").alias("u"), F.concat(F.lit("g:"), "room_source", F.lit("|"), "group_id").alias("g"))
    keys = docs.select("doc_id", F.array_compact(F.array("g", "t", "u")).alias("keys"), F.array_min(F.array_compact(F.array("g", "t", "u"))).alias("first"))
    links = keys.select("first", F.explode("keys").alias("b")).where("first <> b").distinct()
    roots = components(links, "first", "b")
    placed = keys.join(roots.withColumnRenamed("node", "first"), "first", "left").select("doc_id", F.coalesce("root", "first").alias("family"))
    part = text.sha1_modulo(F.col("family"), 10000)
    return placed.select("doc_id", "family", F.when(part < 500, "dev").when(part < 1000, "test").otherwise("train").alias("split"))


def capped_sources(spark: SparkSession, root: str) -> DataFrame:
    """At most 100 distinct texts a source, in digest order; counters of what happened to the rest."""
    docs = table(spark, root, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    order = F.sha1(F.col("doc_id").cast("string"))
    first = docs.groupBy("digest").agg(F.min_by("doc_id", F.struct(order, "doc_id")).alias("first"))  # a text posted often is one row a task
    marked = docs.join(first, "digest").withColumn("copy", F.col("doc_id") != F.col("first")).drop("first")
    kept = S.top_by_digest(marked.where("not copy"), ["source"], order, 100, ["doc_id"]).select("doc_id", F.lit(True).alias("kept"))
    fate = F.when(F.col("copy"), "duplicate").when(F.col("kept"), "kept").otherwise("capped")
    return marked.join(kept, "doc_id", "left").groupBy("source", fate.alias("fate")).agg(F.count(F.lit(1)).alias("texts"))


def dedup_first(spark: SparkSession, root: str) -> DataFrame:
    """One document for each text: the one with the smallest digest of its id."""
    docs = table(spark, root, "documents").where("text is not null")
    best = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by("doc_id", F.struct(F.sha1(F.col("doc_id").cast("string")), "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return best.select("doc_id", "copies")


def dedup_best_source(spark: SparkSession, root: str) -> DataFrame:
    """For each house, the room source with most characters; ties go to the larger name."""
    docs = table(spark, root, "documents").where("group_id is not null")
    sums = docs.groupBy("group_id", "room_source").agg(F.sum("n_chars").alias("chars"))
    return sums.groupBy("group_id").agg(F.max_by("room_source", F.struct("chars", "room_source")).alias("room_source"), F.max("chars").alias("chars"))


def length_batches(spark: SparkSession, root: str) -> DataFrame:
    """Batches of 64 texts of like length, with the width of each."""
    docs = table(spark, root, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "source")
    batched = ordered(docs, ["source"], [F.desc("chars"), "doc_id"]).withColumn("batch", F.floor((F.col("rank") - 1) / 64).cast("long"))
    return batched.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("texts"), F.max("chars").cast("long").alias("width"), F.sum("chars").cast("long").alias("chars"))


def budget_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Orders of a customer in chunks of at most 400,000."""
    orders = table(spark, root, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("cost"))
    return S.budget_chunks(orders, "o_custkey", ["o_orderkey"], "cost", 400_000).groupBy("o_custkey", "chunk").agg(F.count(F.lit(1)).alias("orders"), F.sum("cost").alias("cost"))


def hash_shards(spark: SparkSession, root: str) -> DataFrame:
    """Round-robin shards of each segment in digest order."""
    keyed = table(spark, root, "customer").select("c_custkey", "c_mktsegment", F.sha1(F.col("c_custkey").cast("string")).alias("digest"))
    return ordered(keyed, ["c_mktsegment"], ["digest", "c_custkey"]).select("c_custkey", S.shard_of(F.col("rank"), 7).cast("long").alias("shard"))


def split_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """Keys of each kind that stand in more than one split."""
    docs = table(spark, root, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train"))
    keys = docs.select("split", F.explode(F.array(F.struct(F.lit("house").alias("kind"), F.concat_ws("|", "room_source", "group_id").alias("key")), F.struct(F.lit("room").alias("kind"), F.col("uid").alias("key")), F.struct(F.lit("text").alias("kind"), F.sha2("text", 256).alias("key")))).alias("k")).select("split", "k.kind", "k.key").where("key is not null and key <> ''")
    held = keys.groupBy("kind", "key").agg(F.max(F.col("split") == "train").alias("tr"), F.max(F.col("split") == "dev").alias("de"), F.max(F.col("split") == "test").alias("te"))
    n = lambda a, b: F.count(F.when(F.col(a) & F.col(b), 1))
    return held.groupBy("kind").agg(n("tr", "de").alias("train_dev"), n("tr", "te").alias("train_test"), n("de", "te").alias("dev_test"))


QUERIES = {f.__name__: f for f in (top_per_source, stratum_sample, quota_allocation, quota_sample, weighted_replicas, grouped_split, split_leakage_safe, capped_sources, dedup_first, dedup_best_source, length_batches, budget_chunks, hash_shards, split_overlaps)}

_SHARE = "CAST(CAST(('0x' || substr(sha256({k}), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"
_QUOTA = """WITH s AS (SELECT {by} AS k, count(*) AS n FROM {t} GROUP BY 1), e AS (SELECT k, n, n * {total}.0 / sum(n) OVER () AS x FROM s), f AS (SELECT k, n, x, greatest(floor(x), {least}) AS fl FROM e)
, q AS (SELECT k, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, k) <= {total} - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


def _modulo(key: str, modulus: int) -> str:
    acc = "0"
    for i in range(5):
        acc = f"(({acc}) * {4294967296 % modulus} + CAST(('0x' || substr(sha1({key}), {1 + 8 * i}, 8)) AS BIGINT)) % {modulus}"
    return acc


ORACLES = {
    "top_per_source": "SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents) WHERE rank <= 20",
    "stratum_sample": "SELECT p_partkey, p_brand, round(least(1.0, 30.0 / n), 6) AS chance FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(CAST(p_partkey AS VARCHAR)), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r <= 30",
    "quota_allocation": _QUOTA.format(by="source", t="documents", total=1000, least=1) + " SELECT k AS source, n, quota FROM q",
    "quota_sample": _QUOTA.format(by="o_orderpriority", t="orders", total=200, least=0) + ", r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rank FROM orders) SELECT o_orderkey, o_orderpriority FROM r JOIN q ON k = o_orderpriority WHERE rank <= quota",
    "weighted_replicas": f"WITH w AS (SELECT doc_id, CASE source WHEN 'field_diary' THEN 2.5 WHEN 'handbook' THEN 1.25 WHEN 'run_logs' THEN 0.5 ELSE 1.0 END AS w, {_SHARE.format(k='CAST(doc_id AS VARCHAR)')} AS h FROM documents) SELECT doc_id, unnest(range(1, CAST(floor(w) AS BIGINT) + CASE WHEN h < w - floor(w) THEN 2 ELSE 1 END)) AS copy FROM w",
    "grouped_split": f"SELECT c_custkey, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'dev' ELSE 'test' END AS split FROM (SELECT c_custkey, {_SHARE.format(k="'0|' || c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR)")} AS h FROM customer)",
    "split_leakage_safe": f"""
        WITH RECURSIVE d AS (SELECT doc_id, 't:' || sha256(coalesce(text, '')) AS t, 'u:' || uid AS u, 'g:' || room_source || '|' || group_id AS g FROM documents)
        , k AS (SELECT doc_id, unnest(list_filter([g, t, u], lambda x: x IS NOT NULL)) AS key FROM d)
        , e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b ON a.doc_id = b.doc_id)
        , r(node, root) AS (SELECT a, min(b) FROM e GROUP BY a UNION SELECT e.a, min(r.root) FROM r JOIN e ON e.b = r.node GROUP BY e.a)
        , f AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        , p AS (SELECT doc_id, min(f.root) AS family FROM k JOIN f ON f.node = k.key GROUP BY doc_id)
        SELECT doc_id, family, CASE WHEN m < 500 THEN 'dev' WHEN m < 1000 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, family, {_modulo('family', 10000)} AS m FROM p)""",
    "capped_sources": """
        WITH d AS (SELECT doc_id, source, sha1(CAST(doc_id AS VARCHAR)) AS o, row_number() OVER (PARTITION BY sha256(text) ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) > 1 AS copy FROM documents WHERE text IS NOT NULL)
        , r AS (SELECT source, copy, row_number() OVER (PARTITION BY source, copy ORDER BY o, doc_id) AS rank FROM d)
        SELECT source, CASE WHEN copy THEN 'duplicate' WHEN rank <= 100 THEN 'kept' ELSE 'capped' END AS fate, count(*) AS texts FROM r GROUP BY 1, 2""",
    "dedup_first": "SELECT first(doc_id ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)",
    "dedup_best_source": "WITH s AS (SELECT group_id, room_source, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE group_id IS NOT NULL GROUP BY 1, 2) SELECT group_id, first(room_source ORDER BY chars DESC, room_source DESC) AS room_source, max(chars) AS chars FROM s GROUP BY 1",
    "length_batches": "WITH d AS (SELECT source, coalesce(length(text), 0) AS chars, (row_number() OVER (PARTITION BY source ORDER BY coalesce(length(text), 0) DESC, doc_id) - 1) // 64 AS batch FROM documents) SELECT source, batch, count(*) AS texts, max(chars) AS width, CAST(sum(chars) AS BIGINT) AS chars FROM d GROUP BY 1, 2",
    "budget_chunks": """
        WITH RECURSIVE o AS (SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
        , r AS (SELECT o_custkey, i, cost, cost AS used, CAST(0 AS BIGINT) AS chunk FROM o WHERE i = 1
        UNION ALL SELECT o.o_custkey, o.i, o.cost, CASE WHEN r.used + o.cost > 400000 THEN o.cost ELSE r.used + o.cost END, r.chunk + CASE WHEN r.used + o.cost > 400000 THEN 1 ELSE 0 END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1)
        SELECT o_custkey, chunk, count(*) AS orders, CAST(sum(cost) AS BIGINT) AS cost FROM r GROUP BY 1, 2""",
    "hash_shards": "SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1(CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 7 AS shard FROM customer",
    "split_overlaps": """
        WITH d AS (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM documents)
        , k AS (SELECT split, 'house' AS kind, concat_ws('|', room_source, group_id) AS key FROM d UNION ALL SELECT split, 'room', uid FROM d UNION ALL SELECT split, 'text', sha256(text) FROM d)
        , h AS (SELECT kind, key, bool_or(split = 'train') AS tr, bool_or(split = 'dev') AS de, bool_or(split = 'test') AS te FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY 1, 2)
        SELECT kind, count(*) FILTER (tr AND de) AS train_dev, count(*) FILTER (tr AND te) AS train_test, count(*) FILTER (de AND te) AS dev_test FROM h GROUP BY 1""",
}
