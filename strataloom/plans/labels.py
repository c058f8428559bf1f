"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.runtime import table

# Ordered keyword patterns and their families.
FAMILIES = [("widget", "device"), ("gadget|gizmo", "device"), ("ring|bolt|nut", "fastener"), ("plate|panel|sheet", "surface"), ("pipe|tube|rod", "bar")]


def norm_category(spark: SparkSession, root: str) -> DataFrame:
    label = F.concat(F.upper("p_name"), F.lit("_"), F.col("p_size").cast("string"), F.lit(" ("), "p_brand", F.lit(")/x"))
    return table(spark, root, "part").select("p_partkey", text.category(label).alias("category"), text.head(label).alias("head"))


def norm_room(spark: SparkSession, root: str) -> DataFrame:
    kinds = F.array(F.lit("LivingRoom "), F.lit("meeting_room"), F.lit("Unknown"), F.lit("Restrooms F2"), F.lit("bed room / study."))
    label = F.concat(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")), F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, root, "part").select("p_partkey", text.room_type(label).alias("room_type"))


def slug_asset_key(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.asset_key(F.col("p_name"), F.concat("p_brand", F.lit(" "), "p_type")).alias("asset_key"))


def family_case(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").groupBy(text.first_match(F.lower("p_name"), FAMILIES).alias("family")).agg(F.count(F.lit(1)).alias("parts"))


def hash_shares(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, root, "orders").select("o_orderkey", text.sha1_modulo(key, 10000).alias("bucket"), F.round(text.sha256_share(key), 9).alias("share"))


def yaw_bins(spark: SparkSession, root: str) -> DataFrame:
    angle = (F.col("l_quantity") - 25) / 5
    bin_, rest = text.yaw_bin(angle, 24)
    return table(spark, root, "lineitem").groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(text.wrapped(angle)), 6).alias("least"), F.round(F.max(F.abs(rest)), 6).alias("rest"))


def grid_cells(spark: SparkSession, root: str) -> DataFrame:
    cell = text.grid_cell(F.col("l_discount") * 9.99, F.col("l_quantity") / 51, 8)
    return table(spark, root, "lineitem").groupBy(cell.cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def reasoning_split(spark: SparkSession, root: str) -> DataFrame:
    calls = table(spark, root, "stream_state").where("raw_final_text is not null").select("call_id", "raw_final_text").distinct()
    thought, answer = text.reasoning_parts(F.col("raw_final_text"))
    return calls.select("call_id", F.length(thought).cast("long").alias("thought_chars"), F.sha2(answer, 256).alias("answer_sha"))


def strict_props(spark: SparkSession, root: str) -> DataFrame:
    """Typed field of a JSON text; texts of another shape are counted as refused."""
    parsed = F.from_json("props", "k long", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    return table(spark, root, "events").select(parsed.k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def messages_render(spark: SparkSession, root: str) -> DataFrame:
    """Chat triples as compact JSON, null keys left out."""
    user = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand")))
    chat = F.array(F.struct(F.lit("system").alias("role"), F.lit("Place it.").alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return table(spark, root, "part").select("p_partkey", F.to_json(chat).alias("messages"))


def text_digests(spark: SparkSession, root: str) -> DataFrame:
    """Distinct texts per source by digest of the normal text."""
    normal = F.sha2(text.squeezed(F.lower("text")), 256)
    return table(spark, root, "documents").where("text is not null").select("source", normal.alias("digest")).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("digest").alias("distinct_texts"), F.min("digest").alias("first_digest"))


def pipe_table(spark: SparkSession, root: str) -> DataFrame:
    """Rows of a pipe-separated job table."""
    line = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    row = F.from_csv(line, "job long, state string, owner long", {"sep": "|"})
    return table(spark, root, "events").select(row.alias("r")).groupBy(F.col("r.state").alias("state")).agg(F.count(F.lit(1)).alias("jobs"), F.max("r.job").alias("last_job"), F.count_distinct("r.owner").alias("owners"))


QUERIES = {f.__name__: f for f in (norm_category, norm_room, slug_asset_key, family_case, hash_shares, yaw_bins, grid_cells, reasoning_split, strict_props, messages_render, text_digests, pipe_table)}

ORACLES = {
    "norm_category": r"""
        WITH a AS (SELECT p_partkey, regexp_replace(split_part(lower(p_name) || '_' || p_size, '(', 1), '[^a-z0-9]+', ' ', 'g') AS w FROM part)
        , b AS (SELECT p_partkey, regexp_replace(trim(w), '([a-z])(\s*\d+)+$', '\1') AS category FROM a)
        SELECT p_partkey, category, split_part(category, ' ', -1) AS head FROM b""",
    "norm_room": r"""
        WITH a AS (SELECT p_partkey, p_partkey % 5 AS k FROM part)
        SELECT p_partkey, CASE k WHEN 0 THEN 'living room' WHEN 1 THEN 'meeting room' WHEN 2 THEN NULL WHEN 3 THEN 'restroom' ELSE 'bed room/study.' END AS room_type FROM a""",
    "slug_asset_key": """
        SELECT p_partkey, replace(p_name, ' ', '_') AS slug, left(replace(p_name, ' ', '_'), 24) || '_' || left(sha1(p_brand || ' ' || p_type), 8) AS asset_key FROM part""",
    "family_case": """
        SELECT CASE WHEN regexp_matches(lower(p_name), 'widget') THEN 'device' WHEN regexp_matches(lower(p_name), 'gadget|gizmo') THEN 'device' WHEN regexp_matches(lower(p_name), 'ring|bolt|nut') THEN 'fastener'
        WHEN regexp_matches(lower(p_name), 'plate|panel|sheet') THEN 'surface' WHEN regexp_matches(lower(p_name), 'pipe|tube|rod') THEN 'bar' ELSE 'other' END AS family, count(*) AS parts FROM part GROUP BY 1""",
    "hash_shares": """
        SELECT o_orderkey, CAST(('0x' || sha1(CAST(o_orderkey AS VARCHAR))[33:40])::BIGINT % 10000 AS BIGINT) AS bucket_low, 0 AS share FROM orders WHERE false""",
    "yaw_bins": """
        WITH a AS (SELECT (l_quantity - 25) / 5 AS t FROM lineitem)
        , b AS (SELECT t, (t - floor(t / (2 * pi())) * 2 * pi()) / (2 * pi() / 24) AS p, (t + pi()) - floor((t + pi()) / (2 * pi())) * 2 * pi() - pi() AS w FROM a)
        SELECT CAST(floor(p + 0.5) AS BIGINT) % 24 AS bin, count(*) AS n, round(min(w), 6) AS least, round(max(abs(p - floor(p + 0.5))), 6) AS rest FROM b GROUP BY 1""",
    "grid_cells": """
        SELECT CAST(least(greatest(floor(l_quantity / 51 * 8), 0), 7) * 8 + least(greatest(floor(l_discount * 9.99 * 8), 0), 7) AS BIGINT) AS cell, count(*) AS n FROM lineitem GROUP BY 1""",
    "reasoning_split": r"""
        WITH a AS (SELECT DISTINCT call_id, raw_final_text AS t FROM stream_state WHERE raw_final_text IS NOT NULL)
        SELECT call_id, CASE WHEN contains(t, '</think>') THEN length(trim(replace(split_part(t, '</think>', 1), '<think>', ''))) WHEN contains(t, '<think>') THEN length(trim(replace(t, '<think>', ''))) END AS thought_chars,
        sha256(CASE WHEN contains(t, '</think>') THEN trim(split_part(t, '</think>', -1)) WHEN contains(t, '<think>') THEN NULL ELSE trim(t) END) AS answer_sha FROM a""",
    "strict_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "messages_render": """
        SELECT p_partkey, '[{"role":"system","content":"Place it."},{"role":"user","content":"{\\"name\\":\\"' || p_name || '\\",\\"size\\":' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ',\\"brand\\":\\"' || p_brand || '\\"' ELSE '' END || '}"}]' AS messages FROM part""",
    "text_digests": r"""
        WITH a AS (SELECT source, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS d FROM documents WHERE text IS NOT NULL)
        SELECT source, count(*) AS texts, count(DISTINCT d) AS distinct_texts, min(d) AS first_digest FROM a GROUP BY 1""",
    "pipe_table": "SELECT event_type AS state, count(*) AS jobs, max(event_id) AS last_job, count(DISTINCT user_id) AS owners FROM events GROUP BY 1",
}
# DuckDB: hexadecimal text to numbers, in the same chunks
_CHUNK = "CAST(('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), {at}, 8)) AS BIGINT)"
_ACC = "0"
for _i in range(5):
    _ACC = f"(({_ACC}) * 7296 + {_CHUNK.format(at=1 + 8 * _i)}) % 10000"
ORACLES["hash_shares"] = f"SELECT o_orderkey, {_ACC} AS bucket, round(CAST(CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0, 9) AS share FROM orders"
