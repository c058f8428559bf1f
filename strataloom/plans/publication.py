"""Queries of sources and sinks: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.runtime import checkpoint_dir, table
from strataloom.sources import files, publish


def _fresh(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"


def published_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Orders routed to outputs, written with a manifest and verified."""
    orders = table(spark, root, "orders").withColumn("output", F.when(F.col("o_orderkey") % 10 == 0, "test").when(F.col("o_orderkey") % 10 == 1, "dev").otherwise("train"))
    path = _fresh(spark)
    kept = publish.publish(orders, "output", path)
    return kept.join(publish.verified(spark, path, orders.schema, "output"), "output").select("output", "rows", "state")


def json_lines_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Parts as JSON lines, some of them broken, read back under a schema."""
    path = _fresh(spark)
    line = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    table(spark, root, "part").select(F.when(F.col("p_partkey") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    rows, bad = files.json_lines(spark, path, table(spark, root, "part").select("p_partkey", "p_name", "p_size").schema)
    good = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("p_size").alias("size"))
    return good.withColumn("k", F.lit(1)).join(bad.agg(F.count(F.lit(1)).alias("refused"), F.lit(1).alias("k")), "k").drop("k")


def csv_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Suppliers as CSV, read back under a schema."""
    path = _fresh(spark)
    rows = table(spark, root, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows.write.csv(path, header=True)
    return files.csv_table(spark, path, rows.schema)


QUERIES = {f.__name__: f for f in (published_outputs, json_lines_round_trip, csv_round_trip)}
ORACLES = {
    "published_outputs": "SELECT CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS output, count(*) AS rows, 'same' AS state FROM orders GROUP BY 1",
    "json_lines_round_trip": "SELECT count(*) FILTER (p_partkey % 50 <> 0) AS rows, CAST(sum(p_size) FILTER (p_partkey % 50 <> 0) AS BIGINT) AS size, count(*) FILTER (p_partkey % 50 = 0) AS refused FROM part",
    "csv_round_trip": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
}
