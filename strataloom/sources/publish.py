"""Sinks: classified outputs, counters, manifests that come last, verification.

A published folder is never replaced. Data is written first and the manifest last, so a folder without manifest is unfinished. The
manifest holds rows and an order-free fingerprint of each output, which can be taken again in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the folder that holds the manifest.
MANIFEST = "manifest"


def fingerprint(columns: list[str]):
    """Exclusive or of row digests; NULL and the text of NULL differ."""
    cells = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.bit_xor(F.xxhash64(F.concat_ws("\x1f", *cells)))


def described(df: DataFrame, by: str) -> DataFrame:
    """(output, rows, fingerprint) of each output."""
    columns = sorted(c for c in df.columns if c != by and dict(df.dtypes)[c].split("<")[0] not in ("array", "map", "struct"))
    return df.groupBy(F.col(by).cast("string").alias("output")).agg(F.count(F.lit(1)).alias("rows"), fingerprint(columns).alias("fingerprint"))


def publish(df: DataFrame, by: str, path: str) -> DataFrame:
    """Write ``df`` into one folder for each value of ``by`` and the manifest after it; fails where the folder exists."""
    df.write.mode("errorifexists").partitionBy(by).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    described(stored, by).coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("output string, rows bigint, fingerprint bigint").json(f"{path}/{MANIFEST}")


def verified(spark: SparkSession, path: str, schema, by: str) -> DataFrame:
    """(output, state) of each output: same, differs, missing or extra against the manifest."""
    now = described(spark.read.schema(schema).parquet(f"{path}/rows"), by)
    then = manifest(spark, path).select("output", F.col("rows").alias("r0"), F.col("fingerprint").alias("f0"))
    state = F.when(F.col("r0").isNull(), "extra").when(F.col("rows").isNull(), "missing").when((F.col("rows") == F.col("r0")) & F.col("fingerprint").eqNullSafe(F.col("f0")), "same").otherwise("differs")
    return now.join(then, "output", "full_outer").select("output", state.alias("state"))


#: Rows of a report in one file, at most.
MOST_ROWS = 1_000_000


def single_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header. More than MOST_ROWS rows are refused: one task would write them all."""
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows for one file")
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)
