"""Queries of supervised samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import repair
from strataloom.operators import samples as S
from strataloom.runtime import table


def scene_validation(spark: SparkSession, root: str) -> DataFrame:
    """Conditions and layouts by the rule that refuses them."""
    return S.validated(table(spark, root, "rooms")).groupBy("part", F.coalesce("reason", F.lit("sound")).alias("reason")).agg(F.count(F.lit(1)).alias("rooms"))


def sample_projection(spark: SparkSession, root: str) -> DataFrame:
    """Rooms by the reason for which they have no minimal form."""
    return S.projected(table(spark, root, "rooms")).groupBy(F.coalesce("reason", F.lit("projected")).alias("reason")).agg(F.count(F.lit(1)).alias("rooms"))


def minimal_requests(spark: SparkSession, root: str) -> DataFrame:
    """Minimal request and moved target of each room that has one."""
    return S.projected(table(spark, root, "rooms")).where("reason is null").select("uid", "request", "target")


def sample_qualification(spark: SparkSession, root: str) -> DataFrame:
    """Masks taken back, by field and reason."""
    return S.journal(table(spark, root, "rooms")).groupBy("field", "reason").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("uid").alias("rooms"))


def exchangeable_objects(spark: SparkSession, root: str) -> DataFrame:
    """Groups of objects that can change places, by their size."""
    return S.groups(table(spark, root, "rooms")).groupBy("uid", "label").agg(F.count(F.lit(1)).alias("members")).groupBy("members").agg(F.count(F.lit(1)).alias("groups"))


def repaired_rooms(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong in bound rooms before and after repair, by outcome."""
    r = repair.repair_rooms(table(spark, root, "rooms"))
    sums = [F.sum(f"{when}_{w}").alias(f"{when}_{w}") for w in repair.WRONG for when in ("before", "after")]
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("rooms"), F.sum("moved").alias("moved"), F.round(F.max("farthest"), 4).alias("farthest"), *sums)


def edited_rooms(spark: SparkSession, root: str) -> DataFrame:
    """Edits of critics carried out on the rooms of their prompts."""
    e = repair.edit_rooms(table(spark, root, "stream_state"))
    return e.agg(F.count(F.lit(1)).alias("calls"), F.sum("edits").alias("edits"), F.sum("applied").alias("applied"), F.sum("before").alias("before"), F.sum("after").alias("after"))


def door_clearance(spark: SparkSession, root: str) -> DataFrame:
    """Doors that placed boxes block, and boxes that stand at a wall."""
    d = repair.door_rooms(table(spark, root, "rooms"))
    return d.groupBy("doors").agg(F.count(F.lit(1)).alias("rooms"), F.sum("blocked").alias("blocked"), F.sum("backs").alias("backs"))


QUERIES = {f.__name__: f for f in (repaired_rooms, edited_rooms, door_clearance, scene_validation, sample_projection, minimal_requests, sample_qualification, exchangeable_objects)}
ORACLES: dict[str, str] = {}
