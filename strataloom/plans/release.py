"""The two long pipelines: raw rooms to a release, answers to an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import aggregate as A
from strataloom.operators import curate
from strataloom.operators import sampling as S
from strataloom.operators import statistics as stats
from strataloom.operators.components import components
from strataloom.runtime import cut, table

#: Sources whose rooms share one set of assets: equal sizes don't make rooms related there.
GROUP_ONLY = ("MansionWorld",)
#: Train rooms of a source that a release holds at most; none by default, as sources are balanced when texts are drawn.
CAPS: dict[str, int] = {}


def room_preparation(spark: SparkSession, root: str) -> DataFrame:
    """Reasons and flags of every room, counted."""
    p = curate.prepare(table(spark, root, "raw"))
    marks = F.when(F.col("reason").isNotNull(), F.array(F.concat(F.lit("rejected:"), "reason"))).otherwise(F.concat(F.array(F.lit("kept")), F.transform("flags", lambda f: F.concat(F.lit("flag:"), f))))
    return p.select("source", F.explode(marks).alias("counter")).groupBy("source", "counter").agg(F.count(F.lit(1)).alias("rooms"))


def beyond_caps(fresh: DataFrame, caps: dict[str, int]) -> DataFrame | None:
    """Uids of the train rooms of each named source beyond its number, in the order of their digests; None without caps."""
    over = None
    for source, n in sorted(caps.items()):
        train = fresh.where((F.col("source") == source) & (F.col("split") == "train")).select("uid", "source")
        held = S.top_by_digest(train, ["source"], F.sha1("uid"), n, ["uid"]).select("uid")
        rest = train.join(held, "uid", "left_anti").select("uid")
        over = rest if over is None else over.unionByName(rest)
    return over


def _released(spark: SparkSession, root: str, caps: dict[str, int] | None = None) -> DataFrame:
    """(uid, source, fate, split) of every prepared room; fate is rejected, duplicate, capped or kept."""
    p = cut(curate.prepare(table(spark, root, "raw")).withColumn("house", F.concat_ws("|", "source", "house")))  # houses are numbered within a source
    clean = p.where("reason is null")
    keys = F.array_compact(F.concat(F.array(F.concat(F.lit("g:"), "house"), F.when(~F.coalesce("source", F.lit("")).isin(*GROUP_ONLY), F.concat(F.lit("c:"), "content_key")), F.concat(F.lit("l:"), "layout_key")), F.transform("aliases", lambda a: F.concat(F.lit("a:"), F.lower(a)))))
    keyed = clean.select("uid", "source", "eval_only", "copy_key", keys.alias("keys"), F.array_min(keys).alias("first"))
    roots = components(keyed.select("first", F.explode("keys").alias("b")).where("first <> b").distinct(), "first", "b")
    family = keyed.join(roots.withColumnRenamed("node", "first"), "first", "left").select("uid", "source", "eval_only", "copy_key", F.coalesce("root", "first").alias("family"))
    only = family.groupBy("family").agg(F.max("eval_only").alias("only"))
    part = text.sha1_modulo(F.col("family"), 10000)
    placed = cut(family.join(only, "family").select("uid", "source", "copy_key", F.when(F.col("only"), "test").when(part < 500, "dev").when(part < 1000, "test").otherwise("train").alias("split")))
    order = F.sha1("uid")
    first = placed.where("copy_key is not null").groupBy("split", "copy_key").agg(F.min_by("uid", F.struct(order, "uid")).alias("uid")).select("uid")
    fresh = placed.join(first, "uid", "left_semi")
    over = beyond_caps(fresh, CAPS if caps is None else caps)
    fates = fresh.select("uid", "split", F.lit("kept").alias("fate"))
    if over is not None:
        fates = fates.drop("fate").join(over.withColumn("fate", F.lit("capped")), "uid", "left").select("uid", "split", F.coalesce("fate", F.lit("kept")).alias("fate"))
    copies = placed.join(first, "uid", "left_anti").select("uid", "split", F.lit("duplicate").alias("fate"))
    known = fates.unionByName(copies)
    return p.join(known, "uid", "left").select("uid", "source", F.coalesce("fate", F.lit("rejected")).alias("fate"), "split", "user", "assistant")


def release_counters(spark: SparkSession, root: str, caps: dict[str, int] | None = None) -> DataFrame:
    """What became of the rooms of each source."""
    return _released(spark, root, caps).groupBy("source", "fate", "split").agg(F.count(F.lit(1)).alias("rooms"))


def release_rows(spark: SparkSession, root: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Chat rows of the released rooms."""
    kept = _released(spark, root, caps).where("fate = 'kept'")
    chat = F.array(F.struct(F.lit("system").alias("role"), F.lit(curate.SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), F.col("user").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("assistant").alias("content")))
    return kept.select("uid", "source", "split", F.to_json(chat).alias("messages"))


def _scores(spark: SparkSession, root: str) -> DataFrame:
    answers = table(spark, root, "placer_generate")
    whose = answers.select("output_id", "engine", "source", "group_id", "k").distinct()
    ok = (F.col("state") == "scored") & (F.col("outside") + F.col("main") + F.col("fixed_hits") + F.col("unsupported") == 0)
    return curate.scored(answers, table(spark, root, "rooms")).join(whose, "output_id").withColumn("success", ok)


def evaluation_summary(spark: SparkSession, root: str) -> DataFrame:
    """Rates over all answers and over readable ones, by engine, by source and over all."""
    s = _scores(spark, root)
    read = F.col("state") == "scored"
    sets = s.groupingSets([[F.col("engine")], [F.col("source")], []], "engine", "source")
    r = lambda c: F.round(c, 6)
    return sets.agg(F.count(F.lit(1)).alias("answers"), r(A.rate(read)).alias("readable"), r(A.rate(F.col("success"))).alias("success"), r(A.rate(F.col("main") > 0, read)).alias("collides"), r(A.rate(F.col("outside") > 0, read)).alias("leaves"), r(F.avg("overlap")).alias("overlap"), r(F.avg("moved")).alias("moved"), r(F.avg("moved_matched")).alias("moved_matched"))


def best_samples(spark: SparkSession, root: str) -> DataFrame:
    """The sample of each room with fewest violations, first ones before later ones."""
    s = _scores(spark, root).where("state = 'scored'").withColumn("violations", F.col("outside") + F.col("main") + F.col("fixed_hits") + F.col("unsupported"))
    order = F.struct("violations", "k", "output_id")
    return s.groupBy("uid").agg(F.min_by("output_id", order).alias("output_id"), F.min("violations").alias("violations"), F.count(F.lit(1)).alias("samples"))


def engine_contrast(spark: SparkSession, root: str) -> DataFrame:
    """Difference of success of the two engines on rooms that both answered, houses drawn whole."""
    s = _scores(spark, root).groupBy("source", "group_id", "uid").agg(F.avg(F.when(F.col("engine") == "vllm_greedy", F.col("success").cast("int"))).alias("a"), F.avg(F.when(F.col("engine") != "vllm_greedy", F.col("success").cast("int"))).alias("b")).where("a is not null and b is not null")
    houses = s.groupBy("group_id").agg(F.sum(F.col("a") - F.col("b")).alias("delta"), F.count(F.lit(1)).alias("n"), F.lit("all").alias("scope"))
    point = houses.groupBy("scope").agg(F.round(F.sum("delta") / F.sum("n"), 6).alias("estimate"), F.sum("n").alias("rooms"), F.count(F.lit(1)).alias("houses"))
    drawn = stats.replicates(houses, ["scope"], "group_id", "delta", "n", 200)
    return point.join(stats.interval(drawn, ["scope"], 190), "scope").select("scope", "estimate", "rooms", "houses", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p", 6).alias("p"))


def size_errors(spark: SparkSession, root: str) -> DataFrame:
    """Log errors of estimated sizes against the target, by source."""
    rooms = table(spark, root, "rooms").where("sizes is not null").select("uid", "source", "target", "sizes").distinct()
    given = F.from_json("target", "placements array<struct<id string, size array<double>>>")["placements"]
    rows = rooms.select("source", "uid", F.explode(given).alias("p"), F.from_json("sizes", "map<string, array<double>>").alias("s")).select("source", "uid", "p.id", "p.size", F.try_element_at("s", F.col("p.id")).alias("guess")).where("guess is not null and size(size) = 3 and size(guess) = 3")
    logs = F.zip_with("guess", "size", lambda g, t: F.when((g > 0) & (t > 0), F.log(g / t)))
    per = rows.select("source", F.aggregate(logs, F.lit(0.0), lambda s, v: s + F.abs(v)).alias("mae"), F.aggregate(logs, F.lit(0.0), lambda s, v: s + v).alias("bias"))
    return per.groupBy("source").agg(F.count("mae").alias("objects"), F.round(F.avg(F.col("mae") / 3), 6).alias("log_mae"), F.round(F.avg(F.col("bias") / 3), 6).alias("log_bias"))


def size_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """Mean overlap ratio of estimated and true sizes, boxes at one corner, by source."""
    rooms = table(spark, root, "rooms").where("sizes is not null").select("uid", "source", "target", "sizes").distinct()
    given = F.from_json("target", "placements array<struct<id string, size array<double>>>")["placements"]
    rows = rooms.select("source", F.explode(given).alias("p"), F.from_json("sizes", "map<string, array<double>>").alias("s")).select("source", "p.size", F.try_element_at("s", F.col("p.id")).alias("guess"))
    overlap, _ = stats.size_agreement(F.col("guess"), F.col("size"))
    return rows.select("source", overlap.alias("o")).where("o is not null").groupBy("source").agg(F.count("o").alias("objects"), F.round(F.avg("o"), 6).alias("overlap"))


def critic_edits(spark: SparkSession, root: str) -> DataFrame:
    """Proposed edits by operation and whether they can be applied."""
    return curate.edits(table(spark, root, "stream_state")).groupBy("op", "state").agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("call_id").alias("calls"))


def hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    return curate.perturbed(table(spark, root, "rooms"))


def augmentation_checks(spark: SparkSession, root: str) -> DataFrame:
    """Rooms whose checks don't depend on orientation, by turn and mirror."""
    return curate.augmented(table(spark, root, "raw")).groupBy("quarter", "mirrored").agg(F.count(F.lit(1)).alias("rooms"), F.count(F.when(F.col("same"), 1)).alias("same"))


def call_latency(spark: SparkSession, root: str) -> DataFrame:
    """Latency and tokens of finished calls, by model and status."""
    calls = table(spark, root, "stream_state").select("call_id", "expected_model", "status", "usage.total_tokens", (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))).alias("us")).distinct()
    q = lambda p: F.round(F.percentile(F.col("us") / 1e6, F.lit(p)), 6)
    return calls.groupBy("expected_model", "status").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.col("us") / 1e6), 6).alias("mean_s"), q(0.5).alias("p50_s"), q(0.95).alias("p95_s"), F.sum("total_tokens").alias("tokens"))


def latest_receipts(spark: SparkSession, root: str) -> DataFrame:
    """The first receipt of each answer and how late later ones came."""
    rows = table(spark, root, "placer_generate").where("output_id is not null").select("output_id", "engine", F.unix_micros(F.col("received_at").cast("timestamp")).alias("us"))
    per = rows.groupBy("output_id").agg(F.min_by("engine", F.struct("us", "engine")).alias("engine"), F.count(F.lit(1)).alias("receipts"), (F.max("us") - F.min("us")).alias("spread_us"))
    return per.groupBy("engine").agg(F.count(F.lit(1)).alias("answers"), F.sum("receipts").alias("receipts"), F.max("spread_us").alias("latest_us"))


QUERIES = {f.__name__: f for f in (room_preparation, release_counters, release_rows, evaluation_summary, best_samples, engine_contrast, size_errors, size_overlaps, critic_edits, hard_negatives, augmentation_checks, call_latency, latest_receipts)}
ORACLES = {
    "call_latency": """
        WITH c AS (SELECT DISTINCT call_id, expected_model, status, usage.total_tokens AS t, epoch_us(finished_at) - epoch_us(started_at) AS us FROM stream_state)
        SELECT expected_model, status, count(*) AS calls, round(avg(us / 1e6), 6) AS mean_s, round(quantile_cont(us / 1e6, 0.5), 6) AS p50_s, round(quantile_cont(us / 1e6, 0.95), 6) AS p95_s, CAST(sum(t) AS BIGINT) AS tokens FROM c GROUP BY 1, 2""",
    "size_errors": """
        WITH r AS (SELECT DISTINCT uid, source, target, sizes FROM rooms WHERE sizes IS NOT NULL AND json_valid(target) AND json_valid(sizes))
        , p AS (SELECT uid, source, sizes, unnest(json_extract(target, '$.placements[*]')) AS x FROM r)
        , v AS (SELECT source, CAST(json_extract(x, '$.size') AS DOUBLE[]) AS t, CAST(json_extract(sizes, '$."' || json_extract_string(x, '$.id') || '"') AS DOUBLE[]) AS g FROM p)
        , l AS (SELECT source, [ln(g[i] / t[i]) for i in [1, 2, 3]] AS d FROM v WHERE len(t) = 3 AND len(g) = 3 AND list_min(t) > 0 AND list_min(g) > 0)
        SELECT source, count(*) AS objects, round(avg((abs(d[1]) + abs(d[2]) + abs(d[3])) / 3), 6) AS log_mae, round(avg((d[1] + d[2] + d[3]) / 3), 6) AS log_bias FROM l GROUP BY 1""",
    "size_overlaps": """
        WITH r AS (SELECT DISTINCT uid, source, target, sizes FROM rooms WHERE sizes IS NOT NULL AND json_valid(target) AND json_valid(sizes))
        , p AS (SELECT uid, source, sizes, unnest(json_extract(target, '$.placements[*]')) AS x FROM r)
        , v AS (SELECT source, CAST(json_extract(x, '$.size') AS DOUBLE[]) AS t, CAST(json_extract(sizes, '$."' || json_extract_string(x, '$.id') || '"') AS DOUBLE[]) AS g FROM p)
        , o AS (SELECT source, least(t[1], g[1]) * least(t[2], g[2]) * least(t[3], g[3]) AS b, t[1] * t[2] * t[3] + g[1] * g[2] * g[3] AS w FROM v WHERE len(t) = 3 AND len(g) = 3 AND list_min(t) > 0 AND list_min(g) > 0)
        SELECT source, count(*) AS objects, round(avg(b / (w - b)), 6) AS overlap FROM o GROUP BY 1""",
    "latest_receipts": """
        WITH r AS (SELECT output_id, first(engine ORDER BY received_at, engine) AS engine, count(*) AS receipts, max(epoch_us(received_at)) - min(epoch_us(received_at)) AS spread FROM placer_generate WHERE output_id IS NOT NULL GROUP BY 1)
        SELECT engine, count(*) AS answers, CAST(sum(receipts) AS BIGINT) AS receipts, max(spread) AS latest_us FROM r GROUP BY 1""",
}
