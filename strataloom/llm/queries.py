"""Queries of the operators on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm import mixing, overlap, packing, pairs, splits, truncation
from strataloom.runtime import cut, table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return splits.broken(splits.families(table(spark, root, "raw"), table(spark, root, "selected")))


def p2_splits(spark: SparkSession, root: str) -> DataFrame:
    """A split for every selected room, whole families together."""
    placed = splits.families(table(spark, root, "raw"), table(spark, root, "selected"))
    return splits.assign(placed, table(spark, root, "split_plan"), table(spark, root, "source_catalog"))


def p2_shares(spark: SparkSession, root: str) -> DataFrame:
    """Rooms and share of each new split."""
    counted = p2_splits(spark, root).groupBy("split").agg(F.count_distinct("uid").alias("rooms"), F.count_distinct("family_uid").alias("families"))
    total = F.sum("rooms").over(Window.partitionBy(F.lit(1)))  # one row a split
    return counted.select("split", "rooms", "families", F.round(F.col("rooms") / total, 6).alias("share"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defects(table(spark, root, "placer_generate"), table(spark, root, "rooms"), table(spark, root, "stream_state"))


def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    """Records and defects of each kind, per engine or model."""
    both = pairs.pairs(table(spark, root, "placer_generate"), table(spark, root, "rooms"), table(spark, root, "stream_state"))
    whose = both.select("record_id", "kind", "source").distinct()
    found = p3_found(spark, root)
    return whose.join(found, "record_id", "left").groupBy("kind", "source", F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count_distinct("record_id").alias("records"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return overlap.found(table(spark, root, "selected"))


def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    """Leaked rooms of each evaluation split and source."""
    return overlap.counts(table(spark, root, "selected"), table(spark, root, "source_catalog"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Filling of every container of every profile."""
    return packing.containers(p6_items(spark, root))


def p6_items(spark: SparkSession, root: str) -> DataFrame:
    """The container of every text."""
    return packing.packed(table(spark, root, "documents"), table(spark, root, "pack_bins"))


def p6_summary(spark: SparkSession, root: str) -> DataFrame:
    return packing.summary(p6_containers(spark, root))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    """The chosen texts and how often each is used."""
    return mixing.mixed(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.reached(p7_mix(spark, root), table(spark, root, "mix_targets"))


def p7_pools(spark: SparkSession, root: str) -> DataFrame:
    """Shares reached where sources overlap: each text stands in its feed and in the pool of its language, and feeds and pools get half of all tokens each."""
    texts = table(spark, root, "documents")
    pools = F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("none")))
    both = texts.select("doc_id", "text", F.explode(F.array("source", pools)).alias("source"))
    feeds = table(spark, root, "mix_targets").select("source", (F.col("target_share") / 2).alias("target_share"), "max_repeats")
    names = texts.select(pools.alias("source")).distinct()  # one row a language
    per = Window.partitionBy(F.lit(1))
    langs = names.select("source", (F.lit(0.5) / F.count(F.lit(1)).over(per)).alias("target_share"), F.lit(3).alias("max_repeats"))
    targets = feeds.unionByName(langs)
    return mixing.reached(mixing.mixed(both, targets), targets)


def p2_whole(spark: SparkSession, root: str) -> DataFrame:
    """Rooms placed by the new splits, rooms with more than one, and families with more than one."""
    placed = p2_splits(spark, root)
    per = placed.groupBy("uid").agg(F.count_distinct("split").alias("n"))
    torn = placed.groupBy("family_uid").agg(F.count_distinct("split").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("torn_families"), F.lit(1).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("rooms"), F.count(F.when(F.col("n") > 1, 1)).alias("twice"), F.lit(1).alias("k")).join(torn, "k").drop("k")


def p6_placed(spark: SparkSession, root: str) -> DataFrame:
    """Texts placed for each profile, texts in parts though they fit alone, and overfull containers."""
    items = p6_items(spark, root)
    texts = items.groupBy("profile", "doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"), F.max("capacity").alias("capacity"))
    per = texts.groupBy("profile").agg(F.count(F.lit(1)).alias("texts"), F.count(F.when((F.col("parts") > 1) & (F.col("size") <= F.col("capacity")), 1)).alias("cut_texts"))
    full = packing.containers(items).groupBy("profile").agg(F.count(F.when(F.col("slack") < 0, 1)).alias("overfull"))
    return per.join(full, "profile")


def p7_limits(spark: SparkSession, root: str) -> DataFrame:
    """Sources of the mix, and texts used more often than their source allows."""
    mix = p7_mix(spark, root).join(table(spark, root, "mix_targets").groupBy("source").agg(F.min("max_repeats").alias("most")), "source")
    return mix.groupBy("source").agg(F.count(F.when((F.col("repeats") > F.col("most")) | (F.col("repeats") < 1), 1)).alias("overused"))


def p8_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """Texts without a full stop that are strict prefixes of longer texts, blanks at the ends left out: the value level of p8."""
    bodies = table(spark, root, "documents").where("text is not null").select(F.rtrim("text", F.lit(truncation.BLANKS)).alias("body")).where("body <> ''").distinct()
    texts = cut(bodies.select("body", F.expr("right(body, 16)").rlike(truncation.STOP).alias("stops")).withColumn("id", F.monotonically_increasing_id()))
    return texts.join(truncation.longer_copies(texts), "id").select(F.sha2("body", 256).alias("digest"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.found(table(spark, root, "documents"))


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.rates(table(spark, root, "documents"))


def p8_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Which prefix level, or which other sign, told of the cut texts of each source."""
    return truncation.evidence(table(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p2_shares, p2_whole, p3_found, p3_rates, p5_found, p5_counts, p6_containers, p6_items, p6_summary, p6_placed, p7_mix, p7_shares, p7_limits, p7_pools, p8_found, p8_rates, p8_evidence, p8_prefixes)}
_READ = """CASE WHEN json_valid("row") THEN CASE WHEN json_type("row") = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string("row", '$')) THEN json_extract_string("row", '$') END ELSE "row" END END"""
# all pairs of rooms, each object with its partners; a matching by counts from both sides
_TWINS = rf"""
        WITH s0 AS (SELECT DISTINCT uid, CASE lower(trim(split)) WHEN 'train' THEN 't' WHEN 'dev' THEN 'e' WHEN 'validation' THEN 'e' WHEN 'test' THEN 'e' END AS side, {_READ} AS j FROM selected WHERE uid IS NOT NULL)
        , s1 AS (SELECT row_number() OVER () AS r, uid, side, json_extract(j, '$.messages[*]') AS ms FROM s0 WHERE side IS NOT NULL AND j IS NOT NULL)
        , s2 AS (SELECT r, uid, side, json_extract_string(m, '$.role') AS role, regexp_replace(regexp_replace(json_extract_string(m, '$.content'), '^\s*```[a-z]*\s*', ''), '\s*```\s*$', '') AS c FROM (SELECT r, uid, side, unnest(ms) AS m FROM s1))
        , s3 AS (SELECT r, uid, side, role, CASE WHEN json_type(c) = 'VARCHAR' THEN json_extract_string(c, '$') ELSE c END AS t FROM s2 WHERE json_valid(c))
        , p AS (SELECT r, i, CAST(json_extract(b, '$[0]') AS DOUBLE) AS x, CAST(json_extract(b, '$[1]') AS DOUBLE) AS y FROM (SELECT r, unnest(range(len(json_extract(t, '$.boundary[*]')))) AS i, unnest(json_extract(t, '$.boundary[*]')) AS b FROM s3 WHERE role = 'user'))
        , f AS (SELECT r, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM p GROUP BY 1 HAVING count(*) > 2)
        , o0 AS (SELECT r, role, NULL AS k, unnest(CASE role WHEN 'user' THEN json_extract(t, '$.objects[*]') ELSE json_extract(t, '$.placements[*]') END) AS e FROM s3 WHERE CASE role WHEN 'user' THEN json_type(t, '$.objects') ELSE json_type(t, '$.placements') END = 'ARRAY'
          UNION ALL SELECT r, role, k, json_extract(c, '$."' || k || '"') FROM (SELECT r, role, c, unnest(json_keys(c)) AS k FROM (SELECT r, role, CASE role WHEN 'user' THEN json_extract(t, '$.objects') ELSE json_extract(t, '$.placements') END AS c FROM s3) WHERE json_type(c) = 'OBJECT'))
        , o1 AS (SELECT r, role, coalesce(k, json_extract_string(e, '$.id')) AS id, CAST(json_extract(e, '$.size') AS DOUBLE[]) AS size, CAST(json_extract(e, '$.pos') AS DOUBLE[]) AS pos FROM o0)
        , n AS (SELECT r, count(*) AS n FROM o1 WHERE role = 'user' GROUP BY 1)
        , o AS (SELECT row_number() OVER () AS o, a.r, pos.pos[1] - f.x0 AS x, pos.pos[2] - f.y0 AS y, pos.pos[3] AS z, a.size[1] AS sx, a.size[2] AS sy, a.size[3] AS sz FROM o1 a JOIN o1 pos ON pos.r = a.r AND pos.id = a.id AND pos.role = 'assistant' AND a.role = 'user' JOIN f ON f.r = a.r WHERE len(a.size) >= 3 AND len(pos.pos) >= 3)
        , rooms1 AS (SELECT s1.r, s1.uid, s1.side, f.w, f.h, f.x0, f.y0, n.n FROM s1 JOIN f USING (r) JOIN n USING (r))
        , e AS (SELECT rooms1.*, q, CASE WHEN q % 2 = 0 THEN w ELSE h END AS tw, CASE WHEN q % 2 = 0 THEN h ELSE w END AS th FROM rooms1, (SELECT unnest(range(4)) AS q) WHERE side = 'e')
        , c AS (SELECT e.r AS er, t.r AS tr, e.uid AS eu, t.uid AS tu, e.q, e.w, e.h, greatest(e.n, t.n) AS n FROM e JOIN rooms1 t ON t.side = 't' AND t.uid <> e.uid AND abs(t.w - e.tw) <= 0.0708 AND abs(t.h - e.th) <= 0.0708 AND least(e.n, t.n) >= 0.8 * greatest(e.n, t.n) - 1e-6)
        , m AS (SELECT c.er, c.tr, c.q, count(DISTINCT a.o) AS me, count(DISTINCT b.o) AS mt FROM c JOIN o a ON a.r = c.er JOIN o b ON b.r = c.tr
          AND abs(CASE c.q WHEN 0 THEN a.x WHEN 1 THEN c.h - a.y WHEN 2 THEN c.w - a.x ELSE a.y END - b.x) <= 0.05 + 1e-9 AND abs(CASE c.q WHEN 0 THEN a.y WHEN 1 THEN a.x WHEN 2 THEN c.h - a.y ELSE c.w - a.x END - b.y) <= 0.05 + 1e-9
          AND abs(a.z - b.z) <= 0.05 + 1e-9 AND abs(a.sx - b.sx) <= 0.05 + 1e-9 AND abs(a.sy - b.sy) <= 0.05 + 1e-9 AND abs(a.sz - b.sz) <= 0.05 + 1e-9 GROUP BY 1, 2, 3)
        , g AS (SELECT c.* FROM c JOIN m USING (er, tr, q) WHERE least(m.me, m.mt) >= ceil(0.8 * c.n - 1e-9))
        , pe AS (SELECT g.er, g.tr, g.q, p.i, CASE g.q WHEN 0 THEN p.x - f.x0 WHEN 1 THEN g.h - (p.y - f.y0) WHEN 2 THEN g.w - (p.x - f.x0) ELSE p.y - f.y0 END AS x, CASE g.q WHEN 0 THEN p.y - f.y0 WHEN 1 THEN p.x - f.x0 WHEN 2 THEN g.h - (p.y - f.y0) ELSE g.w - (p.x - f.x0) END AS y FROM g JOIN p ON p.r = g.er JOIN f ON f.r = g.er)
        , pt AS (SELECT g.er, g.tr, g.q, p.i, p.x - f.x0 AS x, p.y - f.y0 AS y FROM g JOIN p ON p.r = g.tr JOIN f ON f.r = g.tr)
        , z AS (SELECT 'e' AS side, * FROM pe UNION ALL SELECT 't', * FROM pt)
        , l AS (SELECT *, coalesce(lead(x) OVER w1, first_value(x) OVER w1) AS x2, coalesce(lead(y) OVER w1, first_value(y) OVER w1) AS y2 FROM z WINDOW w1 AS (PARTITION BY side, er, tr, q ORDER BY i))
        , v AS (SELECT a.er, a.tr, a.q, a.side, a.i, a.x, a.y, b.x AS bx, b.y AS by1, b.x2 - b.x AS dx, b.y2 - b.y AS dy FROM l a JOIN l b ON b.er = a.er AND b.tr = a.tr AND b.q = a.q AND b.side <> a.side)
        , k AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, ((x - bx) * dx + (y - by1) * dy) / (dx * dx + dy * dy))) END AS k FROM v)
        , d AS (SELECT er, tr, q, side, i, min(sqrt(power(x - bx - k * dx, 2) + power(y - by1 - k * dy, 2))) AS d FROM k GROUP BY 1, 2, 3, 4, 5)
        , ok AS (SELECT er, tr, q FROM d GROUP BY 1, 2, 3 HAVING max(d) <= 0.05 * sqrt(2) + 1e-9)"""
ORACLES = {
    "p2_found": f"""
        WITH RECURSIVE raw1 AS (SELECT DISTINCT uid, source, {_READ} AS j FROM raw)
        , g AS (SELECT DISTINCT uid, source, j, coalesce(nullif(trim(json_extract_string(j, '$.group')), ''), split_part(uid, ':', 2)) AS g FROM raw1)
        , x AS (SELECT uid, unnest(json_extract_string(j, '$.meta.group_aliases[*]')) AS a FROM g)
        , k AS (SELECT uid, 'h|' || source || '|' || CAST(regexp_extract(g, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS key FROM g UNION SELECT uid, 'a|' || regexp_replace(regexp_replace(lower(a), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[^a-z0-9]', '', 'g') FROM x WHERE a IS NOT NULL)
        , e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b ON a.uid = b.uid)
        , r(node, root) AS (SELECT a, min(b) FROM e GROUP BY a UNION SELECT e.a, min(r.root) FROM r JOIN e ON e.b = r.node GROUP BY e.a)
        , f AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        , s AS (SELECT DISTINCT uid, CASE WHEN split = 'dev' THEN 'validation' ELSE split END AS split FROM selected)
        , p AS (SELECT s.uid, s.split, min(f.root) AS root FROM s JOIN k ON k.uid = s.uid JOIN f ON f.node = k.key GROUP BY 1, 2)
        , t AS (SELECT root, min(uid) AS family_uid FROM p GROUP BY 1 HAVING min(split) <> max(split))
        SELECT DISTINCT p.uid, t.family_uid FROM p JOIN t ON t.root = p.root""",
    "p2_whole": "SELECT count(DISTINCT uid) AS rooms, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS torn_families FROM selected WHERE uid IS NOT NULL",
    "p6_placed": "SELECT profile, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text <> '') AS texts, CAST(0 AS BIGINT) AS cut_texts, CAST(0 AS BIGINT) AS overfull FROM pack_bins WHERE profile IS NOT NULL AND capacity_tokens > 0 GROUP BY 1",
    "p7_limits": "SELECT DISTINCT source, CAST(0 AS BIGINT) AS overused FROM mix_targets SEMI JOIN documents USING (source) WHERE target_share > 0 AND max_repeats > 0",
    "p8_prefixes": """
        WITH b AS (SELECT DISTINCT rtrim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288)) AS body FROM documents WHERE text IS NOT NULL)
        , h AS (SELECT body, left(body, 4) AS head FROM b WHERE body <> '')
        SELECT sha256(body) AS digest FROM h a WHERE NOT regexp_matches(right(body, 16), '[.!?。！？]["''”’»)\\]]*$|>$')
        AND (EXISTS (SELECT 1 FROM h b WHERE b.head = a.head AND length(b.body) > length(a.body) AND starts_with(b.body, a.body)) OR (length(a.body) < 4 AND EXISTS (SELECT 1 FROM h b WHERE length(b.body) > length(a.body) AND starts_with(b.body, a.body))))""",
    "p5_found": _TWINS + " SELECT DISTINCT least(eu, tu) AS uid_a, greatest(eu, tu) AS uid_b FROM g JOIN ok USING (er, tr, q)",
    "p5_counts": _TWINS + """
        , placed AS (SELECT DISTINCT uid, CASE lower(trim(split)) WHEN 'dev' THEN 'validation' ELSE lower(trim(split)) END AS split, split_part(uid, ':', 1) AS uid_prefix FROM selected WHERE uid IS NOT NULL)
        , leaked AS (SELECT eu AS uid, count(DISTINCT tu) AS twins FROM g JOIN ok USING (er, tr, q) GROUP BY 1)
        SELECT split, source, count(DISTINCT uid) AS rooms, count(DISTINCT uid) FILTER (twins IS NOT NULL) AS leaked, CAST(coalesce(sum(twins), 0) AS BIGINT) AS pairs
        FROM (SELECT DISTINCT placed.uid, placed.split, catalog.source, twins FROM placed LEFT JOIN (SELECT uid_prefix, source FROM source_catalog) catalog USING (uid_prefix) LEFT JOIN leaked USING (uid) WHERE placed.split IN ('validation', 'test')) GROUP BY 1, 2""",
}
