"""Parent-child rows to full hierarchies, with cycles told apart.

Method. Rows are laid out by locality and cut into fragments of at most
``fragment_rows`` nodes. Each fragment contracts its own parent chains: every node
learns the first node above it that lies outside the fragment (its exit), the number
of links to it and the nodes passed. Nodes that are the exit of another fragment's
chains form a smaller quotient forest with weighted links, which is solved the same way
again; then the fragment paths are expanded with the answers. A chain that runs in a
circle inside a fragment is found there; one that crosses fragments becomes a circle
of the quotient. Where a level doesn't shrink, one round of pointer doubling halves its depth
instead, so the levels stay logarithmic in the depth.

Scale: memory of a task is bounded by ``fragment_rows`` whatever the partition holds. A
locality with more nodes than that is salted over several tasks. Nothing is sent to the driver but counts.

Defined cases: a NULL or unknown parent is no link; several rows of one node keep the smallest
non-null parent; a node linking to itself is a circle; nodes that hang on a circle never end
either: their root is '' and their depth -1, their path is empty (``circle_states`` tells them from those on it); rows with a NULL node are dropped as no node.
A level of at most ``fragment_rows`` nodes is one fragment of one task; the answers don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataloom.functions.jsontext import elements, id_text, read_json
from strataloom.operators.nested import own_id
from strataloom.runtime import as_batch, cut, map_records, shuffle_width, spread

FRAGMENT_ROWS = 50_000
LOCAL = T.StructType()
for _name in ("g", "n", "parent"):
    LOCAL.add(_name, T.StringType())
LOCAL.add("weight", T.LongType()).add("exit", T.StringType()).add("dist", T.LongType()).add("way", T.ArrayType(T.StringType())).add("state", T.StringType())


def contract(rows: list[tuple]) -> Iterator[tuple]:
    """Chains of one fragment. rows: (g, n, parent, weight, way); yields LOCAL tuples.

    state is ``root`` (exit is the root itself), ``out`` (exit lies outside) or ``ring``.
    """
    link = {(g, n): (parent, weight, way) for g, n, parent, weight, way in rows}
    done: dict[tuple, tuple] = {}
    for start in link:
        trail, at = [], start
        seen = set()
        while at not in done and at in link and link[at][0] is not None and at not in seen:
            seen.add(at)
            trail.append(at)
            at = (at[0], link[at][0])
        if at in done:
            end = done[at]
        elif at in seen:
            end = (None, 0, "ring", [])
        elif at in link:
            end = done[at] = (at[1], 0, "root", [])
        else:
            end = (at[1], 0, "out", [])
        for node in reversed(trail):
            _, weight, way = link[node]
            end = (end[0], end[1] + weight, end[2], way + end[3]) if end[2] != "ring" else (None, 0, "ring", [])
            done[node] = end
    for (g, n), (exit_, dist, state, way) in done.items():
        if (g, n) in link:
            yield g, n, link[g, n][0], link[g, n][1], exit_, dist, way, state


def fragments(df: DataFrame, rows: int) -> DataFrame:
    """contract() over runs of at most ``rows`` rows of each partition, in their order."""
    arrow = to_arrow_schema(LOCAL)

    def flush(held):
        out = []
        for row in contract(held):
            out.append(row)
            if len(out) == 4096:
                yield as_batch(out, arrow)
                out = []
        if out:
            yield as_batch(out, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) > rows:
                # a locality that fits is never cut in two: the fragment ends before the group that would overflow
                g, stop = held[rows - 1][0], rows
                if held[rows][0] == g:
                    while stop and held[stop - 1][0] == g:
                        stop -= 1
                    stop = stop or rows
                yield from flush(held[:stop])
                held = held[stop:]
        yield from flush(held)

    return df.select("g", "n", "parent", "weight", "way").mapInArrow(run, LOCAL)


def lay_out(df: DataFrame, rows: int) -> DataFrame:
    """Partitions by locality; a locality of more than ``rows`` nodes is spread by node."""
    heavy = df.groupBy("g").count().where(F.col("count") > rows).select("g", F.ceil(F.col("count") / rows).alias("spread"))
    salted = df.join(heavy, "g", "left").withColumn("salt", F.when(F.col("spread").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("n"), F.col("spread"))))
    width = shuffle_width(df.sparkSession)
    return salted.repartition(width, "g", "salt").sortWithinPartitions("g", "n").drop("spread", "salt")


def solve(df: DataFrame, rows: int, level: int = 0) -> DataFrame:
    """(g, n, root, depth, path) of weighted links (g, n, parent, weight, way); path holds root first, n's own id not included."""
    total = df.count() if level else None
    if total is not None and total <= rows:
        local = cut(fragments(df.coalesce(1), rows + 1))
    else:
        local = cut(fragments(lay_out(df, rows), rows))
    out = local.where("state = 'out'").select("g", F.col("exit").alias("n")).distinct()
    known = local.select("g", "n", "parent", "weight", "exit", "dist", "way", "state")
    # exits that are nodes of another fragment; an exit that is no node at all can't occur, links are checked before
    quotient = known.join(out, ["g", "n"], "left_semi")
    ends = local.where("state <> 'out'").select("g", "n", F.when(F.col("state") == "root", F.col("exit")).otherwise("").alias("root"), F.when(F.col("state") == "root", F.col("dist")).otherwise(-1).alias("depth"), F.when(F.col("state") == "root", F.reverse("way")).otherwise(F.array().cast("array<string>")).alias("path"))
    if out.isEmpty():
        return ends
    links = quotient.select("g", "n", F.when(F.col("state") == "out", F.col("exit")).when(F.col("state") == "ring", F.col("n")).otherwise(F.when(F.col("exit") == F.col("n"), F.lit(None)).otherwise(F.col("exit"))).alias("parent"), F.col("dist").alias("weight"), "way")
    # a root reached inside the fragment must be a node of the quotient too
    tops = quotient.where("state = 'root' and exit <> n").select("g", F.col("exit").alias("n")).distinct().join(out, ["g", "n"], "left_anti").select("g", "n", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<string>").alias("way"))
    smaller = cut(links.unionByName(tops))
    before, after = local.count(), smaller.count()
    if after > 0.7 * before:
        smaller = cut(double(smaller))
    above = solve(smaller, rows, level + 1)
    through = local.where("state = 'out'").select("g", "n", F.col("exit"), "dist", "way")
    expanded = through.join(above.select("g", F.col("n").alias("exit"), "root", F.col("depth").alias("up"), F.col("path").alias("over")), ["g", "exit"]).select("g", "n", "root", F.when(F.col("up") < 0, -1).otherwise(F.col("up") + F.col("dist")).alias("depth"), F.when(F.col("up") < 0, F.array().cast("array<string>")).otherwise(F.concat("over", F.reverse("way"))).alias("path"))
    return ends.unionByName(expanded)


def double(df: DataFrame) -> DataFrame:
    """One round of pointer doubling: every link now leads two links up.

    A way that meets a node twice runs in a circle; its node then links to itself, so ways of circles don't keep growing.
    """
    up = df.select("g", F.col("n").alias("parent"), F.col("parent").alias("next"), F.col("weight").alias("more"), F.col("way").alias("then"))
    jumps = F.col("next").isNotNull() & (F.col("parent") != F.col("n"))
    longer = F.when(jumps, F.concat("way", "then")).otherwise(F.col("way"))
    two = df.join(up, ["g", "parent"], "left").select("g", "n", F.when(jumps, F.col("next")).otherwise(F.col("parent")).alias("parent"), F.when(jumps, F.col("weight") + F.col("more")).otherwise(F.col("weight")).alias("weight"), longer.alias("way"))
    ring = F.array_contains("way", F.col("n")) | (F.size(F.array_distinct("way")) < F.size("way"))
    return two.select("g", "n", F.when(ring, F.col("n")).otherwise(F.col("parent")).alias("parent"), "weight", F.when(ring, F.array("n")).otherwise(F.col("way")).alias("way"))


ROOM_EDGES = "uid string, object_id string, parent_id string"


def room_edges(rooms: DataFrame) -> DataFrame:
    """(uid, object_id, parent_id) of the objects and fixed boxes of each room.

    A link is the entry in ``parents`` (a map, or the older list of pairs); only
    an object without an entry takes the ``on`` of its placement. Links to no id of the
    room are none. Unreadable texts count as absent; the last of several entries holds.
    """

    def entries(value):
        if isinstance(value, dict):
            return {k: id_text(x.get("parent") if isinstance(x, dict) else x) for k, x in value.items()}
        if isinstance(value, list):
            return {id_text(x.get("id")): id_text(x.get("parent")) for x in value if isinstance(x, dict)}
        return {}

    def make():
        def act(record):
            uid, request, target, parents = record
            room = read_json(request)
            if uid is None or not isinstance(room, dict):
                return
            ids = {i: None for section in ("objects", "fixed") for key, x in elements(room.get(section)) if (i := own_id(key, x)) is not None}
            given, placed = entries(read_json(parents)), {}
            answer = read_json(target)
            if isinstance(answer, dict):
                placed = {own_id(key, x): id_text(x.get("on")) for key, x in elements(answer.get("placements")) if isinstance(x, dict)}
            for i in ids:
                up = given[i] if i in given else placed.get(i)
                yield uid, i, up if up in ids else None

        return act

    texts = rooms.select(*(F.col(c).cast("string") for c in ("uid", "request", "target", "parents")))
    return map_records(spread(texts), ROOM_EDGES, make).groupBy("uid", "object_id").agg(F.min("parent_id").alias("parent_id"))


def resolve(edges: DataFrame, group: str, node: str, parent: str, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """``group, node, root, depth, path`` for each node of each group; path runs from the root to the node."""
    one = edges.select(F.col(group).cast("string").alias("g"), F.col(node).cast("string").alias("n"), F.col(parent).cast("string").alias("p")).where("n is not null and g is not null").groupBy("g", "n").agg(F.min("p").alias("p"))
    ids = one.select("g", F.col("n").alias("p"), F.lit(True).alias("is_node"))
    linked = one.where("p is not null").join(ids, ["g", "p"], "left").select("g", "n", F.when(F.col("is_node"), F.col("p")).alias("parent"))
    return _resolve(linked.unionByName(one.where("p is null").select("g", "n", F.col("p").alias("parent"))), fragment_rows, group, node)


def resolve_checked(edges: DataFrame, group: str, node: str, parent: str, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """resolve() for edges whose parents are known to be nodes or NULL, each node once: no join is needed to check them."""
    return _resolve(edges.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(parent).alias("parent")), fragment_rows, group, node)


def _resolve(links: DataFrame, rows: int, group: str, node: str) -> DataFrame:
    weighted = links.select("g", "n", "parent", F.lit(1).cast("long").alias("weight"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>")).alias("way"))
    answers = solve(weighted, rows)
    return answers.select(F.col("g").alias(group), F.col("n").alias(node), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.when(F.col("depth") < 0, F.col("path")).otherwise(F.concat("path", F.array("n"))).alias("path"))


def descendants(resolved: DataFrame, group: str, node: str) -> DataFrame:
    """(group, ancestor, descendant, distance) for every pair on a path; the size of the result is the sum of the depths."""
    return resolved.where("depth > 0").select(group, F.col(node).alias("descendant"), F.col("depth"), F.posexplode("path").alias("at", "ancestor")).where("at < depth").select(group, "ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def circle_states(resolved: DataFrame, edges: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """(group, node, state) of nodes whose links never end: ``circle`` on a circle, ``below_circle`` where it only hangs on one.

    The links of these nodes are doubled until their targets no longer get fewer: links of that length lead onto circles only, and onto all of them.
    Rounds grow with the logarithm of the longest tail, not of the circles.
    """
    caught = resolved.where("depth < 0").select(F.col(group).alias("g"), F.col(node).alias("n"))
    links = cut(caught.join(edges.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(parent).alias("to")), ["g", "n"]).groupBy("g", "n").agg(F.min("to").alias("to")))
    ends = links.select("g", F.col("to").alias("n")).distinct()
    jumps, left = links, links.count()
    while True:
        now = ends.count()
        if now == left:
            break
        left = now
        jumps = cut(jumps.join(jumps.select("g", F.col("n").alias("to"), F.col("to").alias("next")), ["g", "to"]).select("g", "n", F.col("next").alias("to")))
        ends = jumps.select("g", F.col("to").alias("n")).distinct()
    on = ends.withColumn("state", F.lit("circle"))
    return links.join(on, ["g", "n"], "left").select(F.col("g").alias(group), F.col("n").alias(node), F.coalesce("state", F.lit("below_circle")).alias("state"))
