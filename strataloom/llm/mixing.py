"""Mixing sources to target shares of all tokens.

The same text may stand in several sources. Distinct texts are aggregated by the set of sources that hold them; a
min-cost flow routes their tokens to the quotas of the sources, and using a text again costs more with each repeat. What a
source gets of a set of texts is then a stretch of a tape that runs over these texts, in seeded order, again
and again; the texts under the stretch are chosen, as often as it passes them.

The total is the largest for which all quotas can be met, or a wanted one if that is less. No text is used more often than
``max_repeats`` of any source that holds it.

Scale: texts are aggregated by membership before anything else (at most as many groups as sets of sources that occur);
the flow works on these groups. The tape is a running sum over salted ranges (operators.ranking), so a set with a third
of all texts is no task of its own. Nothing is collected but one row for each set of sources.

Defined cases: texts of sources without target, NULL and empty texts are left out; a source with target but no text gets nothing, and the others' shares
are kept among themselves; repeated targets of one source are added, their least max_repeats holds; shares are scaled to sum to 1; no targets give an empty mix.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.sizes import sized
from strataloom.operators.ranking import ranked
from strataloom.runtime import cut


class Flow:
    """Min-cost flow with integer capacities, by successive cheapest paths."""

    def __init__(self, n):
        self.head = [[] for _ in range(n)]
        self.to, self.room, self.cost = [], [], []

    def arc(self, a, b, room, cost=0):
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.room.append(room)
        self.cost.append(cost)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.room.append(0)
        self.cost.append(-cost)
        return len(self.to) - 2

    def run(self, source, sink):
        """Send as much as can be, at least cost; returns the amount."""
        total, n = 0, len(self.head)
        while True:
            price, via = [math.inf] * n, [-1] * n
            price[source] = 0
            queue, waiting = deque([source]), [False] * n
            while queue:
                u = queue.popleft()
                waiting[u] = False
                for e in self.head[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and price[u] + self.cost[e] < price[v]:
                        price[v], via[v] = price[u] + self.cost[e], e
                        if not waiting[v]:
                            waiting[v] = True
                            queue.append(v)
            if via[sink] < 0:
                return total
            amount, v = math.inf, sink
            while v != source:
                amount = min(amount, self.room[via[v]])
                v = self.to[via[v] ^ 1]
            v = sink
            while v != source:
                self.room[via[v]] -= amount
                self.room[via[v] ^ 1] += amount
                v = self.to[via[v] ^ 1]
            total += amount


def route(groups: dict[tuple, int], shares: dict[str, float], repeats: dict[str, int], total: int):
    """(amount, {(group, source): tokens}): the cheapest flow to quotas of ``total``."""
    names, keys = sorted(shares), sorted(groups)
    net = Flow(2 + len(keys) + len(names))
    place = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    arcs = {}
    for i, key in enumerate(keys):
        for k in range(min(repeats[s] for s in key)):
            net.arc(0, 2 + i, groups[key], k * k)  # convex: each further use costs more
        for s in key:
            arcs[key, s] = net.arc(2 + i, place[s], groups[key] * repeats[s])
    for s in names:
        net.arc(place[s], 1, int(total * shares[s]))
    amount = net.run(0, 1)
    return amount, {k: net.room[e ^ 1] for k, e in arcs.items() if net.room[e ^ 1]}


def plan(groups: dict[tuple, int], shares: dict[str, float], repeats: dict[str, int], wanted: int | None = None):
    """(total, flows) for the largest total whose quotas can all be met."""
    filled = {s for key in groups for s in key}
    shares = {s: v for s, v in shares.items() if s in filled and v > 0}
    groups = {tuple(s for s in key if s in shares): 0 for key in groups} if not shares else _kept(groups, shares)
    if not shares or not groups:
        return 0, {}
    scale = sum(shares.values())
    shares = {s: v / scale for s, v in shares.items()}
    high = sum(n * min(repeats[s] for s in key) for key, n in groups.items())
    high = min(high, wanted) if wanted is not None else high
    low = 0
    meets = lambda t: route(groups, shares, repeats, t)[0] == sum(int(t * v) for v in shares.values())
    if not meets(high):
        while high - low > max(1, high // 100_000):
            mid = (low + high) // 2
            low, high = (mid, high) if meets(mid) else (low, mid)
    else:
        low = high
    return low, route(groups, shares, repeats, low)[1]


def _kept(groups, shares):
    out: dict[tuple, int] = {}
    for key, n in groups.items():
        kept = tuple(s for s in key if s in shares)
        if kept:
            out[kept] = out.get(kept, 0) + n
    return out


def mixed(documents: DataFrame, targets: DataFrame, wanted: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, repeats, tokens): the chosen texts, by the smallest doc_id that holds them in the source."""
    spark = documents.sparkSession
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats")).collect()  # a fixed table
    shares, repeats = {r["source"]: float(r["share"]) for r in goals}, {r["source"]: int(r["repeats"]) for r in goals}
    named = spark.createDataFrame([(s,) for s in sorted(shares)] or [("",)], "source string").where(F.lit(bool(shares)))
    texts = cut(sized(documents).where("tokens > 0").join(F.broadcast(named), "source").groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")))
    # at most one entry for each source a text stands in
    held = cut(texts.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("source")), "\t").alias("held"), F.max("tokens").alias("tokens")))
    groups = {tuple(r["held"].split("\t")): int(r["tokens"]) for r in held.groupBy("held").agg(F.sum("tokens").alias("tokens")).collect()}
    total, flows = plan(groups, shares, repeats, wanted)
    rows, at = [], {}
    for (key, source), amount in sorted(flows.items()):
        a = at.get(key, 0)
        rows.append(("\t".join(key), source, a, a + amount, groups[key]))
        at[key] = a + amount
    tape = spark.createDataFrame(rows or [("", "", 0, 0, 1)], "held string, source string, a long, b long, length long")
    order = ranked(held, ["held"], ["digest"], seed, size="tokens")
    # a few stretches for each set of sources
    middle = F.col("upto") - F.col("tokens") / 2
    passes = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - middle) / F.col("length")))
    chosen = order.join(F.broadcast(tape), "held").select("digest", "source", (passes("b") - passes("a")).cast("int").alias("repeats")).where("repeats > 0")
    return chosen.join(texts, ["digest", "source"]).select("doc_id", "source", "repeats", "tokens")


def reached(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source."""
    sums = mix.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    return goals.join(sums, "source", "left").withColumn("total", total).select("source", "target_share", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most", F.lit(0)).alias("most_repeats"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("share"))
