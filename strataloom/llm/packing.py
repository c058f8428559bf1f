"""Filling containers of fixed capacity with texts.

Texts of one size are alike, so the packing is found over the histogram of sizes, which has at most
as many rows as the capacity: minimum bin slack. The largest size left opens a container; a bitset
subset-sum over the other sizes left, with their counts, finds the sum closest to the room that
remains, and the counts used are traced back. Slack that even the least number of containers leaves is spread evenly: a fill that wastes no more than that ends the search,
so small sizes aren't used up early. That pattern is repeated as often as the counts allow; patterns follow
until nothing is left. The patterns then give every text its container: texts of a size are ranked by hash, and a
rank falls into the slot of exactly one pattern.

A text larger than the capacity alone gives full containers and one rest, which is packed like a text.

Scale: one narrow pass for the sizes, one aggregate for the histogram, ranks that no hot size can
overload (operators.ranking), and one lookup in the table of slots, whose size is bounded by the capacities and not
by the data. Nothing grows with the data but distributed tables.

Defined cases: texts without tokens need no room and get no container; NULL texts are left out; an empty table gives no containers; profiles with
NULL or non-positive capacity are left out; a repeated profile name keeps its largest capacity; texts posted twice are two items.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.sizes import sized
from strataloom.operators.ranking import ranked
from strataloom.runtime import cut, map_records

PATTERN = "profile string, pattern long, repeats long, base long, size long, used long, first long"


def fill(counts: dict[int, int], room: int, spare: int = 0) -> dict[int, int]:
    """The multiset of sizes whose sum comes closest to ``room`` from below, as size -> count.

    Sizes are taken in from the largest down; as soon as a sum within ``spare`` of the room is reached, smaller sizes aren't looked at and stay for later.
    """
    reach, history, pieces = 1, [1], []
    limit = (1 << (room + 1)) - 1
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, step = min(counts[size], room // size), 1
        while left > 0:
            use = min(step, left)
            reach |= (reach << (size * use)) & limit
            pieces.append((size, use))
            history.append(reach)
            left -= use
            step *= 2
        if reach >> (room - min(spare, room)):
            break
    at, used = reach.bit_length() - 1, {}
    for i in range(len(pieces) - 1, -1, -1):
        if not (history[i] >> at) & 1:
            size, use = pieces[i]
            at -= size * use
            used[size] = used.get(size, 0) + use
    return used


def patterns(histogram: dict[int, int], capacity: int):
    """(pattern, repeats) pairs that use up the histogram; pattern is size -> count in one container."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    total = sum(s * n for s, n in left.items())
    while left:
        # what the least number of containers leaves free anyway, for each of them: slack up to that costs no container
        least = -(-total // capacity)
        spare = (least * capacity - total) // least
        top = max(left)
        left[top] -= 1
        used = fill({s: n for s, n in left.items() if n > 0}, capacity - top, spare) if capacity > top else {}
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            total -= s * n * times
            left[s] -= n * times
            if not left[s]:
                del left[s]
        yield used, times


def largest_first(histogram: dict[int, int], capacity: int):
    """Patterns like those of ``patterns``, each of as many as fit of each size from the largest down. Not used by the queries: for histograms of few coarse sizes,
    where closest fills use small sizes up early and may need some containers more."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    while left:
        used, room = {}, capacity
        for size in sorted(left, reverse=True):
            if n := min(left[size], room // size):
                used[size] = n
                room -= n * size
        times = min(left[s] // n for s, n in used.items())
        left = {s: n - used.get(s, 0) * times for s, n in left.items() if n > used.get(s, 0) * times}
        yield used, times


def pieces(documents: DataFrame, bins: DataFrame) -> DataFrame:
    """(profile, capacity, doc_id, piece, size): a text, or the parts of one that exceeds the capacity."""
    held = bins.where("profile is not null and capacity_tokens > 0").groupBy("profile").agg(F.max("capacity_tokens").cast("long").alias("capacity")).collect()  # a fixed table
    profiles = [F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in held]
    texts = cut(sized(documents).where("tokens > 0").select("doc_id", "tokens"))
    every = texts.select("doc_id", "tokens", F.inline(F.array(*profiles))) if profiles else texts.where("false").selectExpr("doc_id", "tokens", "'' as profile", "1L as capacity")
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / F.col("capacity")))
    return every.select("profile", "capacity", "doc_id", "tokens", F.explode(parts).alias("piece")).select("profile", "capacity", "doc_id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("size"))


def slots(items: DataFrame) -> DataFrame:
    """Which ranks of a size fall into which containers: one row for each pattern and size; at most some rows for each size up to the capacity."""
    histogram = items.groupBy("profile", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))

    def solve(pdf):
        import pandas as pd

        rows = []
        for (profile, capacity), part in pdf.groupby(["profile", "capacity"]):
            start, base = {}, 0
            for number, (used, times) in enumerate(patterns({int(s): int(n) for s, n in zip(part["size"], part["n"])}, int(capacity))):
                for size, n in used.items():
                    first = start.get(size, 1)
                    rows.append((profile, number, times, base, size, n, first))
                    start[size] = first + n * times
                base += times
        return pd.DataFrame(rows, columns=["profile", "pattern", "repeats", "base", "size", "used", "first"])

    return histogram.groupBy("profile").applyInPandas(solve, PATTERN)


def packed(documents: DataFrame, bins: DataFrame, seed: int = 0) -> DataFrame:
    """(profile, container_id, doc_id, piece, size, capacity) of every text."""
    items = cut(pieces(documents, bins))
    table: dict = {}
    for r in slots(items).collect():  # bounded by the capacities
        table.setdefault((r["profile"], r["size"]), []).append((r["first"], r["base"], r["used"]))
    for held in table.values():
        held.sort()
    order = ranked(items, ["profile", "size"], ["doc_id", "piece"], seed)

    def make():
        starts = {k: [x[0] for x in v] for k, v in table.items()}

        def act(record):
            profile, capacity, doc_id, piece, size, rank = record
            key = (profile, size)
            first, base, used = table[key][bisect_right(starts[key], rank) - 1]
            return [(profile, base + (rank - first) // used, doc_id, piece, size, capacity)]

        return act

    return map_records(order.select("profile", "capacity", "doc_id", "piece", "size", "rank"), "profile string, container_id long, doc_id long, piece long, size long, capacity long", make)


def containers(items: DataFrame) -> DataFrame:
    """Filling of each container."""
    return items.groupBy("profile", "container_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("filled"), F.max("capacity").alias("capacity")).withColumn("slack", F.col("capacity") - F.col("filled"))


def summary(filled: DataFrame) -> DataFrame:
    """Containers, share of room used and the least number that any packing needs, of each profile."""
    return filled.groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.round(F.sum("filled") / F.sum("capacity"), 6).alias("fill"), F.sum("slack").alias("slack"), F.ceil(F.sum("filled") / F.max("capacity")).alias("least"))
