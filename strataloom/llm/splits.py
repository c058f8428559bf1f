"""Splits that keep related records together.

Relation. A raw room belongs to a house (its source with its house number) and to any
shared visits it names. Each room gives its keys; keys named by one room are linked;
the components of the keys are the families. The graph is over keys, not over rooms, so a
house with a third of all rooms is a single node.

Assignment. Families are weighed by their selected records. A multiset of sizes
(size -> number of families) is all that the choice of totals needs: a subset-sum bitset
over the size multiplicities picks the multiset whose total lies closest to each split's
share. What is taken of each size is then handed to families in hash order.

Scale: the histogram of sizes has at most sqrt(2n) rows for n records and is the only
thing a single task sees; the bitset has two bits for each record of a goal, and no history of bitsets is kept: what was taken is
found again by halves. Links and answers are resolved for each distinct house, so the rows of a hot house meet one row; components and joins are distributed, see operators.components.

Defined cases: NULL, empty or unreadable rows count as rooms with the house number of the uid; a
uid with less than three pieces and no group is its own house; rooms that are selected but not
in raw form families of their own uid's house without aliases; ``dev`` is ``validation``; NULL splits are ignored
when splits are compared; repeated rows count once; an empty table gives no families.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.jsontext import elements, id_text, read_json
from strataloom.operators.components import components
from strataloom.operators.ranking import ranked
from strataloom.runtime import cut, map_records, spread

#: Rows of one key that meet one row of a table before they are spread.
HEAVY = 200_000
_DIGITS = re.compile(r"[0-9]+")
_OTHER = re.compile(r"[\W_]+")
_ZEROS = re.compile(r"(?<![0-9])0+(?=[0-9])")


def plain_name(text: str) -> str:
    """A name without case, separators and leading zeros."""
    return _OTHER.sub("", _ZEROS.sub("", text.casefold()))


def house_number(text: str) -> str:
    """The number of a house name; a name without one stands for itself."""
    found = _DIGITS.findall(text)
    return str(int(found[-1])) if found else plain_name(text)


def room_keys(source, uid, row) -> list[str]:
    """Keys of one raw room: its house first, then its aliases."""
    value = read_json(row)
    room = value if isinstance(value, dict) else {}
    group = id_text(room.get("group"))
    if group is None or not group.strip():
        pieces = (uid or "").split(":")
        group = pieces[1] if len(pieces) >= 3 else uid or ""
    keys = [f"h|{source or ''}|{house_number(group)}"]
    meta = room.get("meta")
    aliases = meta.get("group_aliases") if isinstance(meta, dict) else None
    for key, alias in elements(aliases) if not isinstance(aliases, str) else [(None, aliases)]:
        text = id_text(alias)
        if text is not None and plain_name(text):
            keys.append(f"a|{plain_name(text)}")
    return keys


def keyed_rooms(raw: DataFrame) -> DataFrame:
    """(uid, source, keys) of each raw row."""

    def make():
        return lambda record: [(record[1], record[0], room_keys(*record))] if record[1] is not None else []

    return map_records(spread(raw.select(*(F.col(c).cast("string") for c in ("source", "uid", "row")))), "uid string, source string, keys array<string>", make)


def selected_splits(selected: DataFrame) -> DataFrame:
    """Distinct (uid, split) with old names replaced."""
    name = F.lower(F.trim("split"))
    return selected.where("uid is not null").select("uid", F.when(name == "dev", "validation").otherwise(name).alias("split")).distinct()


def families(raw: DataFrame, selected: DataFrame) -> DataFrame:
    """(uid, split, source, family) of every selected room; family is the smallest key of its component."""
    rooms = cut(keyed_rooms(raw).distinct())
    one = rooms.select("uid", "source", F.col("keys")[0].alias("house"), "keys")
    links = one.select("house", F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("b")).distinct()
    # several rows of one uid that name different houses link them as well
    twice = one.groupBy("uid").agg(F.min("house").alias("house"), F.max("house").alias("b")).where("house <> b").select("house", "b")
    roots = components(links.union(twice), "house", "b")
    chosen = selected_splits(selected)
    homes = one.groupBy("uid").agg(F.min("house").alias("house"), F.min("source").alias("source"))
    placed = chosen.join(homes, "uid", "left").withColumn("house", F.coalesce("house", F.concat(F.lit("u|"), "uid")))
    return salted_lookup(placed, roots.withColumnRenamed("node", "house"), "house").select("uid", "split", "source", F.coalesce("root", "house").alias("family"))


def salted_lookup(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join of rows to a table with one row a key. Keys of more than HEAVY rows are spread: their rows over salts, their one row copied to each salt."""
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HEAVY).select(key, F.ceil(F.col("_n") / HEAVY).cast("int").alias("_salts"))
    spread_rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.floor(F.rand(7) * F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")  # at most one key for HEAVY rows
    copied = small.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread_rows.join(copied, [key, "_salt"], "left").drop("_salt")


def broken(placed: DataFrame) -> DataFrame:
    """(uid, family_uid) of every room in a family with more than one split."""
    torn = placed.groupBy("family").agg(F.min("uid").alias("family_uid"), F.min("split").alias("s0"), F.max("split").alias("s1")).where("s0 <> s1").select("family", "family_uid")
    return placed.join(torn, "family").select("uid", "family_uid").distinct()


def binary_parts(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """(size, families) pieces of 1, 2, 4, ... families, largest sizes first; together they give every multiplicity up to a total of ``most``."""
    out = []
    for s, n in sorted(sizes.items(), reverse=True):
        left, step = min(n, most // s if s else 0), 1
        while left > 0:
            out.append((s, min(step, left)))
            left -= out[-1][1]
            step *= 2
    return out


def sums(pieces: list[tuple[int, int]], most: int) -> int:
    """Bitset of the totals up to ``most`` that subsets of the pieces reach."""
    reach, limit = 1, (1 << (most + 1)) - 1
    for s, n in pieces:
        reach |= (reach << (s * n)) & limit
    return reach


def mirrored(bits: int, top: int) -> int:
    """Bit i of a bitset at top - i."""
    return int(f"{bits:0{top + 1}b}"[::-1][: top + 1], 2)


def chosen_pieces(pieces: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """Pieces that sum up to a reachable total, by halves: no bitset but those of two halves is held, and the totals of the halves add up to the total."""
    work, out = [(pieces, total)], []
    while work:
        some, at = work.pop()
        if not at:
            continue
        if len(some) == 1:
            out.extend(some)
            continue
        half = len(some) // 2
        left, right = sums(some[:half], at), sums(some[half:], at)
        both = left & mirrored(right, at)
        share = (both & -both).bit_length() - 1
        work += [(some[:half], share), (some[half:], at - share)]
    return out


def closest(sizes: dict[int, int], goal: int) -> dict[int, int]:
    """How many of each size to take so that their total lies as close to ``goal`` as can be; the smaller total of two as close.

    Exact at every size: a bitset over sums and binary pieces of the multiplicities. Pieces behind the first that makes the goal itself reachable aren't needed.
    """
    goal = max(0, min(goal, sum(s * n for s, n in sizes.items())))
    pieces = binary_parts(sizes, 2 * goal)
    reach, limit, needed = 1, (1 << (2 * goal + 1)) - 1, len(pieces)
    for i, (s, n) in enumerate(pieces):
        if (reach >> goal) & 1:
            needed = i
            break
        reach |= (reach << (s * n)) & limit
    low = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = reach >> goal
    high = goal + (over & -over).bit_length() - 1 if over else None
    taken = dict.fromkeys(sizes, 0)
    for s, n in chosen_pieces(pieces[:needed], high if high is not None and high - goal < goal - low else low):
        taken[s] += n
    return taken


def choose(sizes: dict[int, int], goals: list[tuple[str, int]], rest: str) -> list[tuple[str, int, int, int]]:
    """(split, size, first, last) ranks of each size handed to each split; all others go to ``rest``."""
    left, start, out = dict(sizes), dict.fromkeys(sizes, 0), []
    for split, goal in goals:
        for s, n in closest(left, goal).items():
            if n:
                out.append((split, s, start[s] + 1, start[s] + n))
                start[s] += n
                left[s] -= n
    out.extend((rest, s, start[s] + 1, start[s] + n) for s, n in left.items() if n)
    return out


def assign(placed: DataFrame, plan: DataFrame, catalog: DataFrame, seed: int = 0) -> DataFrame:
    """(uid, family_uid, old_split, split): whole families, near the shares of ``plan``.

    Families with a room of an ``evaluation_only`` source go to test and count towards its goal.
    """
    spark = placed.sparkSession
    only = catalog.where("role = 'evaluation_only'").select("source").distinct().withColumn("pinned", F.lit(True))
    rooms = cut(placed.join(only, "source", "left"))
    sized = rooms.groupBy("family").agg(F.count_distinct("uid").alias("size"), F.min("uid").alias("family_uid"), F.coalesce(F.max("pinned"), F.lit(False)).alias("pinned"))
    sized = cut(sized)
    histogram = sized.groupBy("pinned", "size").count().collect()  # at most sqrt(2n) sizes for n records
    shares = {r["split"]: float(r["share"]) for r in plan.where("split is not null and share is not null").select("split", "share").collect()}  # a fixed table
    total = sum(r["size"] * r["count"] for r in histogram)
    pinned = sum(r["size"] * r["count"] for r in histogram if r["pinned"])
    rest = max(shares, key=lambda s: (shares[s], s)) if shares else "train"
    goals = [(s, max(0, round(total * shares[s]) - (pinned if s == "test" else 0))) for s in sorted(shares) if s != rest]
    free = {r["size"]: r["count"] for r in histogram if not r["pinned"]}
    table = spark.createDataFrame(choose(free, goals, rest) or [(rest, 0, 0, 0)], "new_split string, of_size long, first long, last long")
    order = ranked(sized.where("not pinned"), ["size"], ["family"], seed)
    # one row of the small table for each size and split
    named = order.join(table, (F.col("size") == F.col("of_size")) & F.col("rank").between(F.col("first"), F.col("last"))).select("family", "family_uid", F.col("new_split").alias("split"))
    named = named.unionByName(sized.where("pinned").select("family", "family_uid", F.lit("test").alias("split")))
    return rooms.select("uid", "family", F.col("split").alias("old_split")).join(named, "family").select("uid", "family_uid", "old_split", "split").distinct()
