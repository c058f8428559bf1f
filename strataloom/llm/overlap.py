"""Rooms that stand, exactly or nearly, on both sides of a split.

A room becomes a text: each placed object is a word of eight letters, the coarse cells of the room's frame (width, height), of the object's
place and of its size, and the words stand in sorted order. Train rooms are written once, in their own frame; rooms of the evaluation splits in all four orientations.
The suffixes of all texts that begin with a word (a sparse suffix array) are put in partitions by their first word, sorted, and read in order: neighbours that share at
least their first word form a run. In a run, suffixes of both sides whose first objects agree within the tolerance reveal a shared span: that object, and the words both
suffixes go on with. The spans of a pair of rooms are merged into its coverage, the number of objects of the evaluation room inside them. Pairs with enough coverage go
to an exact check of frame and objects.

Nothing is lost to cell borders: an evaluation suffix is asked for in every spelling that a partner may have, with the tolerance of places and sizes for these and that of
outlines for the frame. Nothing is lost to the bound on coverage: a pair must match ceil(0.8 n) objects of the evaluation room, so of any n - ceil(0.8 n) + m of its objects m have a
partner and begin a span; only that many suffixes are asked for, those with the rarest first words, and a coverage of m is what a pair must reach (MEET, fewer where a room has fewer
objects). Suffixes are kept DEPTH words long: a longer span would begin again at later suffixes and could only raise a coverage, so that no pair is lost.

Scale: identical rooms are one class from the start, copies are expanded at the end only. A run with many suffixes is split on both sides: evaluation suffixes into blocks, train
suffixes into blocks, and each pair of blocks is a run of its own of at most about HEAVY rows a side, searched by place and not pair by pair. Only agreeing objects are handed on.

Defined cases: rooms without readable text, frame or placed objects give nothing; objects without
placement count as objects without partner; repeated rows fold; a uid on both sides doesn't pair with itself; NULL splits are neither side; a
frame of no area is compared like any other; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataloom.functions.jsontext import elements, id_text, read_json
from strataloom.operators.nested import own_id
from strataloom.runtime import cut, map_records, shuffle_width, spread

#: Metres by which places and sizes may differ, and by which corners may stand off an outline.
TOLERANCE = 0.05
EPS = 1e-9
FRAME = TOLERANCE * math.sqrt(2)
#: Edge of a cell in metres, share of objects that must match, words kept of a suffix, suffixes of one word and side in a run.
CELL, SHARE, DEPTH, HEAVY = 0.6, 0.8, 8, 20_000
#: Limits of the eight letters; the small surplus covers values kept in single precision.
LIMITS = np.array([FRAME] * 2 + [TOLERANCE] * 6) + 1e-4
#: Letters begin half a cell lower, so that the floor isn't a border.
SHIFT = 0.5


def numbers(value, n):
    """A list of n finite numbers, or None."""
    if not isinstance(value, list) or len(value) < n:
        return None
    out = [float(x) for x in value[:n] if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)]
    return out if len(out) == n else None


def room_of(text):
    """(outline, objects, number of objects) of a training row, anchored at the frame's corner; None where it holds no room."""
    row = read_json(text)
    asked = told = None
    for _, message in elements(row.get("messages")) if isinstance(row, dict) else []:
        if isinstance(message, dict) and message.get("role") in ("user", "assistant"):
            content = read_json(message.get("content"))
            if isinstance(content, dict):
                if message["role"] == "user":
                    asked = content
                else:
                    told = content
    if asked is None or told is None:
        return None
    outline = [p for x in asked.get("boundary") or [] if (p := numbers(x, 2))] if isinstance(asked.get("boundary"), list) else []
    if len(outline) < 3:
        return None
    x0, y0 = min(p[0] for p in outline), min(p[1] for p in outline)
    places = {own_id(k, e): numbers(e.get("pos"), 3) for k, e in elements(told.get("placements")) if isinstance(e, dict)}
    sizes = [(own_id(k, e), numbers(e.get("size"), 3)) for k, e in elements(asked.get("objects")) if isinstance(e, dict)]
    objects = []
    for name, size in sizes:
        place = places.get(name)
        if size and place:
            objects.append([place[0] - x0, place[1] - y0, place[2], *size])
    if not objects:
        return None
    return [[p[0] - x0, p[1] - y0] for p in outline], objects, len(sizes)


def turned(outline, objects, quarter):
    """The room after ``quarter`` turns of its frame, anchored again."""
    for _ in range(quarter):
        outline = [[-y, x] for x, y in outline]
        objects = [[-o[1], o[0], *o[2:]] for o in objects]
    x0, y0 = min(p[0] for p in outline), min(p[1] for p in outline)
    return [[p[0] - x0, p[1] - y0] for p in outline], [[o[0] - x0, o[1] - y0, *o[2:]] for o in objects]


def values_of(outline, objects):
    """What the words of a room are made of: its extent, then place and size of the object."""
    w, h = max(p[0] for p in outline), max(p[1] for p in outline)
    return np.array([[w, h, *o] for o in objects])


def letters(cells):
    """Cells as letters, eight bytes a word; cells that are 256 apart share a letter, which later checks undo."""
    return (np.asarray(cells).astype(np.int64) & 255).astype(np.uint8)


def base_cells(values):
    return np.floor(values / CELL + SHIFT)


def near_words(values):
    """(row, word) of all words that a partner of each row of ``values`` may have."""
    low, high = np.floor((values - LIMITS) / CELL + SHIFT), np.floor((values + LIMITS) / CELL + SHIFT)
    row, cells = np.arange(len(values)), low.copy()
    for axis in range(8):
        for step in range(1, int((high - low)[:, axis].max(initial=0)) + 1):
            more = (cells[:, axis] == low[row, axis]) & (low[row, axis] + step <= high[row, axis])
            other = cells[more]
            other[:, axis] += step
            row, cells = np.concatenate([row, row[more]]), np.concatenate([cells, other])
    return row, as_words(letters(cells))


def as_words(found):
    """Rows of eight letters as numbers that sort like the letters."""
    return np.ascontiguousarray(found).view(">u8").ravel().astype(np.uint64).view(np.int64)


ROOM = "uid string, side string, sig string, outline array<array<double>>, objects array<array<double>>, n int"


def rooms(selected: DataFrame) -> DataFrame:
    """One row for each (uid, side) and content, with the signature of the content."""
    name = F.lower(F.trim("split"))
    side = F.when(name == "train", "train").when(name.isin("dev", "validation", "test"), "eval")

    def make():
        def act(record):
            uid, where, text = record
            room = room_of(text)
            if uid is None or where is None or room is None:
                return []
            outline, objects, n = room
            rounded = [[[round(v, 6) + 0.0 for v in p] for p in part] for part in (outline, sorted(objects))]
            sig = hashlib.blake2b(repr((rounded, n)).encode(), digest_size=16).hexdigest()
            return [(uid, where, sig, *rounded, n)]

        return act

    return map_records(spread(selected.select("uid", side.alias("side"), "row")), ROOM, make, 256)


def text_of(outline, objects, turn):
    """(words, values, letters) of a room in one orientation, in the order of its text."""
    values = values_of(*turned(outline, objects, turn))
    found = letters(base_cells(values))
    order = np.lexsort(found.T[::-1])
    return as_words(found[order]), values[order], found[order]


def asked_of(n, placed):
    """(suffixes to ask for, coverage to reach) of a room of n objects, or None where too few of them are placed."""
    must = math.ceil(SHARE * n - EPS)
    need = min(MEET, must)
    return (placed - must + need, need) if placed >= must else None


#: Asked suffixes that must meet.
MEET = 2
SUFFIX = "word long, block int, other int, rest binary, asks boolean, room long, turn int, at int, need int, vals binary"


def pack(values):
    return values.astype(np.float32).tobytes()


def train_suffixes(classes: DataFrame) -> DataFrame:
    """All suffixes of train rooms in their own frame."""

    def make():
        def act(record):
            room, outline, objects = record
            words, values, found = text_of(outline, objects, 0)
            for i, word in enumerate(words.tolist()):
                yield word, found[i + 1 : i + DEPTH].tobytes(), room, i, pack(values[i])

        return act

    return map_records(classes.select("room", "outline", "objects"), "word long, rest binary, room long, at int, vals binary", make)


def asked_words(classes: DataFrame) -> DataFrame:
    """Words of evaluation rooms in all orientations, with the number that must be asked for."""

    def make():
        def act(record):
            room, outline, objects, n = record
            if asks := asked_of(n, len(objects)):
                for turn in range(4):
                    for i, word in enumerate(text_of(outline, objects, turn)[0].tolist()):
                        yield room, turn, i, word, asks[0]

        return act

    return map_records(classes.select("room", "outline", "objects", "n"), "room long, turn int, at int, word long, k int", make)


def asked_suffixes(chosen: DataFrame) -> DataFrame:
    """The chosen suffixes of evaluation rooms in every near spelling; chosen holds 4-fold positions ``at * 4 + turn``."""

    def make():
        def act(record):
            room, outline, objects, n, places = record
            need = asked_of(n, len(objects))[1]
            spots = [(p % 4, p // 4) for p in sorted(places, key=lambda p: p % 4)]
            texts = {turn: text_of(outline, objects, turn) for turn in {t for t, _ in spots}}
            packed = [(t, i, texts[t][2][i + 1 : i + DEPTH].tobytes(), pack(texts[t][1][i])) for t, i in spots]
            for j, word in zip(*(x.tolist() for x in near_words(np.array([texts[t][1][i] for t, i in spots])))):
                turn, i, rest, vals = packed[j]
                yield word, rest, room, turn, i, need, vals

        return act

    return map_records(chosen.select("room", "outline", "objects", "n", "places"), "word long, rest binary, room long, turn int, at int, need int, vals binary", make)


def suffixes(train: DataFrame, evals: DataFrame) -> DataFrame:
    """All suffixes that can meet: train suffixes, and the asked ones of the evaluation rooms in every near spelling."""
    ours = cut(train_suffixes(train))
    held = cut(ours.groupBy("word").agg(F.count(F.lit(1)).alias("held")))
    rank = Window.partitionBy("room", "turn").orderBy(F.coalesce("held", F.lit(0)), "at")
    ranked = asked_words(evals).join(held, "word", "left").withColumn("r", F.row_number().over(rank)).where("r <= k")
    chosen = ranked.groupBy("room").agg(F.collect_list(F.col("at") * 4 + F.col("turn")).alias("places"))
    theirs = cut(asked_suffixes(evals.join(chosen, "room")))
    # blocks of words that many suffixes of a side begin with
    blocks = lambda n: F.ceil(F.col(n) / HEAVY).cast("int")
    many = held.where(F.col("held") > HEAVY).select("word", blocks("held").alias("t")).join(theirs.groupBy("word").agg(F.count(F.lit(1)).alias("asks")).where(F.col("asks") > HEAVY).select("word", blocks("asks").alias("e")), "word", "full").select("word", F.coalesce("t", F.lit(1)).alias("t"), F.coalesce("e", F.lit(1)).alias("e"))
    one = F.lit(1)
    own = lambda n: F.pmod(F.xxhash64("room", "at"), F.coalesce(n, one)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))
    asking = theirs.join(many, "word", "left").select("word", own("e").alias("block"), every("t").alias("other"), "rest", F.lit(True).alias("asks"), "room", "turn", "at", "need", "vals")
    holding = ours.join(many, "word", "left").select("word", every("e").alias("block"), own("t").alias("other"), "rest", F.lit(False).alias("asks"), "room", F.lit(0).alias("turn"), "at", F.lit(0).alias("need"), "vals")
    return asking.unionByName(holding)


SPAN = T.StructType().add("room_e", T.LongType()).add("turn", T.IntegerType()).add("room_t", T.LongType()).add("at", T.IntegerType()).add("span", T.IntegerType()).add("need", T.IntegerType())


def shared_words(a, b):
    """Common prefix of two suffixes behind their first words, in words."""
    n = min(len(a), len(b)) // 8 * 8
    for i in range(0, n, 8):
        if a[i : i + 8] != b[i : i + 8]:
            return i // 8
    return n // 8


#: Pairs of rows that are compared at once.
CHUNK = 500_000


def agreeing(run, asks, values):
    """Indices (i, j) of asking and other rows of the same run whose values agree within the limits; searched by the x of places, CHUNK pairs at a time."""
    x = np.clip(values[:, 2], -1e4, 1e4) + run * 4e4
    mine, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    others = others[np.argsort(x[others], kind="stable")]
    low = np.searchsorted(x[others], x[mine] - LIMITS[2] - 1e-3, "left")
    many = np.searchsorted(x[others], x[mine] + LIMITS[2] + 1e-3, "right") - low
    kept = many > 0
    mine, low, many = mine[kept], low[kept], many[kept]
    group = np.cumsum(many) // CHUNK
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        i = np.repeat(mine[at], many[at])
        j = others[np.arange(len(i)) - np.repeat(np.cumsum(many[at]) - many[at], many[at]) + np.repeat(low[at], many[at])]
        fits = (run[i] == run[j]) & (np.abs(values[i] - values[j]) <= LIMITS).all(axis=1)
        yield i[fits], j[fits]


def spans(ordered: DataFrame) -> DataFrame:
    """Shared spans of suffixes of both sides, from one pass over each sorted partition.

    Neighbours that share their first word (and block) are a run; all runs that end within a batch are searched together, the last one waits for the next batch.
    """
    arrow = to_arrow_schema(SPAN)
    names = ("room", "turn", "at", "need", "asks", "rest", "vals")

    def search(table, until):
        """Spans of the runs in the first ``until`` rows."""
        keys = [table.column(n).to_numpy()[:until] for n in ("word", "block", "other")]
        new = np.zeros(until, np.int64)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        c = {n: table.column(n).slice(0, until) for n in names}
        asks = c["asks"].to_numpy(zero_copy_only=False)
        values = np.frombuffer(b"".join(c["vals"].to_pylist()), np.float32).reshape(-1, 8).astype(np.float64)
        rest = c["rest"].to_pylist()
        room, turn, at, need = (c[n].to_numpy() for n in ("room", "turn", "at", "need"))
        for i, j in agreeing(np.cumsum(new), asks, values):
            if len(i):
                span = [1 + shared_words(rest[a], rest[b]) for a, b in zip(i.tolist(), j.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((room[i], turn[i], room[j], at[i], span, need[i]), arrow)], schema=arrow)

    def act(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks() if held is not None else pa.Table.from_batches([batch])
            # the last border: where neighbours don't share their first word
            keys = [held.column(n).to_numpy() for n in ("word", "block", "other")]
            borders = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(borders):
                until = int(borders[-1]) + 1
                yield from search(held, until)
                held = held.slice(until)
        if held is not None and held.num_rows:
            yield from search(held, held.num_rows)

    return ordered.mapInArrow(act, SPAN)


def candidates(train: DataFrame, evals: DataFrame) -> DataFrame:
    """(room_e, turn, room_t, covered): pairs whose merged spans cover enough objects of the evaluation room."""
    array = suffixes(train, evals)
    order = ["word", "block", "other"]
    ordered = array.repartition(shuffle_width(array.sparkSession), *order).sortWithinPartitions(*order, "rest").select(*order, "rest", "asks", "room", "turn", "at", "need", "vals")
    merged = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("span") - 1)))))
    return spans(ordered).groupBy("room_e", "turn", "room_t").agg(merged.alias("covered"), F.max("need").alias("need")).where("covered >= need").select("room_e", "turn", "room_t", "covered")


def outline_distance(point, outline):
    """Distance of a point to a closed line."""
    px, py = point
    best = math.inf
    for (ax, ay), (bx, by) in zip(outline, [*outline[1:], outline[0]]):
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / length)) if length else 0.0
        best = min(best, (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)
    return math.sqrt(best)


def same_outline(a, b, limit=FRAME + EPS):
    """Whether each corner of either outline lies on the other."""
    return all(outline_distance(p, b) <= limit for p in a) and all(outline_distance(p, a) <= limit for p in b)


def partners(a, b, tolerance=TOLERANCE):
    """Largest number of disjoint pairs of objects with the same place and size."""
    order = sorted(range(len(b)), key=lambda j: b[j][0])
    xs = [b[j][0] for j in order]
    near = []
    for o in a:
        low, high = bisect.bisect_left(xs, o[0] - tolerance - EPS), bisect.bisect_right(xs, o[0] + tolerance + EPS)
        near.append([j for j in order[low:high] if all(abs(p - q) <= tolerance + EPS for p, q in zip(o, b[j]))])
    owner: dict[int, int] = {}
    total = 0
    for i in range(len(a)):
        # augmenting path, breadth first
        came, queue, seen = {}, [i], set()
        end = None
        while queue and end is None:
            u = queue.pop(0)
            for j in near[u]:
                if j in seen:
                    continue
                seen.add(j)
                came[j] = u
                if j not in owner:
                    end = j
                    break
                queue.append(owner[j])
        while end is not None:
            u = came[end]
            previous = next((j for j, w in owner.items() if w == u), None)
            owner[end] = u
            end = previous
            if u == i:
                total += 1
                break
    return total


def same_room(a, b):
    """Exact check of two rooms (outline, objects, n), both in the same orientation."""
    if not same_outline(a[0], b[0]):
        return False
    need = math.ceil(SHARE * max(a[2], b[2]) - EPS)
    return min(len(a[1]), len(b[1])) >= need and partners(a[1], b[1]) >= need


def matched_classes(classes: DataFrame) -> DataFrame:
    """(room_e, room_t, covered) of classes that are the same room, after the exact check."""
    train, evals = classes.where("in_train"), classes.where("in_eval")
    pairs = cut(candidates(train, evals))
    content = F.struct("outline", "objects", "n")
    both = pairs.join(evals.select(F.col("room").alias("room_e"), content.alias("e")), "room_e").join(train.select(F.col("room").alias("room_t"), content.alias("t")), "room_t").select("room_e", "room_t", "turn", "covered", "e", "t")

    def make():
        def act(record):
            room_e, room_t, turn, covered, e, t = record
            outline, objects = turned(e["outline"], e["objects"], turn)
            if same_room((outline, objects, e["n"]), (t["outline"], t["objects"], t["n"])):
                yield room_e, room_t, covered

        return act

    return map_records(both, "room_e long, room_t long, covered int", make).groupBy("room_e", "room_t").agg(F.max("covered").alias("covered"))


def overlaps(selected: DataFrame) -> DataFrame:
    """(uid_e, uid_t, covered) of every room of an evaluation split that also stands in train."""
    parsed = cut(rooms(selected))
    grouped = parsed.groupBy("sig").agg(F.first("outline").alias("outline"), F.first("objects").alias("objects"), F.first("n").alias("n"), F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval"))
    classes = cut(grouped.withColumn("room", F.monotonically_increasing_id()))  # the numbers are kept with the rows
    members = parsed.select("sig", "uid", "side").distinct().join(classes.select("sig", "room"), "sig")
    pairs = matched_classes(classes)
    e = members.where("side = 'eval'").select(F.col("room").alias("room_e"), F.col("uid").alias("uid_e"))
    t = members.where("side = 'train'").select(F.col("room").alias("room_t"), F.col("uid").alias("uid_t"))
    return pairs.join(e, "room_e").join(t, "room_t").where("uid_e <> uid_t").groupBy("uid_e", "uid_t").agg(F.max("covered").alias("covered"))


def found(selected: DataFrame) -> DataFrame:
    return overlaps(selected).select(F.least("uid_e", "uid_t").alias("uid_a"), F.greatest("uid_e", "uid_t").alias("uid_b")).distinct()


def counts(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rooms and leaked rooms of each evaluation split and source."""
    name = F.lower(F.trim("split"))
    named = selected.where("uid is not null").select("uid", F.when(name == "dev", "validation").otherwise(name).alias("split"), F.expr("split_part(uid, ':', 1)").alias("uid_prefix")).distinct()
    placed = named.where("split in ('validation', 'test')").join(catalog.select("uid_prefix", "source"), "uid_prefix", "left")
    leaked = overlaps(selected).groupBy(F.col("uid_e").alias("uid")).agg(F.count_distinct("uid_t").alias("twins"))
    return placed.join(leaked, "uid", "left").groupBy("split", "source").agg(F.count_distinct("uid").alias("rooms"), F.count_distinct(F.when(F.col("twins").isNotNull(), F.col("uid"))).alias("leaked"), F.coalesce(F.sum("twins"), F.lit(0)).alias("pairs"))
