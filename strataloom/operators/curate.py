"""From raw rooms to released training rows: preparation with reasons and flags, rendering, scoring of answers.

Per room everything is a narrow pass. Across rooms only keys travel: a room's text is joined back by uid at the end.

Defined cases: see operators.rooms; a room delivered several times counts once, by the smallest text digest; a refused room keeps its reason and no text.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import geometry as G
from strataloom.functions import labels as L
from strataloom.functions.jsontext import elements, id_text, read_json
from strataloom.operators import rooms as R
from strataloom.operators.nested import own_id
from strataloom.runtime import map_records, spread

#: Metres by which floor boxes may be sunk; least area of a floor and of a hidden obstacle in square metres.
SUNK, AREA, HIDDEN = 0.30, 0.5, 0.5
#: Metres: boxes lower than this are coverings, structure higher than this doesn't shape the floor, band along the walls, thickest wall, too far outside; and the
#: square metres by which a part of a wall may stand in the room.
LOW, HIGH, BAND, THICK, FAR, INTRUSION = 0.15, 1.5, 0.10, 0.30, 0.5, 0.05
#: Fewest objects of a released room; there is no most.
LEAST_OBJECTS = 1
SYSTEM = "Place every listed object in the room. Answer with one JSON object that holds placements in the listed order."


def shown(x):
    """A number to two decimals; whole numbers without a point, no negative zero."""
    v = round(float(x), 2) + 0.0
    return int(v) if v == int(v) else v


def facts(value, room):
    """What the refusing rules look at."""
    meta = value.get("meta") if isinstance(value.get("meta"), dict) else {}
    inner = next((r.get("furniture") for _, r in elements(value.get("rooms")) if isinstance(r, dict)), None)
    named = [own_id(k, e) for k, e in elements(value.get("objects") or inner)]
    height = value.get("height")
    return {"meta": meta, "named": named, "room": room, "exported": "rooms" in value, "height": height, "ring": G.clean_ring(room["outline"]) if room["outline"] else None}


# Reasons of a refusal, in the order in which they are looked for.
REFUSALS = (
    ("front_unknown", lambda f: f["meta"].get("front_known") is not True),
    ("incomplete_objects", lambda f: bool(f["meta"].get("n_incomplete"))),
    ("duplicate_source_ids", lambda f: len(set(f["named"])) < len(f["named"])),
    ("boundary", lambda f: f["room"]["form"] not in ("polygon", "hull") and not f["exported"]),
    ("boundary_shape", lambda f: f["ring"] is None),
    ("bad_numbers", lambda f: f["height"] is not None and not (R.floats([f["height"]], 1) and f["height"] > 0)),
    ("bad_numbers", lambda f: len(f["room"]["objects"]) < len(f["named"])),
    ("object_count", lambda f: len(f["room"]["objects"]) < LEAST_OBJECTS),
    ("boundary_shape", lambda f: G.area(f["ring"]) < AREA),
)


def refused(value, room):
    """First reason that refuses a room, or None."""
    seen = facts(value, room)
    return next((reason for reason, holds in REFUSALS if holds(seen)), None)


def without(objects, dropped):
    """Objects without the dropped ones and all that rests on them."""
    gone = set(dropped)
    below: dict = {}
    for o in objects:
        below.setdefault(o["parent"], []).append(o["id"])
    queue = list(gone)
    for name in queue:
        more = [i for i in below.get(name, ()) if i not in gone]
        gone.update(more)
        queue.extend(more)
    return [o for o in objects if o["id"] not in gone]


def carried(objects):
    """Objects that stand on the floor, or on one that does."""
    by = {o["id"]: o for o in objects}
    good: dict = {}
    for o in objects:
        trail, at = [], o
        while at is not None and at["id"] not in good and at["id"] not in trail:
            trail.append(at["id"])
            at = by.get(at["parent"]) if at["anchor"] == "object" else None
        last = by[trail[-1]] if trail else None
        ends = good.get(at["id"], False) if at is not None else last is not None and last["anchor"] == "floor"
        good.update(dict.fromkeys(trail, ends))
    return [o for o in objects if good[o["id"]]]


def shown_structure(room, parts):
    """Parts of the building that are told as boxes: no finishes, soft hangings, high parts, slabs, or walls of the room itself."""
    ring, floor = room["outline"], G.area(room["outline"])
    for o in parts:
        if L.is_finish(o["kind"]) or L.holds(L.plain(o["kind"]).split(), "soft hanging") or o["z"] >= HIGH:
            continue
        if ring and o["w"] * o["d"] >= 0.8 * floor:
            continue
        own_wall = L.last_word(o["kind"]) == "wall" and (room["form"] == "hull" or not ring or G.area_away(R.ring_of(o), ring, BAND) < INTRUSION)
        if not own_wall:
            yield {**o, "what": "structure"}


def worth_showing(fixed, objects, room):
    """Fixed boxes that touch the room, aren't coverings or slabs, and aren't a second box of a placed object; cut at the floor where they are sunk."""
    ring, floor = room["outline"], G.area(room["outline"])
    rings = [(R.ring_of(o), o["z"], o["z"] + o["h"]) for o in objects]
    for f in fixed:
        top = f["z"] + f["h"]
        if top < LOW:
            continue
        if f["z"] < -R.FLOOR:
            f = {**f, "z": 0.0, "h": top}
        own = R.ring_of(f)
        size = G.area(own)
        reach = THICK if f["what"] == "structure" else BAND
        if size <= 0 or size >= 0.5 * floor or G.gap(own, ring) > reach:
            continue
        if f["what"] != "structure":
            over = [c for r, low, high in rings if min(top, high) - max(f["z"], low) > R.TOL for c in G.parts_within(r, [own])]
            if over and G.covered_area(over) >= 0.5 * size:
                continue
        yield f


def leaves_no_hole(o, room):
    """A box that may be left out without a hole in the layout: coverings, soft things, finishes, and openings that keep to the walls."""
    words = L.raw_words(o["kind"])
    if L.ends_as(o["kind"], "flat") or L.ends_as(o["kind"], "soft cover") or L.holds(words, "soft hanging") or L.is_finish(o["kind"]):
        return True
    stays = lambda: G.area_away(R.ring_of(o), room["outline"], BAND) < INTRUSION
    loose = not {"partition", "screen", "clothes"}.isdisjoint(words)
    if o["structure"]:
        return stays() if room["form"] == "polygon" else (L.holds(words, "flush") and not loose) or stays()
    if room["form"] == "polygon" and not stays():
        return False
    while len(words) > 1 and words[-1] in ("floor", "wall", "ceiling"):  # where it stands, not what it is
        words.pop()
    return bool(words) and L.is_structure(o["kind"]) and not loose and words[-1] in L.KINDS["flush"]


def hidden_area(room, left_out, objects, fixed):
    """Floor under boxes that were left out, in square metres, that no placed or fixed box explains."""
    parts = G.convex_parts(room["outline"])
    pieces = [c for o in left_out for c in G.parts_within(R.ring_of(o), parts)]
    if not pieces:
        return 0.0
    covers = [R.ring_of(o) for o in [*(o for o in objects if not o["parent"]), *fixed] if o["h"] >= LOW]
    explained = [c for r in covers for c in G.parts_within(r, pieces)]
    return max(0.0, G.covered_area(pieces) - (G.covered_area(explained) if explained else 0.0))


def prepared(room):
    """(room, flags): parts of the building shown as fixed, anchors inferred, boxes snapped to what carries them, the rest told as fixed or left out.

    Fixed boxes are tagged ``structure``, ``generic`` (labels that say nothing), ``wall``, ``floating`` or ``frontless``. Flags name what a reader of the room should know.
    """
    flags = set()
    parts = [o for o in room["objects"] if R.structural(o, room["source"])]
    names = {o["id"] for o in parts}
    rest = {**room, "objects": [o for o in room["objects"] if o["id"] not in names and not L.ends_as(o["kind"], "soft cover")]}
    anchors = {i: (a, p) for i, a, p, _ in R.anchored(rest)}
    every = [{**o, "anchor": anchors[o["id"]][0], "parent": anchors[o["id"]][1]} for o in rest["objects"]]
    objects = carried(every)
    generic = {o["id"] for o in objects if L.says_nothing(o["kind"])}
    objects = without(objects, generic | {o["id"] for o in objects if not o["parent"] and o["z"] < -SUNK})
    by = {o["id"]: o for o in objects}

    def unheld(o):
        parent = by.get(o["parent"])
        if parent is None:
            return True
        above = o["z"] - parent["z"] - parent["h"]
        floats = anchors[o["id"]] == ("object", o["parent"]) and above > R.TOL  # lowered onto it below
        return not (floats or abs(above) <= R.TOL + G.EPS) or G.box_distance((o["x"], o["y"]), parent["x"], parent["y"], parent["w"], parent["d"], parent["yaw"]) > R.TOL + G.EPS

    objects = without(objects, [o["id"] for o in objects if o["parent"] and unheld(o)])
    frontless = {o["id"] for o in objects if o["frontless"]}
    objects = without(objects, frontless)
    kept = {o["id"] for o in objects}

    def told(o):
        stands = -SUNK <= o["z"] <= R.FLOOR or o["anchor"] == "fixed" or o["id"] in frontless
        return o["id"] not in kept and not o["parent"] and o["h"] >= LOW and stands and not (L.hangs(o["kind"]) or L.is_art(o["kind"]))

    what = lambda o: "generic" if o["id"] in generic else "frontless" if o["id"] in frontless else "floating" if o["anchor"] == "fixed" else "wall"
    candidates = [*room["fixed"], *shown_structure(room, parts), *({**o, "what": what(o)} for o in every if told(o))]
    fixed = list(worth_showing([{"what": "structure", **f} for f in candidates], objects, room)) if room["outline"] else candidates
    shown_ids = kept | {f["id"] for f in fixed}
    resting = {o["id"] for o in every if o["parent"]}
    low = lambda o: o["z"] <= R.FLOOR and o["z"] + o["h"] >= LOW
    left_out = [o for o in room["objects"] if o["id"] not in shown_ids and o["id"] not in resting and low(o) and not (L.hangs(o["kind"]) or L.is_art(o["kind"])) and room["outline"] and not leaves_no_hole(o, room)]
    # heights: the floor, or the top of what carries an object; lowest first, so carriers are done before
    done: dict = {}
    snapped = []
    for o in sorted(objects, key=lambda o: (bool(o["parent"]), o["z"])):
        top = done[o["parent"]]["z"] + done[o["parent"]]["h"] if o["parent"] in done else 0.0
        if o["parent"] and o["z"] - by[o["parent"]]["z"] - by[o["parent"]]["h"] > R.TOL:
            flags.add("support_lowered")
        if not o["parent"] and abs(o["z"]) > R.FLOOR:
            flags.add("z_snapped")
        done[o["id"]] = {**o, "z": top}
        snapped.append(done[o["id"]])
    fixed = [{**f, "z": 0.0 if -R.FLOOR <= f["z"] <= R.FLOOR else f["z"]} for f in fixed]
    out = {**room, "objects": snapped, "fixed": fixed}
    _, wrong, _ = R.checked(out)
    floor = G.area(room["outline"]) if room["outline"] else 0.0
    if wrong["outside"] and room["outline"] and max(G.outside_by(p, room["outline"]) for o in snapped for p in R.ring_of(o)) > FAR:
        flags.add("oob_far")
    hidden = hidden_area(room, left_out, snapped, fixed)
    tall = lambda o: not o["parent"] and not L.ends_as(o["kind"], "flat") and o["h"] >= 0.5
    for flag, holds in (
        ("oob_objects", wrong["outside"]),
        ("fixed_collision", wrong["fixed_hits"]),
        ("overlapping_furniture", wrong["severe"]),
        ("hidden_obstacle", hidden >= HIDDEN),
        ("small_area", floor and floor < 1.0),
        ("room_filling_object", floor and any(tall(o) and o["w"] * o["d"] >= 0.8 * floor for o in snapped)),
        ("single_object", len(snapped) == 1),
        ("tilted", any(o["tilted"] for o in snapped)),
        ("front_fixed", frontless),
        ("height_dropped", room["height"] and any(o["z"] + o["h"] > room["height"] + R.TOL for o in snapped)),
    ):
        if holds:
            flags.add(flag)
    if "height_dropped" in flags:
        out["height"] = None
    return out, sorted(flags)


def in_order(room):
    """(part, box) of fixed boxes and objects in the order in which they are shown: by area, label, size and place."""
    rows = [("fixed", o) for o in room["fixed"]] + [("object", o) for o in room["objects"]]
    return sorted(rows, key=lambda r: (-round(r[1]["w"] * r[1]["d"], 6), r[1]["kind"], -r[1]["h"], r[1]["z"], r[1]["x"], r[1]["y"], r[1]["id"]))


def canonical(room):
    """Objects in the order shown, with ids slug_k over one namespace; parents follow."""
    order = in_order(room)
    seen: dict = {}
    names = {}
    for part, o in order:
        slug = "object" if L.says_nothing(o["kind"]) else L.plain(o["kind"]).replace(" ", "_")
        seen[slug] = seen.get(slug, 0) + 1
        names[part, o["id"]] = f"{slug}_{seen[slug]}"
    return {**room, "fixed": [{**o, "id": names[p, o["id"]]} for p, o in order if p == "fixed"], "objects": [{**o, "id": names[p, o["id"]], "parent": names.get(("object", o["parent"]))} for p, o in order if p == "object"]}


def rendered(room):
    """(user text, assistant text) of a canonical room."""
    place = lambda o: {"id": o["id"], **({"on": o["parent"]} if o.get("parent") else {}), "pos": [shown(o["x"]), shown(o["y"]), shown(o["z"])], "yaw": round(math.degrees(o["yaw"])) % 360}
    size = lambda o: [max(shown(v), 0.01) for v in (o["w"], o["d"], o["h"])]
    user = {"boundary_type": room["form"] or "polygon", "boundary": [[shown(x), shown(y)] for x, y in G.clean_ring(room["outline"])], "height": None if room["height"] is None else shown(room["height"]), "fixed": [{**place(o), "size": size(o)} for o in room["fixed"]], "objects": [{"id": o["id"], "size": size(o)} for o in room["objects"]]}
    dense = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return dense({k: v for k, v in user.items() if v not in (None, [])}), dense({"placements": [place(o) for o in room["objects"]]})


PREPARED = "uid string, source string, house string, reason string, flags array<string>, objects int, has_polygon boolean, layout_key string, content_key string, copy_key string, aliases array<string>, eval_only boolean, user string, assistant string"


def prepare(raw: DataFrame) -> DataFrame:
    """One row for each readable room of ``raw``."""

    def make():
        def act(record):
            source, uid, text = record
            value = read_json(text)
            room = R.read_room(text) if isinstance(value, dict) and uid is not None else None
            if room is None:
                return []
            meta = value.get("meta") if isinstance(value.get("meta"), dict) else {}
            aliases = [t for _, a in elements(meta.get("group_aliases") if not isinstance(meta.get("group_aliases"), str) else None) if (t := id_text(a))]
            house = id_text(value.get("group")) or uid
            reason = refused(value, room)
            if reason:
                return [(uid, source, house, reason, [], len(room["objects"]), bool(room["outline"]), None, None, None, aliases, bool(meta.get("eval_only")), None, None)]
            clean, flags = prepared(room)
            if not clean["objects"]:
                return [(uid, source, house, "object_count", flags, 0, True, None, None, None, aliases, bool(meta.get("eval_only")), None, None)]
            return [(uid, source, house, None, flags, len(clean["objects"]), True, *R.keys_of(clean), R.copy_key(clean), aliases, bool(meta.get("eval_only")), *rendered(canonical(clean)))]

        return act

    rows = map_records(spread(raw.select(*(F.col(c).cast("string") for c in ("source", "uid", "row")))), PREPARED, make, 512)
    # rooms delivered twice: the smallest digest of what came out
    names = [c for c in rows.columns if c != "uid"]
    return rows.groupBy("uid").agg(F.min_by(F.struct(*names), F.sha2(F.to_json(F.struct(*names)), 256)).alias("r")).select("uid", "r.*")


def placed_room(request, target, answer):
    """The room of a request with the sizes of its target, furnished as an answer says."""
    asked, given = read_json(request), read_json(target)
    room = R.read_request(asked)
    if not isinstance(asked, dict) or room is None or not isinstance(given, dict):
        return None
    sizes = {own_id(k, e): R.floats(e.get("size"), 3) for k, e in elements(given.get("placements")) if isinstance(e, dict)}
    kinds = {own_id(k, e): e.get("category") or "" for k, e in elements(asked.get("objects")) if isinstance(e, dict)}
    objects = []
    for k, e in elements(answer):
        name = own_id(k, e) if isinstance(e, dict) else None
        pos, yaw = (R.floats(e.get("pos"), 3), e.get("yaw")) if isinstance(e, dict) else (None, None)
        if sizes.get(name) and pos and isinstance(yaw, (int, float)):
            w, d, h = sizes[name]
            objects.append({"id": name, "kind": str(kinds.get(name, "")).lower(), "x": pos[0], "y": pos[1], "z": pos[2], "w": w, "d": d, "h": h, "yaw": math.radians(yaw), "anchor": None, "parent": id_text(e.get("on"))})
    return {**room, "objects": objects}


SCORES = "output_id string, uid string, state string, objects int, outside int, main int, fixed_hits int, unsupported int, overlap double, moved double, moved_matched double"


def scored(answers: DataFrame, rooms: DataFrame) -> DataFrame:
    """Checks of every distinct answer, and the mean distance of its objects from the target, as labelled and after matching like with like."""
    asked = rooms.where("uid is not null").select("uid", "request", "target").distinct()
    both = answers.select("output_id", "uid", "raw").distinct().join(asked, "uid").select("output_id", "uid", "raw", "request", "target")

    def make():
        def act(record):
            output_id, uid, raw, request, target = record
            value = read_json(request)
            wanted = [i for k, e in elements(value.get("objects")) if (i := own_id(k, e)) is not None] if isinstance(value, dict) else []
            state, _ = R.answer_state(raw, wanted)
            none = [(output_id, uid, state or "bad_json", None, None, None, None, None, None, None, None)]
            if state is not None or output_id is None:
                return none if output_id is not None else []
            body = raw.rsplit("</think>", 1)[-1]
            placements = json.JSONDecoder().raw_decode(body, body.find("{"))[0]["placements"]
            room = placed_room(request, target, placements)
            if room is None or not room["objects"]:
                return none
            n, wrong, share = R.checked(room)
            truth = {own_id(k, e): e["pos"] for k, e in elements(read_json(target).get("placements")) if isinstance(e, dict) and R.floats(e.get("pos"), 3)}
            mine = [o for o in room["objects"] if o["id"] in truth]
            far = [[math.hypot(a["x"] - truth[b["id"]][0], a["y"] - truth[b["id"]][1]) for b in mine] for a in mine]
            total = matched = 0.0
            groups: dict = {}
            for i, o in enumerate(mine):
                total += far[i][i]
                groups.setdefault((o["kind"], o["w"], o["d"], o["h"]), []).append(i)
            for same in groups.values():
                cost = [[far[i][j] for j in same] for i in same]
                matched += sum(cost[i][j] for i, j in enumerate(assignment(cost)))
            return [(output_id, uid, "scored", n, *(int(wrong[c]) for c in ("outside", "main", "fixed_hits", "unsupported")), share, round(total / len(mine), 6) if mine else None, round(matched / len(mine), 6) if mine else None)]

        return act

    return map_records(both, SCORES, make, 1024).distinct()


def assignment(cost):
    """Column of each row in the cheapest one-to-one assignment of a square table, by shortest augmenting paths."""
    n = len(cost)
    u, v, way, owner = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, done = [math.inf] * (n + 1), [False] * (n + 1)
        while owner[at]:
            done[at] = True
            row, delta, nxt = owner[at], math.inf, 0
            for j in range(1, n + 1):
                if not done[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, at
                    if least[j] < delta:
                        delta, nxt = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = nxt
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


# Operations of an edit and the fields each needs.
EDITS = {"move": ("x", "y"), "rotate": ("yaw_deg",), "face": ("target",), "against_wall": ()}


def edit_state(edit, ids):
    """State of one proposed edit: ok, or why it can't be applied."""
    if not isinstance(edit, dict):
        return "bad_item"
    if edit.get("op") not in EDITS:
        return "unknown_op"
    if edit.get("id") not in ids:
        return "unknown_id"
    for field in EDITS[edit["op"]]:
        v = edit.get(field)
        if field == "target":
            if v not in ids or v == edit["id"]:
                return "bad_target"
        elif not isinstance(v, (int, float)) or isinstance(v, bool) or not math.isfinite(v):
            return "bad_number"
    return "ok"


def edits(calls: DataFrame) -> DataFrame:
    """(call_id, at, op, object_id, state) of every edit in the answers of critic calls; ids are those listed in the prompt."""

    def make():
        def act(record):
            call_id, prompt, answer = record
            ids = {line.split(" | ")[0].strip() for line in (prompt or "").split("\n") if " | " in line}
            body = (answer or "").rsplit("</think>", 1)[-1]
            value = None
            at = body.find('{"')
            while at >= 0 and not (isinstance(value, dict) and "edits" in value):
                try:
                    value = json.JSONDecoder().raw_decode(body, at)[0]
                except (ValueError, RecursionError):
                    value = None
                at = body.find("{", at + 1)
            if isinstance(value, dict) and isinstance(value.get("edits"), list) and call_id is not None:
                for i, e in enumerate(value["edits"]):
                    yield call_id, i, e.get("op") if isinstance(e, dict) and isinstance(e.get("op"), str) else None, id_text(e.get("id")) if isinstance(e, dict) else None, edit_state(e, ids)

        return act

    return map_records(calls.select("call_id", "prompt", F.col("raw_final_text")).distinct(), "call_id string, at int, op string, object_id string, state string", make)


def perturbed(rooms: DataFrame, seed: int = 0) -> DataFrame:
    """A wrong variant of each target: one object, picked by digest, moved with everything that rests on it; (uid, object_id, moved, dx, dy)."""

    def make():
        def act(record):
            uid, target = record
            value = read_json(target)
            rows = [(own_id(k, e), e) for k, e in elements(value.get("placements"))] if isinstance(value, dict) else []
            rows = [(i, e) for i, e in rows if i is not None and isinstance(e, dict)]
            if uid is None or not rows:
                return []
            score = lambda *p: hashlib.sha256("\0".join(map(str, (seed, uid, *p))).encode()).hexdigest()
            first = min(rows, key=lambda r: score(r[0]))[0]
            above: dict = {}
            for i, e in rows:
                above.setdefault(id_text(e.get("on")), []).append(i)
            moved, queue = {first}, [first]
            for i in queue:
                for j in above.get(i, ()):
                    if j not in moved:
                        moved.add(j)
                        queue.append(j)
            angle = int(score("angle")[:8], 16) / 16**8 * 2 * math.pi
            far = 0.5 + int(score("far")[:8], 16) / 16**8
            return [(uid, first, sorted(moved), round(far * math.cos(angle), 2), round(far * math.sin(angle), 2))]

        return act

    return map_records(rooms.select("uid", "target"), "uid string, object_id string, moved array<string>, dx double, dy double", make).dropDuplicates(["uid"])


def augmented(raw: DataFrame, seed: int = 0) -> DataFrame:
    """Each room turned by a quarter and mirrored as its digest says; checks before and after must agree."""

    def act(uid, source, room):
        if not room["outline"]:
            return []
        score = int(hashlib.sha256(f"{seed}\0{uid}".encode()).hexdigest()[:8], 16)
        k, mirror = score % 4, score // 4 % 2

        def moved(boxes):
            ring, out = G.quarter(room["outline"], [(o["x"], o["y"], o["w"], o["d"], o["yaw"]) for o in boxes], k)
            return ring, [{**o, "x": -x if mirror else x, "y": y, "yaw": math.pi - yaw if mirror else yaw} for o, (x, y, _, _, yaw) in zip(boxes, out)]

        ring, objects = moved(room["objects"])
        ring = [(-x, y) for x, y in ring][::-1] if mirror else ring
        other = {**room, "outline": ring, "objects": objects, "fixed": moved(room["fixed"])[1]}
        a, b = R.checked(room)[1], R.checked(other)[1]
        return [(uid, k, bool(mirror), a == b)]

    return R.over_rooms(raw, "uid string, quarter int, mirrored boolean, same boolean", act).distinct()
