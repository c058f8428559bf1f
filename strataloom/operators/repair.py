"""Repair of placed rooms by moves on the floor, and edits of a critic carried out.

A move takes an object with everything that rests on it; sizes, turns and heights never change. A move is kept only if less of one kind and more of no kind is wrong around the moved unit, so a room never gets
worse, and a room without a problem that a move solves comes out as it was: repairing twice changes nothing more.

Defined cases: see operators.rooms; rooms without problems are ``unchanged``, rooms left without any are ``ok``, others ``partial``; the search ends after TRIALS moves tried in a room, which the
row tells (``trials``).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import geometry as G
from strataloom.functions import labels as L
from strataloom.functions.jsontext import elements, id_text, read_json
from strataloom.operators import rooms as R
from strataloom.operators.curate import EDITS, edit_state
from strataloom.operators.nested import own_id
from strataloom.runtime import map_records, shuffle_width, spread

#: Moves tried in a room, metres added to a push.
TRIALS, MARGIN = 400, 0.005
#: Shifts in metres tried last, nearest first.
GRID = sorted(((dx * 0.1, dy * 0.1) for dx in range(-4, 5) for dy in range(-4, 5) if dx or dy), key=lambda d: (math.hypot(*d), d))
#: Bound of a shift of the grid along an axis, with room for rounding.
FARTHEST = max(max(map(abs, d)) for d in GRID) + 1e-3
#: What can be wrong around an object, gravest first.
WRONG = ("severe", "main", "fixed_hits", "outside", "unsupported")


class Scene:
    """A room under repair: boxes, their rings, and which boxes rest on which."""

    def __init__(self, room):
        self.room = room
        self.boxes = {o["id"]: dict(o) for o in room["objects"]}
        self.rings = {i: R.ring_of(o) for i, o in self.boxes.items()}
        self.fixed = [(f, R.ring_of(f)) for f in room["fixed"]]
        self.outline = room["outline"] if room["form"] in ("polygon", "hull") else []
        self.above: dict = {}
        for o in self.boxes.values():
            self.above.setdefault(o["parent"], []).append(o["id"])

    def unit(self, start):
        """An object and all that rests on it."""
        out = [start]
        for i in out:
            out.extend(j for j in self.above.get(i, ()) if j not in out)
        return out

    def shift(self, unit, dx, dy):
        for i in unit:
            o = self.boxes[i]
            o["x"], o["y"] = round(o["x"] + dx, 6), round(o["y"] + dy, 6)
            self.rings[i] = R.ring_of(o)


def quick_area(ring, other):
    """Area common to two convex counter-clockwise rings; geometry.shared_area in one pass, equal up to rounding."""
    ax, ay = other[-1]
    for bx, by in other:
        ux, uy, out = bx - ax, by - ay, []
        px, py = ring[-1]
        s = ux * (py - ay) - uy * (px - ax)
        for q in ring:
            qx, qy = q
            t = ux * (qy - ay) - uy * (qx - ax)
            if (s > 0 > t) or (s < 0 < t):
                k = s / (s - t)
                out.append((px + k * (qx - px), py + k * (qy - py)))
            if t >= 0:
                out.append(q)
            px, py, s = qx, qy, t
        if len(out) < 3:
            return 0.0
        ring, ax, ay = out, bx, by
    x0, y0 = ring[0]
    px, py, twice = 0.0, 0.0, 0.0
    for x, y in ring:
        x, y = x - x0, y - y0
        twice += px * y - x * py
        px, py = x, y
    return abs(twice) / 2


class Search(Scene):
    """A scene that remembers what is wrong with each object and judges a move only by what the moved unit can meet.

    Sizes, turns, heights and supports never change, so what can meet at all is told once. Areas are first found quickly; those within rounding of a bound are found
    again by geometry's own steps. A move is given up at the first count that gets worse.
    """

    def __init__(self, room):
        super().__init__(room)
        boxes, self.shapes = self.boxes, {}
        spans = [abs(v) for o in [*boxes.values(), *room["fixed"]] for v in (o["x"], o["y"], o["w"], o["d"])]
        widest = 1 + max(spans, default=0.0)
        self.close = 1e-9 * widest * widest
        for i, o in boxes.items():
            self.shapes[i] = self.shape(o)
        self.walls = [(f, r, self.shape(f)) for f, r in self.fixed]
        thick = [i for i, o in boxes.items() if not R.is_thin(o)]
        roles = {o["kind"]: R.roles(o["kind"]) for o in boxes.values()}
        #: What each object may collide with, and what else a collision can be than a main one.
        self.near = {i: [] for i in boxes}
        for n, i in enumerate(thick):
            o = boxes[i]
            for j in thick[n + 1 :]:
                q = boxes[j]
                if o["parent"] == j or q["parent"] == i or not R.tall_overlap(o, q) > R.TOL or self.tucked(roles[o["kind"]], roles[q["kind"]]):
                    continue
                held, holds, alike = self.else_than_main(o, q)
                self.near[i].append((j, (held, holds, alike) if held or holds else None))
                self.near[j].append((i, (holds, held, alike) if held or holds else None))
        self.stuck = {i: [w for w in self.walls if R.tall_overlap(boxes[i], w[0]) > R.TOL] for i in thick}
        xs, ys = [p[0] for p in self.outline], [p[1] for p in self.outline]
        self.frame = (min(xs), min(ys), max(xs), max(ys)) if self.outline else None
        self.sides = [(*a, *b) for a, b in G.edges(self.outline)]
        self.square = len(self.outline) == 4 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in G.edges(self.outline)) and len(set(self.outline)) == 4
        self.rests = {i: self.resting(o) for i, o in boxes.items()}
        self.units: dict = {}
        #: Where everything stood that the grid depended on when it was last tried in vain for the unit of an object.
        self.vain: dict = {}
        self.met: dict = {i: {} for i in boxes}
        self.hit: dict = {}
        self.out: dict = {}
        self.loose: dict = {}
        self.note(list(boxes))

    @staticmethod
    def shape(o):
        """(half width and depth of the bounds, corners about the middle, bounds are the ring, area)."""
        c, s = math.cos(o["yaw"]), math.sin(o["yaw"])
        a, b = o["w"] / 2, o["d"] / 2
        turned = [(c * u, s * v, s * u, c * v) for u, v in ((a, b), (-a, b), (-a, -b), (a, -b))]
        return abs(c) * a + abs(s) * b, abs(s) * a + abs(c) * b, turned, min(abs(c), abs(s)) < 1e-12, o["w"] * o["d"]

    @staticmethod
    def tucked(a, b):
        return any((x in a and y in b) or (y in a and x in b) for x, y in map(tuple, R.TUCKED))

    def else_than_main(self, o, q):
        """(q may hold o, o may hold q, a rule before that may apply); boxes alike in area never hold each other."""
        a, b = o["w"] * o["d"], q["w"] * q["d"]
        if min(a, b) > 0.8 * max(a, b) + self.close:
            return False, False, False
        fits = lambda small, big: small["z"] + small["h"] <= big["z"] + big["h"] + R.TOL and small["w"] * small["d"] <= (big["w"] + 2 * R.TOL) * (big["d"] + 2 * R.TOL) + self.close
        return fits(o, q), fits(q, o), min(a, b) >= 0.8 * max(a, b) - self.close or L.plain(o["kind"]) == L.plain(q["kind"])

    def resting(self, o):
        """Whether a box hangs, or where that depends on the place: (box below, cosine and sine of its turn)."""
        p = self.boxes.get(o["parent"]) if o["parent"] else None
        if o["parent"] is not None and p is None or not abs(o["z"] - (p["z"] + p["h"] if p else 0.0)) <= R.TOL + G.EPS:
            return True
        return (p, math.cos(p["yaw"]), math.sin(p["yaw"])) if p else False

    def unit(self, start):
        if start not in self.units:
            self.units[start] = super().unit(start)
        return self.units[start]

    def setting(self, unit, around):
        """All that moves of a unit depend on and that can change: places of its objects, of neighbours that they can meet and of what they rest on."""
        places = [(self.boxes[i]["x"], self.boxes[i]["y"]) for i in unit]
        below = [(rest[0]["x"], rest[0]["y"]) for i in unit if isinstance(rest := self.rests[i], tuple)]
        return places, below, [sorted((n[4], n[0], n[2]) for n in around[i]) for i in unit]

    def ring_at(self, i, x, y):
        return [(x + a - b, y + c + d) for a, b, c, d in self.shapes[i][2]]

    def common(self, shape, x, y, ring, other, ox, oy, oring):
        """Shared area of two boxes, 0 where it is surely not more than SHARED."""
        hx, hy, gx, gy = shape[0], shape[1], other[0], other[1]
        wide = min(x + hx, ox + gx) - max(x - hx, ox - gx)
        if not wide > 0:
            return 0.0
        deep = min(y + hy, oy + gy) - max(y - hy, oy - gy)
        if not (deep > 0 and wide * deep > R.SHARED - self.close):
            return 0.0
        area = wide * deep if shape[3] and other[3] else quick_area(ring, oring)
        return area if abs(area - R.SHARED) > self.close else G.shared_area(ring, oring)

    def meets(self, i, x, y, ring, j, other_ways):
        """How an object at a place collides with another: None, False for mainly, True for severely."""
        q, shape, other = self.boxes[j], self.shapes[i], self.shapes[j]
        area = self.common(shape, x, y, ring, other, q["x"], q["y"], self.rings[j])
        if not area > R.SHARED or other_ways and not self.main(self.boxes[i], x, y, q, ring, self.rings[j], *other_ways):
            return None
        most = 0.3 * min(shape[4], other[4])
        if abs(area - most) > self.close:
            return area > most
        return G.shared_area(ring, self.rings[j]) > 0.3 * min(G.area(ring), G.area(self.rings[j]))

    @staticmethod
    def main(o, x, y, q, ring, other, held, holds, alike):
        """Whether a collision is a main one, after rooms.collision without what can't be; pairs that tuck in are never near."""
        if alike:
            return R.collision({**o, "x": x, "y": y}, q, ring, other) == "main"
        return not (held and R.encloses(q, ring, o["z"] + o["h"]) or holds and R.encloses({**o, "x": x, "y": y}, other, q["z"] + q["h"]))

    def hits(self, i, x, y, ring):
        return [r for f, r, shape in self.stuck.get(i, ()) if self.common(self.shapes[i], x, y, ring, shape, f["x"], f["y"], r) > R.SHARED]

    def leaves(self, ring):
        if not self.outline:
            return False
        x0, y0, x1, y1 = self.frame
        most = R.OUT + G.EPS
        far = most + self.close
        for x, y in ring:
            if x < x0 - far or x > x1 + far or y < y0 - far or y > y1 + far:
                return True
            if self.square and (x0 < x < x1 and y0 < y < y1 or math.hypot(max(x0 - x, x - x1, 0.0), max(y0 - y, y - y1, 0.0)) < most - self.close):
                continue
            odd = False
            for ax, ay, bx, by in self.sides:
                if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                    odd = not odd
            if not odd and all(G.point_segment((x, y), a, b) > most for a, b in G.edges(self.outline)):
                return True
        return False

    def hangs(self, i, x, y, places):
        rest = self.rests[i]
        if rest is True or rest is False:
            return rest
        p, c, s = rest
        px, py = places.get(p["id"]) or (p["x"], p["y"])
        u, v = c * (x - px) + s * (y - py), -s * (x - px) + c * (y - py)
        return not math.hypot(max(abs(u) - p["w"] / 2, 0.0), max(abs(v) - p["d"] / 2, 0.0)) <= R.TOL + G.EPS

    def note(self, ids):
        """Find anew what is wrong with objects that moved."""
        for i in ids:
            o, ring, (hx, hy, *_) = self.boxes[i], self.rings[i], self.shapes[i]
            for j, ways in self.near[i]:
                q, (gx, gy, *_) = self.boxes[j], self.shapes[j]
                if abs(o["x"] - q["x"]) > hx + gx + self.close or abs(o["y"] - q["y"]) > hy + gy + self.close:
                    self.met[i].pop(j, None)
                    self.met[j].pop(i, None)
                    continue
                for a, b, at in ((i, j, o), (j, i, q)):
                    state = self.meets(a, at["x"], at["y"], self.rings[a], b, ways if a == i else ways and (ways[1], ways[0], ways[2]))
                    if state is None:
                        self.met[a].pop(b, None)
                    else:
                        self.met[a][b] = state
            self.hit[i], self.out[i], self.loose[i] = self.hits(i, o["x"], o["y"], ring), self.leaves(ring), self.hangs(i, o["x"], o["y"], {})

    def wrong(self, unit):
        """Counts of what is wrong around a unit, gravest first; pairs inside the unit can't change."""
        held = set(unit)
        across = [severe for i in unit for j, severe in self.met[i].items() if j not in held]
        return (sum(across), len(across), sum(len(self.hit[i]) for i in unit), sum(self.out[i] for i in unit), sum(self.loose[i] for i in unit))

    def around(self, unit):
        """Neighbours outside a unit: (bounds, id, what else a collision can be) for each of its objects."""
        held, out = set(unit), {}
        for i in unit:
            out[i] = []
            for j, ways in self.near[i]:
                if j not in held:
                    q, (gx, gy, *_) = self.boxes[j], self.shapes[j]
                    out[i].append((q["x"] - gx, q["x"] + gx, q["y"] - gy, q["y"] + gy, j, ways))
        return out

    def within(self, around, reach):
        """Neighbours that a unit can meet by moves of at most ``reach`` along each axis."""
        out = {}
        for i, held in around.items():
            o, (hx, hy, *_) = self.boxes[i], self.shapes[i]
            x0, x1, y0, y1 = o["x"] - hx - reach, o["x"] + hx + reach, o["y"] - hy - reach, o["y"] + hy + reach
            out[i] = [n for n in held if n[0] <= x1 and n[1] >= x0 and n[2] <= y1 and n[3] >= y0]
        return out

    def better(self, unit, around, now, dx, dy):
        """Whether a move makes fewer of one kind and more of none wrong. The neighbour at which it gets worse is asked first next time."""
        places = {i: (round(self.boxes[i]["x"] + dx, 6), round(self.boxes[i]["y"] + dy, 6)) for i in unit}
        severe, main, hits, out, loose = now
        for i, (x, y) in places.items():
            loose -= self.hangs(i, x, y, places)
        if loose < 0:
            return False
        rings, least, surely = {}, R.SHARED - self.close, R.SHARED + self.close
        if self.outline:
            x0, y0, x1, y1 = self.frame
            for i, (x, y) in places.items():
                hx, hy = self.shapes[i][:2]
                if not (self.square and x - hx > x0 and x + hx < x1 and y - hy > y0 and y + hy < y1):
                    rings[i] = self.ring_at(i, x, y)
                    out -= self.leaves(rings[i])
                    if out < 0:
                        return False
        for i, (x, y) in places.items():
            hx, hy, _, level, size = self.shapes[i]
            x0, x1, y0, y1 = x - hx, x + hx, y - hy, y + hy
            for n, (a0, a1, b0, b1, j, ways) in enumerate(around[i]):
                wide = (x1 if x1 < a1 else a1) - (x0 if x0 > a0 else a0)
                if wide > 0:
                    deep = (y1 if y1 < b1 else b1) - (y0 if y0 > b0 else b0)
                    if deep > 0 and (box := wide * deep) > least:
                        other = self.shapes[j]
                        most = 0.3 * min(size, other[4])
                        if level and other[3] and not ways and box > surely and abs(box - most) > self.close:
                            state = box > most  # as meets has it, without rings
                        else:
                            if i not in rings:
                                rings[i] = self.ring_at(i, x, y)
                            state = self.meets(i, x, y, rings[i], j, ways)
                        if state is not None:
                            severe -= state
                            main -= 1
                            if severe < 0 or main < 0:
                                around[i].insert(0, around[i].pop(n))
                                return False
        for i, (x, y) in places.items():
            if self.stuck.get(i):
                hits -= len(self.hits(i, x, y, rings.get(i) or self.ring_at(i, x, y)))
                if hits < 0:
                    return False
        return severe + main + hits + out + loose > 0

    def problems(self):
        """(kind, id, ring to get away from or None), gravest first."""
        out = []
        for i, o in self.boxes.items():
            out.extend(((0 if severe else 1), i, self.rings[j]) for j, severe in self.met[i].items())
            out.extend((2, i, r) for r in self.hit[i])
            if self.out[i]:
                out.append((3, i, None))
            if o["parent"] and self.loose[i]:
                out.append((4, i, None))
        return sorted(out, key=lambda p: (p[0], p[1], p[2] or []))

    def pushes(self, kind, i, other):
        """Moves that may solve a problem, shortest first, then the grid."""
        ring, out = self.rings[i], []
        bounds = lambda r: (min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r))
        a = bounds(ring)
        if other is not None:
            b = bounds(other)
            out = [(b[0] - a[2] - MARGIN, 0.0), (b[2] - a[0] + MARGIN, 0.0), (0.0, b[1] - a[3] - MARGIN), (0.0, b[3] - a[1] + MARGIN)]
        elif kind == 3:
            b = bounds(self.outline)
            out = [(max(0.0, b[0] - a[0]) + min(0.0, b[2] - a[2]), max(0.0, b[1] - a[1]) + min(0.0, b[3] - a[3]))]
            sides = [e for e in G.edges(self.outline) if e[0] != e[1]]  # a repeated point is no side to come in from
            for p in ring:
                if sides and G.outside_by(p, self.outline) > R.OUT:
                    (ax, ay), (bx, by) = min(sides, key=lambda e: G.point_segment(p, *e))
                    length = math.hypot(bx - ax, by - ay)
                    far = G.point_segment(p, (ax, ay), (bx, by))
                    side = 1.0 if G.signed_area(self.outline) > 0 else -1.0
                    out.append((-side * (by - ay) / length * far, side * (bx - ax) / length * far))
        else:
            p, o = self.boxes.get(self.boxes[i]["parent"]), self.boxes[i]
            if p is not None:
                out = [((p["x"] - o["x"]) * k, (p["y"] - o["y"]) * k) for k in (0.25, 0.5, 0.75, 1.0)]
        return sorted((m for m in out if m != (0.0, 0.0)), key=lambda m: math.hypot(*m)) + GRID


def repaired(room):
    """(objects, before, after, trials, moved): the room after moves that each made something better."""
    scene = Search(room)
    ids = list(scene.boxes)
    total = lambda: tuple(sum(v) for v in zip(*(scene.wrong([i]) for i in ids))) if ids else (0,) * len(WRONG)
    before, trials, moved = total(), 0, {}
    progress = True
    while progress and trials < TRIALS:
        progress = False
        for kind, i, other in scene.problems():
            carrier = scene.boxes[i]["parent"]
            for start in [i] + ([carrier] if carrier in scene.boxes and kind != 4 else []):
                unit = scene.unit(start)
                now = scene.wrong(unit)
                if not now[kind] or trials >= TRIALS:
                    continue
                pushes = scene.pushes(kind, i, other)
                if not any(now[:4]) and now[4] == sum(scene.rests[j] is True for j in unit):  # only wrong in height, which no move changes
                    trials = min(trials + len(pushes), TRIALS)
                    continue
                around = scene.around(unit)
                for n, (dx, dy) in enumerate(pushes):
                    if trials >= TRIALS:
                        break
                    if len(pushes) - n == len(GRID):
                        around = scene.within(around, FARTHEST)
                        if scene.vain.get(start) == (setting := scene.setting(unit, around)):
                            trials = min(trials + len(GRID), TRIALS)
                            break
                    trials += 1
                    if scene.better(unit, around, now, dx, dy):
                        progress = True
                        scene.shift(unit, dx, dy)
                        scene.note(unit)
                        for j in unit:
                            x, y = moved.get(j, (0.0, 0.0))
                            moved[j] = (x + dx, y + dy)
                        break
                else:
                    scene.vain[start] = setting
                if progress:
                    break
            if progress or trials >= TRIALS:
                break
    return [scene.boxes[i] for i in ids], before, total(), trials, moved


def status_of(before, after, moved):
    return "unchanged" if not moved else "ok" if not any(after) else "partial"


def furnished(request, target):
    """The room of a request, furnished as its target says."""
    asked, told = read_json(request), read_json(target)
    room = R.read_request(asked) if isinstance(asked, dict) else None
    if room is None or not isinstance(told, dict):
        return None
    kinds = {own_id(k, e): e.get("category") for k, e in elements(asked.get("objects")) if isinstance(e, dict)}
    placed = []
    for k, e in elements(told.get("placements")):
        if isinstance(e, dict) and (name := own_id(k, e)) in kinds:
            yaw = e.get("yaw")
            placed.append({**e, "id": name, "category": kinds[name], "parent": id_text(e.get("on")), "yaw": math.radians(R.real(yaw)) if isinstance(yaw, (int, float)) else None})
    return {**room, "objects": R.read_boxes(placed)}


REPAIRED = "uid string, status string, objects int, moved int, farthest double, trials int, " + ", ".join(f"before_{w} int, after_{w} int" for w in WRONG)


def repair_rooms(rooms: DataFrame) -> DataFrame:
    """One row for each distinct room: what was wrong before and after its repair."""

    def make():
        def act(record):
            uid, request, target = record
            room = furnished(request, target) if uid is not None else None
            if room is None:
                return []
            _, before, after, trials, moved = repaired(room)
            far = max((math.hypot(*m) for m in moved.values()), default=0.0)
            return [(uid, status_of(before, after, moved), len(room["objects"]), len(moved), round(far, 4), trials, *(v for pair in zip(before, after) for v in pair))]

        return act

    cores = rooms.sparkSession.sparkContext.defaultParallelism
    parts = rooms.select("uid", "request", "target").where("uid is not null").repartition(max(shuffle_width(rooms.sparkSession), 4 * cores), "uid")
    return map_records(parts.distinct(), REPAIRED, make, 256)


_LINE = re.compile(r"^(\S+) \| ([\d.]+)x([\d.]+)x([\d.]+) \| (-?[\d.]+),(-?[\d.]+),(-?[\d.]+) \| (-?[\d.]+)")
_SIZE = re.compile(r"([\d.]+) x ([\d.]+) m")


def prompted(prompt):
    """The room that a critic's prompt lists, or None."""
    objects = [{"id": m[1], "category": re.sub(r"_\d+$", "", m[1]).replace("_", " "), "size": [float(m[i]) for i in (2, 3, 4)], "pos": [float(m[i]) for i in (5, 6, 7)], "yaw": math.radians(float(m[8]))} for line in (prompt or "").split("\n") if (m := _LINE.match(line))]
    size = _SIZE.search(prompt or "")
    if not objects or not size:
        return None
    w, d = float(size[1]), float(size[2])
    return R.read_room({"boundary": [[0, 0], [w, 0], [w, d], [0, d]], "boundary_type": "polygon", "objects": objects})


def edited(room, edits):
    """(room, edits carried out): edits in their order; those that can't be carried out are passed over."""
    scene, done = Scene(room), 0
    for e in edits:
        if edit_state(e, set(scene.boxes)) != "ok":
            continue
        o = scene.boxes[id_text(e["id"])]
        x, y, yaw = o["x"], o["y"], o["yaw"]
        if e["op"] == "move":
            x, y = float(e["x"]), float(e["y"])
        elif e["op"] == "rotate":
            yaw = math.radians(float(e["yaw_deg"]))
        elif e["op"] == "face":
            t = scene.boxes[id_text(e["target"])]
            yaw = math.atan2(t["y"] - y, t["x"] - x)
        elif scene.outline:  # the back to the nearest side
            (ax, ay), (bx, by) = min(G.edges(G.counter_clockwise(scene.outline)), key=lambda s: G.point_segment((x, y), *s))
            length = math.hypot(bx - ax, by - ay)
            nx, ny = -(by - ay) / length, (bx - ax) / length
            yaw = math.atan2(ny, nx)
            gap = (x - ax) * nx + (y - ay) * ny - o["w"] / 2
            x, y = x - gap * nx, y - gap * ny
        o["yaw"] = yaw % (2 * math.pi)
        scene.shift(scene.unit(o["id"]), x - o["x"], y - o["y"])
        done += 1
    return {**room, "objects": list(scene.boxes.values())}, done


def edit_rooms(calls: DataFrame) -> DataFrame:
    """(call_id, edits, applied, before, after): edits carried out on the room of the prompt, with what is wrong before and after."""
    import json

    def make():
        def act(record):
            call_id, prompt, answer = record
            room = prompted(prompt)
            body = (answer or "").rsplit("</think>", 1)[-1]
            value, at = None, body.find("{")
            while at >= 0 and not (isinstance(value, dict) and isinstance(value.get("edits"), list)):
                try:
                    value = json.JSONDecoder().raw_decode(body, at)[0]
                except (ValueError, RecursionError):
                    value = None
                at = body.find("{", at + 1)
            if call_id is None or room is None or not isinstance(value, dict) or not isinstance(value.get("edits"), list):
                return []
            out, done = edited(room, value["edits"])
            count = lambda r: sum(R.checked(r)[1][k] for k in ("outside", "main", "fixed_hits"))
            return [(call_id, len(value["edits"]), done, int(count(room)), int(count(out)))]

        return act

    return map_records(spread(calls.select("call_id", "prompt", F.col("raw_final_text")).distinct()), "call_id string, edits int, applied int, before int, after int", make, 256)


def sizes_enforced(placements, sizes, fixed=None):
    """(placements, counts): returned sizes dropped, and what rests on something set on its top under the sizes asked for.

    ``sizes`` holds the size of each object asked for, ``fixed`` (bottom, size) of boxes that stay. Heights that can't be told (unknown support, circles) stay as they are.
    """
    fixed = fixed or {}
    out = [{k: v for k, v in p.items() if k != "size"} for p in placements]
    returned = [p for p in placements if "size" in p]
    same = lambda a, b: R.floats(a, 3) is not None and b is not None and all(abs(x - y) <= 1e-6 for x, y in zip(a, b))
    counts = {"objects": len(out), "size_returned": len(returned), "size_changed": sum(not same(p["size"], sizes.get(p.get("id"))) for p in returned), "z_changed": 0}
    by = {p["id"]: p for p in out if p.get("id") in sizes and R.floats(p.get("pos"), 3)}
    known: dict = {}

    def bottom(name):
        """Bottom of a box after the boxes below it; None where it can't be told."""
        trail = []
        while name in by and name not in known and "on" in by[name] and name not in trail:
            trail.append(name)
            name = by[name]["on"]
        z = None if name in trail else known[name] if name in known else fixed[name][0] if name in fixed else by[name]["pos"][2] if name in by else None
        below = sizes.get(name) or (fixed[name][1] if name in fixed else None)
        for n in reversed(trail):
            z = z + below[2] if z is not None and below else None
            known[n], below = z, sizes.get(n)
        return z

    for name, p in by.items():
        if "on" in p and (z := bottom(name)) is not None and abs(z - p["pos"][2]) > 1e-9:
            counts["z_changed"] += abs(z - p["pos"][2]) > 1e-6
            p["pos"] = [*p["pos"][:2], z]
    return out, counts


def door_zones(room, depth=0.9, side=0.1):
    """(id, corners, middle) of the strip that each door needs free: along its side of the outline, ``depth`` inwards."""
    ring = G.counter_clockwise(room["outline"])
    out = []
    for f in room["fixed"]:
        if not ring or not L.holds(L.plain(f["kind"]).split(), "door"):
            continue
        a, b = min(G.edges(ring), key=lambda e: G.point_segment((f["x"], f["y"]), *e))
        length = math.hypot(b[0] - a[0], b[1] - a[1])
        ux, uy = (b[0] - a[0]) / length, (b[1] - a[1]) / length
        at = min(max((f["x"] - a[0]) * ux + (f["y"] - a[1]) * uy, 0.0), length)
        c, s = math.cos(f["yaw"]), math.sin(f["yaw"])
        half = (abs(f["w"] * (ux * c + uy * s)) + abs(f["d"] * (uy * c - ux * s))) / 2 + side
        low, high = max(at - half, 0.0), min(at + half, length)
        spot = lambda along, into, a=a, ux=ux, uy=uy: (a[0] + ux * along - uy * into, a[1] + uy * along + ux * into)
        out.append((f["id"], [spot(low, 0.0), spot(high, 0.0), spot(high, depth), spot(low, depth)], spot(at, depth / 2)))
    return out


def blocked_doors(room):
    """Doors whose strip a placed box stands in."""
    return [name for name, zone, _ in door_zones(room) if any(not R.is_thin(o) and o["z"] < 1.8 and G.shared_area(R.ring_of(o), zone) > R.SHARED for o in room["objects"])]


def wall_side(o, ring, tolerance=0.15):
    """The side (+X, -X, +Y, -Y) of a box whose middle lies nearest to the outline, within the tolerance; None where none does."""
    c, s = math.cos(o["yaw"]), math.sin(o["yaw"])
    sides = {"+X": (o["w"] / 2, 0), "-X": (-o["w"] / 2, 0), "+Y": (0, o["d"] / 2), "-Y": (0, -o["d"] / 2)}
    far = {k: G.point_line((o["x"] + c * u - s * v, o["y"] + s * u + c * v), ring) for k, (u, v) in sides.items()}
    best = min(far, key=far.get)
    return best if far[best] < tolerance else None


def door_rooms(rooms: DataFrame) -> DataFrame:
    """(uid, doors, blocked, backs): doors of each room, those that are blocked, and boxes with a side at a wall."""

    def make():
        def act(record):
            uid, request, target = record
            room = furnished(request, target) if uid is not None else None
            if room is None or not room["outline"]:
                return []
            return [(uid, len(door_zones(room)), len(blocked_doors(room)), sum(wall_side(o, room["outline"]) is not None for o in room["objects"]))]

        return act

    return map_records(spread(rooms.select("uid", "request", "target").distinct()), "uid string, doors int, blocked int, backs int", make, 256)
