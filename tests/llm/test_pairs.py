"""Defects of answers."""

import json
import random

from strataloom.llm.pairs import Judge, SuffixAutomaton, copied_share, defects, language_of

ROOM = json.dumps({"room_type": "study", "boundary": [[0, 0], [4.5, 0], [4.5, 3.1], [0, 3.1]], "objects": [{"id": "desk_1", "category": "desk"}, {"id": "lamp_1", "category": "lamp"}]})
GOOD = json.dumps({"placements": [{"id": "desk_1", "pos": [1, 2, 0], "yaw": 0}, {"id": "lamp_1", "on": "desk_1", "pos": [1, 2, 0.7], "yaw": 90}]})


def placer(text):
    return Judge().defect("placer", ROOM, text)


def test_automaton_covers_like_brute_force():
    pick = random.Random(1)
    for _ in range(200):
        a, b = ([pick.choice("xyz") for _ in range(pick.randrange(1, 14))] for _ in range(2))
        span = pick.randrange(1, 4)
        marked = set()
        for i in range(len(b)):
            for j in range(i + span, len(b) + 1):
                if any(a[k : k + j - i] == b[i:j] for k in range(len(a))):
                    marked.update(range(i, j))
        assert SuffixAutomaton(a).covered(b, span) == len(marked)


def test_sound_answers():
    for text in (GOOD, f"<think>\n\n</think>\n{GOOD}", f"```json\n{GOOD}\n```", f"{GOOD}\nI could not find a better corner for the desk_1.", f"{GOOD}\nnote {{x}}", f"{ROOM}\n{GOOD}", json.dumps({"request": json.loads(ROOM), **json.loads(GOOD)})):
        assert placer(text) is None, text


def test_defects_of_placer_answers():
    assert placer(None) == placer("  \n") == placer("​") == placer("{}") == placer("null") == placer('""') == placer("N/A") == placer("<think></think>") == placer("```json\n```") == "empty"
    assert placer(GOOD[:60]) == placer("```json\n" + GOOD[:-9]) == placer("<think>The desk sits by the") == placer("{") == "truncated"
    assert placer("I'm sorry, but I can't help with arranging this room.") == placer('{"error":"As a language model I am unable to comply."}') == placer('{"placements":null,"note":"I have to decline here."}') == "refusal"
    assert placer(ROOM) == placer("The room is:\n" + ROOM) == placer(json.dumps(json.loads(ROOM), indent=1, sort_keys=True)) == placer(json.dumps({"request": json.loads(ROOM)})) == "copied"
    assert placer("Al centro rimane un passaggio di 1.01 m. La sedia sta contro la parete.\n" + GOOD) == "other_language"
    assert placer('{"摆放":[{"编号":"床 1","位置":[3,1,0],"角度":270}]}') == placer("中间留出1.14米的通道。冰箱放在电视柜旁边。") == "other_language"


def test_critic_languages():
    german = "Prüfe den Raum und schlage höchstens 2 Änderungen vor.\ndesk_1 | 1x1x1"
    answer = lambda reason: json.dumps({"scores": {"layout": 3}, "edits": [{"id": "desk_1", "reason": reason}]})
    judge = Judge()
    assert judge.defect("critic", german, answer("der Tisch steht zu nah an der Wand")) is None
    assert judge.defect("critic", german, answer("the desk is too close to the wall")) == "other_language"
    assert judge.defect("critic", german, '{"scores":{"layout":3},"edits":[]}') is None
    assert judge.defect("critic", german, "Es tut mir leid, aber dabei kann ich nicht helfen.") == "refusal"
    assert judge.defect("critic", german, german) == "copied"
    assert judge.defect("critic", german, german + "\n" + answer("der Tisch")) is None
    assert language_of("把cabinet_2移近窗户会让走道更宽敞") == "zh" and language_of("12 3.4") is None


def test_long_text_is_read_whole():
    words = " ".join(f"w{i}x" for i in range(20_000))
    assert copied_share(words, words) == 1.0


def test_table(spark):
    placed = spark.createDataFrame([("o1", "u1", None, "e", 1), ("o1", "u1", None, "e", 1), ("o2", "u1", GOOD, "e", 1), ("o3", "none", ROOM, "e", 1), ("o4", "u1", ROOM, None, 1), (None, "u1", "", "e", 1)], "output_id string, uid string, raw string, engine string, prompt int")
    rooms = spark.createDataFrame([("u1", ROOM), ("u1", ROOM), (None, ROOM)], "uid string, request string")
    calls = spark.createDataFrame([("c1", "Review the room and name changes.", "", "m")], "call_id string, prompt string, raw_final_text string, expected_model string")
    got = {tuple(r) for r in defects(placed, rooms, calls).collect()}
    assert {("o1", "empty"), ("o4", "copied"), ("c1", "empty")} <= got and not any(r[0] in ("o2", None) for r in got)
    assert defects(placed.limit(0), rooms.limit(0), calls.limit(0)).count() == 0
