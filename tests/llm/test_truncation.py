"""Texts that lost their end."""

import hashlib
import random

from strataloom.llm import truncation as tr

SENTENCES = ["The desk stands along the north wall and leaves 0.75 m in front of it.", "We kept the lamp where the scan found it.", "Light comes from the west only, which is fine.", "The sofa sits approx. 1.2 m off the wall.", "Nobody had asked for a second chair."]


def test_forms():
    assert tr.open_json('{"a":[1,2') and tr.open_json('{"a":1}') is False and tr.open_json("plain") is None
    assert tr.open_markup("<p>x</p>") is False and tr.open_markup("<p>x") and tr.open_markup("<p>x</p>a &nb")
    assert tr.form(None) == "text" and tr.form('{"a":1}') == "whole"


def test_what_stands_behind(spark):
    texts = ["The des (more)", "The des [...]  ", "abc ...", "it is so…", "wh\ufffd", "  ", "one 12 two. Three", "第一句。第二", "0.7..."]
    rows = {r.digest: r for r in tr.shaped(spark.createDataFrame([(t, None) for t in texts], "text string, source string")).collect()}
    by = {t: rows[hashlib.sha256(t.encode()).hexdigest()] for t in texts}
    assert [(by[t].body, by[t].mark) for t in texts[:5]] == [("The des", "mark"), ("The des", "mark"), ("abc", "mark"), ("it is so…", "dots"), ("wh", "broken")]
    assert not by["abc ..."].stops and not by["it is so…"].stops and not by["0.7..."].stops and by["0.7..."].entry == "0.0"
    assert by["  "].shape == "blank" and by["it is so…"].entry == "it is so"
    last = by["one 12 two. Three"]
    assert (last.entry, last.word, last.before, last.marked) == ("Three", "Three", "", "one 0 two.\x01Three\x02")
    assert (by["第一句。第二"].entry, by["第一句。第二"].word, by["第一句。第二"].before) == ("第二", "二", "第")


def test_prefix_join_equals_brute_force(spark):
    pick = random.Random(7)
    held = list({("g" + str(i % 2), "".join(pick.choice("ab") for _ in range(pick.randrange(1, 40)))) for i in range(400)})
    asked = list({(g, u[: pick.randrange(1, len(u) + 1)]) for g, u in held[:150]}) + [("g1", "zz"), ("g1", "")]
    numbers = {k: (pick.randrange(3), pick.randrange(3), 0) for k in held}
    got = tr.prefix_joined(spark.createDataFrame(asked, "g string, unit string"), spark.createDataFrame([(*k, *v) for k, v in numbers.items()], "g string, unit string, ends long, mid long, low long"), ["g"]).collect()
    want = {(g, u): (*numbers.get((g, u), (0, 0, 0)), sum(sum(n[:2]) for (h, w), n in numbers.items() if h == g and w != u and w.startswith(u))) for g, u in set(asked) if u}
    assert {(r.g, r.unit): (r.ends, r.mid, r.low, r.longer) for r in got} == want


def corpus():
    pick = random.Random(2)
    rows, cut = [], set()
    for i in range(160):
        text = " ".join(pick.choice(SENTENCES) for _ in range(pick.randrange(2, 6))) + f" Sheet {i} is done."
        kind = i % 8
        if kind == 0:
            text = text[: len(text) // 2].rsplit(" ", 1)[0][:-1]
            if text[-1] in ".!?":
                text = text[:-2]
            cut.add(i)
        elif kind == 1:
            text += "\nStatus open"
        elif kind == 2:
            text += " Everything else is a matter of taste…"
        elif kind == 3:
            text = text[: text.index(" ") + 5] + " (more)"
            cut.add(i)
        elif kind == 4:
            text += " The sofa sits approx."
            cut.add(i)
        elif kind == 5:
            text = '{"id": %d, "size": [1, 2' % i if i % 16 == 5 else '{"id": %d}' % i
            cut |= {i} if i % 16 == 5 else set()
        rows.append((i, text, "notes", "en"))
    rows += [(500, rows[0][1], "notes", None), (501, None, "notes", None), (502, "   ", None, None), (None, "The des", "notes", None), (503, "x. " * 30_000 + "Done.", "long", None)]
    return rows, cut | {500}


def test_found(spark):
    rows, cut = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, word string")
    got = {r.doc_id for r in tr.found(docs).collect()}
    assert got == cut
    assert tr.found(docs.limit(0)).count() == 0
    rates = {r.source: (r.texts, r.cut_texts) for r in tr.rates(docs).collect()}
    assert rates["notes"] == (161, len(cut)) and rates["long"] == (1, 0)


def test_strict_prefixes(spark):
    pick = random.Random(3)
    texts = sorted({"".join(pick.choice("abc") for _ in range(pick.randrange(1, 7))) for _ in range(300)})
    want = {t for t in texts if any(u != t and u.startswith(t) for u in texts)}
    got = {r.body for r in tr.strict_prefixes(spark.createDataFrame([(t,) for t in texts], "body string")).collect()}
    assert got == want


def test_longer_copies(spark):
    pick = random.Random(5)
    bodies = ["".join(pick.choice("ab ") for _ in range(pick.randrange(1, 9))) for _ in range(80)] + ["x" * n for n in (63, 64, 65, 5000)] + ["Stop.", "Stop. On"]
    texts = [(i, b, b.endswith(".")) for i, b in enumerate(bodies)]
    got = {r.id for r in tr.longer_copies(spark.createDataFrame(texts, "id long, body string, stops boolean")).collect()}
    assert got == {i for i, b, s in texts if not s and any(o != b and o.startswith(b) for o in bodies)}
