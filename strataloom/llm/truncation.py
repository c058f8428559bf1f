"""Texts that lost their end, found by self-joins on prefixes.

The end of a text is held against everything else that was written, at four levels. At each, the text's last unit is joined to all
longer units that start with it:

* ``value``: the whole text is a strict prefix of a longer text. Hashes of prefixes of 1, 2, 4, ... characters choose the
  texts that can meet; only those are sorted, and a strict prefix is then a prefix of its successor.
* ``entry``: the last entry (sentence, line, list or JSON member, markup piece) against all entries of its source.
* ``word`` and ``pair``: the last word, and the last word after the word before it, against all words and pairs of its source. Pairs
  are asked for only where the word alone is contested.

Units have their digits folded. For each unit four numbers are known: ``ends`` (texts and lines that end with it, the asked text itself
left out), ``mid`` (places where the line goes on behind it), ``low`` (where it goes on with a small letter or a digit) and ``longer`` (places
of units of which it is a strict prefix). A text is cut where its unit goes on elsewhere more often than it ends; a text that
closes with a full stop only where its unit is the start of longer ones or goes on with small letters (abbreviations). The longest level that has seen the unit
decides (an entry must have been seen twice besides), a tie goes to the next shorter one, and a unit nobody else wrote is no evidence of a loss. A longer
copy is no evidence where the last word or entry is a known ending.

A second kind of evidence stands beside the prefixes and is labelled as such: ``open`` (JSON by a delimiter stack, markup by its open elements) and ``broken``
(a broken character at the end). ``evidence`` names the level that decided. Something put behind a cut (dots, "(more)") is set apart first;
dots stay where other texts end in the same entry with dots, unless it ends inside a number.

Scale: texts are moved once, to fold repeats. Units are counted with partial sums, so a unit written everywhere is one row a task. A prefix join
emits for a unit of n characters n/32 + 3 pieces, folded by sums before any of them meets an asked unit: the rows of a hot prefix are its different continuations of
at most 32 characters, whatever its number of copies.

Defined cases: NULL and blank texts are no cases; repeated texts share one verdict, each doc_id comes out;
a NULL source is a source of its own; a doc_id that is NULL gives no row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataloom.runtime import as_batch, cut, shuffle_width, spread

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>")
#: What is put behind a cut, and dots that may be meant.
MARK = r"(?i)(?:\s*(?:\[\s*(?:\.\.\.|…|truncated|cut|more|continued|snip)\s*\]|\(\s*(?:\.\.\.|…|truncated|cut|more|continued)\s*\)|<\s*(?:truncated|cut)\s*>|(?<=\s)(?:\.\.\.|…)|(?:read|show|see) more(?:\.\.\.|…)?))+\s*$"
DOTS = r"(?:\.\.\.+|…)$"
STOP = r"[.!?。！？][\"'”’»)\]]*$|>$"
BLANKS = " \t\n\r\x0b\x0c 　"
#: Characters at the end in which a mark is looked for.
MARK_SPAN = 200
#: Last signs of an entry with what parts it from the next one; a tag opens an entry of its own.
BORDER = r"([.!?,。！？>{}\[])(?:(?<=[.!?])[\"')»”]?[^\S\n]+|(?<=[。！？>])(?!\n|$)|(?<=[,{}\[])(?=[\"{])|(?<=,)[^\S\n]+(?=\"))"
SIGN = r"([　-ヿ㐀-鿿＀-￯])"
#: Words after which any word may stand: they say nothing about the next one.
OPENING = r"[.!?:。！？：，>-]$"
#: Prefixes are joined by pieces of 1, 4, 16, 32, 64, 96, ... characters.
STEP = 32


def open_json(body):
    """True or False for a JSON text that is open or whole, None for other text."""
    if body[:1] not in "{[" or not re.match(r"\{\s*(\"|\}|$)|\[\s*[\[{\"\d\]-]", body):
        return None
    try:
        json.loads(body)
        return False
    except (ValueError, RecursionError):
        pass
    depth = quoted = escaped = 0
    for c in body:
        if escaped:
            escaped = 0
        elif quoted:
            if c == "\\":
                escaped = 1
            elif c == '"':
                quoted = 0
        elif c == '"':
            quoted = 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return bool(quoted or depth > 0)


def open_markup(body):
    """Whether an element or a tag is left open; void elements don't count."""
    if "<" not in body:
        return False
    if re.search(r"<[/A-Za-z][^<>\n]{0,40}$|&[A-Za-z#0-9]{0,7}$", body):
        return True
    depth = Counter()
    for slash, name in _TAG.findall(body):
        if name.lower() not in ("br", "hr", "img", "p/"):
            depth[name.lower()] += -1 if slash else 1
    return any(v > 0 for v in depth.values())


def form(body):
    """``open`` or ``whole`` where brackets or elements tell, otherwise ``text``."""
    if body is None:
        return "text"
    json_open = open_json(body)
    return ("open" if json_open else "whole") if json_open is not None else "open" if open_markup(body) else "text"


def shaped(documents: DataFrame) -> DataFrame:
    """One row for each distinct (source, text): body, what stood behind it, form, the entries as one marked text, and the last entry and words.

    In ``marked`` sign 1 parts the entries; sign 2 before it tells that a line ends there, and sign 5 at the end that the text was marked as cut.
    """
    one = spread(documents.where("text is not null").select(F.coalesce("source", F.lit("")).alias("source"), "text")).withColumn("digest", F.sha2("text", 256)).groupBy("source", "digest").agg(F.first("text").alias("text"))
    text = one.withColumn("text", F.rtrim("text", F.lit(BLANKS))).withColumn("end", F.expr(f"right(text, {MARK_SPAN})"))
    text = text.withColumn("put", F.when(F.expr("right(text, 1)").rlike(r"[\])>.…eE]"), F.length(F.regexp_extract("end", MARK, 0))).otherwise(0))
    text = text.withColumn("mark", F.when(F.col("text").endswith("�"), "broken").when(F.col("put") > 0, "mark").when(F.col("text").endswith("…") | F.col("text").endswith("..."), "dots").otherwise(""))
    body = F.when(F.col("mark") == "broken", F.rtrim("text", F.lit(BLANKS + "�"))).when(F.col("mark") == "mark", F.rtrim(F.expr("left(text, length(text) - put)"), F.lit(BLANKS))).otherwise(F.col("text"))
    text = text.select("source", "digest", "mark", body.alias("body"))
    forms = F.pandas_udf(lambda s: pd.Series([form(b) for b in s]), "string")
    brackets = F.col("body").startswith("{") | F.col("body").startswith("[") | F.col("body").contains("<")
    text = text.withColumn("shape", F.when(F.col("body") == "", F.when(F.col("mark") == "", "blank").otherwise("open")).otherwise(forms(F.when(brackets, F.col("body")))))
    plain = F.when(F.col("mark") == "dots", F.regexp_replace("body", DOTS, "")).otherwise(F.col("body"))
    marked = F.replace(F.regexp_replace(plain, "[0-9]+", "0"), F.lit("<"), F.lit("\x01<"))
    text = text.withColumn("stops", F.right(plain, F.lit(16)).rlike(STOP))  # dots that may be meant are no full stop
    text = text.withColumn("marked", F.replace(F.regexp_replace(marked, BORDER, "$1\x01"), F.lit("\n"), F.lit("\x02\x01")))
    text = text.withColumn("entry", F.ltrim(F.element_at(F.split("marked", "\x01"), -1)))
    text = text.withColumn("words", words_of(F.col("entry")))
    last = lambda i: F.coalesce(F.try_element_at("words", F.lit(i)), F.lit(""))
    ended = F.concat("marked", F.when(F.col("mark") == "", "\x02").otherwise("\x05"))
    return text.select("source", "digest", "body", "mark", "shape", ended.alias("marked"), "entry", last(-1).alias("word"), last(-2).alias("before"), "stops")


def words_of(entry: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(entry, SIGN, " $1 ")), r"\s+")


def small(name: str) -> Column:
    """Whether a text begins with a small letter or a digit."""
    c = F.expr(f"left({name}, 1)")
    return c.between("a", "z") | c.between("0", "9") | ((c > "\x7f") & (F.lower(c) == c) & (F.upper(c) != c))


def counted_entries(texts: DataFrame) -> DataFrame:
    """(source, unit, ends, mid, low) of every distinct entry."""
    next_sign = "left(ltrim(get(a, i + 1)), 1)"
    entries = texts.select("source", F.split("marked", "\x01").alias("a")).select("source", F.expr(f"inline(transform(a, (e, i) -> struct(ltrim(e) as e, {next_sign} as then)))"))
    ended = F.col("e").endswith("\x02")
    kept = entries.where(~F.col("e").endswith("\x05")).select("source", F.rtrim(F.col("e"), F.lit(" \t\r\x02")).alias("unit"), ended.alias("ended"), (~ended & small("then")).alias("low"))
    count = lambda c: F.sum(c.cast("long"))
    return kept.where("unit <> ''").groupBy("source", "unit").agg(count(F.col("ended")).alias("ends"), count(~F.col("ended")).alias("mid"), count(F.col("low")).alias("low"))


def word_places(entries: DataFrame) -> DataFrame:
    """(source, before, unit, ends, mid, low): the words of counted entries; inside an entry the next word tells how it goes on."""
    n = F.col("ends") + F.col("mid")
    split = entries.select("source", "ends", "mid", "low", n.alias("n"), words_of(F.col("unit")).alias("w"))
    shifted = split.select("source", "ends", "mid", "low", "n", F.expr("concat(array(''), slice(w, 1, size(w) - 1))").alias("before"), F.col("w").alias("unit"), F.expr("slice(w, 2, size(w))").alias("next"))
    places = shifted.select("source", "ends", "mid", "low", "n", F.inline(F.arrays_zip("before", "unit", "next"))).where("unit <> ''")
    inside = F.col("next").isNotNull()
    return places.select(
        "source", "before", "unit",
        F.when(inside, 0).otherwise(F.col("ends")).alias("ends"),
        F.when(inside, F.col("n")).otherwise(F.col("mid")).alias("mid"),
        F.when(~inside, F.col("low")).when(small("next"), F.col("n")).otherwise(0).alias("low"),
    )


def summed(places: DataFrame, *by: str) -> DataFrame:
    return places.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("ends", "mid", "low")))


def prefix_joined(asked: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """``asked`` units with their own numbers and ``longer``: the places of all held units that start with them and are longer.

    ``on`` are the columns that must agree besides the prefix. A piece length P is the greatest of 1, 4, 16, 32, 64, ... within the asked unit; hashes of
    prefixes of P characters meet, the rest is compared exactly.
    """
    size = F.length("unit")
    p = F.when(size >= STEP, size - size % STEP).when(size >= 16, 16).when(size >= 4, 4).otherwise(1)
    key = F.xxhash64(*on, "p", F.expr("substring(unit, 1, p)"))
    asked = asked.where("unit <> ''").select(*on, "unit").distinct()
    wanted = asked.withColumn("p", p).groupBy(key.alias("key")).agg(F.collect_set(size).alias("sizes"))
    # level i stands for pieces of 1, 4, 16, 32, 64, ... characters that are shorter than the unit
    top = F.when(size > 16, 2 + (size - 1 - (size - 1) % STEP) / STEP).when(size > 4, 1).otherwise(0).cast("int")
    levels = held.where("length(unit) > 1").select(*on, "unit", (F.col("ends") + F.col("mid")).alias("n"), F.explode(F.sequence(F.lit(0), top)).alias("i"))
    at = lambda i: F.when(i == 0, 1).when(i == 1, 4).when(i == 2, 16).otherwise((i - 2) * STEP)
    pieces = levels.select(*on, at(F.col("i")).alias("p"), F.substring(F.col("unit"), F.lit(1), at(F.col("i") + 1)).alias("unit"), "n")
    folded = pieces.groupBy(*on, "p", "unit").agg(F.sum("n").alias("n")).withColumn("key", key)
    met = folded.join(wanted.hint("shuffle_hash"), "key").select(*on, "unit", "n", F.explode(F.expr("filter(sizes, s -> s < length(unit))")).alias("s"))
    longer = met.select(*on, F.expr("substring(unit, 1, s)").alias("unit"), "n").groupBy(*on, "unit").agg(F.sum("n").alias("longer"))
    own = held.select(*on, "unit", "ends", "mid", "low", F.lit(0).cast("long").alias("longer"), F.lit(False).alias("asks"))
    none = F.lit(0).cast("long")
    both = own.unionByName(longer.select(*on, "unit", none.alias("ends"), none.alias("mid"), none.alias("low"), "longer", F.lit(False).alias("asks"))).unionByName(asked.select(*on, "unit", none.alias("ends"), none.alias("mid"), none.alias("low"), none.alias("longer"), F.lit(True).alias("asks")))
    return both.groupBy(*on, "unit").agg(*(F.sum(c).alias(c) for c in ("ends", "mid", "low", "longer")), F.max("asks").alias("asks")).where("asks").drop("asks")


def strict_prefixes(bodies: DataFrame) -> DataFrame:
    """(body, goes_on) of each body that is a strict prefix of another: what the next longer one goes on with."""
    schema = T.StructType().add("part", T.IntegerType()).add("body", T.StringType()).add("next", T.StringType()).add("first", T.BooleanType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part, before, opened = TaskContext.get().partitionId(), None, False
        for batch in batches:
            out = []
            for body in batch.column(0).to_pylist():
                if before is not None and body != before and body.startswith(before):
                    out.append((part, before, body[len(before) : len(before) + 8], False))
                if not opened:
                    out.append((part, body, None, True))
                    opened = True
                before = body
            if out:
                yield as_batch(out, arrow)
        if before is not None:
            yield as_batch([(part, before, None, False)], arrow)

    ordered = bodies.select("body").repartitionByRange(shuffle_width(bodies.sparkSession), "body").sortWithinPartitions("body")
    seen = cut(ordered.mapInArrow(run, schema))
    inside = seen.where("next is not null").select("body", F.col("next").alias("goes_on"))
    # two rows a part: the last text of a part is held against the first of the next part that has any
    edges = seen.where("next is null").withColumn("then", F.lead("body").over(Window.orderBy("part", F.col("first").desc())))
    across = edges.where("not first and startswith(then, body) and then <> body").select("body", F.expr("substring(then, length(body) + 1, 8)").alias("goes_on"))
    return inside.union(across).groupBy("body").agg(F.min("goes_on").alias("goes_on"))


def longer_copies(texts: DataFrame) -> DataFrame:
    """(id, goes_on) of texts without a full stop that are strict prefixes of longer texts of any source."""
    sized = texts.where("body <> ''").select("id", "stops", F.length("body").alias("n"), "body").withColumn("top", F.floor(F.log2("n")).cast("int"))
    asked = sized.where("not stops").select("id", "n", "top", F.xxhash64("top", F.expr("substring(body, 1, shiftleft(1, top))")).alias("key"))
    wanted = asked.groupBy("key").agg(F.min("n").alias("least"))
    hashes = F.expr("transform(sequence(0, top), i -> struct(i, xxhash64(i, substring(body, 1, shiftleft(1, i))) as key))")
    held = sized.select("id", "n", F.inline(hashes))
    # longer texts whose prefix meets that of an asked one; of them twice the length of that prefix is compared
    longer = cut(held.join(wanted.hint("shuffle_hash"), "key").where("n > least").select("id", "key", F.expr("shiftleft(2, i)").alias("take")))
    met = asked.join(longer.select("key").distinct(), "key", "left_semi").select("id", F.col("n").alias("take"), F.lit(True).alias("asks"))
    taken = longer.groupBy("id", "take").agg(F.lit(False).alias("asks")).unionByName(met)
    pieces = cut(taken.join(texts.select("id", "body"), "id").select("id", "asks", F.expr("substring(body, 1, take)").alias("body")))
    copies = strict_prefixes(pieces.select("body").distinct())
    return pieces.where("asks").join(copies, "body").select("id", "goes_on")


def verdicts(documents: DataFrame) -> DataFrame:
    """(source, digest, cut, evidence, mark, shape, goes_on) of every distinct text."""
    texts = cut(shaped(documents).withColumn("id", F.monotonically_increasing_id()))  # the ids are kept with the rows
    entries = cut(counted_entries(texts))
    ends = texts.where("shape <> 'blank'").select("id", "source", "digest", "mark", "shape", "entry", "word", "before", "stops")
    dotted = texts.where("mark = 'dots'").groupBy("source", "entry").agg(F.count(F.lit(1)).alias("dotted"))
    by_entry = prefix_joined(ends.select("source", F.col("entry").alias("unit")), entries, ["source"])
    places = cut(summed(word_places(entries), "source", "before", "unit"))
    by_word = prefix_joined(ends.select("source", F.col("word").alias("unit")), summed(places, "source", "unit"), ["source"])
    named = lambda df, unit, to: df.select("source", F.col("unit").alias(unit), F.struct("ends", "mid", "low", "longer").alias(to))
    one = ends.join(named(by_entry, "entry", "e"), ["source", "entry"], "left").join(named(by_word, "word", "w"), ["source", "word"], "left").join(dotted, ["source", "entry"], "left")
    one = cut(one.withColumn("by_entry", says("e", 2)).withColumn("by_word", says("w")))
    # the pair is asked where the entry says nothing and the word is contested: more than one in twenty places speaks against the others
    contested = F.col("by_entry").isNull() & ~F.col("before").rlike(OPENING) & (F.col("before") != "") & (F.col("word") != "") & disputed("w")
    open_pairs = one.where(contested).select("source", "before", F.col("word").alias("unit")).distinct()
    near = places.join(open_pairs.select("source", "before").distinct(), ["source", "before"], "left_semi")
    by_pair = prefix_joined(open_pairs, near, ["source", "before"])
    pairs = by_pair.select("source", "before", F.col("unit").alias("word"), F.struct("ends", "mid", "low", "longer").alias("p"), F.lit(True).alias("paired"))
    two = one.withColumn("contested", contested).join(pairs, ["source", "before", "word"], "left").withColumn("by_pair", F.when(F.col("contested"), says("p")))
    two = two.join(longer_copies(texts), "id", "left")
    e_ends = F.coalesce(F.col("e.ends"), F.lit(0)) - F.when(F.col("mark") == "", 1).otherwise(0)
    value = F.col("goes_on").isNotNull() & ~F.col("goes_on").startswith("\n") & ~F.col("stops") & (e_ends <= 0) & F.coalesce(F.col("by_word"), F.lit(True))
    on_purpose = (F.col("mark") == "dots") & (F.col("dotted") > 1) & ~F.col("entry").rlike("[0-9]$") & (F.col("dotted") - 1 > F.coalesce(F.col("e.mid"), F.lit(0)) + F.coalesce(F.col("e.longer"), F.lit(0)))
    level = F.when(value, "value").when(F.col("by_entry").isNotNull(), "entry").when(F.col("by_pair").isNotNull(), "pair").when(F.col("by_word").isNotNull(), "word")
    prefix = F.coalesce(F.when(value, True), F.col("by_entry"), F.col("by_pair"), F.col("by_word"), F.lit(False))
    is_cut = F.when((F.col("mark") == "broken") | (F.col("shape") == "open"), True).when((F.col("shape") == "whole") | on_purpose, False).otherwise(prefix)
    evidence = F.when(~is_cut, None).when(prefix, level).when(F.col("shape") == "open", "open").when(F.col("mark") == "broken", "broken")
    return two.select("source", "digest", is_cut.alias("cut"), evidence.alias("evidence"), "mark", "shape", "goes_on")


def says(numbers: str, least: int = 1) -> Column:
    """True (cut), False (whole) or NULL (a tie, or seen less than ``least`` times) of one level; the text's own ending doesn't count."""
    of = lambda c: F.coalesce(F.col(f"{numbers}.{c}"), F.lit(0))
    ends = F.greatest(of("ends") - F.when(F.col("mark") == "", 1).otherwise(0), F.lit(0))
    on = of("mid") + of("longer")
    closed = F.when((of("longer") > ends + of("mid")) | ((of("mid") >= 2) & (of("low") > 0.5 * of("mid"))), True).when(ends + of("mid") > 0, False)
    return F.when(on + ends < least, None).when(F.col("stops"), closed).when(on > ends, True).when(on < ends, False)


def disputed(numbers: str) -> Column:
    """Whether more than one in twenty of the places of a unit speaks against the verdict of the others."""
    of = lambda c: F.coalesce(F.col(f"{numbers}.{c}"), F.lit(0))
    on, every = of("mid") + of("longer"), of("ends") + of("mid") + of("longer")
    closed = 20 * (of("longer") + of("low")) > every
    return F.when(F.col("stops"), closed).otherwise(20 * F.least(on, of("ends")) > every)


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, evidence, ...) of every document with a text."""
    ids = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.sha2("text", 256).alias("digest"))
    return ids.join(verdicts(documents), ["source", "digest"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of every document whose text was cut."""
    return judged(documents).where("cut").select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """Texts and cut texts of each source."""
    return judged(documents).groupBy("source").agg(F.count_distinct("doc_id").alias("texts"), F.count_distinct(F.when(F.col("cut"), F.col("doc_id"))).alias("cut_texts")).withColumn("rate", F.round(F.col("cut_texts") / F.col("texts"), 6))


def evidence(documents: DataFrame) -> DataFrame:
    """Cut texts of each source by the level or form that told."""
    return judged(documents).where("cut").groupBy("source", "evidence").agg(F.count_distinct("doc_id").alias("cut_texts"))
