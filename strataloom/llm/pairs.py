"""Defects of prompt and answer pairs.

Each answer is read once: thinking is set apart, a delimiter stack finds the complete and
the open JSON values, and what was found decides:

* ``truncated`` - thinking, or an answer, that was opened and not ended;
* ``empty`` - nothing that answers: blanks, placeholders, hollow JSON;
* ``refusal`` - an Aho-Corasick automaton over declining phrases in several languages;
* ``copied`` - a suffix automaton of the prompt, traversed with the answer: the share of
  the answer's tokens that lie in spans copied from the prompt;
* ``other_language`` - stopword and script votes of the free wording, or of the field
  names, against the language of the prompt.

A complete answer (of the prompt's kind, with content) in the right language has no defect,
whatever stands around it. The automaton is built over tokens (words, numbers), so
case, spacing, separators and JSON formatting don't matter; it is built only for answers that hold no
complete answer of their own, as no other can be a copy.

Scale: a narrow pass over the pairs; the one shuffle joins answers to their prompt by uid.
Whole texts are used. Defined cases: NULL answers are ``empty``; a NULL prompt copies nothing and counts
as English; unreadable prompts are plain text; repeated rows count once; where records of one id
differ, each distinct (id, defect) comes out; a NULL id gives no row.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.runtime import map_records

#: Share of an answer's tokens that must come from the prompt, in spans of at least SPAN tokens.
COPIED, SPAN = 0.8, 3

# Stopwords of each language.
STOPWORDS = {
    "en": "the and of to is in it that there with for on at by from this be are was has have not but as too while one should can cannot would could where which its more less little between stands reaches turns moving gives back way middle side past room what i my an or a",
    "de": "der die das und ist nicht ein eine einen einem einer mit von zu zum zur auf für im in den dem des es sich auch aber wird werden steht schaut bleibt zwischen mehr weniger nach bei bis an am aus über unter näher würde weg seite wand hat kann vor jetzt beide ragt links rechts dazu keine kein",
    "es": "el la los las un una y de del que en con por para no se es está más menos entre al lo su muy pero como hay queda mira sobre hacia hasta desde puede estorbaría habitación pared ventana junto mientras demasiado poco paso coloco van juntos cerca lado izquierdo izquierda",
    "fr": "le la les un une et de des du que qui en dans avec pour par pas ne se est au aux plus moins entre il elle son sa ses sur vers très mais comme reste regarde jusqu côté mur fenêtre je place contre trop peu serait gênerait passage près ce cette ensemble tant",
    "it": "il lo la i gli le un una e di del della che in con per non si è al alla più meno tra fra sta stanno restano rimane contro parete verso finestra ma come molto poco centro passaggio vicini vicino al",
    "pt": "o a os as um uma e de do da dos das que em no na com por para não se é ao mais menos entre está fica junto parede janela mas como muito pouco perto",
    "nl": "de het een en van in is niet met voor op aan te dat die er naar om bij tussen meer minder staat blijft muur raam maar ook wordt kan",
}
VOTES = {}
for _language, _words in STOPWORDS.items():
    for _word in set(_words.split()):
        VOTES.setdefault(_word, []).append(_language)

# Phrases that decline, casefolded, apostrophes straight.
REFUSALS = (
    "i can't help", "i cannot help", "i can not help", "i'm unable", "i am unable", "i'm not able", "i am not able", "i won't be", "i will not be", "i must decline", "i have to decline", "i decline",
    "as a language model", "as an ai", "falls outside of what i may", "outside of what i may do", "i must leave to a professional", "unable to comply", "can't comply", "cannot comply", "i can't assist", "i cannot assist",
    "i can't do that", "i cannot do that", "i'm sorry, but", "i am sorry, but", "i'd rather not", "i refuse", "not allowed to", "i can't provide", "i cannot provide", "can't fulfill", "cannot fulfill", "i can't give", "i cannot give",
    "es tut mir leid", "tut mir leid", "bedaure", "leider kann ich", "kann ich keine", "kann ich nicht", "darf ich nicht", "das kann ich", "muss ich ablehnen", "ich muss ablehnen", "als sprachmodell", "nicht in der lage", "möchte ich nicht", "lehne ich ab",
    "lo siento", "lamentablemente", "por desgracia", "disculpa", "negarme", "abstenerme", "no puedo", "no me es posible", "no estoy en condiciones", "debo rechazar", "tengo que rechazar", "como modelo de lenguaje", "no podré", "prefiero no", "no me está permitido", "me es imposible", "lo lamento",
    "je suis désolé", "désolé", "navré", "m'abstenir", "je regrette", "je ne peux pas", "je ne peux ni", "je ne suis pas en mesure", "je dois refuser", "je refuse", "en tant que modèle de langage", "malheureusement", "il m'est impossible", "je ne saurais", "je ne puis",
    "mi dispiace", "purtroppo non posso", "non posso", "desculpe", "não posso", "к сожалению", "не могу", "извините",
    "抱歉", "对不起", "遗憾", "无法", "超出了我", "不能提供", "我不能", "作为语言模型", "作为一个语言模型", "作为ai", "恕我", "不便", "拒绝",
)

_THINK = re.compile(r"\s*<think>(.*?)</think>", re.S)
_TOKEN = re.compile(r"[^\W\d_]+|\d+", re.U)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?", re.U)
_NAME = re.compile(r"\b\w*(?:_\w+|\d)\w*\b", re.A)
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_KANA = re.compile(r"[぀-ヿ]")
_HANGUL = re.compile(r"[가-힯]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_DELIMITER = re.compile(r'["\\{}\[\]]')
_ASIDE = re.compile(r"[\s​‌‍⁠﻿]+")
# Texts that stand in for an answer.
PLACEHOLDERS = {"", "n/a", "na", "none", "null", "nil", "-", "--", "—", "...", "…", ".", "?", "todo", "tbd", "[]", "{}", '""', "''", "undefined", "empty", "no answer", "(empty)", "n.a."}
#: Keys of the answers asked for.
ANSWER_KEYS = {"placer": ("placements",), "critic": ("scores", "edits")}
FREE_KEYS = ("reason", "note", "comment", "comments", "explanation", "summary", "text", "message", "error", "answer", "response")


class SuffixAutomaton:
    """All substrings of a token list, for the longest match that ends at each token of another."""

    def __init__(self, tokens):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for t in tokens:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, tokens, span):
        """Number of ``tokens`` in matches of at least ``span`` tokens."""
        state = size = total = upto = 0
        for i, t in enumerate(tokens, 1):
            while state and t not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if t in self.next[state]:
                state = self.next[state][t]
                size += 1
            else:
                size = 0
            if size >= span:
                total += i - max(upto, i - size)
                upto = i
        return total


def tokens_of(text):
    return [t.casefold() for t in _TOKEN.findall(text)]


def copied_share(prompt, text, span=SPAN):
    """Share of the tokens of ``text`` copied from ``prompt``; 0 for a text without tokens."""
    words = tokens_of(text)
    return SuffixAutomaton(tokens_of(prompt)).covered(words, min(span, len(words))) / len(words) if words else 0.0


def blocks(text):
    """(complete JSON spans, start of the first open one or None), by a stack of delimiters."""
    spans, stack, start, quoted, skip, quote_at = [], [], 0, False, -1, 0
    for m in _DELIMITER.finditer(text):
        c, at = m.group(), m.start()
        if at == skip:
            continue
        if quoted:
            if c == "\\":
                skip = at + 1
            elif c == '"':
                quoted = False
        elif c == '"':
            if stack:
                quoted, quote_at = True, at
        elif c in "{[":
            if not stack:
                start = at
            stack.append(c)
        elif c in "}]" and stack:
            if (stack[-1] == "{") == (c == "}"):
                stack.pop()
                if not stack:
                    spans.append((start, at + 1))
            else:
                return spans, start
    return spans, (start if stack else None)


def language_of(text):
    """Language by script, else by stopword votes; None where nothing speaks."""
    han, kana, hangul, cyrillic = (len(p.findall(text)) for p in (_HAN, _KANA, _HANGUL, _CYRILLIC))
    # a foreign word in a name doesn't make a text foreign: script letters must outweigh a third of the Latin words
    words = _WORD.findall(_NAME.sub(" ", text))
    latin = sum(w.isascii() or w[0] < "ʰ" for w in words)
    for name, letters in (("ja", kana * 3), ("zh", han), ("ko", hangul), ("ru", cyrillic / 3)):
        if letters > max(1, latin / 2):
            return name
    votes = {}
    for w in words:
        for piece in re.split("['’]", w.casefold()):
            for language in VOTES.get(piece, ()):
                votes[language] = votes.get(language, 0) + 1
    if not votes:
        return None
    best = max(votes.values())
    top = sorted(k for k, v in votes.items() if v == best)
    return "en" if "en" in top else top[0]


def strings_of(value, keys=None):
    """Texts under ``keys`` (all texts where None) at any depth."""
    stack, out = [(None, value)], []
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            stack.extend(v.items())
        elif isinstance(v, list):
            stack.extend((key, x) for x in v)
        elif isinstance(v, str) and (keys is None or key in keys):
            out.append(v)
    return out


def names_of(value):
    """All field names at any depth."""
    stack, out = [value], []
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            out.extend(v)
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
    return out


def hollow(value):
    """Whether a JSON value holds no content at all."""
    if isinstance(value, dict):
        return all(hollow(v) for v in value.values())
    if isinstance(value, list):
        return all(hollow(v) for v in value)
    return value is None or (isinstance(value, str) and _ASIDE.sub("", value).casefold() in PLACEHOLDERS)


def answers(kind, value):
    """Whether ``value`` is an answer of the kind asked for, with content."""
    if not isinstance(value, dict):
        return False
    if kind == "placer":
        placed = value.get("placements")
        return isinstance(placed, (list, dict)) and len(placed) > 0 and not hollow(placed)
    return isinstance(value.get("scores"), dict) and not hollow(value["scores"]) or (isinstance(value.get("edits"), list) and len(value["edits"]) > 0 and not hollow(value["edits"]))


def prose_of(text, spans):
    """Text outside the JSON spans, without fences."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return re.sub(r"```[A-Za-z]*", " ", "\n".join(out))


class Judge:
    """Names the defect of one answer, or None. One judge a task."""

    def __init__(self):
        import ahocorasick

        self.refusals = ahocorasick.Automaton()
        for phrase in REFUSALS:
            self.refusals.add_word(phrase, len(phrase))
        self.refusals.make_automaton()

    def declines(self, text):
        return next(self.refusals.iter(text.casefold().replace("’", "'")), None) is not None

    def defect(self, kind, prompt, text):
        if text is None or _ASIDE.sub("", text).casefold() in PLACEHOLDERS:
            return "empty"
        prompt = prompt or ""
        body, wanted = text, "en"
        thought = _THINK.match(body)
        if thought:
            body = body[thought.end() :]
        if body.lstrip().startswith("<think>"):
            return "truncated"
        if kind == "critic":
            wanted = language_of(prompt) or "en"
        try:
            value = json.loads(body)
            spans, opened = [(0, len(body))], None
            values = [value]
            if isinstance(value, str):
                return self.defect(kind, prompt, value) if value.strip() != body.strip() else None
        except (ValueError, RecursionError):
            spans, opened = blocks(body)
            values = []
            for a, b in spans:
                try:
                    values.append(json.loads(body[a:b]))
                except (ValueError, RecursionError):
                    values.append(None)
        found = [v for v in values if answers(kind, v)]
        prose = prose_of(body, spans) if opened is None else prose_of(body[:opened], [s for s in spans if s[1] <= opened])
        if found:
            foreign = self.foreign(kind, prompt, prose, found, wanted)
            return "other_language" if foreign else None
        return self.without_answer(kind, prompt, body, values, prose, opened, wanted)

    def foreign(self, kind, prompt, prose, values, wanted):
        """Free wording of a complete answer in another language than wanted."""
        prose = self.own_lines(prompt, prose)
        wording = " \n ".join([prose, *(s for v in values for s in strings_of(v, FREE_KEYS))])
        spoken = language_of(wording)
        return spoken is not None and spoken != wanted

    def own_lines(self, prompt, prose):
        """Lines that don't stand in the prompt."""
        given = {_ASIDE.sub("", line).casefold() for line in prompt.split("\n")}
        return "\n".join(line for line in prose.split("\n") if _ASIDE.sub("", line).casefold().lstrip(">") not in given)

    def without_answer(self, kind, prompt, body, values, prose, opened, wanted):
        tail = body[opened:] if opened is not None else ""
        begun = any(f'"{key}"' in tail for key in ANSWER_KEYS[kind])
        share = None
        if begun:
            return "truncated"
        if _ASIDE.sub("", re.sub(r"```[A-Za-z]*", "", body)).casefold() in PLACEHOLDERS or (opened is None and values and all(hollow(v) for v in values) and not _WORD.search(prose)):
            return "empty"
        said = " \n ".join([prose, *(s for v in values for s in strings_of(v))])
        share = copied_share(prompt, body)
        if share >= COPIED:
            return "copied"
        if self.declines(said) or (opened is not None and self.declines(tail)):
            return "refusal"
        if opened is not None:
            return "truncated"
        named = [v for v in values if isinstance(v, dict) and not hollow(v)]
        if named:
            # a full answer under field names of another language
            names = " ".join(re.sub("_", " ", n) for v in named for n in names_of(v))
            spoken = language_of(" ".join([prose, *(s for v in named for s in strings_of(v, FREE_KEYS))]))
            if kind == "placer" and not any(k in v for v in named for k in ("objects", "boundary", "request", "prompt", "error", "note")):
                return "other_language" if names.strip() else "empty"
            return "other_language" if spoken is not None and spoken != wanted else "empty"
        spoken = language_of(prose)
        if spoken is not None and spoken != wanted:
            return "other_language"
        return "truncated" if unfinished(prose) else "empty"


def unfinished(prose):
    """Prose that stops inside a sentence."""
    last = prose.rstrip()
    return bool(last) and last[-1] not in ".!?。！？…)\"'”»"


def judged(df: DataFrame) -> DataFrame:
    """(record_id, defect) of (record_id, kind, prompt, answer); defect is NULL for sound pairs."""

    def make():
        judge = Judge()
        return lambda r: [(r[0], judge.defect(r[1], r[2], r[3]))] if r[0] is not None else []

    return map_records(df.select("record_id", "kind", "prompt", "answer"), "record_id string, defect string", make)


def pairs(placer: DataFrame, rooms: DataFrame, stream: DataFrame) -> DataFrame:
    """(record_id, kind, prompt, answer, source) of placer answers and critic calls, each distinct pair once; an answer meets every distinct prompt of its uid."""
    requests = rooms.where("uid is not null").select("uid", F.col("request").alias("prompt")).distinct()
    given = placer.select(F.col("output_id").alias("record_id"), "uid", F.col("raw").alias("answer"), F.col("engine").alias("source")).distinct()
    placed = given.join(requests, "uid", "left").select("record_id", F.lit("placer").alias("kind"), "prompt", "answer", "source")
    called = stream.select(F.col("call_id").alias("record_id"), F.lit("critic").alias("kind"), "prompt", F.col("raw_final_text").alias("answer"), F.col("expected_model").alias("source")).distinct()
    return placed.unionByName(called)


def defects(placer: DataFrame, rooms: DataFrame, stream: DataFrame) -> DataFrame:
    return judged(pairs(placer, rooms, stream)).where("defect is not null").distinct()
