"""Defective prompt and response pairs, by ordered rules over the pair's texts.

Question is the last user message of the prompt, answer the last assistant message of the response. The
rules, in their order: emptiness; refusals in many languages, by the build of their sentences (``refusals``); the copied
question; unclosed delimiters and abrupt endings; another language or script. ``defects`` gives every rule that
triggers, ``first_defects`` the first one of each pair.

Defined results: a null or empty message list has no message; null messages, and messages of null
role, are passed over; without a question only the rules on the answer alone apply; content that is JSON
text of a part, or of a list of parts and strings, stands for their texts joined; rows repeated
under one trace_id count once; whole texts are read, of any length; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.wire import flatten
from tracelode.llm.refusals import refuses as only_declines

EMPTY, REFUSAL, COPY, TRUNCATED, LANGUAGE = "empty", "refusal", "copy", "truncated", "language"
ORDER = [EMPTY, REFUSAL, COPY, TRUNCATED, LANGUAGE]

_ROLES = {"user": {"user", "human"}, "assistant": {"assistant", "model"}}
_INVISIBLE = {"\u200b", "\ufeff"}


def seen(text: str | None) -> bool:
    """Whether a text has a character that is neither white space nor zero-width."""
    return bool(text) and any(not c.isspace() and c not in _INVISIBLE for c in text)


def plain_text(content: str | None) -> str | None:
    """A message's text: its content, or the joined texts of the part or parts that it is JSON of."""
    if content is None or content.lstrip()[:1] not in ("[", "{"):
        return content
    try:
        value = json.loads(content)
    except (ValueError, RecursionError):
        return content
    is_part = lambda p: isinstance(p, dict) and "type" in p
    parts = value if isinstance(value, list) else [value]
    if not all(isinstance(p, str) or is_part(p) for p in parts):
        return content
    return flatten(value)


# --- words --------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTED = re.compile(r"„[^“”„]*[“”]|“[^“”]*”|«[^«»]*»|»[^«»]*«|\"[^\"]*\"|‹[^‹›]*›|```.*?(?:```|\Z)", re.S)


def words(text: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text)]


# --- refusal ------------------------------------------------------------------------------------

#: What shows that a text answers: a page, a serial, a docket, a table or list.
_EVIDENCE = re.compile(r"\bpage:\s?\d+|\bSN-\d+|\bAZ-\d{4}-|^\s*(?:[-*•]|\d+[.)])\s|^\s*\||```", re.M)
_SENTENCES = re.compile(r"(?<=[.!?…。])[\"“”»')\]]*\s+|\n+")


def refuses(question: str | None, answer: str) -> bool:
    """Whether ``answer`` only declines (``refusals``); pages, serials, tables and lists outside quotations are content."""
    bare = _QUOTED.sub(" ", answer)
    return not _EVIDENCE.search(bare) and only_declines([s for s in _SENTENCES.split(bare) if seen(s)], question)


# --- copy ---------------------------------------------------------------------------------------

_LEAD = re.compile(r"^\s*(?:[>*\"'“„«#]\s*|(?:q|re|question|frage|pregunta|you\sasked|the\squestion\swas|your\squestion|sie\sfragten|die\sfrage\swar|vous\savez\sdemandé|la\squestion\sétait|usted\spreguntó|la\spregunta\sera)\s?:\s*)+", re.I)


def _near(a: str, b: str) -> bool:
    """Whether two words differ by letters in another order, or by one letter."""
    if a == b:
        return True
    if len(a) == len(b) and Counter(a) == Counter(b):
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


#: Words of so many letters are compared directly: what they leave behind grows with the square of their length.
_LONG = 40


def _left_behind(word: str) -> set[str]:
    """What near words share: the sorted letters, or a word less one letter at most; long words are left whole."""
    return {"=" + "".join(sorted(word)), word} | {word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) < _LONG}


def copies(question: str, answer: str) -> bool:
    """Whether ``answer`` is the question, or at least its last sentence, with next to nothing added."""
    while _LEAD.match(answer):
        answer = _LEAD.sub("", answer, count=1)
    q, a = words(question), words(answer)
    if not q or not a:
        return False
    has = set(q)
    left = [w for w in a if w not in has]
    traces: dict[str, list[str]] = {}  # the words that leave something behind: their sorted letters, and themselves less any one letter
    for w in has if left else ():
        for t in _left_behind(w):
            traces.setdefault(t, []).append(w)
    long = [w for w in has if len(w) >= _LONG - 1]
    twins: dict[str, set[str]] = {}
    new = 0
    for w in left:
        if w not in twins:
            near = {x for t in _left_behind(w) for x in traces.get(t, ()) if _near(w, x)}
            twins[w] = near.union(x for x in long if _near(w, x)) if len(w) >= _LONG - 1 else near
        new += not twins[w]
        if new > max(2, len(a) // 10):
            return False
    last = [s for s in _SENTENCES.split(question) if words(s)][-1]
    got, core = set(a).union(*twins.values()), words(last)
    return sum(w in got for w in core) >= 0.7 * len(core)


# --- truncation ---------------------------------------------------------------------------------

_CLOSED = re.compile(r"[.!?…。！？][\"“”»«›'’)\]*_]*$")
_ABBREVIATED = re.compile(r"\b(?:Dr|Mr|Mrs|Prof|no|nos|cf|vol|pp?|Nr|Bl|Abs|Art|approx|vgl|bzw|ca|núm|pág|fol|éd|art|Sr|Sra|resp)\.$|\(cf\.$", re.I)
#: A short answer that is whole: serials, dockets, numbers, names, each perhaps with its page.
_SHORT = re.compile(r"^(?:[A-Z]{2}-[\w-]*\d|[A-Z]{3}\s[\d.,\s]*\d|[\d.,:%/\s€$-]*\d|\w[\w&.'’-]*(?:,?\s+(?:\w[\w&.'’-]*)){0,4}|yes|no)\s*(?:\(\s*(?:page|p\.|Seite|S\.|pág\.|página)\s?:?\s?\d+\s*\))?$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)]|[a-z]\))\s+\S")
#: What a text can't end with: an open mark, or a word that needs another after it.
_OPENS = re.compile(
    r"(?:[:,;–—(/&+=-]|\b(?:the|a|an|of|to|and|or|but|by|with|for|from|that|which|under|into|following|because|is|was|are|were|had|has|der|die|das|den|dem|des|ein|eine|einen|einer|und|oder|aber|von|vom|zu|zum|zur|mit|für|bei|dass|unter|folgende|weil|ist|wurde|hatte|im|am"
    r"|le|la|les|un|une|des|du|de|et|ou|mais|par|pour|avec|que|qui|sous|dans|est|avait|el|los|las|una|del|y|o|pero|por|para|con|bajo|siguientes|en|es|fue|había))$", re.I)
#: A sentence begins so; a name or a figure doesn't.
_BEGINS = re.compile(r"^(?:the|a|an|this|that|there|he|she|it|they|we|i|nobody|according|der|die|das|ein|eine|es|er|sie|niemand|nach|laut|le|la|les|l'|un|une|il|elle|ils|personne|selon|el|los|las|una|nadie|según)\b", re.I)


_MARKS = re.compile("[()\\[\\]{}„“”«»‚\"]")
#: What each closing mark closes; “ and " open as well, unless they close.
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“„", "»": "«"}


def _unclosed(text: str) -> bool:
    """Whether a fence, a bracket or a quotation is still open at the end."""
    if text.count("```") % 2:
        return True
    stack: list[str] = []
    for c in _MARKS.findall(text):
        top = stack[-1] if stack else ""
        if c in "([{„«‚":
            stack.append(c)
        elif c in _CLOSES:
            if top and top in _CLOSES[c]:
                stack.pop()
        elif top and top == {"“": "„", '"': '"'}[c]:
            stack.pop()
        else:
            stack.append(c)
    return bool(stack)


def breaks_off(answer: str, finish: str | None = None) -> bool:
    """Whether ``answer`` ends before its end.

    The text decides: open marks, a row of a table that isn't whole, a last sentence without its stop, a last word that needs another.
    Lists, addresses, names and figures end without a stop; where such a short text begins as a sentence does,
    ``finish`` tells which of the two it is.
    """
    text = answer.strip().strip("\u200b\ufeff").rstrip()
    if _unclosed(text):
        return True
    lines = [x for x in text.splitlines() if seen(x)]
    last = lines[-1].strip()
    if last.startswith("|"):
        table = [x.strip() for x in lines if x.strip().startswith("|")]
        return not last.endswith("|") or last.count("|") != table[0].count("|")
    if text.endswith("```"):
        return False
    if _CLOSED.search(text):
        return bool(_ABBREVIATED.search(text)) or bool(re.search(r"(?:^|\n)\s*\d+\.$", text))
    if _OPENS.search(text):
        return True
    items = [x for x in lines if _ITEM.match(x)]
    if _ITEM.match(lines[-1]) and len(items) > 1:
        # An item is whole as a phrase where the items before it are phrases, too.
        return any(_CLOSED.search(x.strip()) for x in items[:-1]) or len(last.split()) > 12
    if _SHORT.match(last) and (len(lines) == 1 or not _CLOSED.search(lines[-2].strip())):
        return finish == "length" and bool(_BEGINS.match(last))
    return True


# --- language -----------------------------------------------------------------------------------

#: Frequent words that tell the languages apart (fixed lists).
COMMON = {
    "en": "the of and to in that was by on for with his her which had at from this be are not it an had were has have who when could less yet only into before after what said is they she he how many why did does where whose list every",
    "de": "der die das und den von zu mit dem des ein eine einen einer auf für ist im nicht sich wie wer dass wurde wurden hatte an am aus bei nach vor über durch bereits seien schon jedoch nur niemand konnte wann was hat zum zur ich sie er es welche welcher warum viele alle laut bis",
    "fr": "le la les des du de un une et à dans que qui sur pour par ne pas au aux est été avait avaient ce cette dit se sont avec mais plus où quand comme après avant selon je il elle en combien quelle quel quelles quels pourquoi tous",
    "nl": "de het een van en niet dat die voor met op zijn was werd wordt werden heeft hebben had door over naar bij aan uit ook nog geen maar wel hij zij wie wat wanneer waarom tussen alle moest",
    "it": "il lo gli di che non per una del della dei delle nel nella sono è era ha hanno aveva anche più con come dal dalla alla questo questa chi quando perché tutti fra stato",
    "pt": "o os as de a e se do da dos das não em no na nos um uma que para com por foi são era tem tinha também mais como ao pelo pela este esta quem quando porque entre todos",
    "sv": "och att det som en ett av är var för på med inte den har hade till från om vid efter över mellan alla när vem vad",
    "da": "og at det som en et af er var for på med ikke den har havde til fra om ved efter over mellem alle når hvem hvad blev",
    "pl": "i w na z że się nie do to jest był była było przez po od dla oraz jak co kto kiedy dlaczego między wszystkie został",
    "es": "el la los las del de que y en un una por con no se su para al lo como fue había habían pero más cuando solo sobre antes después según quién cómo durante entre sin está yo él ella cuenta cuántas cuántos qué cuál dónde a",
}
_COMMON = {k: set(v.split()) for k, v in COMMON.items()}
_LANGUAGES = {w: [k for k, v in _COMMON.items() if w in v] for w in set().union(*_COMMON.values())}
_ELIDED = re.compile("(?:[cdjlmnst]|qu|jusqu)['’]")
_NAMES = {
    "en": r"english|englisch\w*|anglais|inglés",
    "de": r"german|deutsch\w*|allemand|alemán",
    "fr": r"french|französisch\w*|français|francés",
    "nl": r"dutch|niederländisch\w*|holländisch\w*|néerlandais|neerlandés|holandés",
    "it": r"italian|italienisch\w*|italien|italiano",
    "pt": r"portuguese|portugiesisch\w*|portugais|portugués",
    "sv": r"swedish|schwedisch\w*|suédois|sueco",
    "da": r"danish|dänisch\w*|danois|danés",
    "pl": r"polish|polnisch\w*|polonais|polaco",
    "es": r"spanish|spanisch\w*|espagnol|español|castellano",
}
_ASKED = {k: re.compile(rf"\b(?:in|into|auf|en|to|ins?|language|idioma|langue|Sprache|au|al|reads?|speaks?|only)\s(?:\w+\s){{0,2}}?(?:{v})\b|\b(?:{v})\b", re.I) for k, v in _NAMES.items()}
_SCRIPTS = {
    "cyrillic": re.compile(r"[\u0400-\u04ff]"), "greek": re.compile(r"[\u0370-\u03ff]"), "arabic": re.compile(r"[\u0600-\u06ff]"), "hebrew": re.compile(r"[\u0590-\u05ff]"),
    "han": re.compile(r"[\u3040-\u30ff\u3400-\u9fff]"), "hangul": re.compile(r"[\uac00-\ud7af]"), "thai": re.compile(r"[\u0e00-\u0e7f]"), "devanagari": re.compile(r"[\u0900-\u097f]"),
    "latin": re.compile(r"[A-Za-z\u00c0-\u024f]"),
}
_OTHER = re.compile("|".join(p.pattern for s, p in _SCRIPTS.items() if s != "latin"))


def language(text: str) -> str | None:
    """The language of a text outside quotations, or its script if that isn't Latin; None if too little tells."""
    bare = _QUOTED.sub(" ", text)
    if not bare.isascii() and _OTHER.search(bare):
        letters = {s: len(p.findall(bare)) for s, p in _SCRIPTS.items()}
        main = max(letters, key=letters.get)
        if main != "latin":
            return main
    score, n = dict.fromkeys(_COMMON, 0), 0
    for w in words(bare):
        n += 1
        for lang in _LANGUAGES.get(w, ()):
            score[lang] += 1
        if w[1:2] in "'’" and _ELIDED.match(w) or w.startswith(("qu'", "qu’", "jusqu")) and _ELIDED.match(w):
            score["fr"] += 1
    score["es"] += bare.count("¿") + bare.count("¡")
    best, second = sorted(score, key=score.get, reverse=True)[:2]
    if score[best] < 2 or score[best] < 1.25 * score[second] or score[best] < 0.08 * n:
        return None
    return best


def _sentence_languages(text: str) -> Counter:
    out: Counter = Counter()
    for s in _SENTENCES.split(_QUOTED.sub(" ", text)):
        if lang := language(s):
            out[lang] += len(s)
    return out


def other_language(question: str, answer: str) -> bool:
    """Whether ``answer`` is in another language than ``question``, which doesn't ask for that one."""
    asks = language(question) or next((lang for s in reversed(_SENTENCES.split(question)) if words(s) for lang in [language(s)]), None)
    says = language(answer) or next((lang for lang, _ in _sentence_languages(answer).most_common(1)), None)
    if asks is None or says is None or asks == says:
        return False
    return not (says in _ASKED and _ASKED[says].search(question))


# --- the operator -------------------------------------------------------------------------------


def find_defects(question: str | None, answer: str | None, finish: str | None = None) -> list[str]:
    """Every defect of a pair, in the order of the rules; ``finish`` is why the answer ended, if that is known."""
    if not seen(answer):
        return [EMPTY]
    out = []
    if refuses(question, answer):
        out.append(REFUSAL)
    if question and copies(question, answer):
        out.append(COPY)
    if breaks_off(answer, finish):
        out.append(TRUNCATED)
    if question and other_language(question, answer):
        out.append(LANGUAGE)
    return out


def _last(messages: str, role: str):
    """Of the last message with ``role``: a struct with its content, null if there is none."""
    mine = F.filter(messages, lambda m: F.coalesce(F.regexp_replace(F.lower(m["role"]), r"[\s\p{Z}]", "").isin(*_ROLES[role]), F.lit(False)))
    return F.when(F.size(mine) > 0, F.struct(F.try_element_at(mine, F.lit(-1))["content"].alias("content")))


def _rows(traces: DataFrame) -> DataFrame:
    finish = F.col("finish_reason") if "finish_reason" in traces.columns else F.lit(None)
    return traces.select("trace_id", _last("prompt_messages", "user")["content"].alias("question"), _last("response_messages", "assistant")["content"].alias("answer"), finish.cast("string").alias("finish_reason"))


def pairs(traces: DataFrame) -> DataFrame:
    """trace_id, question, answer (contents as they stand) and finish_reason (null where traces have none) of each distinct trace."""
    first = F.max_by(F.struct("question", "answer", "finish_reason"), F.hash("question", "answer", "finish_reason")).alias("p")
    return _rows(traces).groupBy("trace_id").agg(first).select("trace_id", "p.*")


def judge(rows: DataFrame) -> DataFrame:
    """trace_id and the list of defects of each pair in ``rows``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_defects(plain_text(q), plain_text(a), f) for q, a, f in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["trace_id", "defects"])

    return rows.select("trace_id", "question", "answer", "finish_reason").mapInArrow(run, "trace_id bigint, defects array<string>")


def _judged(traces: DataFrame) -> DataFrame:
    """As ``judge(pairs(traces))``, but judged where the rows lie, so that only verdicts are shuffled."""
    return judge(_rows(traces)).groupBy("trace_id").agg(F.max("defects").alias("defects"))


def defects(traces: DataFrame) -> DataFrame:
    """Each triggered defect of each distinct trace: trace_id, rank (of the rule), defect."""
    return _judged(traces).select("trace_id", F.posexplode("defects").alias("rank", "defect"))


def first_defects(traces: DataFrame) -> DataFrame:
    """The defective traces with their first defect: trace_id, defect."""
    return _judged(traces).where(F.size("defects") > 0).select("trace_id", F.try_element_at("defects", F.lit(1)).alias("defect"))
