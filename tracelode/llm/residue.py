"""Texts that are, or hold, template residue instead of content: unfilled fields, filler, error pages,
notices that scripts are required.

Lines are normalised and counted by host (the source of a document): a line in a fifth of a host's
documents, and in ``LEAST`` at least, is its boilerplate and is subtracted where it stands beside
content. What is left of a document, its residual, is searched for evidence; a document with evidence is
excluded. (Notices and fields recur by nature, so the share is high: only what frames a host's pages, such as a footer
on scripts, is boilerplate.) Evidence is taken from whole lines and sentences: fields by their marks and names,
lines by their form (traces, status lines, units over and over), notices by the words they
consist of (``notices``); a sentence that speaks of a field or an error, quotes one or shows code isn't one.

Defined results: null, empty and blank texts have no evidence; a null source is a host of its own;
texts of any length are searched whole; of rows with one doc_id any with evidence counts; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.notices import kind_of, triggers
from tracelode.operators.dedup import unused
from tracelode.runtime import checkpointed

PLACEHOLDER, FILLER, ERROR, SCRIPT = "placeholder", "filler", "error", "script"
#: A line is boilerplate of its host if it is in this share of the host's documents, and in so many at least.
SHARE, LEAST = 0.2, 20

#: What isn't seen, and what ends a line.
_HIDDEN, _BREAK = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]"), re.compile("\r\n?|[\x0b\x0c\x85\u2028\u2029]")
_FIGURES = re.compile("[0-9]+")
_SPACE, _ODD_SPACE = re.compile(r"[^\S\n]+"), re.compile(r"[^\S\n ]|  ")


def normalise(text: str) -> list[str]:
    """The lines of a text without invisible characters, with plain spaces and apostrophes."""
    text = _HIDDEN.sub("", _BREAK.sub("\n", text)).replace("\u2019", "'").replace("\u00b4", "'")
    if _ODD_SPACE.search(text):
        text = _SPACE.sub(" ", text)
    return [line.strip() for line in text.split("\n")]


# --- what a sentence speaks of ---------------------------------------------------------------------

_CODE = re.compile(r"`[^`\n]+`")
_QUOTED = re.compile(r"„[^“”„]*[“”]|“[^“”]*”|«[^«»]*»|\"[^\"{}]*\"")
_TAG = re.compile(r"</?\w+>")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"“”»')\]]*\s+")
#: Words by which a sentence speaks of templates and their fields.
_ON_FIELDS = re.compile(r"\b(?:templates?|fields?|placeholders?|renderer|variables?|syntax|vorlagen?|felde?r?|platzhalter|modèles?|champs?|gabarits?|plantillas?|campos?)\b", re.I)


_QUOTES = frozenset("„“«\"")


def unquoted(line: str) -> str:
    """A line without its quotations; a single word in guillemets may be a field and stays."""
    if not _QUOTES.intersection(line):
        return line
    return _QUOTED.sub(lambda m: m.group() if m.group()[0] == "«" and not re.search(r"\s", m.group()[2:]) else " ", line)


# --- placeholders ----------------------------------------------------------------------------------

_NAME = r"[^\W\d][\w.\- ]{0,40}?"
_FIELD = re.compile(
    rf"""
      \{{\{{[{{%\#]?\s*{_NAME}\s*[%\#}}]?\}}\}} | \$!?\{{\s*{_NAME}\s*\}} | \#\{{\s*{_NAME}\s*\}} | <%[=-]?\s*{_NAME}\s*-?%> | \{{%\s*{_NAME}\s*%\}}
    | %\({_NAME}\)[sd] | %%{_NAME}%% | (?<![\w%])%[^\W\d_][\w.\-]{{1,60}}%(?![\w%]) | @@{_NAME}@@ | (?<!\w)__[^\W\d_][\w.\-]{{0,60}}?[^\W_]__(?!\w) | \[\[\s*{_NAME}\s*\]\] | <<\s*{_NAME}\s*>> | (?<![\w{{$\#])\{{[^\W\d_][\w.\-]{{0,60}}\}}(?![\w}}])
    | «[^\W\d_][\w.\-]{{0,60}}»
    | <(?:enter|insert|add|fill\sin|your|type|eingeben|hier|bitte|indiquer|indiquez|insérer|saisir|votre|indique|indicar|inserte|insertar|introduzca|completar|rellenar|su|ihr|ihre|à\scompléter|por\scompletar|noch\sausfüllen|to\sbe\scompleted)\s?[\s:]\s?[^<>\n]{{1,40}}>
    | <[^\W\d_][\w.\-]{{0,60}}>
    | [\[(](?:insert|enter|add|fill\sin|your|type|here|hier|bitte|einfügen|eintragen|ihr|ihre|noch\sausfüllen|insérer|inserer|indiquer|compléter|completer|saisir|votre|à\scompléter|insertar|indicar|indique|completar|rellenar|su|tu)\b[^\[\]()\n]{{0,50}}[\])]
    | [\[(][^\[\]()\n]{{1,50}}\b(?:to\sbe\s(?:completed|added|inserted|filled\sin|confirmed)|here|ergänzen|einfügen|einsetzen|eintragen|ausfüllen|à\scompléter|à\sinsérer|por\scompletar|a\scompletar|pendiente)\s?[\])]
    | \[[A-ZÄÖÜÉÈÀÑÓÍ]{{3,}}(?:[ _.\-][A-ZÄÖÜÉÈÀÑÓÍ]+)*\]
    | \[[^\W\d_][^\W\d]*(?:[ '\-][^\W\d]+){{0,4}}\]
    | \b(?:TODO|FIXME)\s?:\s?\w+ | \bTBD\b\s?:\s?\w+
    """,
    re.X | re.I,
)
#: Words that a bracketed remark of an editor begins with; they are no fields.
_REMARK = re.compile(r"^[\[(](?:sic|illegible|unleserlich|illisible|ilegible)\b", re.I)
_BLANK = re.compile(r"^[^\W\d_][\w .]{0,30}\s?:\s?_{4,}(?:\s[^\W\d_]{1,12})?$")


def _identifier(name: str) -> bool:
    camel = re.search(r"[a-zäöüéèñ][A-ZÄÖÜÉÈÑ]", name)
    return "_" in name or "." in name or "-" in name or name.isupper() or bool(camel) or name.casefold() in _FIELD_NAMES


#: Nouns that name a field when they stand alone in guillemets or braces, or end or begin what stands in brackets.
_FIELD_NAMES = set(
    "date name address amount recipient court clerk party docket page case datum anschrift betrag empfänger gericht bearbeiter seite aktenzeichen partei montant adresse destinataire tribunal greffier "
    "partie dossier nom fecha nombre domicilio importe destinatario juzgado secretario parte expediente página title nachname vorname prénom apellido subject city street phone email sender signature".split()
)
_BRACKET_NAMES = _FIELD_NAMES - {"court", "clerk", "party", "page", "case", "seite", "partie", "parte", "página", "gericht", "tribunal"} | set(
    "client customer company number nummer numéro número time telephone kunde kundenname firma unterschrift vorname nachname prénom signature entreprise cognome sobrenome achternaam voornaam lastname firstname surname empresa apellido firma naam datum bedrag nome data indirizzo importo valor endereço".split()
)


#: What no editor puts in brackets as a remark.
_PERSONAL = set("nachname vorname prénom apellido surname firstname lastname signature unterschrift telephone email phone".split())


def _bracketed(t: str) -> bool:
    """Whether what stands in square brackets is named as a field is: in capitals, with an instruction, or by a field's noun."""
    inner = t[1:-1]
    if inner.isupper() and len(inner) >= 3 or _HINT.search(t):
        return True
    ws = [w.casefold() for w in re.split(r"[ _.'\-]+", inner)]
    return bool({ws[0], ws[-1]} & _BRACKET_NAMES) and (len(ws) > 1 or inner[:1].isupper() or ws[0] in _PERSONAL)


#: Without one of these a sentence holds no field, or no word for scripts; looked for first. Page numbers alone are none.
_MAY_FIELD = re.compile(r"[\[{<«%@#$]|__|\((?!page:[\d\s,–-]*\))|[Tt](?:ODO|odo|BD|bd)|F(?:IXME|ixme)|fixme")


def _has_field(sentence: str) -> bool:
    for m in _FIELD.finditer(sentence):
        t = m.group()
        if _REMARK.match(t):
            continue
        if (t[0] in "«<" and " " not in t and t[1] not in "<%") or (t[0] == "{" and t[1] not in "{%"):
            if not _identifier(t[1:-1]):
                continue
        if t[0] == "%" and t[1] not in "%(" and not _identifier(t[1:-1]):
            continue
        if re.fullmatch(r"\[[^\W\d_][^\W\d]*(?:[ _.'\-][^\W\d]+)*\]", t) and not _bracketed(t):
            continue
        return True
    return False


_HINT = re.compile(r"\b(?:insert|enter|add|fill|your|type|here|hier|bitte|einfügen|eintragen|ihre?|ausfüllen|insérer|inserer|indiquer|compléter|completer|saisir|votre|insertar|indicar|indique|completar|rellenar|su|tu|completed|added|inserted|ergänzen|einsetzen|pendiente)\b", re.I)

# --- filler ----------------------------------------------------------------------------------------

_UNIT = re.compile(r"^(.{1,40}?)\s*(?:\1\s*){3,}.{0,40}$")
_LABEL = re.compile("^[A-Za-z\u00c0-\u024f]+ [0-9]+$")
_STUB = re.compile(r"^(?:\.{2,}|…|tb[da]|n/?a|text|texte|texto|body text|description|beschreibung|descripción|inhalt|contenu|contenido|content|folgt|lorem|xxx+)\W*$", re.I)
_LOREM = re.compile(r"^\W*lorem\s+ipsum\b", re.I)
#: Frequent words of languages; a plain sentence does without none of its own. Latin ones are left out, as filler has them.
_FUNCTION = set(
    "the of and to that was by on for with his her which had at from this be are not it have who when der die das und den von zu mit dem des ein eine auf für ist im nicht sich wie wer dass wurde hatte "
    "le la les des du un une dans que qui sur pour par ne pas au aux avait el los las del y en una con se su para al lo como no is were has have as they their its or but le de à é es son sus wird werden sind "
    "il gli di che per della nel sono è o da um uma não em os na het een van niet op te dat att och en av som är det på og til ikke ja on ei se oli w i na z się nie do a je ve že".split()
)
_LATIN = set("et in ut sed a ad ex ac non per".split())


def _repeats(line: str) -> bool:
    m = _UNIT.match(line) if len(line) >= 30 else None
    return bool(m) and any(c.isalnum() for c in m.group(1)) and _tail_of(m.group(1), line)


def _tail_of(unit: str, line: str) -> bool:
    """Whether the line is the unit over and over, the last time perhaps in part."""
    bare, one = line.replace(" ", ""), unit.replace(" ", "")
    return bool(one) and bare == (one * (len(bare) // len(one) + 1))[: len(bare)]


def _crossed(line: str) -> bool:
    """Whether a line is words of the letter x only, three at least."""
    if line[:1] not in "xX" or set(line) - set("xX \t.,;:!?"):
        return False
    ws = re.findall("[xX]+", line)
    return len(ws) >= 6 or len(ws) >= 3 and all(len(w) >= 2 for w in ws)


def _mock_latin(line: str) -> bool:
    """Whether a line of eight words or more has letters only and no word that a sentence needs."""
    if re.search(r"[\d|:/@_=<>{}()\[\]]", line):
        return False
    ws = [w.casefold().strip(".,;!?") for w in line.split()]
    if len(ws) < 8 or not all(w.isalpha() for w in ws if w):
        return False
    plain = [w for w in ws if w not in _LATIN]
    capital = sum(w[:1].isupper() for w in line.split())
    return sum(w in _FUNCTION for w in plain) <= len(ws) // 40 and capital * 3 <= len(ws) and all(ord(c) < 0x250 for w in ws for c in w)


# --- errors: lines of a form of their own ------------------------------------------------------------

_ERROR_LINE = re.compile(
    r"""^\W*(?:
      http/\d(?:\.\d)?\s[45]\d\d\b.* | (?:error|fehler|erreur|errore|erro|fout|http|status|code|err)[:\s]*[45]\d\d\W*
    | traceback\s\(most\srecent\scall\slast\):.* | file\s"[^"]+",\sline\s\d+.* | (?:[a-z]\w*\.)*[a-z]\w*(?:error|exception)(?::\s.*)? | at\s[\w$.]+\([\w$.]*:?\d*\)
    | (?:php\s)?(?:warning|fatal\serror|notice|parse\serror):\s.*[/\\(].*\bon\sline\s\d+.* | ora-\d{4,5}:.* | sqlstate\b.* | segmentation\sfault.*
    | \{?\s*"error"\s*:.*
    )$""",
    re.X | re.I,
)


# --- a document ------------------------------------------------------------------------------------


def _form(bare: str) -> str | None:
    """The kind of evidence that a line is by its form."""
    if _BLANK.match(bare):
        return PLACEHOLDER
    if _repeats(bare) or _crossed(bare) or _LOREM.match(bare) or _mock_latin(bare):
        return FILLER
    return ERROR if _ERROR_LINE.match(bare) else None


def _line_kinds(lines: list[str], notice: list[bool]) -> list[str | None]:
    """The kind of evidence that each normalised line is or holds; notices are looked for only in lines that may hold
    one, and there in the sentences that may."""
    kinds: list[str | None] = []
    sentences, owner = [], []
    for k, (line, may) in enumerate(zip(lines, notice)):
        bare = _CODE.sub(" ", unescape(line) if "&" in line else line) if "&" in line or "`" in line else line
        kinds.append(_form(bare))
        if kinds[-1] is None and (may or _MAY_FIELD.search(bare)):
            mine = [s for s in _SENTENCE.split(unquoted(bare)) if s]
            sentences += mine
            owner += [k] * len(mine)
    may_say = pc.match_substring_regex(pc.utf8_lower(pa.array(sentences, pa.string())), _NOTICES).to_pylist()
    for k, s, may in zip(owner, sentences, may_say):
        if kinds[k] is None:
            if _MAY_FIELD.search(s) and _has_field(s) and not _ON_FIELDS.search(_FIELD.sub(" ", s)):
                kinds[k] = PLACEHOLDER
            elif may:
                kinds[k] = FILLER if _LOREM.match(s) else kind_of(_TAG.sub(" ", s) if s[0] == "<" else s)
    return kinds


#: By these patterns, matched over whole Arrow buffers in linear time, lines are told that may hold evidence: words of
#: notices and marks of fields; letters only, at some length; a unit over and over; lines of a form of their own.
_NOTICES = triggers()
_FIELDS = (
    r"\{[^\s\"]|\[[^\s\d\]]|<[^\s\d]|«[^\s\d]|%[\pL(%]|@@|__|\bfixme|:\s?_{4}|&[a-z#]"
    r"|\(\s?(?:insert|enter|add|fill|your|type|here|hier|bitte|einfügen|eintragen|ihre?|noch|insérer|inserer|indiquer|compléter|completer|saisir|votre|à c|insertar|indicar|indique|completar|rellenar|su|tu)\b"
    r"|\b(?:to be (?:completed|added|inserted|filled in|confirmed)|here|ergänzen|einfügen|einsetzen|eintragen|ausfüllen|à compléter|à insérer|por completar|a completar|pendiente)\s?[\])]"
)
_SHAPE = r"^traceback|^file \"|^[^\d|:/@_=<>{}()\[\]]{30,}$|^.*x+[\s.,;:!?]+x+|x{6}|exception|\w+error\b|ora-\d|sqlstate|segmentation|on line \d|\bat [\w$.]+\(|\b[45]\d\d\b.*\b(?:bad|conflict)|^\W*(?:http|status|code|err)[:\s]"
_HIDE, _ENDS, _BLANKS = "[\u200b\u200c\u200d\u2060\ufeff\u00ad]", "\r\n?|[\x0b\x0c\u0085\u2028\u2029]", "[\t \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\x1c-\x1f]+"


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The normalised lines of an Arrow array of texts: the text's place, the line's number, the line."""
    plain = pc.replace_substring_regex(pc.replace_substring_regex(pc.replace_substring_regex(texts, _HIDE, ""), _ENDS, "\n"), "[\u2019\u00b4]", "'")
    lists = pc.split_pattern(pc.replace_substring_regex(plain, _BLANKS, " "), "\n")
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    parent = np.repeat(np.arange(len(texts)), many)
    number = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
    return parent, number, pc.utf8_trim_whitespace(pc.list_flatten(lists))


def _suspects(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each normalised line whether it may hold evidence, and whether that may be a notice."""
    low = pc.utf8_lower(lines)
    mask = lambda p: pc.match_substring_regex(low, p).to_numpy(zero_copy_only=False)
    notice = mask(_NOTICES)
    return notice | mask(_FIELDS) | mask(_SHAPE) | _repetitive(lines), notice


def _repetitive(lines: pa.Array) -> np.ndarray:
    """Which lines of 30 characters or more begin with one unit four times; digits may make the unit."""
    long = pc.indices_nonzero(pc.greater_equal(pc.utf8_length(lines), 30)).to_numpy()
    hit = np.zeros(len(lines), bool)
    # A unit of at most 40 characters: its first characters come back within 42 places.
    for i, line in zip(long.tolist(), lines.take(pa.array(long)).to_pylist()):
        hit[i] = line.find(line[:3], 1, 48) > 0 and line.find(line[:3], len(line) // 2) > 0 and _repeats(line)
    return hit


def evidence(text: str | None) -> list[tuple[int, str, str]]:
    """The evidence in a text: (line number, kind, line); at most one kind a line."""
    return [e[1:] for e in sorted(evidence_of(pa.array([text], pa.string()))[0])]


def evidence_of(texts: pa.Array) -> tuple[list[tuple[int, int, str, str]], np.ndarray]:
    """The evidence in texts, (text's place, line number, kind, line), and how many lines with a letter or figure each text has."""
    parent, number, lines = _split(texts)
    hit, notice = _suspects(lines)
    count = lambda p: np.bincount(parent[pc.match_substring_regex(lines, p).to_numpy(zero_copy_only=False)], minlength=len(texts))
    # What stands between fences is code; a fence that nothing closes opens none.
    for i in np.flatnonzero(count("^```")).tolist():
        mine = np.flatnonzero(parent == i)
        fences = [k for k in mine.tolist() if lines[k].as_py().startswith("```")]
        for a, b in zip(fences[::2], fences[1::2]):
            hit[a : b + 1] = False
    at = np.flatnonzero(hit)
    texts_of = lines.take(pa.array(at)).to_pylist()
    kinds = _line_kinds(texts_of, notice[at].tolist())
    found = [(i, n, kind, line) for i, n, line, kind in zip(parent[at].tolist(), number[at].tolist(), texts_of, kinds) if kind]
    # An outline without content: labels with numbers, each over a stub.
    for i in np.flatnonzero(count(_LABEL.pattern) > 1).tolist():
        mine = np.flatnonzero(parent == i)
        shown = [(n, x) for n, x in zip(number[mine].tolist(), lines.take(pa.array(mine)).to_pylist()) if x]
        stubs = [(n, x) for (n, x), (_, y) in zip(shown, shown[1:]) if _LABEL.match(x) and _STUB.match(y)]
        if len(stubs) >= 2:
            found += [(i, n, FILLER, x) for n, x in stubs]
    return found, count(r"[\pL\pN]")


# --- the operator ----------------------------------------------------------------------------------


def line_key(line: str) -> int:
    """A normalised line as it is counted: 64 bits of a hash, without case and figures."""
    return int.from_bytes(blake2b(_FIGURES.sub("0", line.lower()).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def line_counts(documents: DataFrame) -> DataFrame:
    """source, line (hash) and in how many of the source's documents the line is; counted whole.

    Map-side sums leave one row a line and task, so a line that is in every document isn't hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, keys = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    mine = {line_key(x) for x in normalise(text) if x}
                    keys += mine
                    parent += [i] * len(mine)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(parent, pa.int64())), pa.array(keys, pa.int64())], names=["source", "line"])

    lines = documents.select(F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "source string, line bigint")
    return lines.groupBy("source", "line").agg(F.count("*").alias("docs"))


def boilerplate(documents: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The recurrent lines of each host: source, line (hash), docs; at most 1 / share times the mean number of lines of a document."""
    sizes = documents.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"))
    counted = line_counts(documents).where(F.col("docs") >= least)
    return counted.join(sizes, F.col("source").eqNullSafe(F.col("host"))).where(F.col("docs") >= F.col("n") * share).select("source", "line", "docs")


def search(documents: DataFrame) -> DataFrame:
    """Every line of ``documents`` with evidence: doc_id, source, line_no (from 0), kind, line (hash), beside (how many
    lines of other content the document has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, said = evidence_of(b.column(2))
            docs, no, kinds, texts = (list(x) for x in zip(*found)) if found else ([], [], [], [])
            distinct = np.bincount([i for i, _ in {(i, n) for i, n, _, _ in found}], minlength=b.num_rows) if found else said
            rows = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(no, pa.int32()), pa.array(kinds, pa.string()), pa.array([line_key(x) for x in texts], pa.int64()), pa.array(np.maximum(said - distinct, 0), pa.int32()).take(rows)],
                names=["doc_id", "source", "line_no", "kind", "line", "beside"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, source string, line_no int, kind string, line bigint, beside int")


def residual_evidence(documents: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The evidence that is left when each host's boilerplate is subtracted: as ``search`` has it.

    The texts are read once: only the lines with evidence need their count, and those are what ``search`` gives.
    A recurrent line frames a host's pages only where it stands beside content; where it is all there is,
    the page is the notice, however many such pages a host has.
    """
    found = checkpointed(search(documents))
    counted = found.select("source", "line", "doc_id").distinct().groupBy("source", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    sizes = documents.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"))
    common = counted.join(sizes, F.col("source").eqNullSafe(F.col("host"))).where(F.col("docs") >= F.col("n") * share).select("host", F.col("line").alias("known"))
    framed = F.col("source").eqNullSafe(F.col("host")) & (F.col("line") == F.col("known")) & (F.col("beside") > 0)
    return found.join(common, framed, "left_anti")


def residue(documents: DataFrame) -> DataFrame:
    """The documents with residue: doc_id."""
    return residual_evidence(documents).select("doc_id").distinct()


def clean(documents: DataFrame) -> DataFrame:
    """``documents`` without those with residue, all columns as they are; a null doc_id is never excluded."""
    name = unused(documents, "__residue")
    return documents.join(residue(documents).select(F.col("doc_id").alias(name)), F.col("doc_id") == F.col(name), "left_anti")
