"""Text expressions: page references, names, addresses, windows, byte ids. All are JVM-side columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions.arrays import let

#: How tool results name pages and timesteps (fixed values of the data's formats).
PAGE_MEMBER, PAGE_FILE, TIMESTEP_MEMBER, CITATION = r'"page"\s*:\s*(\d+)', r"md/page_(\d{4})\.md", r'"timestep"\s*:\s*(\d+)', r"page:(\d+)"
#: Role and end marks of the byte-level ids (fixed values).
SYSTEM, USER, ASSISTANT, TOOL, END = 256, 257, 258, 259, 260
FACT = r"(?s)^FACT-(.+)-([0-9]{4})-([0-9]+): (.*)\z"
WINDOW, OVERLAP = 220, 40
_WORD = r"[ \t\r\n]*[^ \t\r\n]+"


def _ints(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.try_cast("int"))


def page_refs(text: Column) -> Column:
    """The distinct pages that a tool result names as members or files, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(_ints(text, PAGE_MEMBER), _ints(text, PAGE_FILE)), lambda x: x.isNotNull())))


def citations(text: Column) -> Column:
    """The pages cited as page:N, in order, repeated ones too."""
    return F.filter(_ints(text, CITATION), lambda x: x.isNotNull())


def timestep_of(text: Column) -> Column:
    """The first timestep member of a text, null if there is none."""
    return F.regexp_extract(text, TIMESTEP_MEMBER, 1).try_cast("int")


def page_file(page: Column) -> Column:
    return F.format_string("md/page_%04d.md", page)


def strip_userinfo(url: Column) -> Column:
    """An address without user and password: from ``://`` to the last @ before the next slash."""
    return F.regexp_replace(url, r"^([^/]*?://)[^/]*@", "$1")


def template_pattern(template: str) -> str:
    """A pattern from a ref template: literal but for {T}, which is a captured number."""
    return "^" + r"(\d+)".join(re.escape(p) for p in template.split("{T}")) + "$"


def env_name(name: Column) -> Column:
    return F.translate(F.upper(name), "-", "_")


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def git_blob_id(content: Column) -> Column:
    """The object id that git gives a file of this content (bytes)."""
    head = F.concat(F.encode(F.lit("blob "), "utf-8"), F.encode(F.octet_length(content).cast("string"), "utf-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """The overlapping word windows of a text as array of (chunk_idx, n_words, text).

    A window's text is the verbatim stretch from its first to its last word; a text without words is
    one window, the text itself; windows stop when one reaches the end.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    stride = size - overlap
    whole = F.array(F.struct(F.lit(0).alias("chunk_idx"), F.lit(0).alias("n_words"), text.alias("text")))

    def cut(words: Column) -> Column:
        n = F.size(words)
        count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / stride)).cast("int")
        piece = lambda i: F.slice(words, i * stride + 1, F.lit(size))
        text_of = lambda i: F.regexp_replace(F.array_join(piece(i), ""), r"^[ \t\r\n]+", "")
        pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_idx"), F.size(piece(i)).alias("n_words"), text_of(i).alias("text")))
        return F.when(n > 0, pieces).otherwise(whole)

    return let(F.regexp_extract_all(text, F.lit(_WORD), 0), cut)


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as ids; for use within other expressions (``kernels.byte_ids`` takes whole columns)."""
    each = F.split(F.decode(F.encode(text, "utf-8"), "ISO-8859-1"), "")  # one character a byte
    return F.transform(F.filter(each, lambda c: c != ""), F.ascii)


def stub_logprobs(ids: Column) -> Column:
    """A deterministic logprob for each position: -0.03125 times (i mod 7 + 1)."""
    n = F.greatest(F.size(ids), F.lit(0))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.lit(-0.03125) * (i % 7 + 1))
    return F.when(n > 0, each).otherwise(F.array().cast("array<double>"))


def flat_content(content: Column) -> Column:
    """A message's text: plain content as it is; JSON text of a part, or of a list of parts and strings, as the joined texts.

    For typed tables; the raw wire form is flattened by ``wire.flatten_content``.
    """
    one = F.get_json_object(content, "$.text")
    part = lambda p: p.startswith("{")
    typed = lambda p: F.get_json_object(p, "$.type").isNotNull()
    text = lambda p: F.when(part(p), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)
    joined = let(F.from_json(content, "array<string>"), lambda m: F.when(F.forall(m, lambda p: ~part(p) | typed(p)), F.array_join(F.transform(m, text), "")))
    start = F.substring(F.ltrim(content), 1, 1)
    return F.when(start == "{", F.coalesce(F.when(typed(content), one), content)).when(start == "[", F.coalesce(joined, content)).otherwise(content)


def message_ids(messages: Column) -> Column:
    """The ids of a prompt's messages: each its role's mark, the bytes of its text and of its calls' arguments, the end mark; then the assistant's mark.

    A message of unknown role has no mark; a null message gives nothing.
    """
    marks = F.create_map(*[F.lit(x) for r, m in (("system", SYSTEM), ("user", USER), ("assistant", ASSISTANT), ("tool", TOOL)) for x in (r, m)])
    calls = lambda m: F.coalesce(F.array_join(F.transform(m["tool_calls"], lambda c: F.coalesce(c["function"]["arguments"], F.lit(""))), ""), F.lit(""))
    body = lambda m: byte_ids(F.concat(F.coalesce(flat_content(m["content"]), F.lit("")), calls(m)))
    known = F.filter(messages, lambda m: m.isNotNull())
    each = F.transform(known, lambda m: F.concat(F.filter(F.array(marks[m["role"]]), lambda x: x.isNotNull()), body(m), F.array(F.lit(END))))
    return F.concat(F.coalesce(F.flatten(each), F.array().cast("array<int>")), F.array(F.lit(ASSISTANT)))


def facts(text: Column) -> Column:
    """The fact lines of a page: array of (case_id, page, k, fact)."""
    lines = F.filter(F.split(text, r"\r\n?|\n"), lambda x: x.rlike(FACT))
    part = lambda x, i: F.regexp_extract(x, FACT, i)
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("case_id"), part(x, 2).cast("int").alias("page"), part(x, 3).cast("int").alias("k"), part(x, 4).alias("fact")))


def redact(text: Column, secrets: list[str]) -> Column:
    """A text with each secret replaced by ***, longer ones first; empty secrets are passed over."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def substitute(text: Column, old: str, new: str) -> Column:
    """(text, n): a text with ``old`` replaced and how often it occurred."""
    if not old:
        raise ValueError("nothing to replace")
    return F.struct(F.replace(text, F.lit(old), F.lit(new)).alias("text"), ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int").alias("n"))


def url_port(url: Column) -> Column:
    """The port of an address: the one it names, or its scheme's; null if it has neither."""
    named = F.regexp_extract(url, r"^[^/]*://[^/]*:(\d+)(?:/|\z)", 1).try_cast("int")
    return F.coalesce(named, F.when(url.startswith("https://"), 443).when(url.startswith("http://"), 80))


def api_root(url: Column) -> Column:
    """Whether an address ends in /v1, a last slash aside."""
    return F.coalesce(url.rlike(r"/v1/?\z"), F.lit(False))
