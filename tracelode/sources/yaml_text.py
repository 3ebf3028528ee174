"""The plain part of YAML 1.1 that prompts and manifests are written in: block mappings and lists, scalars, block texts.

Used where no YAML parser is installed. Anchors, tags, flow collections beyond ``[]`` and ``{}`` of scalars, and
several documents are refused with ValueError.
"""

from __future__ import annotations

import json
import re

#: Words of YAML 1.1 that are no text (fixed values).
_WORDS = {**dict.fromkeys("yes true on".split(), True), **dict.fromkeys("no false off".split(), False), "null": None, "~": None, "": None}
_KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{}&*!|>%@`,-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")


def scalar(text: str):
    """A scalar's value: quoted text, a word of YAML 1.1, a number, an empty or flat flow collection, else the text."""
    t = text.strip()
    if t[:1] == '"':
        return json.loads(t)
    if t[:1] == "'":
        if len(t) < 2 or t[-1] != "'":
            raise ValueError(f"unclosed text {t!r}")
        return t[1:-1].replace("''", "'")
    if t[:1] == "[" and t[-1:] == "]":
        return [scalar(x) for x in re.split(r",\s*", t[1:-1])] if t[1:-1].strip() else []
    if t == "{}":
        return {}
    if t[:1] in ("&", "*", "!", "{", "[", "%", "@", "`"):
        raise ValueError(f"not read here: {t!r}")
    if t.lower() in _WORDS and (t == t.lower() or t == t.title() or t == t.upper()):
        return _WORDS[t.lower()]
    for kind, pattern in ((int, r"[-+]?(?:0|[1-9][0-9]*)"), (float, r"[-+]?[0-9]+\.[0-9]*(?:e[-+]?[0-9]+)?")):
        if re.fullmatch(pattern, t, re.I):
            return kind(t)
    return t


def _bare(line: str) -> str:
    """A line without its comment."""
    quoted = re.match(r"""^((?:[^"'#]|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?<=\S)#)*?)(?:\s+#.*|^#.*)?$""", line)
    return (quoted.group(1) if quoted else line).rstrip()


class _Lines:
    def __init__(self, text: str):
        self.raw, self.at = text.splitlines(), 0

    def peek(self) -> tuple[int, str] | None:
        """The indent and content of the next line that has any."""
        while self.at < len(self.raw):
            line = _bare(self.raw[self.at])
            if line.strip() and line.strip() != "---":
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise ValueError("indented by a tab")
                return len(line) - len(line.lstrip()), line.strip()
            self.at += 1
        return None

    def block(self, indent: int, folded: bool, keep: str) -> str:
        """A block text that is indented deeper than ``indent``."""
        out = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip()) > indent):
            out.append(self.raw[self.at])
            self.at += 1
        deep = min((len(x) - len(x.lstrip()) for x in out if x.strip()), default=0)
        text = "\n".join(x[deep:] for x in out)
        body = re.sub(r"(?<!\n)\n(?!\n)", " ", text.rstrip("\n")) if folded else text.rstrip("\n")
        return body + ("" if keep == "-" or not body else "\n")


def _value(lines: _Lines, indent: int, rest: str | None):
    if rest and re.fullmatch(r"[|>][-+]?", rest):
        return lines.block(indent, rest[0] == ">", rest[1:])
    if rest:
        return scalar(rest)
    below = lines.peek()
    if below and (below[0] > indent or below[0] == indent and below[1].startswith("- ")):
        return _node(lines, below[0])
    return None


def _node(lines: _Lines, indent: int):
    out = None
    while (here := lines.peek()) and here[0] == indent:
        text = here[1]
        if text == "-" or text.startswith("- "):
            if out is not None and not isinstance(out, list):
                break
            out = [] if out is None else out
            inner = text[1:].strip()
            if _KEY.match(inner) and inner[:1] not in "\"'" or inner.startswith("- "):
                deep = indent + len(text) - len(inner)
                lines.raw[lines.at] = " " * deep + inner
                out.append(_node(lines, deep))
            else:
                lines.at += 1
                out.append(_value(lines, indent, inner))
            continue
        m = _KEY.match(text)
        if not m:
            if out is None:
                lines.at += 1
                return scalar(text)
            raise ValueError(f"not a member: {text!r}")
        if isinstance(out, list):
            break  # items that stand no deeper than the member they belong to
        out = {} if out is None else out
        key = scalar(m.group(1))
        if key in out:
            raise ValueError(f"twice: {key!r}")
        lines.at += 1
        out[key] = _value(lines, indent, m.group(2))
    if here and here[0] > indent:
        raise ValueError(f"indented too deep: {here[1]!r}")
    return out


def load(text: str):
    """The value of a document; None for an empty one."""
    lines = _Lines(text)
    first = lines.peek()
    if first is None:
        return None
    value = _node(lines, first[0])
    if lines.peek():
        raise ValueError(f"left over: {lines.peek()[1]!r}")
    return value
