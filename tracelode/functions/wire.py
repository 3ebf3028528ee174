"""Raw JSON: canonical hashes, content flattening, element kinds, by Arrow-batched functions.

Spark's JSON readers don't tell 1 from "1", 1.0 or true, nor null from absent; these read the text.
None of them fails on any content.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _load(text):
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def canonical(value) -> str | None:
    """Sorted, compact JSON without escapes; None if a number isn't finite or a character can't be encoded."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        text.encode()
        return text
    except (ValueError, TypeError, RecursionError):
        return None


def spoken(value, within: bool = False) -> Iterator[str]:
    """The strings that a content value says, in order: itself, a part's text, those of a list's strings and parts."""
    match value:
        case str():
            yield value
        case {"text": str(text)}:
            yield text
        case [*items] if not within:
            for item in items:
                yield from spoken(item, True)


def flatten(value) -> str:
    """A content value as text; empty if it says nothing."""
    return "".join(spoken(value))


def kind(value) -> str:
    """null, bool, int, float, nonfinite, string, list or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float" if math.isfinite(value) else "nonfinite"
    return "string" if isinstance(value, str) else "list" if isinstance(value, list) else "object"


@pandas_udf(T.StringType())
def canonical_hash(text: pd.Series) -> pd.Series:
    """sha256 of the canonical form of each JSON text, null where it has none."""

    def one(t):
        try:
            value = json.loads(t)
        except (TypeError, ValueError, RecursionError):
            return None
        form = canonical(value)
        return hashlib.sha256(form.encode()).hexdigest() if form is not None else None

    return text.map(one, na_action="ignore")


@pandas_udf(T.StringType())
def flatten_content(text: pd.Series) -> pd.Series:
    """The text behind each JSON content value."""
    return text.map(lambda t: flatten(_load(t)), na_action="ignore")


@pandas_udf(T.ArrayType(T.StringType()))
def element_kinds(text: pd.Series) -> pd.Series:
    """The kind of each element of a JSON array, null if the text isn't one."""
    return text.map(lambda t: [kind(v) for v in value] if isinstance(value := _load(t), list) else None, na_action="ignore")


@pandas_udf(T.ArrayType(T.StringType()))
def member_names(text: pd.Series) -> pd.Series:
    """The member names of a JSON object, null members too; null if the text isn't one."""
    return text.map(lambda t: sorted(value) if isinstance(value := _load(t), dict) else None, na_action="ignore")
