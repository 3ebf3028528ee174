"""Array expressions: similarity, slices, runs, offenders, order statistics. All are JVM-side columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions.kernels import segments  # noqa: F401


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: within a lambda an outer expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision; null if an array or an element is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine distance; null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def starts_with(a: Column, prefix: Column) -> Column:
    """Whether array ``a`` begins with ``prefix``."""
    return (F.size(prefix) <= F.size(a)) & (F.slice(a, F.lit(1), F.size(prefix)) == prefix)


def ends_with(a: Column, suffix: Column) -> Column:
    """Whether array ``a`` ends with ``suffix``; guarded, as a slice from before the start is empty."""
    n, k = F.size(a), F.size(suffix)
    return F.when(k <= n, F.slice(a, F.greatest(n - k + 1, F.lit(1)), k) == suffix).otherwise(False)


def indices(a: Column) -> Column:
    """0 .. size - 1; empty for a null or empty array."""
    n = F.greatest(F.size(a), F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def mask_runs(mask: Column) -> Column:
    """The runs of ones in order: array of (start, end), end exclusive."""
    on = lambda i: F.coalesce(F.get(mask, i) == 1, F.lit(False))
    starts = F.filter(indices(mask), lambda i: on(i) & ((i == 0) | ~on(i - 1)))
    ends = F.transform(F.filter(indices(mask), lambda i: on(i) & ~on(i + 1)), lambda i: i + 1)
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def offenders(finding: str, positions: Column) -> Column:
    """One finding with the first position and the count, or none: array<string>."""
    text = F.concat(F.lit(f"{finding}:first="), F.get(positions, F.lit(0)).cast("string"), F.lit(":count="), F.size(positions).cast("string"))
    return F.when(F.size(positions) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def finding(condition: Column, *text: str | Column) -> Column:
    """A finding if ``condition`` is true, or none: array<string>; null parts of the text read None."""
    parts = [F.lit(t) if isinstance(t, str) else F.coalesce(t.cast("string"), F.lit("None")) for t in text]
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def first_divergence(a: Column, b: Column) -> Column:
    """The first index at which two arrays differ, the shorter's size if it is a prefix, null if they are equal."""
    n = F.least(F.size(a), F.size(b))
    at = F.get(F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))), F.lit(0))
    return F.coalesce(at, F.when(F.size(a) != F.size(b), n))
