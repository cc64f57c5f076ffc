"""Numeric and array functions, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)``, with ``value`` found once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; with a zero vector 0 if both are equal, else 1."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.when(a == b, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(1 - dot(a, b) / F.nullif(size, F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(float("nan")))


def percent(errors: Column, total: Column) -> Column:
    return ratio(100.0 * errors, total)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Seconds that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start))


def tiles(seconds: Column, window: float = 30.0) -> Column:
    """Boundaries between full windows in a recording of so many seconds."""
    return F.greatest(F.lit(0), F.ceil(seconds / F.lit(window)) - 1)


def repeated_next(tokens: Column, n: int) -> Column:
    """Tokens that would complete an n-gram that already occurs."""
    size = F.size(tokens)
    prefix = F.slice(tokens, F.greatest(size - n + 2, F.lit(1)), F.lit(n - 1))
    starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(tokens, i, F.lit(n - 1)) == prefix)
    return F.array_sort(F.array_distinct(F.transform(hits, lambda i: F.element_at(tokens, i + (n - 1)))))
