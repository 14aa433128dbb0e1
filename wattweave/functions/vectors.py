"""Row-vector functions on ARRAY<DOUBLE> columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``; inside a lambda it would be evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def row_zscore(values) -> Column:
    """Centre and scale the elements of one row (sample sd). Null elements stay null and do not count.

    A row of equal values, or with fewer than two values, has no scale: all its elements become null.
    """
    values = F.col(values) if isinstance(values, str) else values

    def scaled(mean: Column) -> Column:
        squares = array_total(F.transform(F.filter(values, lambda v: v.isNotNull()),
                                          lambda v: (v - mean) * (v - mean)))
        freedom = F.size(F.filter(values, lambda v: v.isNotNull())) - 1
        sd = F.when(freedom > 0, F.sqrt(squares / F.nullif(freedom, F.lit(0))))
        return bind(F.nullif(sd, F.lit(0.0)), lambda s: F.transform(values, lambda v: (v - mean) / s))

    seen = F.filter(values, lambda v: v.isNotNull())
    return bind(array_total(seen) / F.nullif(F.size(seen), F.lit(0)), scaled)


def euclidean(left, right) -> Column:
    """Distance over the positions present on both sides, scaled up by length / positions used."""
    left = F.col(left) if isinstance(left, str) else left
    right = F.col(right) if isinstance(right, str) else right
    gaps = F.filter(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)), lambda v: v.isNotNull())
    return bind(gaps, lambda g: F.sqrt(array_total(g) * F.size(left) / F.nullif(F.size(g), F.lit(0))))


def is_complete(values) -> Column:
    """True where the array exists and holds neither null nor NaN."""
    values = F.col(values) if isinstance(values, str) else values
    return values.isNotNull() & ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
