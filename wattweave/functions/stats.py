"""Scalar and aggregate functions whose null, zero and rounding rules differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_strict(value) -> Column:
    """Mean that is null as soon as one input of the group is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def sd_sample(value) -> Column:
    """Sample standard deviation; null for a group of one."""
    return F.stddev_samp(value)


def mean_parts(value) -> list[Column]:
    """Mergeable pieces of a mean, for aggregating before a join or a second grouping."""
    return [F.sum(value).alias("part_sum"), F.count(value).alias("part_n"), F.count(F.lit(1)).alias("part_rows")]


def mean_of_parts() -> Column:
    """Null-strict mean over rows made by ``mean_parts``."""
    total = F.sum("part_sum") / F.nullif(F.sum("part_n"), F.lit(0))
    return F.when(F.sum("part_n") == F.sum("part_rows"), total)


def log_natural(value) -> Column:
    """ln with ln(0) = -Infinity and ln(negative) = NaN; null stays null."""
    value = F.col(value) if isinstance(value, str) else value
    return (F.when(value == 0, F.lit(float("-inf")))
            .when(value < 0, F.lit(float("nan")))
            .otherwise(F.ln(value)))


def log_shifted(value) -> Column:
    """ln(value + 1) with the same edge rules as ``log_natural``."""
    value = F.col(value) if isinstance(value, str) else value
    return (F.when(value == -1, F.lit(float("-inf")))
            .when(value < -1, F.lit(float("nan")))
            .otherwise(F.log1p(value)))


def if_else(test: Column, yes, no) -> Column:
    """Two-way choice whose result is null where the test is null."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(test, yes).when(~test, no)


def round_half_even(value, digits: int = 0) -> Column:
    return F.bround(value, digits)


def is_missing(value, is_float: bool = False) -> Column:
    """True for null, and for NaN where the column is a float or double."""
    value = F.col(value) if isinstance(value, str) else value
    return value.isNull() | F.isnan(value) if is_float else value.isNull()
