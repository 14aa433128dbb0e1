"""Exact order statistics by narrowing brackets, and the summaries built on them.

One aggregate gives counts and extremes. While a bracket around a wanted rank holds more than ``limit``
rows, a quantile sketch proposes a tighter one and a count proves where the rank lies. Inside the last
bracket equal values are counted, so a value that fills a third of the column is one row. No pass sorts or
moves the column; ranks are exact whatever the distribution.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 1_000_000
ACCURACY = 10_000


@dataclass(frozen=True)
class Extent:
    """Counts and extremes of one column; NaN counts as missing."""

    n: int
    missing: int
    low: float | None
    high: float | None
    mean: float | None
    sd: float | None


@dataclass(frozen=True)
class Bracket:
    """Values of a column in [low, high]: the wanted rank is the ``rank - below``-th of ``inside`` rows."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    slack: float


def numeric(column: str):
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def extents(df: DataFrame, columns: list[str]) -> dict[str, Extent]:
    """One pass over the table for all columns."""
    stats = []
    for c in columns:
        x = numeric(c)
        stats.append(F.struct(F.count(x).alias("n"), F.count_if(x.isNull()).alias("missing"), F.min(x).alias("low"),
                              F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).alias(c))
    row = df.agg(*stats).first()
    return {c: Extent(**row[c].asDict()) for c in columns}


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], known: dict[str, Extent] | None = None,
                     limit: int = LIMIT, accuracy: int = ACCURACY) -> dict[tuple[str, int], float]:
    """The rank-th smallest value (1-based) for every column and rank asked for."""
    known = known or extents(df, list(ranks))
    open_, done = [], {}
    for column, wanted in ranks.items():
        e = known[column]
        for rank in sorted(set(wanted)):
            if not 1 <= rank <= e.n:
                raise ValueError(f"{column} has {e.n} values, no rank {rank}")
            open_.append(Bracket(column, rank, e.low, e.high, 0, e.n, 2.0 / accuracy))
    while True:
        for b in [b for b in open_ if b.low == b.high]:
            done[b.column, b.rank] = b.low
        open_ = [b for b in open_ if b.low < b.high]
        wide = [b for b in open_ if b.inside > limit]
        if not wide:
            break
        open_ = [b for b in open_ if b.inside <= limit] + _narrow(df, wide, accuracy)
    return done | _read_off(df, open_)


def _narrow(df: DataFrame, wide: list[Bracket], accuracy: int) -> list[Bracket]:
    sketches = []
    for i, b in enumerate(wide):
        x, at = numeric(b.column), (b.rank - b.below) / b.inside
        inside = F.when(x.between(b.low, b.high), x)
        sketches.append(F.percentile_approx(inside, [max(0.0, at - b.slack), min(1.0, at + b.slack)], accuracy)
                        .alias(f"s{i}"))
    near = df.agg(*sketches).first()
    proofs = []
    for i, b in enumerate(wide):
        low, high = near[f"s{i}"]
        x = numeric(b.column)
        proofs += [F.count_if(x < low).alias(f"b{i}"), F.count_if(x <= high).alias(f"e{i}")]
    counted = df.agg(*proofs).first()
    out = []
    for i, b in enumerate(wide):
        (low, high), below, upto = near[f"s{i}"], counted[f"b{i}"], counted[f"e{i}"]
        if b.rank <= below:  # the sketch missed to the right
            tighter = replace(b, high=math.nextafter(low, -math.inf), inside=below - b.below, slack=b.slack * 4)
        elif b.rank > upto:  # the sketch missed to the left
            tighter = replace(b, low=math.nextafter(high, math.inf), below=upto,
                              inside=b.inside - (upto - b.below), slack=b.slack * 4)
        else:
            tighter = replace(b, low=low, high=high, below=below, inside=upto - below)
        if tighter.inside == b.inside:  # no progress: halve the value range instead of the ranks
            tighter = _halve(df, b)
        out.append(tighter)
    return out


def _halve(df: DataFrame, b: Bracket) -> Bracket:
    x, middle = numeric(b.column), b.low + (b.high - b.low) / 2
    row = df.agg(F.count_if(x <= middle).alias("upto"), F.max(F.when(x <= middle, x)).alias("left"),
                 F.min(F.when(x > middle, x)).alias("right")).first()
    if b.rank <= row["upto"]:
        return replace(b, high=row["left"], inside=row["upto"] - b.below)
    return replace(b, low=row["right"], below=row["upto"], inside=b.inside - (row["upto"] - b.below))


def _read_off(df: DataFrame, brackets: list[Bracket]) -> dict[tuple[str, int], float]:
    if not brackets:
        return {}
    spans: dict[tuple[str, float, float], list[Bracket]] = {}
    for b in brackets:
        spans.setdefault((b.column, b.low, b.high), []).append(b)
    entries, wanted = [], F.lit(False)
    for i, ((column, low, high), members) in enumerate(spans.items()):
        x = numeric(column)
        entries.append(F.struct(F.lit(i).alias("span"), F.when(x.between(low, high), x).alias("value")))
        for b in members:
            at = b.rank - b.below
            wanted = wanted | ((F.col("span") == i) & (F.col("before") < at) & (F.col("upto") >= at))
    counts = (df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
              .groupBy("span", "value").agg(F.count(F.lit(1)).alias("n")))
    running = Window.partitionBy("span").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = (counts.withColumn("upto", F.sum("n").over(running))
             .withColumn("before", F.col("upto") - F.col("n")).where(wanted).collect())
    out = {}
    for i, members in enumerate(spans.values()):
        for b in members:
            at = b.rank - b.below
            out[b.column, b.rank] = next(r["value"] for r in found if r["span"] == i and r["before"] < at <= r["upto"])
    return out


def _interpolation(n: int, p: float) -> tuple[int, int, float]:
    """Neighbouring ranks and weight of the quantile at position (n - 1) p + 1."""
    position = (n - 1) * p
    lower = math.floor(position)
    return lower + 1, min(lower + 2, n), position - lower


def quantiles(df: DataFrame, columns: list[str], probs: list[float], known: dict[str, Extent] | None = None,
              limit: int = LIMIT) -> dict[tuple[str, float], float | None]:
    """Interpolated quantiles of every column; None for a column without values."""
    known = known or extents(df, columns)
    plan = {c: {p: _interpolation(known[c].n, p) for p in probs} for c in columns if known[c].n}
    values = order_statistics(df, {c: [r for lo, hi, _ in at.values() for r in (lo, hi)] for c, at in plan.items()},
                              known, limit)
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in columns for p in probs}
    for c, at in plan.items():
        for p, (lo, hi, weight) in at.items():
            out[c, p] = values[c, lo] + (values[c, hi] - values[c, lo]) * weight
    return out


def column_summary(df: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """Per column: min, quartiles, mean, max and the number of missing values."""
    known = extents(df, columns)
    q = quantiles(df, columns, [0.25, 0.5, 0.75], known, limit)
    rows = [(c, e.low, q[c, 0.25], q[c, 0.5], e.mean, q[c, 0.75], e.high, e.missing) for c, e in known.items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, q1 double, median double, mean double, q3 double, max double, missing long")


@dataclass(frozen=True)
class Fences:
    """Box-plot hinges and the bounds beyond which a value is an outlier."""

    lower_hinge: float
    upper_hinge: float
    lower: float
    upper: float


def box_fences(df: DataFrame, column: str, spread: float = 1.5, limit: int = LIMIT) -> Fences | None:
    """Hinges by Tukey's rule (means of order statistics), fences at ``spread`` hinge distances; None if empty."""
    known = extents(df, [column])
    n = known[column].n
    if n == 0:
        return None
    depth = math.floor((n + 3) / 2) / 2
    near, far = math.floor(depth), math.ceil(depth)
    ranks = [near, far, n + 1 - near, n + 1 - far]
    value = order_statistics(df, {column: ranks}, known, limit)
    low = (value[column, near] + value[column, far]) / 2
    high = (value[column, n + 1 - near] + value[column, n + 1 - far]) / 2
    reach = spread * (high - low)
    return Fences(low, high, low - reach, high + reach)


def outliers(df: DataFrame, column: str, limit: int = LIMIT) -> DataFrame:
    """Rows outside the box-plot fences."""
    fences = box_fences(df, column, limit=limit)
    if fences is None:
        return df.where(F.lit(False))
    return df.where((F.col(column) < fences.lower) | (F.col(column) > fences.upper))


def without_outliers(df: DataFrame, column: str, limit: int = LIMIT) -> DataFrame:
    """Rows inside the fences and rows without a value; all rows where there is no outlier."""
    fences = box_fences(df, column, limit=limit)
    if fences is None:
        return df
    value = F.col(column)
    return df.where(value.isNull() | value.between(fences.lower, fences.upper))
