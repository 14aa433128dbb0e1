"""Tables behind histograms, density curves and ordered bars.

Rows are reduced to a fixed number of bins before any shuffle; bin edges are scalars from one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattweave.operators.order_stats import LIMIT, extents, numeric, quantiles

GRID = 512  # points of a density curve
REACH = 4  # bandwidths by which the evaluation grid exceeds the data
FUZZ = 1e-8  # share of a bin width within which a value counts as lying on the edge


def density_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins, closed on the right, one edge at half a width from zero: (bin, low, high, n, density).

    The width is range / (bins - 1), so that the first and last bin overhang the data.
    """
    e = extents(df, [column])[column]
    if e.n == 0:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long, density double")
    width = (e.high - e.low) / (bins - 1) if e.high > e.low else 0.1
    origin = width / 2 + math.floor((e.low - width / 2) / width) * width
    place = F.ceil((numeric(column) - F.lit(origin)) / F.lit(width) - F.lit(FUZZ))
    counts = (df.where(numeric(column).isNotNull())
              .groupBy(F.greatest(place, F.lit(1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    return counts.select(
        "bin", (F.lit(origin) + (F.col("bin") - 1) * width).alias("low"),
        (F.lit(origin) + F.col("bin") * width).alias("high"), "n",
        (F.col("n") / F.lit(float(e.n)) / F.lit(width)).alias("density"))


def round_edges(low: float, high: float, cells: int) -> tuple[float, float]:
    """First edge and width of about ``cells`` bins whose edges are round numbers (1, 2 or 5 times a power of ten)."""
    if high <= low:
        return low - 0.5, 1.0
    raw = (high - low) / cells
    power = 10.0 ** math.floor(math.log10(raw))
    # A larger step wins once the raw width passes this share of it (bias 1.5, 2.75 for fives).
    width = power
    for step, bias in ((2.0, 1.5), (5.0, 2.75), (10.0, 1.5)):
        if step * power - raw < bias * (raw - width):
            width = step * power
    return math.floor(low / width + 1e-7) * width, width


def count_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts in round-edged bins, closed on the right, the lowest value included: (bin, low, high, n)."""
    e = extents(df, [column])[column]
    if e.n == 0:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    cells = math.ceil(math.log2(e.n) + 1)
    first, width = round_edges(e.low, e.high, cells)
    place = F.greatest(F.ceil((numeric(column) - F.lit(first)) / F.lit(width) - F.lit(FUZZ)), F.lit(1))
    counts = (df.where(numeric(column).isNotNull())
              .groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    return counts.select("bin", (F.lit(first) + (F.col("bin") - 1) * width).alias("low"),
                         (F.lit(first) + F.col("bin") * width).alias("high"), "n")


def bandwidth(n: int, sd: float, iqr: float) -> float:
    """Rule of thumb: 0.9 min(sd, IQR / 1.34) n^(-1/5), with fallbacks where the spread is zero."""
    spread = min(sd or 0.0, iqr / 1.34) or sd or 1.0
    return 0.9 * spread * n ** -0.2


def kernel_density(df: DataFrame, column: str, limit: int = LIMIT) -> DataFrame:
    """Gaussian kernel density at 512 equally spaced points from min to max: (point, x, density).

    Values are shared linearly between the two nearest of 512 grid points; each grid point then adds its kernel
    to the curve. Both sizes are constants, so only the first aggregate grows with the data.
    """
    e = extents(df, [column])[column]
    if e.n == 0:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    q = quantiles(df, [column], [0.25, 0.75], {column: e}, limit)
    bw = bandwidth(e.n, e.sd, q[column, 0.75] - q[column, 0.25])
    start = e.low - REACH * bw
    step = (e.high - e.low + 2 * REACH * bw) / (GRID - 1)
    out_step = (e.high - e.low) / (GRID - 1)

    at = (numeric(column) - F.lit(start)) / F.lit(step)
    shares = df.where(numeric(column).isNotNull()).select(
        F.floor(at).cast("int").alias("cell"), (at - F.floor(at)).alias("right"))
    cells = shares.groupBy("cell").agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("n"))
    weights = (cells.select(F.inline(F.array(
        F.struct(F.col("cell").alias("grid"), (F.col("n") - F.col("right")).alias("w")),
        F.struct((F.col("cell") + 1).alias("grid"), F.col("right").alias("w")))))
        .groupBy("grid").agg(F.sum("w").alias("w")))

    def kernel(position):
        """Kernel of this grid point at another grid position, in units of the data."""
        z = (position - F.col("grid")) * F.lit(step / bw)
        return F.exp(-0.5 * z * z) * F.lit(1 / (bw * math.sqrt(2 * math.pi)))

    spread = weights.select("grid", "w", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("point"))
    place = (F.lit(e.low - start) + F.col("point") * F.lit(out_step)) / F.lit(step)
    left = F.least(F.floor(place), F.lit(GRID - 2))
    curve = spread.withColumns({"left": left, "part": place - left})
    height = F.col("w") * ((1 - F.col("part")) * kernel(F.col("left")) + F.col("part") * kernel(F.col("left") + 1))
    return (curve.groupBy("point").agg((F.sum(height) / F.lit(float(e.n))).alias("density"))
            .select(F.col("point"), (F.lit(e.low) + F.col("point") * F.lit(out_step)).alias("x"), "density"))


def in_order_of(df: DataFrame, value: str) -> DataFrame:
    """Categories in ascending order of their value, with their position. One row per category is expected."""
    position = F.row_number().over(Window.orderBy(value))
    return df.withColumn("position", position).orderBy("position")
