"""Gap filling by Kalman smoothing with a local linear trend.

A site's series may be long, so it is cut into chunks of consecutive rows, and a chunk into runs that are filtered side
by side with their start states left symbolic. Each run becomes a small linear-Gaussian map from start state to end state
plus its share of the likelihood. Maps compose, and in any grouping: runs to chunks in a tree inside the task, chunks to
the series. The exact state at every border follows, and each run is then smoothed on its own. The values equal those
of one smoother run over the whole series.

Variances are relative to the observation noise and maximise the likelihood, per site and column: a coarse grid finds
where to begin, then a pattern search in the logarithms of both goes on, shrinking its step where it finds nothing
better, down to a sixteenth of a decade. Both stay between 1e-14 and 1e5. A round of the search is one pass over the
chunks for all sites and columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattweave.sources.shared import materialise, new_path

LEVEL_NOISE = [1e-6, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 1e3]
SLOPE_NOISE = [1e-10, 1e-6, 1e-4, 1e-2, 1.0]
GRID = [(math.log10(level), math.log10(slope)) for level in LEVEL_NOISE for slope in SLOPE_NOISE]
LOWEST, HIGHEST = (-9.0, -14.0), (5.0, 3.0)  # of the logarithms of level and slope noise
# 81 places around the best so far, nearest first: a place costs less than a further pass over the data
PATTERN = sorted(((a / 4, b / 4) for a in range(-4, 5) for b in range(-4, 5)), key=lambda x: (x[0] ** 2 + x[1] ** 2, x))
FIRST_STEP, SHRINK, LAST_STEP = 2.0, 8.0, 0.05
ROUNDS = 10  # three where no step leads to the edge of its pattern
LEAST_GAIN = 1e-3  # of the log likelihood; smaller gains say nothing on the variances
PRIOR = 1e7  # start variance, relative to the observation noise
CHUNK_ROWS = 100_000
LEAST_SEEN = 3

MAP_PARTS = 16  # numbers per setting that describe a run
BORDER = ["a1", "a2", "v11", "v12", "v22", "e1", "e2"]  # state and its variance before a chunk, state after it


def fill_by_smoothing(df: DataFrame, columns: list[str], site: str = "site_id", ts: str = "timestamp",
                      chunk_rows: int = CHUNK_ROWS, least_seen: int = LEAST_SEEN) -> DataFrame:
    """Replace the nulls of ``columns`` by the smoothed level of their site's series in time order.

    A site's column with fewer than ``least_seen`` observed values says too little about its variances and keeps its
    nulls; ``unfilled`` counts them. The scan of one site and column holds a map of some 4 KB per chunk of that site.
    """
    chunks = _chunks(df, site, ts, chunk_rows)
    fitted, keys = _fit(chunks, columns, site, ts)
    chosen = _per_chunk(keys, fitted.withColumns({"levels": F.array("level"), "slopes": F.array("slope")}), site)
    borders = _borders(_chunk_maps(chunks, chosen, columns, site, ts), site)
    return _smooth(chunks, borders, chosen, columns, site, ts, least_seen).select(*df.columns)


def fit_variances(df: DataFrame, columns: list[str], site: str = "site_id", ts: str = "timestamp",
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Maximum likelihood variances: (site, measure, level, slope, likelihood, grid_likelihood, seen), the measure being
    the column's number, level and slope the logarithms to base 10 of the noise relative to that of the observations.
    The likelihoods are logarithms up to a constant; the grid's is that of the best place of the coarse grid."""
    fitted, _ = _fit(_chunks(df, site, ts, chunk_rows), columns, site, ts)
    return fitted.select(site, "measure", "level", "slope", "likelihood", "grid_likelihood", "seen")


def unfilled(df: DataFrame, columns: list[str], site: str = "site_id") -> DataFrame:
    """(site, measure, n): the nulls left in each site's columns, where there are any."""
    counts = df.groupBy(site).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([site], columns, "measure", "n").where("n > 0")


def _chunks(df: DataFrame, site: str, ts: str, chunk_rows: int) -> DataFrame:
    n_chunks = max(1, math.ceil(df.count() / chunk_rows))
    others = [c for c in df.columns if c not in (site, ts)]
    ordered = df.withColumn("_tie", F.xxhash64(*others))
    # written out, because chunk numbers must not change when a lost partition is computed again
    return materialise(ordered.repartitionByRange(n_chunks, site, ts, "_tie").withColumn("_chunk", F.spark_partition_id()))


def _per_chunk(keys: DataFrame, fitted: DataFrame, site: str) -> DataFrame:
    """(site, _chunk, measure, levels, slopes): the places to try for each chunk and column."""
    asked = fitted.select(F.col(site).alias("_site"), "measure", "levels", "slopes")
    return keys.join(asked, F.col(site).eqNullSafe(F.col("_site"))).select(site, "_chunk", "measure", "levels", "slopes")


def _fit(chunks: DataFrame, columns: list[str], site: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """The best variances of each site and column, and the (site, _chunk) pairs."""
    keys = materialise(chunks.select(site, "_chunk").distinct())
    asked = keys.select(
        site, "_chunk", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("measure"),
        F.lit([level for level, _ in GRID]).alias("levels"), F.lit([slope for _, slope in GRID]).alias("slopes"))
    fitted = None
    for _ in range(ROUNDS):
        maps = _chunk_maps(chunks, asked, columns, site, ts)
        fitted = _written(_search(maps, fitted, site))
        if fitted.where(F.col("step") > LAST_STEP).isEmpty():
            break
        places = {"levels": F.transform(F.lit([a for a, _ in PATTERN]), lambda x: _within(F.col("level") + x * F.col("step"), 0)),
                  "slopes": F.transform(F.lit([b for _, b in PATTERN]), lambda x: _within(F.col("slope") + x * F.col("step"), 1))}
        asked = _per_chunk(keys, fitted.withColumns(places), site)
    return fitted, keys


def _written(df: DataFrame) -> DataFrame:
    """Like ``materialise``, but computed only once: a checkpoint runs its plan a second time."""
    path = new_path(df.sparkSession, "variances")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The shuffle that grouping by the keys needs, in a stated number of tasks: the rows are few and the work on them
    is not, so tasks must not be merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _within(place, which: int):
    return F.least(F.greatest(place, F.lit(LOWEST[which])), F.lit(HIGHEST[which]))


def _runs(y: np.ndarray) -> list[np.ndarray]:
    """The rows cut into runs of about the root of their number: runs of one length side by side, as
    (row in run, run, column), and the shorter last run."""
    rows, columns = y.shape
    length = max(32, math.isqrt(rows))
    whole = rows // length
    blocks = []
    if whole:
        blocks.append(y[:whole * length].reshape(whole, length, columns).transpose(1, 0, 2))
    if rows % length:
        blocks.append(y[whole * length:][:, None, :])
    return blocks


def run_maps(y: np.ndarray, level: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Maps of all runs of one chunk: (parts, run, column, setting); level and slope are (column, setting)."""
    return np.concatenate([_filter_runs(block, level, slope) for block in _runs(y)], axis=1)


def _filter_runs(y: np.ndarray, level: np.ndarray, slope: np.ndarray) -> np.ndarray:
    shape = (y.shape[1], *level.shape)
    z = np.zeros(shape)
    m1, m2, p11, p12, p22 = z, z, z, z, z
    t11, t12, t21, t22 = z + 1, z, z, z + 1
    s11, s12, s22, r1, r2, q, logdet = (z.copy() for _ in range(7))
    for seen in y[..., None]:
        hit = ~np.isnan(seen)
        noise = p11 + 1.0
        gain = hit / noise
        gap = np.where(hit, seen - m1, 0.0)
        g1, g2, told = t11 * gain, t12 * gain, gap * gain
        s11 += t11 * g1
        s12 += t11 * g2
        s22 += t12 * g2
        r1 += t11 * told
        r2 += t12 * told
        q += gap * told
        logdet += hit * np.log(noise)
        k1, k2 = p11 * gain, p12 * gain
        m1, m2 = m1 + k1 * gap, m2 + k2 * gap
        t21, t22 = t21 - k2 * t11, t22 - k2 * t12
        t11, t12 = t11 - k1 * t11, t12 - k1 * t12
        p22 = p22 - k2 * p12
        p11, p12 = p11 - k1 * p11, p12 - k1 * p12
        m1, t11, t12 = m1 + m2, t11 + t21, t12 + t22
        p11, p12, p22 = p11 + 2 * p12 + p22 + level, p12 + p22, p22 + slope
    return np.stack([m1, m2, t11, t12, t21, t22, p11, p12, p22, s11, s12, s22, r1, r2, q, logdet])


def _square(a, b, c, d) -> np.ndarray:
    """2 × 2 matrices in the last two axes."""
    return np.stack([np.stack([a, b], -1), np.stack([c, d], -1)], -2)


def _times(matrices: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (matrices @ vectors[..., None])[..., 0]


def _turned(matrices: np.ndarray) -> np.ndarray:
    return np.swapaxes(matrices, -1, -2)


def _unpack(parts: np.ndarray):
    """Shift, move and spread of the end state; information, its shift, fit and log determinant on the start state."""
    m1, m2, t11, t12, t21, t22, p11, p12, p22, s11, s12, s22, r1, r2, q, logdet = parts
    return (np.stack([m1, m2], -1), _square(t11, t12, t21, t22), _square(p11, p12, p12, p22),
            _square(s11, s12, s12, s22), np.stack([r1, r2], -1), q, logdet)


def _condition(state, spread, info, shift, q, logdet):
    """A state and its spread after what a map says on it, with the map's share of fit and log determinant."""
    told = _times(info, state)
    rest = shift - told
    blend = np.eye(2) + info @ spread
    narrowed = spread @ np.linalg.inv(blend)
    narrowed = (narrowed + _turned(narrowed)) / 2
    gain = _times(narrowed, rest)
    fit = q - 2 * (shift * state).sum(-1) + (state * told).sum(-1) - (rest * gain).sum(-1)
    return state + gain, narrowed, fit, logdet + np.log(np.linalg.det(blend))


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The map of two that follow each other; any axes after the parts."""
    m, move, spread, info, shift, q, logdet = _unpack(first)
    m_b, move_b, spread_b, info_b, shift_b, q_b, logdet_b = _unpack(second)
    known, narrowed, fit, det = _condition(m, spread, info_b, shift_b, q_b, logdet_b)
    kept = np.linalg.inv(np.eye(2) + info_b @ spread)  # of what the second says, the part that is on the first's start
    through = move_b @ _turned(kept)
    after = m_b + _times(move_b, known)
    moved = through @ move
    spread = move_b @ narrowed @ _turned(move_b) + spread_b
    told = _turned(move) @ kept
    info = info + told @ info_b @ move
    shift = shift + _times(told, shift_b - _times(info_b, m))
    return np.stack([after[..., 0], after[..., 1], moved[..., 0, 0], moved[..., 0, 1], moved[..., 1, 0], moved[..., 1, 1],
                     spread[..., 0, 0], (spread[..., 0, 1] + spread[..., 1, 0]) / 2, spread[..., 1, 1],
                     info[..., 0, 0], (info[..., 0, 1] + info[..., 1, 0]) / 2, info[..., 1, 1],
                     shift[..., 0], shift[..., 1], q + fit, logdet + det])


def composed(maps: np.ndarray) -> np.ndarray:
    """One map of the maps along the second axis, in order, by a tree of pairs."""
    while maps.shape[1] > 1:
        pairs = maps.shape[1] // 2
        merged = compose(maps[:, 0:2 * pairs:2], maps[:, 1:2 * pairs:2])
        maps = np.concatenate([merged, maps[:, 2 * pairs:]], axis=1)
    return maps[:, 0]


def scan_maps(maps: np.ndarray, state: np.ndarray, spread: np.ndarray, end: np.ndarray | None = None):
    """State and spread before each map along the second axis, and the smoothed state after it; `end` is the state after
    the last (None: as predicted)."""
    steps = []
    for parts in np.moveaxis(maps, 1, 0):
        m, move, own, info, shift, q, logdet = _unpack(parts)
        known, narrowed, _, _ = _condition(state, spread, info, shift, q, logdet)
        carried = narrowed @ _turned(move)
        after, after_spread = m + _times(move, known), move @ carried + own
        steps.append((state, spread, known, carried @ np.linalg.pinv(after_spread), after))
        state, spread = after, (after_spread + _turned(after_spread)) / 2
    end = state if end is None else end
    ends = []
    for _, _, known, back, after in reversed(steps):
        ends.append(end)
        end = known + _times(back, end - after)
    return np.stack([s[0] for s in steps]), np.stack([s[1] for s in steps]), np.stack(ends[::-1])


def _series(rows: pd.DataFrame, columns: list[str], ts: str) -> np.ndarray:
    return rows.sort_values([ts, "_tie"])[columns].to_numpy(dtype=float)


def _noises(asked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Level and slope noise as (column, setting)."""
    asked = asked.sort_values("measure")
    return 10.0 ** np.stack(asked["levels"].to_list()), 10.0 ** np.stack(asked["slopes"].to_list())


def _chunk_maps(chunks: DataFrame, asked: DataFrame, columns: list[str], site: str, ts: str) -> DataFrame:
    """The map of each chunk and column for each of the places asked for."""
    site_type = chunks.schema[site].dataType.simpleString()

    def summarise(key, rows: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        y = _series(rows, columns, ts)
        places = places.sort_values("measure")
        maps = composed(run_maps(y, *_noises(places))).transpose(1, 0, 2).reshape(len(columns), -1)
        seen = ~np.isnan(y)
        counts = seen.sum(0)
        return pd.DataFrame({
            site: key[0], "_chunk": key[1], "measure": np.arange(len(columns)), "n": counts,
            "first": [y[seen[:, c], c][0] if counts[c] else np.nan for c in range(len(columns))],
            "levels": places["levels"].to_list(), "slopes": places["slopes"].to_list(), "map": list(maps)})

    schema = (f"{site} {site_type}, _chunk int, measure int, n long, first double, levels array<double>, slopes array<double>, "
              "map array<double>")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # both sides descend from one frame
    return (_dealt(chunks, site, "_chunk").groupBy(site, "_chunk").cogroup(asked.groupBy(site, "_chunk"))
            .applyInPandas(summarise, schema))


def _whole(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of one site and column the maps in order as (part, chunk, setting), the start state, its spread and the count."""
    rows = rows.sort_values("_chunk")
    maps = np.stack([np.asarray(flat).reshape(MAP_PARTS, -1) for flat in rows["map"]], axis=1)
    seen, width = rows["first"].dropna(), maps.shape[2]
    state = np.zeros((width, 2))
    state[:, 0] = seen.iloc[0] if len(seen) else 0.0
    return maps, state, np.tile(np.eye(2) * PRIOR, (width, 1, 1)), int(rows["n"].sum())


def _search(maps: DataFrame, fitted: DataFrame | None, site: str) -> DataFrame:
    """The best place of each site and column among those tried, and the step for the next round."""
    site_type = maps.schema[site].dataType.simpleString()

    def choose(key, rows: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        chunk_maps, state, spread, n = _whole(rows)
        _, _, _, info, shift, q, logdet = _unpack(composed(chunk_maps))
        _, _, fit, logdet = _condition(state, spread, info, shift, q, logdet)
        value = -0.5 * (n * np.log(np.maximum(fit, 1e-300) / n) + logdet) if n else np.zeros(len(fit))
        value = np.where(np.isfinite(value), value, -np.inf)
        at = int(np.argmax(value >= value.max() - LEAST_GAIN))  # of equals the first, which is nearest to the centre
        level, slope = rows["levels"].iloc[0][at], rows["slopes"].iloc[0][at]
        if before is None or not len(before):
            step, reached, grid = FIRST_STEP, value[at], value[at]
        else:
            old = before.iloc[0]
            reached, grid = value[at], old["grid_likelihood"]
            on_edge = max(map(abs, PATTERN[at])) == 1.0
            step = old["step"] if on_edge and reached > old["likelihood"] + LEAST_GAIN else old["step"] / SHRINK
        if n == 0:
            step = 0.0
        return pd.DataFrame({site: [key[0]], "measure": [key[1]], "level": [level], "slope": [slope], "step": [step],
                             "likelihood": [reached], "grid_likelihood": [grid], "seen": [n]})

    schema = f"{site} {site_type}, measure int, level double, slope double, step double, likelihood double, grid_likelihood double, seen long"
    grouped = _dealt(maps, site, "measure").groupBy(site, "measure")
    if fitted is None:
        return grouped.applyInPandas(lambda key, rows: choose(key, rows, None), schema)
    return grouped.cogroup(fitted.groupBy(site, "measure")).applyInPandas(choose, schema)


def _borders(maps: DataFrame, site: str) -> DataFrame:
    """State before and after every chunk under the variances of each site and column."""
    site_type = maps.schema[site].dataType.simpleString()

    def scan(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_chunk")
        chunk_maps, state, spread, n = _whole(rows)
        states, spreads, ends = (x[:, 0] for x in scan_maps(chunk_maps, state, spread))
        table = np.column_stack([states, spreads[:, 0, 0], spreads[:, 0, 1], spreads[:, 1, 1], ends])
        return pd.DataFrame(table, columns=BORDER).assign(**{
            site: key[0], "_chunk": rows["_chunk"].to_numpy(), "measure": key[1], "seen": n})

    schema = f"{site} {site_type}, _chunk int, measure int, seen long, " + ", ".join(f"{c} double" for c in BORDER)
    return maps.groupBy(site, "measure").applyInPandas(scan, schema)


def smooth_series(y: np.ndarray, level, slope, start: np.ndarray, spread: np.ndarray, end: np.ndarray | None = None):
    """Smoothed level per row and column; start and spread describe the state of the first row, end that of the row
    after the last (None: as predicted). Columns are independent and computed side by side."""
    rows, columns = y.shape
    a1, a2 = start.T.copy()
    p11, p12, p22 = spread.T.copy()
    kept = np.empty((rows, 10, columns))
    for t in range(rows):
        hit = ~np.isnan(y[t])
        gain = hit / (p11 + 1.0)
        gap = np.where(hit, np.nan_to_num(y[t]) - a1, 0.0)
        k1, k2 = p11 * gain, p12 * gain
        f1, f2 = a1 + k1 * gap, a2 + k2 * gap
        g22 = p22 - k2 * p12
        g11, g12 = p11 - k1 * p11, p12 - k1 * p12
        a1, a2 = f1 + f2, f2
        p11, p12, p22 = g11 + 2 * g12 + g22 + level, g12 + g22, g22 + slope
        kept[t] = f1, f2, g11, g12, g22, a1, a2, p11, p12, p22
    s1, s2 = (a1, a2) if end is None else end.T
    out = np.empty((rows, columns))
    for t in range(rows - 1, -1, -1):
        f1, f2, g11, g12, g22, b1, b2, p11, p12, p22 = kept[t]
        det = p11 * p22 - p12 * p12
        flat = det <= 1e-14 * p11 * p22
        safe = np.where(flat, 1.0, det)
        d1, d2 = s1 - b1, s2 - b2
        w1, w2 = (p22 * d1 - p12 * d2) / safe, (p11 * d2 - p12 * d1) / safe
        s1 = np.where(flat, s1 - s2, f1 + (g11 + g12) * w1 + g12 * w2)
        s2 = np.where(flat, s2, f2 + (g12 + g22) * w1 + g22 * w2)
        out[t] = s1
    return out


def smooth_chunk(y: np.ndarray, level: np.ndarray, slope: np.ndarray, start: np.ndarray, spread: np.ndarray,
                 end: np.ndarray) -> np.ndarray:
    """``smooth_series`` of a chunk with its runs side by side."""
    full = _square(spread[:, 0], spread[:, 1], spread[:, 1], spread[:, 2])
    states, spreads, ends = scan_maps(run_maps(y, level[:, None], slope[:, None])[..., 0], start, full, end)
    out, at = [], 0
    for block in _runs(y):
        length, runs, columns = block.shape
        mine = slice(at, at + runs)
        v = spreads[mine].reshape(-1, 2, 2)
        smoothed = smooth_series(block.reshape(length, -1), np.tile(level, runs), np.tile(slope, runs), states[mine].reshape(-1, 2),
                                 np.column_stack([v[:, 0, 0], v[:, 0, 1], v[:, 1, 1]]), ends[mine].reshape(-1, 2))
        out.append(smoothed.reshape(length, runs, columns).transpose(1, 0, 2).reshape(-1, columns))
        at += runs
    return np.concatenate(out)


def _smooth(chunks: DataFrame, borders: DataFrame, chosen: DataFrame, columns: list[str], site: str, ts: str,
            least_seen: int) -> DataFrame:
    known = chosen.select(F.col(site).alias("_site"), F.col("_chunk").alias("_of"), F.col("measure").alias("_measure"), "levels", "slopes")
    borders = borders.join(known, F.col(site).eqNullSafe(F.col("_site")) & (F.col("_chunk") == F.col("_of"))
                           & (F.col("measure") == F.col("_measure"))).drop("_site", "_of", "_measure")

    def fill(rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ts, "_tie"])
        border = border.sort_values("measure")
        y = rows[columns].to_numpy(dtype=float)
        level, slope = _noises(border)
        smoothed = smooth_chunk(y, level[:, 0], slope[:, 0], border[["a1", "a2"]].to_numpy(),
                                border[["v11", "v12", "v22"]].to_numpy(), border[["e1", "e2"]].to_numpy())
        enough = (border["seen"] >= least_seen).to_numpy()
        rows[columns] = np.where(np.isnan(y) & enough, smoothed, y)
        return rows

    return (_dealt(chunks, site, "_chunk").groupBy(site, "_chunk").cogroup(borders.groupBy(site, "_chunk"))
            .applyInPandas(fill, chunks.schema))
