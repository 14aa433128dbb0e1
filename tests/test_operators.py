"""Semantics that the star-schema tables cannot show."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattweave.operators import clustering, discriminant, kalman, knn, linkage, models, reshape
from wattweave.plans.classify import classify
from wattweave.sources import tables
from wattweave.sources.schemas import BUILDINGS
from wattweave.sources.shared import materialise, shuffles_dropped


def naive_complete_linkage(points: dict[int, np.ndarray]) -> list[tuple[int, int, float]]:
    clusters, out = {k: [v] for k, v in points.items()}, []
    while len(clusters) > 1:
        height, a, b = min((max(float(np.sqrt(((p - q) ** 2).sum())) for p in clusters[a] for q in clusters[b]), a, b)
                           for a in clusters for b in clusters if a < b)
        out.append((a, b, height))
        clusters[a] += clusters.pop(b)
    return sorted(out)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=4) for i in range(40)}
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "id long, features array<double>")


@pytest.mark.parametrize(("block", "finish"), [(8, 256), (16, 20)])
def test_complete_linkage_equals_the_naive_tree(points, block, finish):
    rows, df = points
    got = sorted((r.kept, r.gone, r.height) for r in linkage.complete_linkage(df, "id", block, finish).collect())
    want = naive_complete_linkage(rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-12)


def test_linkage_goes_by_several_tasks_and_clusters_larger_than_a_block(spark):
    rng = np.random.default_rng(8)
    x, of = rng.normal(size=(120, 3)), np.concatenate([np.zeros(60, int), np.arange(60) % 4 + 1])
    members = materialise(spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, of))],
                                                "key long, features array<double>, cluster long"))
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    most = np.array([[gaps[np.ix_(of == a, of == b)].max() for b in range(5)] for a in range(5)])
    met = linkage._meet_blocks(members, members, 120, 16, linkage._block_gaps, "one long, other long, distance double", half=True)
    got = {(r.one, r.other): r.distance for r in met.groupBy("one", "other").agg(F.max("distance").alias("distance")).collect()}
    assert got == {(a, b): pytest.approx(most[a, b], rel=1e-12) for a in range(5) for b in range(a + 1, 5)}
    np.fill_diagonal(most, np.inf)
    near = {r.cluster: (r.near, r.distance) for r in linkage._search(members, members, 120, 16).collect()}
    assert near == {a: (most[a].argmin(), pytest.approx(most[a].min(), rel=1e-12)) for a in range(5)}
    assert met.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_size_estimates_do_not_grow_over_the_rounds(points, monkeypatch):
    _, df = points
    sizes, kept = [], linkage.rewritten

    def watched(frame):
        out = kept(frame)
        sizes.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return out

    monkeypatch.setattr(linkage, "rewritten", watched)
    assert linkage.complete_linkage(df, "id", 16, finish=20).count() == 39
    assert len(sizes) > 5 and max(sizes) < 1_000_000


def test_linkage_by_limits_needs_no_search_of_all_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=5) + 6 * (i % 3) for i in range(80)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "id long, features array<double>")
    limits, close = [], linkage._close_pairs
    monkeypatch.setattr(linkage, "_search", None)  # the rounds that compared all blocks with all blocks
    monkeypatch.setattr(linkage, "_close_pairs", lambda m, n, b, limit: limits.append(limit) or close(m, n, b, limit))
    tree = linkage.complete_linkage(df, "id", 40, finish=25).collect()
    got = sorted((r.kept, r.gone, r.height) for r in tree)
    want = naive_complete_linkage(rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-12, atol=0)
    assert 1 < len(limits) < 10 and limits == sorted(limits) and np.isfinite(limits[0]) and limits[-1] == np.inf
    assert all(r.step > c.step for r in tree for c in tree if c.kept == r.gone)


def test_linkage_where_no_limit_parts_the_pairs(spark):
    places = [np.array([i % 5, i // 5], float) for i in range(20)]  # equal distances all over
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(places)], "id long, features array<double>")
    tree = sorted(linkage.complete_linkage(df, "id", 16, finish=4).collect(), key=lambda r: r.step)
    clusters = {i: [v] for i, v in enumerate(places)}
    for r in tree:
        a, b = clusters[r.kept], clusters.pop(r.gone)
        assert r.kept < r.gone and r.height == max(np.sqrt(((p - q) ** 2).sum()) for p in a for q in b)
        a += b
    assert len(tree) == 19 and len(clusters) == 1


@pytest.mark.parametrize("itself", [True, False])
@pytest.mark.parametrize("limit", [3.0, np.inf])
def test_block_close_equals_all_pairs_by_differences(monkeypatch, itself, limit):
    for name, value in (("UNIT_ROWS", 5), ("TILE_ROWS", 7), ("TILE_COLUMNS", 9), ("EXACT_PAIRS", 10)):
        monkeypatch.setattr(linkage, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) + 1_000
    x[30:45] = x[:15] + 1e-7 * rng.normal(size=(15, 4))  # products know no more than a rounding of these distances
    of = np.concatenate([np.arange(25), rng.integers(25, 31, 35)])
    table = pa.table({"cluster": of, "features": pa.array(list(x), pa.list_(pa.float64())), "size": np.bincount(of)[of]})
    some = np.ones(60, bool) if itself else rng.random(60) < 0.5
    sides = (some, some if itself else ~some)
    left, right = (table.filter(pa.array(side)).append_column("a", pa.array([0] * side.sum())).append_column(
        "b", pa.array([0 if itself else 1] * side.sum())) for side in sides)
    rows = linkage._block_close(left, right, limit).to_pandas()
    got = rows.groupby(["one", "other"]).agg({"distance": "max", "pairs": "sum", "whole": "max"})
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pieces = {(a, b): [gaps[i, j] for s, t in ([(a, b)] if itself else [(a, b), (b, a)]) for i in np.flatnonzero((of == s) & sides[0])
                       for j in np.flatnonzero((of == t) & sides[1])]
              for a in range(31) for b in range(a + 1, 31)}
    if limit == np.inf:
        assert {k: (g.distance, g.pairs, g.whole) for k, g in got.iterrows()} == {
            k: (max(v), len(v), (of == k[0]).sum() * (of == k[1]).sum()) for k, v in pieces.items() if v}
    else:
        assert rows["distance"].max() <= limit and got["pairs"].min() >= 1
        assert {k for k, g in got.iterrows() if g.pairs == len(pieces[k])} == {k for k, v in pieces.items() if v and max(v) <= limit}


def test_shuffles_dropped_leaves_the_setting_as_it_was(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    with pytest.raises(KeyError), shuffles_dropped(spark):
        assert spark.conf.get(setting) == "true"
        raise KeyError
    assert spark.conf.get(setting) == before


def test_cut_tree_gives_k_clusters(points):
    _, df = points
    found = linkage.hierarchical_clusters(df, "id", 3)
    assert found.count() == 40 and {r[0] for r in found.select("cluster").distinct().collect()} == {1, 2, 3}


def test_cut_tree_builds_the_tree_once(spark):
    built = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    merges = spark.createDataFrame([(1, 2, 1.0, 1), (3, 4, 2.0, 2), (1, 3, 3.0, 3), (1, 5, 9.0, 4)],
                                   "kept long, gone long, height double, step int")
    rows = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    tree = merges.mapInArrow(counted, merges.schema)
    assert {tuple(r) for r in linkage.cut_tree(rows, "id", tree, 2).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)}
    assert built.value == 4


def test_linkage_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0])], "id long, features array<double>")
    assert linkage.complete_linkage(one, "id").count() == 0 and linkage.complete_linkage(one.limit(0), "id").count() == 0


@pytest.mark.parametrize("sizes", [knn.Sizes(), knn.Sizes(cell_rows=10, query_rows=4, corpus_rows=8),
                                   knn.Sizes(cell_rows=3, fan=2, levels=3, query_rows=16, corpus_rows=2)])
def test_nearest_distance_of_a_frame_to_itself(points, sizes):
    rows, df = points
    x = np.array([rows[i] for i in sorted(rows)])
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    got = {r.id: r.distance for r in knn.nearest_distance(df, "id", sizes=sizes).collect()}
    assert np.allclose([got[i] for i in sorted(got)], gaps.min(1))


def brute_neighbours(asked: np.ndarray, corpus: np.ndarray, value: np.ndarray, k: int) -> dict[int, tuple]:
    """Distance of the k-th nearest row, and number and sum of the rows within it, by differences."""
    out = {}
    for i, q in enumerate(asked):
        gaps = np.sqrt(((corpus - q) ** 2).sum(1))
        kth = np.sort(gaps)[min(k, len(gaps)) - 1]
        out[i] = (round(kth, 9), int((gaps <= kth).sum()), round(value[gaps <= kth].sum(), 6))
    return out


@pytest.mark.parametrize("k", [1, 9, 70])
def test_neighbours_in_a_tree_equal_brute_force(spark, k):
    rng = np.random.default_rng(11)
    corpus = np.concatenate([rng.normal(size=(60, 3)) + c for c in rng.normal(scale=20, size=(10, 3))])
    corpus = np.concatenate([corpus, np.repeat(corpus[:1], 200, axis=0), np.arange(60).reshape(-1, 3) * 0.5])
    value, asked = rng.integers(0, 9, len(corpus)).astype(float), np.concatenate([corpus[::40], rng.normal(scale=30, size=(10, 3))])
    df = spark.createDataFrame([(v.tolist(), float(y)) for v, y in zip(corpus, value)], "features array<double>, y double")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id long, features array<double>")
    want = brute_neighbours(asked, corpus, value, k)
    for sizes in (knn.Sizes(), knn.Sizes(cell_rows=20, fan=8, query_rows=16, corpus_rows=16)):
        found = knn.nearest(queries, df, "id", k, "y", sizes).groupBy("id").agg(
            F.max("distance").alias("kth"), F.sum("n").alias("n"), F.sum("total").alias("total"))
        assert {r.id: (round(r.kth, 9), r.n, round(r.total, 6)) for r in found.collect()} == want


def test_a_deeper_tree_compares_fewer_pairs(spark):
    rng = np.random.default_rng(12)
    corpus = np.concatenate([rng.normal(size=(100, 3)) + c for c in rng.normal(scale=50, size=(12, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, features array<double>")
    pairs, results = [], []
    for sizes in (knn.Sizes(), knn.Sizes(cell_rows=300, fan=8), knn.Sizes(cell_rows=30, fan=8)):
        tree = knn.Tree.build(df, None, sizes)
        results.append(sorted((r.id, round(r.distance, 9), r.n) for r in tree.search(df, "id", 5).collect()))
        pairs.append(sum(r[0] for m in tree.met for r in m.select(F.coalesce(F.sum(F.col("asked") * F.col("rows")), F.lit(0))).collect()))
    assert results[0] == results[1] == results[2]
    assert pairs[0] == len(corpus) ** 2 and pairs[0] > 2 * pairs[1] and pairs[1] > 2 * pairs[2]


def test_many_queries_make_few_copies_of_the_corpus(spark):
    def counted(left, right):
        return pa.table({"n": pa.array([left.num_rows], pa.int64())})

    asked = spark.range(20_000).select(F.lit(1).cast("long").alias("node"), "id")
    corpus = spark.range(10).select(F.lit(1).cast("long").alias("node"), F.col("id").alias("point"))
    met = knn._meet(asked, corpus, counted, "n long", F.xxhash64("id"), knn.Sizes().query_rows, knn.Sizes().corpus_rows)[0].collect()
    assert sum(r.n for r in met) == 20_000 and 1 < len(met) <= knn.LEAST_BLOCKS < 20_000 / 2_048


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "id long, features array<double>")
    some = spark.createDataFrame([(1, [0.0, 1.0])], "id long, features array<double>")
    assert knn.nearest(none, some, "id", 3).count() == 0 and knn.nearest(some, none, "id", 3).count() == 0


def test_array_form_keeps_slots_in_order_and_gaps_null(spark):
    long = spark.createDataFrame([(1, "b", 2.0, 5.0), (1, "a", 1.0, None), (2, "b", 3.0, 6.0)], "id int, slot string, v double, w double")
    got = {r.id: r.features for r in reshape.to_array(long, "id", "slot", ["v", "w"], ["a", "b"]).collect()}
    assert got == {1: [1.0, 2.0, None, 5.0], 2: [None, 3.0, None, 6.0]}


def test_profiles_with_an_absent_slot_take_no_part(spark):
    cells = [(1, d, h, 1.0) for d in (1, 2) for h in (0, 1)] + [(2, 1, 0, 9.0), (2, 1, 1, 9.0), (2, 2, 0, 9.0)]
    profile = spark.createDataFrame(cells, "building_id int, day int, hour int, value double")
    clusters = spark.createDataFrame([(1, 1), (2, 1)], "building_id int, cluster int")
    got = clustering.cluster_hourly_profile(profile, clusters, slots=4).collect()
    assert sorted((r.hour, r.value) for r in got) == [(0, 1.0), (1, 1.0)]


def test_every_row_is_scored_whatever_its_label(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], (rng.normal(size=2) + 4 * (i % 2)).tolist()) for i in range(40)]
    train = spark.createDataFrame(rows + [(99, None, [0.0, 0.0])], "id int, label string, features array<double>")
    test = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "unseen", [4.0, 4.0]), (3, None, [4.0, 4.0])], train.schema)
    scored = classify(train, test, "label", models.logistic("label", ["a", "b"])).scored
    assert {r.id: r.predicted for r in scored.collect()} == {1: "a", 2: "b", 3: "b"}
    assert discriminant.fit_discriminant(train, "label").classes == ["a", "b"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    text = ',building_id,floor_count,site_id,primary_use,square_feet,year_built\n1,7,3,0,Education,10.5,NA\n2,8,,1,"",2,1990\n'
    (tmp_path / "b.csv").write_text(text)
    rows = {r.building_id: r for r in tables.read_csv(spark, str(tmp_path / "b.csv"), BUILDINGS).collect()}
    assert (rows[7].floor_count, rows[7].site_id, rows[7].year_built) == (3, 0, None)
    assert (rows[8].floor_count, rows[8].primary_use, rows[8].year_built) == (None, None, 1990)


def test_only_an_unnamed_first_column_is_an_index(spark):
    df = spark.range(2).select(F.col("id").alias("X"), F.lit(1).alias("_c0"))
    assert tables.drop_index(df).columns == ["X", "_c0"]
    assert tables.drop_index(df.select("_c0", "X")).columns == ["X"]


def test_smoothing_is_the_same_in_chunks_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = []
    for site in (1, 2):
        level = np.cumsum(rng.normal(size=60))
        for t in range(60):
            seen = rng.random() < 0.6
            rows.append((site, t, float(level[t]) if seen else None, None if t > 1 else 1.0))
    df = spark.createDataFrame(rows, "site_id int, timestamp int, a double, b double")
    one = {(r.site_id, r.timestamp): r for r in kalman.fill_by_smoothing(df, ["a", "b"]).collect()}
    many = kalman.fill_by_smoothing(df, ["a", "b"], chunk_rows=9)
    assert {(r.site_id, r.measure): r.n for r in kalman.unfilled(many, ["a", "b"]).collect()} == {(1, "b"): 58, (2, "b"): 58}
    for r in many.collect():
        assert r.a == pytest.approx(one[r.site_id, r.timestamp].a, abs=1e-6)
    assert all(one[s, t].a == v for s, t, v, _ in rows if v is not None)


def _dense_smoother(y: np.ndarray, level: float, slope: float) -> tuple[np.ndarray, float]:
    """Smoothed level and log likelihood of one whole series from the joint normal distribution."""
    n, seen = len(y), ~np.isnan(y)
    first = y[seen][0]
    step, state = np.array([[1.0, 1.0], [0.0, 1.0]]), np.eye(2)
    cov = np.zeros((n, n))
    spread, spreads = np.eye(2) * kalman.PRIOR, []
    for _ in range(n):
        spreads.append(spread)
        spread = step @ spread @ step.T + np.diag([level, slope])
    for i in range(n):
        state = spreads[i]
        for j in range(i, n):
            cov[i, j] = cov[j, i] = state[0, 0]
            state = state @ step.T
    told = cov[np.ix_(seen, seen)] + np.eye(seen.sum())
    gap = y[seen] - first
    weight = np.linalg.solve(told, gap)
    value = -0.5 * (seen.sum() * np.log(gap @ weight / seen.sum()) + np.linalg.slogdet(told)[1])
    return first + cov[:, seen] @ weight, value


def test_variances_maximise_the_likelihood_and_smoothing_equals_the_dense_form(spark):
    rng = np.random.default_rng(9)
    series, rows = {}, []
    for site, (level, slope, noise) in enumerate([(0.5, 0.0, 1.0), (0.01, 0.002, 0.3), (2.0, 0.1, 0.05)]):
        trend = np.cumsum(rng.normal(size=150) * slope)
        y = np.cumsum(rng.normal(size=150) * level + trend) + rng.normal(size=150) * noise
        y[rng.random(150) < 0.3] = np.nan
        series[site] = y
        rows += [(site, t, None if np.isnan(v) else float(v)) for t, v in enumerate(y)]
    rows += [(9, t, None) for t in range(5)] + [(None, t, float(t % 3)) for t in range(4)]
    df = spark.createDataFrame(rows, "site_id int, timestamp int, a double")
    fitted = {r.site_id: r for r in kalman.fit_variances(df, ["a"], chunk_rows=40).collect()}
    filled = {(r.site_id, r.timestamp): r.a for r in kalman.fill_by_smoothing(df, ["a"], chunk_rows=70).collect()}
    assert fitted[9].seen == 0 and filled[9, 0] is None and filled[None, 3] == 0.0
    for site, y in series.items():
        best = fitted[site]
        dense, value = _dense_smoother(y, 10 ** best.level, 10 ** best.slope)
        assert np.isclose(best.likelihood, value, atol=0.02)  # the dense matrix has entries up to 1e11 and loses digits
        assert best.likelihood >= best.grid_likelihood
        near = [(best.level + a, best.slope + b) for a in (-0.3, 0, 0.3) for b in (-0.3, 0, 0.3)]
        around = [_dense_smoother(y, 10 ** a, 10 ** b)[1] for a, b in near if a <= kalman.HIGHEST[0] and b <= kalman.HIGHEST[1]]
        assert best.likelihood >= max(around) - 0.02
        got = np.array([filled[site, t] for t in range(len(y))])
        assert np.allclose(got, np.where(np.isnan(y), dense, y), atol=2e-3)
    assert any(r.likelihood > r.grid_likelihood + 0.1 for r in fitted.values())
