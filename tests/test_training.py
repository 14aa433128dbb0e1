"""Models trained side by side against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattweave.operators import boosting, clustering, estimators, forest, grids, models
from wattweave.operators.blocks import collected_sums, to_blocks
from wattweave.operators.knn import squared_gaps
from wattweave.operators.ranking import stratified_folds


@pytest.fixture(scope="module")
def classed(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        c = i % 3
        rows.append((i, "abc"[c], float(c), (rng.normal(size=5) + 1.5 * np.eye(5)[c]).tolist()))
    rows.append((999, None, None, [0.0] * 5))
    df = spark.createDataFrame(rows, "id long, label string, number double, features array<double>").repartition(3)
    return rows, df


def test_block_sums_are_those_of_all_rows(classed):
    rows, df = classed
    blocks = to_blocks(df, y=F.coalesce("number", F.lit(9.0)), task_rows=100)
    got = collected_sums(blocks, lambda x, y, fold: [(c, x[y == c].sum(0)) for c in (0, 1, 2, 9)])
    for c in range(3):
        assert np.allclose(got[c], np.sum([r[3] for r in rows if r[2] == c], axis=0))


@pytest.mark.parametrize("family", [grids.Perceptron(4), grids.PairwiseMachine(3.0)])
def test_slopes_are_those_of_the_loss(family):
    rng = np.random.default_rng(1)
    x, y, k = rng.normal(size=(30, 4)), rng.integers(0, 3, 30), 3
    w = rng.normal(size=family.size(4, k)) * 0.3

    def loss(w):
        if isinstance(family, grids.Perceptron):
            return -np.log(family.probabilities(w, x, k)[np.arange(30), y]).sum()
        m = w.reshape(-1, 5)
        total = 0.5 * (m[:, :-1] ** 2).sum()
        for (a, b), v in zip(family.pairs(k), m):
            for c, sign in ((a, 1.0), (b, -1.0)):
                total += family.cost * (np.maximum(0, 1 - sign * (x[y == c] @ v[:-1] + v[-1])) ** 2).sum()
        return total

    slope = family.gradient(w, x, y, k) + family.penalty(w, 4, k)
    for i in range(0, len(w), 3):
        step = np.zeros(len(w))
        step[i] = 1e-5
        assert slope[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-5, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("family", [grids.Perceptron(4), grids.PairwiseMachine(3.0)])
def test_models_side_by_side_have_the_slopes_of_each(family):
    rng = np.random.default_rng(2)
    x, y, k, centre, scale = rng.normal(size=(50, 4)) * 3 + 2, rng.integers(0, 3, 50), 3, rng.normal(size=4), rng.uniform(0.5, 2, 4)
    ws, learn = rng.normal(size=(2, family.size(4, k))) * 0.3, rng.random((50, 2)) < 0.7
    got = family.gradients(np.stack([family.moved(w, centre, scale, k) for w in ws]), x, y, k, learn.astype(float))
    for w, slope, of in zip(ws, got, learn.T):
        want = family.gradient(w, (x[of] - centre) / scale, y[of], k)
        assert np.allclose(family.moved_back(slope, centre, scale, k), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("settings", [{f"size={h}": grids.Perceptron(h) for h in (2, 5)}, {f"C={c}": grids.PairwiseMachine(c) for c in (0.1, 17)}])
def test_grid_learns_and_reports_every_setting(classed, settings):
    _, df = classed
    tuned = grids.tune(df, "label", "id", settings, folds=4, iterations=60)
    report = {r.setting: r for r in tuned.report.collect()}
    assert set(report) == set(settings) and sum(r.is_best for r in report.values()) == 1
    assert max(r.accuracy for r in report.values()) > 0.7
    scored = tuned.model.transform(df).collect()
    assert len(scored) == 241 and all(0 < r.probability <= 1 for r in scored)
    assert np.mean([r.label == r.predicted for r in scored if r.label]) > 0.75


def plain_boosting(x, y, k, borders, rounds, depth, rate, bins):
    """The same trees, grown row by row without blocks."""
    cells, m = boosting.binned(x, borders).astype(int), np.zeros((len(x), k))
    for _ in range(rounds):
        share = boosting.softmax(m)
        for c in range(k):
            g, h = share[:, c] - (y == c), 2 * share[:, c] * (1 - share[:, c])

            def grow(rows, level):
                value = -g[rows].sum() / (h[rows].sum() + 1.0) * rate
                best = (1e-9, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for cut in range(bins - 1):
                            left = rows[cells[rows, f] <= cut]
                            right = rows[cells[rows, f] > cut]
                            if len(left) and len(right) and h[left].sum() >= 1 and h[right].sum() >= 1:
                                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                                if gain > best[0] + 1e-10:
                                    best = (gain, (left, right))
                if best[1] is None:
                    m[rows, c] += value
                else:
                    for side in best[1]:
                        grow(side, level + 1)

            grow(np.arange(len(x)), 0)
    return m


def test_boosting_equals_plain_boosting(classed, monkeypatch):
    rows, df = classed
    monkeypatch.setattr(boosting, "BAKE", 2)
    model = boosting.fit_boosted(df, "label", rounds=5, depth=3, bins=8)
    known = [r for r in rows if r[1]]
    x, y = np.array([r[3] for r in known]), np.array([r[2] for r in known])
    want = boosting.softmax(plain_boosting(x, y, 3, model.borders, 5, 3, 0.3, 8))
    got = boosting.softmax(boosting.margins(model.bins(x), model.rounds, 3))
    assert np.allclose(got, want, atol=1e-6)
    scored = {r.id: r for r in model.transform(df).collect()}
    assert [scored[r[0]].predicted for r in known] == ["abc"[i] for i in want.argmax(1)] and 999 in scored


def test_one_scan_an_iteration_gives_plain_k_means(classed):
    rows, df = classed
    x = np.array([r[3] for r in rows])
    best = clustering.lloyd(df, [1, 2, 4], restarts=3)
    assert best[1][0] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    assert best[1][0] > best[2][0] > best[4][0]
    for cost, centres in best.values():
        gaps = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert cost == pytest.approx(gaps.min(1).sum())
        own = gaps.argmin(1)
        for c in range(len(centres)):
            assert np.allclose(centres[c], x[own == c].mean(0), atol=1e-6)  # no centre would move


def test_one_product_serves_all_models_and_ties_go_to_the_first(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate((0, 1, 2, 10, 11, 12))], "id int, features array<double>")
    products = []

    def sums(blocks, work):
        done = collected_sums(blocks, work)
        seen = []
        monkeypatch.setattr(clustering, "squared_gaps", lambda a, b: seen.append(1) or squared_gaps(a, b))
        list(work(np.array([[1.0], [6.0]]), None, None))
        monkeypatch.setattr(clustering, "squared_gaps", squared_gaps)
        products.append(len(seen))
        return done

    monkeypatch.setattr(clustering, "collected_sums", sums)
    best = clustering.lloyd(df, [1, 2], restarts=3)
    assert best[2][0] == 4.0 and sorted(best[2][1].ravel()) == [1.0, 11.0]
    assert set(products[:-1]) == {1} and products[-1] == 6  # the last one takes the costs


def test_more_clusters_than_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1.0])], "id int, features array<double>")
    assert clustering.lloyd(df, [5], restarts=2)[5][0] == 0.0
    assert {r.id for r in clustering.kmeans_clusters(df, "id", clustering.fit_kmeans(df, 2)).collect()} == {1, 2, 3}


def test_discriminant_in_cross_validation_equals_plain_folds(classed):
    rows, df = classed
    report = estimators.validate_discriminant(df, "label", "id", folds=4).first()
    fold = {r.id: r.fold for r in stratified_folds(df.where("label is not null"), "label", "id", 4, 100).collect()}
    known = [r for r in rows if r[1]]
    x, y, f = np.array([r[3] for r in known]), np.array([int(r[2]) for r in known]), np.array([fold[r[0]] for r in known])
    shares = []
    for held in range(4):
        a, b = x[f != held], y[f != held]
        means = np.array([a[b == c].mean(0) for c in range(3)])
        pooled = (a - means[b]).T @ (a - means[b]) / (len(a) - 3)
        w = means @ np.linalg.inv(pooled)
        score = x[f == held] @ w.T - 0.5 * (w * means).sum(1) + np.log(np.bincount(b) / len(b))
        shares.append((score.argmax(1) == y[f == held]).mean())
    assert report.accuracy == pytest.approx(np.mean(shares)) and report.accuracy_sd == pytest.approx(np.std(shares))


def test_neighbours_in_cross_validation_report_each_k(classed):
    _, df = classed
    report = {r.setting: r for r in estimators.validate_neighbours(df, "number", "label", "id", ks=(1, 9), folds=3).collect()}
    assert set(report) == {"k=1", "k=9"} and report["k=9"].is_best and 0 < report["k=9"].rmse < report["k=1"].rmse


def plain_tree(bins, y, weight, k, tree, node, mtry, depth, seed):
    """(counts) of a leaf or (predictor, cut, left, right): every cut of every tried predictor, one by one."""
    own = np.bincount(y, weight, k)
    best = (0.0, None)
    if (own > 0).sum() > 1 and (node + 1).bit_length() - 1 < depth:
        for f in forest.predictors(seed, tree, np.array([node]), bins.shape[1], mtry)[0]:
            for cut in range(forest.BINS - 1):
                low = bins[:, f] <= cut
                sides = [np.bincount(y[s], weight[s], k) for s in (low, ~low)]
                if all(s.sum() for s in sides):
                    gain = sum((s**2).sum() / s.sum() for s in sides) - (own**2).sum() / own.sum()
                    best = max(best, (gain, (f, cut)), key=lambda x: x[0] - 1e-9 * (x is not best))
    if best[1] is None:
        return own
    f, cut = best[1]
    low = bins[:, f] <= cut
    left, right = (plain_tree(bins[s], y[s], weight[s], k, tree, 2 * node + side, mtry, depth, seed) for side, s in ((1, low), (2, ~low)))
    if not isinstance(left, tuple) and not isinstance(right, tuple) and left.argmax() == right.argmax():
        return left + right
    return f, cut, left, right


@pytest.mark.parametrize("depth", [3, 20])
def test_trees_equal_plain_ones(depth):
    rng = np.random.default_rng(4)
    bins, y = rng.integers(0, 32, (300, 6)).astype(np.uint8), rng.integers(0, 4, 300)
    bins[:, 5] = 7
    weight = forest.bag(100, 3, np.arange(300))
    assert 0.5 < (weight > 0).mean() < 0.75 and 0.8 < weight.mean() < 1.2
    bins, y, weight = bins[weight > 0], y[weight > 0], weight[weight > 0]
    got = forest.grow(bins, y, weight, 4, 3, 0, 2, depth, 100)

    def same(at, want):
        if not isinstance(want, tuple):
            assert got.feature[at] == forest.LEAF and got.counts[at].tolist() == want.tolist()
            return 1
        assert (got.feature[at], got.cut[at]) == want[:2]
        return 1 + same(got.left[at], want[2]) + same(got.left[at] + 1, want[3])

    assert same(0, plain_tree(bins, y, weight, 4, 3, 0, 2, depth, 100)) == len(got.feature)


def test_forest_is_the_same_wherever_its_parts_are_grown(classed):
    _, df = classed
    df = df.unionAll(df.sparkSession.createDataFrame([(1000, "a", 0.0, None)], df.schema)).coalesce(1)
    found = []
    for local_rows in (10_000, 12):
        model = forest.fit_forest(df, "label", mtry=2, trees=7, depth=5, local_rows=local_rows)
        assert (sum(len(t.feature) for t in model.tops) > 7) == (local_rows == 12)
        found.append({r["id"]: (r["predicted"], r["probability"]) for r in model.transform(df).collect()})
    whole, parted = found
    assert whole == parted and len(whole) == 242
    assert whole[1000] == (None, None) and whole[999][0] in "abc"


def test_forest_votes_like_that_of_mllib(classed):
    """Other draws, the same rules: most rows get the class and about the share of votes that MLlib's forest gives them."""
    rows, df = classed
    df = df.where("label is not null").coalesce(1)
    fitted = models.random_forest("label", ["a", "b", "c"], mtry=2, trees=100, depth=5).fit(models.with_vector(df))
    other = {r["id"]: (r["predicted"], max(r["probability"].toArray())) for r in models.predict(fitted, models.with_vector(df)).collect()}
    own = {r["id"]: (r["predicted"], r["probability"]) for r in forest.fit_forest(df, "label", mtry=2, trees=100, depth=5).transform(df).collect()}
    assert np.mean([own[i][0] == other[i][0] for i in other]) > 0.9
    assert np.mean([abs(own[i][1] - other[i][1]) for i in other]) < 0.05
    right = [np.mean([of[r[0]][0] == r[1] for r in rows[:240]]) for of in (own, other)]
    assert abs(right[0] - right[1]) < 0.05 and min(right) > 0.8, right


def test_seeds_share_no_bag_and_no_choice_of_predictors():
    rows, nodes = np.arange(200), np.arange(50)
    bags = {forest.bag(seed, tree, rows).tobytes() for seed in range(4) for tree in range(4)}
    choices = {forest.predictors(seed, tree, nodes, 20, 5).tobytes() for seed in range(4) for tree in range(4)}
    assert len(bags) == len(choices) == 16


def test_forest_has_borders_between_few_values(spark):
    df = spark.createDataFrame([(i, "ab"[i % 50 == 0], [float(i % 50 == 0), float(i)]) for i in range(1000)], "id long, label string, features array<double>")
    assert [len(b) for b in forest.split_borders(df, "features")] == [1, 31]
    rows = forest.fit_forest(df, "label", mtry=2, trees=3).transform(df).collect()
    assert len(rows) == 1000 and all(r["predicted"] == r["label"] and r["probability"] == 1.0 for r in rows)


def test_registered_forest_is_grown_in_parts(spark, monkeypatch):
    """500 trees of depth 20 at mtry 15, and no tree comes to the driver as MLlib's would."""
    import __spark_entry__ as entry
    from wattweave.plans import classify

    asked = []

    def few(train, label, mtry, trees, depth):
        asked.append((mtry, trees, depth))
        return forest.fit_forest(train, label, mtry, 5, depth)

    monkeypatch.setattr(classify, "fit_forest", few)
    rows = entry.queries()["m12_random_forest"](spark, "/root/testdata/sf0.001").collect()
    assert asked == [(15, 500, 20)] and len(rows) == 145 and all(r["predicted"] in set("0123456789") for r in rows)
