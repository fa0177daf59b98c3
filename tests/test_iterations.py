"""Boosted trees and shared k-means passes against plain versions of the same rules."""

import pickle

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from crowdgap.operators import boosting as bo
from crowdgap.operators import clustering as cl
from crowdgap.operators.passes import packed, summed


def plain_tree(x, g, h, b, leaves, min_rows):
    """Best-first tree as {row -> leaf number}, by looking at every split of every leaf."""
    def best(rows):
        found = None
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + b.l2)
        for c in range(x.shape[1]):
            for cut in np.unique(x[rows, c])[:-1]:
                low, high = rows[x[rows, c] <= cut], rows[x[rows, c] > cut]
                if min(len(low), len(high)) < min_rows or len(rows) < 2 * min_rows:
                    continue
                gain = round(score(low) + score(high) - score(rows), 6)
                if gain > 0 and (found is None or gain > found[0]):
                    found = gain, low, high
        return found

    parts = [np.arange(len(x))]
    while len(parts) < leaves:
        options = [(f[0], -i, f) for i, p in enumerate(parts) if (f := best(p))]
        if not options:
            break
        _, i, (_, low, high) = max(options, key=lambda o: o[:2])
        parts[-i] = low
        parts.append(high)
    return parts


def plain_boost(x, y, b):
    p = y.mean()
    margin = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(b.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        for rows in plain_tree(x, g, h, b, b.leaves, b.min_rows):
            margin[rows] += -b.rate * g[rows].sum() / (h[rows].sum() + b.l2)
    return 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, 400), rng.integers(0, 30, 400), rng.integers(0, 2, 400)])
    chance = 1 / (1 + np.exp(-(x[:, 0] - 4) * np.where(x[:, 2] == 1, 1, -.5) + .1 * (x[:, 1] - 15)))
    return x.astype(float), (rng.random(400) < chance).astype(float)


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, x array<double>, label double, fold int")
    return df.repartition(3).withColumn("features", array_to_vector("x"))


def test_trees_equal_a_plain_booster(spark, sample):
    x, y = sample
    b = bo.Booster(rounds=4, rate=.3, leaves=6, min_rows=15, min_curvature=0)
    df = frame(spark, x, y)
    jobs = [bo.Job(F.col("fold") != 0), bo.Job(F.lit(True)), bo.Job(F.lit(True), (0, 2))]
    models = b.fit_many(df, jobs)
    part = np.arange(400) % 3 != 0
    for model, rows, columns in ((models[0], part, [0, 1, 2]), (models[1], part | True, [0, 1, 2]),
                                 (models[2], part | True, [0, 2])):
        want = plain_boost(x[rows][:, columns], y[rows], b)
        got = 1 / (1 + np.exp(-model.margins(x[rows])))
        assert np.abs(got - want).max() < 1e-9
    scored = models[1].transform(df).select("i", "probability").collect()
    direct = 1 / (1 + np.exp(-models[1].margins(x)))
    assert max(abs(r.probability[1] - direct[r.i]) for r in scored) < 1e-12


def test_many_blocks_and_refreshed_margins_change_nothing(spark, sample, monkeypatch):
    x, y = sample
    b = bo.Booster(rounds=5, rate=.3, leaves=4)
    one = b.fit(frame(spark, x, y))
    monkeypatch.setattr(bo, "LEAST_ROWS", 50)
    monkeypatch.setattr(bo, "REFRESH", 2)
    many = b.fit(frame(spark, x, y))
    assert np.abs(one.margins(x) - many.margins(x)).max() < 1e-9


def test_depth_and_hopeless_rows(spark, sample):
    x, y = sample
    flat = bo.Booster(rounds=2, depth=1).fit(frame(spark, x, y))
    assert all((t[0] >= 0).sum() == 1 for t in flat.trees)
    same = bo.Booster(rounds=2).fit(frame(spark, x[:30], np.ones(30)))
    assert (same.margins(x[:3]) > 10).all()
    assert all((t[0] >= 0).sum() == 0 for t in same.trees)


def test_few_values_get_a_bin_each_and_many_are_cut(spark):
    x = np.column_stack([np.arange(2000) % 7, np.arange(2000), (np.arange(2000) == 5) * 1.0])
    edges = bo.bin_edges(frame(spark, x, x[:, 2]), "features", 255)
    assert edges[0].tolist() == list(range(7)) and edges[2].tolist() == [0, 1]
    assert 200 < len(edges[1]) <= 256 and bo.binned(x, edges).max() <= 255


def plain_lloyd(x, c, rounds=300):
    c = c.copy()
    for _ in range(rounds):
        at = np.round(((x[:, None] - c[None]) ** 2).sum(2), 12).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() <= 1e-10:
            break
        c = new
    return c


def test_shared_runs_equal_runs_of_their_own(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "i int, v array<double>").repartition(5)
    use = [F.col("i") % 2 == 0, F.col("i") < 200]
    blocks = packed(df, "v", use)
    far = np.vstack([x[:2], np.full((1, 5), 99.0)])         # never gets a row
    runs = cl.lloyd(blocks, [x[:4], x[10:13], x[:6], far], [None, 0, 1, None])
    rows = [x, x[::2], x[:200], x]
    for (c, cost), start, part in zip(runs, [x[:4], x[10:13], x[:6], far], rows):
        want = plain_lloyd(part, start)
        assert np.abs(c - want).max() < 1e-9
        assert abs(cost - ((part[:, None] - want[None]) ** 2).sum(2).min(1).sum()) < 1e-6
    assert summed(blocks, lambda m, u: np.array([len(m), u.sum()])).tolist() == [300, 350]
    blocks.unpersist()


def test_assignment_is_nearest_and_centre_is_mean(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, .1, (60, 3)) for c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "i int, v array<double>")
    got = cl.kmeans(df, 3, 4, vector="v").orderBy("i").toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    centres = np.array([u[got.cluster == j].mean(0) for j in range(3)])
    assert (((u[:, None] - centres) ** 2).sum(2).argmin(1) == got.cluster).all()
    assert all(len(set(got.cluster[i:i + 60])) == 1 for i in (0, 60, 120))


def test_silhouettes_of_several_labelings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4))
    labels = [(i % 3, 0 if i == 5 else 1 + i % 2) for i in range(90)]
    df = spark.createDataFrame([(i, [float(v) for v in r], *a) for (i, r), a in
                                zip(enumerate(x), labels)], "i int, v array<double>, a int, b int")
    got = cl.silhouettes(df, ["a", "b"], "i", "v")
    one = [cl.silhouette(df, c, "i", "v").first().silhouette for c in ("a", "b")]
    assert np.allclose(got, one)


def test_agreement_of_tables():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, 500), rng.integers(0, 3, 500)
    table = np.zeros((4, 3))
    np.add.at(table, (a, b), 1)
    assert abs(cl.ari_of(table)) < .02 and cl.ari_of(np.diag([5., 7., 9.])) == 1.0


def test_logistic_models_meet_their_conditions(spark):
    """Gradients vanish, and a plain Newton solver finds the same coefficients."""
    from crowdgap.operators.logistic import fit_logistic
    rng = np.random.default_rng(8)
    x = rng.normal(2, 3, (400, 4))
    x[:, 3] = 1.0                                               # constant
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 2)))).astype(float)
    df = spark.createDataFrame([(i, [*map(float, r), float(t)]) for i, (r, t) in enumerate(zip(x, y))],
                               "i int, v array<double>").repartition(4)
    blocks = packed(df, "v", [F.col("i") < 300, F.lit(True)])
    for (member, columns), fit in zip([(0, (0, 1, 2, 3)), (1, (0, 2)), (0, (3,))], fit_logistic(
            blocks, [(0, (0, 1, 2, 3)), (1, (0, 2)), (0, (3,))], 4, c=0.5)):
        rows = slice(0, 300) if member == 0 else slice(0, 400)
        part = x[rows][:, columns]
        sd = part.std(0)
        z = np.hstack([np.divide(part - part.mean(0), sd, out=np.zeros_like(part), where=sd > 1e-9),
                       np.ones((len(part), 1))])
        w = np.zeros(z.shape[1])
        price = np.append(np.ones(len(columns)), 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            h = .5 * z.T @ (z * (p * (1 - p))[:, None]) + np.diag(price)
            w -= np.linalg.solve(h, .5 * z.T @ (p - y[rows]) + price * w)
        assert np.abs(fit.weights - w).max() < 1e-5
        assert np.abs(fit.margins(x[rows]) - z @ w).max() < 1e-5
    blocks.unpersist()


def test_models_of_one_task_equal_those_of_passes(spark, sample, monkeypatch):
    """Rows dealt to one task per model, or passes over pieces of all rows: the same trees' margins."""
    x, y = sample
    b = bo.Booster(rounds=6, rate=.3, leaves=6, min_rows=15)
    jobs = [bo.Job(F.col("fold") != 0), bo.Job(F.lit(True)), bo.Job(F.lit(True), (0, 2)), bo.Job(F.lit(False))]
    passes = []
    real = bo.Booster._passes
    monkeypatch.setattr(bo.Booster, "_passes", lambda self, rows, jobs, *a: passes.append(jobs) or real(
        self, rows, jobs, *a))
    roots: list[list] = [[], [], []]
    apart = b.fit_many(frame(spark, x, y), jobs, roots[0])
    assert not passes
    monkeypatch.setattr(bo, "APART_ROWS", 300)          # only the fold's and the empty model fit a task
    mixed = b.fit_many(frame(spark, x, y), jobs, roots[1])
    assert passes == [[1, 2]]
    monkeypatch.setattr(bo, "APART_ROWS", -1)
    monkeypatch.setattr(bo, "LEAST_ROWS", 50)
    monkeypatch.setattr(bo, "REFRESH", 2)
    shared = b.fit_many(frame(spark, x, y), jobs, roots[2])
    assert passes[1:] == [[0, 1, 2, 3]]
    for one, two, three in zip(apart, mixed, shared):
        assert len(one.trees) == len(two.trees) == len(three.trees) == 6
        assert np.abs(one.margins(x) - three.margins(x)).max() < 1e-9
        assert np.abs(two.margins(x) - three.margins(x)).max() < 1e-9
    assert len(roots[0]) == 3 and all(np.allclose(a, r) for a, r in zip(roots[0], roots[2]))


def test_rounds_of_passes_keep_bins_once(spark, sample, monkeypatch):
    """A round makes new margins only, and a pass has one Python step behind each kept RDD."""
    x, y = sample
    monkeypatch.setattr(bo, "APART_ROWS", -1)
    monkeypatch.setattr(bo, "LEAST_ROWS", 50)
    seen = []
    real = bo.Booster._round
    monkeypatch.setattr(bo.Booster, "_round", lambda self, blocks, *a: seen.append(
        (blocks._jrdd.rdd().toDebugString(), [len(pickle.dumps(m)) for _, m in blocks.collect()])) or real(
        self, blocks, *a))
    bo.Booster(rounds=3, rate=.3, leaves=4).fit(frame(spark, x, y))
    assert len(seen) == 3
    assert sum(seen[2][1]) < 400 * 8 + 8 * 300          # a double for each row
    assert [plan.count("PythonRDD[") for plan, _ in seen] == [1, 2, 3]


def test_a_score_reads_the_written_rows(spark, monkeypatch):
    """The trees of a score read its written inputs; the design is not written a second time."""
    from crowdgap.operators import models as mo
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), bool(i % 2), 1500.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a double, y boolean, rating double")

    def again(*_):
        raise AssertionError("written again")

    monkeypatch.setattr(bo, "materialise", again)
    got = mo.score_at(df, df.select("k"), [mo.Block("s", {"a": 0.0}), mo.Block("r", {"rating": 0.0})], "y", "k",
                      ["a"], 1900.0, "rating", lambda t: mo.gbm(t, max_iter=2))
    assert got.where("hit and predicted between 0 and 1").count() == 200
