import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from crowdgap.operators import models as mo
from crowdgap.operators.models import Block


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        a, b, cat = rng.normal(), rng.normal(), str(rng.integers(0, 3))
        y = rng.random() < 1 / (1 + np.exp(-(2.5 * a + (1.5 if cat == "0" else 0))))
        rows.append((i, f"g{i // 6}", float(a), float(b) if i % 10 else None, cat, bool(y),
                     int(rng.integers(1500, 3000)), "new" if i % 3 == 0 else "old",
                     bool(a > 0.5)))
    return spark.createDataFrame(
        rows, "k int, g string, a double, b double, cat string, y boolean, rating int, "
              "batch string, flagged boolean").repartition(4).cache()


BLOCK = Block("surface", {"a": 0.0, "b": 0.0}, ("cat",))
NOISE = Block("noise", {"b": 0.0})


def small(train):
    return mo.gbm(train, max_iter=5, step=0.3, depth=3)


def test_out_of_fold_predictions_cover_every_row_once(items):
    oof = mo.grouped_cv(items, [BLOCK], "y", "g", keep=["k", "g"]).toPandas()
    assert len(oof) == 3000 and oof.k.is_unique
    assert oof.groupby("g").fold.nunique().max() == 1


def test_ladder_ranks_signal_over_noise(items):
    out = {r.spec: r for r in mo.ladder(items, {"noise": [NOISE], "all": [BLOCK]}, "y", "g",
                                        k=3, base="noise").collect()}
    assert out["all"].auc > 0.85 and abs(out["noise"].auc - 0.5) < 0.05
    assert out["all"].verdict == "survives" and out["all"].width == 2 + 4


def test_report_is_calibrated(items):
    oof = mo.grouped_cv(items, [BLOCK], "y", "g", small, 3, ["flagged"]).cache()
    rep = mo.difficulty_report(oof, "flagged")
    b = rep["brier"].first()
    assert b.brier < b.reference
    cal = rep["calibration"].toPandas()
    assert cal.n.sum() == 3000 and (cal.predicted - cal.actual).abs().max() < 0.2
    assert rep["by_flag"].count() == 2


def test_scores_at_a_fixed_rating_count_misses(spark, items):
    wanted = spark.createDataFrame([(1, "c"), (2, "c"), (999999, "c")], "k int, concept string")
    got = mo.score_at(items, wanted, [BLOCK, Block("rating", {"rating": 1500.0})], "y", "k", ["g"],
                      1900.0, "rating", small)
    row = mo.score_by_concept(got, "concept").first()
    assert (row.hits, row.misses) == (2, 1) and 0 < row.predicted < 1
    assert got.where("not hit").first().predicted is None


def test_learning_curve_keeps_whole_groups(items):
    got = mo.learning_curve(items, [BLOCK], "y", "g", [300, None], 2, make=small).toPandas()
    got = got.sort_values("step")
    assert 300 <= got.train_n.iloc[0] < 306 + 6 and got.train_n.iloc[1] == 2400
    assert got.delta.isna().tolist() == [True, False]


def test_batch_value_by_band(items):
    got = mo.batch_value(items, [BLOCK], "y", "g", "batch", "new", "rating", make=small).toPandas()
    assert len(got) == 5 - 1 or len(got) == 5
    assert np.allclose(got.delta_auc, got.auc_full - got.auc_old)


def test_odds_and_rules(items):
    src = items.withColumn("big", (F.col("a") > 0).cast("double")).withColumn(
        "odd", (F.col("k") % 2).cast("double"))
    odds = mo.odds_ratios(src, ["odd", "big"], "y").toPandas().sort_values("place")
    assert odds.feature.iloc[0] == "big" and odds.odds_ratio.iloc[0] > 2
    text, leaves = mo.tree_rules(src, ["odd", "big"], "y")
    assert "big" in text and leaves.agg(F.sum("n")).first()[0] == 3000


def test_cluster_label_gain_is_reported(spark, items):
    src = items.withColumn("embedding", F.array("a", F.lit(1.0)))
    got = mo.cluster_gain(src, "k", "y", [2], NOISE, restarts=1, make=mo.logit, folds=3).first()
    assert got.cluster_auc > 0.6 and got.gain > 0.05


def test_vectors_attached_last_change_nothing(spark, items, monkeypatch):
    """A ladder over attached vectors writes them once, beside each other, in the design only."""
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(20)],
                                  "vid int, scores array<double>")
    keyed = items.withColumn("vid", (F.col("k") % 20).cast("int"))
    specs = {"base": [BLOCK], "both": [BLOCK, Block("embedding", vector="scores", width=2)]}
    want = mo.ladder(keyed.join(table, "vid"), specs, "y", "g", k=3, base="base").collect()
    written = {}
    write = mo.materialise
    monkeypatch.setattr(mo, "materialise", lambda df, kind="table": written.setdefault(kind, write(df, kind)))
    got = mo.ladder(keyed, specs, "y", "g", k=3, base="base", vectors=(table, "vid")).collect()
    assert "scores" not in written["inputs"].columns and "features" in written["design"].columns
    for a, b in zip(want, got):
        assert (a.spec, a.width) == (b.spec, b.width) and abs(a.auc - b.auc) < 1e-9


def test_shared_newton_folds_equal_single_fits(items):
    keep = ["k"]
    one = mo.grouped_cv(items, [BLOCK], "y", "g", keep=keep).toPandas().set_index("k").sort_index()
    many = mo.grouped_cv(items, [BLOCK], "y", "g", mo.newton,
                         keep=keep).toPandas().set_index("k").sort_index()
    assert (one.fold == many.fold).all() and (one.label == many.label).all()
    assert (one[mo.SCORE] - many[mo.SCORE]).abs().max() < 1e-3


def test_curve_scores_each_row_once(spark):
    """All models' chances come from one read of a row's features."""
    from crowdgap.operators import boosting as bo
    tree = (np.array([0, -1, -1]), np.array([0, -1, -1]), np.array([1, -1, -1]),
            np.array([2, -1, -1]), np.array([0., -1., 1.]))
    models = [bo.Boosted(b, [tree], [np.array([0., 1.])]) for b in (0., 2.)]
    rows = spark.createDataFrame([([0.],), ([1.],)], "x array<double>")
    got = rows.select(bo.chances_each(models)("x", F.array(F.lit(0), F.lit(1))).alias("p")).collect()
    want = 1 / (1 + np.exp(-np.array([[-1., 1.], [1., 3.]])))
    assert np.allclose([r.p for r in got], want)


def test_curve_marks_are_the_sampled_groups(spark, items):
    """One pass over the groups for each run gives every size's groups; rows are not looked at."""
    from crowdgap.operators.sampling import group_holdout, sample_groups
    split = group_holdout(items, "g", 0.2, 0)
    jobs = [(300, 0), (300, 1), (700, 0), (None, 0)]
    marks, uses = mo._curve_marks(items, split, "g", jobs)
    pool = items.join(split, "g").where("not is_test")
    for (size, run), use in zip(jobs, uses):
        got = {r.g for r in marks.where("not is_test").where(use).collect()}
        if size is None:
            assert got == {r.g for r in pool.collect()}
            continue
        hashed = {}
        for r in pool.select("g", F.md5(F.concat(F.lit(f"{100 + run}:"), "g")).alias("h")).collect():
            hashed.setdefault((r.h, r.g), []).append(r)
        want, n = set(), 0
        for (_, g), rows in sorted(hashed.items()):
            if n < size:
                want.add(g)
            n += len(rows)
        assert got == want == {r.g for r in sample_groups(pool, "g", size, 100 + run).collect()}


def test_boosting_reads_the_written_design(items, monkeypatch):
    """A design that is written already is not written again, and test rows are scored once."""
    from crowdgap.operators import boosting as bo

    def again(*_):
        raise AssertionError("written again")

    monkeypatch.setattr(bo, "materialise", again)
    written, write = [], mo.materialise
    monkeypatch.setattr(mo, "materialise", lambda df, kind="table": written.append(kind) or write(df, kind))
    assert mo.grouped_cv(items, [BLOCK], "y", "g", small, 3, ["flagged"]).count() == 3000
    got = mo.batch_value(items, [BLOCK], "y", "g", "batch", "new", "rating", make=small).toPandas()
    assert len(got) and written.count("scored") == 1


def test_a_gradient_reads_a_written_table_and_writes_no_design(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)],
                               "a double, b double, y int").repartition(3)
    block = [mo.Block("s", {"a": 0.0, "b": 0.0})]
    kinds = []
    write = mo.materialise
    monkeypatch.setattr(mo, "materialise", lambda d, kind: kinds.append(kind) or write(d, kind))
    one = {r.name: r.coefficient for r in mo.logit_report(df, block, "y").collect()}
    assert kinds == ["inputs"]
    two = {r.name: r.coefficient for r in mo.logit_report(write(df), block, "y", written=True).collect()}
    assert kinds == ["inputs"] and max(abs(one[n] - two[n]) for n in one) < 1e-9


def test_quantiles_are_asked_of_columns_with_many_values_only(spark, monkeypatch):
    from crowdgap.operators import boosting
    rows = spark.range(3000).select(F.array(
        (F.col("id") % 7).cast("double"), (F.col("id") / 3000), F.lit(1.0)).alias("a"))
    asked = []
    real = F.percentile_approx
    monkeypatch.setattr(boosting.F, "percentile_approx", lambda c, *a: asked.append(c) or real(c, *a))
    edges = boosting.bin_edges(rows.select(array_to_vector("a").alias("x")), "x", 255)
    assert asked == ["c1"]
    assert list(edges[0]) == list(range(7)) and list(edges[2]) == [1.0]
    assert 200 < len(edges[1]) <= 256 and edges[1][-1] == 2999 / 3000


def test_newton_folds_write_plain_columns(items, monkeypatch):
    """No vector is written, and the groups' folds are joined once, not once more for the encoders."""
    plans, write = {}, mo.materialise
    monkeypatch.setattr(mo, "materialise", lambda df, kind="table": plans.setdefault(kind, df) and write(df, kind))
    fits, fit = [], mo.StringIndexer.fit
    monkeypatch.setattr(mo.StringIndexer, "fit", lambda self, df: fits.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or fit(self, df))
    odd = items.withColumn("cat", F.when(F.col("k") % 7 > 0, F.col("cat")))
    keep = ["k"]
    got = mo.grouped_cv(odd, [BLOCK], "y", "g", mo.newton, keep=keep).toPandas().set_index("k").sort_index()
    assert mo.FEATURES not in plans["design"].columns and {"__x0", "__x6"} <= set(plans["design"].columns)
    assert len(fits) == 1 and "Join" not in fits[0]
    monkeypatch.undo()
    want = mo.grouped_cv(odd, [BLOCK], "y", "g", keep=keep).toPandas().set_index("k").sort_index()
    assert (got.width == want.width).all() and (got.fold == want.fold).all()
    assert (got[mo.SCORE] - want[mo.SCORE]).abs().max() < 1e-3


def test_shared_newton_sums_are_the_plain_ones():
    """One standardisation for all folds, also where a column is constant in the first of them."""
    from crowdgap.operators import logistic as lo
    rng = np.random.default_rng(3)
    n, d = 9001, 3
    x = np.hstack([rng.normal(5, 2, (n, d)), rng.integers(0, 2, (n, 1))]).astype(float)
    use = rng.random((2, n)) < 0.7
    x[use[0], 1] = 4.0
    models = []
    for member, columns in ((0, [0, 1, 2]), (1, [0, 1, 2]), (1, [0, 2])):
        own = x[use[member]][:, columns]
        scale = np.where(own.std(0) < 1e-12, np.inf, own.std(0))
        models.append((member, np.array(columns), own.mean(0), scale, rng.normal(size=len(columns) + 1)))
    want = []
    for member, columns, mean, scale, w in models:
        rows = x[use[member]]
        z = np.hstack([(rows[:, columns] - mean) / scale, np.ones((len(rows), 1))])
        p = 1 / (1 + np.exp(-z @ w))
        y = rows[:, -1]
        want += [[-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()], z.T @ (p - y),
                 (z.T @ (z * (p * (1 - p))[:, None])).ravel()]
    assert np.allclose(lo.newton_sums(x, use, models), np.concatenate(want), rtol=1e-9, atol=1e-7)
    groups = lo.shared_columns(models)
    assert [g[3] for g in groups] == [[0, 1], [2]]
    flat = lo.moments(x, use).reshape(2, -1)
    assert np.allclose(flat[1], [use[1].sum(), *x[use[1]].sum(0), *(x[use[1]] ** 2).sum(0)])


def test_auc_meets_no_row_with_a_running_total(spark):
    from crowdgap.operators import metrics
    rng = np.random.default_rng(4)
    rows = [(None if g == 2 else int(g), int(rng.integers(0, 2)), float(np.round(rng.random(), 2)))
            for g in rng.integers(0, 3, 2000)]
    got = metrics.auc(spark.createDataFrame(rows, "g int, y int, p double"), "y", "p", ["g"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        pos = np.array([p for g, y, p in rows if g == r.g and y])
        neg = np.array([p for g, y, p in rows if g == r.g and not y])
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert abs(r.auc - wins / (len(pos) * len(neg))) < 1e-12 and r.n == len(pos) + len(neg)

def test_chances_of_rows_that_name_different_models(spark):
    """A validation's rows name the models of their own fold: each model scores a part of a batch."""
    from crowdgap.operators import boosting as bo
    edges = [np.array([0., 1.])]
    tree = (np.array([0, -1, -1]), np.array([0, -1, -1]), np.array([1, -1, -1]),
            np.array([2, -1, -1]), np.array([0., -1., 1.]))
    models = [bo.Boosted(b, [tree], edges) for b in (0., 2., 4., 6.)]
    rows = [(i, [float(i % 2)], i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x array<double>, late boolean").coalesce(1)
    which = F.when(F.col("late"), F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(1)))
    got = {r.i: r.p for r in df.select("i", bo.chances_each(models)("x", which).alias("p")).collect()}
    for i, (x,), late in rows:
        want = [1 / (1 + np.exp(-(models[m].base + (1. if x else -1.)))) for m in ((2, 3) if late else (0, 1))]
        assert np.allclose(got[i], want)


def test_boosted_cluster_gain_scores_every_fold(spark, items):
    src = items.withColumn("embedding", F.array("a", F.lit(1.0)))
    got = mo.cluster_gain(src, "k", "y", [2], NOISE, restarts=1, folds=3,
                          make=lambda t: mo.small_gbm(t, 3)).first()
    assert got.cluster_auc > 0.6 and got.gain > 0.05


class _Asked(Exception):
    pass


def _settings_of(spark, monkeypatch, query):
    """The settings of the boosted models that a registered query fits."""
    from crowdgap.operators import boosting as bo
    from crowdgap.plans import QUERIES

    def asked(self, *_, **__):
        raise _Asked(self.rounds, self.rate, self.leaves, self.depth)

    monkeypatch.setattr(bo.Booster, "fit_many", asked)
    with pytest.raises(_Asked) as e:
        QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    return e.value.args


def test_cluster_gain_fits_the_studys_trees(spark, monkeypatch):
    assert _settings_of(spark, monkeypatch, "cluster_gain") == (120, 0.1, 8, 3)


STUDY = (300, 0.06, 15, None)


def test_difficulty_by_flag_fits_the_studys_trees(spark, monkeypatch):
    assert _settings_of(spark, monkeypatch, "difficulty_by_flag") == STUDY


def test_difficulty_calibration_fits_the_studys_trees(spark, monkeypatch):
    assert _settings_of(spark, monkeypatch, "difficulty_calibration") == STUDY


def test_score_at_fits_the_studys_trees(spark, monkeypatch):
    assert _settings_of(spark, monkeypatch, "score_at") == STUDY


def test_batch_value_fits_the_studys_trees(spark, monkeypatch):
    assert _settings_of(spark, monkeypatch, "batch_value") == STUDY


def test_learning_curve_fits_the_studys_trees(spark, monkeypatch):
    assert _settings_of(spark, monkeypatch, "learning_curve") == STUDY
