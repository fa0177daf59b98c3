import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.operators import ordering as od
from crowdgap.operators import metrics, sampling as sm
from crowdgap.operators.joins import Quota, repair_ids, first_of, overlaps, assert_disjoint


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({"k": np.arange(n), "v": rng.integers(0, 300, n).astype(float),
                        # one group holds a third of the rows
                        "g": np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str)),
                        "y": rng.integers(0, 2, n)})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_rank_matches_sort(table):
    pdf, df = table
    got = od.with_rank(df, ["v", "k"], ["g"]).toPandas().set_index("k")
    want = pdf.sort_values(["v", "k"]).groupby("g").cumcount() + 1
    assert (got["rank"].sort_index() == want.sort_index()).all()
    assert (got["n_rank"].sort_index() == pdf.groupby("g").k.transform("size")).all()


def test_a_frequent_value_is_split(spark):
    rng = np.random.default_rng(9)
    v = np.where(rng.random(6000) < 0.4, 5.0, rng.normal(5, 3, 6000))
    pdf = pd.DataFrame({"k": rng.permutation(6000), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("k") % 10 > 0, F.col("v")))
    sizes = od.add_range_bucket(df, ["v", "k"], 16).groupBy("__bucket").count().toPandas()
    assert sizes["count"].sum() == 6000 and sizes["count"].max() < 1000
    got = od.with_rank(df, ["v", "k"]).toPandas().sort_values("k")
    pdf["v"] = pdf.v.where(pdf.k % 10 > 0)
    want = pdf.sort_values(["v", "k"], na_position="first").reset_index(drop=True)
    want["rank"] = want.index + 1
    assert (got["rank"].to_numpy() == want.sort_values("k")["rank"].to_numpy()).all()


def test_prior_totals_global(table):
    pdf, df = table
    got = od.with_prior(df, ["k"], {"v": "v"}).toPandas().sort_values("k")
    assert np.allclose(got.prior_v, pdf.v.cumsum() - pdf.v)


def test_quantiles_match_numpy(table):
    pdf, df = table
    got = od.exact_quantiles(df, "v", [0, 0.1, 0.333, 0.5, 0.975, 1], ["g"]).toPandas()
    for r in got.itertuples():
        want = np.percentile(pdf[pdf.g == r.g].v, [0, 10, 33.3, 50, 97.5, 100])
        assert np.allclose([r.q0, r.q1, r.q2, r.q3, r.q4, r.q5], want)


@pytest.fixture(scope="module")
def grouped(spark):
    """A group with most rows, one that is NULL, and small ones."""
    rng = np.random.default_rng(4)
    n = 14_000
    group = rng.choice(["hot", "none", "a", "b"], n, p=[.5, .4, .06, .04])
    pdf = pd.DataFrame({"k": rng.permutation(n), "g": group, "v": rng.integers(0, 50, n)})
    df = spark.createDataFrame(pdf).withColumn("g", F.expr("nullif(g, 'none')")).repartition(9)
    return pdf.assign(s=pdf.k.astype(str)), df.cache()


@pytest.mark.parametrize("n", [3, 999, 1000, 5000])
@pytest.mark.parametrize("kind", ["asc", "desc", "md5", "string"])
def test_first_rows_of_any_order_and_size(grouped, n, kind):
    pdf, df = grouped
    order = {"asc": ["v", "k"], "desc": [F.desc("v"), "k"], "md5": [od.shuffle_key(1, "k"), "k"],
             "string": [F.col("k").cast("string")]}[kind]
    key = {"asc": pdf.v * 10 ** 6 + pdf.k, "desc": -pdf.v * 10 ** 6 + pdf.k, "string": pdf.s,
           "md5": [hashlib.md5(f"1:{k}".encode()).hexdigest() for k in pdf.k]}[kind]
    want = pdf.assign(o=key).sort_values("o")
    want["rn"] = want.groupby("g").cumcount() + 1
    want = want[want.rn <= n]
    got = od.first_rows(df, ["g"], order, n).toPandas()
    assert sorted(zip(got.k, got.rn)) == sorted(zip(want.k, want.rn))


def test_null_groups_are_groups(grouped):
    pdf, df = grouped
    got = od.with_prior(df, ["k"], {"v": "v"}, ["g"]).toPandas()
    assert len(got) == len(pdf)
    want = pdf.sort_values("k").groupby("g").v.cumsum() - pdf.sort_values("k").v
    by_key = dict(zip(pdf.sort_values("k").k, want))
    assert all(by_key[k] == p for k, p in zip(got.k, got.prior_v))
    folds = sm.strat_folds(df, "g", "k", 5, 0).groupBy("g", "fold").count().toPandas()
    assert folds["count"].sum() == len(pdf) and folds.groupby("g", dropna=False)["count"].agg(np.ptp).max() <= 1
    q = {r.g: r.q0 for r in od.exact_quantiles(df, "v", [.5], ["g"]).collect()}
    assert q[None] == np.median(pdf[pdf.g == "none"].v)
    marked = df.withColumn("y", F.col("k") % 2)
    assert {r.g for r in metrics.auc(marked, "y", "v", by=["g"]).collect()} == {None, "hot", "a", "b"}


def test_samples_of_any_size_are_the_same(grouped, monkeypatch):
    _, df = grouped
    few = {r.k for r in sm.sample_n(df, "k", 700, 3).collect()}
    monkeypatch.setattr(sm, "GROUP_LIMIT", 0)
    assert {r.k for r in sm.sample_n(df, "k", 700, 3).collect()} == few and len(few) == 700


def test_auc_with_ties_matches_pairs(table):
    pdf, df = table
    got = metrics.auc(df, "y", "v").first()
    p, q = pdf[pdf.y == 1].v.to_numpy(), pdf[pdf.y == 0].v.to_numpy()
    want = ((p[:, None] > q) + 0.5 * (p[:, None] == q)).mean()
    assert got.auc == pytest.approx(want) and got.n == len(pdf)
    strict = metrics.auc(df, "y", "v", ties=0.0).first().auc
    assert strict == pytest.approx((p[:, None] > q).mean())


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, p double")
    assert metrics.auc(df, "y", "p").first().auc is None


def test_ari_extremes(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) * 7, i) for i in range(30)], "a int, b int, c int")
    assert metrics.ari(df, "a", "b").first().ari == pytest.approx(1.0)
    assert metrics.ari(df, "a", "c").first().ari == pytest.approx(0.0)


def test_band_metrics_skips_small_and_one_class(spark):
    rows = ([("big", i % 2, i / 200) for i in range(200)] + [("small", i % 2, 0.5) for i in range(50)]
            + [("one", 1, 0.5) for _ in range(150)])
    df = spark.createDataFrame(rows, "band string, y int, p double")
    assert [r.band for r in metrics.band_metrics(df, "band", "y", "p").collect()] == ["big"]


def test_nan_cost_is_never_flagged(spark):
    rows = [(float("nan"), 0.01), (None, 0.01), (100.0, 0.05), (99.999, 0.01), (100.0, 0.05004)]
    df = spark.createDataFrame(rows, "cost double, p double")
    flags = [r.f for r in df.select(m.disagreement("cost", "p").alias("f")).collect()]
    assert flags == [False, False, True, False, False]


def test_band_edges_are_right_closed(spark):
    df = spark.createDataFrame([(0,), (1,), (2000,), (2001,), (2800,), (4000,), (4001,), (None,)],
                               "r int")
    got = [r.b for r in df.select(m.band("r", m.REPORT_EDGES, m.REPORT_LABELS).alias("b")).collect()]
    assert got == [None, "<2000", "<2000", "2000-2200", "2600-2800", "2800+", None, None]


def test_mates_are_clamped_by_distance(spark):
    df = spark.createDataFrame([(None, 3, "w"), (None, 3, "b"), (None, -2, "w"), (35.0, None, "b")],
                               "cp double, mate int, stm string")
    got = [r.s for r in df.select(m.pov_score("cp", "mate", "stm").alias("s")).collect()]
    assert got == [1997.0, -1997.0, -1998.0, -35.0]


def walk_quota(rows, quotas):
    """The sequential sampler, one group at a time."""
    got, out = {q.name: 0 for q in quotas}, []
    for gid, seq, we, be, nw, nb in sorted(rows, key=lambda r: r[1]):
        for q in quotas:
            if got[q.name] >= q.want:
                continue
            side = "w" if q.lo <= we <= q.hi else "b" if q.lo <= be <= q.hi else None
            if side:
                n = nw if side == "w" else nb
                if n:
                    got[q.name] += n
                    out.append((gid, q.name, side, n))
                break
    return sorted(out)


@pytest.mark.parametrize("wants", [(40, 60), (10 ** 6, 50), (1, 10 ** 6)])
def test_quota_rows_equals_the_sequential_walk(spark, wants):
    rng = np.random.default_rng(3)
    rows = [(i, int(s), int(a), int(b), int(x), int(y)) for i, (s, a, b, x, y) in enumerate(zip(
        rng.permutation(600), rng.integers(2400, 3000, 600), rng.integers(2400, 3000, 600),
        rng.integers(0, 4, 600), rng.integers(0, 4, 600)))]
    quotas = [Quota("top", 2800, 9999, wants[0]), Quota("next", 2600, 2799, wants[1])]
    df = spark.createDataFrame(rows, "gid int, seq int, we int, be int, nw int, nb int")
    got = sm.quota_rows(df, quotas, "seq", "we", "be", "nw", "nb")
    assert sorted((r.gid, r.band, r.side, r.rows) for r in got.collect()) == walk_quota(rows, quotas)


def test_groups_never_straddle_folds(table):
    pdf, df = table
    folds = sm.group_folds(df, "g", 5).toPandas()
    assert folds.g.is_unique and set(folds.fold) == set(range(5))
    small = folds[folds.g != "hot"].groupby("fold").n_rows.sum()
    assert small.max() - small.min() < 2 * folds[folds.g != "hot"].n_rows.max()
    hold = sm.group_holdout(df, "g", 0.2, 0).toPandas()
    assert hold.g.is_unique and hold.is_test.sum() == int(len(hold) * 0.2)


def test_placeholder_groups_become_singletons(spark):
    df = spark.createDataFrame([("a", "?"), ("b", "?"), ("c", "g1"), ("d", "?")], "fen string, gid string")
    fix = spark.createDataFrame([("a", "e7")], "fen string, gid string")
    got = {r.fen: r.gid for r in repair_ids(df, fix, "fen", "gid").collect()}
    assert got["a"] == "e7" and got["c"] == "g1"
    assert got["b"] != got["d"] and got["b"].startswith("orph_")


def test_first_source_with_a_value_wins(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", 5, 2)], "k string, w int, b int")
    b = spark.createDataFrame([("x", 7, 3), ("y", 9, 4)], "k string, w int, b int")
    got = {r.k: (r.w, r.b) for r in first_of([a, b], "k", "w", ["w", "b"]).collect()}
    assert got == {"x": (7, 3), "y": (5, 2)}


def test_disjointness_guard(spark):
    a, b = spark.range(5), spark.range(4, 9)
    assert [r.id for r in overlaps([a, b], "id").collect()] == [4]
    with pytest.raises(ValueError):
        assert_disjoint([a, b], "id")
    with pytest.raises(ValueError):
        sm.disjoint_sets(spark.range(20).withColumn("f", F.lit(1)), ["f"], "id",
                         {"a": 10, "b": 8, "c": 10}, 1)


def test_disjoint_sets_have_their_sizes(spark):
    df = spark.range(100).withColumn("f", F.col("id") % 2)
    got = sm.disjoint_sets(df, ["f"], "id", {"a": 10, "b": 8, "c": 10}, 1).toPandas()
    assert got.id.is_unique
    assert got.groupby(["f", "set"]).size().tolist() == [10, 8, 10, 10, 8, 10]


def test_empty_band_keeps_its_row(spark):
    from crowdgap.operators.aggregates import band_report
    df = spark.createDataFrame([(2100, True, False), (2100, False, True)],
                               "mover_rating int, flagged boolean, found boolean")
    got = {r.band: (r.n_normal, r.n_flagged) for r in band_report(df).collect()}
    assert len(got) == 6 and got["2000-2200"] == (1, 1) and got["2800+"] == (0, 0)
