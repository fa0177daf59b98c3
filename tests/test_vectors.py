import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdgap.functions import vectors as fv
from crowdgap.operators import clustering as cl
from crowdgap.operators import vectors as vo


def frame(spark, x, **more):
    rows = [(i, [float(a) for a in v], *[more[c][i] for c in more]) for i, v in enumerate(x)]
    kinds = {c: ("int" if isinstance(v[0], int) else "double" if isinstance(v[0], float)
                 else "string") for c, v in more.items()}
    schema = "id int, v array<double>" + "".join(f", {c} {k}" for c, k in kinds.items())
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    centre = np.eye(16)[:4] * 3
    lab = [i % 4 for i in range(200)]
    x = centre[lab] + rng.normal(scale=0.3, size=(200, 16))
    return x, lab, frame(spark, x, lab=lab).repartition(4).cache()


def test_two_shifted_coordinates_are_found(spark):
    """One side is moved along two of twenty axes, the first twice as far."""
    rng = np.random.default_rng(77)
    x = rng.uniform(-.4, .4, size=(90, 20))
    side = np.arange(90) % 3 > 0
    x[side, 5] += 3.0
    x[side, 11] -= 1.5
    steps = frame(spark, x, side=["pos" if s else "neg" for s in side])
    v, slack = vo.contrast_direction(steps, vec="v")
    strong = np.argsort(-np.abs(v))[:2]
    assert strong[0] == 5 and v[5] > 0 and v[11] <= 0 and slack < 2.5
    assert np.abs(np.delete(v, [5, 11])).max() < 0.1 * v[5]
    tagged = steps.withColumn("g", F.lit("one"))
    small = vo.contrast_directions(tagged, "g", vec="v").first().v
    large = vo.contrast_directions(tagged.repartition(7), "g", vec="v").first().v
    assert np.dot(small, v) > 0.99 and np.dot(large, v) > 0.99


def test_nearest_is_the_same_in_pieces(planted, monkeypatch):
    x, lab, df = planted
    cents = vo.centroids_of(df, "lab", "v")
    rows = df.select("id", fv.l2norm("v").alias("u"))
    whole = vo.assign_nearest(rows, cents, "lab", "u").toPandas().sort_values("id")
    monkeypatch.setattr(fv, "MAX_BLOCK_NUMBERS", 20)
    monkeypatch.setattr(fv.blocks, "__defaults__", (20,))
    parts = vo.assign_nearest(rows, cents, "lab", "u").toPandas().sort_values("id")
    assert whole.lab.tolist() == parts.lab.tolist() == lab
    assert np.allclose(whole.margin, parts.margin) and (whole.margin > 0).all()
    assert vo.self_consistency(df, "lab", "v").first().agreement == 1.0


def test_silhouette_matches_definition_and_pieces(planted, monkeypatch):
    x, lab, df = planted
    lab = np.array(lab)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = d[i][lab == lab[i]].sum() / (sum(lab == lab[i]) - 1)
        other = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((other - own) / max(own, other))
    got = cl.silhouette(df, "lab", "id", "v", sample=None).first()
    assert got.silhouette == pytest.approx(np.mean(s), abs=1e-9) and got.n == 200
    monkeypatch.setattr(fv.blocks, "__defaults__", (700,))
    again = cl.silhouette(df, "lab", "id", "v", sample=None).first()
    assert again.silhouette == pytest.approx(got.silhouette, abs=1e-12)


def test_null_keeps_each_dimension(spark, planted):
    x, _, df = planted
    null = cl.shuffle_null(df, "id", 3, "v").toPandas()
    got = np.stack(null.v.map(np.asarray))
    assert got.shape == x.shape and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-6)
    # before renormalising, a dimension holds the same values: ratios inside a row undo the norm
    assert sorted(null.row) == list(range(1, 201))


def test_planted_structure_beats_its_null(planted):
    _, _, df = planted
    row = cl.k_sweep(df, "id", [4], restarts=2, vector="v").first()
    assert row.real > 0.5 and row.margin > 0.3
    ari = cl.stability_ari(df, "id", [4], 2, restarts=2, vector="v").first()
    assert ari.mean_ari > 0.95 and ari.verdict == "stable"


def test_permutation_tests_agree(spark):
    rng = np.random.default_rng(2)
    lab = [int(i) for i in rng.integers(0, 4, 300)]
    y = [int(rng.random() < (0.8 if c == 0 else 0.3)) for c in lab]
    z = [int(rng.random() < 0.5) for _ in lab]
    df = frame(spark, np.zeros((300, 1)), lab=lab, y=y, z=z)
    strong = cl.perm_test(df, "lab", "y", "id", 60).first()
    assert strong.p_value == 0 and strong.significant
    slow = cl.perm_test(df, "lab", "z", "id", 200).first()
    fast = cl.perm_test_counts(df, "lab", "z", 2000).first()
    assert slow.observed == pytest.approx(fast.observed)
    assert slow.null_mean == pytest.approx(fast.null_mean, rel=0.25)
    assert abs(slow.p_value - fast.p_value) < 0.15


def slow_dbscan(x, eps, min_pts):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= min_pts
    root = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min([root[j] for j in np.flatnonzero(d[i] & core)]) if core[i] else -1
                        for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        root[i] = root[near[0]] if len(near) else -1
    return root


@pytest.mark.parametrize("block,pivots", [(2000, 8), (15, 5), (7, 1)])
def test_density_clusters_match_brute_force(spark, block, pivots):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.3, (50, 2)),
                   rng.uniform(-3, 6, (30, 2))])
    want = slow_dbscan(x, 0.4, 5)
    got = cl.density_clusters(frame(spark, x), "id", 0.4, 5, vector="v", pivots=pivots,
                              block=block).toPandas().sort_values("id")
    assert got.cluster.fillna(-1).astype(int).tolist() == want.tolist()


def test_density_merges_copies_and_drops_small_groups(spark):
    x = np.array([[0.0, 0.0]] * 6 + [[5.0, 5.0]] * 3 + [[9.0, 9.0]])
    got = cl.density_clusters(frame(spark, x), "id", 0.1, 3, min_size=5, vector="v",
                              pivots=2).toPandas().sort_values("id")
    assert got.cluster.fillna(-1).astype(int).tolist() == [0] * 6 + [-1] * 4


def test_components_of_a_chain(spark):
    nodes = spark.range(12).withColumnRenamed("id", "k")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(10, 11)], "a long, b long")
    got = {r.k: r.root for r in cl.connected_components(nodes, edges, "k").collect()}
    assert all(got[i] == 0 for i in range(9)) and got[9] == 9 and got[11] == 10


def test_mixture_prefers_the_planted_number(planted):
    _, _, df = planted
    bic = {r.k: r.bic for r in cl.gmm_bic(df, [1, 2, 4], "id", "v", max_iter=15).collect()}
    assert bic[4] < bic[2] < bic[1]


def test_leaders_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = [float(a) for a in rng.random(80)]
    groups = []
    for i in np.argsort(-np.array(score)):
        for g in groups:
            if u[i] @ u[g[0]] > 0.6:
                g.append(i)
                break
        else:
            groups.append([i])
    want = {int(i): n for n, g in enumerate(groups) for i in g}
    df = frame(spark, x, score=score)
    got = vo.leader_clusters(df, "id", "score", block=4).toPandas()
    assert dict(zip(got.id, got.cluster)) == want


def test_basis_share_and_novelty(spark):
    rng = np.random.default_rng(5)
    basis, x = rng.normal(size=(3, 8)), rng.normal(size=(20, 8))
    got = vo.basis_r2(frame(spark, x), basis, [0.0] * 8, "v").toPandas().sort_values("id")
    for i, v in enumerate(x):
        coef, r2 = vo.basis_coefficients(v, basis)
        assert got.r2.iloc[i] == pytest.approx(r2) and len(coef) == 3
    inside = frame(spark, basis)
    n = vo.novelty(inside, basis, rng.normal(size=(2, 8)), "v").toPandas()
    assert (n.novelty > 0).all()


def test_dictionary_finds_shared_parts(spark):
    rng = np.random.default_rng(6)
    part = np.eye(12)[:4]
    x = np.vstack([part[rng.integers(0, 4, 120)] + rng.normal(scale=0.02, size=(120, 12))])
    flag = [int(i % 2) for i in range(120)]
    df = frame(spark, x, flag=flag).withColumn("flag", F.col("flag") == 1)
    atoms = cl.dictionary_fit(df, "id", 8, 0.3, 5, vector="v")
    assert (np.abs(atoms @ part.T).max(axis=0) > 0.9).all()
    rates = cl.atom_rates(df, atoms, "flag", 0.3, "v").toPandas()
    assert len(rates) == 8 and rates.flagged_rate.between(0, 1).all()


def test_codes_solve_the_penalised_problem():
    rng = np.random.default_rng(8)
    x, atoms = rng.normal(size=(5, 6)), rng.normal(size=(4, 6))
    code = cl.sparse_codes(x, atoms, 0.5, 4000)
    grad = (code @ atoms - x) @ atoms.T
    on = np.abs(code) > 1e-8
    assert np.allclose(grad[on], -0.5 * np.sign(code[on]), atol=1e-4)
    assert (np.abs(grad[~on]) <= 0.5 + 1e-4).all()


def test_missing_vector_fails_the_job(spark):
    from crowdgap.operators.joins import attach_vectors
    with pytest.raises(Exception, match="no vector for key"):
        attach_vectors(spark.range(3), frame(spark, np.zeros((2, 2))).withColumnRenamed("v", "embedding"),
                       "id").collect()


@pytest.mark.parametrize("keys", [500, 3, 0])
def test_start_rows_send_vectors_of_chosen_rows_only(spark, monkeypatch, keys):
    """Also where keys repeat or are null; every task would send START_ROWS vectors otherwise."""
    monkeypatch.setattr(cl, "START_ROWS", 20)
    src = spark.range(500).select(F.when(F.lit(keys > 0), F.col("id") % max(keys, 1)).alias("k"),
                                  F.array(F.col("id") % max(keys, 1) + 0.5).alias("v"))
    taken = []
    real = type(src).where
    monkeypatch.setattr(type(src), "where", lambda d, c: taken.append(real(d, c)) or taken[-1])
    got, use = cl.start_rows(src.repartition(8), "k", "v", 3, [F.lit(True)])
    monkeypatch.undo()
    order = src.select("k", F.md5(F.concat_ws(":", F.lit("3"), F.col("k").cast("string"))).alias("h"), "v")
    want = [r.v for r in order.orderBy("h", "k").limit(20).collect()]
    assert got.tolist() == [list(map(float, v)) for v in want] and use.shape == (1, 20) and use.all()
    assert len(taken) == 1 and taken[0].count() in {500: [20], 3: [166, 167], 0: [500]}[keys]


def test_kmeans_computes_its_input_for_the_passes_and_for_the_labels_only(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        seen.add(1)
        return [1.0, float(i % 2), i / 1000]

    rows = cl.kmeans_many(spark.range(60).select("id", vector("id").alias("v")), [2], 3, 0, "v", ["c"],
                          "id").select("id", "c").collect()
    assert seen.value == 120
    assert len({(r.id % 2, r.c) for r in rows}) == 2


def brute_silhouette(x, lab):
    d = np.sqrt(np.maximum(((x[:, None] - x) ** 2).sum(-1), 0))
    out = []
    for i in range(len(x)):
        same = lab == lab[i]
        a = d[i][same].sum() / max(same.sum() - 1, 1)
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        out.append(0.0 if same.sum() < 2 else (b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_of_pieces_that_meet_in_pairs(spark, monkeypatch):
    """Many pieces in several partitions give the sums of one; a row alone in its cluster scores 0."""
    from crowdgap.operators import passes
    rng = np.random.default_rng(2)
    x, lab = rng.normal(size=(300, 4)), rng.integers(0, 3, 300)
    lab[7] = 9
    x[10] = x[11]
    df = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, lab))],
                               "id int, v array<double>, lab int").repartition(4)
    one = cl.silhouette(df, "lab", "id", "v", None).first()
    monkeypatch.setattr(passes, "PIECE_ROWS", 20)
    monkeypatch.setattr(passes, "LEAST_ROWS", 100)
    monkeypatch.setattr(cl, "PAIR_ROWS", 7)
    monkeypatch.setattr(cl, "PAIR_COLUMNS", 11)
    many = cl.silhouette(df, "lab", "id", "v", None).first()
    assert one.n == many.n == 300
    assert one.silhouette == pytest.approx(brute_silhouette(x, lab), abs=1e-9)
    assert many.silhouette == pytest.approx(one.silhouette, abs=1e-9)
    none = cl.silhouette(df.where("lab > 99"), "lab", "id", "v", None).first()
    assert none.n == 0 and none.silhouette is None


def test_hierarchy_is_scored_on_every_row(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1300, 3)) + np.repeat([[4, 0, 0], [0, 4, 0]], 650, 0)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, e array<double>")
    got = cl.hier_vs_kmeans(df, "id", 3, 1, vector="e").first()
    labels = dict(cl.bisecting(df, 3, 0, "e", "hier").select("id", "hier").collect())
    want = brute_silhouette(x, np.array([labels[i] for i in range(1300)]))
    assert got.silhouette == pytest.approx(want, abs=1e-9)


def test_components_keep_estimates_small(spark, monkeypatch):
    """A checkpoint inherits its plan's estimate; a product of them in every round outgrows the driver."""
    bits = []
    real = type(spark.range(1)).join

    def joined(self, *a, **k):
        out = real(self, *a, **k)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(type(spark.range(1)), "join", joined)
    nodes = spark.range(64).withColumnRenamed("id", "k")
    edges = nodes.where("k > 0").select(F.col("k").alias("a"), (F.col("k") - 1).alias("b"))
    order = F.xxhash64("a") % 1000
    got = cl.connected_components(nodes, edges.orderBy(order), "k").collect()
    assert {r.root for r in got} == {0} and len(bits) >= 8
    assert max(bits) < 500
