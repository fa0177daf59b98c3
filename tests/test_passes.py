"""What a pass over rows holds in a worker and sends to the driver."""

import numpy as np
from pyspark import RDD
from pyspark.sql import functions as F

from crowdgap.operators import boosting as bo
from crowdgap.operators import clustering as cl
from crowdgap.operators import passes
from crowdgap.operators import vectors as vo
from crowdgap.session import materialise


def vectors(spark, n, d=4):
    x = [F.sin(F.col("id") * (j + 1)).cast("double") for j in range(d)]
    return spark.range(n).select("id", F.array(*x).alias("v"))


def test_pieces_are_bounded_whatever_the_rows(spark):
    blocks = passes.packed(vectors(spark, 70_000), "v", [F.col("id") % 2 == 0])
    sizes = blocks.map(lambda b: (len(b[0]), int(b[1].sum()))).collect()
    blocks.unpersist()
    assert max(n for n, _ in sizes) <= passes.PIECE_ROWS
    assert sum(n for n, _ in sizes) == 70_000 and sum(u for _, u in sizes) == 35_000


def test_signed_pieces_are_bounded(spark):
    rows = vectors(spark, 70_000).select((F.col("id") % 3).cast("int").alias("g"),
                                         (F.col("id") % 2 == 0).alias("hit"), F.col("v").alias("x"))
    blocks = vo._signed_blocks(rows.coalesce(1), 5)
    sizes = blocks.map(lambda b: len(b[0])).collect()
    blocks.unpersist()
    assert max(sizes) <= passes.PIECE_ROWS and sum(sizes) == 70_000


def test_one_sum_reaches_the_driver(spark, monkeypatch):
    """Runs of 8 partitions send as many numbers as runs of one, and the same ones every time."""
    df = vectors(spark, 80_000)
    sent = []
    collect = RDD.collect

    def count(self):
        out = collect(self)
        sent.append(sum(v.size for r in out for v in (r if isinstance(r, tuple) else (r,))
                        if isinstance(v, np.ndarray)))
        return out

    blocks = passes.packed(df, "v")
    assert blocks.getNumPartitions() == 8
    starts = [np.array([r.v for r in df.limit(40).collect()])] * 20
    monkeypatch.setattr(RDD, "collect", count)
    runs = [cl.lloyd(blocks, starts, max_iter=2) for _ in range(2)]
    blocks.unpersist()
    assert sent == [20 * (40 * 4 + 40 + 1)] * 4
    for (a, cost), (b, again) in zip(*runs):
        assert np.array_equal(a, b) and cost == again


def test_a_model_keeps_only_its_rows(spark):
    """A small subset beside all rows: pieces hold margins of the rows that a model uses."""
    rows = vectors(spark, 40_000).select(
        F.col("id"), F.col("v"), (F.col("id") % 2).cast("double").alias("__y"),
        F.array(F.col("id") < 100, F.lit(True)).alias("__use"))
    from pyspark.ml.functions import array_to_vector
    ready = rows.withColumn("features", array_to_vector("v"))
    booster = bo.Booster()
    edges = bo.bin_edges(ready, "features", 255)
    blocks = booster._blocks(ready, 40_000, edges, [0.0, 0.5])
    held = blocks.map(lambda b: [len(m) for m in b[3]]).collect()
    blocks.unpersist()
    assert np.sum(held, axis=0).tolist() == [100, 40_000]
    assert max(m[1] for m in held) <= passes.PIECE_ROWS


def test_density_joins_broadcast_no_vectors(spark, monkeypatch):
    """Copies of vectors are many times their table; estimates of checkpoints do not tell."""
    plans = []
    cut = cl.cut

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df)

    monkeypatch.setattr(cl, "cut", seen)
    cl.density_clusters(vectors(spark, 300), "id", 0.3, 3, vector="v", pivots=4).collect()
    links = [plan for columns, plan in plans if columns == ["a", "b", "border"]]
    assert links and "SortMergeJoin" in links[0] and "BroadcastHashJoin" not in links[0]
    assert not any("cell" in columns for columns, _ in plans)


def test_runs_of_few_rows_share_the_cores(spark, monkeypatch):
    """Hundreds of runs meet every row in a pass: some thousand rows are worth several tasks."""
    from crowdgap.operators import clustering as cl
    rows = spark.range(4000).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).alias("v"))
    found, real = [], cl.packed
    monkeypatch.setattr(cl, "packed", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    cl.kmeans_many(rows, [2], 1, 0, "v", ["c"], "id").count()
    cl.stability_ari(rows, "id", [2], 2, restarts=1, vector="v").count()
    assert [x.getNumPartitions() for x in found] == [4, 4]


def test_small_files_of_many_rows_are_dealt_again(spark):
    """A written table of equal rows is one small file; its pieces still go to all cores."""
    rows = materialise(spark.range(20000).coalesce(1).select(F.array(F.lit(1.0)).alias("v")), "equal")
    assert rows.rdd.getNumPartitions() == 1
    got = passes.packed(rows, "v", written=True, least=1000)
    assert got.getNumPartitions() == 8 and passes.summed(got, lambda x, u: x.sum(0))[0] == 20000
    got.unpersist()


def test_pieces_pass_one_python_worker(spark):
    """Packing is the only Python step behind a kept piece: no second worker of a task holds it too."""
    blocks = passes.packed(vectors(spark, 2_000), "v", [F.col("id") < 10])
    assert "PythonRDD" not in blocks._jrdd.toDebugString()
    x, use = blocks.first()
    assert x.shape[1] == 4 and use.sum() == 10 and blocks.is_cached
    blocks.unpersist()


def test_narrow_pieces_lose_nothing_and_repeated_vectors_take_little(spark):
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(5, 40)), 400, 0)
    x = np.hstack([rng.integers(0, 2, (2000, 3)), rng.normal(size=(2000, 1)), vectors,
                   rng.integers(0, 900, (2000, 1)) / 7]).astype(float)
    x[3, 0], x[4, 3], x[5, 3] = np.nan, -0.0, np.inf
    kept = passes.narrowed(x)
    again = passes.widened(kept)
    assert np.array_equal(x.view(np.int64), again.view(np.int64))
    size = sum(t.nbytes + (0 if c is None else c.nbytes) for _, t, c in kept[1])
    assert size < x.nbytes / 12
    assert passes.widened(passes.narrowed(np.zeros((0, 3)))).shape == (0, 3)

    rows = materialise(spark.range(3000).select(F.array(
        (F.col("id") % 3).cast("double"), F.rand(1), F.lit(2.0)).alias("v"), (F.col("id") % 2 == 0).alias("e")), "v")
    sums = []
    for narrow in (False, True):
        got = passes.packed(rows, "v", [F.col("e")], written=True, narrow=narrow)
        sums.append(passes.summed(got, lambda x, u: np.concatenate([x.sum(0), x[u[0]].sum(0)])))
        got.unpersist()
    assert np.array_equal(*sums)


def test_narrow_pieces_stay_where_their_files_are_read(spark, monkeypatch):
    """A design of few bytes and many numbers is not dealt again, which would write all its numbers."""
    monkeypatch.setattr(passes, "MOST_NUMBERS", 2000)
    rows = materialise(spark.range(6000).repartition(8).select(F.array(F.lit(1.0), F.lit(2.0)).alias("v")), "few")
    plan = []
    real = passes.cached
    monkeypatch.setattr(passes, "cached", lambda df, pack: plan.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or real(df, pack))
    got = passes.packed(rows, "v", written=True, least=100, narrow=True)
    assert passes.summed(got, lambda x, u: x.sum(0)).tolist() == [6000, 12000]
    assert "Repartition 6, true" not in plan[0] and "RoundRobin" not in plan[0] and ", true" not in plan[0]
    got.unpersist()
