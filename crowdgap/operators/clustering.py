"""Clustering and its validation: k-means, nulls, silhouettes, stability, other lenses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.functions.measures import col
from crowdgap.functions.vectors import as_double, l2norm, stack
from crowdgap.operators.metrics import ari
from crowdgap.operators.ordering import (
    bucket_count, md5_bucket, md5_int, shuffle_key, with_rank)
from crowdgap.operators.passes import add, packed, summed
from crowdgap.session import cut, materialise, parallelism


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("__features", array_to_vector(l2norm(vector)))


# Rows that the first centres of a run are drawn from; the runs themselves pass over all rows.
START_ROWS = 2000


def first_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows, each drawn with a chance that grows with its squared distance to those drawn."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    gap = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < min(k, len(x)):
        total = gap.sum()
        at = int(np.searchsorted(np.cumsum(gap), rng.random() * total)) if total > 0 \
            else int(rng.integers(len(x)))
        picked.append(min(at, len(x) - 1))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each row's nearest centre; ties go to the first."""
    gap = (x ** 2).sum(1)[:, None] + (centres ** 2).sum(1) - 2 * x @ centres.T
    # rounding keeps exact ties exact whatever the order of summation was
    at = np.round(gap, 12).argmin(1)
    return at, np.maximum(gap[np.arange(len(x)), at], 0.0)


# Rows and centres whose distances are computed at a time: they stay in a core's cache.
STEP_ROWS, STEP_CENTRES = 1024, 512
# Rows of a partition at least: a row meets hundreds of runs in a pass, so few rows are worth a task.
RUN_ROWS = 1000


def run_sums(x, use, models) -> np.ndarray:
    """For each (centres, member) in turn: sums, counts and cost of the assigned rows.

    Models of equal size share products with all rows; rows that a member leaves out count nothing.
    A row belongs to the first of its nearest centres, by distances rounded as in ``nearest_centre``.
    """
    d = x.shape[1]
    ends = np.cumsum([0] + [c.size + len(c) + 1 for c, _ in models])
    out = np.zeros(ends[-1])
    length, wide = (x ** 2).sum(1) * 1e12, np.hstack([x, np.ones((len(x), 1))])
    sizes: dict[int, list[int]] = {}
    for i, (c, _) in enumerate(models):
        sizes.setdefault(len(c), []).append(i)
    for k, alike in sizes.items():
        most = max(1, STEP_CENTRES // k)
        for some in (alike[i:i + most] for i in range(0, len(alike), most)):
            m = len(some)
            c = np.stack([models[i][0] for i in some], 1).reshape(k * m, d)
            # one product gives squared distances, less the row's own length, in units of 1e-12
            sides = np.hstack([c * -2e12, (c ** 2).sum(1)[:, None] * 1e12])
            sums, counts, cost = np.zeros((k * m, d)), np.zeros(k * m), np.zeros(m)
            every = all(models[i][1] is None for i in some)
            for lo in range(0, len(x), STEP_ROWS):
                rows = x[lo:lo + STEP_ROWS]
                gap = sides @ wide[lo:lo + STEP_ROWS].T
                gap += length[lo:lo + STEP_ROWS]
                np.rint(gap, out=gap)
                gap = gap.reshape(k, m, len(rows))
                near, at = gap[0].copy(), np.zeros((m, len(rows)), np.int8 if k < 128 else np.int32)
                for j in range(1, k):
                    np.copyto(at, j, where=gap[j] < near)
                    np.minimum(near, gap[j], out=near)
                hit = at == np.arange(k, dtype=at.dtype)[:, None, None]
                near = np.maximum(near / 1e12, 0.0)
                if not every:
                    mine = np.stack([np.ones(len(rows), bool) if models[i][1] is None
                                     else use[models[i][1]][lo:lo + STEP_ROWS] for i in some])
                    hit &= mine
                    near *= mine
                onehot = hit.reshape(k * m, len(rows)).astype(float)
                sums += onehot @ rows
                counts += onehot.sum(1)
                cost += near.sum(1)
            sums, counts = sums.reshape(k, m, d), counts.reshape(k, m)
            for j, i in enumerate(some):
                out[ends[i]:ends[i + 1]] = np.concatenate([sums[:, j].ravel(), counts[:, j], cost[j:j + 1]])
    return out


def lloyd(blocks, starts: Sequence[np.ndarray], members: Sequence[int | None] | None = None,
          max_iter: int = 300) -> list[tuple[np.ndarray, float]]:
    """(centres, cost) of many k-means runs that share every pass over the rows.

    A run ends when its centres stay; it then leaves the passes. A centre without rows stays.
    """
    members = members or [None] * len(starts)
    centres = [np.array(c, float) for c in starts]
    cost = [float("inf")] * len(starts)
    open_ = list(range(len(starts)))
    for _ in range(max_iter):
        models = [(centres[m], members[m]) for m in open_]
        flat = summed(blocks, lambda x, u, m=models, f=run_sums: f(x, u, m),
                      sum(c.size + len(c) + 1 for c, _ in models))
        at, left = 0, []
        for m in open_:
            k, d = centres[m].shape
            sums = flat[at:at + k * d].reshape(k, d)
            n = flat[at + k * d:at + k * d + k]
            cost[m] = float(flat[at + k * d + k])
            at += k * d + k + 1
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[m])
            if np.abs(new - centres[m]).max() > 1e-10:
                left.append(m)
            centres[m] = new
        open_ = left
        if not open_:
            break
    return list(zip(centres, cost))


def start_rows(df: DataFrame, key: str, vector: str, seed, use: Sequence[Column] = ()):
    """(matrix, use) of a bounded sample in seeded order.

    Every task sends its first rows to the driver, so these are keys only. The vectors of the rows that
    are first of all follow in a second scan.
    """
    src = df.select(shuffle_key(seed, key).alias("h"), col(key).alias("k"), as_double(vector).alias("v"),
                    F.array(*use).cast("array<boolean>").alias("u"))
    first = src.select("h", "k").orderBy("h", "k").limit(START_ROWS).collect()
    if first:
        last = first[-1]
        same = F.col("k").isNull() if last.k is None else F.col("k").isNull() | (F.col("k") <= F.lit(last.k))
        src = src.where((F.col("h") < last.h) | (F.col("h") == last.h) & same)
    rows = src.orderBy("h", "k").limit(START_ROWS).collect()
    return np.array([r.v for r in rows], float), np.array([r.u for r in rows], bool).reshape(
        len(rows), len(use)).T


def best_runs(blocks, sample: np.ndarray, use: np.ndarray, wanted: Sequence[tuple[int, int | None]],
              restarts: int, seed: int) -> list[np.ndarray]:
    """Centres of the best of ``restarts`` runs for each (k, member)."""
    starts, members = [], []
    for k, member in wanted:
        x = sample if member is None or not use[member].any() else sample[use[member]]
        starts += [first_centres(x, k, seed + r) for r in range(restarts)]
        members += [member] * restarts
    runs = lloyd(blocks, starts, members)
    return [min(runs[i:i + restarts], key=lambda r: r[1])[0]
            for i in range(0, len(runs), restarts)]


def labelled(df: DataFrame, centres: Sequence[np.ndarray], names: Sequence[str],
             vector: str) -> DataFrame:
    """Each row's nearest centre in each set of centres."""
    sets = list(centres)

    @F.pandas_udf("array<int>")
    def place(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        x = stack(v)
        return pd.Series(list(np.stack([nearest_centre(x, c)[0] for c in sets], 1).astype(np.int32)))

    out = df.withColumn("__at", place(as_double(vector)))
    return out.withColumns({n: F.col("__at")[i] for i, n in enumerate(names)}).drop("__at")


def kmeans_many(df: DataFrame, ks: Sequence[int], restarts: int = 8, seed: int = 0,
                vector: str = "embedding", names: Sequence[str] | None = None,
                key: str | None = None) -> DataFrame:
    """Labels of the best of several seeded runs on unit vectors, for each k; all runs share passes.

    The input, often a join, is computed twice: for the passes and for the labels.
    """
    unit = df.withColumn("__u", l2norm(vector))
    held = materialise(unit.select(
        (F.xxhash64("__u") if key is None else col(key)).alias("__k"), "__u"), "vectors")
    blocks = packed(held, "__u", written=True, least=RUN_ROWS)
    try:
        sample, use = start_rows(held, "__k", "__u", seed)
        best = best_runs(blocks, sample, use, [(k, None) for k in ks], restarts, seed)
    finally:
        blocks.unpersist()
    names = names or [f"k{k}" for k in ks]
    return labelled(unit, best, names, "__u").drop("__u")


def kmeans(df: DataFrame, k: int, restarts: int = 8, seed: int = 0, vector: str = "embedding",
           label: str = "cluster") -> DataFrame:
    """Best of several seeded runs on unit vectors."""
    return kmeans_many(df, [k], restarts, seed, vector, [label])


def bisecting(df: DataFrame, k: int, seed: int = 0, vector: str = "embedding",
              label: str = "cluster") -> DataFrame:
    """Top-down hierarchical partition."""
    ready = _features(df, vector)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="__features", predictionCol=label).fit(ready)
    return model.transform(ready).drop("__features")


def silhouette(df: DataFrame, label: str, key: str, vector: str = "embedding",
               sample: int | None = 1200, seed=0) -> DataFrame:
    """Exact mean Euclidean silhouette of a seeded sample (``None``: of every row).

    Pieces of rows meet in pairs, each pair once; a pair adds up its rows' distances by cluster, so
    no pair of rows is ever emitted and neither the driver nor a task holds more than a few pieces.
    Rows alone in their cluster score 0.
    """
    pool = df.select(key, col(label).cast("string").alias("c"), as_double(vector).alias("v"))
    if sample is not None:
        pool = pool.orderBy(shuffle_key(seed, key), key).limit(sample)
    pool = cut(pool)
    sizes = {r.c: r["count"] for r in pool.groupBy("c").count().collect()}     # one row per cluster
    if not sizes:
        return df.sparkSession.createDataFrame([(None, 0)], "silhouette double, n long")
    names = sorted(sizes)
    slot = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("c")) - 1
    rows = pool.select(F.concat("v", F.array(slot.cast("double"))).alias("x"))
    counts = np.array([sizes[n] for n in names], float)

    def number(at, it):
        for j, (x, _) in enumerate(it):
            yield (at, j), x

    def meet(it, sums=distance_sums):
        held: dict = {}
        for (i, a), (j, b) in it:
            if i <= j:
                for at, part in zip((i, j) if i < j else (i,), sums(a, b, len(counts), i == j)):
                    held[at] = held[at] + part if at in held else part
        yield from held.items()

    # kept once, with their numbers
    numbered = packed(rows, "x", written=True).unpersist().mapPartitionsWithIndex(number).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        whole = numbered.cartesian(numbered).mapPartitions(meet).reduceByKey(add).values().map(
            lambda d, f=silhouette_sums: f(d, counts)).fold(np.zeros(3), add)
    finally:
        numbered.unpersist()
    total, known, n = (float(v) for v in whole)
    return df.sparkSession.createDataFrame([(total / known if known else None, int(n))],
                                           "silhouette double, n long")


# Rows of one side and of the other whose distances are computed at a time.
PAIR_ROWS, PAIR_COLUMNS = 256, 4096


def distance_sums(a: np.ndarray, b: np.ndarray, k: int, same: bool) -> list[np.ndarray]:
    """Of the rows of ``a``, then of ``b``: summed distances to each cluster of the other side.

    A row's last number is its cluster; one more column gives it back where ``a`` and ``b`` are the same.
    """
    sides = [(x[:, :-1], x[:, -1].astype(int)) for x in (a, b)]
    (x, own), (y, others) = sides
    out = [np.zeros((len(x), k + 1)), np.zeros((len(y), k + 1))]
    hot = [np.eye(k)[c] for c in (own, others)]
    long_x, long_y = (x ** 2).sum(1), (y ** 2).sum(1)
    for lo in range(0, len(x), PAIR_ROWS):
        for at in range(0, len(y), PAIR_COLUMNS):
            rows, cols = slice(lo, lo + PAIR_ROWS), slice(at, at + PAIR_COLUMNS)
            gap = long_x[rows, None] + long_y[cols] - 2 * x[rows] @ y[cols].T
            # the expansion leaves rounding noise where rows coincide
            gap[gap < 1e-12] = 0.0
            np.sqrt(gap, out=gap)
            out[0][rows, :k] += gap @ hot[1][cols]
            if not same:
                out[1][cols, :k] += gap.T @ hot[0][rows]
    if same:
        out[0][:, k] = own
        return out[:1]
    return out


def silhouette_sums(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of scores, rows that have one, and rows, from summed distances to every cluster."""
    own, at = d[:, -1].astype(int), np.arange(len(d))
    mean = d[:, :-1] / sizes
    mean[at, own] = np.inf
    near = mean.min(axis=1)
    alone = sizes[own] < 2
    a = d[at, own] / np.maximum(sizes[own] - 1, 1)
    top = np.maximum(a, near)
    score = np.where(alone | (top == 0), 0.0, (near - a) / np.where(top == 0, 1.0, top))
    known = alone | np.isfinite(near)
    return np.array([score[known].sum(), known.sum(), len(d)], float)


def shuffle_null(df: DataFrame, key: str, seed, vector: str = "embedding") -> DataFrame:
    """Structureless control: every dimension is permuted on its own, rows are renormalised.

    Two ranks and one regrouping: a value goes to the row whose number is its rank within its
    dimension. Ranks are bucketed by md5 prefix, so no dimension is sorted in one task.
    """
    cells = df.select(key, F.posexplode(as_double(vector)).alias("dim", "x"))
    hashed = cells.withColumn("__h", shuffle_key(seed, "dim", key))
    placed = with_rank(hashed, ["__h", key], ["dim"],
                       md5_bucket(F.col("__h"), bucket_count(df)), "row")
    rows = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("c"))
    return rows.select("row", l2norm(F.transform("c", lambda e: e["x"])).alias(vector))


def silhouettes(df: DataFrame, labels: Sequence[str], key: str, vector: str = "embedding",
                sample: int = 1200, seed=0) -> list[float]:
    """Mean silhouette of a seeded sample for several labelings at once.

    The sample (a bounded number of rows) travels to the tasks; each row sums its distances to every
    cluster of every labeling.
    """
    pool = cut(df.select(key, as_double(vector).alias("v"), F.array(*[
        col(c).cast("int") for c in labels]).alias("c")).orderBy(shuffle_key(seed, key), key).limit(sample))
    rows = pool.select("v", "c").collect()          # the sample
    x, at = np.array([r.v for r in rows], float), np.array([r.c for r in rows])

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for row, own in zip(v, c):
            gap = ((x - np.asarray(row)) ** 2).sum(1)
            dist = np.sqrt(np.where(gap < 1e-12, 0.0, gap))
            line = []
            for j, mine in enumerate(own):
                total = np.bincount(at[:, j], dist)
                n = np.bincount(at[:, j])
                if n[mine] < 2:
                    line.append(0.0)
                    continue
                a = total[mine] / (n[mine] - 1)
                others = [total[i] / n[i] for i in np.flatnonzero(n) if i != mine]
                b = min(others, default=np.nan)
                line.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            out.append(line)
        return pd.Series(out, dtype=object)

    spread = pool.repartition(max(1, len(rows) // 150)).select(scores("v", "c").alias("s"))
    means = spread.agg(*[F.avg(F.col("s")[j]) for j in range(len(labels))]).first()
    return [float(m) for m in means]


def k_sweep(df: DataFrame, key: str, ks: Sequence[int], seed=0, restarts: int = 8,
            vector: str = "embedding", sample: int = 1200) -> DataFrame:
    """Silhouette of real and null data per k, and the margin."""
    real = df.select(key, l2norm(vector).alias(vector))
    null = materialise(shuffle_null(real, key, seed, vector).withColumnRenamed("row", key), "null")
    names = [f"k{k}" for k in ks]
    pairs = [silhouettes(kmeans_many(d, ks, restarts, seed, vector, names, key), names, key, vector,
                         sample, seed) for d in (real, null)]
    out = df.sparkSession.createDataFrame(list(zip(ks, *pairs)), "k int, real double, null_value double")
    return out.withColumn("margin", F.col("real") - F.col("null_value"))


def ari_of(table: np.ndarray) -> float:
    """Adjusted Rand index of a table of counts."""
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    cells, rows, cols, total = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum())
    expected = rows * cols / total if total else 0.0
    top = (rows + cols) / 2
    return 1.0 if top == expected else (cells - expected) / (top - expected)


def agreements(x, use, models, nearest=nearest_centre) -> np.ndarray:
    """Tables of counts of two sets of centres, over the rows of a member."""
    out = []
    for base, again, member in models:
        rows = x[use[member]]
        table = np.zeros((len(base), len(again)))
        np.add.at(table, (nearest(rows, base)[0], nearest(rows, again)[0]), 1)
        out.append(table.ravel())
    return np.concatenate(out)


def stability_ari(df: DataFrame, key: str, ks: Sequence[int], resamples: int = 25,
                  share: float = 0.8, seed=0, restarts: int = 8,
                  vector: str = "embedding") -> DataFrame:
    """Recluster seeded subsamples and compare with the labels of the full data.

    A row is in a resample by its hash. All runs of all k and resamples share every pass; the labels
    are compared in one more, which brings back a table of k x k counts for each.
    """
    src = df.select(key, l2norm(vector).alias(vector))
    use = [md5_int(shuffle_key(f"{seed}-{b}", key)) < int(share * 16 ** 8) for b in range(resamples)]
    blocks = packed(src, vector, use, least=RUN_ROWS)
    try:
        sample, marks = start_rows(src, key, vector, seed, use)
        wanted = [(k, b) for k in ks for b in [None, *range(resamples)]]
        best = dict(zip(wanted, best_runs(blocks, sample, marks, wanted, restarts, int(seed))))
        models = [(best[k, None], best[k, b], b) for k in ks for b in range(resamples)]
        flat = summed(blocks, lambda x, u, m=models, f=agreements: f(x, u, m),
                      sum(len(a) * len(b) for a, b, _ in models))
    finally:
        blocks.unpersist()
    rows, at = [], 0
    for k in ks:
        for b in range(resamples):
            size = len(best[k, None]) * len(best[k, b])
            rows.append((k, b, ari_of(flat[at:at + size].reshape(len(best[k, None]), -1))))
            at += size
    runs = df.sparkSession.createDataFrame(rows, "k int, run int, ari double")
    return (runs.groupBy("k").agg(F.avg("ari").alias("mean_ari"),
                                  F.stddev_pop("ari").alias("sd"))
            .withColumn("verdict", m.verdict_stability("mean_ari")))


def _verdict(nulls: DataFrame, observed: float) -> DataFrame:
    return (nulls.agg(F.avg((F.col("v") >= F.lit(observed)).cast("double")).alias("p_value"),
                      F.avg("v").alias("null_mean"), F.count("*").alias("permutations"))
            .withColumn("observed", F.lit(observed))
            .withColumn("significant", m.verdict_significant("p_value")))


def _observed(df: DataFrame, label: str, y: str):
    per = df.groupBy(label).agg(F.count("*").alias("n"),
                                F.sum(col(y).cast("double")).alias("s")).orderBy(label)
    rows = per.collect()   # one row per cluster
    return rows, float(np.var([r.s / r.n for r in rows], ddof=1))


# Numbers of one counting pass (permutations x buckets), and rows that a bucket holds on average.
PASS_NUMBERS, BUCKET_ROWS = 4_000_000, 64


def perm_buckets(rows: int) -> int:
    """Hash ranges of a permutation: a power of two, so that few rows share one."""
    return 1 << min(16, max(6, (rows // BUCKET_ROWS).bit_length()))


def _hashes(keys, perms: range, seed, buckets: int):
    """For each permutation the md5 digests of all keys, and the buckets of their leading bits."""
    for i in perms:
        head = f"{seed}:{i}:".encode()
        digests = [md5(head + k).digest() for k in keys]
        yield i, digests, np.array([int.from_bytes(d[:4]) for d in digests], np.int64) * buckets >> 32


def perm_test(df: DataFrame, label: str, y: str, key: str, permutations: int,
              seed=0) -> DataFrame:
    """Permutation test of the between-cluster variance of mean ``y``, row by row.

    In each permutation the md5 rank of a row decides which cluster's seat it takes. Rows are never
    copied: one pass counts rows for each (permutation, hash range), which tells in what range each
    cluster's seats end; a second adds up ``y`` by (permutation, cluster) and sends on only the rows
    of ranges in which seats end, to be ranked there. Rows with a null key hash as the empty text.
    """
    rows, observed = _observed(df, label, y)
    ends = np.cumsum([r.n for r in rows])
    buckets = perm_buckets(int(ends[-1]))
    src = materialise(df.select(
        F.coalesce(col(key).cast("string"), F.lit("")).alias("k"), col(y).cast("double").alias("y"))
        .repartition(parallelism(df.sparkSession)), "outcomes")
    out = None
    step = max(1, PASS_NUMBERS // buckets)
    for lo in range(0, permutations, step):
        perms = range(lo, min(lo + step, permutations))
        part = _seat_sums(src, perms, seed, buckets, ends)
        out = part if out is None else out.unionByName(part)
    # a permutation has one row for each cluster: its seats and their sum
    sizes = F.array(*[F.lit(float(r.n)) for r in rows])
    means = out.groupBy("perm", "seat").agg(F.sum("s").alias("s")).withColumn(
        "mu", F.col("s") / F.get(sizes, F.col("seat")))
    return _verdict(means.groupBy("perm").agg(F.var_samp("mu").alias("v")), observed)


def _seat_sums(src: DataFrame, perms: range, seed, buckets: int, ends: np.ndarray) -> DataFrame:
    """(perm, seat, s): partial sums of ``y`` over the seats of each cluster."""
    lo, width = perms[0], len(perms)

    def count(batches):
        total = np.zeros((width, buckets), np.int64)
        for batch in batches:
            keys = [k.encode() for k in batch.column(0).to_pylist()]
            for i, _, at in _hashes(keys, perms, seed, buckets):
                total[i - lo] += np.bincount(at, minlength=buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.int64()))], ["i", "n"])

    counted = src.select("k").mapInArrow(count, "i long, n array<long>")
    merged = counted.groupBy("i").agg(vector_to_array(
        Summarizer.sum(array_to_vector(F.col("n").cast("array<double>")))).alias("n")).collect()
    upto = np.zeros((width, buckets), np.int64)
    for r in merged:                    # permutations x buckets numbers
        # sums come as means times weights: close to whole numbers
        upto[r.i] = np.cumsum(np.rint(np.array(r.n)).astype(np.int64))

    def settle(batches):
        sums = np.zeros((width, len(ends)))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys, values = [k.encode() for k in texts], np.asarray(batch.column(1))
            for i, digests, at in _hashes(keys, perms, seed, buckets):
                last = upto[i - lo]
                first = np.concatenate(([0], last[:-1]))
                # the seat of a range's first and last row; rows between two seats go on
                a = np.searchsorted(ends, first, side="right")
                b = np.searchsorted(ends, np.maximum(last - 1, 0), side="right")
                sure = a[at] == b[at]
                np.add.at(sums[i - lo], a[at[sure]], values[sure])
                rest = np.flatnonzero(~sure)
                if len(rest):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rest), i)), pa.array(np.full(len(rest), -1)),
                         pa.array(at[rest]), pa.array(first[at[rest]]),
                         pa.array([digests[j].hex() + texts[j] for j in rest]),
                         pa.array(values[rest])], names)
        n = width * len(ends)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(lo, lo + width), len(ends))),
             pa.array(np.tile(np.arange(len(ends)), width)), pa.array(np.full(n, -1)),
             pa.array(np.zeros(n, np.int64)), pa.array([""] * n), pa.array(sums.ravel())], names)

    names = ["perm", "seat", "range", "first", "place", "s"]
    got = materialise(src.select("k", "y").mapInArrow(
        settle, "perm long, seat long, range long, first long, place string, s double"), "seats")
    rank = F.row_number().over(Window.partitionBy("perm", "range").orderBy("place")) + F.col("first")
    seat = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e < rank))
    return got.where("seat >= 0").select("perm", "seat", "s").unionByName(
        got.where("seat < 0").select("perm", seat.cast("long").alias("seat"), "s"))


def perm_test_counts(df: DataFrame, label: str, y: str, permutations: int = 2000,
                     seed: int = 0) -> DataFrame:
    """The same test for a 0/1 outcome from the cluster sizes alone.

    Shuffling labels over a binary outcome draws the positives per cluster from a multivariate
    hypergeometric law, so after one aggregate the row count no longer matters.
    """
    rows, observed = _observed(df, label, y)
    sizes = np.array([r.n for r in rows], dtype=np.int64)
    hits = int(round(sum(r.s for r in rows)))

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            out = []
            for i in part["id"]:
                rng = np.random.default_rng([seed, int(i)])
                got = rng.multivariate_hypergeometric(sizes, hits, method="marginals")
                out.append(np.var(got / sizes, ddof=1))
            yield pd.DataFrame({"v": np.asarray(out, dtype=float)})

    return _verdict(df.sparkSession.range(permutations).mapInPandas(draw, "v double"), observed)


def hier_vs_kmeans(df: DataFrame, key: str, k: int = 8, restarts: int = 8, seed: int = 0,
                   vector: str = "embedding") -> DataFrame:
    both = bisecting(kmeans(df, k, restarts, seed, vector, "flat"), k, seed, vector, "hier")
    both = both.select(key, vector, "flat", "hier").persist()
    try:
        a = ari(both, "flat", "hier").first().ari
        s = silhouette(both, "hier", key, vector, None).first().silhouette
    finally:
        both.unpersist()
    return df.sparkSession.createDataFrame([(k, float(a), float(s))],
                                           "k int, ari double, silhouette double")


# ---------------------------------------------------------------- density clusters

def connected_components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Smallest key of each component, by min-label rounds with pointer jumping.

    Rounds are written, not checkpointed: a checkpoint inherits its plan's estimate, and the estimate of
    a join is a product, so its digits would multiply in every round until the driver is full of them.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).where("src <> dst")
    both = materialise(both.distinct(), "edges").hint("merge")
    labels = materialise(nodes.select(key, col(key).alias("root")), "roots")
    while True:
        near = (both.join(labels.select(F.col(key).alias("dst"), "root").hint("merge"), "dst")
                .groupBy(F.col("src").alias(key)).agg(F.min("root").alias("low")))
        lower = labels.hint("merge").join(near, key, "left").select(
            key, F.col("root").alias("old"), F.least("root", "low").alias("root"))
        hop = lower.select(F.col(key).alias("root"), F.col("root").alias("up"))
        jumped = materialise(lower.hint("merge").join(hop, "root", "left").select(
            key, "old", F.least("root", "up").alias("root")), "roots")
        moved = jumped.where("old <> root").limit(1).count()
        labels = jumped.select(key, "root")
        if not moved:
            return labels


def density_clusters(df: DataFrame, key: str, eps: float, min_pts: int, min_size: int = 1,
                     vector: str = "embedding", pivots: int = 64, block: int = 2000,
                     seed=0) -> DataFrame:
    """Density-connected groups with explicit noise (cluster NULL).

    A row with at least ``min_pts`` rows (itself included) within ``eps`` is core; core rows
    within ``eps`` share a cluster; other rows in reach of a core row join the smallest such
    row's cluster; groups under ``min_size`` rows count as noise.

    Exact without an all-pairs join: equal vectors are merged into one weighted row; rows live
    in the cell of their nearest pivot and are copied only to cells the triangle inequality
    cannot rule out; a crowded cell is split into blocks so that a task sees at most two blocks.
    Blocks emit a count or a spanning forest, never their pairs.
    """
    src = df.select(key, as_double(vector).alias("v"))
    points = cut(src.groupBy("v").agg(F.min(key).alias("id"), F.count("*").alias("w")))
    heads = [r.v for r in points.orderBy(shuffle_key(seed, "id"), "id").limit(pivots).collect()]
    centre = np.asarray(heads, dtype=np.float64)

    @F.pandas_udf("home int, cells array<int>")
    def locate(v: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({"home": [], "cells": []})
        x = stack(v)
        d = np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (centre ** 2).sum(1)
                               - 2 * x @ centre.T, 0.0))
        near = d.min(axis=1)
        reach = d <= (near + 2 * eps + 1e-9)[:, None]
        return pd.DataFrame({"home": d.argmin(axis=1).astype(np.int32),
                             "cells": [np.flatnonzero(r).astype(np.int32) for r in reach]})

    # A vector is in a cell up to once per pivot: its copies are made where blocks meet and never
    # written or joined. Sizes of checkpoints are estimates that know nothing of the copies, so joins
    # with vectors are told not to broadcast them.
    placed = cut(points.withColumn("at", locate("v")).select("id", "v", "w", "at.home", "at.cells"))

    def copied(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.explode("cells").alias("cell")).drop("cells")

    copies = copied(placed)
    load = {r.cell: (r.homes, r.n) for r in copies.select("home", "cell").groupBy("cell").agg(
        F.count_if(F.col("cell") == F.col("home")).alias("homes"),
        F.count("*").alias("n")).collect()}   # at most one row per pivot

    def parts(n):
        return max(1, -(-n // block))

    home_parts = F.create_map(*[F.lit(x) for c, (h, _) in load.items() for x in (c, parts(h))])
    all_parts = F.create_map(*[F.lit(x) for c, (_, n) in load.items() for x in (c, parts(n))])
    spot = md5_int(shuffle_key("block", "id"))
    cell = F.col("cell")

    def paired(members: DataFrame, cols: Sequence[str]) -> DataFrame:
        """Home blocks meet every member block of their cell."""
        homes = members.where("cell = home").select(
            *cols, "cell", (spot % home_parts[cell]).alias("hb"),
            F.explode(F.sequence(F.lit(0), all_parts[cell] - 1)).alias("mb"),
            F.lit(True).alias("is_home"))
        others = members.where(F.col("can_host")).select(
            *cols, "cell", F.explode(F.sequence(F.lit(0), home_parts[cell] - 1)).alias("hb"),
            (spot % all_parts[cell]).alias("mb"), F.lit(False).alias("is_home"))
        return homes.withColumn("hb", F.col("hb").cast("long")).unionByName(
            others.withColumn("hb", F.col("hb").cast("long"))
            .withColumn("mb", F.col("mb").cast("int")))

    def within(pdf):
        h, o = pdf[pdf.is_home], pdf[~pdf.is_home]
        if len(h) == 0 or len(o) == 0:
            return h, o, None
        a, b = stack(h.v), stack(o.v)
        gap = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T
        return h, o, gap <= eps * eps + 1e-12

    kind = df.schema[key].dataType.simpleString()

    def count_block(pdf: pd.DataFrame) -> pd.DataFrame:
        h, o, hit = within(pdf)
        if hit is None:
            return pd.DataFrame({"id": h.id, "n": np.zeros(len(h), dtype=np.int64)})
        return pd.DataFrame({"id": h.id, "n": hit.astype(np.int64) @ o.w.to_numpy()})

    first = paired(copies.withColumn("can_host", F.lit(True)), ["id", "v", "w"])
    near = (first.groupBy("cell", "hb", "mb").applyInPandas(count_block, f"id {kind}, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))
    core = cut(near.select("id", (F.col("n") >= min_pts).alias("core")))
    marked = copied(placed.hint("merge").join(core, "id")).withColumn("can_host", F.col("core"))

    def link_block(pdf: pd.DataFrame) -> pd.DataFrame:
        h, o, hit = within(pdf)
        if hit is None or not hit.any():
            return pd.DataFrame({"a": h.id[:0], "b": h.id[:0], "border": np.zeros(0, bool)})
        hid, oid = h.id.to_numpy(), o.id.to_numpy()
        order = np.argsort(oid, kind="stable")
        hit, oid = hit[:, order], oid[order]
        some = hit.any(axis=1)
        lone = some & ~h.core.to_numpy()
        left, right, edge = [hid[lone]], [oid[hit[lone].argmax(axis=1)]], [True] * int(lone.sum())
        live = some & h.core.to_numpy()
        grid = hit[live]
        names = hid[live]
        if len(names):
            # bipartite components inside the block: labels sink to the smallest column
            root = np.full(grid.shape[1], -1)
            row_root = grid.argmax(axis=1)
            while True:
                col_root = np.where(grid, row_root[:, None], grid.shape[1]).min(axis=0)
                fresh = np.where(grid, col_root[None, :], grid.shape[1]).min(axis=1)
                if np.array_equal(fresh, row_root) and np.array_equal(col_root, root):
                    break
                row_root, root = fresh, col_root
            used = root < grid.shape[1]
            left += [names, oid[used]]
            right += [oid[row_root], oid[root[used]]]
            edge += [False] * (len(names) + int(used.sum()))
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right),
                             "border": edge})

    links = cut(paired(marked, ["id", "v", "w", "core"]).groupBy("cell", "hb", "mb").applyInPandas(
        link_block, f"a {kind}, b {kind}, border boolean"))
    roots = connected_components(core.where("core").select("id"), links.where("not border"), "id")
    edge_of = links.where("border").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("via"))
    border = edge_of.hint("merge").join(roots.select(F.col("id").alias("via"), "root"), "via").select("id", "root")
    label = points.hint("merge").join(roots.unionByName(border), "id", "left")
    big = label.groupBy("root").agg(F.sum("w").alias("size")).where(F.col("size") >= min_size)
    kept = label.select("v", "root").join(big.select("root"), "root", "left_semi")
    return (src.hint("merge").join(kept, "v", "left")
            .select(key, F.col("root").alias("cluster")))


def density_report(df: DataFrame, key: str, flat: str, eps: float, min_pts: Sequence[int],
                   vector: str = "embedding") -> DataFrame:
    """Clusters, noise share, and agreement with another labeling on the non-noise rows."""
    out = []
    for n in min_pts:
        got = density_clusters(df, key, eps, n, n, vector).hint("merge").join(df.select(key, flat), key)
        got = got.persist()
        row = got.agg(F.countDistinct("cluster").alias("c"),
                      F.avg(F.col("cluster").isNull().cast("double")).alias("noise")).first()
        agree = ari(got.where("cluster is not null"), flat, "cluster").first().ari \
            if row.c > 1 else 0.0
        got.unpersist()
        out.append((n, int(row.c), float(row.noise), float(agree)))
    return df.sparkSession.createDataFrame(
        out, "min_pts int, clusters int, noise_share double, ari double")


# ---------------------------------------------------------------- mixtures

def mixture_sums(x, use, models) -> np.ndarray:
    """Log-likelihood, weights and weighted moments of each (means, variances, weights)."""
    out, d = [], x.shape[1]
    for mu, var, weight in models:
        log = (np.log(weight) - 0.5 * (d * np.log(2 * np.pi) + np.log(var).sum(1))
               - 0.5 * ((x ** 2) @ (1 / var).T - 2 * x @ (mu / var).T + (mu ** 2 / var).sum(1)))
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        r = np.exp(log - total[:, None])
        out += [[total.sum()], r.sum(0), (r.T @ x).ravel(), (r.T @ (x ** 2)).ravel()]
    return np.concatenate(out)


def fit_mixtures(blocks, starts: Sequence[tuple], n: int, max_iter: int = 100, tol: float = 1e-3,
                 reg: float = 1e-6) -> list[dict]:
    """Diagonal Gaussian mixtures by EM; all models share every pass and leave when they converge.

    ``history`` holds a model's log-likelihood before each update.
    """
    models = [{"at": s, "history": []} for s in starts]
    open_ = list(range(len(models)))
    for step in range(max_iter + 1):
        now = [models[i]["at"] for i in open_]
        flat = summed(blocks, lambda x, u, m=now, f=mixture_sums: f(x, u, m),
                      sum(1 + len(mu) + 2 * mu.size for mu, _, _ in now))
        at, left = 0, []
        for i in open_:
            k, d = models[i]["at"][0].shape
            part = flat[at:at + 1 + k + 2 * k * d]
            at += len(part)
            history = models[i]["history"]
            history.append(float(part[0]))
            if step == max_iter or (len(history) > 1 and history[-1] - history[-2] < tol * n):
                continue
            nk = part[1:1 + k] + 1e-10
            mu = part[1 + k:1 + k + k * d].reshape(k, d) / nk[:, None]
            var = np.maximum(part[1 + k + k * d:].reshape(k, d) / nk[:, None] - mu ** 2, 0) + reg
            models[i]["at"] = mu, var, nk / nk.sum()
            left.append(i)
        open_ = left
        if not open_:
            break
    return models


def mixtures(df: DataFrame, ks: Sequence[int], key: str, vector: str = "embedding", starts: int = 2,
             max_iter: int = 100, seed: int = 0, reg: float = 1e-6) -> list[dict]:
    """Every start of every k: {k, start, log_likelihood, bic, history, means, variances, weights}."""
    blocks = packed(df, vector)
    try:
        sample, _ = start_rows(df, key, vector, seed)
        base = summed(blocks, lambda x, u: np.concatenate([[len(x)], x.sum(0), (x ** 2).sum(0)]))
        n, d = int(base[0]), sample.shape[1]
        spread = base[1 + d:] / n - (base[1:1 + d] / n) ** 2 + reg
        jobs = [(k, s) for k in ks for s in range(starts)]
        runs = lloyd(blocks, [first_centres(sample, k, seed + s) for k, s in jobs], max_iter=20)
        begin = [(c, np.tile(spread, (len(c), 1)), np.full(len(c), 1 / len(c))) for c, _ in runs]
        done = fit_mixtures(blocks, begin, n, max_iter, reg=reg)
    finally:
        blocks.unpersist()
    out = []
    for (k, s), model in zip(jobs, done):
        mu, var, weight = model["at"]
        log = model["history"][-1]
        free = 2 * len(mu) * d + len(mu) - 1
        out.append({"k": k, "start": s, "log_likelihood": log, "bic": -2 * log + free * float(np.log(n)),
                    "history": model["history"], "means": mu, "variances": var, "weights": weight})
    return out


def gmm_bic(df: DataFrame, ks: Sequence[int], key: str, vector: str = "embedding", starts: int = 2,
            max_iter: int = 100, seed: int = 0) -> DataFrame:
    """BIC of the better start for each number of components."""
    best: dict[int, float] = {}
    for r in mixtures(df, ks, key, vector, starts, max_iter, seed):
        best[r["k"]] = min(best.get(r["k"], float("inf")), r["bic"])
    return df.sparkSession.createDataFrame(sorted(best.items()), "k int, bic double")


# ---------------------------------------------------------------- sparse parts

def sparse_codes(x: np.ndarray, atoms: np.ndarray, alpha: float, steps: int = 60) -> np.ndarray:
    """Codes minimising half the squared error plus ``alpha`` times the absolute sum."""
    gram, target = atoms @ atoms.T, x @ atoms.T
    rate = 1.0 / max(np.linalg.norm(gram, 2), 1e-12)
    code = np.zeros_like(target)
    ahead, t = code, 1.0
    for _ in range(steps):
        raw = ahead - rate * (ahead @ gram - target)
        fresh = np.sign(raw) * np.maximum(np.abs(raw) - rate * alpha, 0.0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = fresh + (t - 1) / t_next * (fresh - code)
        code, t = fresh, t_next
    return code


def code_sums(x, use, atoms, alpha: float, codes=sparse_codes) -> np.ndarray:
    c = codes(x, atoms, alpha)
    return np.concatenate([(c.T @ c).ravel(), (c.T @ x).ravel()])


def dictionary_fit(df: DataFrame, key: str, n_atoms: int = 32, alpha: float = 0.5,
                   rounds: int = 300, seed=0, vector: str = "embedding", tol: float = 1e-4) -> np.ndarray:
    """Alternate sparse codes (row-local) and atoms (from summed products) until atoms stay."""
    unit = df.select(key, l2norm(vector).alias(vector))
    blocks = packed(unit, vector)
    try:
        seeds = unit.orderBy(shuffle_key(seed, key), key).limit(n_atoms).collect()
        atoms = np.asarray([r[vector] for r in seeds])
        n, d = atoms.shape
        for _ in range(rounds):
            flat = summed(blocks, lambda x, u, a=atoms.copy(), f=code_sums: f(x, u, a, alpha),
                          n * n + n * d)
            a, b = flat[:n * n].reshape(n, n), flat[n * n:].reshape(n, d)
            old = atoms.copy()
            for j in range(n):
                if a[j, j] > 1e-10:
                    atom = atoms[j] + (b[j] - a[j] @ atoms) / a[j, j]
                    atoms[j] = atom / max(np.linalg.norm(atom), 1.0)
            if np.abs(atoms - old).max() < tol:
                break
    finally:
        blocks.unpersist()
    return atoms


def atom_rates(df: DataFrame, atoms: np.ndarray, flag: str, alpha: float = 0.5,
               vector: str = "embedding") -> DataFrame:
    """How often each atom fires on flagged and on control rows."""
    @F.pandas_udf("array<boolean>")
    def fires(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.abs(sparse_codes(stack(v), atoms, alpha)) > 1e-9))

    marked = df.select(col(flag).alias("flag"), fires(l2norm(vector)).alias("on"))
    aggs = [F.avg(F.when(side, F.get(F.col("on"), F.lit(i)).cast("double"))).alias(f"{n}{i}")
            for i in range(len(atoms))
            for n, side in (("f", F.col("flag")), ("c", ~F.col("flag")))]
    row = F.array(*[F.struct(F.lit(i).alias("atom"), F.col(f"f{i}").alias("flagged_rate"),
                             F.col(f"c{i}").alias("control_rate")) for i in range(len(atoms))])
    return (marked.agg(*aggs).select(F.inline(row))
            .withColumn("gain", F.col("flagged_rate") - F.col("control_rate")))
