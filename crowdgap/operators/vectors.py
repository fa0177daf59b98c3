"""Mean vectors, directions, nearest labels, separation, bases, leader clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdgap.functions.measures import col
from crowdgap.functions.vectors import (
    as_double, blocks, l2norm, literal, norm, products, stack, subtract)
from crowdgap.operators.ordering import first_rows
from crowdgap.operators.passes import (
    PIECE_NUMBERS, PIECE_ROWS, cached, combined, matrix_of, regrouped)
from crowdgap.session import cut, materialise


def mean_vector(df: DataFrame, by: Sequence[str], vector: str = "embedding",
                name: str = "mean") -> DataFrame:
    """Component-wise mean per group; partial sums are merged map-side, so hot groups are fine."""
    mean = Summarizer.mean(array_to_vector(as_double(vector)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), vector_to_array(mean).alias(name))


def overall_mean(df: DataFrame, vector: str = "embedding") -> list[float]:
    """One vector (as many numbers as dimensions) on the driver."""
    return list(mean_vector(df, [], vector).first()["mean"])


def directions(df: DataFrame, tag: str, baseline: DataFrame, vector: str = "embedding",
               unit: bool = True) -> DataFrame:
    """mean(tag) - mean(baseline) per tag."""
    base = literal(overall_mean(baseline, vector))
    raw = mean_vector(df, [tag], vector).withColumn("direction", subtract("mean", base))
    out = raw.withColumn("direction", l2norm("direction", 0.0)) if unit else raw
    return out.select(tag, "n", "direction")


def nearest_motifs(groups: DataFrame, motifs: DataFrame, motif: str, k: int,
                   vector: str = "direction", by_size: bool = False) -> DataFrame:
    """Top ``k`` named directions per group vector by cosine (signed, or by absolute value).

    The motif list is streamed in bounded pieces; each piece is a row-local product followed by
    a merge of the best ``k``, so no pair table is ever shuffled. Names and numbers travel with
    the task, and the plan is cut between pieces, so it does not grow with the motifs.
    """
    kind = "array<struct<motif:string,cosine:double>>"
    out = groups.withColumn("motifs", F.array().cast(kind))
    unit = motifs.select(col(motif).cast("string").alias("m"),
                         l2norm(vector, 0.0).alias("v"))
    for i, (names, matrix) in enumerate(blocks(unit, "m", "v")):
        merge = _merge_best(names, matrix, k, by_size, kind)
        out = (cut(out) if i else out).withColumn("motifs", merge(l2norm(vector, 0.0), "motifs"))
    return out


def _merge_best(names: list[str], matrix: np.ndarray, k: int, by_size: bool, kind: str):
    """Pandas UDF: the best ``k`` of a list and of a small matrix's rows; ties by name."""
    right = np.ascontiguousarray(matrix.T)
    order = np.argsort(np.asarray(names, dtype=object), kind="stable")

    @F.pandas_udf(kind)
    def merge(v: pd.Series, old: pd.Series) -> pd.Series:
        out = []
        sims = stack(v) @ right if len(v) else []
        for row, had in zip(sims, old):
            size = np.abs(row) if by_size else row
            best = order[np.argsort(-size[order], kind="stable")[:k]]
            both = [*((e["motif"], e["cosine"]) for e in had), *((names[j], row[j]) for j in best)]
            both.sort(key=lambda e: (-(abs(e[1]) if by_size else e[1]), e[0]))
            out.append([{"motif": m, "cosine": float(c)} for m, c in both[:k]])
        return pd.Series(out, dtype=object)

    return merge


def assign_nearest(df: DataFrame, centroids: DataFrame, label: str, vector: str = "embedding",
                   centroid: str = "centroid") -> DataFrame:
    """Most similar centroid per row with similarity and margin over the runner-up.

    Row-local: a running (label, best, second) is folded over bounded pieces of the centroid
    table. Ties go to the smaller label.
    """
    kind = centroids.schema[label].dataType
    ordered = centroids.orderBy(label).select(
        col(label).cast("string").alias("c"), col(centroid).alias("v"))
    out = df.withColumns({"__c": F.lit(None).cast("string"), "__s": F.lit(None).cast("double"),
                          "__r": F.lit(None).cast("double")})
    for i, (names, matrix) in enumerate(blocks(ordered, "c", "v")):
        out = out.withColumn("__x", _best_two(names, matrix)(
            as_double(vector), F.col("__c"), F.col("__s"), F.col("__r"))).withColumns(
            {"__c": F.col("__x.c"), "__s": F.col("__x.s"), "__r": F.col("__x.r")}).drop("__x")
        if i % 8 == 7:
            out = cut(out)
    return (out.withColumns({label: F.col("__c").cast(kind), "sim": F.col("__s"),
                             "margin": F.col("__s") - F.col("__r")})
            .drop("__c", "__s", "__r"))


def _best_two(names: list[str], matrix: np.ndarray):
    right = np.ascontiguousarray(matrix.T)
    labels = np.asarray(names, dtype=object)

    @F.pandas_udf("c string, s double, r double")
    def fold(v: pd.Series, c: pd.Series, s: pd.Series, r: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({"c": [], "s": [], "r": []})
        # rounding first keeps exact ties exact whatever the summation order was
        sims = np.round(stack(v) @ right, 12)
        rows = np.arange(len(sims))
        top = sims.argmax(axis=1)
        best = sims[rows, top]
        rest = sims.copy()
        rest[rows, top] = -np.inf
        second = rest.max(axis=1)
        old, old2 = s.fillna(-np.inf).to_numpy(), r.fillna(-np.inf).to_numpy()
        keep = old >= best
        new_second = np.where(keep, np.maximum(old2, best), np.maximum(old, second))
        return pd.DataFrame({
            "c": np.where(keep, c.to_numpy(dtype=object), labels[top]),
            "s": np.where(keep, old, best),
            "r": np.where(np.isneginf(new_second), np.nan, new_second)})

    return fold


def centroids_of(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Unit-length means of unit vectors."""
    unit = df.withColumn("__u", l2norm(vector))
    return mean_vector(unit, [label], "__u").select(
        label, "n", l2norm("mean").alias("centroid"))


def self_consistency(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Share of rows whose nearest centroid is their own group's."""
    cents = centroids_of(df, label, vector)
    kept = df.select(col(label).alias("own"), l2norm(vector).alias("__u"))
    placed = assign_nearest(kept, cents, label, "__u")
    return placed.agg(F.avg((F.col("own") == F.col(label)).cast("double")).alias("agreement"),
                      F.count("*").alias("n"))


# Scores of a flush, and rows of a pack for each of its score ranges.
FLUSH_SCORES, RANGE_ROWS = 2_000_000, 20_000


def separation(steps: DataFrame, vectors: DataFrame, key: str, own: str, pack: str = "pack_id",
               side: str = "side", vec: str = "vec", v: str = "v") -> DataFrame:
    """Share of (positive, negative) step pairs each vector orders strictly, per pack.

    Neither a pair nor a row for each (step, vector) is formed. Every task counts positives and
    negatives of the different scores of each (vector, pack, score range) and sends these counters,
    packed; counters of one range are merged and give the pairs inside it, and running totals over
    ranges give all others. A pack has one range for every ``RANGE_ROWS`` of the largest pack's rows.
    ``own`` is true for the packs a vector was made from. Steps and packs may be null; a null side
    counts as negative.
    """
    size = steps.groupBy(pack).agg(F.count("*").alias("n"), F.max(norm(vec)).alias("r"))
    most = size.agg(F.max("n").alias("n"), F.max("r").alias("r")).first()
    ranges = min(4096, max(1, -(-(most.n or 0) // RANGE_ROWS)))
    ready = steps.where(col(vec).isNotNull()).select(
        col(pack).cast("string").alias("p"),
        F.coalesce(col(side) == "pos", F.lit(False)).alias("y"), as_double(vec).alias("x"))
    out = None
    for names, matrix in blocks(vectors.select(col(key).cast("string").alias("k"), v), "k", v):
        part = _packed_counters(ready, names, matrix, ranges, float(most.r or 0))
        merged = part.groupBy("k", "p", "range").applyInPandas(
            _merge_counters, "k string, p string, range int, pos double, neg double, inside double")
        out = merged if out is None else out.unionByName(merged)
    before = Window.partitionBy("k", "p").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    shares = out.withColumn("wins", F.col("inside") + F.col("pos") * lower).groupBy("k", "p").agg(
        (F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("separation"))
    owners = vectors.select(col(key).cast("string").alias("k"), col(own).alias("__own"))
    named = F.col("p").cast(steps.schema[pack].dataType)
    return shares.join(owners, "k").select(
        F.col("k").cast(vectors.schema[key].dataType).alias(key), named.alias(pack), "separation",
        F.array_contains("__own", named).alias("own"))


def _packed_counters(ready: DataFrame, names: list[str], matrix: np.ndarray, ranges: int,
                     longest: float) -> DataFrame:
    """(k, p, range, scores, pos, neg): the different scores of a task with their counts, as bytes."""
    reach = np.maximum(np.linalg.norm(matrix, axis=1) * longest, 1e-300)
    right = np.ascontiguousarray(matrix.T)
    each = max(1, FLUSH_SCORES // max(1, len(names)))

    def counters(p: pd.Series, y: np.ndarray, x: np.ndarray):
        code, packs = pd.factorize(p, use_na_sentinel=False)
        scores = x @ right
        for j, name in enumerate(names):
            s = scores[:, j]
            at = np.clip(((s / reach[j] + 1) / 2 * ranges).astype(np.int64), 0, ranges - 1)
            order = np.lexsort((s, at, code))
            c, a, s, hit = code[order], at[order], s[order], y[order]
            new = np.ones(len(s), bool)
            new[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1])
            value = new.copy()
            value[1:] |= s[1:] != s[:-1]
            first = np.flatnonzero(value)
            pos = np.add.reduceat(hit.astype(np.int64), first)
            neg = np.diff(np.append(first, len(s))) - pos
            group = np.append(np.searchsorted(first, np.flatnonzero(new)), len(first))
            for lo, hi in zip(group[:-1], group[1:]):
                i = first[lo]
                yield (name, packs[c[i]], int(a[i]), s[first[lo:hi]].tobytes(),
                       pos[lo:hi].tobytes(), neg[lo:hi].tobytes())

    def run(it):
        for batch in it:
            for lo in range(0, len(batch), each):
                part = batch.iloc[lo:lo + each]
                yield pd.DataFrame(
                    list(counters(part["p"], part["y"].to_numpy(bool), stack(part["x"]))),
                    columns=["k", "p", "range", "scores", "pos", "neg"])

    return ready.mapInPandas(run, "k string, p string, range int, scores binary, pos binary, neg binary")


def _merge_counters(pdf: pd.DataFrame) -> pd.DataFrame:
    """Positives, negatives and strictly ordered pairs of one score range."""
    s = np.frombuffer(b"".join(pdf["scores"]), np.float64)
    pos = np.frombuffer(b"".join(pdf["pos"]), np.int64)
    neg = np.frombuffer(b"".join(pdf["neg"]), np.int64)
    values, at = np.unique(s, return_inverse=True)
    p, n = np.bincount(at, pos, len(values)), np.bincount(at, neg, len(values))
    inside = float((p * (np.cumsum(n) - n)).sum())
    return pd.DataFrame({"k": pdf["k"].iloc[:1], "p": pdf["p"].iloc[:1], "range": pdf["range"].iloc[:1],
                         "pos": p.sum(), "neg": n.sum(), "inside": inside})


def generalisation(separations: DataFrame, key: str, threshold: float = 0.65) -> DataFrame:
    """Mean separation on own and on other packs; vectors at the threshold survive."""
    own = F.col("own")
    return (separations.groupBy(key).agg(
        F.avg(F.when(own, F.col("separation"))).alias("in_group"),
        F.coalesce(F.avg(F.when(~own, F.col("separation"))), F.lit(0.0)).alias("held_out"))
        .withColumn("survives", F.col("held_out") >= threshold))


def orthobasis(rows) -> np.ndarray:
    """Orthonormal row basis of a few vectors (rank-revealing)."""
    m = np.atleast_2d(np.asarray(rows, dtype=np.float64))
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    return vt[s > s.max() * 1e-10] if s.size and s.max() > 0 else vt[:0]


def basis_r2(df: DataFrame, basis, origin: Sequence[float], vector: str = "embedding",
             name: str = "r2") -> DataFrame:
    """Uncentred share of each row's offset from ``origin`` that lies in the span of a basis."""
    q, zero = orthobasis(basis), np.asarray(origin, dtype=np.float64)

    @F.pandas_udf("double")
    def share(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=float)
        d = stack(v) - zero
        total = np.maximum((d ** 2).sum(axis=1), 1e-12)
        inside = d @ q.T
        residual = ((d - inside @ q) ** 2).sum(axis=1)
        return pd.Series(1 - residual / total)

    return df.withColumn(name, share(as_double(vector)))


def basis_coefficients(direction: Sequence[float], basis) -> tuple[list[float], float]:
    """Least-squares coefficients of one direction on a few vectors, and its R2."""
    b, d = np.atleast_2d(np.asarray(basis, float)), np.asarray(direction, float)
    coef, *_ = np.linalg.lstsq(b.T, d, rcond=None)
    residual = ((d - b.T @ coef) ** 2).sum()
    return [float(c) for c in coef], float(1 - residual / max((d ** 2).sum(), 1e-12))


def novelty(df: DataFrame, expert_basis, crowd_basis, vector: str = "v") -> DataFrame:
    """Relative residual on the crowd basis minus that on the expert basis."""
    def residual(basis):
        q = orthobasis(basis)

        @F.pandas_udf("double")
        def left_over(v: pd.Series) -> pd.Series:
            if len(v) == 0:
                return pd.Series([], dtype=float)
            m = stack(v)
            rest = m - (m @ q.T) @ q
            return pd.Series(np.linalg.norm(rest, axis=1) / (np.linalg.norm(m, axis=1) + 1e-12))

        return left_over(as_double(vector))

    return df.withColumn("novelty", residual(crowd_basis) - residual(expert_basis))


def pca_scores(df: DataFrame, k: int, vector: str = "embedding",
               name: str = "scores") -> DataFrame:
    """Principal component scores on centred data; shorter widths are prefixes."""
    centre = literal(overall_mean(df, vector))
    ready = df.withColumn("__f", array_to_vector(subtract(vector, centre)))
    model = PCA(k=k, inputCol="__f", outputCol="__pc").fit(ready)
    return (model.transform(ready).withColumn(name, vector_to_array("__pc"))
            .drop("__f", "__pc"))


def principal_basis(df: DataFrame, k: int, vector: str = "embedding") -> np.ndarray:
    ready = df.select(array_to_vector(as_double(vector)).alias("f"))
    return PCA(k=k, inputCol="f", outputCol="pc").fit(ready).pc.toArray().T


def leader_clusters(df: DataFrame, key: str, score: str, vector: str = "v",
                    threshold: float = 0.6, block: int = 512) -> DataFrame:
    """Greedy clusters: in score order each row joins the earliest leader above the threshold.

    Round by round the best ``block`` open rows settle their leaders on the driver, then every
    open row is compared with those leaders only (bounded, row-local). A row left open matched
    no earlier leader, so the outcome equals the one-by-one loop.
    """
    todo = df.select(key, score, l2norm(vector, 0.0).alias("__v"))
    done, start = None, 0
    while True:
        head = todo.orderBy(col(score).desc(), key).limit(block).collect()
        if not head:
            break
        leaders: list[int] = []
        matrix = np.asarray([r["__v"] for r in head])
        sims = matrix @ matrix.T
        for i in range(len(head)):
            if not any(sims[i, j] > threshold for j in leaders):
                leaders.append(i)
        own = F.create_map(*[F.lit(x) for i, j in enumerate(leaders)
                             for x in (head[j][key], i)])
        tagged = cut(todo.withColumn("__m", _first_match(matrix[leaders], threshold)("__v"))
                     .withColumn("__m", F.coalesce(own[col(key)].cast("long"), F.col("__m"))))
        won = tagged.where("__m >= 0").select(
            key, score, (F.col("__m") + start).alias("cluster"))
        done = won if done is None else done.unionByName(won)
        todo = tagged.where("__m < 0").drop("__m")
        start += len(leaders)
    return done


def _first_match(leaders: np.ndarray, threshold: float):
    right = np.ascontiguousarray(leaders.T)

    @F.pandas_udf("long")
    def match(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype="int64")
        hit = stack(v) @ right > threshold
        return pd.Series(np.where(hit.any(axis=1), hit.argmax(axis=1), -1))

    return match


# Numbers of one pass of the solver: groups x (dimensions + 1) squared.
SOLVER_NUMBERS = 4_000_000


def _signed_blocks(rows: DataFrame, d: int):
    """Cached pieces (rows with threshold column, signed by side; first row of each group; groups).

    ``d`` counts the threshold column.
    """
    most = max(1, min(PIECE_ROWS, PIECE_NUMBERS // d))

    def pack(batches, split=regrouped, matrix=matrix_of):
        for t in split(batches, most):
            g, hit = t.column("g").to_numpy(), t.column("hit").to_numpy()
            z = np.hstack([matrix(t, "x", d - 1), np.ones((len(t), 1))]) * np.where(hit, 1.0, -1.0)[:, None]
            order = np.argsort(g, kind="stable")
            g, z = g[order], z[order]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            yield z, first, g[first]

    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, n // 10_000), -(-n // 200_000))
    return cached(rows.repartition(parts), pack)


def keyed_sums(pieces, step, width: int, groups: int) -> np.ndarray:
    """Sums of each group: groups x width. ``step`` gives those of a piece's groups, from its rows,
    the group of each row and the first row of each group."""
    out = np.zeros((groups, width))
    for z, first, names in pieces:
        out[names] += step(z, np.repeat(names, np.diff(np.append(first, len(z)))), first)
    return out


def products_by_group(z: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows and summed products of every two columns of each group."""
    return np.stack([np.append(len(p), (p.T @ p).ravel()) for p in np.split(z, first[1:])])


def _solve(blocks_of, groups: int, d: int, l1: float, tol: float, max_iter: int):
    """(w, slack) of all groups: smallest ``l1`` times the absolute sum plus mean squared violation.

    Proximal steps with momentum; every pass gives the gradients of all groups that are not done. A
    group is done when its optimality conditions hold within ``tol``. The threshold is the last
    entry and is not penalised.
    """
    def total(step, width, f=keyed_sums):
        def fold(it, s=step, w=width, g=groups, f=f):
            yield f(it, s, w, g).ravel()

        return combined(blocks_of.mapPartitions(fold), groups * width).reshape(groups, width)

    gram = total(products_by_group, 1 + d * d)
    n = np.maximum(gram[:, 0], 1)
    curve = np.array([np.linalg.eigvalsh(m.reshape(d, d))[-1] for m in gram[:, 1:]])
    rate = (1 / np.maximum(2 * curve / n, 1e-12))[:, None]
    w = np.zeros((groups, d))
    ahead, t, open_ = w.copy(), np.ones(groups), np.ones(groups, bool)

    def gradient(at):
        return -2 / n[:, None] * total(lambda z, g, first, at=at: np.add.reduceat(np.maximum(
            0.0, 1 - (z * at[g]).sum(1))[:, None] * z, first, axis=0), d)

    for _ in range(max_iter):
        grad = gradient(ahead)
        raw = ahead - rate * grad
        fresh = np.sign(raw) * np.maximum(np.abs(raw) - rate * l1, 0.0)
        fresh[:, -1] = raw[:, -1]
        moved = fresh - w
        t = np.where((moved * (ahead - fresh)).sum(1) > 0, 1.0, t)   # momentum points uphill
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        # how far a step still moves, in units of the gradient
        open_ &= np.abs((ahead - fresh) / rate).max(1) > tol
        w = np.where(open_[:, None], fresh, w)
        ahead = np.where(open_[:, None], fresh + ((t - 1) / t_next)[:, None] * moved, w)
        t = t_next
        if not open_.any():
            break
    slack = total(lambda z, g, first, w=w: np.add.reduceat(
        np.maximum(0.0, 1 - (z * w[g]).sum(1)), first)[:, None], 1)[:, 0]
    return w, slack, np.abs(optimality(gradient(w), w, l1)).max(1)


def optimality(grad: np.ndarray, w: np.ndarray, l1: float) -> np.ndarray:
    """How far each entry is from the conditions of a minimum; zero where they hold."""
    size = l1 * np.ones(w.shape)
    size[:, -1] = 0.0
    return np.where(w != 0, grad + np.sign(w) * size, np.sign(grad) * np.maximum(np.abs(grad) - size, 0))


def contrast_fits(steps: DataFrame, by: str | None, side: str = "side", vec: str = "vec",
                  l1: float = 0.05, tol: float = 1e-4, max_iter: int = 1000) -> DataFrame:
    """(by, n, v, weights, slack, residual) for each group of steps; a null group is a group.

    Ordering every (positive, negative) pair with a margin is the same as having one threshold
    between the two sets, so rows are enough and no pair is formed. All groups are solved together,
    as many at a time as ``SOLVER_NUMBERS`` allows, by sums over blocks of rows, so neither the
    size of a group nor the dealing of its rows matters. ``v`` has unit length (zeros where nothing
    separates, or where one side is missing); ``residual`` is the distance to optimality.
    """
    rows = steps.where(col(vec).isNotNull()).select(
        (F.lit(None).cast("string") if by is None else col(by)).alias("name"),
        F.coalesce(col(side) == "pos", F.lit(False)).alias("hit"), as_double(vec).alias("x"))
    rows = materialise(rows, "steps")
    kind = rows.schema["name"].dataType.simpleString()
    schema = f"name {kind}, n bigint, v array<double>, weights array<double>, slack double, residual double"
    first = rows.first()
    sizes = rows.groupBy("name").agg(F.count("*").alias("n"), F.count_if("hit").alias("pos"))
    d = 1 + (len(first.x) if first else 0)
    chunk = max(1, SOLVER_NUMBERS // d ** 2)
    numbered = materialise(sizes.withColumn("id", F.monotonically_increasing_id()), "groups")
    out = steps.sparkSession.createDataFrame([], schema)
    held: list = []

    def flush():
        names = steps.sparkSession.createDataFrame([(r.id, i) for i, r in enumerate(held)], "id long, g int")
        mine = numbered.join(F.broadcast(names), "id").select(F.col("name").alias("__name"), "g")
        part = rows.join(F.broadcast(mine), F.col("name").eqNullSafe(F.col("__name"))).select("g", "hit", "x")
        blocks_of = _signed_blocks(part, d)
        try:
            w, slack, residual = _solve(blocks_of, len(held), d, l1, tol, max_iter)
        finally:
            blocks_of.unpersist()
        lone = np.array([r.pos in (0, r.n) for r in held])
        length = np.where(lone, 0.0, np.linalg.norm(w[:, :-1], axis=1))
        v = np.where(length[:, None] > 0, w[:, :-1] / np.maximum(length, 1e-300)[:, None], 0.0)
        found = [(r.name, r.n, v[i].tolist(), w[i].tolist(), float(slack[i]), float(residual[i]))
                 for i, r in enumerate(held)]
        held.clear()
        return steps.sparkSession.createDataFrame(found, schema)

    for r in numbered.toLocalIterator():        # one row for each group, a bounded number at a time
        held.append(r)
        if len(held) == chunk:
            out = out.unionByName(flush())
    if held:
        out = out.unionByName(flush())
    return out.withColumnRenamed("name", by or "group")


def contrast_direction(steps: DataFrame, side: str = "side", vec: str = "vec", l1: float = 0.05,
                       max_iter: int = 1000) -> tuple[list[float], float]:
    """Sparse unit direction that scores positive steps above negative ones, and its slack."""
    one = contrast_fits(steps, None, side, vec, l1, max_iter=max_iter).first()
    return list(one.v), float(one.slack)


def contrast_directions(steps: DataFrame, by: str, side: str = "side", vec: str = "vec",
                        l1: float = 0.05, max_iter: int = 1000) -> DataFrame:
    """One unit direction per group of steps."""
    return contrast_fits(steps, by, side, vec, l1, max_iter=max_iter).select(by, "v")


def concept_score(df: DataFrame, v: Sequence[float], vector: str = "embedding",
                  name: str = "score") -> DataFrame:
    return df.withColumn(name, products(np.asarray([v]))(as_double(vector))[0])


def strongest(df: DataFrame, by: Sequence[str], value: str, key: str, k: int,
              by_size: bool = False) -> DataFrame:
    """Top ``k`` per group, signed or by absolute value."""
    strength = F.abs(col(value)) if by_size else col(value)
    return first_rows(df, by, [strength.desc(), key], k, "rank")
