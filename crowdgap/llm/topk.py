"""Exact top-k by integer inner product: three-phase uniform threshold over slices of components.

Vectors become ``floor(64 * x)`` and are cut into ``slices`` equal runs of components. A slice's
inner product is a local score; a candidate's score is the sum of its local scores. Slices of
candidates lie on different tasks, and the queries travel to them in pieces of at most ``PIECE``
bytes, so candidates are written once and no pair of blocks ever is.

1. Each task gives its queries' best k local scores; the best k of each (query, slice) are gathered
   and their whole scores looked up. The k-th best of these is a score that k candidates reach: a
   safe cutoff. (Local scores may be negative, so sums of some of them would not be safe.)
2. The cutoffs go back. A sum that reaches the cutoff has a local score of at least cutoff / slices,
   so each slice gives the entries that reach this uniform threshold.
3. The entries of a candidate meet its vector; local scores that no slice sent are computed, and the
   sums that reach the cutoff are ranked: score, then id.

Equal candidate vectors are one candidate until the end; it carries its k + 1 smallest ids, which
are all that an answer can hold, so a vector that a third of all rows share costs one row. A query
that scores many different vectors alike (a zero vector does) sends all of them.

Products are exact: float32 or float64 while every sum fits their integers, else int64 or Python's
integers; scores and components beyond 64 bits count as the largest number of that sign.

Null vectors and vectors with null or non-finite components take no part. Of vectors of unequal
length the shorter counts as zero beyond its end. Rows that repeat an id are separate candidates
(a row repeated more than k times counts k times); as a query the id has the least of its vectors,
compared component by component. A query never meets rows of its own id. Null ids take no part. An
empty table gives no rows; a query without candidates gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdgap.llm.common import materialise
from crowdgap.llm.registry import query, table
from crowdgap.session import new_path, parallelism

NOTHING = np.iinfo(np.int64).min
LARGEST = 2 ** 63 - 1
BLOCK = 1024       # candidates of a matrix product
STEP = 1024        # queries of a matrix product
PIECE = 1 << 22    # bytes of the queries that travel at once: 8,192 vectors of 64 components
IDS = "array<struct<id:bigint,n:bigint>>"


def scaled(vector: str, factor: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def usable(vector: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def integers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.where(usable(vector)).select(
        F.col(key).cast("bigint").alias("id"), scaled(vector).alias("v")).dropna(subset=["id"])


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each different vector with its k + 1 smallest ids and their numbers of rows."""
    order = Window.partitionBy("v").orderBy("id")
    return (rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
            .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
            .groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids")))


def extent(rows: DataFrame) -> tuple[int, int, float]:
    """Number of rows, longest vector, largest component."""
    size = F.transform("v", lambda x: F.abs(x.cast("double")))
    got = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(size))).first()
    return got[0], got[1] or 0, got[2] or 0.0


def dense(column: pa.ListArray, width: int) -> np.ndarray:
    """A matrix of the lists, zero beyond their ends."""
    size = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = np.asarray(column.flatten())
    return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact integer products of the rows of ``a`` and ``b``; no sum is larger than ``most``."""
    if most < 2 ** 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LARGEST, LARGEST).astype(np.int64)


def dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: float,
         step: int = 1 << 15) -> np.ndarray:
    """Products of row ``i[n]`` of ``a`` and row ``j[n]`` of ``b`` for all n."""
    out = np.zeros(len(i), np.int64)
    for n in range(0, len(i), step):
        x, y = a[i[n:n + step]], b[j[n:n + step]]
        if most < 2 ** 62:
            out[n:n + step] = np.einsum("ij,ij->i", x, y)
        else:
            whole = (x.astype(object) * y.astype(object)).sum(axis=1)
            out[n:n + step] = np.clip(whole, -LARGEST, LARGEST)
    return out


class Piece:
    """The queries that travel together, and the bounds of the slices."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, slices: int, most: float, block: int):
        self.ids, self.vectors, self.most, self.block = ids, vectors, most, block
        width = vectors.shape[1]
        self.edges = [(width * s // slices, width * (s + 1) // slices) for s in range(slices)]
        self.cutoff = np.full(len(ids), NOTHING, np.int64)

    def local(self, batches) -> Iterator[tuple]:
        """(slice, rows, first query, scores) for blocks; queries' own rows score NOTHING."""
        for batch in batches:
            for at in range(0, batch.num_rows, self.block):
                row, sole, s, part = batch.slice(at, self.block).columns
                s = s[0].as_py()
                a, b = self.edges[s]
                part = dense(part, b - a)
                alone, sole = np.asarray(sole.is_valid()), np.asarray(pc.fill_null(sole, 0))
                for i in range(0, len(self.ids), STEP):
                    got = products(self.vectors[i:i + STEP, a:b], part, self.most)
                    got[(self.ids[i:i + STEP, None] == sole[None, :]) & alone[None, :]] = NOTHING
                    yield s, np.asarray(row), i, got

    def lists(self, k: int):
        """Phase 1: the best k local scores of a task."""
        def run(batches):
            held = {}
            for s, row, i, got in self.local(batches):
                if s not in held:
                    shape = (len(self.ids), k)
                    held[s] = np.full(shape, NOTHING, np.int64), np.full(shape, -1, np.int64)
                scores, rows = held[s]
                every = np.concatenate((scores[i:i + STEP], got), axis=1)
                names = np.concatenate((rows[i:i + STEP], np.broadcast_to(row, got.shape)), axis=1)
                best = np.argpartition(every, every.shape[1] - k, axis=1)[:, -k:]
                scores[i:i + STEP] = np.take_along_axis(every, best, axis=1)
                rows[i:i + STEP] = np.take_along_axis(names, best, axis=1)
            for s, (scores, rows) in held.items():
                q, at = np.nonzero(scores > NOTHING)
                table = pa.table({"slice": np.full(len(q), s, np.int32), "q": q.astype(np.int32),
                                  "row": rows[q, at], "s": scores[q, at]})
                yield from table.to_batches(max_chunksize=1 << 16)
        return run

    def looked_up(self, batches):
        """Whole scores of the candidates that the lists hold."""
        for batch in batches:
            v, qs = batch.columns
            v = dense(v, self.vectors.shape[1])
            at = np.repeat(np.arange(batch.num_rows), np.asarray(qs.value_lengths()))
            q = np.asarray(qs.flatten())
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(dots(self.vectors, q, v, at, self.most))], ["q", "s"])

    def entries(self, batches):
        """Phase 2: the local scores that reach the uniform threshold, by candidate."""
        need = np.where(self.cutoff <= -LARGEST, NOTHING, self.cutoff // len(self.edges))
        for s, row, i, got in self.local(batches):
            at, q = np.nonzero(((got >= need[i:i + STEP, None]) & (got > NOTHING)).T)
            some, size = np.unique(at, return_counts=True)
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                     for x in ((q + i).astype(np.int32), got[q, at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[some]), pa.array(np.full(len(some), s, np.int32)), *lists],
                ["row", "slice", "q", "s"])

    def resolved(self, batches):
        """Phase 3: sums of the entries, with the local scores that were not sent."""
        for batch in batches:
            v, ids, got = batch.columns
            v = dense(v, self.vectors.shape[1])
            of = np.repeat(np.arange(batch.num_rows), np.asarray(got.value_lengths()))
            s, q, score = got.flatten().flatten()
            size = np.asarray(q.value_lengths())
            of, s = np.repeat(of, size), np.repeat(np.asarray(s), size)
            q, score = np.asarray(q.flatten()), np.asarray(score.flatten())
            pair, at = np.unique(of * len(self.ids) + q, return_inverse=True)
            of, q = pair // len(self.ids), pair % len(self.ids)
            if self.most < 2 ** 62:
                total = np.zeros(len(pair), np.int64)
                for n, (a, b) in enumerate(self.edges):
                    sent = np.zeros(len(pair), bool)
                    sent[at[s == n]] = True
                    total[at[s == n]] += score[s == n]
                    rest = np.flatnonzero(~sent)
                    total[rest] += dots(self.vectors[:, a:b], q[rest], v[:, a:b], of[rest], self.most)
            else:           # local scores beyond 64 bits can't be summed
                total = dots(self.vectors, q, v, of, self.most)
            keep = total >= self.cutoff[q]
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[q[keep]]), pa.array(total[keep]), ids.take(pa.array(of[keep]))],
                ["query_id", "score", "ids"])


def search(piece: Piece, vectors: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(query_id, score, ids): the different vectors that reach the cutoffs of a piece's queries."""
    best = Window.partitionBy("slice", "q").orderBy(F.desc("s"), "row")
    gathered = (parts.mapInArrow(piece.lists(k), "slice int, q int, row bigint, s bigint")
                .withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
                .groupBy("row").agg(F.collect_set("q").alias("qs")))
    order = Window.partitionBy("q").orderBy(F.desc("s"))
    cutoffs = (gathered.join(vectors, "row").select("v", "qs")
               .mapInArrow(piece.looked_up, "q int, s bigint")
               .withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k)
               .select("q", "s").toArrow())             # a number for each query of the piece
    piece.cutoff[np.asarray(cutoffs["q"])] = np.asarray(cutoffs["s"])
    sent = (parts.mapInArrow(piece.entries, "row bigint, slice int, q array<int>, s array<bigint>")
            .groupBy("row").agg(F.collect_list(F.struct("slice", "q", "s")).alias("got")))
    return sent.join(vectors, "row").select("v", "ids", "got").mapInArrow(
        piece.resolved, f"query_id bigint, score bigint, ids {IDS}")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, key: str = "vec_id",
          vector: str = "embedding", slices: int = 2, block: int = BLOCK,
          piece: int = PIECE) -> DataFrame:
    """(query_id, rank, key, score): each query's k best candidates."""
    spark = queries.sparkSession
    q = materialise(integers(queries, key, vector).groupBy("id").agg(F.min("v").alias("v")), "topk")
    # numbers of rows are fixed by being written
    c = materialise(
        distinct_vectors(integers(candidates, key, vector), k).repartition(parallelism(spark))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("sole", F.when(F.size("ids") == 1, F.col("ids")[0]["id"])), "topk")
    (n, *q_size), (_, *c_size) = extent(q), extent(c)
    width = max(q_size[0], c_size[0])
    most = width * q_size[1] * c_size[1]
    bounds = Piece(np.zeros(0, np.int64), np.zeros((0, width), np.int64), slices, most, block).edges
    parts = None
    for s, (a, b) in enumerate(bounds):
        cut = c.select("row", "sole", F.lit(s).alias("slice"), F.slice("v", a + 1, b - a).alias("part"))
        parts = cut if parts is None else parts.unionByName(cut)
    pieces = -(-n * max(width, 1) * 8 // piece)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    kinds = f"query_id bigint, rank int, `{key}` bigint, score bigint"
    path = new_path(spark, "topk")
    for p in range(pieces):
        rows = q.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == p).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        asked = Piece(np.asarray(rows["id"]), dense(rows["v"].combine_chunks(), width), slices,
                      most, block)
        found = search(asked, c.select("row", "v", "ids"), parts, k)
        (found.select("query_id", "score", F.inline("ids"))
         .where(F.col("id") != F.col("query_id"))
         .select("query_id", "score", F.col("id").alias(key),
                 F.explode(F.sequence(F.lit(1), F.col("n"))))
         .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
         .select("query_id", "rank", key, "score").write.mode("append").parquet(path))
    return spark.read.schema(kinds).parquet(path) if pieces else spark.createDataFrame([], kinds)


@query("op10_topk_search", """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT)
             AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)
