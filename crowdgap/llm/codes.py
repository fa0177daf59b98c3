"""Vector codes: a codebook for each part of a vector, searched by slices and bitmasks.

Vectors become integers ``floor(scale * x)`` and are cut into equal consecutive parts. Each part
has a codebook of at most 64 entries, which starts as that part of the vectors with the smallest
keys. A round assigns every part to its nearest entry and moves each entry to the componentwise
floor of its parts' mean; entries without parts stay.

The nearest entry is found by slice and intersect. A codebook keeps, for each dimension, its
entries' coordinates in order, and for each place in that order the 64-bit mask of the entries
before it. The entries that are next to a part's coordinate in each dimension give an initial
radius: the nearest one is no farther away. In each dimension two binary searches bound the slice
within the radius, and the exclusive or of two prefix masks is the set of entries in it; the AND of
all dimensions leaves the entries in the box, which holds every entry at the least distance. Their
distances are computed in order of entry, so ties go to the lower one.

How the work is bounded: every round is one pass with a task's sums for each entry; what reaches
the driver, and each task from there, are the codebooks (parts x 64 entries). Label sums are
aggregates, and labels with more than a thousandth of all rows, of which there are fewer than a
thousand, return to the rows by broadcast.

Vectors that are null or hold null or non-finite components are left out. Of unequal lengths, and
lengths that are no multiple of the number of parts, the missing components count as zero.
Components beyond 64 bits count as the largest number of that sign; numbers whose squares could
leave 64 bits are computed as Python integers, and errors beyond 64 bits count as the largest.
Null keys come after all others when the first entries are chosen; equal keys by their vectors.
With fewer vectors than entries there are as many entries. Equal labels, and all nulls, share a
sum. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm.common import attach, materialise
from crowdgap.llm.registry import query, table
from crowdgap.llm.topk import LARGEST, scaled, usable

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2


class Codebook:
    """The entries of one part, with the slices of each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable").T
        self.line = np.ascontiguousarray(np.take_along_axis(entries.T, self.order, 1))
        bits = np.uint64(1) << self.order.astype(np.uint64)
        self.prefix = np.zeros((len(self.order), len(entries) + 1), np.uint64)
        self.prefix[:, 1:] = np.bitwise_or.accumulate(bits, axis=1)

    def gaps(self, x: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = x - self.entries[e]
        return (d * d).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number that the nearest entry's distance does not exceed."""
        best = None
        for d, line in enumerate(self.line):
            at = np.searchsorted(line, x[:, d])
            for place in (np.minimum(at, len(line) - 1), np.maximum(at - 1, 0)):
                gap = self.gaps(x, self.order[d, place])
                best = gap if best is None else np.minimum(best, gap)
        if best.dtype == object:
            return np.array([isqrt(g) + 1 for g in best], object)
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """The mask of the entries in each row's box."""
        r = self.radius(x)
        mask = np.full(len(x), 2 ** 64 - 1, np.uint64)
        for d, line in enumerate(self.line):
            low = np.searchsorted(line, x[:, d] - r, side="left")
            high = np.searchsorted(line, x[:, d] + r, side="right")
            mask &= self.prefix[d, high] ^ self.prefix[d, low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row."""
        mask = self.candidates(x)
        code = np.zeros(len(x), np.int64)
        dist = np.full(len(x), -1, x.dtype)
        live = np.arange(len(x))
        while len(live):
            m = mask[live]
            lowest = m & (~m + np.uint64(1))
            e = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            gap = self.gaps(x[live], e)
            better = (dist[live] < 0) | (gap < dist[live])
            code[live[better]], dist[live[better]] = e[better], gap[better]
            mask[live] = m & (m - np.uint64(1))
            live = live[mask[live] != 0]
        return code, dist


def matrix(column, width: int, wide: bool) -> np.ndarray:
    """An Arrow column of integer lists as rows of ``width`` numbers."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if (sizes == width).all():
        out = flat.reshape(-1, width)
    else:
        out = np.zeros((len(sizes), width), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        out[row, np.arange(len(flat)) - np.repeat(first, sizes)] = flat
    return out.astype(object) if wide else out


class Coder:
    """Codebooks of all parts, and what rows they fit."""

    def __init__(self, books: np.ndarray, wide: bool):
        self.books, self.wide = books, wide        # parts x entries x width of a part
        self.width = books.shape[0] * books.shape[2]
        self.found = [Codebook(b) for b in books]

    def parts(self, column):
        """(part, rows of that part) of a batch."""
        rows = matrix(column, self.width, self.wide)
        size = self.books.shape[2]
        return ((p, np.ascontiguousarray(rows[:, p * size:(p + 1) * size]))
                for p in range(len(self.books)))


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(k, label, v) of the vectors that take part."""
    return vectors.where(usable(vector)).select(
        F.col(key).alias("k"), F.col(label).alias("label"), scaled(vector, scale).alias("v"))


def first_books(rows: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, bool] | None:
    """The first codebooks, and whether numbers may need more than 64 bits."""
    size, most = rows.agg(F.max(F.size("v")), F.max(F.greatest(
        F.array_max("v").cast("decimal(20,0)"), -F.array_min("v").cast("decimal(20,0)")))).first()
    if size is None:
        return None
    width = max(1, -(-size // parts))
    wide = width * (2 * int(most or 0)) ** 2 >= 2 ** 62
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), parts * width), object if wide else np.int64)
    for i, r in enumerate(first):
        start[i, :len(r.v)] = r.v
    return np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)), wide


def moved(rows: DataFrame, books: np.ndarray, wide: bool) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches):
        coder = Coder(books, wide)
        sums = np.zeros((parts, entries, width + 1), object)
        for batch in batches:
            for p, x in coder.parts(batch.column(0)):
                code, _ = coder.found[p].nearest(x)
                part = np.zeros((entries, width + 1), object if wide else np.int64)
                np.add.at(part, code, np.hstack([x, np.ones((len(x), 1), x.dtype)]))
                sums[p] += part
        used = np.flatnonzero((sums[:, :, -1] > 0).ravel())
        totals = sums.reshape(-1, width + 1)[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1)),
             pa.array(np.tile(np.arange(width + 1), len(used))),
             pa.array([Decimal(int(t)) for t in totals.ravel()], pa.decimal128(38, 0))],
            ["slot", "place", "total"])

    sums = rows.select("v").mapInArrow(run, "slot bigint, place bigint, total decimal(38,0)")
    new = books.copy().reshape(-1, width)
    # parts x entries x (width + 1) numbers at most
    found: dict[int, dict[int, int]] = {}
    for r in sums.groupBy("slot", "place").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r.slot, {})[r.place] = int(r.total)
    for slot, totals in found.items():
        new[slot] = [totals[i] // totals[width] for i in range(width)]
    return new.reshape(books.shape)


def coded(rows: DataFrame, books: np.ndarray, wide: bool) -> DataFrame:
    """(k, label, code, error) of every row."""
    def run(batches):
        coder = Coder(books, wide)
        for batch in batches:
            n = batch.num_rows
            codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, object)
            for p, x in coder.parts(batch.column(2)):
                code, gap = coder.found[p].nearest(x)
                codes[:, p] = code
                error += gap
            text = codes.tobytes().hex()
            size = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([text[i:i + size] for i in range(0, n * size, size)], pa.string()),
                 pa.array([min(int(e), LARGEST) for e in error], pa.int64())],
                ["k", "label", "code", "error"])

    k, label = (rows.schema[c].dataType.simpleString() for c in ("k", "label"))
    return rows.select("k", "label", "v").mapInArrow(
        run, f"k {k}, label {label}, code string, error bigint")


def learned(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
            rounds: int = ROUNDS) -> tuple[np.ndarray, bool] | None:
    """The codebooks (parts x entries x width of a part); None without a row."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries, the bits of a mask")
    start = first_books(rows, parts, entries)
    if start is None:
        return None
    books, wide = start
    for _ in range(rounds):
        books = moved(rows, books, wide)
    return books, wide


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
             label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    rows = integers(vectors, key, vector, label, scale)
    model = learned(rows, parts, entries, rounds)
    k, kind = (rows.schema[c].dataType.simpleString() for c in ("k", "label"))
    done = rows.sparkSession.createDataFrame([], f"k {k}, label {kind}, code string, error bigint") \
        if model is None else materialise(coded(rows, *model), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("bigint")
    sums = materialise(done.groupBy("label").agg(F.count("*").alias("n"),
                                                 total.alias("label_error")), "labels")
    return attach(done, sums, "label").select(
        F.col("k").alias(key), "code", "error", "label_error",
        F.lit(None if model is None else books_digest(model[0])).cast("string")
        .alias("codebooks_sha256"))


def _round(name: str, books: str, codes: str) -> str:
    """SQL of one round: assign to ``books``, then move its entries."""
    return f"""
{codes} AS (SELECT vec_id, p, e, dist FROM (
  SELECT x.vec_id, x.p, b.e, sum((x.c - b.c) ** 2)::BIGINT AS dist,
    row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY sum((x.c - b.c) ** 2), b.e) AS place
  FROM cells x JOIN {books} b ON b.p = x.p AND b.d = x.d GROUP BY x.vec_id, x.p, b.e) WHERE place = 1),
{name} AS (SELECT b.p, b.e, b.d, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
  SELECT x.p, c.e, x.d, floor(sum(x.c)::DOUBLE / count(*))::BIGINT AS c
  FROM cells x JOIN {codes} c ON c.vec_id = x.vec_id AND c.p = x.p GROUP BY x.p, c.e, x.d) m
  ON m.p = b.p AND m.e = b.e AND m.d = b.d)"""


@query("op11_vector_codes", f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
flat AS (
  SELECT vec_id, w, generate_subscripts(embedding, 1) - 1 AS i,
    floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS c FROM kept),
cells AS (SELECT vec_id, i // w AS p, i % w AS d, c FROM flat),
heads AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
  ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, d, c FROM cells JOIN heads USING (vec_id)),
{_round("b1", "b0", "c0")},
{_round("b2", "b1", "c1")},
{_round("b3", "b2", "c2")},
books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, d)) AS sha FROM b2),
done AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
  sum(dist)::BIGINT AS error FROM c2 GROUP BY vec_id)
SELECT d.vec_id, d.code, d.error,
  (sum(d.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, books.sha AS codebooks_sha256
FROM done d JOIN kept k USING (vec_id), books
""")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
