"""Iterations over vectors: rows packed once into cached pieces, each pass a sum over all pieces.

A piece is bounded, whatever the rows, and a task adds up its pieces one after another, so a worker
holds one piece and one sum. A pass of larger sums is added up slice by slice on the executors, in
the order of the partitions, so the driver receives a single sum, the same in every run. A lost piece
is packed again from the written rows, so an iteration never depends on one executor.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgap.functions.vectors import as_double
from crowdgap.session import materialise

# rows of a partition at least, and numbers at most
LEAST_ROWS, MOST_NUMBERS = 10_000, 8_000_000
# rows and numbers of a piece at most
PIECE_ROWS, PIECE_NUMBERS = 32_768, 1_000_000
# numbers that the tasks of a pass may send to the driver without being added up before
DIRECT_NUMBERS = 10_000


def regrouped(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches as tables of at most ``rows`` rows, all but the last of them full."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, rows - n)
            batch = batch.slice(len(part))
            held.append(part)
            n += len(part)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix_of(table: pa.Table, name: str, width: int) -> np.ndarray:
    """A list column whose cells all have ``width`` entries."""
    parts = [c.flatten() for c in table.column(name).chunks]
    flat = np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts]) if parts else np.zeros(0)
    return flat.reshape(len(table), width)


def pieces(rows: DataFrame, pack: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> RDD:
    """What ``pack`` yields for a partition's Arrow batches.

    A packed piece is its pickle already, so the column of pieces is read as it stands: rows of
    ``DataFrame.rdd`` would be pickled again, and a second Python worker of each task would unpack them.
    """
    def to_bytes(batches, pack=pack):
        for piece in pack(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(piece, 5)], pa.large_binary())],
                                             ["piece"])

    ctx = rows.sparkSession.sparkContext
    found = getattr(rows.mapInArrow(to_bytes, "piece binary")._jdf, "as")(
        ctx._jvm.org.apache.spark.sql.Encoders.BINARY()).toJavaRDD()
    return RDD(found, ctx, CPickleSerializer())


def cached(rows: DataFrame, pack: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> RDD:
    """The pieces of ``rows``, kept on the executors."""
    return pieces(rows, pack).persist(StorageLevel.MEMORY_AND_DISK)


def narrowed(x: np.ndarray) -> tuple:
    """A matrix without loss as (shape, parts): (columns, table, codes), a row of the table for each code.

    A column of few different values takes a byte or two a row, and columns whose values change in the
    same rows (a vector that is repeated) share their codes; others stay as they are, codes ``None``.
    """
    n, shared, plain = len(x), {}, []
    for j in range(x.shape[1]):
        bits = np.ascontiguousarray(x[:, j]).view(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1]))) if n else np.zeros(0, int)
        if 4 * len(heads) < n:
            # runs of equal values: only their heads are sorted
            values, first, at = np.unique(bits[heads], return_index=True, return_inverse=True)
            at = np.repeat(at, np.diff(np.append(heads, n)))
        else:
            values, first, at = np.unique(bits, return_index=True, return_inverse=True)
        if 2 * len(values) > n or len(values) > 65_536:
            plain.append(j)
            continue
        # codes count values as they appear, so that columns that change together have the same
        order = np.argsort(first)
        codes = np.argsort(order)[at].astype(np.uint8 if len(values) <= 256 else np.uint16)
        _, columns, tables = shared.setdefault((codes.dtype.char, codes.tobytes()), (codes, [], []))
        columns.append(j)
        tables.append(values[order].view(float))
    parts = [(np.array(columns), np.stack(tables, 1), codes) for codes, columns, tables in shared.values()]
    if plain:
        parts.append((np.array(plain), x[:, plain], None))
    return x.shape, parts


def widened(kept: tuple) -> np.ndarray:
    """The matrix that :func:`narrowed` was given."""
    shape, parts = kept
    x = np.empty(shape)
    for columns, table, codes in parts:
        x[:, columns] = table if codes is None else table[codes]
    return x


def single(found: RDD) -> RDD:
    """A new RDD of pieces, each its own pickle: such RDDs are zipped as they are, others are pickled again."""
    found._jrdd_deserializer = CPickleSerializer()
    return found


def packed(df: DataFrame, vector: str, use: Sequence[Column] = (), written: bool = False,
           least: int = LEAST_ROWS, narrow: bool = False) -> RDD:
    """Pieces (matrix, use): vectors as rows, and for each condition which rows meet it.

    With ``narrow`` a matrix is kept as :func:`narrowed` gives it, for :func:`summed` only: a design of
    encoded categories and attached vectors is many times its different values. Such pieces stay where
    the files are read, unless these are read in fewer parts than there are cores, or are very large.

    ``written`` tells that ``df`` reads a written table whose rows are dealt well: it is not written
    again, and dealt again only where its files are read in fewer parts than the numbers ask for (a
    table of few different values is small on disk, whatever its rows). A partition has ``least`` rows at least: fewer where passes are costly.
    """
    rows = df.select(
        as_double(vector).alias("v"),
        F.array(*[F.coalesce(u, F.lit(False)) for u in use]).cast("array<boolean>").alias("use"))
    if not written:
        rows = materialise(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    d, wide = size.d or 1, len(use)
    parts = max(1, min(cores, size.n // least), -(-size.n * d // MOST_NUMBERS))
    most = max(1, min(PIECE_ROWS, PIECE_NUMBERS // d))

    def pack(batches, split=regrouped, matrix=matrix_of, kept=narrowed if narrow else np.asarray):
        for t in split(batches, most):
            yield kept(matrix(t, "v", d).astype(float)), np.ascontiguousarray(
                matrix(t, "use", wide).astype(bool).T)

    found = rows.rdd.getNumPartitions() if written else 0
    enough = max(1, min(cores, size.n // least), -(-size.n * d // (8 * MOST_NUMBERS))) if narrow else parts
    return cached(rows.coalesce(min(parts, found)) if found >= enough else rows.repartition(parts), pack)


def packed_columns(df: DataFrame, columns: Sequence[Column], fold: str, k: int) -> RDD:
    """Pieces like those of :func:`packed`, from plain columns of a written table; member i uses all
    rows but those of fold i.

    A row travels as one array: Spark measures a batch of Arrow rows after every row, column by column,
    which costs more than the numbers. Files stay as they were dealt, unless they are read in fewer
    parts than there are cores, or hold very many numbers.
    """
    d = len(columns)
    rows = df.select(F.array(*[c.cast("double") for c in columns], F.col(fold).cast("double")).alias("v"))
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = max(1, min(cores, n // LEAST_ROWS))
    parts = max(few, -(-n * d // MOST_NUMBERS))
    most = max(1, min(PIECE_ROWS, PIECE_NUMBERS // d))

    def pack(batches, split=regrouped, matrix=matrix_of):
        for t in split(batches, most):
            flat = matrix(t, "v", d + 1)
            yield np.ascontiguousarray(flat[:, :d]), flat[:, d] != np.arange(k)[:, None]

    found = rows.rdd.getNumPartitions()
    whole = found >= max(few, -(-n * d // (8 * MOST_NUMBERS)))
    return cached(rows.coalesce(min(parts, found)) if whole else rows.repartition(parts), pack)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def combined(parts: RDD, numbers: int) -> np.ndarray:
    """The sum of at most one vector (of ``numbers`` numbers) for each partition."""
    n = parts.getNumPartitions()
    if n * numbers <= DIRECT_NUMBERS or n == 1:
        return parts.reduce(add)
    slices = max(1, min(n, parts.context.defaultParallelism, numbers))

    def deal(i, it):
        for v in it:
            for s, part in enumerate(np.array_split(v, slices)):
                yield s, (i, part)

    def total(it, add=add):
        own = sorted(((*v, s) for s, v in it), key=lambda e: e[0])
        if own:
            yield own[0][2], reduce(add, [e[1] for e in own])

    found = parts.mapPartitionsWithIndex(deal).partitionBy(slices, int).mapPartitions(total).collect()
    return np.concatenate([v for _, v in sorted(found, key=lambda e: e[0])])


def summed(blocks: RDD, step: Callable[[np.ndarray, np.ndarray], np.ndarray],
           numbers: int = 0) -> np.ndarray:
    """Sum of ``step(matrix, use)``, a vector of ``numbers`` numbers, over all pieces."""
    def fold(it, step=step, wide=widened):
        total = None
        for x, use in it:
            part = step(wide(x) if isinstance(x, tuple) else x, use)
            total = np.array(part, float) if total is None else total + part
        if total is not None:
            yield total

    return combined(blocks.mapPartitions(fold), numbers)
