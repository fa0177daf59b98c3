"""Vector expressions on ``array`` columns, and dense products as Arrow-batched helpers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgap.functions.measures import col

# Largest matrix shipped to the tasks in one piece (doubles; 32 MB).
MAX_BLOCK_NUMBERS = 4_000_000
SMALL_TABLE = 2000


def as_double(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product accumulated in double; stays in the JVM."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2norm(v, eps: float = 1e-9) -> Column:
    length = norm(v) + F.lit(eps)
    return F.transform(as_double(v), lambda x: x / length)


def subtract(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def stack(series: pd.Series) -> np.ndarray:
    """A batch of array cells as one matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(x, dtype=np.float64) for x in series])


def products(matrix: np.ndarray):
    """Pandas UDF: product of each vector with every row of a small matrix."""
    right = np.ascontiguousarray(np.asarray(matrix, dtype=np.float64).T)

    @F.pandas_udf("array<double>")
    def times(v: pd.Series) -> pd.Series:
        return pd.Series(list(stack(v) @ right)) if len(v) else pd.Series([], dtype=object)

    return times


def blocks(df: DataFrame, label: str, vector: str,
           limit: int = MAX_BLOCK_NUMBERS) -> Iterator[tuple[list, np.ndarray]]:
    """Stream a table of vectors as (labels, matrix) pieces of bounded size.

    The driver holds one piece at a time; a table below the limit is a single piece.
    """
    src = df.select(label, as_double(vector).alias(vector))
    head = src.limit(SMALL_TABLE + 1).collect()   # the usual case: one job, one piece
    if len(head) <= SMALL_TABLE and sum(len(r[1]) for r in head) <= limit:
        if head:
            yield [r[0] for r in head], np.asarray([r[1] for r in head], dtype=np.float64)
        return
    labels, rows, width = [], [], None
    for r in src.toLocalIterator():
        width = width or max(1, len(r[1]))
        labels.append(r[0])
        rows.append(r[1])
        if (len(rows) + 1) * width > limit:
            yield labels, np.asarray(rows, dtype=np.float64)
            labels, rows = [], []
    if rows:
        yield labels, np.asarray(rows, dtype=np.float64)


