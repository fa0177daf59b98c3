"""Exact ranks, running totals and quantiles that never sort a whole table in one task.

A window without a partition column, or over a column where one value holds a third of the
rows, sends that much data to a single task. Everything here works on *buckets*: a bucket is
a value that never decreases along the wanted order. Bucket totals are a small aggregate; a
running sum over them gives each bucket its offset; rows then only need ranking inside their
own bucket.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from crowdgap.session import materialise, parallelism

_BUCKET = "__bucket"
# Rank filters below this size are pruned map-side by Spark itself (window group limit).
GROUP_LIMIT = 1000
BUCKET_BYTES = 64 << 20
TASK_BUCKETS = 64


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shuffle_key(seed, *cols) -> Column:
    """md5(seed:col:...): the seeded, engine-independent random order used everywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def md5_int(digest: Column, digits: int = 8) -> Column:
    """The leading hex digits of an md5 as an integer."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def md5_bucket(digest: Column, buckets: int) -> Column:
    """Bucket number that grows with the md5 text; uniform whatever the keys look like."""
    return F.floor(md5_int(digest, 8) * buckets / 2 ** 32).cast("int")


def bucket_count(df: DataFrame) -> int:
    """Enough buckets for every task, and for the table's bytes: measured ones of a written table.

    Other plans have estimates, which joins multiply; they count for a few buckets a task at most.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(8, parallelism(df.sparkSession))
    return max(tasks, min(size // BUCKET_BYTES, TASK_BUCKETS * tasks))


def _cut_points(df: DataFrame, number: Column, buckets: int) -> tuple[list[float], list[float]]:
    """Approximate quantiles and, among them, the values so frequent that they repeat."""
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(number, probs, 10 * buckets).alias("q")).first()
    found = Counter(float(v) for v in (row.q or []) if math.isfinite(v))
    return sorted(found) or [0.0], sorted(v for v, n in found.items() if n > 1)


def _slot(df: DataFrame, number: Column, points: Sequence[float], name: str) -> DataFrame:
    splits = [float("-inf"), *points, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__ord", outputCol="__slot", handleInvalid="keep")
    return (cut.transform(df.withColumn("__ord", number))
            .withColumn(name, F.coalesce(F.col("__slot").cast("int"), F.lit(-1)))
            .drop("__ord", "__slot"))


def add_range_bucket(df: DataFrame, order: Sequence, buckets: int,
                     name: str = _BUCKET) -> DataFrame:
    """Bucket a numeric order column on approximate quantiles.

    The cut points only balance the work; the result is exact for any cut points. A frequent
    value (or NULL) gets a bucket of its own, which is split further by the second order
    column where that is a plain numeric one.
    """
    number = _col(order[0]).cast("double")
    points, heavy = _cut_points(df, number, buckets)
    points = sorted({*points, *(math.nextafter(v, math.inf) for v in heavy)})
    out = _slot(df, number, points, name)
    second = order[1] if len(order) > 1 and isinstance(order[1], str) else None
    if second is None or not isinstance(df.schema[second].dataType, NumericType):
        return out
    again = F.col(second).cast("double")
    out = _slot(out, again, _cut_points(df, again, buckets)[0], "__sub")
    # slot i starts at the i-th split, and the first split is minus infinity
    lone = [-1, *(points.index(v) + 1 for v in heavy)]
    sub = F.when(F.col(name).isin(lone), F.col("__sub")).otherwise(F.lit(-2))
    return out.withColumn(name, F.struct(F.col(name).alias("a"), sub.alias("b"))).drop("__sub")


def with_prior(df: DataFrame, order: Sequence, totals: Mapping[str, object],
               by: Sequence[str] = (), bucket: Column | None = None,
               written: bool = False, below: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``prior_<name>`` (sum over earlier rows) and ``total_<name>`` per group.

    ``order`` must be a total order inside a group. Without ``bucket`` its first column has to
    be numeric and ascending; cut points, totals and rows then need three passes, so the input
    is written once to the shared folder instead of being computed three times, unless it comes
    from a ``written`` table anyway. NULL groups are groups like others.

    Whoever wants only rows with a ``prior_<name>`` under some bound may name it in ``below``: of
    totals without negative parts, buckets that begin at or above it are left out before any row is
    moved. Rows at or above the bound may still come.
    """
    by = list(by)
    if bucket is None:
        source = df if written else materialise(df, "ordered")
        work = add_range_bucket(source, order, bucket_count(source))
    else:
        work = df.withColumn(_BUCKET, bucket)
    sums = work.groupBy(*by, _BUCKET).agg(
        *[F.sum(_col(v)).alias(f"__t_{n}") for n, v in totals.items()])
    spread = Window.partitionBy(*by)
    before = spread.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, _BUCKET,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in totals],
        *[F.sum(f"__t_{n}").over(spread).alias(f"total_{n}") for n in totals])
    for n, bound in (below or {}).items():
        offsets = offsets.where(F.col(f"__o_{n}") < F.lit(bound))
    inside = (Window.partitionBy(*by, _BUCKET).orderBy(*[_col(c) for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    for c in [*by, _BUCKET]:
        offsets = offsets.withColumnRenamed(c, f"__r_{c}")
    same = [work[c].eqNullSafe(offsets[f"__r_{c}"]) for c in [*by, _BUCKET]]
    joined = work.join(offsets, reduce(and_, same))
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__o_{n}") + F.coalesce(F.sum(_col(v)).over(inside), F.lit(0)))
          .alias(f"prior_{n}") for n, v in totals.items()],
        *[F.col(f"total_{n}") for n in totals])
    return out


def with_rank(df: DataFrame, order: Sequence, by: Sequence[str] = (),
              bucket: Column | None = None, name: str = "rank") -> DataFrame:
    """1-based position in ``order`` inside each group, plus ``n_<name>`` (group size)."""
    ranked = with_prior(df, order, {"one": F.lit(1)}, by, bucket)
    return (ranked.withColumn(name, (F.col("prior_one") + 1).cast("bigint"))
            .withColumn(f"n_{name}", F.col("total_one").cast("bigint"))
            .drop("prior_one", "total_one"))


def with_shuffled_rank(df: DataFrame, key, seed, by: Sequence[str] = (),
                       name: str = "rank") -> DataFrame:
    """Position after a seeded shuffle; md5 prefixes are the buckets, so no sampling pass."""
    keys = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("__h", shuffle_key(seed, *keys))
    bucket = md5_bucket(F.col("__h"), bucket_count(df))
    return with_rank(hashed, ["__h", *keys], by, bucket, name).drop("__h")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence, n: int,
               name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group with their position, for any total order.

    A rank filter of small ``n`` is pruned by Spark before the shuffle, so a hot group sends at
    most ``n`` rows per map task. For larger ``n`` the same filter runs on the pieces of a group
    that each task read first, and then on what they kept.
    """
    order = [_col(c) for c in order]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if n >= GROUP_LIMIT:
        pieces = df.withColumn("__piece", F.spark_partition_id() % bucket_count(df))
        df = (pieces.withColumn(name, place(*by, "__piece")).where(F.col(name) <= n)
              .drop("__piece", name))
    return df.withColumn(name, place(*by)).where(F.col(name) <= n)


def dedupe(df: DataFrame, key, order: Sequence) -> DataFrame:
    """Keep the first row per key in a total order (row rank 1, pruned map-side)."""
    keys = [key] if isinstance(key, str) else list(key)
    return first_rows(df, keys, order, 1, "__rn").drop("__rn")


def exact_quantiles(df: DataFrame, value, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles ``q0..qN`` per group, from distinct-value counts."""
    by = list(by)
    values = df.select(*by, _col(value).cast("double").alias("v")).where("v is not null")
    counts = values.groupBy(*by, "v").agg(F.count("*").alias("n"))
    placed = with_prior(counts, ["v"], {"n": "n"}, by)
    aggs = []
    for i, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("total_n") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("prior_n") <= at) & (at < F.col("prior_n") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"{tag}{i}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"f{i}"))
    picked = placed.groupBy(*by).agg(*aggs)
    return picked.select(*by, *[
        (F.col(f"lo{i}") + F.col(f"f{i}") * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(f"q{i}")
        for i in range(len(probs))])
