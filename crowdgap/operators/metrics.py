"""Scoring of predictions and labelings; exact, tie-aware, grouped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdgap.functions.measures import col, mean_of, nan_to_null
from crowdgap.operators.ordering import (
    add_range_bucket, bucket_count, exact_quantiles, md5_int, shuffle_key)
from crowdgap.session import materialise


def _scored(df: DataFrame, y, p, by: Sequence[str]) -> DataFrame:
    return (df.select(*by, col(y).cast("double").alias("y"), nan_to_null(p).alias("p"))
            .where("y is not null and p is not null"))


def auc(df: DataFrame, y, p, by: Sequence[str] = (), ties: float = 0.5) -> DataFrame:
    """ROC AUC by rank sums: aggregate per distinct score, then pairs inside and between score ranges.

    Ranges are cut at approximate quantiles; a range counts its own pairs, and its positives win against
    all negatives of the ranges below, so no row meets a running total. ``ties`` is the credit of an
    equal pair (0 gives the strict pair-ordering share). A group with one class has no AUC.
    """
    by = list(by)
    per = materialise(_scored(df, y, p, by).groupBy(*by, "p").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "ordered")
    work = add_range_bucket(per, ["p"], bucket_count(per), "__range")
    inside = Window.partitionBy(*by, "__range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    ranges = work.withColumn("__wins", F.col("pos") * (below + ties * F.col("neg"))).groupBy(
        *by, "__range").agg(F.sum("__wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    wins, pairs = F.sum("wins"), F.sum("pos") * F.sum("neg")
    return ranges.withColumn("wins", F.col("wins") + F.col("pos") * lower).groupBy(*by).agg(
        (wins / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.sum(F.col("pos") + F.col("neg")).cast("bigint").alias("n"))


def brier(df: DataFrame, y, p, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of probabilities next to the score of the constant base rate."""
    s = _scored(df, y, p, by)
    rate = F.avg("y")
    return s.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        rate.alias("base_rate"), (rate * (1 - rate)).alias("reference"))


def calibration(df: DataFrame, y, p, bins: int = 10) -> DataFrame:
    """Quantile bins, right-closed; bins without rows do not appear."""
    s = _scored(df, y, p, [])
    inner = exact_quantiles(s, "p", [i / bins for i in range(1, bins)]).first()
    edges = list(inner) if inner and inner[0] is not None else []
    slot = sum([(F.col("p") > F.lit(e)).cast("int") for e in edges], F.lit(0))
    return s.groupBy(slot.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("actual"))


def fold_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation over folds or seeds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
                               F.count("*").alias("folds"))


def band_metrics(df: DataFrame, band: str, y, p, min_rows: int = 100) -> DataFrame:
    """AUC and Brier per band; small and one-class bands are left out."""
    a = auc(df, y, p, [band])
    b = brier(df, y, p, [band]).drop("n")
    return (a.join(b, band).where((F.col("n") >= min_rows) & F.col("auc").isNotNull())
            .select(band, "n", "auc", "brier"))


def pred_vs_actual(df: DataFrame, flag: str, y, p) -> DataFrame:
    return df.groupBy(flag).agg(F.count("*").alias("n"), F.avg(col(p)).alias("predicted"),
                                mean_of(y).alias("actual"))


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows."""
    def pairs(c):
        return F.col(c) * (F.col(c) - 1) / 2

    # cells, rows and columns of the table of counts in one pass
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    sides = cells.groupingSets([[a, b], [a], [b]], a, b).agg(
        F.sum("n").alias("n"), F.grouping_id().alias("side"))
    one = sides.agg(*[F.sum(F.when(F.col("side") == i, pairs("n"))).alias(c)
                      for i, c in enumerate(("cells", "rows", "cols"))],
                    F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("total"))
    expected = F.col("rows") * F.col("cols") / F.nullif(pairs("total"), F.lit(0.0))
    top = (F.col("rows") + F.col("cols")) / 2
    # two labelings that are both trivial agree perfectly
    return one.select(
        F.when(top == expected, F.lit(1.0))
        .otherwise((F.col("cells") - expected) / F.nullif(top - expected, F.lit(0.0)))
        .alias("ari"), F.col("total").cast("bigint").alias("n"))


def dummy_auc(df: DataFrame, y, key: str, seed, by: Sequence[str] = ()) -> DataFrame:
    """Chance baseline: AUC of a seeded random score."""
    score = md5_int(shuffle_key(seed, key)) / F.lit(float(16 ** 8))
    return auc(df.withColumn("__score", score), y, "__score", by)
