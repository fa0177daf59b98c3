"""Ranked candidate lists, top-k and curve deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgap.functions.measures import col
from crowdgap.operators.ordering import exact_quantiles, first_rows


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence, n: int,
                  name: str = "rn") -> DataFrame:
    return first_rows(df, by, order, n, name)


def target_rank(options: str, target, k: int | None = None) -> Column:
    """1-based place of a target in an ordered list, NULL when absent or beyond ``k``."""
    pool = col(options) if k is None else F.slice(col(options), 1, k)
    return F.nullif(F.array_position(pool, col(target)), F.lit(0))


def target_ranks(df: DataFrame, item: Sequence[str], order: Sequence, is_target: Column,
                 k: int) -> DataFrame:
    """The same on a long (item, option) table: cut at k first, then look for the target."""
    kept = first_rows(df, item, order, k, "rank").withColumn("__hit", is_target)
    return kept.groupBy(*item).agg(F.min(F.when(F.col("__hit"), F.col("rank"))).alias("rank"))


def top_options(df: DataFrame, item: Sequence[str], option: str, p: str, k: int) -> DataFrame:
    """Best ``k`` options per item as an ordered array and as ``opt:0.123`` text."""
    kept = first_rows(df, item, [col(p).desc(), col(option)], k, "rank")
    rows = F.sort_array(F.collect_list(F.struct("rank", col(option).alias("option"),
                                                col(p).alias("p"))))
    text = F.array_join(F.transform("options", lambda o: F.format_string(
        "%s:%.3f", o["option"], o["p"])), " ")
    return kept.groupBy(*item).agg(rows.alias("options")).withColumn("text", text)


def favourite(df: DataFrame, item: Sequence[str], option: str, p: str) -> DataFrame:
    """Most likely option per item; equal probabilities resolve to the smallest option."""
    pick = F.min(F.struct((-col(p)).alias("neg"), col(option).alias("option")))
    return (df.groupBy(*item).agg(pick.alias("s"))
            .select(*item, F.col("s.option").alias(option), (-F.col("s.neg")).alias(p)))


def top2_margin(df: DataFrame, item: Sequence[str], label: str, sim: str) -> DataFrame:
    """Best and runner-up similarity per item and the distance between them."""
    two = first_rows(df, item, [col(sim).desc(), col(label)], 2, "rn")
    best, second = F.col("rn") == 1, F.col("rn") == 2
    return (two.groupBy(*item).agg(
        F.max(F.when(best, col(label))).alias(label),
        F.max(F.when(best, col(sim))).alias("sim"),
        F.max(F.when(second, col(sim))).alias("second"))
        .withColumn("margin", F.col("sim") - F.col("second")))


def curve_delta(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Change against the previous point; a curve is a short table by definition."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("delta", col(value) - F.lag(value).over(w))


def top_n(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def prototypes(df: DataFrame, score: str, key: str, n: int | None = None,
               pct: float | None = None) -> DataFrame:
    """The ``n`` best rows, or every row at or above the top-``pct`` percent cutoff."""
    if n is not None:
        return top_n(df, [col(score).desc(), col(key)], n)
    cutoff = exact_quantiles(df, score, [1 - pct / 100]).first()
    return df.where(col(score) >= F.lit(cutoff.q0))


def best_by(df: DataFrame, choice: str, metric: str, highest: bool = True) -> DataFrame:
    """Setting with the best metric; ties go to the smallest setting."""
    key = -col(metric) if highest else col(metric)
    pick = F.min(F.struct(key.alias("k"), col(choice).alias("c"), col(metric).alias("m")))
    return df.agg(pick.alias("s")).select(F.col("s.c").alias(choice), F.col("s.m").alias(metric))
