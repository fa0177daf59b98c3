"""Reports and group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.functions.measures import col, mean_of, rounded
from crowdgap.operators.ordering import first_rows


def frontier_trend(df: DataFrame, by: str, level: str, p: str, low: float = 1400,
                   high: float = 1700) -> DataFrame:
    """Mean probability at low and high levels, their difference and its verdict."""
    lo = F.avg(F.when(col(level) <= low, col(p)))
    hi = F.avg(F.when(col(level) >= high, col(p)))
    return (df.groupBy(by).agg(lo.alias("low"), hi.alias("high"))
            .withColumn("delta", F.col("high") - F.col("low"))
            .withColumn("verdict", m.verdict_trend("delta")))


def mining_summary(df: DataFrame, levels: Sequence[str], flagged="flagged", cost="cost",
                   favourite="favourite", best="best") -> DataFrame:
    """One pass over the corpus: counts, shares, mean probability overall and flagged."""
    flag = col(flagged)
    aggs = [F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"),
            mean_of(flag).alias("flagged_share"), F.avg(cost).alias("mean_cost"),
            mean_of(F.coalesce(col(favourite) == col(best), F.lit(False))).alias("agreement")]
    for c in levels:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.avg(F.when(flag, col(c))).alias(f"flagged_{c}")]
    return df.agg(*aggs)


def frontier_pivot(df: DataFrame, level: str, sets: Sequence[str], set_col: str = "set",
                   rank: str = "rank") -> DataFrame:
    """Level by set table of top-1 and top-5 rates (absent = missed)."""
    aggs = []
    for s in sets:
        inside = col(set_col) == s
        top1 = F.coalesce(col(rank) == 1, F.lit(False)).cast("double")
        top5 = col(rank).isNotNull().cast("double")
        aggs += [F.avg(F.when(inside, top1)).alias(f"{s}_top1"),
                 F.avg(F.when(inside, top5)).alias(f"{s}_top5")]
    return df.groupBy(level).agg(*aggs)


def band_report(df: DataFrame, rating: str = "mover_rating", flagged: str = "flagged",
                found: str = "found", edges=m.REPORT_EDGES, labels=m.REPORT_LABELS) -> DataFrame:
    """Found rate and count by rating band and flag; empty bands keep a row."""
    flag, hit = col(flagged), col(found).cast("double")
    counted = (df.withColumn("band", m.band(rating, edges, labels))
               .where(F.col("band").isNotNull()).groupBy("band").agg(
        F.avg(F.when(~flag, hit)).alias("normal_rate"),
        F.avg(F.when(flag, hit)).alias("flagged_rate"),
        F.count(F.when(~flag, hit)).alias("n_normal"),
        F.count(F.when(flag, hit)).alias("n_flagged")))
    bands = df.sparkSession.createDataFrame(
        list(enumerate(labels)), "band_order int, band string")
    return (bands.join(counted, "band", "left")
            .fillna(0, ["n_normal", "n_flagged"]))


def signature(df: DataFrame, by: str, flags: Sequence[str] = ("quiet", "pawn_move", "retreat",
                                                              "capture"),
              found: str = "found", cost: str = "cost", pmax: str = "p_max",
              cost_rule: str = "truncate") -> DataFrame:
    """Measured signature of each group; mean cost truncated or rounded to a whole number."""
    mean_cost = F.avg(cost)
    whole = mean_cost if cost_rule == "truncate" else F.bround(mean_cost, 0)
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        *[rounded(mean_of(f), 3).alias(f"{f}_share") for f in flags],
        rounded(mean_of(found), 3).alias("found_rate"),
        whole.cast("bigint").alias("mean_cost"),
        rounded(F.avg(pmax), 4).alias("mean_p"))


def value_counts(df: DataFrame, by: Sequence[str], value: str, n: int | None = None) -> DataFrame:
    """Counts per value as long rows with their rank; ``n`` keeps the most frequent ones."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    if n is None:
        return counts
    return first_rows(counts, by, [F.col("n").desc(), col(value)], n, "rank")


def counts_map(df: DataFrame, by: Sequence[str], value: str, n: int) -> DataFrame:
    """The same as one map per group, most frequent first."""
    top = value_counts(df, by, value, n)
    ordered = F.sort_array(F.collect_list(F.struct("rank", col(value).alias("k"),
                                                   F.col("n").alias("v"))))
    entries = F.transform(ordered, lambda e: F.struct(e["k"], e["v"]))
    return top.groupBy(*by).agg(F.map_from_entries(entries).alias("counts"))


def mode_of(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), col(value).alias("v")))
    return (counts.groupBy(*by).agg(best.alias("s"))
            .select(*by, F.col("s.v").alias("mode"), (-F.col("s.neg")).alias("n")))


def n_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def progress(attempts: DataFrame, concepts: DataFrame, users: DataFrame,
             studied: DataFrame | None = None) -> DataFrame:
    """Per user and concept: distinct items tried, correct answers, share, resume point.

    ``correct`` counts repeats too and may exceed ``n``. ``concepts`` (concept, items) is the
    course list; every user gets a row for each of its entries.
    """
    course = F.array(*[F.struct(F.lit(r["concept"]).alias("concept"),
                                F.lit(r["items"]).alias("items"))
                       for r in concepts.orderBy("concept").collect()])
    grid = users.select("code").distinct().select("code", F.inline(course))
    done = attempts.groupBy("code", "concept").agg(
        F.countDistinct("idx").alias("n"), F.sum(col("correct").cast("bigint")).alias("correct"))
    out = grid.join(done, ["code", "concept"], "left").fillna(0, ["n", "correct"])
    if studied is None:
        out = out.withColumn("studied", F.lit(False))
    else:
        seen = studied.select("code", "concept").distinct().withColumn("studied", F.lit(True))
        out = (out.join(seen, ["code", "concept"], "left")
               .withColumn("studied", F.coalesce("studied", F.lit(False))))
    return (out.withColumn("pct", rounded(100 * F.col("n") / F.col("items"), 1))
            .withColumn("resume", F.least(F.col("n"), F.col("items") - 1)))


def profile(attempts: DataFrame, by: Sequence[str] = ("code", "concept")) -> DataFrame:
    return attempts.groupBy(*by).agg(
        F.count("*").alias("tries"), F.countDistinct("idx").alias("seen"),
        F.sum(col("correct").cast("bigint")).alias("hits"),
        rounded(F.avg("human_p")).alias("avg_human_p"))


def totals(attempts: DataFrame, players: DataFrame) -> DataFrame:
    """Site totals; the percentage is NULL while nobody has tried anything."""
    a = attempts.agg(F.count("*").alias("attempts"),
                     F.coalesce(F.sum(col("correct").cast("bigint")), F.lit(0)).alias("correct"))
    p = players.agg(F.count("*").alias("players"))
    # both sides are global aggregates: one row each, folded into one
    one = a.unionByName(p, True).agg(*[F.max(c).alias(c) for c in ("attempts", "correct",
                                                                    "players")])
    return one.withColumn("pct", rounded(
        100 * F.col("correct") / F.nullif(F.col("attempts"), F.lit(0)), 1))


def between_var(df: DataFrame, by: str, y: str) -> DataFrame:
    """Sample variance of the group means."""
    return (df.groupBy(by).agg(F.avg(col(y).cast("double")).alias("mu"))
            .agg(F.var_samp("mu").alias("variance"), F.count("*").alias("groups")))


def enrichment(df: DataFrame, features: Sequence[str], stratum: str,
               min_visible: float = 0.002) -> DataFrame:
    """Rate of each feature per stratum, ratio, and whether the middle fits a dose response.

    All rates come from one pass; only the resulting single row is unpivoted.
    """
    names = ("invisible", "mid", "visible")
    rates = df.agg(*[F.avg(F.when(col(stratum) == s, col(f).cast("double"))).alias(f"{f}|{s}")
                     for f in features for s in names])
    row = F.array(*[F.struct(F.lit(f).alias("feature"),
                             *[F.col(f"`{f}|{s}`").alias(s) for s in names]) for f in features])
    i, mid, v = F.col("invisible"), F.col("mid"), F.col("visible")
    return (rates.select(F.inline(row))
            .withColumn("ratio", F.when(v > min_visible, i / v))
            .withColumn("monotone", ((i >= mid) & (mid >= v)) | ((i <= mid) & (mid <= v))))


def contrast(df: DataFrame, features: Sequence[str], y: str, min_support: int = 80) -> DataFrame:
    """Outcome rate with and without each feature, both sides large enough."""
    hit = col(y).cast("double")
    aggs = []
    for f in features:
        has = col(f).cast("double") > 0
        aggs += [F.count_if(has).alias(f"{f}|nw"), F.count_if(~has).alias(f"{f}|no"),
                 F.avg(F.when(has, hit)).alias(f"{f}|fw"), F.avg(F.when(~has, hit)).alias(f"{f}|fo")]
    row = F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"`{f}|fw`").alias("found_with"),
        F.col(f"`{f}|fo`").alias("found_without"), F.col(f"`{f}|nw`").alias("n_with"),
        F.col(f"`{f}|no`").alias("n_without")) for f in features])
    return (df.agg(*aggs).select(F.inline(row))
            .where((F.col("n_with") >= min_support) & (F.col("n_without") >= min_support)))


def quiz_score(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(col("correct").cast("bigint")).alias("score"),
        rounded(mean_of("correct")).alias("share"))


def assigned_counts(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Original and newly assigned rows per group."""
    both = (old.select(group, F.lit(1).alias("o"), F.lit(0).alias("a"))
            .unionByName(new.select(group, F.lit(0).alias("o"), F.lit(1).alias("a"))))
    return both.groupBy(group).agg(F.sum("o").alias("n_old"), F.sum("a").alias("n_new"))
