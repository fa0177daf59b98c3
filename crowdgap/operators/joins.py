"""Joins, set operations and id repair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgap.functions.measures import col
from crowdgap.operators.ordering import dedupe


def attach_ratings(df: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """Left join; ``ratings`` must hold one row per key (see :func:`first_of`)."""
    return df.join(ratings, key, "left")


def first_of(sources: Sequence[DataFrame], key: str, required: str,
             payload: Sequence[str]) -> DataFrame:
    """First source that has a value wins per key; one map-side combined aggregate."""
    tagged = [s.where(col(required).isNotNull())
              .select(key, F.struct(F.lit(i).alias("prio"), *payload).alias("s"))
              for i, s in enumerate(sources)]
    best = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min("s").alias("s"))
    return best.select(key, *[F.col(f"s.{c}").alias(c) for c in payload])


def unambiguous_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that always carry the same value; min = max needs no distinct count."""
    return (df.where(col(value).isNotNull()).groupBy(key)
            .agg(F.min(value).alias(value), F.max(value).alias("__hi"))
            .where(F.col(value) == F.col("__hi")).drop("__hi"))


def repair_ids(df: DataFrame, mapping: DataFrame, key: str, group: str,
               placeholder: str = "?") -> DataFrame:
    """Placeholder groups take the mapped id; what stays unmapped becomes its own group.

    Only placeholder rows are joined. They leave the union with distinct group ids, so no later
    grouping sees one giant fake group.
    """
    wanted = mapping.select(col(key), col(group).alias("__mapped"))
    known = df.where(~col(group).eqNullSafe(F.lit(placeholder)))
    fixed = (df.where(col(group) == placeholder).join(wanted, key, "left")
             .withColumn(group, F.coalesce(F.col("__mapped"), F.concat(
                 F.lit("orph_"), F.md5(col(key).cast("string")))))
             .drop("__mapped"))
    return known.unionByName(fixed)


def exclude(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_anti")


def keep_groups(df: DataFrame, groups: DataFrame, on) -> DataFrame:
    return df.join(groups, on, "left_semi")


def new_only(everything: DataFrame, old: DataFrame, key: str, order: Sequence) -> DataFrame:
    """Rows whose key is not in ``old``, one per key."""
    return dedupe(exclude(everything, old.select(key), key), key, order)


def lookup_prob(df: DataFrame, options: str, picked: str, name: str = "p") -> DataFrame:
    """Probability of the picked option in the row's own list; unlisted means 0."""
    hit = F.filter(col(options), lambda o: o["uci"] == col(picked))
    return df.withColumn(name, F.coalesce(F.get(hit, F.lit(0))["p"], F.lit(0.0)))


def attach_vectors(df: DataFrame, vectors: DataFrame, key: str,
                   vector: str = "embedding") -> DataFrame:
    """Key join that fails the job when a row has no vector."""
    joined = df.join(vectors.select(key, vector), key, "left")
    checked = F.when(col(vector).isNull(), F.raise_error(
        F.concat(F.lit("no vector for key "), col(key).cast("string")))).otherwise(col(vector))
    return joined.withColumn(vector, checked)


def score_lookup(items: DataFrame, master: DataFrame, key: str, payload: Sequence[str],
                 order: Sequence) -> DataFrame:
    """Every item keeps its row; ``hit`` tells whether the master knows the key."""
    one = dedupe(master, key, order).select(key, *payload, F.lit(True).alias("hit"))
    return items.join(one, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@dataclass(frozen=True)
class Quota:
    """A closed rating range and how much is wanted from it."""

    name: str
    lo: float
    hi: float
    want: int


def assign_band(quotas: Sequence[Quota], white, black) -> Column:
    """Range join on a short list of closed ranges, both players inside: a CASE expression."""
    def both(q):
        return col(white).between(q.lo, q.hi) & col(black).between(q.lo, q.hi)

    chain = F.when(both(quotas[0]), quotas[0].name)
    for q in quotas[1:]:
        chain = chain.when(both(q), q.name)
    return chain


def assign_band_either(quotas: Sequence[Quota], white, black) -> Column:
    """Either player inside; quotas in preference order, white before black."""
    chain = None
    for q in quotas:
        for side, rating in (("w", white), ("b", black)):
            picked = F.struct(F.lit(q.name).alias("band"), F.lit(side).alias("side"))
            cond = col(rating).between(q.lo, q.hi)
            chain = F.when(cond, picked) if chain is None else chain.when(cond, picked)
    return chain


def grade(answers: DataFrame, quiz: DataFrame, on: str) -> DataFrame:
    """Join answers to their key by item id and mark them."""
    return answers.join(quiz, on).withColumn("correct", col("picked") == col("best"))


def union_batches(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def overlaps(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that occur in more than one set; empty means the sets are disjoint."""
    tagged = [f.select(col(key)).withColumn("__set", F.lit(i)) for i, f in enumerate(frames)]
    return (reduce(DataFrame.unionByName, tagged).groupBy(key)
            .agg(F.min("__set").alias("first_set"), F.max("__set").alias("last_set"))
            .where("first_set < last_set"))


def assert_disjoint(frames: Sequence[DataFrame], key: str) -> None:
    shared = overlaps(frames, key).limit(5).collect()
    if shared:
        raise ValueError(f"sets share keys, e.g. {[r[key] for r in shared]}")
