"""Quotas, splits, folds and seeded samples.

Whole-group decisions are taken on a table with one row per group, never on the rows. Seeded
order is md5(seed:key), so any engine reproduces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgap.functions.measures import col
from crowdgap.operators.joins import Quota
from crowdgap.operators.ordering import (
    GROUP_LIMIT, bucket_count, first_rows, md5_bucket, md5_int, shuffle_key, with_prior,
    with_rank, with_shuffled_rank)
from crowdgap.session import materialise


def quota_groups(groups: DataFrame, band: Column, quotas: Sequence[Quota],
                 order: str) -> DataFrame:
    """First ``want`` groups per band in arrival order; one row per group comes in."""
    tagged = groups.withColumn("band", band).where(F.col("band").isNotNull())
    want = F.create_map(*[F.lit(v) for q in quotas for v in (q.name, q.want)])
    kept = first_rows(tagged, ["band"], [order], max(q.want for q in quotas), "arrival")
    return kept.where(F.col("arrival") <= want[F.col("band")])


def quota_rows(groups: DataFrame, quotas: Sequence[Quota], order: str, white: str, black: str,
               white_rows: str, black_rows: str) -> DataFrame:
    """Fill row quotas in preference order with whole groups.

    A group goes to the first band that has one of its players and is not yet full when it
    arrives; the group that crosses the target stays whole. A group claimed by an open band
    without offering any new row is lost, as it was looked at once. When a band is full, its
    later groups are offered to the next one.
    """
    groups = materialise(groups, "groups")   # one row per group, read several times per band
    left, out = groups, None
    for q in quotas:
        in_white = col(white).between(q.lo, q.hi)
        in_black = col(black).between(q.lo, q.hi)
        side = F.when(in_white, "w").when(in_black, "b")
        mine = (left.withColumn("side", side).where(F.col("side").isNotNull())
                .withColumn("rows", F.when(F.col("side") == "w", col(white_rows))
                            .otherwise(col(black_rows))))
        seen = with_prior(mine, [order], {"rows": "rows"}, written=True)
        claimed = seen.where(F.col("prior_rows") < q.want)
        picked = (claimed.where(F.col("rows") > 0).withColumn("band", F.lit(q.name))
                  .select(*groups.columns, "band", "side", "rows", "prior_rows"))
        out = picked if out is None else out.unionByName(picked)
        if q is not quotas[-1]:
            # arrival of the last claimed group bounds what the band can still take
            last, offered = claimed.agg(F.max(order), F.max("total_rows")).first()
            if (offered or 0) < q.want:
                left = left.where(side.isNull())
            else:
                left = left.where(side.isNull() | (col(order) > F.lit(last)))
    return out


def number_groups(groups: DataFrame, order: str, prefix: str, name: str = "gid") -> DataFrame:
    """Sequential ids in arrival order."""
    ranked = with_rank(groups, [order], name="__n")
    return (ranked.withColumn(name, F.concat(F.lit(prefix), F.col("__n").cast("string")))
            .drop("__n", "n___n"))


def disjoint_sets(df: DataFrame, by: Sequence[str], key: str, sizes: dict[str, int], seed,
                  strict: bool = True) -> DataFrame:
    """Shuffle each family and cut consecutive slices; ``strict`` fails below the total."""
    total = sum(sizes.values())
    if strict:
        short = df.groupBy(*by).count().where(F.col("count") < total).limit(1).collect()
        if short:
            raise ValueError(f"{short[0].asDict()} is smaller than {total}")
    kept = first_rows(df, by, [shuffle_key(seed, key), col(key)], total, "pos")
    chain, upto = None, 0
    for name, size in sizes.items():
        upto += size
        cond = F.col("pos") <= upto
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return kept.withColumn("set", chain)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n_rows"))


def sample_groups(df: DataFrame, group: str, budget: int, seed) -> DataFrame:
    """Whole shuffled groups until the row budget is met (crossing group included)."""
    return sample_sized(group_sizes(df, group), group, budget, seed, bucket_count(df))


def sample_sized(sizes: DataFrame, group: str, budget: int, seed, buckets: int) -> DataFrame:
    """:func:`sample_groups` of a table with one row (group, ``n_rows``) per group.

    A smaller budget takes the first of the same groups: those with ``prior_rows`` below it.
    """
    hashed = sizes.select(group, "n_rows").withColumn("__h", shuffle_key(seed, group))
    seen = with_prior(hashed, ["__h", group], {"rows": "n_rows"},
                      bucket=md5_bucket(F.col("__h"), buckets), below={"rows": budget})
    return seen.where(F.col("prior_rows") < budget).select(group, "n_rows", "prior_rows")


def group_holdout(df: DataFrame, group: str, fraction: float, seed) -> DataFrame:
    """One row per group with ``is_test``: the first floor(f*n) shuffled groups."""
    ranked = with_shuffled_rank(df.select(group).distinct(), group, seed)
    test = F.col("rank") <= F.floor(F.lit(fraction) * F.col("n_rank"))
    return ranked.select(group, test.alias("is_test"))


def group_folds(df: DataFrame, group: str, k: int, seed=0, balanced: bool = True) -> DataFrame:
    """Fold per group; a group never straddles.

    Balanced: groups by falling size are dealt in serpentine order. Unbalanced: md5 mod k,
    a row-local expression (see :func:`hash_fold`) that needs no shuffle at all.
    """
    if not balanced:
        return df.select(group).distinct().withColumn("fold", hash_fold(group, k, seed))
    sizes = group_sizes(df, group).withColumn("__h", shuffle_key(seed, group))
    bucket = F.struct((-F.col("n_rows")).alias("s"),
                      md5_bucket(F.col("__h"), bucket_count(df)).alias("h"))
    ranked = with_rank(sizes, [F.col("n_rows").desc(), "__h", group], bucket=bucket)
    place = F.col("rank") - 1
    lap, seat = F.floor(place / k), place % k
    fold = F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat)
    return ranked.select(group, "n_rows", fold.cast("int").alias("fold"))


def hash_fold(group, k: int, seed=0) -> Column:
    return (md5_int(shuffle_key(seed, group)) % k).cast("int")


def strat_folds(df: DataFrame, y: str, key: str, k: int, seed) -> DataFrame:
    """Each class is shuffled and dealt round-robin."""
    ranked = with_shuffled_rank(df, key, seed, by=[y])
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "n_rank")


def sample_n(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """Seeded sample without replacement."""
    if n < 100 * GROUP_LIMIT:
        return df.orderBy(shuffle_key(seed, key), key).limit(n)
    return with_shuffled_rank(df, key, seed).where(F.col("rank") <= n).drop("rank", "n_rank")


def quota_per_tag(df: DataFrame, tags: str, order: str, wanted: Sequence[str], n: int = 150,
                  baseline: int = 400) -> DataFrame:
    """First ``n`` items per tag in arrival order, plus the first items whatever their tags."""
    tagged = (df.withColumn("tag", F.explode(F.array_distinct(col(tags))))
              .where(F.col("tag").isin(*wanted)))
    per_tag = first_rows(tagged, ["tag"], [order], n, "arrival")
    base = first_rows(df.withColumn("tag", F.lit("baseline")), ["tag"], [order], baseline,
                      "arrival")
    return per_tag.unionByName(base.select(*per_tag.columns))


def interleave(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    return sample_n(df, key, n, seed)


def curriculum(items: DataFrame, concept: str, key: str, seed, study: int = 4,
               drill: int = 12) -> DataFrame:
    """Per concept: shuffle the eligible items, first ``study`` to read, next ``drill`` to try."""
    kept = first_rows(items, [concept], [shuffle_key(seed, key), col(key)], study + drill, "pos")
    return (kept.withColumn("slot", F.when(F.col("pos") <= study, "study").otherwise("drill"))
            .withColumn("idx", F.when(F.col("pos") <= study, F.col("pos") - 1)
                        .otherwise(F.col("pos") - 1 - study)))


def extend_curriculum(current: DataFrame, assigned: DataFrame, concept: str, key: str, seed,
                      extra: int = 24, min_margin: float = 0.05, batch: str = "extension",
                      margin: str = "margin") -> DataFrame:
    """Append well-assigned, unused items to the drill slot, numbered after the present ones."""
    pool = (assigned.where(col(margin) >= min_margin)
            .join(current.select(key), key, "left_anti"))
    fresh = first_rows(pool, [concept], [shuffle_key(seed, key), col(key)], extra, "pos")
    have = (current.where(F.col("slot") == "drill").groupBy(concept)
            .agg(F.count("*").alias("have")))
    return (fresh.join(have, concept, "left")
            .withColumn("idx", F.coalesce("have", F.lit(0)) + F.col("pos") - 1)
            .withColumn("slot", F.lit("drill")).withColumn("batch", F.lit(batch)).drop("have"))


def curriculum_documents(items: DataFrame, concept: str, columns: Sequence[str]) -> DataFrame:
    """One nested row per concept with ordered ``study`` and ``drill`` arrays."""
    entry = F.struct("idx", *columns)

    def slot(name):
        return F.sort_array(F.collect_list(F.when(F.col("slot") == name, entry))).alias(name)

    return items.groupBy(concept).agg(slot("study"), slot("drill"))


def first_eligible(items: DataFrame, order: str, n: int) -> DataFrame:
    """Flat pool: the first ``n`` eligible items, numbered from 1."""
    return items.orderBy(order).limit(n)
