"""Merkle manifest of a dataset: sibling-shift self-joins, level by level.

Every row is a leaf, the SHA-256 of its fields (``-`` for null, else byte count, ``:``, value).
Leaves of a group, in order of key, are the lowest level of the group's tree. On each level an
equijoin of the nodes with themselves on the computed index of a sibling (``idx XOR 1`` in binary
trees, ``(slot + offset) mod arity`` inside the run otherwise) gives every node its siblings; the
rows of slot zero then hash the run into its parent. A last run may be shorter, even one node. The
groups' roots, in order of group, are the leaves of one more tree, whose root names the dataset.

Proofs go down again: a node's path is its own step (the siblings before and after it) and its
parent's path, one equijoin with the level above. Folding a leaf through its path gives the root
again, unless the row was changed.

How the work is bounded:

* Indices come from a range partitioning by (group, key, leaf, row number): places inside a range
  plus the running totals of ranges, so a hot group is dealt to as many ranges as it fills. One row
  for each (range, group) is all that is ranked.
* Nodes carry group numbers and digests only; a level has half the rows of the one below, so all
  levels together have twice as many rows as the table. Joins are on (group, index): no hot keys.
* Each level is written once to the shared folder, so a lost executor costs one level's tasks.

Null groups and null keys come first. Rows of equal key are ordered by leaf, and equal rows are
interchangeable. Rows without a key are never tampered with. A change that leaves a null as it is
leaves the leaf as it is, so the row is verified. Texts of any length are hashed whole. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdgap.llm.common import materialise
from crowdgap.llm.registry import query, table
from crowdgap.session import parallelism

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# monotonically_increasing_id() counts rows below this bit and partitions from it on
ROW_BITS = 33


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part`` and ``at``, ranges with ``part``, ``first``, ``before`` and ``size``).

    A row's place in its group is ``at - first + before`` of its range and group.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    line = rows.repartitionByRange(parallelism(rows.sparkSession), *keys).sortWithinPartitions(
        *keys).withColumn("at", F.monotonically_increasing_id())
    line = materialise(line.withColumn("part", F.shiftright("at", ROW_BITS)), "line")
    group = Window.partitionBy(*by)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = line.groupBy(*by, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return line, materialise(ranges.select(
        *by, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(group).alias("size")), "ranges")


def leaves_of(rows: DataFrame, fields: Sequence[str], key: str, group: str,
              changed: str | None) -> DataFrame:
    """(k, gname, row, leaf, altered): the leaf of each row, and its leaf after tampering."""
    leaf = digest(*[field(F.col(c)) for c in fields])
    altered = F.lit(None).cast("string")
    if changed:
        more = field(F.col(changed).cast("decimal(20,0)") + 1)
        hit = F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0
        altered = F.when(hit, digest(*[more if c == changed else field(F.col(c)) for c in fields]))
    return rows.select(F.col(key).alias("k"), F.col(group).cast("string").alias("gname"),
                       F.monotonically_increasing_id().alias("row"), leaf.alias("leaf"),
                       altered.alias("altered"))


def indexed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of the lowest level, groups): groups are numbered in their order."""
    line, ranges = numbered(leaves, ["gname"], ["k", "leaf", "row"])
    names, places = numbered(ranges.select("gname").distinct(), [], ["gname"])
    groups = materialise(names.join(places, "part").select(
        F.col("gname").alias("name"), (F.col("at") - F.col("first") + F.col("before")).alias("g"),
        F.col("size").alias("groups")), "groups")
    ranges = materialise(ranges.join(groups, F.col("gname").eqNullSafe(F.col("name"))).drop("name"),
                         "ranges")
    spot = ranges.withColumnRenamed("gname", "name").withColumnRenamed("part", "range")
    nodes = line.join(spot, F.col("gname").eqNullSafe(F.col("name"))
                      & (F.col("part") == F.col("range")))
    return nodes.select("g", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "size",
                        F.col("leaf").alias("hash"), "k", "altered"), groups


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``step``: the siblings before and after them, as ``before|after``."""
    slot = F.col("idx") % arity
    out, found = nodes, []
    for offset in range(1, arity):
        place = (slot + offset) % arity
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + place
        other = nodes.select(F.col("g").alias(f"g{offset}"), F.col("idx").alias(f"i{offset}"),
                             F.col("hash").alias(f"h{offset}"))
        out = out.join(other, (F.col("g") == F.col(f"g{offset}"))
                       & (sibling == F.col(f"i{offset}")), "left")
        found.append(F.struct(place.alias("slot"), F.col(f"h{offset}").alias("hash")))
    ordered = F.array_sort(F.filter(F.array(*found), lambda x: x["hash"].isNotNull()))

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter(ordered, keep), lambda x: x["hash"]), "")

    step = F.concat(joined(lambda x: x["slot"] < slot), F.lit("|"), joined(lambda x: x["slot"] > slot))
    return out.select(*nodes.columns, step.alias("step"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    steps = F.filter(F.split(path, ","), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda h, s: digest(
        F.substring_index(s, "|", 1), h, F.substring_index(s, "|", -1)))


def climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """All levels of every group's tree, from the leaves: (g, idx, size, hash, step, ...)."""
    size = nodes.agg(F.max("size")).first()[0] or 0
    levels = []
    while True:
        levels.append(materialise(with_siblings(nodes, arity), "level"))
        if size <= 1:
            return levels
        size = -(-size // arity)
        first = levels[-1].where((F.col("size") > 1) & (F.col("idx") % arity == 0))
        nodes = first.select(
            "g", F.floor(F.col("idx") / arity).alias("idx"),
            F.ceil(F.col("size") / arity).alias("size"),
            digest(F.col("hash"), F.substring_index("step", "|", -1)).alias("hash"))


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(level, g, root): a group's tree ends on the level where it has one node."""
    out = None
    for i, nodes in enumerate(levels):
        ends = nodes.where("size = 1").select(F.lit(i).alias("level"), "g", F.col("hash").alias("root"))
        out = ends if out is None else out.unionByName(ends)
    return out


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``path`` and their group's ``root``; ``tops`` has the paths of the roots."""
    above = None
    for i in reversed(range(len(levels))):
        ends = tops.where(F.col("level") == i).select(
            "g", F.lit(-1).cast("bigint").alias("up"), F.col("path").alias("rest"), "root")
        source = ends if above is None else ends.unionByName(above.select(
            "g", F.col("idx").alias("up"), F.col("path").alias("rest"), "root"))
        up = F.when(F.col("size") == 1, F.lit(-1).cast("bigint")).otherwise(
            F.floor(F.col("idx") / arity))
        path = F.when(F.col("size") == 1, F.col("rest")).otherwise(
            F.concat("step", F.lit(","), "rest"))
        above = (levels[i].withColumn("up", up).join(source, ["g", "up"])
                 .withColumn("path", path).drop("up", "rest", "step"))
    return above


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id",
             group: str = "lang", changed: str | None = None, arity: int = 2) -> DataFrame:
    """(key, leaf, subroot, root, path, altered) for every row.

    ``path`` lists the steps from leaf to root, ``before|after,``; ``altered`` is the leaf of a row
    whose ``changed`` column grew by one, where its key's CRC-32 is divisible by 7.
    """
    leaves = materialise(leaves_of(rows, fields, key, group, changed), "leaves")
    nodes, groups = indexed(leaves)
    levels = climb(nodes, arity)
    ends = materialise(roots_of(levels), "roots")
    tops = climb(ends.join(groups.select("g", "groups"), "g").select(
        F.lit(0).cast("bigint").alias("g"), F.col("g").alias("idx"),
        F.col("groups").alias("size"), F.col("root").alias("hash")), arity)
    root = roots_of(tops).withColumn("path", F.lit(""))          # one row, or none
    over = descend(tops, root, arity).select(F.col("idx").alias("g"), "path",
                                             F.col("root").alias("whole"))
    starts = materialise(ends.join(over, "g"), "starts")
    whole = starts.select("whole").first()
    found = descend(levels, starts, arity)
    return found.select(F.col("k").alias(key), F.col("hash").alias("leaf"),
                        F.col("root").alias("subroot"),
                        F.lit(whole[0] if whole else None).cast("string").alias("root"),
                        "path", "altered")


def verify(found: DataFrame) -> DataFrame:
    """Proof digests, and the root that each possibly changed leaf folds to."""
    again = folded(F.coalesce("altered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root",
                       F.sha2(F.translate("path", "|,", ""), 256).alias("proof_sha256"),
                       again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_merkle_manifest", """
WITH RECURSIVE enc AS (
  SELECT doc_id, lang, n_chars, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
     || coalesce(strlen(source) || ':' || source, '-')
     || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_transform(split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
        lambda r, i: xor(r >> 1, (r & 1) * 3988292384), xor(crc, b)), 4294967295) AS crc
  FROM documents),
lv AS (
  SELECT doc_id, lang,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN
      sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail)
    END AS altered
  FROM enc),
base AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n, coalesce('x' || lang, '') AS g FROM lv),
up AS (
  SELECT 0 AS level, g, idx, n, leaf AS h FROM base
  UNION ALL
  SELECT level + 1, g, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM up WHERE n > 1 GROUP BY level, g, idx // 2),
ends AS (SELECT g, level, h AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n,
    subroot AS h FROM ends
  UNION ALL
  SELECT level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM top WHERE n > 1 GROUP BY level, idx // 2),
place AS (SELECT g, subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS spot FROM ends),
steps AS (
  SELECT b.doc_id, b.g, b.idx, u.level, s.idx < u.idx AS first, s.h
  FROM base b JOIN up u ON u.g = b.g AND u.idx = b.idx >> u.level AND u.n > 1
  LEFT JOIN up s ON s.g = u.g AND s.level = u.level AND s.idx = xor(u.idx, 1)
  UNION ALL
  SELECT b.doc_id, b.g, b.idx, 1000 + t.level, s.idx < t.idx, s.h
  FROM base b JOIN place p ON p.g = b.g JOIN top t ON t.idx = p.spot >> t.level AND t.n > 1
  LEFT JOIN top s ON s.level = t.level AND s.idx = xor(t.idx, 1)),
path AS (
  SELECT g, idx, list({'first': coalesce(first, false), 'h': coalesce(h, '')} ORDER BY level) AS path
  FROM steps GROUP BY g, idx),
done AS (
  SELECT b.doc_id, b.leaf, p.subroot, (SELECT h FROM top WHERE n = 1) AS root,
    sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.h), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda a, s: {'first': false, 'h':
      sha256(CASE WHEN s.first THEN s.h || a.h ELSE a.h || s.h END)},
      {'first': false, 'h': coalesce(b.altered, b.leaf)}).h AS folded_root
  FROM base b JOIN place p ON p.g = b.g LEFT JOIN path ON path.g = b.g AND path.idx = b.idx)
SELECT *, folded_root = root AS verified FROM done
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(manifest(table(spark, sf_dir, "documents"), changed="n_chars"))
