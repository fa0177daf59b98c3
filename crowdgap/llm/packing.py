"""Best-fit packing of documents into training sequences, under conflicts.

A sequence (bin) holds ``capacity`` tokens. Documents longer than that give full bins of their own
and a remainder. The pieces are placed by falling size into the tightest bin that has room and
holds neither a piece of the same source nor one of the same cluster of duplicates; without such a
bin a new one opens. Bins are ordered by what is left in them and carry a bitmap of the sources
and larger clusters they hold. A table counts, for each residual and class, the bins without that
class, so the search starts at the tightest residual that can do and goes on until a compatible
bin is found; small clusters are looked up in the bin.

Documents are dealt by hash to groups of about ``per_group`` rows that are packed apart, so a
source or cluster of any share is spread evenly and no task holds more than its groups.

``pack`` takes a column of clusters; without one they are exact copies. The query's clusters are the
classes of near copies that ``neardup`` finds.

Sizes are estimated tokens (UTF-8 bytes / 4, rounded up), or the numbers of a column. Null sources
and clusters never conflict. Null or empty texts have size 0: they are listed with a null bin.
Rows that repeat are packed each (as duplicates, apart); of equal sizes the smaller key goes
first, null keys first of all. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm import neardup
from crowdgap.llm.common import materialise
from crowdgap.llm.registry import query, table

CAPACITY, PER_GROUP = 2048, 20_000
LARGE_CLUSTER = 16          # members in a group from which a cluster has a bit of its own


def token_estimate(text) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


class Bins:
    """Open bins by residual, with the counts that guide the search."""

    def __init__(self, capacity: int, classes: int):
        self.lacking = np.zeros((capacity + 1, max(classes, 1)), np.int32)
        self.at = defaultdict(dict)         # residual -> bins in order of opening
        self.room: list[int] = []
        self.bits: list[np.ndarray] = []    # classes that the bin does not hold
        self.small: list[set] = []
        self.capacity = capacity

    def tightest(self, size: int, own: list[int], cluster) -> int | None:
        """The compatible bin with least room, of equal ones the oldest."""
        if own:
            possible = (self.lacking[size:, own] > 0).all(axis=1)
            levels = np.flatnonzero(possible) + size
        else:
            levels = np.array(sorted(r for r, bins in self.at.items() if r >= size and bins),
                              np.int64)
        for r in levels.tolist():
            for b in self.at[r]:
                if self.bits[b][own].all() and cluster not in self.small[b]:
                    return b
        return None

    def place(self, size: int, own: list[int], cluster) -> tuple[int, int]:
        """Bin and offset of a piece."""
        b = self.tightest(size, own, cluster)
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.bits.append(np.ones(self.lacking.shape[1], bool))
            self.small.append(set())
        else:
            self.lacking[self.room[b]] -= self.bits[b]
            del self.at[self.room[b]][b]
        start = self.capacity - self.room[b]
        self.room[b] -= size
        self.bits[b][own] = False
        if cluster is not None:
            self.small[b].add(cluster)
        self.lacking[self.room[b]] += self.bits[b]
        self.at[self.room[b]][b] = None
        return b, start


def pack_group(sizes, sources, clusters, capacity: int) -> tuple[np.ndarray, list]:
    """Pieces (row, piece, bin, start, size) of rows that come by falling remainder."""
    members = defaultdict(int)
    for c in clusters:
        if c is not None:
            members[c] += 1
    classes: dict = {}
    for s in sources:
        if s is not None:
            classes.setdefault(("source", s), len(classes))
    for c, n in members.items():
        if n >= LARGE_CLUSTER:
            classes.setdefault(("cluster", c), len(classes))
    bins, out, full = Bins(capacity, len(classes)), [], []
    for row, (size, source, cluster) in enumerate(zip(sizes, sources, clusters)):
        whole, rest = divmod(int(size), capacity)
        full += [(row, piece) for piece in range(whole)]
        if rest:
            own = [classes[k] for k in (("source", source), ("cluster", cluster)) if k in classes]
            alone = cluster is None or ("cluster", cluster) in classes or members[cluster] < 2
            b, start = bins.place(rest, own, None if alone else cluster)
            out.append((row, whole, b, start, rest))
        elif not whole:
            out.append((row, 0, -1, -1, 0))
    first = len(bins.room)
    out += [(row, piece, first + i, 0, capacity) for i, (row, piece) in enumerate(full)]
    return np.array(out, np.int64).reshape(-1, 5), bins.room


def pack(docs: DataFrame, key: str = "doc_id", text: str | None = "text", source: str = "source",
         cluster: str | None = None, size: str | None = None, capacity: int = CAPACITY,
         per_group: int = PER_GROUP) -> DataFrame:
    """(key, piece, bin, start, size): where each piece of each document goes.

    ``text`` is read only where ``cluster`` or ``size`` are not named.
    """
    kind = docs.schema[key].dataType
    groups = max(1, -(-docs.count() // per_group))
    same = F.col(cluster).cast("string") if cluster else F.when(
        F.col(text) != "", F.substring(F.sha2(F.col(text), 256), 1, 24))
    amount = F.coalesce(F.col(size).cast("bigint"), F.lit(0)) if size else token_estimate(F.col(text))
    items = docs.select(F.col(key).alias("k"), amount.alias("size"),
                        F.col(source).cast("string").alias("source"), same.alias("cluster"))
    items = items.withColumn("g", F.pmod(F.xxhash64("k", "cluster", "size"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        k, amounts, sources, clusters, g = (rows.column(i).to_pylist() for i in range(5))
        order = sorted(range(len(k)), key=lambda i: (-(amounts[i] % capacity), k[i] is not None,
                                                     0 if k[i] is None else k[i],
                                                     clusters[i] or ""))
        placed, _ = pack_group(*([c[i] for i in order] for c in (amounts, sources, clusters)),
                               capacity)
        row, piece, where, start, amount_ = placed.T
        none = where < 0
        return pa.table({
            key: rows.column(0).take(pa.array(np.array(order, np.int64)[row])),
            "piece": pa.array(piece, pa.int32()),
            "bin": pa.array(where + (g[0] << 32), mask=none),
            "start": pa.array(start, mask=none), "size": pa.array(amount_)})

    return items.groupBy("g").applyInArrow(
        run, f"`{key}` {kind.simpleString()}, piece int, bin bigint, start bigint, size bigint")


def pack_classes(docs: DataFrame) -> DataFrame:
    """``pack`` with the classes of near copies as clusters."""
    # texts are read for their digest and size only: narrow rows are joined, once
    named = docs.select("doc_id", "source", neardup.digest_of(F.col("text")).alias("digest"),
                        token_estimate(F.col("text")).alias("size"), (F.col("text") != "").alias("some"))
    found = named.join(neardup.labels(docs), "digest").select(
        "doc_id", "source", "size", F.when(F.col("some"), F.hex("label")).alias("label"))
    return pack(materialise(found, "sized"), text=None, cluster="label", size="size")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_classes(table(spark, sf_dir, "documents"))
