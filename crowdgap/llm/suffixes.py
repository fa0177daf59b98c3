"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document of
smaller key, or in the same document further left. Strings are judged on the input; matches never
cross documents.

Suffixes of a whole corpus cannot be sorted on one machine, so the text is cut where equal strings
are sure to be cut alike:

1. Each string of LENGTH bytes has an anchor: of the GRAM-byte strings in it the one with the
   smallest hash (of equal ones the leftmost). Equal strings have equal anchors. The consecutive
   starts in a text with the same anchor form a block, about 135 bytes for 35 starts.
2. Blocks are dealt by their anchor, those of a frequent anchor (more than about SHARD bytes of
   different blocks, estimated from one text in SAMPLE) also by the block's hash, to parts of
   about SHARD bytes on different tasks. Equal blocks collapse into their first occurrence, inside a
   batch before the shuffle, so a passage that a third of all texts share is one row for a batch.
   Later occurrences are covered whole. A block whose anchor occurs in no other block is done.
3. What is left, different blocks with a common anchor, is read and packed into shards of about
   SHARD bytes. A shard gets a suffix array by Larsson-Sadakane refinement (ranks by 8 bytes, then
   doubled, only in groups that are not yet sorted), common prefixes by Kasai's rule (run over all
   blocks of the shard side by side) and so the classes of equal strings. Groups that need several
   shards are merged by binary search in the shards' sorted distinct strings.
4. Each part of a frequent anchor emits the first start of each of its strings with a 128-bit hash
   of the string. A shuffle by that hash settles equal strings of different parts; a string has a
   row for each part at most. The estimate decides only where work is done, not its result.

Nulls count as empty texts; texts below LENGTH bytes lose nothing. Null keys come after all
others. Rows that repeat a key and text are one document and are worked on once; the result is
joined back to each of them. Rows of equal key with different texts are different documents, told
apart and ordered by a 64-bit digest of the text. Very long texts are cut into pieces, which
only makes more blocks. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdgap.llm.common import byte_table, carried, mix, powers, rows_of, small, texts
from crowdgap.llm.registry import query, table

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1                    # anchors that a string can have
PIECE, SHARD, SAMPLE = 1 << 20, 1 << 20, 64
BLOCK = 135                                 # bytes of a usual block
LAST = 2 ** 63 - 1
BASE = 0x9E3779B97F4A7C15
ROW = "anchor bigint, part int, block bigint, doc bigint, digest bigint, pack bigint"


def order_of(key) -> Column:
    return F.coalesce(key.cast("bigint"), F.lit(LAST))


def digest_of(text) -> Column:
    """64 bits that tell texts of one key apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def gram_hashes(raw: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h, size = table_[raw], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(BASE, size, 2 ** 64)) + h[size:]
        size *= 2
    return mix(h)


def least_over(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on."""
    n, size = len(keys) - width + 1, 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[:n], keys[width - size:width - size + n])


class Blocks:
    """Finds the blocks of texts; made once for a task."""

    def __init__(self):
        self.gram, self.byte = byte_table(31), byte_table(32)
        self.power = powers(BASE, PIECE + LENGTH)
        self.back = powers(pow(BASE, -1, 2 ** 64), PIECE + LENGTH)

    def find(self, raw: np.ndarray, at: np.ndarray):
        """(row, start in the buffer, starts, anchor, block hash) arrays, piece by piece."""
        for a in range(0, len(raw), PIECE):
            b = min(a + PIECE, len(raw))
            part = raw[a:b + LENGTH - 1]
            if len(part) < LENGTH:
                return
            h = gram_hashes(part, self.gram)
            place = np.arange(len(h), dtype=np.uint64)
            low = np.uint64(0xFFFFFF)
            first = (least_over((h & ~low) | place, SPAN) & low).astype(np.int64)
            starts = min(b - a, len(first))
            row = rows_of(at, a, a + starts)
            ok = np.flatnonzero(np.arange(a, a + starts) + LENGTH <= at[1:][row])
            if not len(ok):
                continue
            new = np.ones(len(ok), bool)
            new[1:] = (np.diff(ok) != 1) | (first[ok[1:]] != first[ok[:-1]])
            lo = ok[new]
            hi = ok[np.append(np.flatnonzero(new)[1:] - 1, len(ok) - 1)]
            anchor = first[lo]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.byte[part] * self.power[:len(part)], out=sums[1:])
            body = (sums[hi + LENGTH] - sums[lo]) * self.back[lo]
            body = mix(body + ((hi - lo) * 128 + (anchor - lo)).astype(np.uint64))
            yield row[lo], lo + a, hi - lo + 1, h[anchor].view(np.int64), body.view(np.int64)


def runs(row, lo, hi):
    """Merge spans [lo, hi) of the same row that touch; input in order."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    step = (row - row[0]) * (int(hi.max()) + 1)     # rows follow each other on one line
    reach = np.maximum.accumulate(hi + step)
    new = np.ones(len(row), bool)
    new[1:] = (lo + step)[1:] > reach[:-1]
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], lo[new], (reach - step)[ends]


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with more than about SHARD bytes of different blocks, in order, and their parts.

    One text in SAMPLE is looked at; at least two different blocks are seen of each.
    """
    none = np.zeros(0, np.int64)
    some = docs.where(F.pmod("digest", F.lit(SAMPLE)) == 0).dropDuplicates(["digest"])
    seen = instances(some, (none, none)).where(F.col("pack").bitwiseAND(F.lit(255)) > 0)
    least = max(2, -(-SHARD // (BLOCK * SAMPLE)))
    found = sorted(tuple(r) for r in seen.select("anchor", "block").distinct().groupBy(
        "anchor").count().where(F.col("count") >= least).collect())
    anchor, count = np.array(found, np.int64).reshape(-1, 2).T
    return anchor, np.maximum(2, -(-count * SAMPLE * BLOCK // SHARD))


def instances(docs: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Blocks of every document (``ROW``): the first of equal ones in a batch; the rest as spans.

    Documents are distinct by (doc, digest). ``pack`` holds start and number of starts; rows without
    starts are covered spans, their end in ``block``. ``part`` is from 1 on for the anchors that
    are there ``often``, else 0.
    """
    def run(batches):
        finder = Blocks()
        for batch in small(batches, 2, 1 << 24):
            raw, at = texts(batch.column(2))
            doc, digest = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            found = list(finder.find(raw, at))
            if not found:
                continue
            row, start, count, anchor, block = (np.concatenate(x) for x in zip(*found))
            start = start - at[row]
            pack = (start << 8) | count
            order = np.lexsort((pack, digest[row], doc[row], block, anchor))
            a, b = anchor[order], block[order]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            gone = order[~keep]
            r, lo, hi = runs(row[gone], start[gone], start[gone] + count[gone] - 1 + LENGTH)
            order = order[keep]
            part = np.zeros(len(order), np.int64)
            if len(often[0]):
                place = np.minimum(np.searchsorted(often[0], anchor[order]), len(often[0]) - 1)
                salt = mix(block[order].view(np.uint64)) % often[1][place].astype(np.uint64)
                part = np.where(often[0][place] == anchor[order], salt.astype(np.int64) + 1, 0)
            part = np.concatenate((part, np.zeros(len(r), np.int64))).astype(np.int32)
            columns = [np.concatenate(x) for x in (
                (anchor[order], mix((doc[r] ^ digest[r]).view(np.uint64)).view(np.int64)),
                (block[order], hi), (doc[row[order]], doc[r]), (digest[row[order]], digest[r]),
                (pack[order], lo << 8))]
            columns.insert(1, part)
            for i in range(0, len(part), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[i:i + 100_000]) for c in columns],
                    ["anchor", "part", "block", "doc", "digest", "pack"])

    return docs.mapInArrow(run, ROW)


def suffix_order(raw: np.ndarray) -> np.ndarray:
    """The suffix array of a shard, by Larsson-Sadakane refinement."""
    n = len(raw)
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i:i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1                                    # beyond the end
    line = key[order]
    new = np.concatenate(([True], line[1:] != line[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    rank[order] = np.repeat(begin, size)            # a group's number: where it begins
    open_ = np.repeat(size > 1, size)               # places of groups that are not sorted yet
    h = 8
    while open_.any():
        place = np.flatnonzero(open_)
        who = order[place]
        own, after = rank[who], rank[np.minimum(who + h, n)]
        inner = np.lexsort((after, own))
        who, own, after = who[inner], own[inner], after[inner]
        order[place] = who
        new = np.ones(len(who), bool)
        new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(who)))
        rank[who] = np.repeat(place[begin], size)
        open_[place] = np.repeat(size > 1, size)
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, begin: np.ndarray,
                    size: np.ndarray) -> np.ndarray:
    """Bytes (LENGTH at most) that each suffix shares with the one before it in order.

    Kasai's rule: from one place of a text to the next the length falls by one at most. The blocks
    of the shard are walked side by side, one place a step, each with its own running length.
    """
    n = len(raw)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    padded = np.concatenate((raw.astype(np.int16), np.full(1, -1, np.int16)))
    out = np.zeros(n, np.int64)
    length = np.zeros(len(begin), np.int64)
    live = np.arange(len(begin))
    for step in range(int(size.max(initial=0))):
        live = live[size[live] > step]
        here = begin[live] + step
        r = rank[here]
        before = order[np.maximum(r - 1, 0)]
        have = np.where(r > 0, length[live], 0)
        grow = np.flatnonzero((r > 0) & (have < LENGTH))
        while len(grow):
            i, j = here[grow] + have[grow], before[grow] + have[grow]
            same = (np.maximum(i, j) < n) & (padded[np.minimum(i, n)] == padded[np.minimum(j, n)])
            grow = grow[same]
            have[grow] += 1
            grow = grow[have[grow] < LENGTH]
        out[r] = have
        length[live] = np.maximum(have - 1, 0)
    return out


def equal_strings(raw: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Places where strings of LENGTH bytes start, in suffix order, and their class."""
    order = suffix_order(raw)
    shared = common_prefixes(raw, order, begin, size)
    classes = np.cumsum(shared < LENGTH)
    starts = np.zeros(len(raw), bool)
    for b, s in zip(begin.tolist(), size.tolist()):
        starts[b:b + s - LENGTH + 1] = True
    mine = starts[order]
    return order[mine], classes[mine]


class Shard:
    """Blocks with their bytes; gives each string's class and earliest start."""

    def __init__(self, parts, docs, digests, packs, bodies):
        size = np.array([len(b) for b in bodies], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        self.raw = np.frombuffer(b"".join(bodies), np.uint8)
        self.part, self.doc, self.digest = parts, docs, digests
        place, classes = equal_strings(self.raw, self.begin, size)
        which = np.searchsorted(self.begin, place, side="right") - 1
        at = (packs[which] >> 8) + place - self.begin[which]
        first = np.lexsort((at, digests[which], docs[which], classes))
        place, classes, which, at = place[first], classes[first], which[first], at[first]
        new = np.ones(len(place), bool)
        new[1:] = classes[1:] != classes[:-1]
        self.place, self.which, self.at, self.first = place, which, at, new.copy()
        self.lead = np.flatnonzero(new)

    def strings(self) -> np.ndarray:
        """The distinct strings, in suffix order."""
        windows = np.lib.stride_tricks.sliding_window_view(self.raw, LENGTH)[self.place[self.lead]]
        return np.ascontiguousarray(windows).view(f"S{LENGTH}").ravel()

    def earlier_in(self, other: "Shard", mine: np.ndarray, theirs: np.ndarray) -> None:
        """Strike out strings that start earlier in another shard, found by binary search."""
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        hit = np.flatnonzero(theirs[at] == mine)
        i, j = self.lead[hit], other.lead[at[hit]]
        w, v = self.which[i], other.which[j]
        d, e = self.doc[w], other.doc[v]
        f, g = self.digest[w], other.digest[v]
        late = (e < d) | ((e == d) & ((g < f) | ((g == f) & (other.at[j] < self.at[i]))))
        self.first[i[late]] = False

    def covered(self):
        """Spans of the strings that are not first: (doc, digest, start, end)."""
        gone = ~self.first
        row, lo, hi = runs(self.which[gone], self.at[gone], self.at[gone] + LENGTH)
        return self.doc[row], self.digest[row], lo, hi

    def unsettled(self):
        """First strings of frequent anchors: (doc, digest, start, end, two halves of a hash)."""
        mine = self.lead[self.first[self.lead] & (self.part[self.which[self.lead]] > 0)]
        w, lo, place = self.which[mine], self.at[mine], self.place[mine]
        raw = self.raw.tobytes()
        name = b"".join(hashlib.blake2b(raw[p:p + LENGTH], digest_size=16).digest()
                        for p in place.tolist())
        halves = np.frombuffer(name, np.int64).reshape(-1, 2)
        return self.doc[w], self.digest[w], lo, lo + LENGTH, halves[:, 0], halves[:, 1]


def search_shards(blocks: DataFrame) -> DataFrame:
    """(doc, digest, lo, hi, h1, h2, first) from blocks (anchor, part, doc, digest, pack, body).

    Spans of repeated strings, and the ``first`` strings of parts with their hash.
    """
    def group(parts):
        """One or more whole parts of anchors; several shards only if one part needs them."""
        columns = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        bodies = [b for p in parts for b in p[4]]
        ends = np.cumsum([len(b) for b in bodies])
        cuts = np.unique(np.searchsorted(ends, np.arange(1, ends[-1] // (2 * SHARD) + 1)
                                         * 2 * SHARD))
        edges = [0, *[c for c in cuts.tolist() if 0 < c < len(bodies)], len(bodies)]
        shards = [Shard(*(c[a:b] for c in columns), bodies[a:b])
                  for a, b in zip(edges[:-1], edges[1:])]
        if len(shards) > 1:
            strings = [s.strings() for s in shards]
            for i, s in enumerate(shards):
                for j, t in enumerate(shards):
                    if i != j:
                        s.earlier_in(t, strings[i], strings[j])
        for s in shards:
            doc, digest, lo, hi = s.covered()
            spread = mix((doc ^ digest).view(np.uint64)).view(np.int64)
            for first, columns in ((False, (doc, digest, lo, hi, spread, lo)),
                                   (True, s.unsettled())):
                for i in range(0, len(columns[0]), 100_000):
                    arrays = [pa.array(c[i:i + 100_000]) for c in columns]
                    yield pa.RecordBatch.from_arrays(
                        [*arrays, pa.array(np.full(len(arrays[0]), first))],
                        ["doc", "digest", "lo", "hi", "h1", "h2", "first"])

    def run(batches):
        parts, held, last = [], 0, None
        for batch in batches:
            anchor, part, *columns = (np.asarray(batch.column(i), np.int64) for i in range(5))
            bodies = batch.column(5).to_pylist()
            edges = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1])
                                                   | (part[1:] != part[:-1]))))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(anchor)]):
                if held >= SHARD and (anchor[a], part[a]) != last:
                    yield from group(parts)
                    parts, held = [], 0
                last = anchor[a], part[a]
                parts.append((part[a:b], *(c[a:b] for c in columns), bodies[a:b]))
                held += sum(map(len, bodies[a:b]))
        if parts:
            yield from group(parts)

    return blocks.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
        run, "doc bigint, digest bigint, lo bigint, hi bigint, h1 bigint, h2 bigint, "
             "first boolean")


def settled(found: DataFrame) -> DataFrame:
    """(doc, digest, lo, hi) of the strings that start earlier; ``found`` is as searched."""
    same = Window.partitionBy("first", "h1", "h2").orderBy("doc", "digest", "lo")
    # in one pass, as the shards would be searched again for another
    return found.withColumn("rank", F.rank().over(same)).where("not first or rank > 1").select(
        "doc", "digest", "lo", "hi")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   keep: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    With ``keep`` instead (text, row, n_removed), where ``text`` is what is left (a code point
    stays if any of its bytes does) and ``row`` holds the other columns.
    """
    given = carried(docs, key, text, keep)
    named = given.select(order_of(F.col("row").getField(key)).alias("doc"),
                         digest_of(F.col("text")).alias("digest"), "text", "row")
    # all that reads the texts takes the columns of this one exchange, so that they are shuffled
    # once; after dropDuplicates Spark would not see that blocks are made twice
    once = named.select("doc", "digest", "text").groupBy("doc", "digest").agg(
        F.min("text").alias("text"))
    often = frequent(named.select("doc", "digest", "text"))
    dealt = instances(once, often).repartition("anchor", "part")
    same = Window.partitionBy("anchor", "part", "block").orderBy("doc", "digest", "pack")
    group = Window.partitionBy("anchor", "part")
    judged = dealt.withColumn("rank", F.rank().over(same)).withColumn(
        "low", F.min("block").over(group)).withColumn("high", F.max("block").over(group))
    start = F.shiftrightunsigned("pack", 8)
    count = F.col("pack").bitwiseAND(F.lit(255))
    # a condition on ``part`` alone would go below the windows, and the blocks be made twice
    copies = judged.where((count == 0) | (F.col("rank") > 1)).select(
        "doc", "digest", start.alias("lo"),
        F.when(count == 0, F.col("block")).otherwise(start + count - 1 + LENGTH).alias("hi"))
    open_ = judged.where((count > 0) & F.expr("rank = 1 and (part > 0 or low < high)")).groupBy(
        "doc", "digest").agg(F.collect_list(F.struct("anchor", "part", "pack")).alias("list"))

    def bodies(batches):
        for batch in small(batches, 2):
            raw, at = texts(batch.column(2))
            lists = batch.column(3)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            anchor, part, pack = (np.asarray(flat.field(i)) for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            lo = at[row] + (pack >> 8)
            hi = lo + (pack & 255) - 1 + LENGTH
            doc, digest = (np.asarray(batch.column(i), np.int64)[row] for i in (0, 1))
            for i in range(0, len(row), 20_000):
                some = [raw[a:b].tobytes() for a, b in zip(lo[i:i + 20_000].tolist(),
                                                           hi[i:i + 20_000].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[i:i + 20_000]) for c in (anchor, part, doc, digest, pack)),
                     pa.array(some, pa.binary())],
                    ["anchor", "part", "doc", "digest", "pack", "body"])

    listed = once.join(open_, ["doc", "digest"]).select("doc", "digest", "text", "list")
    blocks = listed.mapInArrow(
        bodies, "anchor bigint, part int, doc bigint, digest bigint, pack bigint, body binary")
    spans = copies.union(settled(search_shards(blocks))).groupBy("doc", "digest").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches):
        for batch in small(batches, 2):
            raw, at = texts(batch.column(2))
            out = []
            for i, listed_ in enumerate(batch.column(3).to_pylist()):
                body = raw[at[i]:at[i + 1]]
                lo, hi = (np.array([s[c] for s in listed_ or ()], np.int64) for c in ("lo", "hi"))
                _, lo, hi = runs(np.zeros(len(lo), np.int64), lo, hi)
                stay = np.ones(len(body), bool)
                for a, b in zip(lo.tolist(), hi.tolist()):
                    stay[a:b] = False
                if keep:                        # whole code points
                    head = np.flatnonzero((body & 0xC0) != 0x80)
                    if len(lo) and len(head):
                        some = np.logical_or.reduceat(stay, head)
                        stay = np.repeat(some, np.diff(np.append(head, len(body))))
                    left = body[stay].tobytes().decode("utf-8", "ignore")
                else:
                    left = hashlib.sha256(body[stay].tobytes()).hexdigest()
                out.append((len(body), int((hi - lo).sum()), len(lo), left))
            columns = [pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64())
                       for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *columns],
                ["doc", "digest", "n_bytes", "n_removed", "n_spans", "left"])

    results = once.join(spans, ["doc", "digest"], "left").select(
        "doc", "digest", "text", "spans").mapInArrow(
        cut, "doc bigint, digest bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
             "left string")
    done = named.select("doc", "digest", "row").join(results.hint("merge"), ["doc", "digest"])
    if keep:
        return done.select(F.col("left").alias("text"), "row", "n_removed")
    return done.select(F.col("row").getField(key).alias(key), "n_bytes", "n_removed", "n_spans",
                       F.col("left").alias("kept_sha256"))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
