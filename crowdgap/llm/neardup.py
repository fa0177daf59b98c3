"""Near-duplicate documents by Order MinHash.

A text's k-mers are its shingles of five words, each labelled with its occurrence number. For each
of BANDS hash functions the PICKED smallest labelled k-mers are taken and kept in text order; their
combination is the band's key, so texts share a key if the same k-mers were picked in the same
order. If one word in forty is another, texts share none of 16 keys with a chance of about 1 in 5
million; at one in twenty it is 1 in 3,000, at one in nine, the limit, 1 in 13.

Similarity comes from a banded alignment of words: k-mers that both texts hold once are aligned by
the longest increasing run of their positions, among those whose positions differ by no more than
unmatched words allow; the words between aligned k-mers are aligned by their longest common
subsequence. Aligned words over all words of both must reach 0.8.

How the work is bounded:

* Equal texts are one text (by a 128-bit digest) from the start; copies only meet in a count.
* Texts that share a key are compared in blocks of BLOCK rows by small sketches of their words (a
  byte for each of BINS ranges of hash values); a larger group is more blocks on more tasks.
* Only pairs whose sketches allow 0.8 (3.5 standard deviations) and that nothing has linked yet
  are aligned, in their first common band, inside the task. A block emits a forest of links: fewer
  than it has rows, whatever the number of similar pairs.

Comparing sketches inside a group of similar but unequal texts costs the square of that group's
size (about 0.3 microseconds a pair); nothing is capped or dropped.

A class is named by the smallest key in it. Null texts count as empty; texts without a word are
like their exact copies only. Texts of fewer than five words are one shingle. Texts of five to
ten words have few shingles, and one change can part them. Rows with a null
key belong to the class of their text, and a class of null keys only is null. Rows that repeat a
key are told apart by their texts. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm.common import materialise, mix, powers, small, texts, words_of
from crowdgap.llm.registry import query, table

WORDS, SIMILAR = 5, 0.8
BANDS, PICKED = 16, 2
BINS, BLOCK = 512, 500
NO_TEXT = np.zeros(0, np.uint64)


def digest_of(text) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def shingles(marks: np.ndarray) -> np.ndarray:
    """Hashes of a text's shingles, in text order."""
    if not len(marks):
        return NO_TEXT
    k = min(WORDS, len(marks))
    n = len(marks) - k + 1
    weight = powers(0xD6E8FEB86659FD93, WORDS)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += marks[i:i + n] * weight[i]
    return mix(h)


def grams(marks: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingles of a text's word hashes, in text order."""
    return numbered(shingles(marks))


def single(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a text holds once, ascending, and where."""
    h, at, count = np.unique(shingles(line.astype(np.uint64)), return_index=True, return_counts=True)
    return h[count == 1], at[count == 1]


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes with their occurrence number mixed in, so that each is there once."""
    order = np.argsort(h, kind="stable")
    line = h[order]
    same = line[1:] == line[:-1]
    if same.any():
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        number = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        label = np.empty(len(h), np.uint64)
        label[order] = number
        h = mix(h + label * np.uint64(0xA0761D6478BD642F))
    return h


def short(marks: np.ndarray) -> np.ndarray:
    """Word hashes in four bytes each."""
    return (marks >> np.uint64(32)).astype(np.uint32)


def each_text(column):
    """The word hashes of each text of an Arrow column."""
    raw, at = texts(column)
    doc, marks, _ = words_of(raw, at)
    edges = np.searchsorted(doc, np.arange(len(at)))
    return [marks[a:b] for a, b in zip(edges[:-1], edges[1:])]


FACTORS = powers(0x9FB21C651E98DF25, BANDS + 1)[1:]
SHIFTS = powers(0xC2B2AE3D27D4EB4F, BANDS + 1)[1:]


def band_keys(h: np.ndarray) -> np.ndarray:
    """The Order MinHash key of each band."""
    count = min(PICKED, len(h))
    picked = np.empty((BANDS, count), np.int64)
    step = BANDS if len(h) < 50_000 else 1
    for i in range(0, BANDS, step):
        order = (h[None, :] ^ SHIFTS[i:i + step, None]) * FACTORS[i:i + step, None]
        order ^= order >> np.uint64(32)
        if len(h) > count:
            for j in range(count):              # hashes differ, so the smallest is one place
                at = picked[i:i + step, j] = order.argmin(axis=1)
                order[np.arange(len(at)), at] = np.uint64(2 ** 64 - 1)
        else:
            picked[i:i + step] = np.arange(count)
    picked.sort(axis=1)                     # text order
    weight = powers(0xE7037ED1A0B428DB, PICKED + 1)[1:]
    key = (h[picked] * weight[None, :count]).sum(axis=1, dtype=np.uint64)
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def sketch(h: np.ndarray) -> np.ndarray:
    """For each range of hash values a byte of its smallest member, and 0 where it has none."""
    line = np.sort(h)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    at = np.searchsorted(line, edges)
    ends = np.append(at[1:], len(line))
    out = np.zeros(BINS, np.uint8)
    some = at < ends
    out[some] = (line[at[some]] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, digest, keys) of every row; keys are null without a word."""
    def run(batches):
        for batch in small(batches, 2):
            lines = map(grams, each_text(batch.column(2)))
            keys = [band_keys(h).view(np.int64).tolist() if len(h) else None for h in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))],
                ["k", "digest", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), digest_of(F.col(text)).alias("digest"), F.col(text)).mapInArrow(
        run, f"k {kind}, digest binary, keys array<bigint>")


def details(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(digest, keys, sketch, line) of the texts with wanted digests.

    ``line`` holds the words in text order, four bytes each.
    """
    def run(batches):
        for batch in small(batches, 1):
            keys, bits, lines = [], [], []
            for marks in each_text(batch.column(1)):
                keys.append(band_keys(grams(marks)).tobytes())
                bits.append(sketch(numbered(marks)).tobytes())
                lines.append(short(marks).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.binary()) for x in (keys, bits, lines))],
                ["digest", "keys", "sketch", "line"])

    named = docs.select(digest_of(F.col(text)).alias("digest"), F.col(text).alias("text"))
    found = named.join(wanted.hint("merge"), "digest")      # as many rows as there are members
    return found.mapInArrow(run, "digest binary, keys binary, sketch binary, line binary")


def allowed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sketches allow 0.8 between one and each of many; ``sizes`` are words of both.

    A sketch is a sample without replacement of the labelled words of both texts. Aligned words are
    common to both, so their share in any order is no less.
    """
    bins = np.maximum(((b != 0) | (a != 0)[None, :]).sum(1), 1)
    same = ((a[None, :] == b) & (b != 0)).sum(1) / bins
    unseen = np.maximum(1 - bins / np.maximum(sizes / (1 + SIMILAR), 1), 0)
    margin = 3.5 * np.sqrt(SIMILAR * (1 - SIMILAR) / bins * unseen) + 1 / bins + 0.01
    return same >= SIMILAR - margin


class Group:
    """Texts of one group of a band; finds links between them."""

    def __init__(self, keys, bits, lines, side, band, both):
        self.keys, self.bits, self.side, self.band, self.both = keys, bits, side, band, both
        self.lines = [np.frombuffer(x, np.uint32) for x in lines]
        self.n = np.array([len(x) for x in self.lines])
        self.marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def similarity(self, i: int, j: int) -> float:
        for x in (i, j):
            if x not in self.marks:
                self.marks[x] = single(self.lines[x])
        return similarity(self.lines[i], self.lines[j], self.marks[i], self.marks[j])

    def links(self):
        """Pairs of rows of 0.8 or more that join all rows which such pairs join."""
        n, root = self.n, np.arange(len(self.n))
        for i in range(len(n) - 1):
            rest = np.arange(i + 1, len(n))
            rest = rest[(np.minimum(n[i], n[rest]) >= SIMILAR * np.maximum(n[i], n[rest]))
                        & (root[rest] != root[i])]
            if self.both:                   # pairs of one side belong to that side's own block
                rest = rest[self.side[rest] != self.side[i]]
            if self.band and len(rest):     # not the first band that they share
                rest = rest[~(self.keys[i, :self.band] == self.keys[rest, :self.band]).any(1)]
            if not len(rest):
                continue
            near = rest[allowed(self.bits[i], self.bits[rest], n[i] + n[rest])]
            for j in near.tolist():
                if root[i] != root[j] and self.similarity(i, j) >= SIMILAR:
                    root[root == root[j]] = root[i]
                    yield i, j


def links_of(one: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(a, b): links of digests with 0.8 or more that span every class."""
    lines = one.where(F.col("keys").isNotNull()).select(
        "digest", F.posexplode("keys").alias("band", "key"))
    sizes = lines.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(lines.join(sizes, ["band", "key"]), "members")
    wanted = members.select("digest").distinct()
    detail = materialise(details(docs, wanted, text).dropDuplicates(["digest"]), "details")
    # blocks of a large group: each row meets every block, once as left and once as right
    placed = (members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
              .withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .join(detail, "digest")
              .select("band", "key", F.least("own", "other").alias("x"),
                      F.greatest("own", "other").alias("y"), "own", "digest", "keys", "sketch",
                      "line"))
    group = ["band", "key", "x", "y"]

    def run(batches):
        held = None
        for batch in chain_end(batches):
            if batch is None:
                whole, rest = held, None
            else:
                whole = batch if held is None else pa.concat_tables([held, batch])
                cut = last_group(whole, group)
                whole, rest = whole.slice(0, cut), whole.slice(cut)
            held = rest
            if whole is not None and whole.num_rows:
                yield from links_in(whole.combine_chunks(), group)

    return placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        run, "a binary, b binary")


def chain_end(batches):
    """The batches as tables, then None."""
    for batch in batches:
        yield pa.Table.from_batches([batch])
    yield None


def group_edges(t: pa.Table, group: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in group:
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def last_group(t: pa.Table, group: list[str]) -> int:
    """Where the last group, which may go on, begins."""
    edges = group_edges(t, group)
    return int(edges[-1]) if len(edges) else 0


def links_in(t: pa.Table, group: list[str]):
    """Record batches of the links of a table of whole groups."""
    edges = np.append(group_edges(t, group), t.num_rows)
    digests, lines = t.column("digest").to_pylist(), t.column("line").to_pylist()
    bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
    keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
    side, band = t.column("own").to_numpy(), t.column("band").to_numpy()
    both = t.column("x").to_numpy() != t.column("y").to_numpy()
    found = [(digests[lo + i], digests[lo + j]) for lo, hi in zip(edges[:-1], edges[1:])
             for i, j in Group(keys[lo:hi], bits[lo:hi], lines[lo:hi], side[lo:hi],
                               int(band[lo]), bool(both[lo])).links()]
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()),
                                      pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def increasing(values: np.ndarray) -> np.ndarray:
    """Places of a longest increasing run (not contiguous) of distinct values."""
    if len(values) < 2 or (np.diff(values) > 0).all():
        return np.arange(len(values))
    tails: list[int] = []
    places: list[int] = []
    before = np.full(len(values), -1)
    for at, v in enumerate(values.tolist()):
        i = bisect_left(tails, v)
        before[at] = places[i - 1] if i else -1
        tails[i:i + 1] = [v]
        places[i:i + 1] = [at]
    out = [places[-1]]
    while before[out[-1]] >= 0:
        out.append(before[out[-1]])
    return np.array(out[::-1])


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; a bit for each member of ``b``."""
    if not a or not b:
        return 0
    where: dict[int, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    open_ = full                            # a cleared bit is one step of the length
    for w in a:
        if w in where:
            met = open_ & where[w]
            open_ = ((open_ + met) | (open_ - met)) & full
    return len(b) - open_.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, x, y) -> float:
    """Aligned words over all words of both; ``x`` and ``y`` are their ``single`` shingles.

    Less than 0.8 is a lower bound: alignment ends where 0.8 is out of reach.
    """
    total = len(a) + len(b)
    need = 2 * SIMILAR / (1 + SIMILAR) * total / 2
    free = int(total - 2 * need) + 1        # words without a partner; a position shifts by no more
    _, of_a, of_b = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    i, j = x[1][of_a], y[1][of_b]
    order = np.argsort(i)
    order = order[np.abs(i - j)[order] <= free]
    order = order[increasing(j[order])]
    i, j = i[order], j[order]
    size = min(WORDS, len(a), len(b))
    # runs of one shift cover the words of their shingles; where two runs overlap, the later gives way
    runs = np.flatnonzero(np.diff(j - i, prepend=j[:1] - i[:1] - 1) | (np.diff(i, prepend=-9) > size)
                          ) if len(i) else i
    m, gaps, p, q = 0, [], 0, 0
    for lo, hi in zip(runs, np.append(runs[1:], len(i))):
        skip = max(p - int(i[lo]), q - int(j[lo]), 0)
        first, then, end = int(i[lo]) + skip, int(j[lo]) + skip, int(i[hi - 1]) + size
        if first >= end:
            continue
        gaps.append((p, first, q, then))
        m += end - first
        p, q = end, then + end - first
    gaps.append((p, len(a), q, len(b)))
    left = sum(min(d - c, f - e) for c, d, e, f in gaps)
    for c, d, e, f in gaps:
        if m + left < need:
            break
        left -= min(d - c, f - e)
        m += common(a[c:d].tolist(), b[e:f].tolist())
    return m / (total - m)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, by alternating large and small stars."""
    links = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "links")
    last = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"),
                                                             F.col("m").alias("v"))
        links = materialise(small.union(down.select("u", "m")).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
        last = state


def labels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, label): a digest that names the class of each distinct text."""
    sigs = materialise(signatures(docs, key, text), "signatures")
    one = sigs.groupBy("digest").agg(F.min("k").alias("k"), F.any_value("keys").alias("keys"))
    found = components(links_of(one, docs, text)).withColumnRenamed("node", "digest")
    return one.select("digest").join(found, "digest", "left").select(
        "digest", F.coalesce("label", "digest").alias("label"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, class_id) for every row."""
    sigs = materialise(signatures(docs, key, text), "signatures")
    one = sigs.groupBy("digest").agg(F.min("k").alias("k"), F.any_value("keys").alias("keys"))
    found = components(links_of(one, docs, text))
    named = one.select("digest", "k").join(
        found.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "label", F.coalesce("label", "digest"))
    smallest = named.groupBy("label").agg(F.min("k").alias("class_id"))
    of_text = named.join(smallest, "label").select("digest", "class_id")
    return sigs.select(F.col("k").alias(key), "digest").join(of_text, "digest").select(
        key, "digest", "class_id")


def keepers(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(kept_id, kept_digest): one text of each class, the one with the class's name.

    Texts that only rows without a key have are kept each.
    """
    named = found.where(F.col(key).eqNullSafe(F.col("class_id")))
    keyed = named.where(F.col(key).isNotNull()).groupBy("class_id").agg(
        F.min("digest").alias("kept_digest"))
    unkeyed = named.where(F.col(key).isNull()).select("class_id", F.col("digest").alias("kept_digest"))
    return keyed.unionByName(unkeyed.distinct()).withColumnRenamed("class_id", "kept_id")


@query("op9_order_minhash")
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
