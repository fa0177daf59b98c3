"""Near-duplicate documents by SimHash, with pivot distance tables.

A text's shingles are its runs of four words (a shorter text is one shingle); a bit of its 64-bit
fingerprint is set where more than half of the shingles' XXH64 values have it. Texts are linked
where their fingerprints differ in at most NEAR bits, and a component is named by its smallest key.

Pairs come from pigeonholes and are decided by a pivot table:

* A fingerprint is cut into blocks. Fingerprints that differ in NEAR bits or fewer agree in all
  blocks but NEAR, so every near pair shares the bits of one choice of blocks. The number of blocks
  grows with the number of distinct fingerprints (``cuts``); no choice of it loses a pair.
* Rows that share such a key get a table of Hamming distances to PIVOTS reference fingerprints.
  Near fingerprints differ by at most NEAR in every column. Rows sorted by the first column meet
  only rows in its window; the other columns discard pairs one after another by their difference,
  and what survives all of them is verified by its bits.

The table alone could not choose the pairs: distances of unrelated 64-bit words to a pivot are
32 +- 4, so one column keeps 57 of 100 unrelated pairs.

How the work is bounded:

* Equal fingerprints are one row from the start, so copies meet in a count only.
* A group of more than BLOCK rows is dealt to blocks, and each pair of its blocks is a task of its
  own with rows of 8 bytes; each block gives links that join what is joined in it (no pair of rows
  that are already joined is looked at again), fewer than rows times their logarithm.
* Results return to the rows by a join; fingerprints with more than a thousandth of all rows, of
  which there are fewer than a thousand, by broadcast.

Null texts count as empty. Texts without a word have fingerprint zero and are linked like others.
Rows with a null key belong to the component of their text; a component of null keys only is null.
Rows that repeat a key are separate rows. Texts are read in pieces cut between words, whatever
their length. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm.common import attach, materialise, mix, small, texts
from crowdgap.llm.neardup import chain_end, components, group_edges, last_group
from crowdgap.llm.registry import query, table

WORDS, SEED, BITS, NEAR = 4, 42, 64, 4
PIVOTS = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BLOCK = 50_000
PIECE = 1 << 20
BLANKS = b" \t\n\r\x0b\x0c"


def word_pieces(text: bytes):
    """Lists of words of about PIECE bytes of text; no word is cut."""
    a = 0
    while a < len(text):
        b = a + PIECE
        if b < len(text):
            step = 0
            while b < len(text) and text[b] not in BLANKS:
                step += 1
                if step % 4096 == 0:        # a very long word: look for each blank at once
                    ends = [i for i in (text.find(c, b) for c in map(bytes, zip(BLANKS))) if i >= 0]
                    b = min(ends, default=len(text))
                else:
                    b += 1
        yield text[a:b].lower().split()
        a = b


def shingle_hashes(text: bytes):
    """Arrays of the XXH64 values of a text's shingles, in order."""
    held: list[bytes] = []
    seen = False
    for words in word_pieces(text):
        held += words
        if len(held) < WORDS:
            continue
        line = b" ".join(held)
        size = np.fromiter(map(len, held), np.int64, len(held))
        end = np.cumsum(size + 1) - 1
        spans = zip((end - size)[:len(held) - WORDS + 1].tolist(), end[WORDS - 1:].tolist())
        digest = xxhash.xxh64_intdigest
        yield np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64,
                          len(held) - WORDS + 1)
        held, seen = held[len(held) - WORDS + 1:], True
    if held and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's shingles, as an unsigned number."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for h in shingle_hashes(text):
        n += len(h)
        for i in range(0, len(h), 1 << 14):
            part = h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, fp) of every row; ``fp`` holds the 64 bits of the fingerprint."""
    def run(batches):
        for batch in small(batches, 1):
            raw, at = texts(batch.column(1))
            found = [fingerprint(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"k {kind}, fp bigint")


def cuts(rows: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks for so many distinct fingerprints.

    More blocks are more keys for each row but smaller groups: a row's copy costs about as much as
    a hundred pairs.
    """
    def cost(n: int) -> float:
        return comb(n, NEAR) * (1 + .01 * rows / 2 ** (BITS * (n - NEAR) / n))

    n = min(range(NEAR + 1, 13), key=cost)
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def pigeonholes(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    """The keys of a fingerprint: the bits of every choice of all blocks but NEAR."""
    keys = []
    for i, chosen in enumerate(combinations(blocks, len(blocks) - NEAR)):
        mask = sum(((1 << width) - 1) << low for low, width in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints, a row for each of them."""
    return np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give what links join the same (smallest) root."""
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low < high
        if not open_.any():
            return
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root[:] = up
        a, b = a[open_], b[open_]


def near_pairs(group: np.ndarray, fp: np.ndarray, side: np.ndarray | None = None):
    """Links between rows of equal ``group`` (rising numbers) that join all that near pairs join.

    With ``side`` only pairs of different sides count. Yields arrays of row numbers (a, b).
    """
    table = pivot_table(fp)
    order = np.lexsort((table[0], group))
    group, table, bits = group[order], table[:, order], fp[order]
    side = None if side is None else side[order]
    n, root = len(fp), np.arange(len(fp))
    last = np.searchsorted(group, group, side="right")     # end of each row's group
    live, gap = np.arange(n), 0
    while True:
        gap += 1
        live = live[live + gap < last[live]]
        live = live[table[0, live + gap] - table[0, live] <= NEAR]
        if not len(live):
            return
        if gap % 64 == 0:          # groups that are one component need no more pairs
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            lone = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
            live = live[~np.repeat(lone, np.diff(np.append(first, n)))[live]]
        a, b = live, live + gap
        keep = root[a] != root[b]
        if side is not None:
            keep &= side[a] != side[b]
        a, b = a[keep], b[keep]
        for column in table[1:]:
            if not len(a):
                break
            keep = np.abs(column[a] - column[b]) <= NEAR
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(bits[a] ^ bits[b]) <= NEAR
        a, b = a[keep], b[keep]
        if len(a):
            merge(root, a, b)
            yield order[a], order[b]


def links_of(distinct: DataFrame, rows: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links of fingerprints that join every component."""
    keyed = distinct.select("fp", F.inline(pigeonholes(F.col("fp"), cuts(rows))))
    names = ["choice", "bits"]
    # at most keys / block rows
    large = materialise(keyed.groupBy(*names).agg(F.count("*").alias("size"))
                        .where(F.col("size") > block), "large")
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int")
    placed = (keyed.join(large, names, "left").withColumn("blocks", blocks)
              .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(*names, F.least("own", "other").alias("x"),
                      F.greatest("own", "other").alias("y"), "own", "fp"))
    group = [*names, "x", "y"]

    def run(batches):
        held = None
        for batch in chain_end(batches):
            whole = held if batch is None else (
                batch if held is None else pa.concat_tables([held, batch]))
            held = None
            if batch is not None:
                cut = last_group(whole, group)
                whole, held = whole.slice(0, cut), whole.slice(cut)
            if whole is not None and whole.num_rows:
                yield from linked(whole, group)

    return placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        run, "a bigint, b bigint")


def linked(t: pa.Table, group: list[str]):
    """Record batches of the links in a table of whole groups."""
    edges = np.append(group_edges(t, group), t.num_rows)
    sizes = np.diff(edges)
    number = np.repeat(np.arange(len(sizes)), sizes)
    fp = t.column("fp").to_numpy().view(np.uint64)
    two = np.repeat(sizes > 1, sizes)
    split = t.column("x").to_numpy() != t.column("y").to_numpy()
    own = t.column("own").to_numpy()
    for some, side in ((two & ~split, None), (two & split, own)):
        at = np.flatnonzero(some)
        for a, b in near_pairs(number[at], fp[at], None if side is None else side[at]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[at[a]].view(np.int64)), pa.array(fp[at[b]].view(np.int64))], ["a", "b"])


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row."""
    prints = materialise(fingerprints(docs, key, text), "simhash")
    one = materialise(prints.groupBy("fp").agg(F.min("k").alias("k"), F.count("*").alias("n")),
                      "distinct")
    found = components(links_of(one, one.count()))
    named = one.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("k").alias("component_id"))
    of_print = materialise(named.join(smallest, "label").select("fp", "n", "component_id"), "of")
    return attach(prints, of_print, "fp").select(F.col("k").alias(key), "fp", "component_id")


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
