"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes proposes boundaries; normalised chunking asks for a rarer
pattern before the wanted size and a commoner one after it, between a least and a largest size. A
text's fingerprint is the set of its chunks' 48-bit digests with their lengths in bytes, so an
insertion changes only the chunks it touches. Likeness is containment weighted by length: the
bytes of common chunks over the smaller set's bytes.

Null counts as the empty text; an empty text has the empty fingerprint, which is like itself (1)
and unlike any other (0). Very long texts are hashed in pieces of 1 MB. Other columns are ignored,
repeated rows are kept.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm.common import byte_table, mix, powers
from crowdgap.llm.registry import query, table
from crowdgap.session import parallelism

WINDOW = 16
LEAST, WANTED, LARGEST = 16, 64, 256
# Patterns of the hash's high bits: 1 in 128 before the wanted size, 1 in 32 after it.
RARE, COMMON = np.uint32(0xFE000000), np.uint32(0xF8000000)
PIECE = 1 << 20
LOWEST = -(2 ** 63)


class Chunker:
    """The tables that a task needs, made once."""

    def __init__(self):
        self.gear = (byte_table(11) >> np.uint64(32)).astype(np.uint32)
        self.bytes = byte_table(12)
        self.power = powers(0x9E3779B97F4A7C15, LARGEST)

    def candidates(self, raw: np.ndarray, start: int) -> tuple[list, list]:
        """Places after ``start`` where a chunk may end, and whether by the rarer pattern."""
        at, rare = [], []
        for a in range(start, len(raw), PIECE):
            low = max(0, a - WINDOW + 1)
            h = self.gear[raw[low:a + PIECE]]
            for shift in (1, 2, 4, 8):
                nxt = h.copy()
                nxt[shift:] += h[:-shift] << np.uint32(shift)
                h = nxt
            h = h[a - low:]
            found = np.flatnonzero((h & COMMON) == 0)
            at += (found + (a + 1)).tolist()
            rare += ((h[found] & RARE) == 0).tolist()
        return at, rare

    def cuts(self, raw: np.ndarray, start: int = 0) -> list[int]:
        """Ends of the chunks from ``start`` on."""
        n = len(raw)
        at, rare = self.candidates(raw, start)
        at.append(n + LARGEST)              # so that the search always ends
        rare.append(True)
        ends, i = [], 0
        while start < n:
            least, wanted, last = start + LEAST, start + WANTED, min(start + LARGEST, n)
            while at[i] < least:
                i += 1
            while at[i] < wanted and not rare[i]:
                i += 1
            start = at[i] if at[i] < last else last
            ends.append(start)
        return ends

    def digests(self, raw: np.ndarray, start: int, ends: np.ndarray) -> np.ndarray:
        """Digest and length of each chunk in one number: 48 and 16 bits."""
        if not len(ends):
            return np.zeros(0, np.uint64)
        begins = np.concatenate(([start], ends[:-1]))
        out = np.empty(len(ends), np.uint64)
        step = PIECE // LARGEST
        for i in range(0, len(ends), step):
            b, e = begins[i:i + step], ends[i:i + step]
            size = e - b
            place = np.arange(b[0], e[-1]) - np.repeat(b, size)
            weighted = self.bytes[raw[b[0]:e[-1]]] * self.power[place]
            h = mix(np.add.reduceat(weighted, b - b[0]) + size.astype(np.uint64))
            out[i:i + step] = (h & np.uint64(0xFFFFFFFFFFFF0000)) | size.astype(np.uint64)
        return out

    def chunks(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and digests, in text order."""
        ends = np.array(self.cuts(raw), np.int64)
        return ends, self.digests(raw, 0, ends)

    def after_edit(self, ends: np.ndarray, digests: np.ndarray, kept: int,
                   raw: np.ndarray) -> np.ndarray:
        """Digests of a text that shares its first ``kept`` bytes with a chunked one."""
        same = int(np.searchsorted(ends, kept, side="right"))
        if same == len(ends) and same:
            same -= 1                       # the last chunk may have ended with the text only
        start = int(ends[same - 1]) if same else 0
        rest = self.digests(raw, start, np.array(self.cuts(raw, start), np.int64))
        return np.concatenate((digests[:same], rest))


def printed(marks: np.ndarray) -> str:
    return marks.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of two sets of marks (sorted, distinct), weighted by length."""
    size = np.uint64(0xFFFF)
    less = min(int((a & size).sum()), int((b & size).sum()))
    if not less:
        return 1.0 if not len(a) and not len(b) else 0.0
    return min(1.0, int((np.intersect1d(a, b, assume_unique=True) & size).sum()) / less)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint): 16 hexadecimal digits for each distinct chunk, in order."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        chunker = Chunker()
        for batch in batches:
            marks = [printed(np.unique(chunker.chunks(np.frombuffer(
                (t or "").encode(), np.uint8))[1])) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())],
                                             [key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds (descending) that are above the value, found in two short steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    above = lambda b: b > value
    lit = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    coarse = F.size(F.filter(lit(bounds[step - 1::step]), above)) * step
    return coarse + F.size(F.filter(F.slice(lit(bounds), coarse + 1, F.lit(step)), above))


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt into ranges of descending (key, hash of text), each with the row that follows it.

    Keys that fill several ranges, null included, show as repeated quantiles; their rows are dealt
    by hash to as many ranges and one more. Columns: bucket, extra (the row belongs to the next range), o (the key, null as the lowest), h,
    key, text. Only one row for each range is known to the driver, and no text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key), F.col(text)).withColumn(
        "o", F.coalesce(F.col(key).cast("bigint"), F.lit(LOWEST))).withColumn(
        "h", F.xxhash64(F.col(text)))
    n = 4 * parallelism(spark)
    cut = Counter(int(x) for x in rows.select(F.col("o").cast("double").alias("k")).approxQuantile(
        "k", [i / n for i in range(1, n)], 0.1 / n))
    bucket = bucket_of(F.col("o"), sorted(cut, reverse=True))
    # keys that a double can't hold may share a quantile; they are not split
    ways = {x: many + 1 for x, many in cut.items() if many > 1 and (abs(x) < 2 ** 53 or x == LOWEST)}
    if ways:
        # the range of a key holds larger keys too: these are part 0, the key's own follow by hash
        way = F.try_element_at(F.create_map(*[F.lit(x) for pair in ways.items() for x in pair]), F.col("o"))
        part = F.floor((F.lit(0.5) - F.col("h") / F.lit(2.0 ** 64)) * way)
        part = F.coalesce(F.least(part, way - 1) + 1, F.lit(0)).cast("int")
        bucket = bucket * (max(ways.values()) + 1) + part
    rows = rows.withColumn("bucket", bucket).withColumn("extra", F.lit(False))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("o", "h")).alias("head")).collect()
    heads.sort(key=lambda r: r.bucket)
    if not heads:
        return rows
    before = [(heads[i - 1].bucket, r.head.o, r.head.h) for i, r in enumerate(heads)]
    before = spark.createDataFrame(before, "into int, o bigint, h bigint")
    extra = rows.join(F.broadcast(before), ["o", "h"]).select(
        key, text, "o", "h", F.col("into").alias("bucket"), F.lit(True).alias("extra"))
    return rows.unionByName(extra)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness.

    The edit replaces the last third of the code points by the start of the next document in
    descending order of key (after the last: the first); rows of equal key are ordered by a hash
    of their text, null keys come last.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    dealt = followed(docs, key, text).repartition(parallelism(spark), "bucket").sortWithinPartitions(
        "bucket", "extra", F.desc("o"), F.desc("h"))

    def run(batches):
        chunker, held, out = Chunker(), None, []

        def emit(this, following):
            doc, words, ends, digests, marks, _ = this
            cut = len(words) - len(words) // 3
            kept = words[:cut].encode("utf-8", "surrogatepass")
            edit = kept + following[1][:len(words) - cut].encode("utf-8", "surrogatepass")
            new = np.unique(chunker.after_edit(ends, digests, len(kept),
                                               np.frombuffer(edit, np.uint8)))
            out.append((doc, len(words), hashlib.sha256(edit).hexdigest(), printed(marks),
                        printed(new), likeness(marks, new), likeness(marks, following[4])))

        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                 "near_edited", "near_next"]
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                 pa.float64()]
        for batch in batches:
            kinds[0] = batch.column(0).type
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for doc, words, bucket, extra in rows:
                words = words or ""
                ends, digests = chunker.chunks(np.frombuffer(words.encode(), np.uint8))
                now = (doc, words, ends, digests, np.unique(digests), bucket)
                if held is not None and held[5] == bucket:
                    emit(held, now)
                held = None if extra else now
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return dealt.select(key, text, "bucket", "extra").mapInArrow(
        run, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
