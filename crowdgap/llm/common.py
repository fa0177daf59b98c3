"""Helpers shared by the operators: Arrow text buffers, byte hashes, shared tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdgap.session import materialise

__all__ = ["materialise", "texts", "mix", "byte_table", "powers", "code_points", "text_digest", "in_fold", "small",
           "starts_of", "hash_share"]


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one UTF-8 byte array and row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset:]
    if data is None or at[-1] == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8, count=int(at[-1]))[int(at[0]):]
    return raw, at - at[0]


def small(batches, column: int, limit: int = 1 << 22):
    """Cut record batches so that each has about ``limit`` bytes of text, or one row.

    The arrays that a task makes of a text are many times its size.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        part = np.cumsum(np.asarray(size, np.int64)) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value, the same on every machine."""
    shift = seed * 0xD1B54A32D192ED03 % 2 ** 64
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(shift))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.full(max(n, 1), base % 2 ** 64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Offsets of pieces with these sizes."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def text_digest(text) -> Column:
    """A 128-bit name for equal texts; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def in_fold(key, folds: int, fold: int) -> Column:
    """Whether ``crc32(key as text) mod folds`` is ``fold``; a null key counts as text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def hash_share(key, share: float) -> Column:
    """Keeps about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1_000_000)) < int(share * 1_000_000)




PIECE = 1 << 21
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\r\n\x0b\x0c")] = True


def byte_pieces(raw: np.ndarray):
    """(start, end) of pieces of at most PIECE bytes that end at a blank where there is one."""
    a = 0
    while a < len(raw):
        b = min(a + PIECE, len(raw))
        if b < len(raw):
            gaps = np.flatnonzero(BLANK[raw[b - PIECE // 2:b]])
            b = b - PIECE // 2 + int(gaps[-1]) + 1 if len(gaps) else b
        yield a, b
        a = b


def rows_of(at: np.ndarray, a: int, b: int) -> np.ndarray:
    """Row number of each byte from ``a`` to ``b``."""
    inside = np.minimum(at[1:], b) - np.maximum(at[:-1], a)
    return np.repeat(np.arange(len(at) - 1), np.clip(inside, 0, None))


def words_of(raw: np.ndarray, at: np.ndarray, seed: int = 21
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash and size in bytes of every blank-separated word, in order.

    A word without a blank in it for longer than a piece counts as several words.
    """
    hashes = np.where(BLANK, np.uint64(0), byte_table(seed))
    power = powers(0x9E3779B97F4A7C15, PIECE + 1)
    begins, marks, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in byte_pieces(raw):
        piece = raw[a:b]
        solid = ~BLANK[piece]
        first = np.ones(len(piece), bool)       # a blank or another text before it
        first[1:] = ~solid[:-1]
        first[at[(at >= a) & (at < b)] - a] = True
        begin = np.flatnonzero(solid & first)
        if not len(begin):
            continue
        last = np.ones(len(piece), bool)        # a blank or another text after it
        last[:-1] = first[1:] | ~solid[1:]
        size = np.flatnonzero(solid & last) - begin + 1
        edges = np.concatenate(([0], begin, [len(piece)]))
        place = np.arange(len(piece)) - np.repeat(edges[:-1], np.diff(edges))
        weighted = hashes[piece]                # blanks count nothing
        weighted *= power[place]
        begins.append(begin + a)
        marks.append(mix(np.add.reduceat(weighted, begin) + size.astype(np.uint64)))
        sizes.append(size)
    begin = np.concatenate(begins)
    return (np.searchsorted(at, begin, side="right") - 1, np.concatenate(marks),
            np.concatenate(sizes))


def carried(docs: DataFrame, key: str, text: str, keep: bool) -> DataFrame:
    """(text, row): the text, and the key or (``keep``) all other columns in one struct.

    Columns of any name can so travel with an operator's own.
    """
    others = [c for c in docs.columns if c != text] if keep else [key]
    return docs.select(F.col(text).alias("text"), F.struct(*others).alias("row"))


def restored(columns: list[str], text: str, value=None) -> list[Column]:
    """The columns of a carried table again, with a new text if ``value`` is one."""
    value = F.col("text") if value is None else value
    return [value.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns]


def attach(rows: DataFrame, values: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``values``: one row for each key, and its number of rows ``n``.

    Keys that have more than one in ``share`` of all rows, fewer than ``share`` of them, are
    broadcast and their rows stay where they are; all other rows are joined by shuffle. Null keys
    are keys like others. Both tables are read twice, so they should be written ones.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    named = values.withColumnRenamed(key, "__key").drop("n")
    heavy = values["n"] * share > total
    hot, cold = named.where(heavy), named.where(~heavy)
    same = rows[key].eqNullSafe(F.col("__key"))
    rest = rows.join(F.broadcast(hot.select("__key")), same, "left_anti")
    return (rows.join(F.broadcast(hot), same)
            .unionByName(rest.join(cold, rest[key].eqNullSafe(F.col("__key")))).drop("__key"))
