"""Language identification with a string kernel.

The kernel compares which byte n-grams (lengths 1 to 3, a blended spectrum) two texts hold:
common ones over the geometric mean of both counts. Letters are folded to lower case (ASCII and
Latin-1), other ASCII characters count as one blank. Nystroem landmarks, some texts of each
language, span the space; n-grams that no landmark holds are not counted. One-versus-rest kernel
ridge regression is fitted on the kernel values against the landmarks, every language with the same
weight. A text's scores are a matrix product: its presence vector times (landmark presence times
ridge weights), made once. The score is the best language's, as a share of 1, times the share of the
text's 3-grams that some landmark holds: what the landmarks never saw is no evidence for any
language, and a text of fewer than three bytes gives none. The n-grams of all landmarks are kept; rows are scored fewer at a time if they are many.

At most ``max_rows`` different texts are learned from, an equal share for each language, chosen by
a hash of the text (a documented bound). Text and language of those rows are all that is used.
Languages are the model's own size and are known to the driver.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing
could be learned. Null languages are not learned from. Ties go to the language first in order.
Extra columns are ignored, repeated rows kept. Very long texts are read in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdgap.llm.common import carried, in_fold, small, texts
from crowdgap.llm.registry import query, table

MAX_ROWS, LANDMARKS = 2_000, 200
RIDGE = 1e-3
PIECE, FLAGS = 1 << 20, 1 << 22
# First codes of the 2- and 3-grams; 1-grams are bytes, and folded texts have no byte 0.
TWO, THREE = np.uint32(1 << 8), np.uint32((1 << 8) + (1 << 16))


def fold_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


def folded(raw: np.ndarray) -> np.ndarray:
    out = fold_table()[raw]
    upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)
                           & (out[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out


def ngram_codes(piece: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams at each place; 0 where the text ends before (``left``)."""
    b = np.zeros(len(piece) + 2, np.uint32)
    b[:-2] = piece
    one = b[:-2]
    pair = (one << np.uint32(8)) | b[1:-1]
    two = np.where(left > 1, TWO + pair, 0)
    three = np.where(left > 2, THREE + ((pair << np.uint32(8)) | b[2:]), 0)
    return [one, two, three]


def pieces(at: np.ndarray, rows: int):
    """(first row, last row, start, end): at most ``rows`` texts and PIECE bytes at a time."""
    n = len(at) - 1
    for first in range(0, n, rows):
        last = min(first + rows, n)
        for a in range(int(at[first]), int(at[last]), PIECE):
            yield first, last, a, min(a + PIECE, int(at[last]))


def presence(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The distinct n-gram codes of each text."""
    out = []
    for i in range(len(at) - 1):
        text = folded(raw[at[i]:at[i + 1]])
        seen: np.ndarray = np.zeros(0, np.uint32)
        for a in range(0, len(text), PIECE):
            piece = text[a:a + PIECE + 2]
            left = np.arange(len(piece), 0, -1)
            codes = np.concatenate([c for c in ngram_codes(piece, left)])
            seen = np.union1d(seen, codes[codes > 0])
        out.append(seen.astype(np.int32))
    return out


def lettered(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[97:123] = ascii_letter[65:91] = True
    sums = np.concatenate(([0], np.cumsum(ascii_letter[raw], dtype=np.int64)))
    out = sums[at[1:]] > sums[at[:-1]]
    for i in np.flatnonzero(~out):
        if at[i + 1] > at[i]:
            out[i] = any(c.isalpha() for c in raw[at[i]:at[i + 1]].tobytes().decode(errors="ignore"))
    return out


class Model:
    """Languages, the landmarks' n-gram codes in order, and a weight for each of them."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray):
        self.langs, self.codes, self.weights = langs, codes, weights

    def tables(self) -> np.ndarray:
        """Number of each known code, 0 for others."""
        out = np.zeros(int(THREE) + (1 << 24), np.int32)
        out[self.codes] = np.arange(1, len(self.codes) + 1)
        return out

    def scores(self, raw: np.ndarray, at: np.ndarray, number: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ridge output for each text and language, and the known share of each text's 3-grams."""
        n, width = len(at) - 1, len(self.codes) + 1
        out = np.zeros((n, len(self.langs)), np.float32)
        known, places = np.zeros(n, np.int64), np.maximum(np.diff(at) - 2, 0)
        flags, of = None, -1

        def close():
            held = flags[:, 1:].astype(np.float32)
            size = np.maximum(held.sum(1), 1)
            out[of:of + len(held)] = (held @ self.weights) / np.sqrt(size)[:, None]

        for first, last, a, b in pieces(at, min(64, max(1, FLAGS // width))):
            if first != of:
                if flags is not None:
                    close()
                flags, of = np.zeros((last - first, width), bool), first
            some = folded(raw[max(a - 1, 0):b + 2])[1 if a else 0:]
            ends = np.minimum(at[first + 1:last + 1], b) - np.maximum(at[first:last], a)
            row = np.repeat(np.arange(last - first), np.maximum(ends, 0))
            left = at[first + 1:last + 1][row] - np.arange(a, b)
            for codes in ngram_codes(some, np.pad(left, (0, len(some) - len(left)))):
                found = number[codes[:b - a]]
                flags.reshape(-1)[row * width + found] = True
            known[first:last] += np.bincount(row[found > 0], minlength=last - first)   # 3-grams
        if flags is not None:
            close()
        return out, known / np.maximum(places, 1)


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS) -> Model:
    """Kernel ridge regression on Nystroem landmarks; rows are (language, distinct codes)."""
    langs = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    each = max(1, landmarks // len(langs))
    marks = [codes for lang in langs
             for codes in [c for other, c in rows if other == lang][:each]]
    known = np.unique(np.concatenate(marks))

    def held(codes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(codes), len(known)), np.float32)
        for i, c in enumerate(codes):
            place = np.searchsorted(known, c)
            place[place == len(known)] = 0
            out[i, place[known[place] == c]] = 1
        return out / np.sqrt(np.maximum(out.sum(1), 1))[:, None]

    m = held(marks)
    k_nm = np.concatenate([held([c for _, c in rows[i:i + 256]]) @ m.T
                           for i in range(0, len(rows), 256)]).astype(np.float64)
    k_mm = (m @ m.T).astype(np.float64)
    named = np.array([langs.index(lang) for lang, _ in rows])
    y = np.where(named[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = (len(rows) / len(langs) / np.bincount(named, minlength=len(langs)))[named][:, None]
    left = k_nm.T @ (weight * k_nm) + RIDGE * len(rows) * k_mm + 1e-6 * np.eye(len(marks))
    ridge = np.linalg.solve(left, k_nm.T @ (weight * y))
    return Model(langs, known.astype(np.int64), (m.T @ ridge).astype(np.float32))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          max_rows: int = MAX_ROWS) -> Model:
    """A model from at most ``max_rows`` different texts of known language (ten of each at least)."""
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & (F.col("text") != ""))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("text")).collect()  # a row for each language
    if not sizes:
        return fit([])
    each = max(10, max_rows // len(sizes))
    shares = docs.sparkSession.createDataFrame(
        [(r[0], int(min(1.0, 1.2 * each / r[1]) * 1_000_000)) for r in sizes], "lang string, share long")
    chosen = known.join(F.broadcast(shares), "lang").withColumn("h", F.xxhash64("text")).where(
        F.pmod("h", F.lit(1_000_000)) < F.col("share")).select("text", "lang", "h")

    def run(batches):
        for batch in small(batches, 0):
            seen = presence(*texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([c.tobytes() for c in seen], pa.binary())],
                ["lang", "h", "codes"])

    got = chosen.mapInArrow(run, "lang string, h long, codes binary").dropDuplicates(["lang", "h"])
    first = got.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    rows = sorted(first.where(F.col("n") <= each).collect(), key=lambda r: (r.lang, r.h))
    return fit([(r.lang, np.frombuffer(r.codes, np.int32)) for r in rows])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
             keep: bool = False) -> DataFrame:
    """(key, lang_pred, score) for every row; with ``keep`` (text, row, lang_pred, score)."""
    given = carried(docs, key, text, keep)
    langs = np.array([*model.langs, "und"], dtype=object)

    def run(batches):
        number = model.tables()
        for batch in small(batches, 0):
            raw, at = texts(batch.column(0))
            if model.langs:
                s, known = model.scores(raw, at, number)
                best = s.argmax(1) if len(s) else np.zeros(0, np.int64)
                sure = np.clip((s.max(1, initial=-1) + 1) / 2, 0, 1).astype(np.float64) * known
            else:
                best, sure = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1)
            some = lettered(raw, at)
            best = np.where(some, best, len(model.langs))
            columns = batch.columns if keep else batch.columns[1:]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs[best], pa.string()), pa.array(np.where(some, sure, 0.0))],
                [*batch.schema.names[len(batch.columns) - len(columns):], "lang_pred", "score"])

    kinds = f"row {given.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    out = given.mapInArrow(run, f"text string, {kinds}" if keep else kinds)
    return out if keep else out.select(F.col("row").getField(key).alias(key), "lang_pred", "score")


FOLDS, HELD_OUT = 3, 1


def learned(docs: DataFrame) -> Model:
    """A model from the rows outside the held-out fold."""
    return learn(docs.where(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select(
        "doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
