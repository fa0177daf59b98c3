"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics (``NAMES``) come from one pass over the Arrow byte buffers: shares of character
classes, word lengths, and how much of the text repeats itself. Spark makes them for the labelled
rows; the trees are fitted from at most ``max_rows`` of them (a documented bound; the rows are
chosen by a hash of their key) on histograms of at most ``BINS`` quantile bins. The fitted trees
are complete binary trees in flat arrays, so a task walks a whole batch through a tree with a few
numpy steps.

Null texts count as empty; empty texts get a score like any other. Null labels and keys are not
learned from; of several labels of a key the lowest counts. Without labels, or with one class
only, every score is that class's smoothed share (0.5 without labels). Extra columns are ignored,
repeated rows are kept. Very long texts are read in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm.common import (byte_pieces, carried, hash_share, in_fold, rows_of, small,
                                 texts, words_of)
from crowdgap.llm.registry import query, table

MAX_ROWS = 20_000
BINS, TREES, DEPTH, RATE, PENALTY = 64, 80, 4, 0.15, 1.0

# Classes of bytes; the first name counts bytes that no other class has.
CLASSES = {"other": b"", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)),
           "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".?",
           "comma": b",;:", "shout": b"!", "bar": b"|", "symbol": b"#$%&*@^~+=_",
           "bracket": b"<>()[]{}/\\", "quote": b"'\"`-", "lead": bytes(range(0xC0, 0x100)),
           "tail": bytes(range(0x80, 0xC0))}
NAMES = ["bytes", "words", "word_size", "word_size_sd", "repeat_next", "repeat_second",
         "distinct", *CLASSES]


def class_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for i, members in enumerate(CLASSES.values()):
        out[list(members)] = i
    return out


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text of a buffer."""
    n, kinds, kind_of = len(at) - 1, len(CLASSES), class_table()
    counts = np.zeros(n * kinds, np.int64)
    for a, b in byte_pieces(raw):
        counts += np.bincount(rows_of(at, a, b) * kinds + kind_of[raw[a:b]], minlength=n * kinds)
    doc, marks, size = words_of(raw, at)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    mean = np.bincount(doc, size, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, size * size, n) / some - mean * mean, 0))

    def repeats(gap: int) -> np.ndarray:
        same = (marks[gap:] == marks[:-gap]) & (doc[gap:] == doc[:-gap])
        return np.bincount(doc[gap:], same, n) / some

    keys = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (marks >> np.uint64(20)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=n) / some
    total = (at[1:] - at[:-1]).astype(np.float64)
    shares = counts.reshape(n, kinds) / np.maximum(total, 1)[:, None]
    return np.column_stack([np.log1p(total), np.log1p(words), mean, spread, repeats(1),
                            repeats(2), distinct, shares])


class Trees:
    """Complete trees in flat arrays: ``2 ** DEPTH - 1`` tests and ``2 ** DEPTH`` leaves each."""

    def __init__(self, base: float):
        self.base = base
        self.feature: list[np.ndarray] = []
        self.limit: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, feature[at]] > limit[at])
            out += leaf[at - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost the logistic loss; splits are chosen from histograms of gradients."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    margin, width, inner = np.full(len(y), model.base), x.shape[1], 2 ** DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2 ** level - 1, 2 ** level
            best = np.full(many, 1e-9)
            cut = np.full(many, BINS)
            for f in range(width):
                place = (node - first) * BINS + codes[:, f]
                gl = np.bincount(place, g, many * BINS).reshape(many, BINS).cumsum(1)
                hl = np.bincount(place, h, many * BINS).reshape(many, BINS).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = (gl ** 2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY)
                        - gt ** 2 / (ht + PENALTY))
                gain[(hl < 1) | (ht - hl < 1)] = 0
                gain[:, len(edges[f]):] = 0
                top = gain.argmax(1)
                value = gain[np.arange(many), top]
                for j in np.flatnonzero(value > best):
                    best[j], cut[j] = value[j], top[j]
                    feature[first + j] = f
                    limit[first + j] = edges[f][top[j]]
            at = node - first
            node = 2 * node + 1 + (codes[np.arange(len(y)), feature[node]] > cut[at])
        leaf_of = node - inner
        gs = np.bincount(leaf_of, g, 2 ** DEPTH)
        hs = np.bincount(leaf_of, h, 2 ** DEPTH)
        leaf = -RATE * gs / (hs + PENALTY)
        margin += leaf[leaf_of]
        model.feature.append(feature)
        model.limit.append(limit)
        model.leaf.append(leaf)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Trees from at most ``max_rows`` labelled rows, chosen by hash; a repeated row is one."""
    known = labels.select(key, F.col(label).cast("double").alias("y")).dropna()
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(hash_share(F.col(key), share)).groupBy(key).agg(F.min("y").alias("y"))
    # bounded by max_rows, so it may be sent to every task
    rows = docs.select(key, text).join(F.broadcast(chosen), key)

    def run(batches):
        for batch in small(batches, 1):
            x = statistics(*texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3),
                 pa.array(list(x), pa.list_(pa.float64()))], ["k", "y", "h", "x"])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.select(key, text, "y", F.xxhash64(key, text).alias("h")).mapInArrow(
        run, f"k {kind}, y double, h long, x array<double>").dropDuplicates(["k", "h"])
    got = got.orderBy("h").limit(max_rows).toPandas().sort_values(["k", "h"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    return fit(x, (got["y"].to_numpy(np.float64) >= 0.5).astype(np.float64))


def score(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text",
          keep: bool = False) -> DataFrame:
    """(key, score) for every row; with ``keep`` (text, row, score), see ``carried``."""
    given = carried(docs, key, text, keep)

    def run(batches):
        for batch in small(batches, 0):
            s = model.score(statistics(*texts(batch.column(0))))
            columns = batch.columns if keep else batch.columns[1:]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(s, pa.float64())],
                [*batch.schema.names[len(batch.columns) - len(columns):], "score"])

    kinds = f"row {given.schema['row'].dataType.simpleString()}, score double"
    out = given.mapInArrow(run, f"text string, {kinds}" if keep else kinds)
    return out if keep else out.select(F.col("row").getField(key).alias(key), "score")


FOLDS, HELD_OUT, CUT = 5, 0, 0.3


def learned(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from the labels outside the held-out fold."""
    return learn(docs, labels.where(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)))


@query("op5_quality_trees")
def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
