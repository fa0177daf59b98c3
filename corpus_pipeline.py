"""The corpus pipeline: five stages, each written and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and
returns documents with the same columns; the last returns where each document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm import language, neardup, packing, quality, suffixes
from crowdgap.llm.common import carried, restored
from crowdgap.session import materialise

# Documents go whose language score is below this: no known language explains them. With a language
# left out of training, its texts score 0.22 to 0.45 (95 of 100), the others' 0.46 to 1.
SURE = 0.45


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality trees score at the cut or above."""
    model = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.score(docs, model, keep=True).where(F.col("score") >= quality.CUT)
    return kept.select(*restored(docs.columns, "text"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a known language."""
    found = language.identify(docs, language.learned(docs), keep=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return kept.select(*restored(docs.columns, "text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class; one of rows that repeat it."""
    first = neardup.keepers(neardup.classes(docs))
    named = carried(docs, "doc_id", "text", keep=True).select(
        "text", "row", F.col("row.doc_id").alias("id"),
        neardup.digest_of(F.col("text")).alias("digest"))
    kept = named.join(first, named["digest"].eqNullSafe(first["kept_digest"])
                      & named["id"].eqNullSafe(first["kept_id"]), "left_semi")
    return kept.dropDuplicates(["digest"]).select(*restored(docs.columns, "text"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated strings out of the texts; documents of which nothing is left go."""
    cut = suffixes.remove_repeats(docs, keep=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    columns = dict(zip(docs.columns, restored(docs.columns, "text")))
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast("bigint").alias("n_chars")
    return left.select(*columns.values())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: (doc_id, piece, bin, start, size)."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("language", language_stage),
          ("near_duplicates", near_duplicate_stage), ("suffix_dedup", suffix_stage),
          ("packing", packing_stage)]

# Trained models, alignments and packing are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
