"""Sinks, rewritten tables, keyed tables and nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdgap.functions.measures import col

ITEM = T.StructType([
    T.StructField("fen", T.StringType()), T.StructField("best", T.StringType()),
    T.StructField("human", T.ArrayType(T.StructType([
        T.StructField("uci", T.StringType()), T.StructField("p", T.DoubleType())]))),
    T.StructField("p_best", T.DoubleType())])
CONCEPTS = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("gloss", T.StringType()),
    T.StructField("signature", T.MapType(T.StringType(), T.StringType())),
    T.StructField("study", T.ArrayType(ITEM)), T.StructField("drill", T.ArrayType(ITEM))])


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    """Parquet, or CSV with its header once per file."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).format(fmt).save(path)


def append_new(df: DataFrame, path: str, key: str | Sequence[str]) -> None:
    """Append the rows whose key the sink does not hold yet (safe to repeat).

    Only the key columns of the sink are read.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    if exists(spark, path):
        known = spark.read.schema(df.schema).parquet(path).select(*keys)
        df = df.join(known, keys, "left_anti")
    df.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_docs(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def read_concepts(spark: SparkSession, path: str, schema: T.StructType = CONCEPTS,
                  multi_line: bool = False) -> DataFrame:
    """Nested course documents: JSON lines, or one array per file with ``multi_line``."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def course_items(concepts: DataFrame, concept: str = "id") -> DataFrame:
    """Long form of the study and drill arrays."""
    parts = [concepts.select(concept, F.lit(s).alias("slot"),
                             F.posexplode(s).alias("idx", "item")) for s in ("study", "drill")]
    return parts[0].unionByName(parts[1]).select(concept, "slot", "idx", "item.*")


def rewrite_with_map(spark: SparkSession, path: str, mapping: DataFrame, key: str,
                     value: str) -> None:
    """Replace ``value`` where the mapping knows the key, then swap the new table in.

    A key with two different values in the mapping is an error; repeats are harmless.
    A table cannot be overwritten while it is read, so the result is written beside it first.
    """
    old = spark.read.parquet(path)
    clash = F.raise_error(F.lit(f"the mapping has several values for one {key}"))
    fixed = mapping.groupBy(key).agg(F.min(value).alias("__new"), F.max(value).alias("__max"))
    fixed = fixed.select(key, F.when(F.col("__new") != F.col("__max"), clash).otherwise(
        F.col("__new")).alias("__new"))
    out = (old.join(fixed, key, "left")
           .withColumn(value, F.coalesce(F.col("__new"), col(value)))
           .select(*old.columns))
    fresh, aside = path.rstrip("/") + ".__new", path.rstrip("/") + ".__old"
    out.write.mode("overwrite").parquet(fresh)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm_path(aside), True)
    fs.rename(jvm_path(path), jvm_path(aside))
    fs.rename(jvm_path(fresh), jvm_path(path))
    fs.delete(jvm_path(aside), True)


def append_attempts(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Last write per key; a map-side combined aggregate, equal times resolve by payload."""
    rest = [c for c in df.columns if c not in key and c != at]
    newest = F.max(F.struct(at, *rest)).alias("s")
    return df.groupBy(*key).agg(newest).select(*key, "s.*")


def upsert(df: DataFrame, path: str) -> None:
    """Keyed tables are append-only logs; :func:`latest` reads them, :func:`compact` shrinks."""
    df.write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, key: Sequence[str], at: str, target: str) -> str:
    """Write the last version per key to ``target`` and return it."""
    latest(spark.read.parquet(path), key, at).write.parquet(target)
    return target
