"""Archive and table scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdgap.functions.measures import col

RECORD_MARKER = "[Event "

POSITIONS = T.StructType([
    T.StructField("game_id", T.StringType()), T.StructField("ply", T.IntegerType()),
    T.StructField("fen", T.StringType()), T.StructField("played_move", T.StringType()),
    T.StructField("white_elo", T.IntegerType()), T.StructField("black_elo", T.IntegerType())])


def read_records(spark: SparkSession, path: str, marker: str = RECORD_MARKER) -> DataFrame:
    """Split plain, gzip or zstd archives of multi-line records, one row per record.

    The separator eats the marker of every record but a file's first; it is put back. The last
    record is emitted too, without its trailing line breaks.
    """
    raw = spark.read.option("lineSep", "\n\n" + marker).text(path)
    text = F.regexp_replace("value", r"\s+$", "")
    whole = F.when(F.startswith(text, F.lit(marker)), text).otherwise(
        F.concat(F.lit(marker), text))
    return (raw.where(F.length(text) > 0)
            .select(whole.alias("record"), F.col("_metadata.file_name").alias("file")))


def with_patterns(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """First match of each pattern's group; absent gives the empty string."""
    return df.withColumns({n: F.regexp_extract(col(text), rx, 1) for n, rx in patterns.items()})


def with_tags(df: DataFrame, tags: Sequence[str], text: str = "record") -> DataFrame:
    """Header tags of the form ``[Name "value"]``."""
    return with_patterns(df, text, {t: rf'\[{t} "([^"]*)"\]' for t in tags})


def in_file_order(df: DataFrame, name: str, head: str | None = None) -> DataFrame:
    """Number the rows of a file scan from 0: by file path, then by place in the file.

    ``head`` names a flag for the first row of each file.

    Rows of one split follow each other in a task, so only the splits' counts are put in order.
    ``df`` must be a scan as read, without a filter.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("__file"),
                   F.col("_metadata.file_block_start").alias("__block"),
                   F.monotonically_increasing_id().alias("__at"))
    splits = at.groupBy("__file", "__block").agg(F.min("__at").alias("__first"),
                                                 F.count("*").alias("__n"))
    earlier = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__file", "__block", "__first", F.coalesce(
        F.sum("__n").over(earlier), F.lit(0)).alias("__before"))     # a row for each split
    placed = at.join(splits, ["__file", "__block"])
    number = (F.col("__before") + F.col("__at") - F.col("__first")).alias(name)
    first = (F.col("__block") == 0) & (F.col("__at") == F.col("__first"))
    return placed.select(*df.columns, number, *[first.alias(h) for h in [head] if h])


def read_positions(spark: SparkSession, path: str, offset: int = 0,
                   limit: int | None = None) -> DataFrame:
    """Typed CSV scan; an offset/limit slice follows the order of files and of lines in them."""
    df = spark.read.schema(POSITIONS).option("header", True).csv(path)
    if not offset and limit is None:
        return df
    rows = in_file_order(df, "__row").where(F.col("__row") >= offset)
    if limit is not None:
        rows = rows.where(F.col("__row") < offset + limit)
    return rows.drop("__row")


def read_batches(spark: SparkSession, pattern: str, schema: T.StructType,
                 folders: bool = False) -> DataFrame:
    """Union of batch files tagged with ``source`` (elite or club) and ``batch``.

    A batch is named by its file, or by its folder where a batch is a folder of part files.
    """
    df = spark.read.schema(schema).option("header", True).csv(pattern)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2 if folders else -1)
    batch = name if folders else F.regexp_replace(name, r"\.[^.]*$", "")
    return df.select("*", F.when(F.contains(name, F.lit("elite")), "elite").otherwise("club")
                     .alias("source"), batch.alias("batch"))


def read_keys(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Column-pruned parquet scan."""
    return spark.read.parquet(path).select(*cols)


def read_tagged(spark: SparkSession, path: str, fields: int = 8) -> DataFrame:
    """Headered CSV by position; short lines are dropped, the last wanted field holds tags.

    The file is quote-free by definition, so a plain split is exact. Every file's first line is
    its header; ``arrival`` grows with the order of files and of lines in them.
    """
    parts = F.split("value", ",")
    lines = in_file_order(spark.read.text(path), "arrival", "__head")
    lines = lines.where(~F.col("__head") & (F.size(parts) >= fields))
    at = [F.get(parts, F.lit(i)) for i in (0, 1, 2, fields - 1)]
    return lines.select(at[0].alias("id"), at[1].alias("fen"), at[2].alias("moves"),
                        F.filter(F.split(at[3], r"\s+"), lambda t: t != "")
                        .alias("tags"), "arrival")


def read_vectors(spark: SparkSession, path: str, key: str,
                 vector: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(key, vector)
