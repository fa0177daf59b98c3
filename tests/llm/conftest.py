import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("row", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("digest", T.StringType()), T.StructField("k", T.LongType()),
    T.StructField("bucket", T.LongType()), T.StructField("tag", T.StringType())])


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(1, 9)))
                    for _ in range(n))


def hard_rows():
    """Nulls in every column, empty, blank, long, equal and repeated texts, odd characters."""
    base = words(1, 300)
    near = base.split()
    near[50] = "changed"
    texts = [base, " ".join(near), base, None, "", " \n\t ", "x", "\\ <|im_end|> 日本語 𝄞 é ▁", "a" * 5000,
             "ab" * 3000, words(2, 120) + " " + base[:400], words(3, 4), "é" * 90, words(4, 20_000),
             base[100:700] + "ö" + base[100:700]]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None,
             None if t is None else len(t), "r", .5, "d", 1, 2, "t") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, base, *[None] * 9), (None, "only here", *[None] * 9)]
    return rows


@pytest.fixture(scope="session")
def hard(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
