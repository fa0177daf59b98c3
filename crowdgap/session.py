"""Session helper and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "crowdgap", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on; a cluster's own master wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # wide feature rows: methods above this size are never compiled by the JVM
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (unit tests, a laptop) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    existing = getattr(spark, "_crowdgap_dir", None)
    if existing is None:
        existing = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._crowdgap_dir = existing
    return existing


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"crowdgap-{kind}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the lineage."""
    spark = df.sparkSession
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write to the shared folder and read back, for results used by several later jobs."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
