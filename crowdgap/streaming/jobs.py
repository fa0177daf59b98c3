"""Incremental jobs: resumable mining, live progress, keyed state, quota sampling.

Every sink is idempotent per key or per batch, so a batch replayed after a failure changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crowdgap.operators.joins import Quota
from crowdgap.operators.ordering import dedupe, first_rows
from crowdgap.session import new_path
from crowdgap.sources.live import LiveTable
from crowdgap.sources.sinks import exists, latest


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet",
               files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _start(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str | None,
           mode: str = "append") -> StreamingQuery:
    place = checkpoint or new_path(df.sparkSession, "stream")
    return (df.writeStream.outputMode(mode).option("checkpointLocation", place)
            .trigger(availableNow=True).foreachBatch(step).start())


def mine_stream(source: DataFrame, sink: str, key: str, order: Sequence,
                derive: Callable[[DataFrame], DataFrame],
                checkpoint: str | None = None) -> StreamingQuery:
    """Derive and append the items of each batch that the sink does not hold yet.

    The sink is a :class:`~crowdgap.sources.live.LiveTable`: a batch reads the slots it touches.
    """
    table = LiveTable(source.sparkSession, sink, key)

    def step(batch: DataFrame, _: int) -> None:
        # a row's slot is known from its key alone, so neither copies nor ranks are made for it
        table.append_new(derive(dedupe(batch, key, order)), batch)

    return _start(source, step, checkpoint)


def progress_stream(attempts: DataFrame, sink: str,
                    checkpoint: str | None = None) -> StreamingQuery:
    """Running tries and hits per (user, concept, item).

    An exact distinct count is not available on streams; one counter per item is, it is
    additive, and rolls up to progress, profile and totals when read. Each batch appends the
    counters it changed.
    """
    counters = attempts.groupBy("code", "concept", "idx").agg(
        F.count("*").alias("tries"), F.sum(F.col("correct").cast("bigint")).alias("hits"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("append").parquet(sink)

    return _start(counters, step, checkpoint, "update")


def item_counters(spark: SparkSession, sink: str) -> DataFrame:
    """Current counters: the newest version of each."""
    return latest(spark.read.parquet(sink), ["code", "concept", "idx"], "version").drop("version")


def live_progress(counters: DataFrame) -> DataFrame:
    return counters.groupBy("code", "concept").agg(
        F.count("*").alias("n"), F.sum("hits").alias("correct"), F.sum("tries").alias("tries"))


def live_totals(counters: DataFrame) -> DataFrame:
    return counters.agg(F.coalesce(F.sum("tries"), F.lit(0)).alias("attempts"),
                        F.coalesce(F.sum("hits"), F.lit(0)).alias("correct"))


def keyed_stream(source: DataFrame, sink: str, key: Sequence[str], at: str,
                 checkpoint: str | None = None) -> StreamingQuery:
    """Last-write-wins state as a log: one newest row per key and batch."""
    def step(batch: DataFrame, _: int) -> None:
        latest(batch, key, at).write.mode("append").parquet(sink)

    return _start(source, step, checkpoint)


class QuotaSink:
    """Fills per-band quotas batch by batch; ``full`` tells when the feed can be stopped."""

    def __init__(self, spark: SparkSession, path: str, quotas: Sequence[Quota], key: str,
                 order: str):
        self.spark, self.path, self.key, self.order = spark, path, key, order
        self.want = {q.name: q.want for q in quotas}

    def counts(self) -> dict[str, int]:
        """At most one number per band."""
        if not exists(self.spark, self.path):
            return {}
        rows = self.spark.read.parquet(self.path).groupBy("band").count().collect()
        return {r.band: r["count"] for r in rows}

    @property
    def full(self) -> bool:
        have = self.counts()
        return all(have.get(b, 0) >= n for b, n in self.want.items())

    def step(self, batch: DataFrame, _: int) -> None:
        have = self.counts()
        room = {b: n - have.get(b, 0) for b, n in self.want.items() if n > have.get(b, 0)}
        if not room:
            return
        limit = F.create_map(*[F.lit(x) for b, n in room.items() for x in (b, n)])
        open_rows = batch.where(F.col("band").isin(*room))
        if have:
            seen = self.spark.read.parquet(self.path).select(self.key)
            open_rows = open_rows.join(seen, self.key, "left_anti")
        kept = first_rows(open_rows, ["band"], [self.order], max(room.values()), "__at")
        (kept.where(F.col("__at") <= limit[F.col("band")]).drop("__at")
         .write.mode("append").parquet(self.path))


def quota_stream(source: DataFrame, sink: QuotaSink, checkpoint: str | None = None) -> None:
    """Run until the feed is drained or every quota is full."""
    running = _start(source, sink.step, checkpoint)
    while not running.awaitTermination(1):
        if sink.full:
            running.stop()
            break
