"""Keyed sinks that readers always see whole.

Rows lie in ``write=<id>/slot=<n>`` below the sink's folder, where the slot is a hash of the key. A
small manifest names the live (write, slot) folders; a new version of it is written aside and
renamed into place, so a reader sees the table before a change or after it, and an append reads only
the slots that its rows touch. A sink has one writer at a time, as a streaming query has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.functions.measures import col

SLOTS = 64


class LiveTable:
    """A table at ``path``, keyed by one or more columns."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots
        self.keys = [key] if isinstance(key, str) else list(key)

    # -- the manifest: one small text, at most writes x slots names

    def _hadoop(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._hadoop("_live")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict[str, list[int]]:
        """{write: slots}; of the newest version unless one is named."""
        found = self.versions()
        if not found:
            return {}
        file, fs = self._hadoop(f"_live/{found[-1] if version is None else version:010d}.json")
        stream = fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, writes: dict[str, list[int]]) -> None:
        version = (self.versions() or [0])[-1] + 1
        aside, fs = self._hadoop(f"_live/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(writes).encode()))
        finally:
            stream.close()
        if not fs.rename(aside, self._hadoop(f"_live/{version:010d}.json")[0]):
            raise OSError(f"version {version} of {self.path} could not be put in place")

    # -- rows

    def folders(self, writes: dict[str, list[int]], touched: Sequence[int] | None = None) -> list[str]:
        wanted = None if touched is None else set(touched)
        return [f"{self.path}/write={w}/slot={s}" for w, slots in writes.items() for s in slots
                if wanted is None or s in wanted]

    def read(self, schema=None, version: int | None = None,
             touched: Sequence[int] | None = None) -> DataFrame | None:
        """The live rows, of certain slots only if named; None where nothing is live."""
        places = self.folders(self.manifest(version), touched)
        if not places:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*places)

    def _slot(self):
        return F.pmod(F.xxhash64(*[col(k) for k in self.keys]), F.lit(self.slots)).cast("int")

    def _write(self, df: DataFrame) -> dict[str, list[int]]:
        """Write rows under a new name; not live yet."""
        name = uuid.uuid4().hex
        (df.withColumn("slot", self._slot()).repartition("slot").write.partitionBy("slot")
         .parquet(f"{self.path}/write={name}"))
        folder, fs = self._hadoop(f"write={name}")
        slots = [int(s.getPath().getName()[5:]) for s in fs.listStatus(folder)
                 if s.getPath().getName().startswith("slot=")]
        return {name: sorted(slots)} if slots else {}

    def append_new(self, df: DataFrame, keyed: DataFrame | None = None) -> None:
        """Append the rows whose key the table does not hold yet (safe to repeat).

        ``keyed`` is a cheaper table that holds all keys of ``df``, to see which slots it touches; an
        empty table has none to look at.
        """
        live, known = self.manifest(), None
        if live:
            slots = (df if keyed is None else keyed).select(self._slot().alias("slot")).distinct()
            known = self.read(df.schema, touched=[r.slot for r in slots.collect()])
        if known is not None:
            df = df.join(known.select(*self.keys), self.keys, "left_anti")
        new = self._write(df)
        if new or not live:
            self._commit({**live, **new})

    def replace(self, df: DataFrame) -> None:
        """Make these rows, which may come from the table itself, the whole table.

        Folders of earlier versions stay for their readers.
        """
        self._commit(self._write(df))

    def rewrite_with_map(self, mapping: DataFrame, key: str, value: str) -> None:
        """Replace ``value`` where the mapping knows the key; several values for one are an error."""
        old = self.read()
        if old is None:
            return
        clash = F.raise_error(F.lit(f"the mapping has several values for one {key}"))
        fixed = mapping.groupBy(key).agg(F.min(value).alias("__new"), F.max(value).alias("__max"))
        fixed = fixed.select(key, F.when(F.col("__new") != F.col("__max"), clash).otherwise(
            F.col("__new")).alias("__new"))
        self.replace(old.join(fixed, key, "left").withColumn(
            value, F.coalesce(F.col("__new"), col(value))).select(*old.columns))
