"""URL filter: a sorted array of 64-bit digests, memory-mapped by the tasks.

Rules are (host, path, verdict). A rule fits its host and all subdomains if the url's path starts
with the rule's path; the longest rule wins (of equally long ones the longer host, of equal rules
``block``). A url that no rule fits gets ``default``.

The index holds the xxhash64 digests of ``host + path`` in order, and the full strings beside
them. Spark makes every digest a url could match (host suffixes of the label counts and path
prefixes of the lengths that occur in rules), a task finds them all with one vectorised binary search, and hits
count only if the stored string is the same, so digests that collide do no harm.

The index travels as files, so its size is checked: a rule table beyond ``max_rules`` is joined on
the digest instead, with the same result.

Null or malformed urls have empty host and path and get ``default``. Rules with a null host, path
or verdict are ignored. Other columns of ``pages`` are ignored; repeated rows are kept. Empty
tables give empty results.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm.registry import query, table
from crowdgap.session import shared_dir

MAX_RULES = 1_000_000      # about 100 MB of index files
SEED = 42                  # of Spark's xxhash64


def host_of(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def clean_rules(rules: DataFrame) -> DataFrame:
    """One row for each (host, path); ``block`` wins where both verdicts are given."""
    return (rules.select("host", "path", "verdict").dropna()
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))


def probes(host, path, lengths: list[int], counts: list[int]) -> Column:
    """Every ``host + path`` string of a rule that would fit.

    Host suffixes of the label counts and path prefixes of the lengths that occur in rules: work
    grows with a url's length, not with its square.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in counts]),
                                    lambda n: n <= F.size(labels)),
                           lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    heads = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]),
                                 lambda n: n <= F.length(path)),
                        lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes,
                                 lambda s: F.transform(heads, lambda p: F.concat(s, F.lit("\t"), p))))


def write_index(rules: list, folder: str) -> list[str]:
    """Files of the index: digests in order, string offsets, verdicts, host sizes, strings."""
    import xxhash
    strings = [f"{r.host}\t{r.path}".encode() for r in rules]
    keys = np.array([xxhash.xxh64_intdigest(s, seed=SEED) for s in strings],
                    np.uint64).view(np.int64)
    order = np.argsort(keys, kind="stable")
    offsets = np.zeros(len(rules) + 1, np.int64)
    np.cumsum([len(strings[i]) for i in order], out=offsets[1:])
    parts = {"keys": keys[order], "offsets": offsets,
             "block": np.array([rules[i].verdict == "block" for i in order], bool),
             "host": np.array([len(rules[i].host) for i in order], np.int64),
             "size": np.array([len(rules[i].host) + len(rules[i].path) for i in order], np.int64),
             "strings": np.frombuffer(b"".join(strings[i] for i in order), np.uint8)}
    name, paths = uuid.uuid4().hex, []
    for part, values in parts.items():
        paths.append(os.path.join(folder, f"urls-{name}-{part}.npy"))
        np.save(paths[-1], values)
    return paths


class Index:
    """The memory-mapped index on an executor."""

    def __init__(self, names: dict[str, str]):
        for part, name in names.items():
            path = SparkFiles.get(name)
            try:
                values = np.load(path, mmap_mode="r")
            except ValueError:             # an empty array cannot be mapped
                values = np.load(path)
            setattr(self, part, values)

    def find(self, keys: np.ndarray, strings) -> np.ndarray:
        """Place of each probe in the index, or -1; equal digests are told apart by string."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, len(self.keys) - 1)
        for i in np.flatnonzero(self.keys[near] == keys):
            j, wanted = int(at[i]), strings[int(i)].as_py().encode()
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.strings[self.offsets[j]:self.offsets[j + 1]].tobytes() == wanted:
                    out[i] = j
                    break
                j += 1
        return out


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``."""
    spark = pages.sparkSession
    rules = clean_rules(rules)
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().limit(10_001).collect()]
    counts = [r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct()
              .limit(10_001).collect()]
    if len(lengths) > 10_000 or len(counts) > 10_000:
        raise ValueError("rules have more than 10,000 different path lengths or label counts")
    urls = pages.select(F.col(key), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    if not lengths:
        return urls.select(key, "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    head = rules.limit(max_rules + 1).collect() if max_rules else []
    if not max_rules or len(head) > max_rules:
        return joined(urls, rules, key, lengths, counts, default)
    with tempfile.TemporaryDirectory() as folder:
        names = ship(spark, write_index(head, folder))
    asked = urls.withColumn("probe", probes(F.col("host"), F.col("path"), lengths, counts))
    asked = asked.withColumn("digest", F.transform("probe", lambda p: F.xxhash64(p)))
    kind = urls.schema[key].dataType.simpleString()

    def judge(batches):
        index = Index(names)
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            sizes = np.asarray(pc.fill_null(pc.list_value_length(at["probe"]), 0), np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = index.find(np.asarray(at["digest"].flatten(), np.int64), at["probe"].flatten())
            hit = np.flatnonzero(place >= 0)
            best = np.full(batch.num_rows, -1, np.int64)
            if len(hit):
                p, r = place[hit], row[hit]
                order = np.lexsort((index.host[p], index.size[p], r))
                best[r[order]] = p[order]          # the last, so the longest, stays
            rule = [index.strings[index.offsets[b]:index.offsets[b + 1]].tobytes().decode()
                    .replace("\t", "", 1) if b >= 0 else None for b in best]
            verdict = [default if b < 0 else "block" if index.block[b] else "allow" for b in best]
            yield pa.RecordBatch.from_arrays(
                [at[key], at["host"], at["path"], pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string())], [key, "host", "path", "rule", "verdict"])

    return asked.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, "
                                   "verdict string")


def ship(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Put the files into the shared folder, from where Spark gives every executor a copy."""
    names = {}
    for path in paths:
        name = os.path.basename(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}"), target)
        spark.sparkContext.addFile(str(target.toString()))
        names[name[:-4].rpartition("-")[2]] = name
    return names


def joined(urls: DataFrame, rules: DataFrame, key: str, lengths: list[int],
           counts: list[int], default: str) -> DataFrame:
    """The same verdicts by a join on the digest, for rule tables of any size."""
    keyed = rules.select(F.concat("host", F.lit("\t"), "path").alias("s"),
                         F.concat("host", "path").alias("rule"), "verdict",
                         F.length("host").alias("h"))
    keyed = keyed.withColumn("d", F.xxhash64("s"))
    places = urls.select("host", "path").distinct()
    asked = (places.withColumn("p", F.explode(probes(F.col("host"), F.col("path"), lengths, counts)))
             .withColumn("d", F.xxhash64("p")))
    found = asked.join(keyed, (asked.d == keyed.d) & (asked.p == keyed.s)).groupBy(
        asked.host, asked.path).agg(F.max(F.struct(F.length("rule").alias("n"), "h", "rule",
                                                   "verdict")).alias("best"))
    return urls.join(found, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


# The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(list(rules), columns=["host", "path", "verdict"]),
                                 "host string, path string, verdict string")


@query("op3_url_filter", r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
places AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule,
         arg_max(v, length(h || p) * 1000 + length(h)) AS v
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_frame(spark))
