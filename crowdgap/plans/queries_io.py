"""Source, sink and streaming queries; every file read here is written from the tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdgap.functions import measures as m
from crowdgap.functions.measures import rounded
from crowdgap.operators import joins, rows
from crowdgap.operators import sampling as sm
from crowdgap.plans.bindings import (
    ATTEMPTS, EVALS, GAMES, LEVELS, MASTER, arrival, attempts, evals, games, master, read,
    select_stream)
from crowdgap.plans.queries_joins import CLUB_QUOTAS
from crowdgap.plans.registry import query
from crowdgap.session import new_path
from crowdgap.sources import archives, sinks
from crowdgap.sources.live import LiveTable
from crowdgap.streaming import jobs


@query("archive_ingest", f"""
WITH {GAMES} SELECT CAST(game_id AS STRING) AS gid, white_elo FROM games
WHERE try_cast(coalesce(white_tag, '') AS INT) >= 1800 AND black_elo >= 1800
  AND try_cast(split_part(time_control, '+', 1) AS INT) >= 600
  AND (termination IS NULL OR termination <> 'Abandoned')""")
def archive_ingest(spark, sf):
    tags = F.concat_ws(
        "\n", F.lit('[Event "Rated game"]'),
        F.concat(F.lit('[Site "https://host.example/'), F.col("game_id").cast("string"),
                 F.lit('"]')),
        F.concat(F.lit('[WhiteElo "'), F.coalesce("white_tag", F.lit("")), F.lit('"]')),
        F.concat(F.lit('[BlackElo "'), F.col("black_tag"), F.lit('"]')),
        F.concat(F.lit('[TimeControl "'), F.col("time_control"), F.lit('"]')),
        F.concat(F.lit('[Termination "'), F.col("termination"), F.lit('"]')))
    path = new_path(spark, "archive")
    (games(spark, sf).select(F.concat(tags, F.lit("\n\n1. e4 e5 2. Nf3 Nc6")).alias("value"))
     .write.option("lineSep", "\n\n").text(path))
    tagged = archives.with_tags(archives.read_records(spark, path), [
        "Site", "WhiteElo", "BlackElo", "TimeControl", "Termination"])
    kept = rows.eligible_games(tagged, 1800, 600, "WhiteElo", "BlackElo", "TimeControl",
                               "Termination")
    return kept.select(m.game_id("Site", F.lit("none")).alias("gid"),
                       F.col("WhiteElo").cast("bigint").alias("white_elo"))


_BATCH = T.StructType([T.StructField("item_key", T.StringType()),
                       T.StructField("ply", T.IntegerType()),
                       T.StructField("cost", T.DoubleType())])


@query("read_batches", f"""
WITH {EVALS} SELECT CASE WHEN batch >= 2000 THEN 'elite' ELSE 'club' END AS source,
 CASE WHEN batch >= 2000 THEN '03_elite' ELSE '03_club' END AS batch, count(*) AS n,
 count(cost) AS n_cost, round(avg(cost), 6) AS mean_cost FROM evals GROUP BY ALL""")
def read_batches(spark, sf):
    path = new_path(spark, "batches")
    src = evals(spark, sf)
    for name, part in (("03_elite", src.where("batch >= 2000")), ("03_club",
                                                                  src.where("batch < 2000"))):
        sinks.write_table(part.select("item_key", "ply", "cost"), f"{path}/{name}", "csv")
    found = archives.read_batches(spark, f"{path}/*/*.csv", _BATCH, folders=True)
    return found.groupBy("source", "batch").agg(
        F.count("*").alias("n"), F.count("cost").alias("n_cost"),
        rounded(F.avg("cost")).alias("mean_cost"))


@query("read_keys", """
SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def read_keys(spark, sf):
    return archives.read_keys(spark, f"{sf}/lineitem.parquet", ["l_orderkey"]).groupBy(
        "l_orderkey").agg(F.count("*").alias("n"))


@query("read_positions", f"""
WITH {GAMES} SELECT CAST(game_id AS STRING) AS game_id, white_elo, black_elo FROM games""")
def read_positions(spark, sf):
    path = new_path(spark, "positions")
    src = games(spark, sf).select(
        "game_id", F.lit(14).alias("ply"), F.lit("8/8/8/8/8/8/8/8 w - - 0 1").alias("fen"),
        F.lit("e2e4").alias("played_move"), "white_elo", "black_elo")
    sinks.write_table(src, path, "csv")
    back = archives.read_positions(spark, path)
    return back.select("game_id", F.col("white_elo").cast("bigint").alias("white_elo"),
                       F.col("black_elo").cast("bigint").alias("black_elo"))


@query("position_slice", f"""
WITH {GAMES}, r AS (SELECT game_id, row_number() OVER (ORDER BY white_elo % 2, game_id) - 1 AS place
  FROM games) SELECT CAST(game_id AS STRING) AS game_id FROM r WHERE place >= 1500 AND place < 4000""")
def position_slice(spark, sf):
    """A slice over two files, the second of which is the larger."""
    path = new_path(spark, "slices")
    src = games(spark, sf).select(
        "game_id", F.lit(14).alias("ply"), F.lit("8/8/8/8/8/8/8/8 w - - 0 1").alias("fen"),
        F.lit("e2e4").alias("played_move"), "white_elo", "black_elo")
    for half in (0, 1):
        sinks.write_table(src.where(F.col("white_elo") % 2 == half).orderBy("game_id"),
                          f"{path}/{half}", "csv")
    return archives.read_positions(spark, f"{path}/*/*.csv", 1500, 2500).select("game_id")


@query("read_tagged", """
WITH t AS (SELECT doc_id, unnest([lang, source]) AS tag FROM documents WHERE doc_id % 10 <> 0)
SELECT tag, count(*) AS n FROM t GROUP BY tag""")
def read_tagged(spark, sf):
    path = new_path(spark, "tagged")
    docs = read(spark, sf, "documents")
    full = F.concat_ws(",", F.col("doc_id").cast("string"), F.lit("fen"), F.lit("m1 m2"),
                       *[F.lit("x")] * 4, F.concat_ws(" ", "lang", "source"))
    short = F.concat_ws(",", F.col("doc_id").cast("string"), F.lit("fen"))
    lines = docs.select(F.when(F.col("doc_id") % 10 == 0, short).otherwise(full).alias(
        "id,fen,moves,a,b,c,d,tags"))
    lines.write.option("header", True).option("quoteAll", False).option("sep", "\t").csv(path)
    items = archives.read_tagged(spark, path)
    return items.select(F.explode("tags").alias("tag")).groupBy("tag").agg(
        F.count("*").alias("n"))


@query("concept_documents", f"""
WITH {MASTER}, r AS (SELECT item_key, best, p4, row_number() OVER (PARTITION BY best
  ORDER BY md5(concat('3:', item_key)), item_key) AS pos FROM master WHERE hard_core)
SELECT best AS label, CASE WHEN pos <= 4 THEN 'study' ELSE 'drill' END AS slot,
 CASE WHEN pos <= 4 THEN pos - 1 ELSE pos - 5 END AS idx, item_key AS fen,
 round(p4, 6) AS p_best FROM r WHERE pos <= 16""")
def concept_documents(spark, sf):
    now = sm.curriculum(master(spark, sf).where("hard_core"), "best", "item_key", 3)
    docs = sm.curriculum_documents(now.select(
        "best", "slot", "idx", F.col("item_key").alias("fen"), F.col("p4").alias("p_best")),
        "best", ["fen", "p_best"]).withColumnRenamed("best", "label")
    path = new_path(spark, "concepts")
    sinks.write_docs(docs, path)
    items = sinks.course_items(sinks.read_concepts(spark, path), "label")
    return items.select("label", "slot", F.col("idx").cast("bigint").alias("idx"), "fen",
                        rounded("p_best").alias("p_best"))


@query("rewrite_with_map", f"""
WITH {EVALS}, amap AS (SELECT item_key, min(game_id) AS game_id FROM evals GROUP BY item_key
  HAVING count(DISTINCT game_id) = 1), raw AS (SELECT item_key, ply, CASE WHEN batch % 2 = 0
  THEN '?' ELSE CAST(game_id AS STRING) END AS gid FROM evals)
SELECT coalesce(CAST(a.game_id AS STRING), r.gid) AS gid, count(*) AS n FROM raw r
LEFT JOIN amap a ON a.item_key = r.item_key GROUP BY 1""")
def rewrite_with_map(spark, sf):
    src = evals(spark, sf)
    path = new_path(spark, "rewrite")
    src.select("item_key", "ply", F.when(F.col("batch") % 2 == 0, "?").otherwise(
        F.col("game_id").cast("string")).alias("gid")).write.parquet(path)
    mapping = joins.unambiguous_map(src, "item_key", "game_id").select(
        "item_key", F.col("game_id").cast("string").alias("gid"))
    sinks.rewrite_with_map(spark, path, mapping, "item_key", "gid")
    return spark.read.parquet(path).groupBy("gid").agg(F.count("*").alias("n"))


@query("live_rewrite", f"""
WITH {EVALS}, amap AS (SELECT item_key, min(game_id) AS game_id FROM evals GROUP BY item_key
  HAVING count(DISTINCT game_id) = 1), raw AS (SELECT item_key, min(CASE WHEN batch % 2 = 0
  THEN '?' ELSE CAST(game_id AS STRING) END) AS gid FROM evals GROUP BY item_key),
 t AS (SELECT r.gid AS old, coalesce(CAST(a.game_id AS STRING), r.gid) AS new FROM raw r
  LEFT JOIN amap a ON a.item_key = r.item_key)
SELECT version, gid, n FROM (SELECT 'before' AS version, old AS gid, count(*) AS n FROM t GROUP BY 2
 UNION ALL SELECT 'after', new, count(*) FROM t GROUP BY 2)""")
def live_rewrite(spark, sf):
    """A table filled in two appends of which the second repeats rows, before and after a rewrite."""
    src = evals(spark, sf)
    rows = src.groupBy("item_key").agg(F.min(F.when(F.col("batch") % 2 == 0, "?").otherwise(
        F.col("game_id").cast("string"))).alias("gid"))
    table = LiveTable(spark, new_path(spark, "live"), "item_key")
    table.append_new(rows.where("gid = '?'"))
    table.append_new(rows)
    mapping = joins.unambiguous_map(src, "item_key", "game_id").select(
        "item_key", F.col("game_id").cast("string").alias("gid"))
    version = table.versions()[-1]
    table.rewrite_with_map(mapping, "item_key", "gid")
    parts = [table.read(version=v).groupBy("gid").agg(F.count("*").alias("n")).withColumn(
        "version", F.lit(name)) for v, name in ((version, "before"), (None, "after"))]
    return parts[0].unionByName(parts[1])


@query("studied_latest", f"""
WITH {ATTEMPTS} SELECT code, concept, max(id) AS last_id FROM attempts
WHERE event_type = 'signup' GROUP BY code, concept""")
def studied_latest(spark, sf):
    path = new_path(spark, "studied")
    marks = attempts(spark, sf).where("event_type = 'signup'").select(
        "code", "concept", F.col("id").alias("last_id"))
    for part in (marks.where("last_id % 2 = 0"), marks.where("last_id % 2 = 1")):
        sinks.upsert(part, path)
    packed = sinks.compact(spark, path, ["code", "concept"], "last_id", new_path(spark, "compact"))
    return spark.read.parquet(packed)


@query("mine_stream", f"""
WITH {MASTER} SELECT flagged, count(*) AS n, count(DISTINCT item_key) AS keys FROM master
GROUP BY flagged""")
def mine_stream(spark, sf):
    sink = new_path(spark, "mined")
    stream = select_stream(spark, sf, "lineitem")
    jobs.mine_stream(stream, sink, "item_key", arrival(),
                     lambda b: rows.flag_disagreement(b, LEVELS)).awaitTermination()
    return LiveTable(spark, sink, "item_key").read().groupBy("flagged").agg(
        F.count("*").alias("n"), F.countDistinct("item_key").alias("keys"))


def _counters(spark, sf):
    sink = new_path(spark, "progress")
    jobs.progress_stream(select_stream(spark, sf, "events"), sink).awaitTermination()
    return jobs.item_counters(spark, sink)


@query("progress_stream", f"""
WITH {ATTEMPTS} SELECT code, concept, count(DISTINCT idx) AS n, sum(correct)::BIGINT AS correct,
 count(*) AS tries FROM attempts GROUP BY code, concept""")
def progress_stream(spark, sf):
    return jobs.live_progress(_counters(spark, sf))


@query("totals_stream", f"""
WITH {ATTEMPTS} SELECT count(*) AS attempts, sum(correct)::BIGINT AS correct FROM attempts""")
def totals_stream(spark, sf):
    return jobs.live_totals(_counters(spark, sf))


@query("studied_stream", f"""
WITH {ATTEMPTS} SELECT code, concept, max(id) AS id FROM attempts WHERE event_type = 'signup'
GROUP BY code, concept""")
def studied_stream(spark, sf):
    sink = new_path(spark, "keyed")
    marks = select_stream(spark, sf, "events").where("event_type = 'signup'").select(
        "code", "concept", "id")
    jobs.keyed_stream(marks, sink, ["code", "concept"], "id").awaitTermination()
    return sinks.latest(spark.read.parquet(sink), ["code", "concept"], "id")


@query("quota_stream", f"""
WITH {GAMES}, b AS (SELECT game_id, seq, CASE
  WHEN white_elo BETWEEN 2000 AND 2199 AND black_elo BETWEEN 2000 AND 2199 THEN '2000-2200'
  WHEN white_elo BETWEEN 2200 AND 2399 AND black_elo BETWEEN 2200 AND 2399 THEN '2200-2400'
  END AS band FROM games), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY seq)
  AS rn FROM b WHERE band IS NOT NULL)
SELECT game_id, band FROM r WHERE rn <= CASE band WHEN '2000-2200' THEN 60 ELSE 40 END""")
def quota_stream(spark, sf):
    path = new_path(spark, "quota")
    stream = select_stream(spark, sf, "orders")
    tagged = stream.select("game_id", "seq", joins.assign_band(
        CLUB_QUOTAS, "white_elo", "black_elo").alias("band")).where("band is not null")
    sink = jobs.QuotaSink(spark, path, CLUB_QUOTAS, "game_id", "seq")
    jobs.quota_stream(tagged, sink)
    return spark.read.parquet(path).select("game_id", "band")
