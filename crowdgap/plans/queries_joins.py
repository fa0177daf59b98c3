"""Join and set queries."""

from pyspark.sql import functions as F

from crowdgap.operators import joins
from crowdgap.operators.joins import Quota
from crowdgap.operators.ordering import dedupe
from crowdgap.plans.bindings import (
    ATTEMPTS, EVALS, GAMES, MASTER, arrival, attempts, evals, games, master, read)
from crowdgap.plans.registry import query

# closed ranges, both players inside
CLUB_QUOTAS = [Quota("2000-2200", 2000, 2199, 60), Quota("2200-2400", 2200, 2399, 40)]
# preference order: the scarcer band first
TOP_QUOTAS = [Quota("2800+", 2800, 9999, 3000), Quota("2600-2800", 2600, 2799, 2000)]


@query("priority_ratings", """
WITH src AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS r,
  1 AS prio FROM customer UNION ALL
 SELECT o_custkey, min(o_totalprice), 2 FROM orders GROUP BY o_custkey),
 pick AS (SELECT k, r, row_number() OVER (PARTITION BY k ORDER BY prio) AS rn
  FROM src WHERE r IS NOT NULL)
SELECT c.c_custkey AS k, round(p.r, 6) + 0.0 AS r FROM customer c LEFT JOIN pick p
 ON p.k = c.c_custkey AND p.rn = 1""")
def priority_ratings(spark, sf):
    cust = read(spark, sf, "customer")
    first = cust.select(F.col("c_custkey").alias("k"),
                        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("r"))
    second = (read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"))
              .agg(F.min("o_totalprice").alias("r")))
    best = joins.first_of([first, second], "k", "r", ["r"])
    keys = cust.select(F.col("c_custkey").alias("k"))
    return joins.attach_ratings(keys, best, "k").select(
        "k", (F.round("r", 6) + F.lit(0.0)).alias("r"))


_AMBIGUOUS = f"""{EVALS}, amap AS (SELECT item_key, min(game_id) AS game_id FROM evals
  GROUP BY item_key HAVING count(DISTINCT game_id) = 1)"""


@query("unambiguous_map", f"WITH {_AMBIGUOUS} SELECT item_key, game_id FROM amap")
def unambiguous_map(spark, sf):
    return joins.unambiguous_map(evals(spark, sf), "item_key", "game_id")


@query("repair_ids", f"""
WITH {_AMBIGUOUS}, raw AS (SELECT item_key, ply, batch,
  CASE WHEN batch % 2 = 0 THEN '?' ELSE CAST(game_id AS STRING) END AS gid FROM evals)
SELECT r.item_key, r.ply, r.batch, CASE WHEN r.gid <> '?' THEN r.gid
  ELSE coalesce(CAST(a.game_id AS STRING), concat('orph_', md5(r.item_key))) END AS gid
FROM raw r LEFT JOIN amap a ON a.item_key = r.item_key""")
def repair_ids(spark, sf):
    src = evals(spark, sf)
    known = joins.unambiguous_map(src, "item_key", "game_id").select(
        "item_key", F.col("game_id").cast("string").alias("gid"))
    raw = src.select("item_key", "ply", "batch", F.when(F.col("batch") % 2 == 0, "?").otherwise(
        F.col("game_id").cast("string")).alias("gid"))
    return joins.repair_ids(raw, known, "item_key", "gid")


@query("exclude_known", f"""
WITH {EVALS} SELECT item_key, game_id, ply FROM evals e WHERE NOT EXISTS
 (SELECT 1 FROM orders o WHERE o.o_orderkey = e.game_id AND o.o_orderstatus = 'F')""")
def exclude_known(spark, sf):
    done = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("game_id"))
    return joins.exclude(evals(spark, sf), done, "game_id").select("item_key", "game_id", "ply")


@query("keep_groups", f"""
WITH {EVALS} SELECT game_id, count(*) AS n FROM evals e WHERE EXISTS
 (SELECT 1 FROM orders o WHERE o.o_orderkey = e.game_id AND o.o_orderpriority = '1-URGENT')
GROUP BY game_id""")
def keep_groups(spark, sf):
    kept = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("game_id"))
    return (joins.keep_groups(evals(spark, sf), kept, "game_id").groupBy("game_id")
            .agg(F.count("*").alias("n")))


@query("new_only", f"""
WITH {EVALS}, n AS (SELECT item_key, game_id, ply, batch, row_number() OVER (PARTITION BY item_key
  ORDER BY batch, game_id, ply) AS rn FROM evals WHERE item_key NOT IN
  (SELECT item_key FROM evals WHERE batch < 1996))
SELECT item_key, game_id, ply, batch FROM n WHERE rn = 1""")
def new_only(spark, sf):
    src = evals(spark, sf)
    return joins.new_only(src, src.where("batch < 1996"), "item_key",
                          ["batch", "game_id", "ply"]).select("item_key", "game_id", "ply",
                                                              "batch")


@query("dedupe_first", f"""
WITH {MASTER} SELECT item_key, game_id, ply, batch, picked, round(best_cp, 6) + 0.0 AS best_cp
FROM deduped""")
def dedupe_first(spark, sf):
    return dedupe(evals(spark, sf), "item_key", arrival()).select(
        "item_key", "game_id", "ply", "batch", "picked",
        (F.round("best_cp", 6) + F.lit(0.0)).alias("best_cp"))


@query("set_overlaps", f"""
WITH {EVALS}, s AS (SELECT item_key, batch % 3 AS s FROM evals)
SELECT item_key, min(s) AS first_set, max(s) AS last_set FROM s GROUP BY item_key
HAVING min(s) < max(s)""")
def set_overlaps(spark, sf):
    src = evals(spark, sf)
    return joins.overlaps([src.where(F.col("batch") % 3 == i) for i in range(3)], "item_key")


@query("union_batches", f"""
WITH {EVALS} SELECT batch, count(*) AS n, count(second_cp) AS n_second, count(cost) AS n_cost
FROM evals GROUP BY batch""")
def union_batches(spark, sf):
    src = evals(spark, sf)
    early = src.where("batch < 1998").select("batch", "second_cp", "cost")
    late = src.where("batch >= 1998").select("cost", "second_cp", "batch")
    return joins.union_batches([early, late]).groupBy("batch").agg(
        F.count("*").alias("n"), F.count("second_cp").alias("n_second"),
        F.count("cost").alias("n_cost"))


_OPTION = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("prob_lookup", """
WITH a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  event_id % 10 AS pick, value FROM events)
SELECT event_id, round(CASE WHEN pick = k % 10 THEN value / 500 WHEN pick = (k + 1) % 10
  THEN value / 1000 ELSE 0.0 END, 6) + 0.0 AS p FROM a""")
def prob_lookup(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    src = read(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 10).cast("string").alias("pick"),
        F.array(F.struct((k % 10).cast("string").alias("uci"), (F.col("value") / 500).alias("p")),
                F.struct(((k + 1) % 10).cast("string").alias("uci"),
                         (F.col("value") / 1000).alias("p"))).alias("human"))
    return joins.lookup_prob(src, "human", "pick").select(
        "event_id", (F.round("p", 6) + F.lit(0.0)).alias("p"))


@query("attach_vectors", """
SELECT d.doc_id, d.lang, len(e.embedding) AS dim FROM documents d
JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""")
def attach_vectors(spark, sf):
    vec = read(spark, sf, "embeddings")
    n = vec.count()
    docs = read(spark, sf, "documents").select(
        "doc_id", "lang", (F.col("doc_id") % n).alias("vec_id"))
    return joins.attach_vectors(docs, vec, "vec_id").select(
        "doc_id", "lang", F.size("embedding").cast("bigint").alias("dim"))


@query("score_lookup", f"""
WITH {MASTER} SELECT l.l_orderkey AS game_id, count(*) AS items,
  count(m.item_key) AS hits, count(*) - count(m.item_key) AS misses
FROM (SELECT l_orderkey, concat_ws('-', CAST(l_partkey AS STRING),
   CAST(l_suppkey + l_linenumber % 2 AS STRING)) AS k FROM lineitem) l
LEFT JOIN master m ON m.item_key = l.k GROUP BY 1""")
def score_lookup(spark, sf):
    items = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.concat_ws(
            "-", F.col("l_partkey").cast("string"),
            (F.col("l_suppkey") + F.col("l_linenumber") % 2).cast("string")).alias("item_key"))
    scored = joins.score_lookup(items, evals(spark, sf), "item_key", ["p1"], arrival())
    return scored.groupBy("game_id").agg(
        F.count("*").alias("items"), F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"))


@query("assign_band_range", f"""
WITH {GAMES} SELECT game_id, CASE
  WHEN white_elo BETWEEN 2000 AND 2199 AND black_elo BETWEEN 2000 AND 2199 THEN '2000-2200'
  WHEN white_elo BETWEEN 2200 AND 2399 AND black_elo BETWEEN 2200 AND 2399 THEN '2200-2400'
  END AS band FROM games""")
def assign_band_range(spark, sf):
    return games(spark, sf).select(
        "game_id", joins.assign_band(CLUB_QUOTAS, "white_elo", "black_elo").alias("band"))


@query("assign_band_either", f"""
WITH {GAMES}, b AS (SELECT game_id, CASE WHEN white_elo >= 2800 THEN '2800+w'
  WHEN black_elo >= 2800 THEN '2800+b' WHEN white_elo BETWEEN 2600 AND 2799 THEN '2600-2800w'
  WHEN black_elo BETWEEN 2600 AND 2799 THEN '2600-2800b' END AS x FROM games)
SELECT game_id, left(x, length(x) - 1) AS band, right(x, 1) AS side FROM b WHERE x IS NOT NULL""")
def assign_band_either(spark, sf):
    pick = joins.assign_band_either(TOP_QUOTAS, "white_elo", "black_elo")
    return (games(spark, sf).withColumn("s", pick).where("s is not null")
            .select("game_id", "s.band", "s.side"))


@query("grade_answers", f"""
WITH {ATTEMPTS}, quiz AS (SELECT l_orderkey % 97 AS item, min(l_returnflag) AS best FROM lineitem
  GROUP BY 1)
SELECT a.concept, count(*) AS n, sum((CASE WHEN a.id % 3 = 0 THEN 'A' ELSE 'N' END = q.best)::INT)
  ::BIGINT AS score, round(avg((CASE WHEN a.id % 3 = 0 THEN 'A' ELSE 'N' END = q.best)::INT), 6)
  + 0.0 AS share FROM attempts a JOIN quiz q ON q.item = a.id % 97 GROUP BY a.concept""")
def grade_answers(spark, sf):
    from crowdgap.operators.aggregates import quiz_score
    quiz = (read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("item"))
            .agg(F.min("l_returnflag").alias("best")))
    answers = attempts(spark, sf).select(
        "concept", (F.col("id") % 97).alias("item"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("picked"))
    return quiz_score(joins.grade(answers, quiz, "item"), ["concept"])


@query("header_tags", r"""
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset,
  regexp_extract(html, 'data-nothing="([^"]*)"', 1) AS absent FROM pages""")
def header_tags(spark, sf):
    from crowdgap.sources.archives import with_patterns
    return with_patterns(read(spark, sf, "pages"), "html", {
        "lang": r'<html lang="([^"]*)"', "charset": r'<meta charset="([^"]*)"',
        "absent": r'data-nothing="([^"]*)"'}).select("page_id", "lang", "charset", "absent")


@query("master_items", f"""
WITH {MASTER} SELECT item_key, flagged, found, hard_core, mover_rating, p_max FROM master""")
def master_items(spark, sf):
    return master(spark, sf).select("item_key", "flagged", "found", "hard_core", "mover_rating",
                                    "p_max")
