"""Ranking, quota, split and sampling queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.functions.measures import rounded
from crowdgap.operators import joins, ranking, rows
from crowdgap.operators import sampling as sm
from crowdgap.plans.bindings import (
    EVALS, GAMES, MASTER, evals, games, master, read)
from crowdgap.plans.queries_joins import CLUB_QUOTAS, TOP_QUOTAS
from crowdgap.plans.registry import query


@query("top_per_group", f"""
WITH {MASTER}, r AS (SELECT batch, item_key, cost, row_number() OVER (PARTITION BY batch
  ORDER BY cost DESC NULLS LAST, item_key) AS rn FROM master)
SELECT batch, item_key, round(cost, 6) AS cost, rn FROM r WHERE rn <= 4""")
def top_per_group(spark, sf):
    out = ranking.top_per_group(master(spark, sf), ["batch"],
                                [F.col("cost").desc_nulls_last(), "item_key"], 4)
    return out.select("batch", "item_key", rounded("cost").alias("cost"),
                      F.col("rn").cast("bigint").alias("rn"))


_OPTIONS_SQL = """opts AS (SELECT l_orderkey AS item, CAST(l_partkey AS STRING) AS opt,
  max(l_tax + l_discount / 10) AS p FROM lineitem GROUP BY ALL)"""


def _options(spark, sf):
    return read(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("item"), F.col("l_partkey").cast("string").alias("opt")).agg(
        F.max(F.col("l_tax") + F.col("l_discount") / 10).alias("p"))


@query("target_rank", f"""
WITH {_OPTIONS_SQL}, r AS (SELECT item, opt, row_number() OVER (PARTITION BY item
  ORDER BY p DESC, opt) AS rank FROM opts)
SELECT item, min(CASE WHEN CAST(opt AS BIGINT) % 7 = 0 THEN rank END) AS rank FROM r
WHERE rank <= 5 GROUP BY item""")
def target_rank(spark, sf):
    hit = F.col("opt").cast("bigint") % 7 == 0
    return ranking.target_ranks(_options(spark, sf), ["item"], [F.col("p").desc(), "opt"], hit,
                                5).select("item", F.col("rank").cast("bigint").alias("rank"))


@query("top_options", f"""
WITH {_OPTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item
  ORDER BY p DESC, opt) AS rank FROM opts)
SELECT item, string_agg(concat(opt, ':', printf('%.3f', p)), ' ' ORDER BY rank) AS text
FROM r WHERE rank <= 3 GROUP BY item""")
def top_options(spark, sf):
    return ranking.top_options(_options(spark, sf), ["item"], "opt", "p", 3).select(
        "item", "text")


@query("favourite", f"""
WITH {_OPTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item
  ORDER BY p DESC, opt) AS rank FROM opts)
SELECT item, opt, round(p, 6) AS p FROM r WHERE rank = 1""")
def favourite(spark, sf):
    return ranking.favourite(_options(spark, sf), ["item"], "opt", "p").withColumn(
        "p", rounded("p"))


@query("quota_groups", f"""
WITH {GAMES}, ok AS (SELECT game_id, seq, CASE
  WHEN white_elo BETWEEN 2000 AND 2199 AND black_elo BETWEEN 2000 AND 2199 THEN '2000-2200'
  WHEN white_elo BETWEEN 2200 AND 2399 AND black_elo BETWEEN 2200 AND 2399 THEN '2200-2400'
  END AS band FROM games WHERE try_cast(split_part(time_control, '+', 1) AS INT) >= 600
  AND (termination IS NULL OR termination <> 'Abandoned') AND game_id NOT IN (
   SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)),
 r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY seq) AS arrival FROM ok
  WHERE band IS NOT NULL)
SELECT game_id, band, arrival FROM r
WHERE arrival <= CASE band WHEN '2000-2200' THEN 970 ELSE 1440 END""")
def quota_groups(spark, sf):
    """Known groups are left out before anything is counted."""
    ok = rows.eligible_games(games(spark, sf), 0, 600, "white_elo", "black_elo")
    known = read(spark, sf, "lineitem").where("l_linenumber = 7").select(
        F.col("l_orderkey").alias("game_id"))
    quotas = [replace(q, want=n) for q, n in zip(CLUB_QUOTAS, (970, 1440))]
    band = joins.assign_band(quotas, "white_elo", "black_elo")
    return sm.quota_groups(joins.exclude(ok, known, "game_id"), band, quotas, "seq").select(
        "game_id", "band", F.col("arrival").cast("bigint").alias("arrival"))


_OFFERS = f"""{GAMES}, offers AS (SELECT g.game_id, g.seq, g.white_elo, g.black_elo,
  count(CASE WHEN l_linenumber % 2 = 1 THEN 1 END) AS nw,
  count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS nb
  FROM games g JOIN lineitem l ON l.l_orderkey = g.game_id GROUP BY ALL)"""


def _offers(spark, sf):
    counts = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(
        F.count_if(F.col("l_linenumber") % 2 == 1).alias("nw"),
        F.count_if(F.col("l_linenumber") % 2 == 0).alias("nb"))
    return games(spark, sf).select("game_id", "seq", "white_elo", "black_elo").join(
        counts, "game_id")


@query("quota_rows", f"""
WITH {_OFFERS}, a AS (SELECT *, CASE WHEN white_elo >= 2800 THEN 'w' ELSE 'b' END AS side
  FROM offers WHERE white_elo >= 2800 OR black_elo >= 2800),
 a2 AS (SELECT *, CASE side WHEN 'w' THEN nw ELSE nb END AS rows FROM a),
 a3 AS (SELECT *, coalesce(sum(rows) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS prior FROM a2),
 b AS (SELECT *, CASE WHEN white_elo BETWEEN 2600 AND 2799 THEN 'w' ELSE 'b' END AS side
  FROM offers WHERE (white_elo BETWEEN 2600 AND 2799 OR black_elo BETWEEN 2600 AND 2799)
  AND game_id NOT IN (SELECT game_id FROM a3 WHERE prior < 3000)),
 b2 AS (SELECT *, CASE side WHEN 'w' THEN nw ELSE nb END AS rows FROM b),
 b3 AS (SELECT *, coalesce(sum(rows) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS prior FROM b2)
SELECT game_id, '2800+' AS band, side, rows, prior::BIGINT AS prior_rows FROM a3
WHERE prior < 3000 AND rows > 0 UNION ALL
SELECT game_id, '2600-2800', side, rows, prior::BIGINT FROM b3 WHERE prior < 2000 AND rows > 0""")
def quota_rows(spark, sf):
    return sm.quota_rows(_offers(spark, sf), TOP_QUOTAS, "seq", "white_elo", "black_elo",
                         "nw", "nb").select("game_id", "band", "side", "rows", "prior_rows")


@query("number_groups", f"""
WITH {GAMES} SELECT game_id, concat('e', row_number() OVER (ORDER BY seq)) AS gid
FROM games WHERE try_cast(coalesce(white_tag, '0') AS INT) IS NOT NULL""")
def number_groups(spark, sf):
    kept = rows.eligible_games(games(spark, sf), min_elo=None, white="white_tag",
                               black="black_tag")
    return sm.number_groups(kept.select("game_id", "seq"), "seq", "e").select("game_id", "gid")


@query("disjoint_sets", f"""
WITH {MASTER}, r AS (SELECT item_key, best, row_number() OVER (PARTITION BY best
  ORDER BY md5(concat('42:', item_key)), item_key) AS pos FROM master WHERE flagged)
SELECT best, item_key, pos, CASE WHEN pos <= 10 THEN 'baseline' WHEN pos <= 18 THEN 'study'
  ELSE 'retest' END AS set FROM r WHERE pos <= 28""")
def disjoint_sets(spark, sf):
    out = sm.disjoint_sets(master(spark, sf).where("flagged"), ["best"], "item_key",
                           {"baseline": 10, "study": 8, "retest": 10}, 42)
    return out.select("best", "item_key", F.col("pos").cast("bigint").alias("pos"), "set")


@query("sample_groups", f"""
WITH {EVALS}, s AS (SELECT game_id, count(*) AS n_rows, md5(concat('100:', game_id)) AS h
  FROM evals GROUP BY game_id),
 r AS (SELECT *, coalesce(sum(n_rows) OVER (ORDER BY h, game_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS prior FROM s)
SELECT game_id, n_rows, prior::BIGINT AS prior_rows FROM r WHERE prior < 5000""")
def sample_groups(spark, sf):
    return sm.sample_groups(evals(spark, sf), "game_id", 5000, 100)


@query("group_holdout", f"""
WITH {EVALS}, g AS (SELECT DISTINCT game_id FROM evals), r AS (SELECT game_id, row_number() OVER
  (ORDER BY md5(concat('0:', game_id)), game_id) AS rank, count(*) OVER () AS n FROM g)
SELECT game_id, rank <= floor(0.2 * n) AS is_test FROM r""")
def group_holdout(spark, sf):
    return sm.group_holdout(evals(spark, sf), "game_id", 0.2, 0)


@query("group_folds", f"""
WITH {EVALS}, s AS (SELECT game_id, count(*) AS n_rows FROM evals GROUP BY game_id),
 r AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, md5(concat('0:', game_id)), game_id)
  - 1 AS place FROM s)
SELECT game_id, n_rows, CASE WHEN (place // 5) % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END
  AS fold FROM r""")
def group_folds(spark, sf):
    return sm.group_folds(evals(spark, sf), "game_id", 5)


@query("hash_folds", f"""
WITH {EVALS} SELECT CAST(concat('0x', substr(md5(concat('0:', game_id)), 1, 8)) AS BIGINT) % 5
  AS fold, count(*) AS n, count(DISTINCT game_id) AS groups FROM evals GROUP BY 1""")
def hash_folds(spark, sf):
    return evals(spark, sf).groupBy(sm.hash_fold("game_id", 5).alias("fold")).agg(
        F.count("*").alias("n"), F.countDistinct("game_id").alias("groups"))


@query("strat_folds", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
  ORDER BY md5(concat('0:', doc_id)), doc_id) AS rank FROM labels)
SELECT doc_id, quality, (rank - 1) % 5 AS fold FROM r""")
def strat_folds(spark, sf):
    return sm.strat_folds(read(spark, sf, "labels"), "quality", "doc_id", 5, 0).select(
        "doc_id", "quality", "fold")


@query("top2_margin", f"""
WITH {_OPTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item
  ORDER BY p DESC, opt) AS rn FROM opts)
SELECT item, max(CASE WHEN rn = 1 THEN opt END) AS opt,
 round(max(CASE WHEN rn = 1 THEN p END), 6) AS sim,
 round(max(CASE WHEN rn = 2 THEN p END), 6) AS second,
 round(max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END), 6) AS margin
FROM r WHERE rn <= 2 GROUP BY item""")
def top2_margin(spark, sf):
    return ranking.top2_margin(_options(spark, sf), ["item"], "opt", "p").withColumns(
        {c: rounded(c) for c in ("sim", "second", "margin")})


@query("curve_delta", f"""
WITH {MASTER}, c AS (SELECT batch, avg(found::INT) AS v FROM master GROUP BY batch)
SELECT batch, round(v, 6) AS v, round(v - lag(v) OVER (ORDER BY batch), 6) AS delta FROM c""")
def curve_delta(spark, sf):
    c = master(spark, sf).groupBy("batch").agg(m.mean_of("found").alias("v"))
    return ranking.curve_delta(c, "batch", "v").withColumns(
        {"v": rounded("v"), "delta": rounded("delta")})


@query("curriculum", f"""
WITH {MASTER}, e AS (SELECT item_key, best FROM master WHERE flagged AND NOT found),
 r AS (SELECT *, row_number() OVER (PARTITION BY best ORDER BY md5(concat('3:', item_key)),
  item_key) AS pos FROM e)
SELECT best, item_key, CASE WHEN pos <= 4 THEN 'study' ELSE 'drill' END AS slot,
 CASE WHEN pos <= 4 THEN pos - 1 ELSE pos - 5 END AS idx FROM r WHERE pos <= 16""")
def curriculum(spark, sf):
    pool = master(spark, sf).where("hard_core")
    return sm.curriculum(pool, "best", "item_key", 3).select("best", "item_key", "slot", "idx")


@query("curriculum_extended", f"""
WITH {MASTER}, r AS (SELECT item_key, best, row_number() OVER (PARTITION BY best
  ORDER BY md5(concat('3:', item_key)), item_key) AS pos FROM master WHERE hard_core),
 cur AS (SELECT * FROM r WHERE pos <= 16), f AS (SELECT item_key, best, row_number() OVER (
  PARTITION BY best ORDER BY md5(concat('11:', item_key)), item_key) AS pos FROM master
  WHERE flagged AND p1 >= 0.005::DOUBLE AND item_key NOT IN (SELECT item_key FROM cur)),
 have AS (SELECT best, count(*) AS have FROM cur WHERE pos > 4 GROUP BY best)
SELECT f.best, f.item_key, 'drill' AS slot, 'extension' AS batch,
 coalesce(have, 0) + pos - 1 AS idx FROM f LEFT JOIN have h ON h.best = f.best WHERE pos <= 24""")
def curriculum_extended(spark, sf):
    items = master(spark, sf)
    now = sm.curriculum(items.where("hard_core"), "best", "item_key", 3)
    pool = items.where("flagged").select("best", "item_key", "p1")
    return sm.extend_curriculum(now, pool, "best", "item_key", 11, min_margin=0.005,
                                margin="p1").select("best", "item_key", "slot", "batch", "idx")


@query("curriculum_documents", f"""
WITH {MASTER}, r AS (SELECT item_key, best, row_number() OVER (PARTITION BY best
  ORDER BY md5(concat('3:', item_key)), item_key) AS pos FROM master WHERE hard_core)
SELECT best, string_agg(item_key, ' ' ORDER BY pos) FILTER (pos <= 4) AS study,
 string_agg(item_key, ' ' ORDER BY pos) FILTER (pos > 4) AS drill
FROM r WHERE pos <= 16 GROUP BY best""")
def curriculum_documents(spark, sf):
    now = sm.curriculum(master(spark, sf).where("hard_core"), "best", "item_key", 3)
    docs = sm.curriculum_documents(now, "best", ["item_key"])
    return docs.select("best", F.array_join("study.item_key", " ").alias("study"),
                       F.array_join("drill.item_key", " ").alias("drill"))


@query("first_eligible", f"""
WITH {GAMES} SELECT game_id FROM games WHERE white_elo >= 2400 ORDER BY seq LIMIT 300""")
def first_eligible(spark, sf):
    return sm.first_eligible(games(spark, sf).where("white_elo >= 2400"), "seq", 300).select(
        "game_id")


@query("sample_n", f"""
WITH {MASTER} SELECT item_key FROM master WHERE NOT flagged
ORDER BY md5(concat('0:', item_key)), item_key LIMIT 400""")
def sample_n(spark, sf):
    return sm.sample_n(master(spark, sf).where("not flagged").select("item_key"), "item_key",
                       400, 0)


@query("interleave", f"""
WITH {MASTER}, r AS (SELECT item_key, best, row_number() OVER (PARTITION BY best
  ORDER BY md5(concat('42:', item_key)), item_key) AS pos FROM master WHERE flagged)
SELECT best, item_key FROM r WHERE pos <= 10 ORDER BY md5(concat('7:', item_key)), item_key
LIMIT 10""")
def interleave(spark, sf):
    base = sm.disjoint_sets(master(spark, sf).where("flagged"), ["best"], "item_key",
                            {"baseline": 10}, 42)
    return sm.interleave(base.select("best", "item_key"), "item_key", 10, 7)


@query("quota_per_tag", """
WITH t AS (SELECT doc_id, unnest([lang, source, concat('n', n_chars % 5)]) AS tag FROM documents),
 r AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY tag ORDER BY doc_id) AS arrival FROM t
  WHERE tag IN ('en', 'fr', 'src1', 'src3', 'n2')),
 b AS (SELECT doc_id, 'baseline' AS tag, row_number() OVER (ORDER BY doc_id) AS arrival
  FROM documents)
SELECT * FROM r WHERE arrival <= 150 UNION ALL SELECT * FROM b WHERE arrival <= 400""")
def quota_per_tag(spark, sf):
    src = read(spark, sf, "documents").select("doc_id", F.array(
        "lang", "source", F.concat(F.lit("n"), (F.col("n_chars") % 5).cast("string"))
    ).alias("tags"))
    return sm.quota_per_tag(src, "tags", "doc_id", ["en", "fr", "src1", "src3", "n2"]).select(
        "doc_id", "tag", F.col("arrival").cast("bigint").alias("arrival"))


@query("prototypes_pct", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.975) AS cut FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS score FROM lineitem, q
WHERE l_extendedprice >= cut""")
def prototypes_pct(spark, sf):
    src = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             F.col("l_extendedprice").alias("score"))
    return ranking.prototypes(src, "score", "l_orderkey", pct=2.5).withColumn(
        "score", rounded("score"))


@query("prototypes_top8", f"""
WITH {MASTER} SELECT item_key, round(best_cp, 6) AS best_cp FROM master
ORDER BY master.best_cp DESC, item_key LIMIT 8""")
def prototypes_top8(spark, sf):
    return ranking.prototypes(master(spark, sf).select("item_key", "best_cp"), "best_cp",
                              "item_key", n=8).withColumn("best_cp", rounded("best_cp"))


@query("best_by", f"""
WITH {MASTER}, v AS (SELECT batch, avg(found::INT) AS rate FROM master GROUP BY batch)
SELECT batch, round(rate, 6) AS rate FROM v ORDER BY v.rate DESC, batch LIMIT 1""")
def best_by(spark, sf):
    v = master(spark, sf).groupBy("batch").agg(m.mean_of("found").alias("rate"))
    return ranking.best_by(v, "batch", "rate").withColumn("rate", rounded("rate"))
