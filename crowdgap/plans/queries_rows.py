"""Row-level queries."""

from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.functions.measures import rounded
from crowdgap.operators import rows
from crowdgap.operators.aggregates import band_report as report_by_band
from crowdgap.operators.ranking import top_n
from crowdgap.plans.bindings import (
    BANDS_SQL, EVALS, GAMES, LEVELS, MASTER, evals, games, master, read)
from crowdgap.plans.registry import query


@query("band_report", f"""
WITH {MASTER}, {BANDS_SQL}
SELECT b.band_order, b.band,
  round(avg(CASE WHEN NOT flagged THEN found::INT END), 6) + 0.0 AS normal_rate,
  round(avg(CASE WHEN flagged THEN found::INT END), 6) + 0.0 AS flagged_rate,
  count(CASE WHEN NOT flagged THEN 1 END) AS n_normal,
  count(CASE WHEN flagged THEN 1 END) AS n_flagged
FROM bands b LEFT JOIN master m ON m.mover_rating > b.lo AND m.mover_rating <= b.hi
GROUP BY b.band_order, b.band""")
def band_report(spark, sf):
    return report_by_band(master(spark, sf)).withColumns({
        "normal_rate": rounded("normal_rate"), "flagged_rate": rounded("flagged_rate")})


@query("eligible_games", f"""
WITH {GAMES}
SELECT game_id FROM games
WHERE try_cast(coalesce(white_tag, '0') AS INT) >= 1800
  AND try_cast(coalesce(black_tag, '0') AS INT) >= 1800
  AND try_cast(split_part(time_control, '+', 1) AS INT) >= 600
  AND (termination IS NULL OR termination <> 'Abandoned')""")
def eligible_games(spark, sf):
    return rows.eligible_games(games(spark, sf), white="white_tag",
                               black="black_tag").select("game_id")


@query("elite_games", f"""
WITH {GAMES}
SELECT game_id, coalesce(white_tag, '0') AS white_tag FROM games
WHERE try_cast(coalesce(white_tag, '0') AS INT) IS NOT NULL
  AND try_cast(coalesce(black_tag, '0') AS INT) IS NOT NULL""")
def elite_games(spark, sf):
    kept = rows.eligible_games(games(spark, sf), min_elo=None, white="white_tag",
                               black="black_tag")
    return kept.select("game_id", F.coalesce("white_tag", F.lit("0")).alias("white_tag"))


@query("grid_sample", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
WHERE l_linenumber BETWEEN 2 AND 6 AND l_linenumber % 2 = 0
GROUP BY l_orderkey, l_linenumber""")
def grid_sample(spark, sf):
    kept = rows.sample_grid(read(spark, sf, "lineitem"), "l_linenumber", 2, 2, 6)
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("grid_sample_turns", """
SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 9 AND turn % 2 = 0""")
def grid_sample_turns(spark, sf):
    return rows.sample_grid(read(spark, sf, "conversations"), "turn", 2, 1, 9).select(
        "conv_id", "turn", "role")


@query("side_sample", """
SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'assistant'""")
def side_sample(spark, sf):
    return rows.sample_side(read(spark, sf, "conversations"), "role", F.lit("assistant")).select(
        "conv_id", "turn", F.length("text").cast("bigint").alias("chars"))


@query("game_ids", """
SELECT page_id, coalesce(nullif(list_extract(string_split(url, '/'), -1), ''),
  concat('g', page_id)) AS gid FROM pages""")
def game_ids(spark, sf):
    fallback = F.concat(F.lit("g"), F.col("page_id").cast("string"))
    return read(spark, sf, "pages").select("page_id", m.game_id("url", fallback).alias("gid"))


@query("pov_scores", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 10 AS cp,
  CASE WHEN l_linenumber = 7 THEN l_suppkey % 9 - 4 END AS mate,
  CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS sign FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sign * CASE WHEN mate IS NULL THEN cp
  WHEN mate > 0 THEN 2000 - mate ELSE -2000 - mate END, 6) + 0.0 AS score FROM s""")
def pov_scores(spark, sf):
    src = read(spark, sf, "lineitem").withColumns({
        "cp": F.col("l_extendedprice") / 10,
        "mate": F.when(F.col("l_linenumber") == 7, F.col("l_suppkey") % 9 - 4),
        "stm": F.when(F.col("l_linenumber") % 2 == 1, "w").otherwise("b")})
    return src.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      rounded(m.pov_score("cp", "mate", "stm")).alias("score"))


@query("derive_measures", f"""
WITH {EVALS}, c AS (SELECT *, CASE WHEN favourite = best THEN 0.0
  ELSE floor(best_cp) - floor(favourite_cp) END AS raw, greatest(p1, p2, p3, p4) AS pm FROM evals)
SELECT item_key, game_id, ply, round(best_cp - coalesce(second_cp, best_cp), 6) + 0.0
  AS engine_margin, round(raw, 1) + 0.0 AS cost, round(pm, 4) + 0.0 AS p_max,
  round(p4 - p1, 4) + 0.0 AS p_slope,
  coalesce(raw >= 100 AND pm <= 0.05::DOUBLE, false) AS flagged FROM c""")
def derive_measures(spark, sf):
    whole = evals(spark, sf).withColumns({
        "f": F.floor("favourite_cp").cast("double"), "b": F.floor("best_cp").cast("double")})
    out = rows.derive_measures(whole, LEVELS, best_cp="b", favourite_cp="f")
    return out.select(
        "item_key", "game_id", "ply",
        rounded(m.margin("best_cp", "second_cp")).alias("engine_margin"), "cost", "p_max", "p_slope", "flagged")


@query("disagreement_flag", f"""
WITH {EVALS}
SELECT item_key, game_id, ply, batch, coalesce(cost >= 100 AND
  greatest(p1, p2, p3, p4) <= 0.05::DOUBLE, false) AS flagged FROM evals""")
def disagreement_flag(spark, sf):
    return rows.flag_disagreement(evals(spark, sf), LEVELS).select(
        "item_key", "game_id", "ply", "batch", "flagged")


@query("hard_core", f"""
WITH {MASTER} SELECT item_key, game_id, batch, mover_rating, found, hard_core
FROM master WHERE flagged""")
def hard_core(spark, sf):
    return master(spark, sf).where("flagged").select(
        "item_key", "game_id", "batch", "mover_rating", "found", "hard_core")


@query("visibility_strata", f"""
WITH {MASTER}
SELECT CASE WHEN p_max <= 0.05::DOUBLE THEN 'invisible' WHEN p_max >= 0.30::DOUBLE THEN 'visible'
  ELSE 'mid' END AS stratum, count(*) AS n, round(avg(found::INT), 6) + 0.0 AS found_rate
FROM master WHERE cost >= 100 GROUP BY 1""")
def visibility_strata(spark, sf):
    return (master(spark, sf).where(F.col("cost") >= m.GAP)
            .groupBy(m.visibility("p_max").alias("stratum"))
            .agg(F.count("*").alias("n"), rounded(m.mean_of("found")).alias("found_rate")))


@query("starkest_top12", f"""
WITH {MASTER} SELECT item_key, round(cost - 1000 * p_max, 6) + 0.0 AS starkness
FROM master WHERE flagged ORDER BY 2 DESC, item_key LIMIT 12""")
def starkest_top12(spark, sf):
    scored = master(spark, sf).where("flagged").select(
        "item_key", rounded(m.starkness("cost", "p_max")).alias("starkness"))
    return top_n(scored, [F.col("starkness").desc(), "item_key"], 12)


_ITEMS = """items AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat(l_returnflag, CASE WHEN l_suppkey % 10 = 0 THEN '2e4q' ELSE '2e4' END) AS best,
  concat(CASE WHEN l_partkey % 5 = 0 THEN 'Z' ELSE l_returnflag END,
    CASE WHEN l_suppkey % 10 = 0 THEN '2e4q' ELSE '2e4' END) AS deep_best,
  l_linenumber = 3 AS in_check, CAST(l_quantity AS INT) AS n_options,
  l_extendedprice / 500 AS deep_gap FROM lineitem)"""


def _items(spark, sf):
    src = read(spark, sf, "lineitem")
    tail = F.when(F.col("l_suppkey") % 10 == 0, "2e4q").otherwise("2e4")
    return src.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat("l_returnflag", tail).alias("best"),
        F.concat(F.when(F.col("l_partkey") % 5 == 0, "Z").otherwise(F.col("l_returnflag")),
                 tail).alias("deep_best"),
        (F.col("l_linenumber") == 3).alias("in_check"),
        F.col("l_quantity").cast("int").alias("n_options"),
        (F.col("l_extendedprice") / 500).alias("deep_gap"))


@query("eligible_items", f"""
WITH {_ITEMS} SELECT l_orderkey, l_linenumber, l_partkey, best FROM items
WHERE length(best) = 4 AND NOT in_check AND n_options >= 8 AND deep_best = best
  AND deep_gap >= 70""")
def eligible_items(spark, sf):
    return rows.eligible_items(_items(spark, sf)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "best")


@query("stability", f"""
WITH {_ITEMS} SELECT best, count(*) AS n, count(CASE WHEN deep_best = best THEN 1 END) AS n_stable
FROM items GROUP BY best""")
def stability(spark, sf):
    return rows.stability(_items(spark, sf)).groupBy("best").agg(
        F.count("*").alias("n"), F.count_if("stable").alias("n_stable"))


@query("tiers", f"""
WITH {EVALS} SELECT item_key, game_id, ply, CASE WHEN p1 >= 0.02::DOUBLE THEN 1
  WHEN p1 >= 0.005::DOUBLE THEN 2 ELSE 3 END AS tier FROM evals""")
def tiers(spark, sf):
    return evals(spark, sf).select("item_key", "game_id", "ply", m.tier("p1").alias("tier"))


@query("impute", f"""
WITH {EVALS} SELECT item_key, game_id, ply, round(coalesce(cost, 0), 6) + 0.0 AS cost,
  round(coalesce(second_cp, 1500), 6) + 0.0 AS second_cp FROM evals""")
def impute(spark, sf):
    return rows.impute(evals(spark, sf), {"cost": 0, "second_cp": 1500}).select(
        "item_key", "game_id", "ply", rounded("cost").alias("cost"),
        rounded("second_cp").alias("second_cp"))


@query("complete_rows", f"""
WITH {EVALS} SELECT item_key, game_id, ply FROM evals
WHERE cost IS NOT NULL AND second_cp IS NOT NULL""")
def complete_rows(spark, sf):
    return rows.complete_rows(evals(spark, sf), ["cost", "second_cp"]).select(
        "item_key", "game_id", "ply")


@query("counterfactual", f"""
WITH {MASTER} SELECT flagged, 1900.0::DOUBLE AS mover_rating, count(*) AS n
FROM master GROUP BY flagged""")
def counterfactual(spark, sf):
    return (rows.counterfactual(master(spark, sf), "mover_rating", 1900)
            .groupBy("flagged", "mover_rating").agg(F.count("*").alias("n")))


@query("control_set", f"""
WITH {MASTER} SELECT item_key, batch FROM master
WHERE NOT flagged AND cost >= 100 AND p4 >= 0.2::DOUBLE""")
def control_set(spark, sf):
    return rows.control_set(master(spark, sf), "p4").select("item_key", "batch")


@query("family_names", f"""
WITH {MASTER}, g AS (SELECT batch % 10 AS gid, best, count(*) AS n,
  round(avg((ply % 2 = 0)::INT) + 0.3, 2) AS quiet, round(avg((ply <= 2)::INT), 2) AS pawn,
  round(avg((ply = 7)::INT) * 2, 2) AS retreat, round(avg((ply = 5)::INT) * 3, 2) AS endgame,
  round(avg(p4), 2) AS c_sac, round(avg(p2), 2) AS c_king, round(avg(p1) - 0.04, 2) AS c_int,
  round(avg(p3), 2) AS c_def, round(avg(p3) - 0.1, 2) AS c_clear,
  round(avg(found::INT), 2) AS found, round(avg(coalesce(cost, 0)), 2) AS cost
  FROM master GROUP BY 1, 2)
SELECT gid, best, CASE WHEN c_sac > 0.3 AND quiet > 0.75 THEN 'The unpaid sacrifice'
  WHEN c_king > 0.35 THEN 'Walking into the fire' WHEN c_def >= greatest(c_sac, c_king, c_int, c_clear) OR (c_def > 0.15 AND quiet > 0.75)
   THEN 'Cold defence'
  WHEN pawn > 0.28 AND quiet > 0.8 THEN 'The pawn that isn''t urgent'
  WHEN retreat > 0.3 THEN 'Backwards on purpose' WHEN endgame > 0.4 THEN 'Endgame against instinct'
  WHEN c_int > 0.18 OR c_clear > 0.18 THEN 'Order of operations' ELSE concat('Quiet ', best, ' play') END AS name,
  concat('Concept ', gid + 1) AS label,
  concat(n, ' positions, mostly ', best, '. ', printf('%.0f', quiet * 100),
   '% of the moves are quiet — neither capture nor check — and the piece moved is most often a ',
   best, '. In the engine''s representation ', CASE WHEN c_int <= 0.01 THEN
   concat('it has no measurable similarity to any of the twelve named motifs — the closest, ',
    'intermezzo, sits at ', printf('%.2f', c_int)) ELSE concat('this group is closest to ',
    'intermezzo (', printf('%.2f', c_int), '), and only weakly') END,
   '. Real players at the board found these moves ', printf('%.1f', found * 100),
   '% of the time, losing an average of ', CAST(round(cost) AS BIGINT),
   ' centipawns by choosing otherwise.') AS gloss FROM g""")
def family_names(spark, sf):
    def share(cond):
        return F.avg(F.expr(cond).cast("double"))

    g = master(spark, sf).groupBy((F.col("batch") % 10).alias("gid"), "best").agg(
        F.count("*").alias("n"), F.round(share("ply % 2 = 0") + 0.3, 2).alias("quiet"),
        F.round(share("ply <= 2"), 2).alias("pawn"),
        F.round(share("ply = 7") * 2, 2).alias("retreat"),
        F.round(share("ply = 5") * 3, 2).alias("endgame"), F.round(F.avg("p4"), 2).alias("c_sac"),
        F.round(F.avg("p2"), 2).alias("c_king"), F.round(F.avg("p1") - 0.04, 2).alias("c_int"),
        F.round(F.avg("p3"), 2).alias("c_def"), F.round(F.avg("p3") - 0.1, 2).alias("c_clear"),
        F.round(share("found"), 2).alias("found"),
        F.round(F.avg(F.coalesce("cost", F.lit(0))), 2).alias("cost"))
    columns = {"sacrifice": "c_sac", "exposedKing": "c_king", "intermezzo": "c_int",
               "defensiveMove": "c_def", "clearance": "c_clear"}
    motifs = F.create_map(*[x for n, c in columns.items() for x in (F.lit(n), F.col(c))])
    others = F.greatest("c_sac", "c_king", "c_int", "c_clear")
    nearest = F.when(F.col("c_def") >= others, "defensiveMove").otherwise("another")
    return g.select(
        "gid", "best",
        m.family_name(motifs, nearest, "best", "quiet", "pawn", "retreat", "endgame").alias("name"),
        m.neutral_label("gid").alias("label"),
        m.neutral_gloss("n", "best", "quiet", "best", F.lit("intermezzo"), "c_int", "found",
                        "cost").alias("gloss"))


@query("verdicts", f"""
WITH {MASTER}, v AS (SELECT batch, avg(p4) - 0.2 AS d, avg(flagged::INT) * 5 AS a
  FROM master GROUP BY batch)
SELECT batch, CASE WHEN d > 0.02 THEN 'RISING' WHEN d < -0.02 THEN 'FALLING' ELSE 'FLAT' END
  AS trend, CASE WHEN a >= 0.6 THEN 'stable' WHEN a >= 0.4 THEN 'moderate' ELSE 'unstable' END
  AS stability, a < 0.05 AS significant,
  CASE WHEN d > 0.01 THEN 'survives' ELSE 'does not survive' END AS gain FROM v""")
def verdicts(spark, sf):
    v = master(spark, sf).groupBy("batch").agg((F.avg("p4") - 0.2).alias("d"),
                                               (m.mean_of("flagged") * 5).alias("a"))
    return v.select("batch", m.verdict_trend("d").alias("trend"),
                    m.verdict_stability("a").alias("stability"),
                    m.verdict_significant("a").alias("significant"),
                    m.verdict_gain("d").alias("gain"))
