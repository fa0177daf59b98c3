"""Aggregate and metric queries."""

from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.functions.measures import rounded
from crowdgap.operators import aggregates as ag
from crowdgap.operators import metrics
from crowdgap.operators.ordering import exact_quantiles
from crowdgap.plans.bindings import (
    ATTEMPTS, EVALS, LEVELS, MASTER, attempts, evals, master, read)
from crowdgap.plans.registry import query


@query("frontier_trend", f"""
WITH {EVALS}, lv AS (SELECT batch, 1100 AS level, p1 AS p FROM evals UNION ALL
 SELECT batch, 1400, p2 FROM evals UNION ALL SELECT batch, 1700, p3 FROM evals UNION ALL
 SELECT batch, 2000, p4 FROM evals),
 t AS (SELECT batch, avg(CASE WHEN level <= 1400 THEN p END) AS low,
  avg(CASE WHEN level >= 1700 THEN p END) AS high FROM lv GROUP BY batch)
SELECT batch, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS delta,
 CASE WHEN high - low > 0.02 THEN 'RISING' WHEN high - low < -0.02 THEN 'FALLING' ELSE 'FLAT' END
 AS verdict FROM t""")
def frontier_trend(spark, sf):
    levels = F.array(*[F.struct(F.lit(1100 + 300 * i).alias("level"), F.col(c).alias("p"))
                       for i, c in enumerate(LEVELS)])
    long = evals(spark, sf).select("batch", F.inline(levels))
    return ag.frontier_trend(long, "batch", "level", "p").withColumns(
        {c: rounded(c) for c in ("low", "high", "delta")})


@query("mining_summary", f"""
WITH {MASTER} SELECT count(*) AS n, count(CASE WHEN flagged THEN 1 END) AS n_flagged,
 round(avg(flagged::INT), 6) AS flagged_share, round(avg(cost), 6) AS mean_cost,
 round(avg((favourite = best)::INT), 6) AS agreement,
 {", ".join(f"round(avg({p}), 6) AS mean_{p}, "
            f"round(avg(CASE WHEN flagged THEN {p} END), 6) AS flagged_{p}" for p in LEVELS)}
FROM master""")
def mining_summary(spark, sf):
    out = ag.mining_summary(master(spark, sf), LEVELS)
    return out.withColumns({c: rounded(c) for c in out.columns if c not in ("n", "n_flagged")})


@query("frontier_pivot", f"""
WITH {MASTER}, r AS (SELECT flagged, unnest([1100, 1400, 1700, 2000]) AS level,
  unnest([CASE WHEN p1 >= 0.05::DOUBLE THEN 1 WHEN p1 > 0.02::DOUBLE THEN 3 END,
   CASE WHEN p2 >= 0.05::DOUBLE THEN 1 WHEN p2 > 0.02::DOUBLE THEN 3 END,
   CASE WHEN p3 >= 0.05::DOUBLE THEN 1 WHEN p3 > 0.02::DOUBLE THEN 3 END,
   CASE WHEN p4 >= 0.05::DOUBLE THEN 1 WHEN p4 > 0.02::DOUBLE THEN 3 END]) AS rank FROM master)
SELECT level, round(avg(CASE WHEN flagged THEN coalesce(rank = 1, false)::INT END), 6)
  AS flagged_top1, round(avg(CASE WHEN flagged THEN (rank IS NOT NULL)::INT END), 6)
  AS flagged_top5, round(avg(CASE WHEN NOT flagged THEN coalesce(rank = 1, false)::INT END), 6)
  AS control_top1, round(avg(CASE WHEN NOT flagged THEN (rank IS NOT NULL)::INT END), 6)
  AS control_top5 FROM r GROUP BY level""")
def frontier_pivot(spark, sf):
    def rank(p):
        return F.when(F.col(p) >= 0.05, 1).when(F.col(p) > 0.02, 3)

    levels = F.array(*[F.struct(F.lit(1100 + 300 * i).alias("level"), rank(c).alias("rank"))
                       for i, c in enumerate(LEVELS)])
    long = master(spark, sf).select(
        F.when(F.col("flagged"), "flagged").otherwise("control").alias("set"), F.inline(levels))
    out = ag.frontier_pivot(long, "level", ["flagged", "control"])
    return out.withColumns({c: rounded(c) for c in out.columns if c != "level"})


_FEATURES = ["early", "even_ply", "agrees", "cheap", "long_shot"]
_FEATURES_SQL = """feats AS (SELECT *, ply <= 2 AS early, ply % 2 = 0 AS even_ply,
  favourite = best AS agrees, coalesce(second_cp < 200, false) AS cheap, p1 < 0.02::DOUBLE
  AS long_shot, CASE WHEN p_max <= 0.05::DOUBLE THEN 'invisible' WHEN p_max >= 0.30::DOUBLE
  THEN 'visible' ELSE 'mid' END AS stratum FROM master WHERE cost >= 100)"""


def _features(spark, sf):
    return master(spark, sf).where(F.col("cost") >= m.GAP).withColumns({
        "early": F.col("ply") <= 2, "even_ply": F.col("ply") % 2 == 0,
        "agrees": F.col("favourite") == F.col("best"),
        "cheap": F.coalesce(F.col("second_cp") < 200, F.lit(False)),
        "long_shot": F.col("p1") < 0.02, "stratum": m.visibility("p_max")})


@query("signature", f"""
WITH {MASTER} SELECT batch, count(*) AS n, round(avg((ply % 2 = 0)::INT), 3) AS even_ply_share,
 round(avg((ply <= 2)::INT), 3) AS early_share, round(avg(found::INT), 3) AS found_rate,
 trunc(avg(cost))::BIGINT AS mean_cost, round(avg(p_max), 4) AS mean_p
FROM master WHERE flagged GROUP BY batch""")
def signature(spark, sf):
    src = master(spark, sf).where("flagged").withColumns({
        "even_ply": F.col("ply") % 2 == 0, "early": F.col("ply") <= 2})
    return ag.signature(src, "batch", ["even_ply", "early"])


@query("value_counts", f"""
WITH {MASTER}, c AS (SELECT batch, picked, best, count(*) AS n FROM master GROUP BY ALL),
 r AS (SELECT batch, best, n, picked, row_number() OVER (PARTITION BY batch, picked
  ORDER BY n DESC, best) AS rank FROM c)
SELECT batch, picked, best, n, rank FROM r WHERE rank <= 2""")
def value_counts(spark, sf):
    out = ag.value_counts(master(spark, sf), ["batch", "picked"], "best", 2)
    return out.select("batch", "picked", "best", "n", F.col("rank").cast("bigint").alias("rank"))


@query("counts_map", """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM c)
SELECT lang, string_agg(concat(source, '=', n), ',' ORDER BY rank) AS counts FROM r
WHERE rank <= 3 GROUP BY lang""")
def counts_map(spark, sf):
    out = ag.counts_map(read(spark, sf, "documents"), ["lang"], "source", 3)
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("string"))), ",")
    return out.select("lang", text.alias("counts"))


@query("mode_of", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c)
SELECT source, lang AS mode, n FROM r WHERE k = 1""")
def mode_of(spark, sf):
    return ag.mode_of(read(spark, sf, "documents"), ["source"], "lang")


@query("n_distinct", f"""
WITH {EVALS} SELECT count(DISTINCT game_id) AS n_game_id, count(DISTINCT item_key) AS n_item_key
FROM evals""")
def n_distinct(spark, sf):
    return ag.n_distinct(evals(spark, sf), ["game_id", "item_key"])


@query("progress", f"""
WITH {ATTEMPTS}, users AS (SELECT DISTINCT code FROM attempts),
 course AS (SELECT concept, max(idx) + 1 AS items FROM attempts GROUP BY concept),
 d AS (SELECT code, concept, count(DISTINCT idx) AS n, sum(correct) AS c FROM attempts
  GROUP BY ALL),
 st AS (SELECT DISTINCT code, concept FROM attempts WHERE event_type = 'signup')
SELECT u.code, k.concept, k.items, coalesce(d.n, 0) AS n, coalesce(d.c, 0)::BIGINT AS correct,
 st.code IS NOT NULL AS studied, round(100 * coalesce(d.n, 0) / k.items, 1) AS pct,
 least(coalesce(d.n, 0), k.items - 1) AS resume
FROM users u CROSS JOIN course k LEFT JOIN d ON d.code = u.code AND d.concept = k.concept
LEFT JOIN st ON st.code = u.code AND st.concept = k.concept""")
def progress(spark, sf):
    a = attempts(spark, sf)
    course = a.groupBy("concept").agg((F.max("idx") + 1).alias("items"))
    return ag.progress(a, course, a.select("code"), a.where("event_type = 'signup'"))


@query("profile", f"""
WITH {ATTEMPTS} SELECT code, concept, count(*) AS tries, count(DISTINCT idx) AS seen,
 sum(correct)::BIGINT AS hits, round(avg(human_p), 6) AS avg_human_p
FROM attempts GROUP BY code, concept""")
def profile(spark, sf):
    return ag.profile(attempts(spark, sf))


@query("totals", f"""
WITH {ATTEMPTS} SELECT (SELECT count(*) FROM attempts) AS attempts,
 (SELECT coalesce(sum(correct), 0)::BIGINT FROM attempts) AS correct,
 (SELECT count(*) FROM customer) AS players,
 (SELECT round(100 * sum(correct) / nullif(count(*), 0), 1) FROM attempts) AS pct""")
def totals(spark, sf):
    return ag.totals(attempts(spark, sf), read(spark, sf, "customer"))


@query("quantiles", """
SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q0,
 round(quantile_cont(l_extendedprice, 0.5), 6) AS q1,
 round(quantile_cont(l_extendedprice, 0.75), 6) AS q2,
 round(quantile_cont(l_extendedprice, 0.975), 6) AS q3 FROM lineitem GROUP BY 1""")
def quantiles(spark, sf):
    src = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"),
                                             "l_extendedprice")
    out = exact_quantiles(src, "l_extendedprice", [0.25, 0.5, 0.75, 0.975], ["flag"])
    return out.withColumns({f"q{i}": rounded(f"q{i}") for i in range(4)})


@query("between_var", f"""
WITH {MASTER}, g AS (SELECT batch, avg(found::INT) AS mu FROM master GROUP BY batch)
SELECT round(var_samp(mu) * 1000000, 6) AS variance_e6, count(*) AS groups FROM g""")
def between_var(spark, sf):
    out = ag.between_var(master(spark, sf), "batch", "found")
    return out.select(rounded(F.col("variance") * 1000000).alias("variance_e6"), "groups")


@query("enrichment", f"""
WITH {MASTER}, {_FEATURES_SQL}, u AS (
 {" UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CASE WHEN stratum = 'invisible' THEN {f}::INT END) AS i, "
    f"avg(CASE WHEN stratum = 'mid' THEN {f}::INT END) AS m, "
    f"avg(CASE WHEN stratum = 'visible' THEN {f}::INT END) AS v FROM feats" for f in _FEATURES)})
SELECT feature, round(i, 6) AS invisible, round(m, 6) AS mid, round(v, 6) AS visible,
 round(CASE WHEN v > 0.002 THEN i / v END, 6) AS ratio,
 (i >= m AND m >= v) OR (i <= m AND m <= v) AS monotone FROM u""")
def enrichment(spark, sf):
    out = ag.enrichment(_features(spark, sf), _FEATURES, "stratum")
    return out.withColumns({c: rounded(c) for c in ("invisible", "mid", "visible", "ratio")})


@query("contrast", f"""
WITH {MASTER}, {_FEATURES_SQL}, u AS (
 {" UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CASE WHEN {f} THEN found::INT END) AS w, "
    f"avg(CASE WHEN NOT {f} THEN found::INT END) AS o, count(CASE WHEN {f} THEN 1 END) AS nw, "
    f"count(CASE WHEN NOT {f} THEN 1 END) AS no FROM feats WHERE stratum = 'invisible'"
    for f in _FEATURES)})
SELECT feature, round(w, 6) AS found_with, round(o, 6) AS found_without, nw AS n_with,
 no AS n_without FROM u WHERE nw >= 80 AND no >= 80""")
def contrast(spark, sf):
    inv = _features(spark, sf).where("stratum = 'invisible'")
    out = ag.contrast(inv, _FEATURES, "found")
    return out.withColumns({c: rounded(c) for c in ("found_with", "found_without")})


_AUC_SQL = """per AS (SELECT {by}, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY {by}, p),
 cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY p
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per),
 aucs AS (SELECT {by}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc,
  sum(pos + neg)::BIGINT AS n FROM cum GROUP BY {by})"""
_BAND_CASE = """CASE WHEN mover_rating > 0 AND mover_rating <= 2000 THEN '<2000'
  WHEN mover_rating <= 2300 THEN '2000-2300' WHEN mover_rating <= 2600 THEN '2300-2600'
  WHEN mover_rating <= 2800 THEN '2600-2800' WHEN mover_rating <= 4000 THEN '2800+' END"""
_SCORED = f"""s AS (SELECT {_BAND_CASE} AS band, found::INT AS y, p4 * 2 AS p, flagged
 FROM master)"""


def _scored(spark, sf):
    return master(spark, sf).select(
        m.band("mover_rating", m.VALUE_EDGES, m.VALUE_LABELS).alias("band"),
        F.col("found").cast("int").alias("y"), (F.col("p4") * 2).alias("p"), "flagged")


@query("auc_by_band", f"""
WITH {MASTER}, {_SCORED}, {_AUC_SQL.format(by="band")}
SELECT band, round(auc, 6) AS auc, n FROM aucs""")
def auc_by_band(spark, sf):
    out = metrics.auc(_scored(spark, sf), "y", "p", ["band"])
    return out.withColumn("auc", rounded("auc"))


@query("auc_prices", f"""
WITH s AS (SELECT 1 AS one, (l_returnflag = 'R')::INT AS y, l_extendedprice AS p FROM lineitem),
 {_AUC_SQL.format(by="one")} SELECT round(auc, 6) AS auc, n FROM aucs""")
def auc_prices(spark, sf):
    src = read(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    return metrics.auc(src, "y", "l_extendedprice").withColumn("auc", rounded("auc"))


@query("brier", f"""
WITH {MASTER}, {_SCORED} SELECT band, count(*) AS n, round(avg(power(p - y, 2)), 6) AS brier,
 round(avg(y), 6) AS base_rate, round(avg(y) * (1 - avg(y)), 6) AS reference
FROM s GROUP BY band""")
def brier(spark, sf):
    out = metrics.brier(_scored(spark, sf), "y", "p", ["band"])
    return out.withColumns({c: rounded(c) for c in ("brier", "base_rate", "reference")})


_LABELLED = """s AS (SELECT l.doc_id, l.quality AS y, d.source AS grp,
  d.n_chars % 1000 / 1000 AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _labelled(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("source").alias("grp"),
        (F.col("n_chars") % 1000 / 1000).alias("p"))


@query("calibration", f"""
WITH {_LABELLED}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
  AS edges FROM s), b AS (SELECT len(list_filter(e.edges, lambda x: s.p > x)) AS bin, s.p, s.y
  FROM s, e)
SELECT bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual
FROM b GROUP BY bin""")
def calibration(spark, sf):
    out = metrics.calibration(_labelled(spark, sf), "y", "p")
    return out.select(F.col("bin").cast("bigint").alias("bin"), "n",
                      rounded("predicted").alias("predicted"), rounded("actual").alias("actual"))


@query("fold_summary", f"""
WITH {MASTER}, f AS (SELECT flagged, batch, avg(found::INT) AS v FROM master GROUP BY ALL)
SELECT flagged, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS folds
FROM f GROUP BY flagged""")
def fold_summary(spark, sf):
    f = master(spark, sf).groupBy("flagged", "batch").agg(m.mean_of("found").alias("v"))
    return metrics.fold_summary(f, "v", ["flagged"]).withColumns(
        {"mean": rounded("mean"), "sd": rounded("sd")})


@query("band_metrics", f"""
WITH {MASTER}, {_SCORED}, {_AUC_SQL.format(by="band")},
 b AS (SELECT band, avg(power(p - y, 2)) AS brier FROM s GROUP BY band)
SELECT a.band, a.n, round(a.auc, 6) AS auc, round(b.brier, 6) AS brier
FROM aucs a JOIN b ON b.band = a.band WHERE a.n >= 100 AND a.auc IS NOT NULL""")
def band_metrics(spark, sf):
    return metrics.band_metrics(_scored(spark, sf), "band", "y", "p").withColumns(
        {"auc": rounded("auc"), "brier": rounded("brier")})


@query("pred_vs_actual", f"""
WITH {MASTER}, {_SCORED} SELECT flagged, count(*) AS n, round(avg(p), 6) AS predicted,
 round(avg(y), 6) AS actual FROM s GROUP BY flagged""")
def pred_vs_actual(spark, sf):
    return metrics.pred_vs_actual(_scored(spark, sf), "flagged", "y", "p").withColumns(
        {"predicted": rounded("predicted"), "actual": rounded("actual")})


@query("ari", """
WITH s AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'R' ELSE
  l_returnflag END AS b FROM lineitem), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM s
  GROUP BY a, b), k AS (SELECT sum(n * (n - 1) / 2) AS cells, sum(n) AS total FROM c),
 r AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)),
 q AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((cells - r.v * q.v / (total * (total - 1) / 2)) / ((r.v + q.v) / 2
  - r.v * q.v / (total * (total - 1) / 2)), 6) AS ari, total::BIGINT AS n FROM k, r, q""")
def ari(spark, sf):
    src = read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("a"),
        F.when(F.col("l_linestatus") == "O", "R").otherwise(F.col("l_returnflag")).alias("b"))
    return metrics.ari(src, "a", "b").withColumn("ari", rounded("ari"))


@query("dummy_auc", f"""
WITH s AS (SELECT 1 AS one, quality AS y, CAST(concat('0x', substr(md5(concat('7:', doc_id)),
  1, 8)) AS BIGINT) AS p FROM labels), {_AUC_SQL.format(by="one")}
SELECT round(auc, 6) AS auc, n FROM aucs""")
def dummy_auc(spark, sf):
    return metrics.dummy_auc(read(spark, sf, "labels"), "quality", "doc_id", 7).withColumn(
        "auc", rounded("auc"))


@query("quiz_score", f"""
WITH {ATTEMPTS} SELECT concept, count(*) AS n, sum(correct)::BIGINT AS score,
 round(avg(correct), 6) AS share FROM attempts GROUP BY concept""")
def quiz_score(spark, sf):
    return ag.quiz_score(attempts(spark, sf), ["concept"])


@query("assigned_counts", f"""
WITH {EVALS} SELECT best, count(CASE WHEN batch < 1998 THEN 1 END) AS n_old,
 count(CASE WHEN batch >= 1998 THEN 1 END) AS n_new FROM evals GROUP BY best""")
def assigned_counts(spark, sf):
    src = evals(spark, sf)
    return ag.assigned_counts(src.where("batch < 1998"), src.where("batch >= 1998"), "best")
