"""Modelling queries over the consolidated items (whole tables, the study's settings)."""

from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.functions import vectors as fv
from crowdgap.operators import metrics
from crowdgap.operators import models as mo
from crowdgap.operators import vectors as vo
from crowdgap.operators.joins import attach_vectors
from crowdgap.operators.models import Block
from crowdgap.plans.bindings import LEVELS, MASTER, evals, master, read
from crowdgap.plans.registry import query
from crowdgap.session import materialise

SURFACE = Block("surface", {"ply": 0.0}, ("favourite",))
CROWD = Block("crowd", {c: 0.0 for c in LEVELS})
ENGINE = Block("engine", {"best_cp": 0.0, "second_cp": 0.0, "cost": 0.0})
RATING = Block("rating", {"mover_rating": 1500.0})
ALL = [SURFACE, CROWD, ENGINE, RATING]
INPUTS = ["item_key", "game_id", "batch", "flagged", "found", "favourite", "ply", *LEVELS,
          "best_cp", "second_cp", "cost", "mover_rating", "best", "p_max"]


def _items(spark, sf):
    """The found outcome is made learnable: it depends on the crowd's favourite and the cost."""
    liked = (F.col("favourite") == F.col("best")) | F.coalesce(F.col("cost") < 50, F.lit(False))
    return master(spark, sf).withColumn("found", F.col("found") | liked).select(*INPUTS)


def _full_logit(train):
    return mo.newton(train, max_iter=3000)


@query("grouped_cv")
def grouped_cv(spark, sf):
    oof = mo.grouped_cv(_items(spark, sf), ALL, "found", "game_id", _full_logit, keep=["flagged"])
    return mo.cv_summary(oof)


@query("cv_rows", f"""
WITH {MASTER} SELECT count(*) AS n, count(DISTINCT item_key) AS items, 0::BIGINT AS split_groups,
 5::BIGINT AS folds FROM master""")
def cv_rows(spark, sf):
    """Each row is predicted once and no group is split over folds."""
    oof = mo.grouped_cv(_items(spark, sf), ALL, "found", "game_id", _full_logit,
                        keep=["item_key", "game_id"])
    split = oof.groupBy("game_id").agg(F.countDistinct("fold").alias("n")).agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("split_groups"))
    return oof.agg(F.count("*").alias("n"), F.countDistinct("item_key").alias("items"),
                   F.countDistinct("fold").alias("folds")).join(split)


EMBEDDING = Block("embedding", vector="scores", width=40)


def _with_scores(spark, sf):
    """Items that name a vector each, and the vectors' 40 component scores."""
    vec = read(spark, sf, "embeddings")
    n = vec.count()
    scores = vo.pca_scores(vec.select("vec_id", fv.l2norm("embedding").alias("u")), 40, "u")
    keyed = _items(spark, sf).withColumn("vec_id", F.pmod(F.crc32(F.col("item_key").cast("binary")), F.lit(n)))
    return keyed, materialise(scores.select("vec_id", "scores"), "scores")


@query("feature_ladder")
def feature_ladder(spark, sf):
    """The study's eight rungs, from surface features to everything with the embedding."""
    items, scores = _with_scores(spark, sf)
    return mo.ladder(items, {
        "surface": [SURFACE], "crowd": [CROWD], "engine": [ENGINE], "embedding": [EMBEDDING],
        "surface + engine": [SURFACE, ENGINE], "surface + engine + crowd": [SURFACE, ENGINE, CROWD],
        "surface + engine + crowd + rating": ALL,
        "all + embedding": [*ALL, EMBEDDING]}, "found", "game_id",
        base="surface + engine + crowd + rating", vectors=(scores, "vec_id"))


@query("best_width")
def best_width(spark, sf):
    """Best gain of the embedding at any width, with and without the rating in the base set."""
    items, scores = _with_scores(spark, sf)
    items = materialise(items, "items")
    parts = []
    for name, blocks in (("position", [SURFACE, ENGINE, CROWD]), ("with rating", ALL)):
        sweep = mo.width_sweep(items, blocks, "scores", [2, 5, 10, 20, 40], "found", "game_id",
                               vectors=(scores, "vec_id"))
        parts.append(sweep.where("spec <> 'base'").agg(
            F.max_by("spec", "gain").alias("width"), F.max("gain").alias("gain")).withColumn(
            "base", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("logit_gradient", f"""
WITH {MASTER} SELECT name, 0.0 AS gradient FROM (VALUES ('ply'), ('best_cp'), ('second_cp'), ('cost'),
 ('p1'), ('p2'), ('p3'), ('p4'), ('mover_rating'), ('intercept')) t(name)
WHERE (SELECT count(*) FROM master) > 0""")
def logit_gradient(spark, sf):
    """At the fitted coefficients the objective's gradient, summed over the rows by Spark, is zero."""
    block = Block("all", {"ply": 0.0, **ENGINE.numeric, **CROWD.numeric, **RATING.numeric})
    # consolidated and written once, for the fit and for its check
    items = materialise(_items(spark, sf).select("found", *block.numeric), "items")
    fit = mo.logit_report(items, [block], "found", written=True).collect()       # one row per column
    z = {r["name"]: (F.lit(1.0) if r["name"] == "intercept" else (F.coalesce(
        m.nan_to_null(F.col(r["name"])), F.lit(block.numeric[r["name"]])) - r["mean"]) / r["scale"])
        for r in fit}
    margin = sum((z[r["name"]] * r["coefficient"] for r in fit), F.lit(0.0))
    off = 1 / (1 + F.exp(-F.col("margin"))) - F.col("found").cast("double")
    rows = items.select("found", margin.alias("margin"), *[z[r["name"]].alias(f"z{i}") for i, r in enumerate(fit)])
    price = {r["name"]: 0.0 if r["name"] == "intercept" else r["coefficient"] for r in fit}
    sums = rows.agg(*[(0.5 * F.sum(off * F.col(f"z{i}")) + price[r["name"]]).alias(f"z{i}")
                      for i, r in enumerate(fit)])
    lines = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.abs(F.round(f"z{i}", 3)).alias("gradient"))
                      for i, r in enumerate(fit)])
    return sums.select(F.inline(lines))


@query("difficulty_calibration")
def difficulty_calibration(spark, sf):
    oof = mo.grouped_cv(_items(spark, sf), ALL, "found", "game_id", mo.gbm, 5, ["flagged"])
    return metrics.calibration(oof, mo.LABEL, mo.SCORE)


@query("difficulty_by_flag")
def difficulty_by_flag(spark, sf):
    oof = mo.grouped_cv(_items(spark, sf), ALL, "found", "game_id", mo.gbm, 5, ["flagged"])
    return metrics.pred_vs_actual(oof, "flagged", mo.LABEL, mo.SCORE)


@query("score_at")
def score_at(spark, sf):
    items = evals(spark, sf).select(
        (F.col("game_id") % 8).alias("concept"), "item_key").distinct()
    scored = mo.score_at(_items(spark, sf), items, ALL, "found", "item_key", ["batch", "game_id"],
                         1900.0, make=mo.gbm)
    return mo.score_by_concept(scored, "concept")


@query("learning_curve")
def learning_curve(spark, sf):
    return mo.learning_curve(_items(spark, sf), ALL, "found", "game_id", [2000, 5000, 10000, 20000, 30000, None],
                             3, make=mo.gbm)


@query("batch_value")
def batch_value(spark, sf):
    return mo.batch_value(_items(spark, sf), ALL, "found", "game_id", "batch", 2001,
                          make=mo.gbm)


_FLAGS = ["early", "agrees", "cheap", "even_ply"]


def _flags(spark, sf):
    return _items(spark, sf).where(F.col("cost") >= m.GAP).withColumns({
        "early": (F.col("ply") <= 2).cast("double"),
        "agrees": (F.col("favourite") == F.col("best")).cast("double"),
        "cheap": F.coalesce((F.col("second_cp") < 400).cast("double"), F.lit(0.0)),
        "even_ply": (F.col("ply") % 2 == 0).cast("double")})


@query("odds_ratios")
def odds_ratios(spark, sf):
    return mo.odds_ratios(_flags(spark, sf), _FLAGS, "found")


@query("tree_rules")
def tree_rules(spark, sf):
    text, leaves = mo.tree_rules(_flags(spark, sf), _FLAGS, "found")
    return leaves.withColumn("rules", F.lit(text))


@query("rule_leaves", f"""
WITH {MASTER} SELECT count(*) AS n, sum((found OR favourite = best OR coalesce(cost < 50, false))::INT)
 ::BIGINT AS positives FROM master WHERE cost >= 100""")
def rule_leaves(spark, sf):
    """The leaves share out all rows."""
    _, leaves = mo.tree_rules(_flags(spark, sf), _FLAGS, "found")
    return leaves.agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def _documents(spark, sf):
    """Labelled documents with a vector each, so blocks and embeddings can be compared."""
    vec = read(spark, sf, "embeddings")
    n = vec.count()
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    scores = vo.pca_scores(vec.select("vec_id", fv.l2norm("embedding").alias("u")), 40, "u")
    keyed = docs.withColumn("vec_id", F.col("doc_id") % n)
    return attach_vectors(keyed, scores, "vec_id", "scores").select(
        "doc_id", "source", "lang", "n_chars", "quality", "scores")


@query("pca_ladder")
def pca_ladder(spark, sf):
    base = Block("surface", {"n_chars": 0.0}, ("lang",))
    return mo.width_sweep(_documents(spark, sf), [base], "scores", [2, 5, 10, 20, 40], "quality", "source")


@query("cluster_gain")
def cluster_gain(spark, sf):
    base = Block("surface", {"n_chars": 0.0}, ("lang",))
    return mo.cluster_gain(_documents(spark, sf), "doc_id", "quality", [4, 5, 6, 7, 8, 9, 10, 12], base,
                           "scores", 10)


_SPLIT = Block("split", {"ply": 0.0, **{c: 0.0 for c in LEVELS}})


@query("boosted_split", f"""
WITH {MASTER}, m AS (SELECT *, (found OR favourite = best OR coalesce(cost < 50, false))::INT AS y
  FROM master),
 x AS (SELECT 0 AS f, ply::DOUBLE AS v, y FROM m UNION ALL SELECT 1, p1, y FROM m UNION ALL
  SELECT 2, p2, y FROM m UNION ALL SELECT 3, p3, y FROM m UNION ALL SELECT 4, p4, y FROM m),
 b AS (SELECT f, v, sum(t.p - y) AS g, count(*) AS n FROM x, (SELECT avg(y) AS p FROM m) t
  GROUP BY f, v),
 c AS (SELECT f, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY f) AS g,
  sum(n) OVER (PARTITION BY f) AS n FROM b WINDOW w AS (PARTITION BY f ORDER BY v)),
 s AS (SELECT c.*, p, p * (1 - p) AS h FROM c, (SELECT avg(y) AS p FROM m) WHERE nl >= 20 AND n - nl >= 20),
 r AS (SELECT *, round(gl ** 2 / (nl * h + 1) + (g - gl) ** 2 / ((n - nl) * h + 1)
  - g ** 2 / (n * h + 1), 6) AS gain FROM s)
SELECT f::INT AS feature, round(v, 6) AS cut, nl::BIGINT AS left_n, (n - nl)::BIGINT AS right_n, gain,
 round(-0.06 * gl / (nl * h + 1), 6) AS left_value,
 round(-0.06 * (g - gl) / ((n - nl) * h + 1), 6) AS right_value
FROM r ORDER BY gain DESC, f, v LIMIT 1""")
def boosted_split(spark, sf):
    """The root split of the first tree, and what its two leaves add to a row's margin."""
    ready, _ = mo.design(mo._once(_items(spark, sf), [_SPLIT], "found", []), [_SPLIT], "__y")
    model, split = mo.gbm(max_iter=1, leaves=2).fit_with_splits(ready)
    return spark.createDataFrame([split], "feature int, cut double, left_n bigint, right_n bigint, "
                                          "gain double, left_value double, right_value double").select(
        "feature", F.round("cut", 6).alias("cut"), "left_n", "right_n", F.round("gain", 6).alias("gain"),
        F.round("left_value", 6).alias("left_value"), F.round("right_value", 6).alias("right_value"))
