"""Vector and clustering queries over the embeddings table."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crowdgap.functions import vectors as fv
from crowdgap.functions.measures import rounded
from crowdgap.operators import clustering as cl
from crowdgap.operators import vectors as vo
from crowdgap.operators.ordering import exact_quantiles, md5_int, shuffle_key
from crowdgap.operators.passes import packed
from crowdgap.plans.bindings import read
from crowdgap.plans.registry import query

_DIMS = "range(1, 65)"
# unit vectors as long rows (vec_id, label, i, x)
_UNIT = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 nrm AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-9
  AS len FROM e),
 cells AS (SELECT vec_id, label, unnest(v) / len AS x, generate_subscripts(v, 1) AS i FROM nrm)"""
_CENTS = """raw AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
 cn AS (SELECT label, sqrt(sum(x * x)) + 1e-9 AS len FROM raw GROUP BY label),
 cents AS (SELECT r.label, i, x / len AS x FROM raw r JOIN cn ON cn.label = r.label)"""


def _vectors(spark, sf):
    return read(spark, sf, "embeddings")


@query("l2_normalise", f"""
WITH {_UNIT} SELECT vec_id, round(sum(x * i), 6) + 0.0 AS checksum, round(max(x), 6) + 0.0 AS top
FROM cells GROUP BY vec_id""")
def l2_normalise(spark, sf):
    unit = _vectors(spark, sf).select("vec_id", fv.l2norm("embedding").alias("u"))
    weights = F.transform(F.sequence(F.lit(1), F.size("u")), lambda i: i.cast("double"))
    return unit.select("vec_id", rounded(fv.dot("u", weights)).alias("checksum"),
                       rounded(F.array_max("u")).alias("top"))


@query("mean_vectors", f"""
WITH {_UNIT} SELECT label, i, round(avg(x), 6) + 0.0 AS x FROM cells GROUP BY label, i""")
def mean_vectors(spark, sf):
    unit = _vectors(spark, sf).select("label", fv.l2norm("embedding").alias("u"))
    means = vo.mean_vector(unit, ["label"], "u")
    return means.select("label", F.posexplode("mean").alias("i", "x")).select(
        "label", (F.col("i") + 1).cast("bigint").alias("i"), rounded("x").alias("x"))


@query("concept_score", """
WITH v AS (SELECT i, avg(x) AS w FROM (SELECT unnest(embedding::DOUBLE[]) AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 0) GROUP BY i),
 c AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings)
SELECT vec_id, round(sum(x * w), 6) + 0.0 AS score FROM c JOIN v ON v.i = c.i GROUP BY vec_id""")
def concept_score(spark, sf):
    src = _vectors(spark, sf)
    v = vo.overall_mean(src.where("label = 0"))
    return vo.concept_score(src, v).select("vec_id", rounded("score").alias("score"))


_MOTIFS = """base AS (SELECT i, avg(x) AS x FROM cells WHERE vec_id % 5 = 0 GROUP BY i),
 md AS (SELECT m.label, m.i, m.x - b.x AS x FROM (SELECT label, i, avg(x) AS x FROM cells
  WHERE vec_id % 5 <> 0 GROUP BY label, i) m JOIN base b ON b.i = m.i),
 ml AS (SELECT label, sqrt(sum(x * x)) AS len FROM md GROUP BY label),
 motifs AS (SELECT d.label, i, x / len AS x FROM md d JOIN ml ON ml.label = d.label),
 gd AS (SELECT g.grp, g.i, g.x - b.x AS x FROM (SELECT vec_id % 7 AS grp, i, avg(x) AS x
  FROM cells WHERE vec_id % 5 <> 0 GROUP BY ALL) g JOIN base b ON b.i = g.i),
 gl AS (SELECT grp, sqrt(sum(x * x)) AS len FROM gd GROUP BY grp)"""


def _unit(spark, sf):
    return _vectors(spark, sf).select("vec_id", "label", fv.l2norm("embedding").alias("u"))


def _motifs(spark, sf):
    unit = _unit(spark, sf)
    return vo.directions(unit.where("vec_id % 5 <> 0"), "label", unit.where("vec_id % 5 = 0"), "u")


@query("motif_directions", f"""
WITH {_UNIT}, {_MOTIFS} SELECT label, i, round(x, 6) + 0.0 AS x FROM motifs""")
def motif_directions(spark, sf):
    return _motifs(spark, sf).select("label", F.posexplode("direction").alias("i", "x")).select(
        "label", (F.col("i") + 1).cast("bigint").alias("i"), rounded("x").alias("x"))


@query("nearest_motifs", f"""
WITH {_UNIT}, {_MOTIFS}, s AS (SELECT g.grp, m.label, sum(g.x * m.x) / any_value(gl.len) AS c
  FROM gd g JOIN motifs m ON m.i = g.i JOIN gl ON gl.grp = g.grp GROUP BY g.grp, m.label),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, label) AS rank FROM s)
SELECT grp, rank, CAST(label AS STRING) AS motif, round(c, 6) AS cosine FROM r WHERE rank <= 3""")
def nearest_motifs(spark, sf):
    unit = _unit(spark, sf)
    groups = vo.directions(unit.where("vec_id % 5 <> 0").withColumn("grp", F.expr("vec_id % 7")),
                           "grp", unit.where("vec_id % 5 = 0"), "u")
    out = vo.nearest_motifs(groups, _motifs(spark, sf), "label", 3)
    return out.select("grp", F.posexplode("motifs").alias("at", "m")).select(
        "grp", (F.col("at") + 1).cast("bigint").alias("rank"), "m.motif",
        rounded("m.cosine").alias("cosine"))


_SIMS = f"""{_UNIT}, {_CENTS}, sims AS (SELECT c.vec_id, c.label AS own, t.label,
  sum(c.x * t.x) AS s FROM cells c JOIN cents t ON t.i = c.i GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM sims)"""


@query("assign_nearest", f"""
WITH {_SIMS} SELECT vec_id, max(CASE WHEN rn = 1 THEN label END) AS label,
 round(max(CASE WHEN rn = 1 THEN s END), 6) AS sim,
 round(max(CASE WHEN rn = 1 THEN s END) - max(CASE WHEN rn = 2 THEN s END), 6) AS margin
FROM r GROUP BY vec_id""")
def assign_nearest(spark, sf):
    src = _vectors(spark, sf)
    cents = vo.centroids_of(src, "label")
    rows = src.select("vec_id", fv.l2norm("embedding").alias("u"))
    return vo.assign_nearest(rows, cents, "label", "u").select(
        "vec_id", "label", rounded("sim").alias("sim"), rounded("margin").alias("margin"))


@query("self_consistency", f"""
WITH {_SIMS} SELECT round(avg((own = label)::INT), 6) AS agreement, count(*) AS n
FROM r WHERE rn = 1""")
def self_consistency(spark, sf):
    return vo.self_consistency(_vectors(spark, sf), "label").withColumn(
        "agreement", rounded("agreement"))


_STEPS = f"""{_UNIT}, sc AS (SELECT vec_id, label AS pack_id, vec_id % 2 = 0 AS pos, i, x FROM cells),
 vec AS (SELECT p.pack_id AS vid, p.i, p.x - n.x AS w FROM
  (SELECT pack_id, i, avg(x) AS x FROM sc WHERE pos GROUP BY ALL) p JOIN
  (SELECT pack_id, i, avg(x) AS x FROM sc WHERE NOT pos GROUP BY ALL) n
  ON n.pack_id = p.pack_id AND n.i = p.i),
 proj AS (SELECT s.vec_id, s.pack_id, s.pos, v.vid, sum(s.x * v.w) AS score FROM sc s
  JOIN vec v ON v.i = s.i GROUP BY ALL),
 sep AS (SELECT a.vid, a.pack_id, avg((a.score > b.score)::INT) AS separation FROM proj a
  JOIN proj b ON b.vid = a.vid AND b.pack_id = a.pack_id AND NOT b.pos WHERE a.pos GROUP BY ALL)"""


def _separation(spark, sf):
    steps = _vectors(spark, sf).select(
        F.col("label").alias("pack_id"), fv.l2norm("embedding").alias("vec"),
        F.when(F.col("vec_id") % 2 == 0, "pos").otherwise("neg").alias("side"))
    pos = vo.mean_vector(steps.where("side = 'pos'"), ["pack_id"], "vec", "p").drop("n")
    neg = vo.mean_vector(steps.where("side = 'neg'"), ["pack_id"], "vec", "q").drop("n")
    vecs = pos.join(neg, "pack_id").select(F.col("pack_id").alias("vid"),
                                           fv.subtract("p", "q").alias("v"),
                                           F.array("pack_id").alias("own"))
    return vo.separation(steps, vecs, "vid", "own")


@query("separation", f"""
WITH {_STEPS} SELECT vid, pack_id, round(separation, 6) AS separation, vid = pack_id AS own
FROM sep""")
def separation(spark, sf):
    return _separation(spark, sf).withColumn("separation", rounded("separation"))


@query("generalisation", f"""
WITH {_STEPS} SELECT vid, round(avg(CASE WHEN vid = pack_id THEN separation END), 6) AS in_group,
 round(avg(CASE WHEN vid <> pack_id THEN separation END), 6) AS held_out,
 coalesce(avg(CASE WHEN vid <> pack_id THEN separation END), 0) >= 0.65 AS survives
FROM sep GROUP BY vid""")
def generalisation(spark, sf):
    return vo.generalisation(_separation(spark, sf), "vid").withColumns(
        {"in_group": rounded("in_group"), "held_out": rounded("held_out")})


@query("silhouette_sample", """
WITH pool AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  ORDER BY md5(concat('0:', vec_id)), vec_id LIMIT 1200),
 d AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v)) AS t,
  count(*) AS n FROM pool a, pool b GROUP BY ALL),
 ab AS (SELECT vec_id, max(CASE WHEN own = label THEN t / nullif(n - 1, 0) END) AS a,
  min(CASE WHEN own <> label THEN t / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
 count(*) AS n FROM ab""")
def silhouette_sample(spark, sf):
    return cl.silhouette(_vectors(spark, sf), "label", "vec_id").withColumn(
        "silhouette", rounded("silhouette"))


@query("shuffle_null", f"""
WITH {_UNIT}, r AS (SELECT i, x, row_number() OVER (PARTITION BY i
  ORDER BY md5(concat('5:', i - 1, ':', vec_id)), vec_id) AS row FROM cells),
 n AS (SELECT row, sqrt(sum(x * x)) + 1e-9 AS len FROM r GROUP BY row)
SELECT r.row, r.i, round(r.x / n.len, 6) + 0.0 AS x FROM r JOIN n ON n.row = r.row""")
def shuffle_null(spark, sf):
    null = cl.shuffle_null(_unit(spark, sf), "vec_id", 5, "u")
    return null.select("row", F.posexplode("u").alias("i", "x")).select(
        "row", (F.col("i") + 1).cast("bigint").alias("i"), rounded("x").alias("x"))


_PERMS = 2000


@query("perm_test", f"""
WITH s AS (SELECT vec_id, label, (vec_id % 3 = 0)::INT AS y FROM embeddings),
 g AS (SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) AS hi FROM s GROUP BY label),
 o AS (SELECT var_samp(mu) AS v FROM (SELECT avg(y) AS mu FROM s GROUP BY label)),
 p AS (SELECT perm, y, row_number() OVER (PARTITION BY perm
  ORDER BY md5(concat('0:', perm, ':', vec_id)), vec_id) AS rank
  FROM s, range({_PERMS}) t(perm)),
 q AS (SELECT p.perm, g.label, avg(y) AS mu FROM p JOIN g ON p.rank <= g.hi AND p.rank > g.hi - g.n
  GROUP BY ALL), z AS (SELECT perm, var_samp(mu) AS v FROM q GROUP BY perm)
SELECT round(avg((z.v >= o.v)::INT), 6) AS p_value, round(avg(z.v) * 1000, 6) AS null_mean_e3,
 round(any_value(o.v) * 1000, 6) AS observed_e3, count(*) AS permutations FROM z, o""")
def perm_test(spark, sf):
    src = _vectors(spark, sf).select("vec_id", "label", (F.col("vec_id") % 3 == 0).cast("int")
                                     .alias("y"))
    out = cl.perm_test(src, "label", "y", "vec_id", _PERMS)
    return out.select(rounded("p_value").alias("p_value"), "permutations",
                      rounded(F.col("null_mean") * 1000).alias("null_mean_e3"),
                      rounded(F.col("observed") * 1000).alias("observed_e3"))


@query("perm_test_counts")
def perm_test_counts(spark, sf):
    src = read(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("cluster"), (F.col("l_returnflag") == "A").alias("y"))
    return cl.perm_test_counts(src, "cluster", "y", 2000)


def _lloyd_round(i: int) -> str:
    """SQL of one round: nearest centre of every row, then the mean of its rows."""
    return f"""a{i} AS (SELECT vec_id, j FROM (SELECT c.vec_id, b.j, row_number() OVER (PARTITION BY c.vec_id
   ORDER BY round(sum((c.x - b.x) ** 2), 12), b.j) AS place FROM cells c JOIN b{i} b ON b.i = c.i
   GROUP BY c.vec_id, b.j) WHERE place = 1),
 b{i + 1} AS (SELECT b.j, b.i, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT a.j, c.i, avg(c.x) AS x
   FROM a{i} a JOIN cells c ON c.vec_id = a.vec_id GROUP BY a.j, c.i) m ON m.j = b.j AND m.i = b.i)"""


def _gap_to(centres):
    @F.pandas_udf("double")
    def gap(v: pd.Series) -> pd.Series:
        return pd.Series(cl.nearest_centre(fv.stack(v), centres)[1] if len(v) else [], dtype=float)

    return gap


@query("kmeans_rounds", f"""
WITH {_UNIT}, heads AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM e
  ORDER BY vec_id LIMIT 8),
 b0 AS (SELECT j, i, x FROM cells JOIN heads USING (vec_id)),
 {", ".join(_lloyd_round(i) for i in range(4))},
 d AS (SELECT a3.j, c.vec_id, sum((c.x - b3.x) ** 2) AS gap FROM a3 JOIN cells c USING (vec_id)
  JOIN b3 ON b3.j = a3.j AND b3.i = c.i GROUP BY ALL)
SELECT j::INT AS cluster, count(*) AS n, sum(vec_id)::BIGINT AS ids, round(sum(gap), 6) AS cost
FROM d GROUP BY j""")
def kmeans_rounds(spark, sf):
    """Four shared rounds from the eight smallest keys: who is where, and how far."""
    unit = _unit(spark, sf)
    blocks = packed(unit, "u")
    heads = np.array([r.u for r in unit.orderBy("vec_id").limit(8).collect()])
    centres = cl.lloyd(blocks, [heads, heads[:3]], max_iter=3)[0][0]
    blocks.unpersist()
    placed = cl.labelled(unit, [centres], ["cluster"], "u")
    gap = _gap_to(centres)
    return placed.withColumn("gap", gap("u")).groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("vec_id").alias("ids"), rounded(F.sum("gap")).alias("cost"))


@query("kmeans_signature")
def kmeans_signature(spark, sf):
    got = cl.kmeans(_vectors(spark, sf), 8, 12)
    return got.groupBy("cluster").agg(F.count("*").alias("n"),
                                      F.avg((F.col("label") % 2).cast("double")).alias("odd_share"))


@query("k_sweep")
def k_sweep(spark, sf):
    return cl.k_sweep(_vectors(spark, sf), "vec_id", range(2, 17))


@query("stability_ari")
def stability_ari(spark, sf):
    return cl.stability_ari(_vectors(spark, sf), "vec_id", [4, 8, 12])


@query("density_clusters")
def density_clusters(spark, sf):
    src = _vectors(spark, sf).select("vec_id", "label", fv.l2norm("embedding").alias("u"))
    return cl.density_report(src, "vec_id", "label", 1.0, [3], "u")


_MIXTURES = [1, 2, 4, 6, 8, 10, 12]


@query("gmm_bic")
def gmm_bic(spark, sf):
    src = vo.pca_scores(_unit(spark, sf), 40, "u")
    return cl.gmm_bic(src, _MIXTURES, "vec_id", "scores")


@query("mixture_rises", f"""
SELECT k::INT AS k, start::INT AS start, true AS rises, true AS weights_add_up
FROM (VALUES {", ".join(f"({k})" for k in _MIXTURES)}) a(k), (VALUES (0), (1)) b(start)
WHERE (SELECT count(*) FROM embeddings) > 0""")
def mixture_rises(spark, sf):
    """The log-likelihood of no start of any size ever falls (beyond what the variance floor adds)."""
    src = vo.pca_scores(_unit(spark, sf), 40, "u")
    rows = [(r["k"], r["start"], bool(np.min(np.diff(r["history"]), initial=0) > -1e-3),
             bool(abs(r["weights"].sum() - 1) < 1e-9))
            for r in cl.mixtures(src, _MIXTURES, "vec_id", "scores")]
    return spark.createDataFrame(rows, "k int, start int, rises boolean, weights_add_up boolean")


@query("hier_vs_kmeans")
def hier_vs_kmeans(spark, sf):
    return cl.hier_vs_kmeans(_vectors(spark, sf), "vec_id", 8, 8)


@query("dictionary_atoms")
def dictionary_atoms(spark, sf):
    """The eight atoms that gain most on flagged rows, with their nearest motifs of either sign."""
    src = _vectors(spark, sf).withColumn("flagged", F.col("vec_id") % 5 != 0)
    atoms = cl.dictionary_fit(src, "vec_id")
    rates = cl.atom_rates(src, atoms, "flagged")
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(atoms)],
                                 "atom int, direction array<double>")
    named = vo.nearest_motifs(rows, _motifs(spark, sf), "label", 3, by_size=True).drop("direction")
    return rates.join(named, "atom").orderBy(F.desc("gain"), "atom").limit(8)


@query("pca_scores")
def pca_scores(spark, sf):
    return vo.pca_scores(_unit(spark, sf), 10, "u").select(
        "vec_id", F.abs(F.round(F.col("scores")[0], 4)).alias("first"))


def _halves(unit):
    """Control rows in two halves: one gives the origin, the other is scored around it."""
    half = md5_int(shuffle_key("half", "vec_id")) % 2
    return unit.withColumns({"control": F.col("vec_id") % 5 == 0, "half": half})


@query("basis_r2")
def basis_r2(spark, sf):
    unit = _halves(_unit(spark, sf))
    basis = [r.direction for r in _motifs(spark, sf).collect()]   # one row per motif
    origin = vo.overall_mean(unit.where("control and half = 0"), "u")
    scored = vo.basis_r2(unit.where("not control or half = 1"), basis, origin, "u").withColumn(
        "grp", F.when(F.col("control"), "control").otherwise("flagged"))
    middle = exact_quantiles(scored, "r2", [0.5], ["grp"])
    return (scored.groupBy("grp").agg(F.count("*").alias("n"), F.avg("r2").alias("mean_r2"))
            .join(middle.withColumnRenamed("q0", "median_r2"), "grp"))


def _two_motifs(spark, sf):
    rows = _motifs(spark, sf).where("label < 2").orderBy("label").collect()
    return [r.direction for r in rows]


@query("basis_r2_pair", f"""
WITH {_UNIT}, {_MOTIFS}, h AS (SELECT vec_id, vec_id % 5 = 0 AS control,
  CAST(concat('0x', substr(md5(concat('half:', vec_id)), 1, 8)) AS BIGINT) % 2 AS half
  FROM embeddings),
 zero AS (SELECT i, avg(x) AS x FROM cells JOIN h USING (vec_id) WHERE control AND half = 0
  GROUP BY i),
 b1 AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM motifs WHERE label = 0),
 rest AS (SELECT m.i, m.x - b1.x * sum(m.x * b1.x) OVER () AS x FROM motifs m
  JOIN b1 ON b1.i = m.i WHERE m.label = 1),
 b2 AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM rest),
 d AS (SELECT c.vec_id, h.control, sum((c.x - z.x) * b1.x) AS p, sum((c.x - z.x) * b2.x) AS q,
  sum((c.x - z.x) ** 2) AS t FROM cells c JOIN h USING (vec_id) JOIN zero z ON z.i = c.i
  JOIN b1 ON b1.i = c.i JOIN b2 ON b2.i = c.i WHERE NOT control OR half = 1 GROUP BY ALL)
SELECT CASE WHEN control THEN 'control' ELSE 'flagged' END AS grp, count(*) AS n,
 round(avg((p * p + q * q) / t), 6) AS mean_r2 FROM d GROUP BY 1""")
def basis_r2_pair(spark, sf):
    unit = _halves(_unit(spark, sf))
    origin = vo.overall_mean(unit.where("control and half = 0"), "u")
    scored = vo.basis_r2(unit.where("not control or half = 1"), _two_motifs(spark, sf), origin, "u")
    return scored.groupBy(F.when(F.col("control"), "control").otherwise("flagged").alias("grp")).agg(
        F.count("*").alias("n"), rounded(F.avg("r2")).alias("mean_r2"))


@query("novelty_pair", f"""
WITH {_UNIT}, {_MOTIFS}, b AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x
  FROM motifs WHERE label < 2),
 p AS (SELECT vec_id, b.label, sum(c.x * b.x) AS along, sum(c.x * c.x) AS len FROM cells c
  JOIN b ON b.i = c.i GROUP BY ALL),
 r AS (SELECT vec_id, label, sqrt(greatest(len - along * along, 0)) / (sqrt(len) + 1e-12) AS left_over
  FROM p)
SELECT vec_id, round(sum(CASE WHEN label = 0 THEN left_over ELSE -left_over END), 6) + 0.0 AS novelty
FROM r GROUP BY vec_id""")
def novelty_pair(spark, sf):
    crowd, expert = _two_motifs(spark, sf)
    return vo.novelty(_unit(spark, sf), [expert], [crowd], "u").select(
        "vec_id", rounded("novelty").alias("novelty"))


@query("mixture_of_one", f"""
WITH {_UNIT}, m AS (SELECT i, var_pop(x) AS v, count(*) AS n FROM cells GROUP BY i)
SELECT 1 AS k, round(sum(n * (ln(2 * pi() * (v + 1e-6)) + v / (v + 1e-6)))
 + 2 * count(*) * ln(any_value(n)), 3) AS bic FROM m""")
def mixture_of_one(spark, sf):
    """With one component the likelihood has a closed form."""
    return cl.gmm_bic(_unit(spark, sf), [1], "vec_id", "u").withColumn("bic", F.round("bic", 3))


@query("pca_trace", f"""
WITH {_UNIT} SELECT round(sum(v), 6) AS total, count(*) AS n FROM (SELECT var_samp(x) AS v FROM cells
 GROUP BY i)""")
def pca_trace(spark, sf):
    """The components' variances add up to the data's."""
    scores = vo.pca_scores(_unit(spark, sf), 64, "u").select(F.posexplode("scores").alias("i", "x"))
    return scores.groupBy("i").agg(F.var_samp("x").alias("v")).agg(
        rounded(F.sum("v")).alias("total"), F.count("*").alias("n"))


@query("kmeans_sizes", """
SELECT count(*) AS n, 8::BIGINT AS clusters FROM embeddings""")
def kmeans_sizes(spark, sf):
    got = cl.kmeans(_vectors(spark, sf), 8, 12)
    return got.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))


@query("perm_counts_observed", """
WITH m AS (SELECT l_suppkey % 8 AS c, avg((l_returnflag = 'A')::INT) AS mu FROM lineitem GROUP BY 1)
SELECT round(var_samp(mu) * 1000, 6) AS observed_e3, 2000::BIGINT AS permutations FROM m""")
def perm_counts_observed(spark, sf):
    return perm_test_counts(spark, sf).select(
        rounded(F.col("observed") * 1000).alias("observed_e3"),
        F.col("permutations").cast("bigint").alias("permutations"))


_SCORED = """s AS (SELECT c.label, c.vec_id, sum(c.x * w.x) AS score FROM cells c JOIN (
  SELECT i, avg(x) AS x FROM cells WHERE label = 0 GROUP BY i) w ON w.i = c.i GROUP BY ALL)"""


def _strongest(spark, sf, by_size):
    unit = _unit(spark, sf)
    scored = vo.concept_score(unit, vo.overall_mean(unit.where("label = 0"), "u"), "u")
    return vo.strongest(scored, ["label"], "score", "vec_id", 5, by_size).select(
        "label", F.col("rank").cast("bigint").alias("rank"), "vec_id", rounded("score").alias("score"))


@query("strongest", f"""
WITH {_UNIT}, {_SCORED} SELECT label, rank, vec_id, round(score, 6) + 0.0 AS score FROM (SELECT *,
 row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def strongest(spark, sf):
    return _strongest(spark, sf, False)


@query("strongest_by_size", f"""
WITH {_UNIT}, {_SCORED} SELECT label, rank, vec_id, round(score, 6) + 0.0 AS score FROM (SELECT *,
 row_number() OVER (PARTITION BY label ORDER BY abs(score) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def strongest_by_size(spark, sf):
    """Either sign counts."""
    return _strongest(spark, sf, True)


@query("nearest_motifs_by_size", f"""
WITH {_UNIT}, {_MOTIFS}, s AS (SELECT g.grp, m.label, sum(g.x * m.x) / any_value(gl.len) AS c
  FROM gd g JOIN motifs m ON m.i = g.i JOIN gl ON gl.grp = g.grp GROUP BY g.grp, m.label),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(c) DESC, label) AS rank FROM s)
SELECT grp, rank, CAST(label AS STRING) AS motif, round(c, 6) AS cosine FROM r WHERE rank <= 3""")
def nearest_motifs_by_size(spark, sf):
    unit = _unit(spark, sf)
    groups = vo.directions(unit.where("vec_id % 5 <> 0").withColumn("grp", F.expr("vec_id % 7")),
                           "grp", unit.where("vec_id % 5 = 0"), "u")
    out = vo.nearest_motifs(groups, _motifs(spark, sf), "label", 3, by_size=True)
    return out.select("grp", F.posexplode("motifs").alias("at", "m")).select(
        "grp", (F.col("at") + 1).cast("bigint").alias("rank"), "m.motif",
        rounded("m.cosine").alias("cosine"))


@query("leader_clusters")
def leader_clusters(spark, sf):
    src = _unit(spark, sf).select("vec_id", F.col("u").alias("v"),
                                  F.col("u")[0].alias("score"))
    return vo.leader_clusters(src, "vec_id", "score", threshold=0.2)


@query("contrast_direction")
def contrast_direction(spark, sf):
    steps = _unit(spark, sf).select(
        F.col("u").alias("vec"), F.when(F.col("label") < 5, "pos").otherwise("neg").alias("side"))
    v, slack = vo.contrast_direction(steps, l1=0.002)
    return steps.agg(F.count("*").alias("n")).withColumns({
        "nonzeros": F.lit(int(np.count_nonzero(np.abs(v) > 1e-9))), "slack": F.lit(slack)})


@query("contrast_directions")
def contrast_directions(spark, sf):
    steps = _unit(spark, sf).select(
        F.col("label").alias("pack_id"), F.col("u").alias("vec"),
        F.when(F.col("vec_id") % 2 == 0, "pos").otherwise("neg").alias("side"))
    vecs = vo.contrast_directions(steps, "pack_id", l1=0.01).select(
        F.col("pack_id").alias("vid"), "v", F.array("pack_id").alias("own"))
    return vo.generalisation(vo.separation(steps, vecs, "vid", "own"), "vid")


@query("contrast_optimal", """
SELECT CASE WHEN label % 4 = 3 THEN NULL ELSE label END AS pack_id, count(*) AS n,
 count(*) FILTER (vec_id % 2 = 0) AS positives, true AS optimal
FROM embeddings GROUP BY 1""")
def contrast_optimal(spark, sf):
    """Every group, the null one too, meets the conditions of a minimum, checked over its rows.

    For entries that are zero the gradient is at most l1; for others it cancels l1.
    """
    l1 = 0.01
    steps = _unit(spark, sf).select(
        F.when(F.col("label") % 4 != 3, F.col("label")).alias("pack_id"), F.col("u").alias("vec"),
        F.when(F.col("vec_id") % 2 == 0, "pos").otherwise("neg").alias("side"))
    fits = vo.contrast_fits(steps, "pack_id", l1=l1, tol=1e-4).select(
        F.col("pack_id").alias("__p"), "weights")
    sign = F.when(F.col("side") == "pos", 1.0).otherwise(-1.0)
    z = F.transform(F.concat("vec", F.array(F.lit(1.0))), lambda x: x * sign)
    miss = F.greatest(1 - fv.dot("z", "weights"), F.lit(0.0))
    rows = steps.withColumn("z", z).join(F.broadcast(fits), F.col("pack_id").eqNullSafe(F.col("__p")))
    entries = rows.select("pack_id", miss.alias("miss"), F.size("z").alias("d"),
                          F.posexplode(F.arrays_zip("z", "weights")).alias("j", "e"))
    grads = entries.groupBy("pack_id", "j").agg(
        (-2 * F.sum(F.col("miss") * F.col("e.z")) / F.count("*")).alias("grad"),
        F.first("e.weights").alias("w"), F.first("d").alias("d"))
    price = F.when(F.col("j") == F.col("d") - 1, 0.0).otherwise(l1)
    off = F.when(F.col("w") != 0, F.abs(F.col("grad") + F.sign("w") * price)).otherwise(
        F.greatest(F.abs("grad") - price, F.lit(0.0)))
    good = grads.groupBy("pack_id").agg((F.max(off) < 1e-3).alias("optimal")).withColumnRenamed(
        "pack_id", "__g")
    sizes = steps.groupBy("pack_id").agg(F.count("*").alias("n"),
                                         F.count_if(F.col("side") == "pos").alias("positives"))
    return sizes.join(good, F.col("pack_id").eqNullSafe(F.col("__g"))).drop("__g")


@query("novelty")
def novelty(spark, sf):
    unit = _unit(spark, sf)
    expert = vo.principal_basis(unit.where("vec_id % 5 <> 0"), 8, "u")
    crowd = vo.principal_basis(unit.where("vec_id % 5 = 0"), 8, "u")
    return vo.novelty(unit, expert, crowd, "u").select("vec_id", "novelty")
