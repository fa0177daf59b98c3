"""Difficulty models: feature blocks, leakage-free validation, reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import RDD, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.functions import measures as m
from crowdgap.functions.measures import col
from crowdgap.operators import metrics
from crowdgap.operators.boosting import Booster, Job, chances, chances_each
from crowdgap.operators.clustering import kmeans_many
from crowdgap.operators.joins import attach_vectors, keep_groups, score_lookup
from crowdgap.operators.logistic import chance_column, chances as logistic_chances, fit_logistic
from crowdgap.operators.ordering import bucket_count
from crowdgap.operators.passes import packed, packed_columns
from crowdgap.operators.ranking import curve_delta
from crowdgap.operators.rows import counterfactual
from crowdgap.operators.sampling import (
    group_folds, group_holdout, group_sizes, sample_groups, sample_sized, strat_folds)
from crowdgap.session import materialise

FEATURES, LABEL, SCORE = "features", "label", "prediction_p"


@dataclass(frozen=True)
class Block:
    """A named set of model inputs: numbers with their default, categories, a vector prefix."""

    name: str
    numeric: Mapping[str, float] = field(default_factory=dict)
    categorical: Sequence[str] = ()
    vector: str | None = None
    width: int | None = None


# The study's blocks and their defaults.
SURFACE = Block("surface", {c: 0.0 for c in (
    "quiet_ep", "capture", "gives_check", "piece_pawn", "piece_king", "advance", "retreat", "ply",
    "n_legal", "in_check")}, ("piece_name", "phase"))
CROWD = Block("crowd", {c: 0.0 for c in ("p_1100", "p_1400", "p_1700", "p_2000", "p_max",
                                         "p_slope")})
ENGINE = Block("engine", {c: 0.0 for c in ("best_cp", "engine_margin", "cost")})
RATING = Block("rating", {"mover_rating": 1500.0})


def design(df: DataFrame, blocks: Sequence[Block], y=None,
           fit_on: DataFrame | None = None) -> tuple[DataFrame, PipelineModel]:
    """Feature vectors from blocks; encoders are fitted once on the given rows, or on ``fit_on``."""
    stages, inputs = [], []
    cats = [c for b in blocks for c in b.categorical]
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"__i_{c}" for c in cats],
                                    handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"__i_{c}" for c in cats],
                                    outputCols=[f"__o_{c}" for c in cats], dropLast=False))
        inputs += [f"__o_{c}" for c in cats]
    for b in blocks:
        inputs += [f"__n_{c}" for c in b.numeric]
        if b.vector:
            inputs.append(f"__v_{b.name}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    ready = prepare(df, blocks, y)
    model = Pipeline(stages=stages).fit(ready if fit_on is None else prepare(fit_on, blocks, y))
    return tidy(model.transform(ready)), model


def prepare(df: DataFrame, blocks: Sequence[Block], y=None) -> DataFrame:
    """Numbers imputed, categories as text, vectors cut to width."""
    cols = {}
    for b in blocks:
        for c, default in b.numeric.items():
            cols[f"__n_{c}"] = F.coalesce(m.nan_to_null(col(c)), F.lit(float(default)))
        for c in b.categorical:
            cols[c] = F.coalesce(col(c).cast("string"), F.lit("?"))
        if b.vector:
            cut = F.slice(b.vector, 1, b.width) if b.width else col(b.vector)
            cols[f"__v_{b.name}"] = array_to_vector(cut)
    if y is not None:
        cols[LABEL] = col(y).cast("double")
    return df.withColumns(cols)


def tidy(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("__n_", "__i_", "__o_", "__v_"))])


def n_features(df: DataFrame) -> int:
    return int(df.select(FEATURES).first()[0].size)


def logit(train: DataFrame, c: float = 0.5, max_iter: int = 100) -> LogisticRegression:
    """Standardised L2 logistic regression; ``c`` is the inverse strength per summed row loss."""
    n_rows = train.count()
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, standardization=True,
                              elasticNetParam=0.0, regParam=1.0 / (c * max(n_rows, 1)),
                              maxIter=max_iter)


def gbm(train: DataFrame | None = None, max_iter: int = 300, step: float = 0.06,
        leaves: int = 15, depth: int | None = None, l2: float = 1.0) -> Booster:
    """Boosted trees, grown leaf by leaf. The training rows are not looked at."""
    return Booster(max_iter, step, leaves, depth, l2, features=FEATURES, label=LABEL)


@dataclass(frozen=True)
class Newton:
    """The regression of ``logit``, solved by Newton steps; all folds share every pass."""

    c: float = 0.5
    max_iter: int = 100


def newton(train: DataFrame | None = None, c: float = 0.5, max_iter: int = 100) -> Newton:
    """A factory like ``logit``. The training rows are not looked at."""
    return Newton(c, max_iter)


# An estimator made for a training set.
Factory = Callable[[DataFrame], Estimator]


def fit_score(train: DataFrame, test: DataFrame, make: Factory, keep: Sequence[str]) -> DataFrame:
    """Fit on one side, probability of class 1 on the other."""
    scored = make(train).fit(train).transform(test)
    return scored.select(*keep, vector_to_array("probability")[1].alias(SCORE))


def in_parallel(spark: SparkSession, fn, items: Sequence, workers: int = 4) -> list:
    """Independent Spark fits submitted together; each thread keeps the session's settings."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


def cross_validate(ready: DataFrame, k: int, make: Factory, keep: Sequence[str]) -> DataFrame:
    """Out-of-fold probabilities for rows of a written design that carry ``fold``; one fit per fold.

    The narrow result is written once, so reports do not score the rows again.
    """
    width = n_features(ready)
    est = make(ready) if make is not logit else None
    if isinstance(est, Booster):
        models = est.fit_many(ready, [Job(F.col("fold") != i) for i in range(k)], written=True)
        p = chances(models)(vector_to_array(FEATURES), F.col("fold"))
        return materialise(ready.select(*keep, "fold", LABEL, p.alias(SCORE),
                                        F.lit(width).alias("width")), "oof")

    if isinstance(est, Newton):
        blocks = _with_outcome(ready, [F.col("fold") != i for i in range(k)])
        try:
            fits = fit_logistic(blocks, [(i, range(width)) for i in range(k)], width, est.c,
                                max_iter=est.max_iter)
        finally:
            blocks.unpersist()
        p = logistic_chances([fits])(vector_to_array(FEATURES), "fold")[0]
        return materialise(ready.select(*keep, "fold", LABEL, p.alias(SCORE),
                                        F.lit(width).alias("width")), "oof")

    def one(i):
        return fit_score(ready.where(F.col("fold") != i), ready.where(F.col("fold") == i), make,
                         [*keep, "fold", LABEL])

    parts = in_parallel(ready.sparkSession, one, range(k))
    oof = reduce(DataFrame.unionByName, parts).withColumn("width", F.lit(width))
    return materialise(oof, "oof")


def _with_outcome(ready: DataFrame, use: Sequence) -> RDD:
    """Cached pieces of a written design, the outcome as last column."""
    return packed(ready.withColumn("__v", F.concat(vector_to_array(FEATURES), F.array(LABEL))), "__v",
                  use, written=True, narrow=True)


def grouped_cv(df: DataFrame, blocks: Sequence[Block], y, group: str, make: Factory = logit,
               k: int = 5, keep: Sequence[str] = (), seed=0) -> DataFrame:
    """Out-of-fold predictions; all rows of a group share a fold.

    Encoders are fitted on the rows before folds are joined, which drops rows without a group only.
    """
    src = _once(df, blocks, y, [group, *keep])
    folds = group_folds(src, group, k, seed).select(group, "fold")
    dealt, known = src.join(folds, group), src.where(col(group).isNotNull())
    est = make(src) if make is not logit else None
    if isinstance(est, Newton) and not any(b.vector for b in blocks):
        return _plain_cv(dealt, known, blocks, est, k, keep)
    ready, _ = design(dealt, blocks, "__y", known)
    return cross_validate(materialise(ready.select(*keep, "fold", LABEL, FEATURES), "design"), k, make,
                          keep)


def _plain_cv(dealt: DataFrame, fit_on: DataFrame, blocks: Sequence[Block], est: Newton, k: int,
              keep: Sequence[str]) -> DataFrame:
    """Newton's regressions on plain columns: no vector is made, neither for the fits nor for the scores.

    The ready columns are written with the fold, so that later reads compute nothing; predictions are
    written once, like those of others.
    """
    columns = plain_columns(blocks, fit_on)
    width = len(columns)
    ready = materialise(dealt.select(*keep, "fold", F.col("__y").alias(LABEL), *[
        c.alias(f"__x{i}") for i, c in enumerate(columns)]), "design")
    columns = [F.col(f"__x{i}") for i in range(width)]
    rows = packed_columns(ready, [*columns, F.col(LABEL)], "fold", k)
    try:
        fits = fit_logistic(rows, [(i, range(width)) for i in range(k)], width, est.c, max_iter=est.max_iter)
    finally:
        rows.unpersist()
    p = chance_column(fits, columns, "fold")
    return materialise(ready.select(*keep, "fold", LABEL, p.alias(SCORE), F.lit(width).alias("width")), "oof")


def plain_columns(blocks: Sequence[Block], fit_on: DataFrame) -> list[Column]:
    """The columns of :func:`design`, in its order, as plain numbers; for blocks without vectors."""
    cats = list(dict.fromkeys(c for b in blocks for c in b.categorical))
    out = []
    if cats:
        texts = {c: F.coalesce(col(c).cast("string"), F.lit("?")) for c in cats}
        seen = StringIndexer(inputCols=cats, outputCols=[f"__i_{c}" for c in cats]).fit(
            fit_on.select(*[t.alias(c) for c, t in texts.items()]))
        for c, labels in zip(cats, seen.labelsArray):
            out += [(texts[c] == F.lit(v)).cast("double") for v in labels]
            out.append((~texts[c].isin(*labels)).cast("double"))
    return out + [F.coalesce(m.nan_to_null(col(c)), F.lit(float(default)))
                  for b in blocks for c, default in b.numeric.items()]


def stratified_cv(df: DataFrame, blocks: Sequence[Block], y, key: str, make: Factory = logit,
                  k: int = 5, keep: Sequence[str] = (), seed=0) -> DataFrame:
    """Out-of-fold predictions on class-balanced folds (no group rule)."""
    src = _once(df, blocks, y, [key, *keep])
    folds = strat_folds(src.select(key, "__y"), "__y", key, k, seed)
    ready, _ = design(src.join(folds.select(key, "fold"), key), blocks, "__y")
    return cross_validate(materialise(ready.select(*keep, "fold", LABEL, FEATURES), "design"), k, make,
                          keep)


def _inputs(blocks: Sequence[Block]) -> list[str]:
    return sorted({c for b in blocks for c in [*b.numeric, *b.categorical,
                                               *([b.vector] if b.vector else [])]})


def _once(df: DataFrame, blocks: Sequence[Block], y, extra: Sequence[str]) -> DataFrame:
    """Only the columns a validation needs, computed once: encoders, folds and fits re-read it."""
    cols = dict.fromkeys([*_inputs(blocks), *extra])
    return materialise(df.select(*cols, col(y).cast("double").alias("__y")), "inputs")


def cv_summary(oof: DataFrame) -> DataFrame:
    """Mean and sd of the per-fold AUC."""
    return metrics.fold_summary(metrics.auc(oof, LABEL, SCORE, ["fold"]), "auc")


def ladder(df: DataFrame, specs: Mapping[str, Sequence[Block]], y, group: str,
           make: Factory | None = None, k: int = 5, base: str | None = None, c: float = 0.5,
           vectors: tuple[DataFrame, str] | None = None) -> DataFrame:
    """AUC of growing feature sets on the same folds, with the gain over a base set.

    One design holds every block once (of a vector the widest cut); a spec is a set of its columns.
    ``vectors`` (a table, its key) are attached last: only narrow rows are written and dealt before,
    and rows of one vector then lie side by side, so its repeats shrink where they are written.
    Without ``make`` all logistic regressions, specs times folds, are fitted in shared passes.
    """
    widest: dict[str, Block] = {}
    for b in (b for blocks in specs.values() for b in blocks):
        key = b.vector or b.name
        if key not in widest or (widest[key].width or 0) < (b.width or 0):
            widest[key] = b
    blocks = list(widest.values())
    src = _once(df, [b for b in blocks if not (vectors and b.vector)], y,
                [group, *([vectors[1]] if vectors else [])])
    folds = group_folds(src, group, k, 0).select(group, "fold")
    dealt = src.join(folds, group)
    if vectors:
        table, key = vectors
        names = [b.vector for b in blocks if b.vector]
        for name in names:
            dealt = attach_vectors(dealt.hint("merge"), table, key, name)
        blank = src.withColumns({n: F.lit(None).cast(table.schema[n].dataType) for n in names})
        ready, own = columns_of(dealt, blocks, "__y", blank,
                                src.limit(1).crossJoin(table.select(*names).limit(1)))
    else:
        ready, own = columns_of(dealt, blocks, "__y")
    ready = materialise(ready.select("fold", LABEL, FEATURES), "design")
    sets = {}
    for name, chosen in specs.items():
        at = []
        for b in chosen:
            places = [i for x in [*b.categorical, *b.numeric] for i in own[x]]
            at += places + (own[f"vector {b.vector}"][:b.width] if b.vector else [])
        sets[name] = sorted(at)
    scores = _logistic_scores(ready, sets, k, c) if make is None else _made_scores(ready, sets, k, make)
    rows = [(name, *scores[name], len(sets[name])) for name in specs]
    ref = dict((r[0], r[1]) for r in rows).get(base)
    out = df.sparkSession.createDataFrame(rows, "spec string, auc double, sd double, width int")
    gain = F.col("auc") - F.lit(ref)
    return out.withColumn("gain", gain).withColumn("verdict", m.verdict_gain("gain"))


def columns_of(df: DataFrame, blocks: Sequence[Block], y, fit_on: DataFrame | None = None,
               head: DataFrame | None = None) -> tuple[DataFrame, dict[str, list[int]]]:
    """The design, and the places of each input column (``vector <name>``: of a vector) in it.

    ``fit_on`` and ``head`` are cheaper rows than ``df`` to fit encoders on and to take widths from.
    """
    wide = prepare(df if head is None else head, blocks, y)
    ready, model = design(df, blocks, y, fit_on)
    inputs = model.stages[-1].getInputCols()
    first = model.transform(wide).select(*inputs).first()
    names = {f"__v_{b.name}": f"vector {b.vector}" for b in blocks if b.vector}
    own: dict[str, list[int]] = {}
    at = 0
    for col_name, value in zip(inputs, first or []):
        size = value.size if hasattr(value, "size") else 1
        own[names.get(col_name, col_name[4:])] = list(range(at, at + size))
        at += size
    return ready, own


def _fold_aucs(scored: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, sd) over folds for each spec; ``scores`` has one entry per spec."""
    long = scored.select("fold", LABEL, F.posexplode("scores").alias("spec", SCORE))
    per = metrics.auc(long, LABEL, SCORE, ["spec", "fold"])
    rows = metrics.fold_summary(per, "auc", ["spec"]).collect()         # one row per spec
    return {names[r.spec]: (float(r["mean"]), float(r["sd"])) for r in rows}


def _logistic_scores(ready: DataFrame, sets: Mapping[str, Sequence[int]], k: int, c: float) -> dict:
    width = n_features(ready)
    blocks = _with_outcome(ready, [F.col("fold") != f for f in range(k)])
    try:
        fits = fit_logistic(blocks, [(f, sets[s]) for s in sets for f in range(k)], width, c)
    finally:
        blocks.unpersist()
    models = [fits[i:i + k] for i in range(0, len(fits), k)]
    scored = ready.select("fold", LABEL, logistic_chances(models)(
        vector_to_array(FEATURES), "fold").alias("scores"))
    return _fold_aucs(scored, list(sets))


def _made_scores(ready: DataFrame, sets: Mapping[str, Sequence[int]], k: int, make: Factory) -> dict:
    out = {}
    for name, at in sets.items():
        x = vector_to_array(FEATURES)
        part = ready.withColumn(FEATURES, array_to_vector(F.array(*[x[i] for i in at])))
        row = cv_summary(cross_validate(part, k, make, [])).first()
        out[name] = float(row["mean"]), float(row["sd"])
    return out


def logit_report(df: DataFrame, blocks: Sequence[Block], y, c: float = 0.5,
                 written: bool = False) -> DataFrame:
    """(name, coefficient, mean, scale) of one regression over all rows, the intercept last.

    ``written`` tells that ``df`` reads a written table of little more than the inputs: it is not
    written again. The design is row-local and read for its pieces only, so it is not written at all.
    """
    src = df.withColumn("__y", col(y).cast("double")) if written else _once(df, blocks, y, [])
    ready, own = columns_of(src, blocks, "__y")
    width = n_features(ready)
    rows = _with_outcome(ready, [F.lit(True)])
    try:
        fit = fit_logistic(rows, [(0, range(width))], width, c)[0]
    finally:
        rows.unpersist()
    names = {i: f"{n}[{j}]" if len(at) > 1 else n for n, at in own.items() for j, i in enumerate(at)}
    found = [(names[i], float(w), float(mu), float(sd)) for i, w, mu, sd in
             zip(fit.columns, fit.weights, fit.mean, fit.scale)]
    return df.sparkSession.createDataFrame(
        [*found, ("intercept", float(fit.weights[-1]), 0.0, 1.0)],
        "name string, coefficient double, mean double, scale double")


def width_sweep(df: DataFrame, blocks: Sequence[Block], vector: str, widths: Sequence[int], y,
                group: str, make: Factory | None = None, k: int = 5,
                vectors: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Gain of a vector block at several widths; the widest scores are reused as prefixes."""
    specs = {"base": list(blocks)}
    for w in widths:
        specs[f"+{w}"] = [*blocks, Block("embedding", vector=vector, width=w)]
    return ladder(df, specs, y, group, make, k, base="base", vectors=vectors)


def difficulty_report(oof: DataFrame, flag: str) -> dict[str, DataFrame]:
    """Everything reported about a scorer, from its out-of-fold predictions."""
    return {"auc": cv_summary(oof), "brier": metrics.brier(oof, LABEL, SCORE),
            "calibration": metrics.calibration(oof, LABEL, SCORE),
            "by_flag": metrics.pred_vs_actual(oof, flag, LABEL, SCORE)}


def score_at(train: DataFrame, items: DataFrame, blocks: Sequence[Block], y, key: str,
             order: Sequence, rating: float, rating_col: str = "mover_rating",
             make: Factory = gbm) -> DataFrame:
    """Predicted probability per item at one fixed rating; unknown items stay, unscored."""
    extra = [c for c in [key, *order] if isinstance(c, str)]
    train = _once(train, blocks, y, extra)
    ready, encoders = design(train, blocks, "__y")
    est = make(ready)
    # the design is row-local over a written table: boosted trees read it without a second copy
    model = est.fit_many(ready, [Job(F.lit(True))], written=True)[0] if isinstance(est, Booster) else est.fit(ready)
    known = score_lookup(items, train, key, _inputs(blocks), order)
    fixed = counterfactual(known, rating_col, rating)
    scored = model.transform(tidy(encoders.transform(prepare(fixed, blocks))))
    p = F.when(F.col("hit"), vector_to_array("probability")[1])
    return scored.select(*items.columns, "hit", p.alias("predicted"))


def score_by_concept(scored: DataFrame, concept: str) -> DataFrame:
    return scored.groupBy(concept).agg(
        F.round(F.avg("predicted"), 4).alias("predicted"), F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"))


def learning_curve(df: DataFrame, blocks: Sequence[Block], y, group: str,
                   sizes: Sequence[int | None], seeds: int = 3, test_share: float = 0.2,
                   make: Factory = gbm, seed=0) -> DataFrame:
    """Test AUC against training size; subsets are whole groups, ``None`` is everything.

    Which groups a subset holds is settled on a table with one row per group. Boosted models are
    fitted together on one written design that carries these marks.
    """
    df = _once(df, blocks, y, [group])
    jobs = [(s, r) for s in sizes for r in range(1 if s is None else seeds)]
    split = group_holdout(df, group, test_share, seed)
    est = make(df) if make is not logit else None
    if isinstance(est, Booster):
        marks, uses = _curve_marks(df, split, group, jobs)
        ready = design(df, blocks, "__y")[0].select(group, LABEL, FEATURES).join(marks, group)
        rows = _curve_points(materialise(ready.drop(group), "design"), jobs, uses, est)
    else:
        ready = design(df, blocks, "__y")[0].select(group, LABEL, FEATURES)
        marked = ready.join(split, group).persist()
        try:
            rows = _curve_fits(marked, group, jobs, make)
        finally:
            marked.unpersist()
    runs = df.sparkSession.createDataFrame(
        [(i, r[0], r[1], r[2], r[3]) for i, s in enumerate(sizes) for r in rows if r[0] == s],
        "step int, size int, run int, train_n long, auc double")
    curve = runs.groupBy("step").agg(F.max("train_n").alias("train_n"),
                                     F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("sd"))
    return curve_delta(curve, "step", "auc")


def _curve_marks(df: DataFrame, split: DataFrame, group: str, jobs: Sequence[tuple]):
    """(group, is_test, one column per run), and the condition under which a job uses a row.

    All sizes of a run take the first groups of the same shuffle, so a run is one pass over the groups.
    """
    sized = materialise(group_sizes(df, group).join(split, group), "groups")
    pool = sized.where("not is_test")
    most: dict[int, int] = {}
    for size, run in jobs:
        if size is not None:
            most[run] = max(size, most.get(run, 0))
    marks = sized.select(group, "is_test")
    for run, budget in most.items():
        picked = sample_sized(pool, group, budget, 100 + run, bucket_count(sized))
        marks = marks.join(picked.select(group, F.col("prior_rows").alias(f"__prior{run}")), group, "left")
    return marks, [F.lit(True) if s is None else F.coalesce(F.col(f"__prior{r}") < s, F.lit(False))
                   for s, r in jobs]


def _curve_points(ready: DataFrame, jobs: Sequence[tuple], uses: Sequence, est: Booster) -> list:
    """(size, run, training rows, test AUC) of each job, from a written design."""
    pool, test = ready.where("not is_test"), ready.where("is_test")
    models = est.fit_many(pool, [Job(u) for u in uses], written=True)
    counts = pool.agg(*[F.count_if(u) for u in uses]).first()
    each = F.sequence(F.lit(0), F.lit(len(jobs) - 1))
    scored = test.select(LABEL, F.posexplode(chances_each(models)(
        vector_to_array(FEATURES), each)).alias("job", SCORE))
    aucs = metrics.auc(scored, LABEL, SCORE, ["job"]).collect()       # one row per job
    found = {r.job: r.auc for r in aucs}
    return [(*job, counts[i], float(found[i])) for i, job in enumerate(jobs)]


def _curve_fits(marked: DataFrame, group: str, jobs: Sequence[tuple], make: Factory) -> list:
    """The same by one fit for each job."""
    test, pool = marked.where("is_test"), marked.where("not is_test")
    pools = [pool if size is None else keep_groups(
        pool, sample_groups(pool, group, size, 100 + run), group) for size, run in jobs]

    def one(at):
        (size, run), part = jobs[at], pools[at]
        scored = make(part).fit(part).transform(test).select(
            LABEL, vector_to_array("probability")[1].alias(SCORE))
        return (size, run, part.count(), float(metrics.auc(scored, LABEL, SCORE).first().auc))

    return in_parallel(marked.sparkSession, one, range(len(jobs)))


def batch_value(df: DataFrame, blocks: Sequence[Block], y, group: str, batch: str, newest,
                rating: str = "mover_rating", edges=m.VALUE_EDGES, labels=m.VALUE_LABELS,
                test_share: float = 0.25, make: Factory = gbm, seed=0) -> DataFrame:
    """Per rating band: scores of a model without the newest batch and of one with it."""
    df = _once(df, blocks, y, [group, batch, rating])
    ready = design(df, blocks, "__y")[0].select(
        group, m.band(rating, edges, labels).alias("band"),
        (~col(batch).eqNullSafe(F.lit(newest))).alias("old"), LABEL, FEATURES)
    marked = materialise(ready.join(group_holdout(df, group, test_share, seed), group).drop(group),
                         "design")
    train, test = marked.where("not is_test"), marked.where("is_test")
    est = make(train) if make is not logit else None
    if isinstance(est, Booster):
        models = est.fit_many(train, [Job(F.col("old")), Job(F.lit(True))], written=True)
        p = chances_each(models)(vector_to_array(FEATURES), F.array(F.lit(0), F.lit(1)))
        # narrow rows, scored once for both models and all reports
        both = materialise(test.select("band", LABEL, p.alias("p")), "scored")
        scored = [both.select("band", LABEL, F.col("p")[i].alias(SCORE)) for i in range(2)]
    else:
        scored = in_parallel(df.sparkSession, lambda part: fit_score(part, test, make, ["band", LABEL]),
                             [train.where("old"), train])
    old, full = [metrics.band_metrics(s, "band", LABEL, SCORE).collect() for s in scored]  # a row per band
    before = {r.band: r for r in old}
    rows = [(r.band, r.n, before[r.band].auc, r.auc, r.auc - before[r.band].auc,
             before[r.band].brier, r.brier) for r in full if r.band in before]
    return df.sparkSession.createDataFrame(
        rows, "band string, n long, auc_old double, auc_full double, delta_auc double, "
              "brier_old double, brier_full double")


def odds_ratios(df: DataFrame, features: Sequence[str], y) -> DataFrame:
    """exp of the standardised coefficients, strongest first."""
    block = [Block("f", {c: 0.0 for c in features})]
    ready = design(_once(df, block, y, []), block, "__y")[0]
    rows = _with_outcome(ready, [F.lit(True)])
    try:
        fit = fit_logistic(rows, [(0, range(len(features)))], len(features), 0.5)[0]
    finally:
        rows.unpersist()
    coef = fit.weights[:-1]
    order = np.argsort(-np.abs(coef), kind="stable")
    rows = [(i + 1, features[j], float(coef[j]), float(np.exp(coef[j])))
            for i, j in enumerate(order)]
    return df.sparkSession.createDataFrame(
        rows, "place int, feature string, coefficient double, odds_ratio double")


def tree_rules(df: DataFrame, features: Sequence[str], y, depth: int = 3,
               min_rows: int = 150) -> tuple[str, DataFrame]:
    """Rules of a shallow tree as text, and the class weights of its leaves."""
    block = [Block("f", {c: 0.0 for c in features})]
    ready, _ = design(_once(df, block, y, []), block, "__y")
    model = DecisionTreeClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxDepth=depth, minInstancesPerNode=min_rows,
        leafCol="leaf").fit(ready)
    text = model.toDebugString
    for i in reversed(range(len(features))):
        text = text.replace(f"feature {i} ", f"{features[i]} ")
    leaves = model.transform(ready).groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        F.count("*").alias("n"), F.sum(LABEL).cast("bigint").alias("positives"))
    return text, leaves


def cluster_gain(df: DataFrame, key: str, y, ks: Sequence[int], surface: Block,
                 vector: str = "embedding", restarts: int = 10, make: Factory | None = None,
                 folds: int = 5, seed: int = 0) -> DataFrame:
    """What the cluster label adds to the surface features, per number of clusters.

    All labels go into one design; a model sees its own columns. The default are the study's small
    trees: 120 of depth 3.
    """
    est = (make or small_gbm)(df)
    labels = cluster_labels(df, ks, restarts, seed, vector)
    blocks = [surface, *[Block(f"k{k}", categorical=(f"__k{k}",)) for k in ks]]
    src = _once(labels, blocks, y, [key])
    dealt = strat_folds(src.select(key, "__y"), "__y", key, folds, seed).select(key, "fold")
    ready, _ = design(src.join(dealt, key), blocks, "__y")
    ready = materialise(ready.select("fold", LABEL, FEATURES), "design")
    own = feature_columns(ready, blocks)
    base = [i for c in [*surface.categorical, *surface.numeric] for i in own[c]]
    sets = {"base": base}
    for k in ks:
        sets[f"alone{k}"], sets[f"both{k}"] = own[f"__k{k}"], base + own[f"__k{k}"]
    found = _set_aucs(ready, sets, folds, est)
    rows = [(k, found[f"alone{k}"], found[f"both{k}"], found[f"both{k}"] - found["base"]) for k in ks]
    return df.sparkSession.createDataFrame(
        rows, "k int, cluster_auc double, combined_auc double, gain double")


def small_gbm(train: DataFrame | None = None, max_iter: int = 120) -> Booster:
    return gbm(train, max_iter, 0.1, 8, 3, 0.0)


def feature_columns(ready: DataFrame, blocks: Sequence[Block]) -> dict[str, list[int]]:
    """Places of each input column in the feature vector, from its attributes."""
    attrs = ready.schema[FEATURES].metadata["ml_attr"]["attrs"]
    out: dict[str, list[int]] = {}
    for a in (x for kind in attrs.values() for x in kind):
        for b in blocks:
            for c in [*b.numeric, *b.categorical]:
                if a["name"] == f"__n_{c}" or a["name"].startswith(f"__o_{c}_"):
                    out.setdefault(c, []).append(a["idx"])
    return {c: sorted(places) for c, places in out.items()}


def _set_aucs(ready: DataFrame, sets: Mapping[str, Sequence[int]], folds: int, est) -> dict:
    """Mean AUC over folds of each set of columns; boosted models are fitted together."""
    if isinstance(est, Booster):
        jobs = [Job(F.col("fold") != f, tuple(sets[s])) for s in sets for f in range(folds)]
        models = est.fit_many(ready, jobs, written=True)
        which = F.array(*[F.col("fold") + i * folds for i in range(len(sets))])
        scored = ready.select("fold", LABEL, F.posexplode(chances_each(models)(
            vector_to_array(FEATURES), which)).alias("set", SCORE))
    else:
        cut = {s: Job(F.lit(True), tuple(c)) for s, c in sets.items()}
        parts = []
        for i, s in enumerate(cut):
            x = vector_to_array(FEATURES)
            part = ready.withColumn(FEATURES, array_to_vector(F.array(*[x[c] for c in sets[s]])))
            parts += [fit_score(part.where(F.col("fold") != f), part.where(F.col("fold") == f),
                                lambda _: est, ["fold", LABEL]).withColumn("set", F.lit(i))
                      for f in range(folds)]
        scored = reduce(DataFrame.unionByName, parts)
    per = metrics.auc(scored, LABEL, SCORE, ["set", "fold"]).groupBy("set").agg(
        F.avg("auc").alias("auc")).collect()        # one row per set
    names = list(sets)
    return {names[r["set"]]: float(r.auc) for r in per}


def cluster_labels(df: DataFrame, ks: Sequence[int], restarts: int, seed: int,
                   vector: str) -> DataFrame:
    """``__k<k>``: the k-means label of each row for every k."""
    names = [f"__k{k}" for k in ks]
    out = kmeans_many(df, ks, restarts, seed, vector, names)
    return out.withColumns({n: F.col(n).cast("string") for n in names})
