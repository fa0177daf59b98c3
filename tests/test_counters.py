"""Counting passes: permutation seats, strict orderings, contrast directions of many groups."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdgap.operators import clustering as cl
from crowdgap.operators import vectors as vo


def plain_permutations(labels, y, keys, n, seed):
    sizes = sorted((c, labels.count(c)) for c in set(labels))
    out = []
    for i in range(n):
        order = sorted(range(len(keys)), key=lambda r: (
            hashlib.md5(f"{seed}:{i}:{keys[r]}".encode()).hexdigest(), keys[r]))
        at, means = 0, []
        for _, size in sizes:
            means.append(np.mean([y[r] for r in order[at:at + size]]))
            at += size
        out.append(np.var(means, ddof=1))
    return np.array(out)


@pytest.mark.parametrize("numbers", [4_000_000, 200])
def test_permutation_seats_are_exact_for_any_outcome(spark, monkeypatch, numbers):
    """Also when permutations are taken in several passes."""
    monkeypatch.setattr(cl, "PASS_NUMBERS", numbers)
    rng = np.random.default_rng(1)
    labels = [int(c) for c in rng.choice(4, 300, p=[.4, .3, .29, .01])]
    y = [float(v) for v in rng.normal(size=300)]
    df = spark.createDataFrame([(f"k{i}", c, v) for i, (c, v) in enumerate(zip(labels, y))],
                               "k string, c int, y double").repartition(5)
    got = cl.perm_test(df, "c", "y", "k", 25, seed=3).first()
    null = plain_permutations(labels, y, [f"k{i}" for i in range(300)], 25, 3)
    real = np.var([np.mean([v for v, l in zip(y, labels) if l == c]) for c in set(labels)], ddof=1)
    assert got.permutations == 25 and abs(got.observed - real) < 1e-12
    assert abs(got.null_mean - null.mean()) < 1e-9 and got.p_value == (null >= real).mean()
    plan = cl.perm_test(df, "c", "y", "k", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()


@pytest.mark.parametrize("rows", [20_000, 7])
def test_strict_orderings_by_packed_counters(spark, monkeypatch, rows):
    monkeypatch.setattr(vo, "RANGE_ROWS", rows)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 3)), 1)           # with ties
    pack = [None if i % 4 == 0 else int(i % 3) for i in range(200)]
    side = ["pos" if v < .4 else "neg" for v in rng.random(200)]
    vecs = {"a": [1.0, 0.0, 0.0], "b": [0.5, -1.0, 2.0], "zero": [0.0, 0.0, 0.0]}
    steps = spark.createDataFrame([(p, s, [float(t) for t in v]) for p, s, v in zip(pack, side, x)],
                                  "pack_id int, side string, vec array<double>").repartition(4)
    vectors = spark.createDataFrame([(k, v, [1]) for k, v in vecs.items()],
                                    "k string, v array<double>, own array<int>")
    got = {(r.k, r.pack_id): r for r in vo.separation(steps, vectors, "k", "own").collect()}
    assert len(got) == 3 * 4
    for (k, p), r in got.items():
        s = np.array([x[i] @ vecs[k] for i in range(200)])
        a = [s[i] for i in range(200) if pack[i] == p and side[i] == "pos"]
        b = [s[i] for i in range(200) if pack[i] == p and side[i] == "neg"]
        assert abs(r.separation - np.mean([[u > v for v in b] for u in a])) < 1e-12
        assert r.own == (None if p is None else p == 1)


def test_directions_do_not_depend_on_the_dealing_and_keep_null_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for g in (None, 1, 2):
        for i in range(120):
            hit = i % 2 == 0
            v = rng.normal(0, .3, 6)
            v[0 if g is None else g] += 1.0 if hit else -1.0
            rows.append((g, "pos" if hit else "neg", [float(t) for t in v]))
    rows += [(9, "pos", [0.1] * 6)] * 3                  # one side only
    df = spark.createDataFrame(rows, "g int, side string, vec array<double>")
    one = {r.g: r for r in vo.contrast_fits(df.coalesce(1), "g").collect()}
    monkeypatch.setattr(vo, "SOLVER_NUMBERS", 60)        # a group at a time
    many = {r.g: r for r in vo.contrast_fits(df.repartition(7), "g").collect()}
    assert set(one) == set(many) == {None, 1, 2, 9}
    for g, r in one.items():
        assert np.abs(np.array(r.v) - np.array(many[g].v)).max() < 1e-3
        assert r.residual < 1e-3 or g == 9
        if g != 9:
            assert np.argmax(np.abs(r.v)) == (0 if g is None else g)
    assert one[9].v == [0.0] * 6
    empty = vo.contrast_directions(df.where(F.lit(False)), "g")
    assert empty.collect() == []
