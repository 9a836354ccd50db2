"""Forests with bags by hash, judged out of their bags."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctrisk.models import boosting, oob
from acctrisk.sources.schemas import KEY, LABEL

X = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data():
    random = np.random.default_rng(11)
    x = random.integers(0, 25, (800, 4)).astype(float)
    wanted = (x[:, 0] > 12) ^ (x[:, 1] > 17)
    y = np.where(random.uniform(size=800) < 0.1, ~wanted, wanted).astype(float)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(800)],
                                 f"{KEY} long, `{LABEL}` double, x0 double, x1 double, x2 double, x3 double").repartition(3).persist()


def test_bags_are_poisson_and_repeatable():
    keys = np.arange(200_000)
    drawn = oob.bag(keys, 3)
    assert (drawn == oob.bag(keys, 3)).all() and (drawn != oob.bag(keys, 4)).any()
    for k in range(4):
        assert (drawn == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)


def test_best_cut_by_brute_force():
    random = np.random.default_rng(2)
    for _ in range(20):
        zeros, ones = random.integers(0, 4, (2, 3, 8))
        zeros[1:], ones[1:] = zeros[0][random.permutation(8)], ones[0][random.permutation(8)]

        def impurity(a, b):
            return a + b - (a * a + b * b) / max(a + b, 1)

        falls = [(impurity(zeros[j].sum(), ones[j].sum()) - impurity(zeros[j][:k].sum(), ones[j][:k].sum())
                  - impurity(zeros[j][k:].sum(), ones[j][k:].sum())) for j in range(3) for k in range(1, 8)]
        assert oob.best_cut(zeros, ones)[0] == pytest.approx(max(falls + [0]))


def own_tree(x, y, weight, tree, usable, max_depth, min_rows=2):
    """The same tree from all rows at hand."""
    splits, todo = {}, [(0, weight > 0)]
    while todo:
        node, here = todo.pop()
        w, t = weight * here, y == 1
        if w.sum() < min_rows or not (w * t).sum() or not (w * ~t).sum() or (node + 1).bit_length() > max_depth:
            continue
        drawn = oob.drawn_predictors(usable, tree.per_split, tree.number, node)
        zeros = np.array([np.bincount(x[:, f], w * ~t, boosting.BINS) for f in drawn])
        ones = np.array([np.bincount(x[:, f], w * t, boosting.BINS) for f in drawn])
        fall, j, k, _, _ = oob.best_cut(zeros, ones)
        if fall <= 1e-9:
            continue
        splits[node] = drawn[j], k
        left = x[:, drawn[j]] <= k
        todo += [(2 * node + 1, here & left), (2 * node + 2, here & ~left)]
    return splits


@pytest.mark.parametrize("cells", [oob.CELLS, 2000])
def test_trees_and_votes_against_plain_python(rows, data, monkeypatch, cells):
    monkeypatch.setattr(oob, "CELLS", cells)
    x, y = data
    grown, votes, cuts = oob.tune(rows, X, (1, 3), trees=4, max_depth=4)
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    keys = np.arange(len(y))
    ones, judges = {m: np.zeros(len(y), int) for m in (1, 3)}, {m: np.zeros(len(y), int) for m in (1, 3)}
    for tree in grown:
        weight = oob.bag(keys, tree.number)
        assert tree.splits == own_tree(binned, y, weight, tree, range(4), 4)
        leaf = np.zeros(len(y), int)
        for _ in range(4):
            leaf = np.array([2 * n + 1 + (binned[i, tree.splits[n][0]] > tree.splits[n][1]) if n in tree.splits else n for i, n in enumerate(leaf)])
        for i in np.flatnonzero(weight == 0):
            inside = (leaf == leaf[i]) * weight
            judges[tree.per_split][i] += 1
            ones[tree.per_split][i] += 2 * (inside * y).sum() > inside.sum()
    got = votes.collect()
    assert len(got) == 2 * len(y)
    for r in got:
        assert (r.votes, r.ones) == (judges[r.per_split][r[KEY]], ones[r.per_split][r[KEY]])


def test_one_row_per_setting_and_no_optimism(rows, data):
    x, y = data
    table = {r.per_split: r for r in oob.oob_table(rows, X, (1, 2, 4), trees=30, max_depth=6).collect()}
    assert set(table) == {1, 2, 4}
    for r in table.values():
        assert r.n_rows == 800 and r.n_judged == 800 and r.oob_share == pytest.approx(math.exp(-1), abs=0.02)
    assert table[4].oob_error < 0.2 < 0.5
    scored = oob.tuned_forest(X, (1, 4), trees=20, max_depth=6)(rows)(rows).toPandas()
    assert ((scored["score"] > 0.5) == (scored[LABEL] == 1)).mean() > 0.85


def test_flat_predictors(rows):
    flat = rows.withColumn("x0", F.lit(1.0)).select(KEY, LABEL, "x0")
    r, = oob.oob_table(flat, ["x0"], (1,), trees=5).collect()
    assert r.n_rows == 800 and 0 < r.oob_error < 1
    scored = oob.tuned_forest(["x0"], (1,), trees=5)(flat)(flat).toPandas()
    assert scored["score"].nunique() == 1 and 0.2 < scored["score"][0] < 0.8
    with pytest.raises(ValueError):
        oob.oob_table(rows, X, (0,), trees=2)
