"""Second-order boosting, stepwise selection by sweeping and penalised splines against plain fits."""

import math
from itertools import product

import numpy as np
import pytest

from acctrisk.models import boosting, gram, splines, stepwise
from acctrisk.sources.schemas import KEY, LABEL


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(5)
    x = random.normal(size=(600, 6)).round(3)
    x[:, 5] = x[:, 0] + x[:, 1]  # determined by two others
    eta = 1.2 * x[:, 0] - 0.8 * x[:, 1] + 0.3 * x[:, 2] + np.sin(2 * x[:, 3])
    y = (random.uniform(size=600) < 1 / (1 + np.exp(-eta))).astype(float)
    data = [(i, float(y[i]), i % 3, *map(float, x[i])) for i in range(600)]
    names = ", ".join(f"x{j} double" for j in range(6))
    return spark.createDataFrame(data, f"{KEY} long, `{LABEL}` double, fold int, {names}").repartition(3).persist()


X = [f"x{j}" for j in range(6)]


def arrays(rows):
    data = rows.orderBy(KEY).toPandas()
    return data[X].to_numpy(), data[LABEL].to_numpy()


def plain_tree(x, g, h, s, depth=0):
    """Growth and pruning of one tree by trying every cut: nested tuples, or a leaf's value."""
    leaf = -s.step * g.sum() / (h.sum() + s.l2)
    best = (1e-6, None)
    if depth < s.max_depth:
        for j, cut in ((j, c) for j in range(x.shape[1]) for c in np.unique(x[:, j])[:-1]):
            left = x[:, j] <= cut
            gain = boosting.removed_loss(g[left].sum(), h[left].sum(), g.sum(), h.sum(), s.l2)
            if min(h[left].sum(), h[~left].sum()) >= s.min_hessian and gain > best[0] + 1e-12:
                best = (gain, (j, cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1][0]] <= best[1][1]
    parts = [plain_tree(x[k], g[k], h[k], s, depth + 1) for k in (left, ~left)]
    if best[0] < s.min_loss and not any(isinstance(p, tuple) for p in parts):
        return leaf
    return (*best[1], *parts)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_boosting_equals_plain_trees(rows):
    coarse = rows.select(KEY, LABEL, *[(boosting.F.round(c) + 0.0).alias(c) for c in X[:4]])
    s = boosting.Settings(rounds=12, step=0.3, max_depth=3, min_loss=1.5, min_hessian=4.0, rows=1.0, columns=1.0)
    score = boosting.boosted(X[:4], rounds=12, step=0.3, max_depth=3, min_loss=1.5, min_hessian=4.0, rows=1.0, columns=1.0)(coarse)
    got = {r[KEY]: r["score"] for r in score(coarse).collect()}
    data = coarse.orderBy(KEY).toPandas()
    x, y, margin = data[X[:4]].to_numpy(), data[LABEL].to_numpy(), np.zeros(600)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, p - y, p * (1 - p), s)
        margin += [walk(tree, r) for r in x]
    assert max(abs(got[i] - 1 / (1 + math.exp(-margin[i]))) for i in range(600)) < 1e-9


def test_staged_areas_and_stopping(rows):
    grid = [dict(rounds=40, step=e, max_depth=2, min_loss=0.0, min_hessian=1.0, stop=5) for e in (0.5, 0.1)]
    table = boosting.grid_search(rows, X, grid, 3).collect()
    assert len(table) == 2
    for r in table:
        assert 0.6 < r["test_auc"] <= r["train_auc"] <= 1 and 1 <= r["best_round"] <= r["grown_rounds"] <= 40
    assert min(r["grown_rounds"] for r in table) < 40
    assert boosting.best_round([0.5, 0.7, 0.7, 0.6, None], 3) == (2, True)
    assert boosting.best_round([0.5, 0.7, 0.7], 3) == (2, False)


def test_staged_area_equals_counting_pairs(rows):
    cuts = boosting.bin_cuts(rows, X)
    model = boosting.Model(boosting.Settings(rounds=3, step=0.5, max_depth=3, min_loss=0.0, min_hessian=1.0), 0)
    stored = boosting.binned(rows, X, cuts, 1, boosting.F.col("fold"))
    boosting.train(stored, [model], cuts, [[0]])
    for n in (1, 3):
        scored = boosting.scorer(X, cuts, model.trees[:n])(rows).toPandas()
        for held, area in ((False, model.areas[n - 1][0]), (True, model.areas[n - 1][1])):
            part = scored[(scored["fold"] == 0) == held]
            s = (part["score"] * boosting.SCORE_STEPS).astype(int)
            pairs = [(a > b) + (a == b) / 2 for a, b in product(s[part[LABEL] == 1], s[part[LABEL] == 0])]
            assert area == pytest.approx(sum(pairs) / len(pairs))


def test_importance_and_nodes(rows):
    nodes = boosting.node_table(rows, X, rounds=5, step=0.3, max_depth=3, min_loss=0.0, min_hessian=1.0).persist()
    for r in nodes.where("predictor is not null").collect():  # children share the node's Hessians
        below = [c.cover for c in nodes.where(f"tree = {r.tree} and node in ({2 * r.node + 1}, {2 * r.node + 2})").collect()][:2]
        assert len(below) == 2 and sum(below) == pytest.approx(r.cover)
        break
    shares = boosting.importance(nodes).toPandas()
    assert shares[["gain", "cover", "frequency"]].sum().tolist() == pytest.approx([1, 1, 1])


def test_odd_tables_and_settings(spark, rows):
    same = rows.withColumn("x0", boosting.F.lit(1.0)).limit(50)
    score = boosting.boosted(["x0"], rounds=2)(same)
    assert {r["score"] for r in score(same).collect()} == {0.5}
    for bad in (dict(step=0.0), dict(max_depth=20), dict(stop=3)):
        with pytest.raises(ValueError):
            boosting.boosted(X, **bad)
    with pytest.raises(ValueError):
        boosting.boosted([LABEL])(rows)


def aic(x, y, chosen):
    design, beta = np.column_stack([np.ones(len(y)), *[x[:, j] for j in chosen]]), np.zeros(len(chosen) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        w = p * (1 - p)
        beta = beta + np.linalg.lstsq(design.T * w @ design, design.T @ (y - p), rcond=None)[0]
    p = 1 / (1 + np.exp(-design @ beta))
    return -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)) + 2 * np.linalg.matrix_rank(design)


@pytest.mark.parametrize("start", [[], [0, 1, 2, 3, 4], [4, 5]])
def test_stepwise_path_equals_full_refits(rows, start):
    x, y = arrays(rows)
    steps, chosen, _, _ = stepwise.path(rows, X, [X[j] for j in start])
    now, want = list(start), [(None, None, aic(x, y, start))]
    while True:
        tried = [(aic(x, y, [k for k in now if k != j] if j in now else [*now, j]), j) for j in range(6)
                 if j in now or np.linalg.matrix_rank(x[:, [*now, j]]) == len(now) + 1]
        best, j = min(tried)
        if best >= want[-1][2] - 1e-7:
            break
        want.append((X[j], j not in now, best))
        now = [k for k in now if k != j] if j in now else [*now, j]
    assert [s[:2] for s in steps] == [s[:2] for s in want]
    assert [s[2] for s in steps] == pytest.approx([s[2] for s in want], abs=1e-4)
    assert sorted(chosen) == sorted(X[j] for j in now)


def test_sweep_twice_is_the_matrix():
    a = np.random.default_rng(1).normal(size=(30, 4))
    m = a.T @ a
    assert np.allclose(gram.sweep(gram.sweep(m, 2), 2)[np.ix_([0, 1, 3], [0, 1, 3])], m[np.ix_([0, 1, 3], [0, 1, 3])])


def test_splines_have_the_wanted_degrees(rows):
    smooth = {"x0": 3, "x3": 5}
    terms = splines.Terms(rows, X[:5], smooth, [("x1", "x2")])
    beta, products, _ = gram.logistic_fit(rows, terms.columns, terms.design, terms.size, terms.penalty)
    assert terms.freedoms(products[:-1, :-1]) == pytest.approx({"x0": 3, "x3": 5}, abs=1e-3)
    knots = np.array([0.0, 1.0, 2.5, 4.0])
    parts = splines.basis(np.linspace(-1, 5, 50), knots)
    assert parts.shape[1] == 6 and np.allclose(parts.sum(axis=1), 1) and (parts >= 0).all()
    curved = splines.additive(X[:5], smooth, [("x1", "x2")])(rows)(rows).toPandas()
    flat = splines.additive(X[:5], {"x0": 3}, [])(rows)(rows).toPandas()
    assert deviance(flat) - deviance(curved) > 11.07  # chance gives less in 95 % of cases, at five degrees


def deviance(scored):
    return -2 * np.log(np.where(scored[LABEL] == 1, scored["score"], 1 - scored["score"])).sum()


def test_a_task_gives_one_row_per_node_and_either_way_adds_up_alike(rows, monkeypatch):
    cuts = boosting.bin_cuts(rows, X)
    stored = boosting.binned(rows, X, cuts, 2, boosting.F.col("fold"))
    used = [j for j, c in enumerate(cuts) if c]
    root = {m: {"share": 1.0, "held": m, "tree": boosting.Tree().arrays(), "open": boosting.np.array([0]), "predictors": used} for m in (0, 1)}
    sums = boosting.cut_sums(stored, root, [], 0)
    assert sums.count() <= 2 * stored.rdd.getNumPartitions()
    found = []
    for most in (0, 1 << 30):
        monkeypatch.setattr(boosting, "DRIVER_BYTES", most)
        settings = {m: boosting.Settings(min_hessian=1.0) for m in root}
        found.append(sorted(boosting._best(sums, root, settings, [len(c) for c in cuts], 4)))
    assert len(found[0]) == 2
    for a, b in zip(*found):
        assert a[:3] == b[:3] and a[4:6] == b[4:6] and a[3] == pytest.approx(b[3])


def test_both_ways_down_a_tree_agree(monkeypatch):
    random = boosting.np.random.default_rng(4)
    x = random.integers(0, 64, (5, 3000)).astype("uint8")
    tree = boosting.Tree({n: (int(random.integers(5)), int(random.integers(64))) for n in [0, 1, 2, 4, 5, 9, 10, 300]})
    few = boosting._nodes(tree.arrays(), x)
    monkeypatch.setattr(boosting, "FEW_SPLITS", 0)
    assert (few == boosting._nodes(tree.arrays(), x)).all() and len(set(few.tolist())) > 4
