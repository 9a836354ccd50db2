"""Models on planted data: they must find the signal, repeat themselves and stay out of fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctrisk.models import bayes, kernel_bayes, knn, linear, networks, stacking, trees
from acctrisk.models.base import settled
from acctrisk.operators import splits
from acctrisk.plans.evaluate import roc_auc
from acctrisk.session import checkpointed

P = ("a", "b", "c")
N = 1200


@pytest.fixture(scope="module")
def data():
    random = np.random.default_rng(5)
    x = random.normal(size=(N, 3))
    logit = 2.0 * x[:, 0] - 1.0 * x[:, 1] - 0.5
    y = (random.uniform(size=N) < 1 / (1 + np.exp(-logit))).astype(float)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    frame = spark.createDataFrame(
        [(i, float(y[i]), *map(float, x[i])) for i in range(N)], "ID_CPTE long, Default double, a double, b double, c double")
    return checkpointed(splits.hashed_folds(settled(frame, 4), 3))


def auc(df):
    return roc_auc(df, "Default", ["score"]).first()["auc"]


FITS = {
    "tree": (lambda: trees.tree(P, 5, 20, 0.001), 0.75),
    "forest": (lambda: trees.forest(P, trees=10, max_depth=5), 0.8),
    "boosted": (lambda: trees.boosted(P, rounds=10, step=0.3, max_depth=3, min_gain=0.0, min_rows=5), 0.8),
    "boosted_early_stop": (lambda: trees.boosted(
        P, rounds=10, step=0.3, max_depth=3, min_gain=0.0, min_rows=5, holdout=0.2), 0.78),
    "adaptive": (lambda: trees.adaptive(P, rounds=6, max_depth=2, checkpoint_every=2), 0.8),
    "bagged_adaptive": (lambda: trees.bagged_adaptive(P, bags=2, rounds=3, max_depth=2), 0.78),
    "logistic": (lambda: linear.logistic(P), 0.83),
    "stepwise": (lambda: linear.stepwise(P, start=["c"]), 0.83),
    "formula": (lambda: linear.logistic_formula("Default ~ a*b + c"), 0.83),
    "svm_linear": (lambda: linear.svm_linear(P, max_iter=10), 0.83),
    "svm_radial": (lambda: linear.svm_radial(P, size=60, max_iter=10), 0.8),
    "additive": (lambda: linear.additive(P, smooth={"a": 4}, interactions=[("a", "b")]), 0.83),
    "network": (lambda: linear.network_average(P, networks=2, max_iter=20), 0.8),
    "network_decay": (lambda: networks.network_average(P, networks=2), 0.83),
    "bayes": (lambda: bayes.gaussian(P), 0.83),
    "bayes_averaged": (lambda: bayes.model_averaged(P), 0.83),
    "bayes_kernel": (lambda: kernel_bayes.kernel(P), 0.82),
    "knn": (lambda: knn.nearest(P, 16), 0.78),
    "knn_weighted": (lambda: knn.nearest(P, 16, weighted=True), 0.78),
}


@pytest.mark.parametrize("name", FITS)
def test_model_finds_the_signal(rows, name):
    fit, bound = FITS[name]
    train, test = rows.where("fold <> 0").drop("fold"), rows.where("fold = 0").drop("fold")
    scored = fit()(train)(test)
    assert set(scored.columns) == {*test.columns, "score"}
    got = scored.select("ID_CPTE", "score", "Default").collect()
    assert len(got) == test.count() and all(0 <= r.score <= 1 for r in got)
    assert auc(scored) > bound


def test_logistic_matches_newton(rows, data):
    x, y = data
    design = np.column_stack([np.ones(N), x])
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    want = 1 / (1 + np.exp(-design @ beta))
    got = linear.logistic(P)(rows)(rows).orderBy("ID_CPTE").toPandas()["score"].to_numpy()
    assert got == pytest.approx(want, abs=1e-4)


def test_bayes_matches_direct_formula(rows, data):
    x, y = data
    logs = []
    for c in (0, 1):
        part = x[y == c]
        m, v = part.mean(axis=0), part.var(axis=0, ddof=1)
        logs.append(np.log(len(part)) - (0.5 * np.log(2 * np.pi * v) + (x - m) ** 2 / (2 * v)).sum(axis=1))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    got = bayes.gaussian(P)(rows)(rows).orderBy("ID_CPTE").toPandas()["score"].to_numpy()
    assert got == pytest.approx(want, abs=1e-9)


def test_kernel_bayes_matches_the_direct_sum(rows, data):
    x, y = data
    logs = []
    for c in (0, 1):
        part, total = x[y == c], np.log((y == c).sum())
        for j in range(3):
            v = part[:, j]
            quarter = np.quantile(v, 0.75) - np.quantile(v, 0.25)
            width = 0.9 * min(v.std(ddof=1), quarter / 1.34) * len(v) ** -0.2
            z = (x[:, j][:, None] - v[None, :]) / width
            total = total + np.log(np.exp(-0.5 * z * z).mean(axis=1) / (width * np.sqrt(2 * np.pi)) + 1e-300)
        logs.append(total)
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    got = kernel_bayes.kernel(P)(rows)(rows).orderBy("ID_CPTE").toPandas()["score"].to_numpy()
    assert np.abs(got - want).mean() < 0.005


def test_irrelevant_predictor_is_left_out_of_the_average(rows):
    stats = bayes.class_statistics(rows, P)
    assert bayes.inclusion(stats, "a") > 0.99 and bayes.inclusion(stats, "c") < 0.2


@pytest.mark.parametrize("block, pivots", [(20_000, 1), (20_000, 12), (15, 5)])
@pytest.mark.parametrize("weighted", [False, True])
def test_neighbours_equal_brute_force(spark, block, pivots, weighted):
    random = np.random.default_rng(9)
    x = np.round(random.normal(size=(300, 2)), 1)
    x[:100] = x[0]  # a third of the rows are copies
    y = random.integers(0, 2, 300).astype(float)
    frame = spark.createDataFrame(
        [(i, float(y[i]), *map(float, x[i])) for i in range(300)], "ID_CPTE long, Default double, a double, b double")
    train, test = frame.where("ID_CPTE % 4 <> 1"), frame.where("ID_CPTE % 4 = 1")
    got = {r.ID_CPTE: r for r in knn.knn_scores(
        train, test, ("a", "b"), (2, 8), weighted, block, pivots).collect()}
    inside = np.arange(300) % 4 != 1
    z = np.round((x - x[inside].mean(axis=0)) / x[inside].std(axis=0, ddof=1), 6)
    assert len(got) == 75
    for i, r in got.items():
        squared = knn.squared_distances(z[i:i + 1], z[inside])[0]
        for k in (2, 8):
            edge = np.sort(squared)[k - 1]
            near = squared <= edge
            w = np.ones(near.sum())
            after = np.sort(squared)[k]
            if weighted and after > 0 and (squared[near] < after).any():
                w = 1 - np.sqrt(squared[near]) / np.sqrt(after)
            assert r[f"knn_{k}"] == pytest.approx((w * y[inside][near]).sum() / w.sum())


def test_out_of_fold_scores_every_row_once_and_unseen(rows):
    seen = []

    def fit(train):
        seen.append({r.ID_CPTE for r in train.select("ID_CPTE").collect()})
        index = len(seen) - 1
        return lambda df: df.withColumn("score", F.lit(float(index)))

    got = stacking.out_of_fold(rows, fit, 3).collect()
    assert len(got) == N == len({r.ID_CPTE for r in got})
    assert all(r.ID_CPTE not in seen[int(r.score)] for r in got)


def test_two_folds_are_enough(rows):
    two = splits.hashed_folds(rows.drop("fold"), 2)
    assert stacking.out_of_fold(two, linear.logistic(P), 2).count() == N


def test_second_level(rows):
    models = {"v1": linear.logistic(P), "v2": bayes.gaussian(P), "v3": linear.logistic(("a",)),
              "v4": linear.logistic(("b",)), "v5": bayes.model_averaged(P)}
    table = checkpointed(stacking.out_of_fold_table(rows, models, 3))
    assert table.count() == N
    assert auc(stacking.blender()(table)(table)) > 0.83
    votes = stacking.votes(table, list(models), {"v1": 0.257})
    assert votes.columns == ["ID_CPTE", "v1", "v2", "v3", "v4", "v5"]
    more = votes.join(table.select("ID_CPTE", F.col("v1").alias("s")), "ID_CPTE")
    assert more.where("v1 <> int(s >= 0.257)").count() == 0
    staged = stacking.first_stage_feature(rows, linear.logistic(P), 3, "first")
    assert staged.columns == [*rows.columns, "first"] and staged.count() == N


def test_grid(rows):
    grid = stacking.expand_grid(step=[0.1, 0.3], max_depth=[2])
    assert grid == [{"step": 0.1, "max_depth": 2}, {"step": 0.3, "max_depth": 2}]
    result = stacking.grid_search(
        rows, lambda **p: trees.boosted(P, rounds=5, min_gain=0.0, min_rows=5, **p), grid, 3)
    assert result.columns == ["step", "max_depth", "train_auc", "test_auc"] and result.count() == 2
    best = stacking.best_point(result).first()
    assert best.test_auc == max(r.test_auc for r in result.collect()) > 0.75
    with pytest.raises(ValueError):
        trees.boosted(P, step=0.0)


def test_cross_validation_uses_the_fold_column(rows):
    result = stacking.cross_validated_logistic(rows, P, [0.0, 10.0], 3).orderBy("ridge").collect()
    assert result[0].test_auc > 0.83


def test_importance_ranks_the_signal_first(rows):
    table = trees.importance(rows, P, trees=20, max_depth=5).collect()
    assert table[0].predictor == "a" and sum(r.gain for r in table) == pytest.approx(1)


def test_label_and_unknown_predictors_are_rejected(rows):
    for wrong in (("a", "Default"), ("a", "z")):
        with pytest.raises(ValueError):
            linear.logistic(wrong)(rows)


def test_registry_names_every_first_level_model():
    assert list(stacking.registry()) == [
        "svm_radial", "additive", "boosted", "boosted_billing", "boosted_payments", "forest", "network_average",
        "knn_2", "knn_4", "knn_8", "knn_16", "bayes", "bayes_kernel", "bayes_averaged"]


def test_seeded_fits_repeat_for_any_partitioning(spark, rows):
    fit = trees.forest(P, trees=5, max_depth=4)
    def scores(df):
        stored = checkpointed(settled(df, 4))
        return [r.score for r in fit(stored)(stored).orderBy("ID_CPTE").collect()]
    assert scores(rows.repartition(1)) == scores(rows.repartition(8))
