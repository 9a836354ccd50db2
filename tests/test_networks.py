"""Networks with weight decay: gradients, repeatability and settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctrisk.models import networks
from acctrisk.models.networks import Net
from acctrisk.operators import splits

P, N = ("a", "b"), 900


@pytest.fixture(scope="module")
def data():
    random = np.random.default_rng(3)
    x = random.normal(size=(N, 2))
    odds = 3 * np.tanh(x[:, 0] * x[:, 1]) + x[:, 0]  # a line can't find the product
    return x, (random.uniform(size=N) < 1 / (1 + np.exp(-odds))).astype(float)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    frame = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(N)], "ID_CPTE long, Default double, a double, b double")
    return splits.hashed_folds(frame.repartition(3), 3).persist()


def test_gradient_equals_finite_differences(data):
    x, y = np.column_stack([np.ones(N), data[0]]), data[1]
    random = np.random.default_rng(1)
    for size in (1, 4):
        theta, weight = random.normal(size=size * 4 + 1), random.poisson(1.0, N).astype(float)
        value = lambda t: networks.penalised(networks.row_sums(t, size, x, y, weight), t, 0.3)
        steps = np.eye(len(theta)) * 1e-5
        numeric = [(value(theta + s)[0] - value(theta - s)[0]) / 2e-5 for s in steps]
        assert np.allclose(value(theta)[1], numeric, rtol=1e-5, atol=1e-4)
        assert np.linalg.eigvalsh(value(theta)[2]).min() >= 0.6 - 1e-9


def test_sums_of_spark_are_those_of_one_pass(spark, rows, data):
    net = Net(size=3, bag_seed=7919, held=1)
    moments, (theta,) = networks.fit_networks(rows, P, [net])
    kept = {r[0]: r[1] for r in rows.select("ID_CPTE", net.weight().alias("w")).collect()}
    x = np.column_stack([np.ones(N), *[(data[0][:, i] - moments[p][0]) / moments[p][1] for i, p in enumerate(P)]])
    weight = np.array([kept[i] for i in range(N)])
    assert 0 < weight.sum() < N and set(weight) > {0.0, 1.0, 2.0}
    loss, gradient, _ = networks.penalised(networks.row_sums(theta, 3, x, data[1], weight), theta, net.decay)
    assert np.abs(gradient).max() < 0.5 and loss < 0.95 * len(data[1]) * np.log(2)


def test_decay_shrinks_and_partitions_do_not_matter(rows):
    sizes = []
    for decay in (0.01, 1.0, 100.0):
        _, found = networks.fit_networks(rows, P, [Net(size=2, decay=decay)])
        sizes.append(np.abs(found[0]).sum())
    assert sizes[0] > sizes[1] > sizes[2]
    scores = [networks.network_average(P, networks=2)(r)(rows).select("ID_CPTE", F.round("score", 4)).orderBy("ID_CPTE").collect()
              for r in (rows, rows.repartition(7, "b"))]
    assert scores[0] == scores[1]


def test_grid_leaves_the_fold_out(rows):
    table = networks.network_grid(rows, P, (1, 3), (0.1, 0.5), 3, networks=2).collect()
    assert len(table) == 12 and {(r["size"], r["decay"], r["fold"]) for r in table} == {(s, d, f) for s in (1, 3) for d in (0.1, 0.5) for f in range(3)}
    mean = lambda s: np.mean([r["auc"] for r in table if r["size"] == s])
    assert mean(3) > 0.75 and mean(3) > mean(1)


def test_incomplete_rows_and_label_are_refused(rows):
    with pytest.raises(ValueError, match="complete"):
        networks.fit_networks(rows.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), P, [Net()])
    with pytest.raises(ValueError, match="label"):
        networks.fit_networks(rows, ("a", "Default"), [Net()])


def test_sums_leave_a_task_as_one_row_per_network(spark, rows, data, monkeypatch):
    x, y = np.column_stack([np.ones(N), data[0]]), data[1]
    products = x[:, np.triu_indices(3)[0]] * x[:, np.triu_indices(3)[1]]
    random = np.random.default_rng(5)
    for size in (1, 3):
        theta, weight = random.normal(size=size * 4 + 1), random.poisson(1.0, N).astype(float)
        found = networks._whole(size, 2, networks._part_sums(theta, size, x, products, y, weight))
        for a, b in zip(found, networks.row_sums(theta, size, x, y, weight)):
            assert np.allclose(a, b, rtol=1e-10, atol=1e-10)
    left = []
    monkeypatch.setattr(type(rows), "mapInArrow", _counting(type(rows).mapInArrow, left))
    table = rows.select(F.col("Default").alias("y"), F.col("a").alias("x0"), F.col("b").alias("x1"), F.lit(1.0).alias("w0"))
    networks.network_sums(table, 2, {m: (0, 3, random.normal(size=13)) for m in range(4)})
    assert left[0] <= 4 * table.rdd.getNumPartitions()


def _counting(original, left):
    def counted(self, *args, **kwargs):
        out = original(self, *args, **kwargs)
        left.append(out.count())
        return out
    return counted
