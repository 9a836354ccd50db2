"""Evaluation tables, running totals, quantiles and splits."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from acctrisk.functions.bins import bin_index
from acctrisk.operators import quantiles, running, splits
from acctrisk.operators.skew import heavy_keys
from acctrisk.plans import evaluate

SIX = [(1, 0, 0.10), (2, 0, 0.40), (3, 1, 0.35), (4, 1, 0.80), (5, 0, 0.40), (6, 1, 0.40)]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame(SIX, "key long, obs int, mod1 double")


def test_lorenz_of_the_worked_example(six):
    rows = evaluate.lorenz_points(six, "obs", ["mod1"], "key").orderBy("exposure").collect()
    assert [r.key for r in rows] == [1, 3, 2, 5, 6, 4]
    assert [r.observed_share for r in rows] == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3, 2 / 3, 1])
    assert [r.exposure_share for r in rows] == pytest.approx([i / 6 for i in range(1, 7)])


def test_gini_and_auc_of_the_worked_example(six):
    assert evaluate.gini(six, "obs", ["mod1"], "key").first().gini == pytest.approx(10 / 36)
    assert evaluate.roc_auc(six, "obs", ["mod1"]).first().auc == pytest.approx(2 / 3)


def test_roc_of_the_worked_example(six):
    rows = evaluate.roc_points(six, "obs", ["mod1"]).orderBy(F.desc("threshold")).collect()
    assert [(r.fpr, r.tpr) for r in rows] == [
        pytest.approx(p) for p in ((0, 1 / 3), (2 / 3, 2 / 3), (2 / 3, 1), (1, 1))]


def test_confusion_of_the_worked_example(six):
    rows = evaluate.confusion(six, "obs", "mod1", 0.40).orderBy("obs").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 2), (1, 1, 2)]


def test_auc_with_one_class_is_undefined_and_direction_can_be_chosen(spark, six):
    assert evaluate.roc_auc(six.where("obs = 1"), "obs", ["mod1"]).first().auc is None
    turned = six.withColumn("mod1", -F.col("mod1"))
    assert evaluate.roc_auc(turned, "obs", ["mod1"], direction="auto").first().auc == pytest.approx(2 / 3)


def test_unknown_model_column_is_rejected(six):
    with pytest.raises(ValueError):
        evaluate.roc_auc(six, "obs", ["mod9"])


def test_repeated_quantiles_make_fewer_bins(spark):
    df = spark.createDataFrame([(float(v), 1, 0.5, 0.5) for v in (1, 1, 1, 1, 2, 9)], "v double, obs int, a double, b double")
    breaks = quantiles.quantile_breaks(df, "v", 4)
    assert breaks == [1.0, 1.75, 9.0]
    rows = {r.bin: r.exposure for r in evaluate.observed_by_bin(df, "obs", "a", "b", "v", 4).collect()}
    assert rows == {None: 4, 2: 2}


def test_missing_values_share_the_null_bin(spark):
    df = spark.createDataFrame([(None,), (1.0,), (1.5,), (3.0,)], "v double")
    assert [r.b for r in df.select(bin_index("v", [1.0, 2.0, 3.0]).alias("b")).collect()] == [None, None, 1, 2]


def test_report_by_value_for_few_values_and_by_bin_for_many(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("obs"), F.lit(0.5).alias("a"), F.lit(0.5).alias("b"),
                                  F.col("id").cast("double").alias("many"), (F.col("id") % 7).alias("few"))
    assert "bin" in evaluate.observed_vs_predicted(df, "obs", "a", "b", "many", 10).columns
    assert evaluate.observed_vs_predicted(df, "obs", "a", "b", "few", 10).count() == 7


@pytest.mark.parametrize("buckets", [2, 8, 256])
@pytest.mark.parametrize("value", ["id % 1000 / 7.0", "if(id % 3 = 0, 5.0, id % 11)", "1.0", "cast(null as double)"])
def test_running_totals_equal_a_global_window(spark, buckets, value):
    df = spark.range(3000).select(F.col("id").alias("k"), F.expr(value).cast("double").alias("v"),
                                  F.expr("id % 5").alias("x"), F.expr("if(id % 4 = 0, null, id % 2)").alias("g"))
    got = running.running_totals(df, "v", {"s": F.col("x"), "n": F.lit(1)}, tie="k", by=["g"], buckets=buckets)
    w = Window.partitionBy("g").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("g")
    want = df.select("k", "v", "x", "g", F.sum("x").over(w).alias("s"), F.count("*").over(w).alias("n"),
                     F.sum("x").over(whole).alias("s_total"), F.count("*").over(whole).alias("n_total"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_totals_of_large_integers(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.expr("9007199254740990 + id % 7").alias("v"))
    got = running.running_totals(df, "v", {"n": F.lit(1)}, tie="k", buckets=8)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("v", "k")))
    assert sorted((r.k, r.n) for r in got.collect()) == sorted((r.k, r.n) for r in want.collect())


@pytest.mark.parametrize("buckets", [2, 256, 8])
def test_exact_quantiles_per_group(spark, buckets):
    random = np.random.default_rng(3)
    data = [(int(g), float(v)) for g, v in zip(random.integers(0, 3, 900), random.integers(0, 60, 900))]
    data += [(3, 4.0)] * 5 + [(4, 1.0), (None, 7.0), (None, 8.0)]
    df = spark.createDataFrame(data, "g int, v double")
    steps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, "v", steps, by=["g"], buckets=buckets).collect()
    assert len(got) == 6 * len(steps)
    for r in got:
        assert r.quantile == pytest.approx(np.quantile([v for g, v in data if g == r.g], r.p))


def test_approximate_breaks_are_close(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.quantile_breaks(df, "v", 4, approximate=True) == pytest.approx([0, 2500, 5000, 7500, 10_000], abs=5)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).count() == 0


def test_heavy_keys_finds_all_of_them(spark):
    df = spark.range(10_000).select(F.expr("if(id % 3 = 0, 7, id)").alias("k"))
    assert [r.k for r in heavy_keys(df, "k", rows=1000).collect()] == [7]
    assert heavy_keys(df, "k", rows=100_000).isEmpty()
    assert heavy_keys(spark.range(30_000).selectExpr("id % 3000 AS k"), "k", rows=10).count() == 3000


def accounts(spark):
    return spark.range(1000).select(F.col("id").alias("ID_CPTE"), F.expr("int(id % 5 = 0)").alias("Default"))


def test_split_is_exact_per_class(spark):
    rows = splits.stratified_split(accounts(spark), 0.7).groupBy("Default").agg(F.count_if("in_train").alias("n"))
    assert {r.Default: r.n for r in rows.collect()} == {0: 560, 1: 140}


@pytest.mark.parametrize("k", [2, 10])
def test_folds_are_balanced_and_cover_everything(spark, k):
    folds = splits.balanced_folds(accounts(spark), k)
    counts = folds.groupBy("Default", "fold").count().collect()
    assert len(counts) == 2 * k and folds.select("ID_CPTE").distinct().count() == 1000
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r.Default == label]
        assert max(sizes) - min(sizes) <= 1


def test_splits_do_not_depend_on_partitions(spark):
    a = splits.balanced_folds(accounts(spark).repartition(1), 10)
    b = splits.balanced_folds(accounts(spark).repartition(13), 10)
    assert sorted(a.collect()) == sorted(b.collect())


def test_bootstrap_weights_look_like_poisson(spark):
    row = splits.bootstrap_weights(spark.range(20_000).withColumnRenamed("id", "ID_CPTE"), 1).agg(
        F.avg("weight_1").alias("m"), F.var_samp("weight_1").alias("v")).first()
    assert row.m == pytest.approx(1, abs=0.03) and row.v == pytest.approx(1, abs=0.05)


def test_subsample_and_repeated_folds(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "ID_CPTE")
    assert splits.subsample(keys, 0.8).count() / 20_000 == pytest.approx(0.8, abs=0.02)
    same = splits.repeated_folds(keys, 5, 2).where("fold_1 = fold_2").count() / 20_000
    assert same == pytest.approx(0.2, abs=0.02)
