"""Fractional observed values, CSV columns by name, quantiles of many groups, missing flags, heavy accounts, one class."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from acctrisk.models import bayes, kernel_bayes
from acctrisk.operators.quantiles import exact_quantiles
from acctrisk.operators.running import running_totals
from acctrisk.plans import evaluate, payments
from acctrisk.sources import tables


def test_fractional_observed_values_add_up(spark):
    df = spark.createDataFrame([(1, 0.6, 0.1), (2, 1.5, 0.2), (3, 0.9, 0.3)], "key long, obs double, mod1 double")
    rows = sorted((r["key"], r["observed"]) for r in evaluate.lorenz_points(df, "obs", ["mod1"], "key").collect())
    assert [k for k, _ in rows] == [1, 2, 3]
    assert [v for _, v in rows] == pytest.approx([0.6, 2.1, 3.0])
    assert evaluate.gini(df, "obs", ["mod1"], "key").first()["gini"] == pytest.approx(1 - 2 * (1.35 + 2.55) / 9)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,extra,a\nx,1,2\ny,,3\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t.csv"), schema, code_columns=()).collect())) == [(2, "x"), (3, "y")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "t.csv"), T.StructType([T.StructField("c", T.LongType())])).collect()


def test_quantiles_of_many_groups(spark):
    df = spark.range(3000).selectExpr("id % 1500 AS g", "CAST(id AS DOUBLE) AS v")
    rows = exact_quantiles(df, "v", [0.5], by=["g"]).collect()
    assert len(rows) == 1500 and all(r["quantile"] == r["g"] + 750 for r in rows)


PAYMENTS = "ID_CPTE long, TRANSACTION_AMT double, TRANSACTION_DTTM timestamp, PAYMENT_REVERSAL_XFLG string"


def test_a_missing_flag_makes_the_flags_of_its_account_false(spark):
    rows = [(1, 1.0, "N"), (1, 1.0, None), (2, 1.0, "N"), (2, 1.0, "Y")]
    df = spark.createDataFrame([(k, v, datetime(2001, 1, 1), f) for k, v, f in rows], PAYMENTS)
    assert [r.reversedPayment for r in payments.features(df).orderBy("ID_CPTE").collect()] == [False, True]
    assert [r.reversedPayment for r in payments.features(df, skip_missing=True).orderBy("ID_CPTE").collect()] == [True, True]


def test_more_than_a_thousand_heavy_accounts(spark):
    df = spark.range(6000).selectExpr(
        "id % 1500 AS ID_CPTE", "CAST(id AS DOUBLE) AS TRANSACTION_AMT", "TIMESTAMP '2001-01-01' AS TRANSACTION_DTTM",
        "'Y' AS PAYMENT_REVERSAL_XFLG")
    rows = payments.features(df, hot_rows=4).collect()
    assert len(rows) == 1500 and all(r.median_payment == r.ID_CPTE + 2250 for r in rows)


def test_one_class_is_refused(spark):
    train = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], 'x double, `Default` double')
    for fit in (bayes.gaussian(["x"]), bayes.model_averaged(["x"]), kernel_bayes.kernel(["x"])):
        with pytest.raises(ValueError, match="both classes"):
            fit(train)


def test_running_totals_of_integers_beyond_doubles(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(2 ** 60 + F.col("id") % 7).alias("v"))
    got = running_totals(df, "v", {"n": F.lit(1)}, tie="id").orderBy("v", "id").collect()
    assert [r.n for r in got] == list(range(1, 3001))
