"""Edge cases of the feature tables, on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from acctrisk.functions import columns as C
from acctrisk.operators import joins, nulls
from acctrisk.operators.sequence import change_sign, with_previous_period
from acctrisk.plans import billing, mart, payments, profile, proposals, transactions
from acctrisk.sources import schemas, tables

BILLING = "ID_CPTE long, PERIODID_MY date, CurrentTotalBalance double, CashBalance double, CreditLimit double, DelqCycle int"
PAYMENTS = "ID_CPTE long, TRANSACTION_AMT double, TRANSACTION_DTTM timestamp, PAYMENT_REVERSAL_XFLG string"
TRANSACTIONS = ("ID_CPTE long, TRANSACTION_AMT double, PRIOR_CREDIT_LIMIT_AMT double, TRANSACTION_TYPE_XCD string, "
                "TRANSACTION_CATEGORY_XCD string, MERCHANT_COUNTRY_XCD string")


def day(month, number=1, year=2020):
    return dt.date(year, month, number)


def at(month, number, hour=0):
    return dt.datetime(2020, month, number, hour)


def statements(spark, rows):
    return spark.createDataFrame(rows, BILLING)


def test_zero_limit_gives_no_ratio_but_a_flag(spark):
    row = billing.derived(statements(spark, [(1, day(1), 50.0, 10.0, 0.0, 0)])).first()
    assert row.TotalBalanceOL_perc is None and row.TotalBalanceOL_ind == 1
    assert row.CB_limit_perc is None and row.Delinquent == 0


def test_unknown_values_keep_flags_unknown(spark):
    row = billing.derived(statements(spark, [(1, day(1), None, 10.0, 100.0, None)])).first()
    assert row.TotalBalanceOL_ind is None and row.Delinquent is None and row.CB_ind == 1


def test_strict_aggregates_lose_a_group_with_a_gap(spark):
    df = statements(spark, [(1, day(1), None, 1.0, 100.0, 0), (1, day(2), 20.0, 3.0, 100.0, 2)])
    strict, relaxed = billing.features(df).first(), billing.features(df, skip_missing=True).first()
    assert strict.mean_balance is None and strict.max_balance is None
    assert strict.mean_cash_balance == 2.0 and strict.count_num_cmp == 1 and strict.credit_change is False
    assert relaxed.mean_balance == 20.0
    assert nulls.fill_with_zero(billing.features(df)).first().mean_balance == 0.0


def test_payment_flags_and_fill(spark):
    df = spark.createDataFrame([
        (1, 10.0, at(1, 1), "N"), (1, 20.0, at(1, 2), ""), (1, 60.0, at(1, 3), "Y"),
        (2, None, at(1, 1), "Y"), (2, 5.0, at(1, 2), "Y")], PAYMENTS)
    one, two = payments.features(df).orderBy("ID_CPTE").collect()
    assert (one.mean_payment, one.median_payment, one.number_payments) == (30.0, 20.0, 3)
    assert one.reversedPayment and one.noPayments
    assert (two.mean_payment, two.median_payment, two.number_payments) == (0.0, 0.0, 2)
    assert not two.reversedPayment and not two.noPayments
    assert payments.features(df, skip_missing=True).where("ID_CPTE = 2").first().median_payment == 5.0


@pytest.mark.parametrize("skip", [False, True])
def test_heavy_accounts_get_the_same_features(spark, skip):
    rows = [(k, None if k == 3 and i == 4 else float(i * 37 % 101), at(1, 1 + i % 28), "NY"[i % 2])
            for k, n in ((1, 400), (2, 3), (3, 150)) for i in range(n)]
    df = spark.createDataFrame(rows, PAYMENTS)
    plain = payments.features(df, skip_missing=skip).orderBy("ID_CPTE").collect()
    spread = payments.features(df, skip_missing=skip, hot_rows=100).orderBy("ID_CPTE").collect()
    assert plain == spread


def test_mode_tie_takes_the_first_level_and_shares_add_up(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 0.0, t, "A", "DP") for t in "BABA"] + [(2, 5.0, 10.0, "C", None, "US")], TRANSACTIONS)
    one, two = transactions.features(df).orderBy("ID_CPTE").collect()
    assert one.trx_type_mode == "A" and one.mean_trx_pct == 0.0 and one.traveller_ind == 1
    assert sum(one[f"trx_type_{v}_perc"] for v in C.TRANSACTION_TYPES) == 1.0
    assert two.traveller_ind == 0 and two.mean_trx_pct == 0.5
    assert two.trx_cat_mode is None and two.trx_cat_A_perc is None


def test_accounts_without_transactions_get_population_means(spark):
    account = spark.createDataFrame(
        [(1, 10.0, 0.1, 2), (2, 30.0, 0.3, 4), (3, None, None, None)],
        "ID_CPTE long, mean_trx_amt double, mean_trx_pct double, number_transactions long")
    row = mart.fill_transactions(account).where("ID_CPTE = 3").first()
    assert (row.mean_trx_amt, row.mean_trx_pct, row.number_transactions) == (20.0, pytest.approx(0.2), 3.0)


def test_account_table_drops_and_keeps_the_right_accounts(spark):
    bills = statements(spark, [(k, day(1), 50.0, 10.0, 100.0, 0) for k in (1, 2, 3)])
    pays = spark.createDataFrame([(k, 5.0, at(1, 2), "Y") for k in (1, 2, 4)], PAYMENTS)
    buys = spark.createDataFrame([(1, 5.0, 100.0, "A", "B", "DP")], TRANSACTIONS)
    labels = spark.createDataFrame([(k, day(1), k % 2) for k in (1, 2, 3, 4)], schemas.PERFORMANCE)
    rows = mart.account_table(bills, pays, buys, labels).orderBy("ID_CPTE").collect()
    assert [(r.ID_CPTE, r.number_transactions) for r in rows] == [(1, 1), (2, None)]


@pytest.mark.parametrize("impute, amounts", [(True, [15.0, 20.0]), (False, [0.0, 20.0])])
def test_missing_payments_become_the_mean_of_all_before_they_are_aggregated(spark, impute, amounts):
    bills = statements(spark, [(k, day(1), 50.0, 10.0, 100.0, 0) for k in (1, 2)])
    pays = spark.createDataFrame([(1, 10.0, at(1, 2), "Y"), (1, None, at(1, 3), "Y"), (2, 20.0, at(1, 2), "Y"), (3, 30.0, at(1, 2), "Y")], PAYMENTS)
    buys = spark.createDataFrame([], TRANSACTIONS)
    labels = spark.createDataFrame([(k, day(1), 0) for k in (1, 2)], schemas.PERFORMANCE)
    rows = mart.account_table(bills, pays, buys, labels, impute=impute).orderBy("ID_CPTE").collect()
    assert [r.mean_payment for r in rows] == amounts


def test_label_cannot_be_a_predictor(spark):
    with pytest.raises(ValueError):
        mart.model_table(spark.createDataFrame([(1, 1)], "ID_CPTE long, Default int"), ("Default",))


def test_recodes_keep_missing_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "y int")
    text = df.select(C.label_to_text("y").alias("t"))
    assert [r.t for r in text.collect()] == ["No", "Yes", None]
    assert [r.n for r in text.select(C.label_to_number("t").alias("n")).collect()] == [0, 1, None]


def test_unknown_columns_are_rejected(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.keep(df, ["b", "c"], strict=False).columns == ["b"]
    assert C.leave_out(df, ["b"]).columns == ["a"]
    for wrong in (lambda: C.keep(df, ["c"]), lambda: C.leave_out(df, ["c"]), lambda: tables.require_columns(df, "c")):
        with pytest.raises(ValueError):
            wrong()


def test_csv_blank_and_missing(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text('ID_CPTE,TRANSACTION_AMT,TRANSACTION_DTTM,PAYMENT_REVERSAL_XFLG\n'
                    '1,NA,2020-01-01 10:00:00,\n2,3.5,2020-01-02 00:00:00,""\n3,,2020-01-03 00:00:00,NA\n'
                    '4,1.5,2020-01-04 00:00:00,N\n')
    rows = tables.read_table(spark, str(path), "payments").orderBy("ID_CPTE").collect()
    assert [r.TRANSACTION_AMT for r in rows] == [None, 3.5, None, 1.5]
    assert [r.PAYMENT_REVERSAL_XFLG for r in rows] == ["", "", None, "N"]
    assert rows[0].TRANSACTION_DTTM == dt.datetime(2020, 1, 1, 10)


def test_csv_with_a_bad_number_fails(spark, tmp_path):
    path = tmp_path / "performance.csv"
    path.write_text("ID_CPTE,PERIODID_MY,Default\n1,2020-01-01,many\n")
    with pytest.raises(Exception):
        tables.read_table(spark, str(path), "performance").collect()


def test_sinks_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.25), (2, 0.75)], "ID_CPTE long, score double")
    out = tables.submission(scored)
    tables.write_csv(out, str(tmp_path / "csv"))
    tables.write_parquet(out, str(tmp_path / "parquet"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, schema="ID_CPTE long, Default double")
    assert sorted(back.collect()) == sorted(tables.read_scored(spark, str(tmp_path / "parquet")).collect())
    with pytest.raises(Exception):
        tables.write_csv(out, str(tmp_path / "csv"))


def test_lag_and_sign_stay_within_the_account(spark):
    df = statements(spark, [(1, day(3), 5.0, 0.0, 1.0, 0), (2, day(2), 7.0, 0.0, 1.0, 0), (1, day(1), 9.0, 0.0, 1.0, 0),
                            (2, day(1), 7.0, 0.0, 1.0, 0), (1, day(2), 9.0, 0.0, 1.0, 0), (2, day(4), 8.0, 0.0, 1.0, 0)])
    rows = with_previous_period(df).withColumn("step", change_sign("CurrentTotalBalance")).orderBy("ID_CPTE", "PERIODID_MY")
    assert [(r.lag_period, r.step) for r in rows.collect()] == [
        (None, None), (day(1), 0), (day(2), -1), (None, None), (day(1), 0), (day(2), 1)]


def test_payment_on_a_statement_day_belongs_to_the_next_statement(spark):
    lagged = with_previous_period(statements(spark, [
        (1, day(1), 1.0, 0.0, 1.0, 0), (1, day(2), 2.0, 0.0, 1.0, 0), (1, day(3), 3.0, 0.0, 1.0, 0)]))
    pays = spark.createDataFrame([
        (1, 10.0, at(1, 1), "Y"), (1, 20.0, at(2, 1), "Y"), (1, 30.0, at(2, 1, 23), "Y"), (1, 40.0, at(3, 1), "Y")], PAYMENTS)
    got = joins.statement_payments_join(lagged, pays, "inner")
    assert sorted((r.PERIODID_MY, r.TRANSACTION_AMT) for r in got.collect()) == [
        (day(2), 10.0), (day(3), 20.0), (day(3), 30.0)]
    left = joins.statement_payments_join(lagged, pays, "left")
    assert sorted((r.PERIODID_MY, r.TRANSACTION_AMT or 0.0) for r in left.collect()) == [
        (day(1), 0.0), (day(2), 10.0), (day(3), 20.0), (day(3), 30.0)]
    paid = proposals.paid_by_statement(lagged.drop("lag_period"), pays)
    assert {(r.PERIODID_MY, r.paid) for r in paid.collect()} == {(day(2), 10.0), (day(3), 50.0)}


def test_statement_dates_inside_a_month(spark):
    lagged = with_previous_period(statements(spark, [(1, day(1, 10), 1.0, 0.0, 1.0, 0), (1, day(2, 20), 2.0, 0.0, 1.0, 0)]))
    pays = spark.createDataFrame([(1, float(n), at(m, n), "Y") for m, n in ((1, 9), (1, 10), (2, 19), (2, 20))], PAYMENTS)
    got = joins.statement_payments_join(lagged, pays, "inner")
    assert sorted(r.TRANSACTION_AMT for r in got.collect()) == [10.0, 19.0]


def test_null_profile_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert [tuple(r) for r in nulls.null_profile(df).collect()] == [("a", 1, 2), ("b", 2, 1)]


def test_group_mean_fill_leaves_an_empty_group_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, None)], "k int, x double")
    rows = nulls.fill_with_group_mean(df, "x", "k").collect()
    assert sorted((r.k, r.x if r.x is not None else -1.0) for r in rows) == [(1, 2.0), (1, 2.0), (2, -1.0)]


def test_side_by_side_is_by_key(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "ID_CPTE long, score double")
    b = spark.createDataFrame([(2, 0.9), (1, 0.8)], "ID_CPTE long, score double")
    rows = joins.side_by_side({"x": a, "y": b}).orderBy("ID_CPTE").collect()
    assert [tuple(r) for r in rows] == [(1, 0.1, 0.8), (2, 0.2, 0.9)]


def test_describe_by_matches_direct_formulas(spark):
    import numpy as np
    values = [float(v * v % 97) for v in range(60)]
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, x double")
    for row in profile.describe_by(df, "g", "x").collect():
        x = np.sort([v for i, v in enumerate(values) if ("a" if i % 3 else "b") == row.g])
        n, cut = len(x), int(len(x) * 0.1)
        z = x - x.mean()
        assert row.median == np.median(x) and row.n == n
        assert row.trimmed == pytest.approx(x[cut:n - cut].mean())
        assert row.mad == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))))
        assert row.skew == pytest.approx((z ** 3).mean() / x.std(ddof=1) ** 3)
        assert row.kurtosis == pytest.approx((z ** 4).mean() / x.std(ddof=1) ** 4 - 3)


def test_top_frequencies_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaacd"], "v string")
    assert [tuple(r) for r in profile.frequencies(df, "v", top=3).collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_last_zero_balance(spark):
    df = statements(spark, [(1, day(1), 1.0, 0.0, 1.0, 0), (1, day(2), 1.0, 0.0, 1.0, 0), (1, day(3), 1.0, 4.0, 1.0, 0),
                            (2, day(1), 1.0, 4.0, 1.0, 0), (2, day(2), 1.0, 0.0, 1.0, 0), (3, day(1), 1.0, 0.0, 1.0, 0)])
    rows = proposals.last_balance_zero(df).orderBy("ID_CPTE").collect()
    assert [(r.last_zero, r.last_two_zero) for r in rows] == [(0, 0), (1, 0), (1, 1)]
