"""Derived columns, aggregates, joins and the account table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from acctrisk.catalog.registry import query
from acctrisk.functions import columns as C
from acctrisk.operators import coding, joins, nulls
from acctrisk.plans import billing as B, mart, payments as P, profile, transactions as X
from acctrisk.session import checkpointed
from acctrisk.sources import views
from acctrisk.sources.schemas import KEY, LABEL, PERIOD
from acctrisk.sources.tables import submission

# Ratios are summed in an order that depends on the engine; nine decimals are far above that noise.
RATIO_MEANS = ("TotalBalanceOL_perc_mean", "CB_limit_perc_mean", "SpendingOL_perc_mean", "mean_trx_pct")


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names if n in df.columns})


def _rounding(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


BILLING_MEANS = RATIO_MEANS[:3]
# With imputed amounts these are sums and midpoints of fractions.
PAID = ("mean_payment", "median_payment")
_PAID = ", ".join(f"round({n}, 4) AS {n}" for n in PAID)


def account_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.account_table(views.billing(spark, sf_dir), views.payments(spark, sf_dir),
                              views.transactions(spark, sf_dir), views.performance(spark, sf_dir))


def train_part(df: DataFrame) -> DataFrame:
    return df.where(views.is_train())


def test_part(df: DataFrame) -> DataFrame:
    return df.where(~views.is_train())


@query("default_by_overlimit", """
    SELECT TotalBalanceOL_ind, count(*) AS n_accounts, avg("Default") AS default_rate,
           round(avg(TotalBalanceOL_perc_mean), 9) AS mean_utilisation
    FROM billing_features b JOIN performance p ON b.ID_CPTE = p.ID_CPTE GROUP BY TotalBalanceOL_ind""")
def default_by_overlimit(spark, sf_dir):
    joined = B.features(views.billing(spark, sf_dir)).join(views.performance(spark, sf_dir), KEY)
    return joined.groupBy("TotalBalanceOL_ind").agg(
        F.count(F.lit(1)).alias("n_accounts"), F.avg(LABEL).alias("default_rate"),
        F.round(F.avg("TotalBalanceOL_perc_mean"), 9).alias("mean_utilisation"))


@query("billing_derived", "SELECT * FROM billing_derived")
def billing_derived(spark, sf_dir):
    return B.derived(views.billing(spark, sf_dir))


@query("billing_features", f"SELECT * REPLACE ({_rounding(*BILLING_MEANS)}) FROM billing_features")
def billing_features(spark, sf_dir):
    return rounded(B.features(views.billing(spark, sf_dir)), *BILLING_MEANS)


@query("delinquency_any", """
    SELECT ID_CPTE, avg(CurrentTotalBalance) AS mean_balance, avg(CashBalance) AS mean_cash_balance,
           max(CurrentTotalBalance) AS max_balance, max(CashBalance) AS max_cash_balance,
           sum(DelqCycle) >= 1 AS delinquent
    FROM billing GROUP BY ID_CPTE""")
def delinquency_any(spark, sf_dir):
    return B.any_delinquency(views.billing(spark, sf_dir))


@query("trx_derived", "SELECT * FROM trx_derived")
def trx_derived(spark, sf_dir):
    return X.derived(views.transactions(spark, sf_dir))


@query("trx_features", f"SELECT * REPLACE ({_rounding('mean_trx_pct')}) FROM trx_features")
def trx_features(spark, sf_dir):
    return rounded(X.features(views.transactions(spark, sf_dir)), "mean_trx_pct")


@query("trx_mode", "SELECT ID_CPTE, trx_type_mode, trx_cat_mode FROM trx_features")
def trx_mode(spark, sf_dir):
    return X.features(views.transactions(spark, sf_dir)).select(KEY, "trx_type_mode", "trx_cat_mode")


@query("trx_shares", "SELECT ID_CPTE, " + ", ".join(
    [f"trx_type_{v}_perc" for v in "ABCDEFG"] + [f"trx_cat_{v}_perc" for v in "ABCDE"]) + " FROM trx_features")
def trx_shares(spark, sf_dir):
    return X.features(views.transactions(spark, sf_dir)).select(KEY, *X.FEATURES[6:])


@query("payment_features", "SELECT * FROM payment_features")
def payment_features(spark, sf_dir):
    return P.features(views.payments(spark, sf_dir))


@query("null_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null, count({c}) AS n_present FROM payments"""
    for c in (KEY, "TRANSACTION_AMT", "TRANSACTION_DTTM", "PAYMENT_REVERSAL_XFLG")))
def null_profile(spark, sf_dir):
    return nulls.null_profile(views.payments(spark, sf_dir))


@query("impute_global_mean", """
    SELECT * REPLACE (coalesce(CAST(TRANSACTION_AMT AS DOUBLE), (SELECT avg(TRANSACTION_AMT) FROM payments))
                      AS TRANSACTION_AMT) FROM payments""")
def impute_global_mean(spark, sf_dir):
    return nulls.fill_with_mean(views.payments(spark, sf_dir), ["TRANSACTION_AMT"])


@query("impute_group_mean", """
    SELECT * REPLACE (coalesce(CAST(TRANSACTION_AMT AS DOUBLE), avg(TRANSACTION_AMT) OVER (PARTITION BY ID_CPTE))
                      AS TRANSACTION_AMT) FROM payments""")
def impute_group_mean(spark, sf_dir):
    return nulls.fill_with_group_mean(views.payments(spark, sf_dir), "TRANSACTION_AMT", KEY)


@query("zero_fill", """
    SELECT ID_CPTE, coalesce(TRANSACTION_AMT, 0) AS TRANSACTION_AMT, TRANSACTION_DTTM, PAYMENT_REVERSAL_XFLG
    FROM payments""")
def zero_fill(spark, sf_dir):
    return nulls.fill_with_zero(views.payments(spark, sf_dir))


@query("complete_cases", """
    SELECT ID_CPTE, TRANSACTION_AMT, PAYMENT_REVERSAL_XFLG FROM payments
    WHERE ID_CPTE IS NOT NULL AND TRANSACTION_AMT IS NOT NULL AND PAYMENT_REVERSAL_XFLG IS NOT NULL""")
def complete_cases(spark, sf_dir):
    return nulls.complete_cases(views.payments(spark, sf_dir), [KEY, "TRANSACTION_AMT", "PAYMENT_REVERSAL_XFLG"])


@query("label_recode", """
    SELECT ID_CPTE, CASE WHEN "Default" = 0 THEN 'No' WHEN "Default" IS NOT NULL THEN 'Yes' END AS label_text,
           "Default" AS label_number
    FROM performance""")
def label_recode(spark, sf_dir):
    text = views.performance(spark, sf_dir).select(KEY, C.label_to_text(LABEL).alias("label_text"))
    return text.withColumn("label_number", C.label_to_number("label_text"))


@query("categorical_code", """
    SELECT key, var_cat, CAST(dense_rank() OVER (ORDER BY var_cat) - 1 AS INTEGER) AS code FROM scored""")
def categorical_code(spark, sf_dir):
    return coding.categorical_code(views.scored(spark, sf_dir).select("key", "var_cat"), "var_cat")


@query("logical_cast", """
    SELECT ID_CPTE, CAST(credit_change AS INTEGER) AS credit_change, TotalBalanceOL_ind <> 0 AS TotalBalanceOL_ind,
           CB_ind <> 0 AS CB_ind, SpendingOL_ind <> 0 AS SpendingOL_ind
    FROM billing_features""")
def logical_cast(spark, sf_dir):
    df = C.keep(B.features(views.billing(spark, sf_dir)),
                [KEY, "credit_change", "TotalBalanceOL_ind", "CB_ind", "SpendingOL_ind"])
    df = C.cast_columns(df, ["TotalBalanceOL_ind", "CB_ind", "SpendingOL_ind"], "boolean")
    return C.cast_columns(df, ["credit_change"], "int")


@query("column_complement", 'SELECT ID_CPTE, "Default" FROM performance')
def column_complement(spark, sf_dir):
    return C.leave_out(views.performance(spark, sf_dir), [PERIOD])


@query("score_threshold", """
    SELECT key, CAST(mod1 >= CAST(0.257 AS DOUBLE) AS INTEGER) AS vote_1,
           CAST(mod2 > CAST(0.4 AS DOUBLE) AS INTEGER) AS vote_2 FROM scored""")
def score_threshold(spark, sf_dir):
    return views.scored(spark, sf_dir).select(
        "key", C.at_threshold("mod1").alias("vote_1"), C.at_threshold("mod2", 0.4, strict=True).alias("vote_2"))


@query("score_ratio", "SELECT key, mod2 / nullif(mod1, 0) AS sort_ratio FROM scored")
def score_ratio(spark, sf_dir):
    return views.scored(spark, sf_dir).select("key", C.ratio("mod2", "mod1").alias("sort_ratio"))


@query("period_year", """
    SELECT substr(CAST(PERIODID_MY AS VARCHAR), 1, 4) AS year, count(*) AS n_statements FROM billing GROUP BY 1""")
def period_year(spark, sf_dir):
    year = C.period_year(PERIOD).alias("year")
    return views.billing(spark, sf_dir).groupBy(year).agg(F.count(F.lit(1)).alias("n_statements"))


@query("default_rate_by_period",
       'SELECT PERIODID_MY, avg("Default") AS default_rate FROM performance GROUP BY PERIODID_MY')
def default_rate_by_period(spark, sf_dir):
    return profile.rate_by(views.performance(spark, sf_dir), PERIOD, LABEL, "default_rate")


@query("describe_by_group", """
    WITH x AS (SELECT "Default" AS g, CAST(max_balance AS DOUBLE) AS v FROM mart),
    m AS (SELECT g, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, median(v) AS med, min(v) AS lo, max(v) AS hi
          FROM x GROUP BY g),
    c AS (SELECT x.g, sum(power((v - mean) / 1e6, 2)) AS s2, sum(power((v - mean) / 1e6, 3)) AS s3,
                 sum(power((v - mean) / 1e6, 4)) AS s4, median(abs(v - med)) AS mad
          FROM x JOIN m ON x.g = m.g GROUP BY x.g),
    r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM x),
    t AS (SELECT r.g, avg(v) AS trimmed FROM r JOIN m ON r.g = m.g
          WHERE i > floor(n * CAST(0.1 AS DOUBLE)) AND i <= n - floor(n * CAST(0.1 AS DOUBLE)) GROUP BY r.g)
    SELECT m.g AS "Default", n, mean, round(sd, 3) AS sd, med AS median, round(trimmed, 3) AS trimmed,
           round(mad * CAST(1.4826 AS DOUBLE), 3) AS mad, lo AS min, hi AS max, hi - lo AS range,
           round(sqrt(n) * s3 / power(s2, 1.5) * power((n - 1.0) / n, 1.5), 6) AS skew,
           round(n * s4 / (s2 * s2) * power((n - 1.0) / n, 2) - 3, 6) AS kurtosis,
           round(sd / sqrt(n), 3) AS se
    FROM m JOIN c ON m.g = c.g JOIN t ON m.g = t.g""")
def describe_by_group(spark, sf_dir):
    balances = checkpointed(account_table(spark, sf_dir).select(LABEL, "max_balance"))
    df = profile.describe_by(balances, LABEL, "max_balance")
    return rounded(rounded(df, "sd", "trimmed", "mad", "se", digits=3), "skew", "kurtosis", digits=6)


@query("freq_table", "SELECT MERCHANT_CATEGORY_XCD, count(*) AS n FROM transactions GROUP BY 1")
def freq_table(spark, sf_dir):
    return profile.frequencies(views.transactions(spark, sf_dir), "MERCHANT_CATEGORY_XCD")


@query("freq_top_cities",
       "SELECT MERCHANT_CITY_NAME, count(*) AS n FROM transactions GROUP BY 1")
def freq_top_cities(spark, sf_dir):
    return profile.frequencies(views.transactions(spark, sf_dir), "MERCHANT_CITY_NAME")


SUMMARY = ("CurrentTotalBalance", "CashBalance", "CreditLimit", "DelqCycle")


@query("column_summary", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min,
           quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
           avg({c}) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max,
           count(*) - count({c}) AS n_null FROM billing""" for c in SUMMARY))
def column_summary(spark, sf_dir):
    return profile.column_summary(views.billing(spark, sf_dir), SUMMARY)


@query("level_counts", """
    SELECT 'TRANSACTION_TYPE_XCD' AS "column", TRANSACTION_TYPE_XCD AS level, count(*) AS n
    FROM transactions GROUP BY 2
    UNION ALL
    SELECT 'TRANSACTION_CATEGORY_XCD', TRANSACTION_CATEGORY_XCD, count(*) FROM transactions GROUP BY 2""")
def level_counts(spark, sf_dir):
    return profile.level_counts(views.transactions(spark, sf_dir), [X.TYPE, X.CATEGORY])


@query("mean_trx_by_account", "SELECT ID_CPTE, avg(TRANSACTION_AMT) AS mean_amt FROM transactions GROUP BY ID_CPTE")
def mean_trx_by_account(spark, sf_dir):
    return X.mean_amount(views.transactions(spark, sf_dir))


@query("row_count_by_account", "SELECT ID_CPTE, count(*) AS n_rows FROM payments GROUP BY ID_CPTE")
def row_count_by_account(spark, sf_dir):
    return profile.row_counts(views.payments(spark, sf_dir), KEY)


@query("pair_count", """
    SELECT TRANSACTION_CATEGORY_XCD, TRANSACTION_TYPE_XCD, "Default", mean_amt, count(*) AS pair_count
    FROM transactions t
    LEFT JOIN (SELECT ID_CPTE, avg(TRANSACTION_AMT) AS mean_amt FROM transactions GROUP BY ID_CPTE) a
         ON t.ID_CPTE = a.ID_CPTE
    LEFT JOIN performance p ON t.ID_CPTE = p.ID_CPTE
    WHERE TRANSACTION_CATEGORY_XCD IS NOT NULL AND TRANSACTION_TYPE_XCD IS NOT NULL AND "Default" IS NOT NULL
          AND mean_amt IS NOT NULL
    GROUP BY 1, 2, 3, 4""")
def pair_count(spark, sf_dir):
    return X.pair_counts(views.transactions(spark, sf_dir), views.performance(spark, sf_dir))


@query("distinct_accounts", "SELECT DISTINCT ID_CPTE FROM payments")
def distinct_accounts(spark, sf_dir):
    return profile.distinct_keys(views.payments(spark, sf_dir), KEY)


@query("distinct_count", "SELECT count(DISTINCT ID_CPTE) AS n_distinct FROM payments")
def distinct_count(spark, sf_dir):
    return profile.distinct_count(views.payments(spark, sf_dir), KEY)


@query("contingency", """
    SELECT obs, count(*) FILTER (WHERE mod1 < CAST(0.5 AS DOUBLE)) AS predicted_0,
           count(*) FILTER (WHERE mod1 >= CAST(0.5 AS DOUBLE)) AS predicted_1 FROM scored GROUP BY obs""")
def contingency(spark, sf_dir):
    df = views.scored(spark, sf_dir).withColumn("predicted", C.at_threshold("mod1", 0.5))
    return profile.contingency(df, "obs", "predicted")


CORRELATED = ("mean_balance", "max_balance", "mean_payment", "number_payments", "count_num_cmp")


@query("corr_matrix", " UNION ALL ".join(
    f"""SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr({a}, {b}), 6) AS correlation FROM mart"""
    for i, a in enumerate(sorted(CORRELATED)) for b in sorted(CORRELATED)[:i]))
def corr_matrix(spark, sf_dir):
    return rounded(profile.correlations(account_table(spark, sf_dir), CORRELATED), "correlation", digits=6)


@query("mart_train", f"SELECT * REPLACE ({_rounding(*RATIO_MEANS)}, {_PAID}) FROM mart WHERE ID_CPTE % 10 < 7")
def mart_train(spark, sf_dir):
    return rounded(rounded(train_part(account_table(spark, sf_dir)), *RATIO_MEANS), *PAID, digits=4)


@query("mart_test", f"SELECT * REPLACE ({_rounding(*RATIO_MEANS)}, {_PAID}) FROM mart WHERE ID_CPTE % 10 >= 7")
def mart_test(spark, sf_dir):
    return rounded(rounded(test_part(account_table(spark, sf_dir)), *RATIO_MEANS), *PAID, digits=4)


@query("mart_filled", f"""
    SELECT * REPLACE ({_rounding(*RATIO_MEANS)}, {_PAID}, round(mean_trx_amt, 4) AS mean_trx_amt) FROM mart_filled""")
def mart_filled(spark, sf_dir):
    # The population is every account with purchases, also those that the inner joins leave out.
    # Its features are stored, because the fill and the join both read them.
    population = checkpointed(X.features(views.transactions(spark, sf_dir)))
    account = mart.account_table(views.billing(spark, sf_dir), views.payments(spark, sf_dir), population,
                                 views.performance(spark, sf_dir), aggregated=True)
    filled = mart.fill_transactions(account, population)
    return rounded(rounded(filled, *RATIO_MEANS), *PAID, "mean_trx_amt", digits=4)


@query("semi_split", """
    SELECT b.* FROM billing b WHERE ID_CPTE IN (SELECT ID_CPTE FROM performance WHERE ID_CPTE % 10 < 7)""")
def semi_split(spark, sf_dir):
    return joins.members(views.billing(spark, sf_dir), train_part(views.performance(spark, sf_dir)))


@query("anti_split", """
    SELECT b.* FROM billing b WHERE ID_CPTE NOT IN (SELECT ID_CPTE FROM performance WHERE ID_CPTE % 10 < 7)""")
def anti_split(spark, sf_dir):
    return joins.others(views.billing(spark, sf_dir), train_part(views.performance(spark, sf_dir)))


@query("detail_left_join", """
    SELECT t.ID_CPTE, TRANSACTION_AMT, TRANSACTION_TYPE_XCD, number_payments, noPayments
    FROM transactions t LEFT JOIN payment_features p ON t.ID_CPTE = p.ID_CPTE""")
def detail_left_join(spark, sf_dir):
    detail = views.transactions(spark, sf_dir).select(KEY, "TRANSACTION_AMT", "TRANSACTION_TYPE_XCD")
    account = P.features(views.payments(spark, sf_dir)).select(KEY, "number_payments", "noPayments")
    return joins.detail_with_account(detail, account)


@query("lookup_score", """
    SELECT p.ID_CPTE, p."Default", s.mean_balance FROM performance p
    LEFT JOIN (SELECT ID_CPTE, avg(CurrentTotalBalance) AS mean_balance FROM billing GROUP BY ID_CPTE) s
         ON p.ID_CPTE = s.ID_CPTE""")
def lookup_score(spark, sf_dir):
    scores = B.any_delinquency(views.billing(spark, sf_dir)).select(KEY, "mean_balance")
    return joins.lookup(views.performance(spark, sf_dir).select(KEY, LABEL), scores)


@query("union_four", """
    SELECT ID_CPTE, TRANSACTION_AMT, 'train' AS part FROM transactions WHERE ID_CPTE % 10 < 7
    UNION ALL SELECT ID_CPTE, TRANSACTION_AMT, 'test' FROM transactions WHERE ID_CPTE % 10 >= 7
    UNION ALL SELECT ID_CPTE, TRANSACTION_AMT, 'train_more' FROM statement_payments WHERE ID_CPTE % 10 < 7
    UNION ALL SELECT ID_CPTE, TRANSACTION_AMT, 'test_more' FROM statement_payments WHERE ID_CPTE % 10 >= 7""")
def union_four(spark, sf_dir):
    first = views.transactions(spark, sf_dir).select(KEY, "TRANSACTION_AMT")
    second = views.statement_payments(spark, sf_dir).select(KEY, "TRANSACTION_AMT")
    return joins.union_all(
        train_part(first).withColumn("part", F.lit("train")),
        test_part(first).withColumn("part", F.lit("test")),
        train_part(second).withColumn("part", F.lit("train_more")),
        test_part(second).withColumn("part", F.lit("test_more")))


@query("submission", """
    SELECT ID_CPTE, max(CAST(CurrentTotalBalance AS DOUBLE) / nullif(CreditLimit, 0)) AS "Default"
    FROM billing WHERE ID_CPTE % 10 >= 7 GROUP BY ID_CPTE""")
def submission_rows(spark, sf_dir):
    scored = test_part(B.features(views.billing(spark, sf_dir)))
    return submission(scored, score="TotalBalanceOL_perc_max")
