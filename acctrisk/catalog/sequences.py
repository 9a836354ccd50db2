"""Statement sequences, the statement-to-payment join and the further account features."""

from __future__ import annotations

from pyspark.sql import functions as F

from acctrisk.catalog.features import account_table, rounded
from acctrisk.catalog.registry import query
from acctrisk.operators.joins import statement_payments_join
from acctrisk.operators.sequence import change_sign, with_previous_period
from acctrisk.plans import proposals as G, profile, transactions as X
from acctrisk.sources import views
from acctrisk.sources.schemas import KEY, LABEL, PERIOD


@query("period_lag", "SELECT ID_CPTE, PERIODID_MY, lag_period FROM lagged")
def period_lag(spark, sf_dir):
    return with_previous_period(views.billing(spark, sf_dir)).select(KEY, PERIOD, "lag_period")


@query("statements_with_previous", "SELECT * FROM lagged WHERE lag_period IS NOT NULL")
def statements_with_previous(spark, sf_dir):
    return with_previous_period(views.billing(spark, sf_dir)).where(F.col("lag_period").isNotNull())


@query("change_sign", """
    SELECT ID_CPTE, PERIODID_MY, CAST(sign(CurrentTotalBalance - lag(CurrentTotalBalance) OVER w) AS INTEGER) AS step
    FROM billing WINDOW w AS (PARTITION BY ID_CPTE ORDER BY PERIODID_MY)""")
def change_signs(spark, sf_dir):
    return views.billing(spark, sf_dir).select(KEY, PERIOD, change_sign("CurrentTotalBalance").alias("step"))


INTERVAL = """
    SELECT s.ID_CPTE, s.PERIODID_MY, s.lag_period, s.CurrentTotalBalance, p.TRANSACTION_AMT, p.TRANSACTION_DTTM
    FROM lagged s {how} JOIN statement_payments p
         ON s.ID_CPTE = p.ID_CPTE AND p.TRANSACTION_DTTM >= s.lag_period AND p.TRANSACTION_DTTM < s.PERIODID_MY"""


def _interval(spark, sf_dir, how):
    statements = with_previous_period(views.billing(spark, sf_dir)).select(
        KEY, PERIOD, "lag_period", "CurrentTotalBalance")
    return statement_payments_join(statements, views.statement_payments(spark, sf_dir), how)


@query("statement_payment_interval", INTERVAL.format(how="LEFT"))
def statement_payment_interval(spark, sf_dir):
    return _interval(spark, sf_dir, "left")


@query("statement_payment_interval_inner", INTERVAL.format(how=""))
def statement_payment_interval_inner(spark, sf_dir):
    return _interval(spark, sf_dir, "inner")


@query("trend_score", """
    SELECT ID_CPTE, CAST(coalesce(sum(b), 0) AS BIGINT) AS balance_trend,
           CAST(coalesce(sum(c), 0) AS BIGINT) AS cash_trend
    FROM (SELECT ID_CPTE, sign(CurrentTotalBalance - lag(CurrentTotalBalance) OVER w) AS b,
                 sign(CashBalance - lag(CashBalance) OVER w) AS c,
                 row_number() OVER (PARTITION BY ID_CPTE ORDER BY PERIODID_MY DESC) AS back
          FROM billing WINDOW w AS (PARTITION BY ID_CPTE ORDER BY PERIODID_MY))
    WHERE back <= 12 GROUP BY ID_CPTE""")
def trend_score(spark, sf_dir):
    return G.trend_scores(views.billing(spark, sf_dir))


@query("limit_increases", """
    SELECT ID_CPTE, count(*) FILTER (WHERE d > 0) AS limit_increases, count(*) FILTER (WHERE d < 0) AS limit_decreases
    FROM (SELECT ID_CPTE, CreditLimit - lag(CreditLimit) OVER (PARTITION BY ID_CPTE ORDER BY PERIODID_MY) AS d
          FROM billing) GROUP BY ID_CPTE""")
def limit_increases(spark, sf_dir):
    return G.limit_increases(views.billing(spark, sf_dir))


@query("payback_share", """
    SELECT ID_CPTE, round(avg(CAST(paid AS DOUBLE) / nullif(CurrentTotalBalance, 0)), 9) AS mean_payback,
           count(*) FILTER (WHERE CAST(paid AS DOUBLE) / nullif(CurrentTotalBalance, 0) < CAST(0.03 AS DOUBLE))
               AS months_under_floor,
           count(*) AS n_statements
    FROM paid_by_statement GROUP BY ID_CPTE""")
def payback_share(spark, sf_dir):
    df = G.payback(views.billing(spark, sf_dir), views.statement_payments(spark, sf_dir))
    return rounded(df, "mean_payback")


@query("remaining_balance", """
    SELECT ID_CPTE, PERIODID_MY, CurrentTotalBalance, paid, CurrentTotalBalance - paid AS remaining,
           CAST(sum(CurrentTotalBalance - paid) OVER (PARTITION BY ID_CPTE ORDER BY PERIODID_MY) AS BIGINT)
               AS remaining_running
    FROM paid_by_statement""")
def remaining_balance(spark, sf_dir):
    return G.remaining_balance(views.billing(spark, sf_dir), views.statement_payments(spark, sf_dir))


@query("monthly_activity", """
    SELECT ID_CPTE, avg(n) AS trx_per_month, CASE WHEN count(*) > 1 THEN round(regr_slope(amount, month), 4) END AS amount_slope
    FROM (SELECT ID_CPTE, year(TRANSACTION_DTTM) * 12 + month(TRANSACTION_DTTM) AS month, count(*) AS n,
                 avg(TRANSACTION_AMT) AS amount FROM transactions GROUP BY 1, 2)
    GROUP BY ID_CPTE""")
def monthly_activity(spark, sf_dir):
    return rounded(G.monthly_activity(views.transactions(spark, sf_dir)), "amount_slope", digits=4)


@query("repeat_amounts", """
    SELECT ID_CPTE, count(*) AS repeated_amounts, CAST(sum(n) AS BIGINT) AS repeated_rows
    FROM (SELECT ID_CPTE, TRANSACTION_AMT, count(*) AS n FROM payments WHERE TRANSACTION_AMT IS NOT NULL
          GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY ID_CPTE""")
def repeat_amounts(spark, sf_dir):
    return G.repeated_amounts(views.payments(spark, sf_dir).dropna(subset=["TRANSACTION_AMT"]))


@query("category_severity", """
    SELECT ID_CPTE, MERCHANT_CATEGORY_XCD, count(*) AS frequency, avg(TRANSACTION_AMT) AS severity
    FROM transactions GROUP BY 1, 2""")
def category_severity(spark, sf_dir):
    return G.category_severity(views.transactions(spark, sf_dir))


@query("change_compare", """
    SELECT ID_CPTE, PERIODID_MY, b AS balance_change, l AS limit_change,
           avg(b) OVER (PARTITION BY ID_CPTE) AS mean_balance_change
    FROM (SELECT ID_CPTE, PERIODID_MY, CurrentTotalBalance - lag(CurrentTotalBalance) OVER w AS b,
                 CreditLimit - lag(CreditLimit) OVER w AS l
          FROM billing WINDOW w AS (PARTITION BY ID_CPTE ORDER BY PERIODID_MY))""")
def change_compare(spark, sf_dir):
    return G.change_comparison(views.billing(spark, sf_dir))


@query("months_over_90pct", """
    SELECT ID_CPTE, count(*) FILTER (WHERE CAST(CurrentTotalBalance AS DOUBLE) / nullif(CreditLimit, 0)
                                           > CAST(0.9 AS DOUBLE)) AS months_near_limit
    FROM billing GROUP BY ID_CPTE""")
def months_over_90pct(spark, sf_dir):
    return G.months_near_limit(views.billing(spark, sf_dir))


@query("recency_weighted", """
    SELECT ID_CPTE, round(sum(w * CurrentTotalBalance) / sum(w), 3) AS recent_balance
    FROM (SELECT ID_CPTE, CurrentTotalBalance, CAST(1 AS DOUBLE) / (max(m) OVER (PARTITION BY ID_CPTE) - m + 1) AS w
          FROM (SELECT *, year(PERIODID_MY) * 12 + month(PERIODID_MY) AS m FROM billing))
    GROUP BY ID_CPTE""")
def recency_weighted(spark, sf_dir):
    return rounded(G.recency_weighted(views.billing(spark, sf_dir)), "recent_balance", digits=3)


TREND = """
           CASE WHEN count(*) > 1 THEN round(regr_slope(CurrentTotalBalance, m) FILTER (WHERE back <= {k})
               / avg(CurrentTotalBalance) FILTER (WHERE back <= {k}), 9) END AS trend_{k}"""


@query("rolling_trends", f"""
    SELECT ID_CPTE, {", ".join(TREND.format(k=k) for k in (12, 6, 3))}
    FROM (SELECT ID_CPTE, CurrentTotalBalance, year(PERIODID_MY) * 12 + month(PERIODID_MY) AS m,
                 row_number() OVER (PARTITION BY ID_CPTE ORDER BY PERIODID_MY DESC) AS back FROM billing)
    GROUP BY ID_CPTE""")
def rolling_trends(spark, sf_dir):
    return rounded(G.rolling_trends(views.billing(spark, sf_dir)), "trend_12", "trend_6", "trend_3")


@query("last_zero_balance", """
    SELECT ID_CPTE, CAST(max(CashBalance) FILTER (WHERE back = 1) = 0 AS INTEGER) AS last_zero,
           CAST(max(CashBalance) FILTER (WHERE back <= 2) = 0 AS INTEGER) AS last_two_zero
    FROM (SELECT *, row_number() OVER (PARTITION BY ID_CPTE ORDER BY PERIODID_MY DESC) AS back FROM billing)
    GROUP BY ID_CPTE""")
def last_zero_balance(spark, sf_dir):
    return G.last_balance_zero(views.billing(spark, sf_dir))


@query("latest_balance", """
    SELECT ID_CPTE, arg_max(CurrentTotalBalance, PERIODID_MY) AS last_balance, max(PERIODID_MY) AS last_period
    FROM billing GROUP BY ID_CPTE""")
def latest_balance(spark, sf_dir):
    return G.last_balance(views.billing(spark, sf_dir))


@query("mean_payments_given_any", """
    SELECT avg(n) AS mean_payments, count(*) AS n_accounts
    FROM (SELECT count(*) AS n FROM payments GROUP BY ID_CPTE)""")
def mean_payments_given_any(spark, sf_dir):
    return G.mean_payments_given_any(views.payments(spark, sf_dir))


@query("preauth_activity", """
    SELECT ID_CPTE, count(*) FILTER (WHERE TRANSACTION_TYPE_XCD = 'A') AS preauthorisations,
           round(avg(trxpctused), 9) AS mean_limit_used, max(trxpctused) AS max_limit_used
    FROM trx_derived GROUP BY ID_CPTE""")
def preauth_activity(spark, sf_dir):
    return rounded(G.preauthorisations(views.transactions(spark, sf_dir)), "mean_limit_used")


@query("trx_code_shares", "SELECT ID_CPTE, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE TRANSACTION_TYPE_XCD = '{v}') AS DOUBLE) / count(*) AS share_{v}"
    for v in "ABCDEFG") + " FROM transactions GROUP BY ID_CPTE")
def trx_code_shares(spark, sf_dir):
    return G.code_shares(views.transactions(spark, sf_dir))


@query("reversal_flag_profile", """
    SELECT PAYMENT_REVERSAL_XFLG, count(*) AS n_payments, count(DISTINCT p.ID_CPTE) AS n_accounts,
           avg("Default") AS default_rate
    FROM payments p JOIN performance f ON p.ID_CPTE = f.ID_CPTE GROUP BY PAYMENT_REVERSAL_XFLG""")
def reversal_flag_profile(spark, sf_dir):
    return profile.flag_profile(views.payments(spark, sf_dir), views.performance(spark, sf_dir), KEY, LABEL)


@query("default_by_reversal", """
    SELECT reversedPayment, avg("Default") AS default_rate, count(*) AS n_accounts FROM mart GROUP BY reversedPayment""")
def default_by_reversal(spark, sf_dir):
    return G.default_rate_by_flag(account_table(spark, sf_dir), "reversedPayment")


@query("low_limit_delinquent", """
    SELECT ID_CPTE, CAST(min(CreditLimit) < 11000000 AND max(DelqCycle) > 0 AS INTEGER) AS low_limit_delinquent
    FROM billing GROUP BY ID_CPTE""")
def low_limit_delinquent(spark, sf_dir):
    return G.low_limit_delinquent(views.billing(spark, sf_dir), 11_000_000)


@query("top_scored_profile", """
    SELECT CASE WHEN r <= 100 THEN 'top' ELSE 'rest' END AS segment, count(*) AS n, avg(obs) AS mean_obs,
           avg(mod2) AS mean_mod2, avg(var) AS mean_var
    FROM (SELECT *, row_number() OVER (ORDER BY mod1 DESC, key) AS r FROM scored) GROUP BY 1""")
def top_scored_profile(spark, sf_dir):
    return G.top_scored_profile(views.scored(spark, sf_dir), "mod1", "key", ["obs", "mod2", "var"], 100)
