"""Further account features: trends, payback, repeated amounts, recency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.functions.columns import TRANSACTION_TYPES, flag, guarded_ratio, ratio
from acctrisk.operators.joins import closing_statements
from acctrisk.operators.running import running_totals
from acctrisk.operators.sequence import (
    change, change_sign, history, last_rows, latest, with_previous_period)
from acctrisk.sources.schemas import KEY, LABEL, PERIOD

PAYBACK_FLOOR = 0.03
NEAR_LIMIT = 0.9


def trend_scores(billing: DataFrame) -> DataFrame:
    """Sum of the signs of change of the balances over the last twelve steps: -12 to 12."""
    steps = billing.select(
        KEY, change_sign("CurrentTotalBalance").alias("balance_step"),
        change_sign("CashBalance").alias("cash_step"),
        F.row_number().over(history().orderBy(F.desc(PERIOD))).alias("back"))
    return steps.where(F.col("back") <= 12).groupBy(KEY).agg(
        F.coalesce(F.sum("balance_step"), F.lit(0)).alias("balance_trend"),
        F.coalesce(F.sum("cash_step"), F.lit(0)).alias("cash_trend"))


def limit_increases(billing: DataFrame) -> DataFrame:
    steps = billing.select(KEY, change_sign("CreditLimit").alias("step"))
    return steps.groupBy(KEY).agg(
        F.count_if(F.col("step") > 0).alias("limit_increases"),
        F.count_if(F.col("step") < 0).alias("limit_decreases"))


def paid_by_statement(billing: DataFrame, payments: DataFrame) -> DataFrame:
    """Statements that have a previous one, with the sum of the payments made since then.

    Payments are first totalled per account and day, which is as fine as a statement date.
    """
    statements = with_previous_period(billing).select(KEY, PERIOD, "lag_period", "CurrentTotalBalance")
    days = payments.groupBy(KEY, F.to_date("TRANSACTION_DTTM").alias("day")).agg(
        F.sum("TRANSACTION_AMT").alias("paid"))
    paid = closing_statements(statements, days).groupBy(KEY, F.col(f"closing.{PERIOD}").alias(PERIOD)).agg(
        F.sum("paid").alias("paid"))
    return (statements.where(F.col("lag_period").isNotNull()).join(paid, [KEY, PERIOD], "left")
            .withColumn("paid", F.coalesce("paid", F.lit(0))))


def payback(billing: DataFrame, payments: DataFrame) -> DataFrame:
    """Mean share of the statement paid, and the number of months under three percent."""
    share = ratio("paid", "CurrentTotalBalance")
    return paid_by_statement(billing, payments).groupBy(KEY).agg(
        F.avg(share).alias("mean_payback"),
        F.count_if(share < PAYBACK_FLOOR).alias("months_under_floor"),
        F.count(F.lit(1)).alias("n_statements"))


def remaining_balance(billing: DataFrame, payments: DataFrame) -> DataFrame:
    """Per statement: what was paid, what is left of it, and the account's running remainder."""
    rest = F.col("CurrentTotalBalance") - F.col("paid")
    upto = history().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paid_by_statement(billing, payments).select(
        KEY, PERIOD, "CurrentTotalBalance", "paid", rest.alias("remaining"),
        F.sum(rest).over(upto).alias("remaining_running"))


def _month_number(day: str):
    return F.year(day) * 12 + F.month(day)


def monthly_activity(transactions: DataFrame) -> DataFrame:
    """Purchases per active month and the slope of the monthly mean amount."""
    monthly = transactions.groupBy(KEY, _month_number("TRANSACTION_DTTM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("TRANSACTION_AMT").alias("amount"))
    return monthly.groupBy(KEY).agg(
        F.avg("n").alias("trx_per_month"), F.regr_slope("amount", "month").alias("amount_slope"))


def repeated_amounts(transactions: DataFrame) -> DataFrame:
    """How many amounts an account paid more than once, and in how many purchases."""
    same = transactions.groupBy(KEY, "TRANSACTION_AMT").agg(F.count(F.lit(1)).alias("n"))
    return same.where(F.col("n") >= 2).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("repeated_amounts"), F.sum("n").alias("repeated_rows"))


def category_severity(transactions: DataFrame, column: str = "MERCHANT_CATEGORY_XCD") -> DataFrame:
    return transactions.groupBy(KEY, column).agg(
        F.count(F.lit(1)).alias("frequency"), F.avg("TRANSACTION_AMT").alias("severity"))


def change_comparison(billing: DataFrame) -> DataFrame:
    """Change of balance and of limit, beside the account's average change of balance so far."""
    steps = billing.select(KEY, PERIOD, change("CurrentTotalBalance").alias("balance_change"),
                           change("CreditLimit").alias("limit_change"))
    return steps.withColumn("mean_balance_change", F.avg("balance_change").over(Window.partitionBy(KEY)))


def months_near_limit(billing: DataFrame, share: float = NEAR_LIMIT) -> DataFrame:
    return billing.groupBy(KEY).agg(
        F.count_if(ratio("CurrentTotalBalance", "CreditLimit") > share).alias("months_near_limit"))


def recency_weighted(billing: DataFrame) -> DataFrame:
    """Mean balance with weight ``1 / (1 + months before the account's last statement)``."""
    last = F.max(_month_number(PERIOD)).over(Window.partitionBy(KEY))
    weighted = billing.withColumn("w", ratio(F.lit(1), last - _month_number(PERIOD) + 1))
    return weighted.groupBy(KEY).agg(
        ratio(F.sum(F.col("w") * F.col("CurrentTotalBalance")), F.sum("w")).alias("recent_balance"))


def rolling_trends(billing: DataFrame, spans: Sequence[int] = (12, 6, 3)) -> DataFrame:
    """Slope of the balance over the last statements, as of each account's latest one.

    The slope per month is a share of the mean balance of those statements, so that accounts of
    different size compare.
    """
    balance, month = F.col("CurrentTotalBalance"), _month_number(PERIOD)
    rows = billing.select(KEY, PERIOD, *[
        ratio(F.regr_slope(balance, month).over(last_rows(k)), F.avg(balance).over(last_rows(k))).alias(f"trend_{k}")
        for k in spans])
    return rows.groupBy(KEY).agg(*latest({f"trend_{k}": F.col(f"trend_{k}") for k in spans}))


def last_balance(billing: DataFrame) -> DataFrame:
    return billing.groupBy(KEY).agg(
        *latest({"last_balance": F.col("CurrentTotalBalance")}), F.max(PERIOD).alias("last_period"))


def last_balance_zero(billing: DataFrame, column: str = "CashBalance") -> DataFrame:
    """Whether the latest and the two latest statements show a zero balance."""
    two = F.max(F.abs(F.col(column))).over(last_rows(2))
    return billing.select(KEY, PERIOD, F.col(column).alias("b"), two.alias("t")).groupBy(KEY).agg(
        *latest({"last_zero": flag(F.col("b") == 0), "last_two_zero": flag(F.col("t") == 0)}))


def mean_payments_given_any(payments: DataFrame) -> DataFrame:
    """Average number of payments over the accounts that made at least one."""
    counts = payments.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.avg("n").alias("mean_payments"), F.count(F.lit(1)).alias("n_accounts"))


def preauthorisations(transactions: DataFrame, code: str = "A") -> DataFrame:
    used = guarded_ratio("TRANSACTION_AMT", "PRIOR_CREDIT_LIMIT_AMT")
    return transactions.groupBy(KEY).agg(
        F.count_if(F.col("TRANSACTION_TYPE_XCD") == code).alias("preauthorisations"),
        F.avg(used).alias("mean_limit_used"), F.max(used).alias("max_limit_used"))


def code_shares(transactions: DataFrame, column: str = "TRANSACTION_TYPE_XCD",
                codes: Sequence[str] = TRANSACTION_TYPES) -> DataFrame:
    """Share of an account's purchases per code; the shares add up to one if all are listed."""
    return transactions.groupBy(KEY).agg(*[
        ratio(F.count_if(F.col(column) == c), F.count(F.lit(1))).alias(f"share_{c}") for c in codes])


def low_limit_delinquent(billing: DataFrame, limit: int) -> DataFrame:
    """Accounts whose lowest limit is small and that were late at least once."""
    return billing.groupBy(KEY).agg(
        flag((F.min("CreditLimit") < limit) & (F.max("DelqCycle") > 0)).alias("low_limit_delinquent"))


def top_scored_profile(scored: DataFrame, score: str, key: str, columns: Sequence[str], top: int) -> DataFrame:
    """Means of the ``top`` highest scored rows beside those of all other rows.

    Ranks come from running totals, so neither part is gathered in one task.
    """
    ranked = running_totals(scored.withColumn("__score", -F.col(score)), "__score",
                            {"rank": F.lit(1)}, tie=key)
    group = F.when(F.col("rank") <= top, "top").otherwise("rest")
    return ranked.groupBy(group.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def default_rate_by_flag(account: DataFrame, column: str) -> DataFrame:
    return account.groupBy(column).agg(
        F.avg(LABEL).alias("default_rate"), F.count(F.lit(1)).alias("n_accounts"))
