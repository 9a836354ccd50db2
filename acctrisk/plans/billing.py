"""Statement-level columns and per-account billing features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.columns import flag, ratio
from acctrisk.functions.strict import Aggregates
from acctrisk.sources.schemas import KEY

FEATURES = (
    "mean_balance", "mean_cash_balance", "max_balance", "max_cash_balance", "max_num_cmp",
    "count_num_cmp", "credit_change", "TotalBalanceOL_perc_max", "TotalBalanceOL_perc_mean",
    "TotalBalanceOL_ind", "CB_ind", "CB_limit_perc_max", "CB_limit_perc_mean", "Spending_mean",
    "SpendingOL_perc_max", "SpendingOL_perc_mean", "SpendingOL_ind",
)


def derived(billing: DataFrame) -> DataFrame:
    """Utilisation, cash and spending ratios with their flags, and the delinquency flag."""
    balance, cash, limit = F.col("CurrentTotalBalance"), F.col("CashBalance"), F.col("CreditLimit")
    spending = balance - cash
    return billing.withColumns({
        "TotalBalanceOL_perc": ratio(balance, limit),
        "TotalBalanceOL_ind": flag(balance > limit),
        "CB_limit_perc": ratio(cash, limit),
        "CBOL_ind": flag(cash > limit),
        "CB_ind": flag(cash > 0),
        "Spending": spending,
        "SpendingOL_perc": ratio(spending, limit),
        "SpendingOL_ind": flag(spending > limit),
        "Num_CMP": F.col("DelqCycle"),
        "Delinquent": flag(F.col("DelqCycle") != 0),
    })


def features(billing: DataFrame, skip_missing: bool = False) -> DataFrame:
    """One row per account. Every aggregate has a small fixed-size partial state."""
    a = Aggregates(skip_missing)
    return derived(billing).groupBy(KEY).agg(
        a.mean("CurrentTotalBalance").alias("mean_balance"),
        a.mean("CashBalance").alias("mean_cash_balance"),
        a.max("CurrentTotalBalance").alias("max_balance"),
        a.max("CashBalance").alias("max_cash_balance"),
        a.max("Num_CMP").alias("max_num_cmp"),
        a.sum("Delinquent").alias("count_num_cmp"),
        (a.max("CreditLimit") != a.min("CreditLimit")).alias("credit_change"),
        a.max("TotalBalanceOL_perc").alias("TotalBalanceOL_perc_max"),
        a.mean("TotalBalanceOL_perc").alias("TotalBalanceOL_perc_mean"),
        a.max("TotalBalanceOL_ind").alias("TotalBalanceOL_ind"),
        a.max("CB_ind").alias("CB_ind"),
        a.max("CB_limit_perc").alias("CB_limit_perc_max"),
        a.mean("CB_limit_perc").alias("CB_limit_perc_mean"),
        a.mean("Spending").alias("Spending_mean"),
        a.max("SpendingOL_perc").alias("SpendingOL_perc_max"),
        a.mean("SpendingOL_perc").alias("SpendingOL_perc_mean"),
        a.max("SpendingOL_ind").alias("SpendingOL_ind"),
    )


def any_delinquency(billing: DataFrame) -> DataFrame:
    """The earlier, shorter feature set: balances and whether the account was ever late."""
    a = Aggregates()
    return billing.groupBy(KEY).agg(
        a.mean("CurrentTotalBalance").alias("mean_balance"),
        a.mean("CashBalance").alias("mean_cash_balance"),
        a.max("CurrentTotalBalance").alias("max_balance"),
        a.max("CashBalance").alias("max_cash_balance"),
        (a.sum("DelqCycle") >= 1).alias("delinquent"),
    )
