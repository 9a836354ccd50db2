"""The wide account table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.columns import cast_columns
from acctrisk.operators.nulls import fill_with_mean
from acctrisk.plans import billing, payments, transactions
from acctrisk.sources.schemas import KEY, LABEL

LOGICAL = ("credit_change", "reversedPayment", "noPayments")
TRANSACTION_FILLS = ("mean_trx_amt", "mean_trx_pct", "number_transactions")

# Predictor lists. The column sets the models are defined on.
FULL24 = (
    "mean_payment", "number_payments", "max_payment", "min_payment", "median_payment",
    "reversedPayment", "noPayments", "mean_balance", "mean_cash_balance", "max_balance",
    "max_cash_balance", "max_num_cmp", "count_num_cmp", "credit_change", "TotalBalanceOL_perc_max",
    "TotalBalanceOL_perc_mean", "TotalBalanceOL_ind", "CB_ind", "CB_limit_perc_max",
    "CB_limit_perc_mean", "Spending_mean", "SpendingOL_perc_max", "SpendingOL_perc_mean",
    "SpendingOL_ind",
)
FULL27 = (*FULL24, *TRANSACTION_FILLS)
BILLING13 = FULL24[11:]
PAYMENTS11 = FULL24[:11]
NET16 = (
    "mean_payment", "number_payments", "reversedPayment", "noPayments", "mean_balance",
    "mean_cash_balance", "max_num_cmp", "count_num_cmp", "credit_change", "TotalBalanceOL_ind",
    "TotalBalanceOL_perc_max", "CB_ind", "CB_limit_perc_mean", "Spending_mean",
    "SpendingOL_perc_max", "SpendingOL_ind",
)
BAYES14 = (
    "mean_payment", "number_payments", "reversedPayment", "noPayments", "mean_balance",
    "mean_cash_balance", "count_num_cmp", "credit_change", "TotalBalanceOL_perc_mean",
    "TotalBalanceOL_ind", "CB_ind", "CB_limit_perc_mean", "SpendingOL_perc_max", "SpendingOL_ind",
)
REVISED8 = (
    "TotalBalanceOL_perc_max", "count_num_cmp", "CB_limit_perc_mean", "median_payment",
    "number_payments", "max_balance", "max_cash_balance", "credit_change",
)


def account_table(billing_rows: DataFrame, payment_rows: DataFrame, transaction_rows: DataFrame,
                  performance: DataFrame, impute: bool = True, aggregated: bool = False) -> DataFrame:
    """Payments and billing features joined to the label; transaction features where there are any.

    With ``aggregated``, ``transaction_rows`` has the features already, one row per account.

    Each input is aggregated on the account key before it is joined, so the joins meet rows
    that are already partitioned by that key. Train and test accounts are told apart by
    membership in ``performance``; pass both to build them in one go. Missing payment amounts
    become the mean of all payments first; without ``impute`` they make the account's amounts
    missing, hence 0.
    """
    if impute:
        payment_rows = fill_with_mean(payment_rows, ["TRANSACTION_AMT"])
    wide = (
        payments.features(payment_rows)
        .join(billing.features(billing_rows), KEY)
        .join(performance.select(KEY, LABEL), KEY)
        .join(transaction_rows if aggregated else transactions.features(transaction_rows), KEY, "left")
    )
    return cast_columns(wide, LOGICAL, "int")


def fill_transactions(account: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Accounts without purchases get the mean of the per-account values of the population."""
    return fill_with_mean(account, TRANSACTION_FILLS, population)


def model_table(account: DataFrame, predictors: tuple[str, ...] = FULL27) -> DataFrame:
    """Key, label and predictors as doubles, with no missing predictor (zero fill)."""
    if LABEL in predictors:
        raise ValueError("the label must not be a predictor")
    return account.select(
        KEY, F.col(LABEL).cast("double").alias(LABEL),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in predictors])
