"""Explicit schemas of the account tables; nothing is inferred from the files."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "ID_CPTE"
LABEL = "Default"
PERIOD = "PERIODID_MY"

BILLING = T.StructType([
    T.StructField(KEY, T.LongType(), False),
    T.StructField(PERIOD, T.DateType(), False),
    T.StructField("CurrentTotalBalance", T.DoubleType()),
    T.StructField("CashBalance", T.DoubleType()),
    T.StructField("CreditLimit", T.DoubleType()),
    T.StructField("DelqCycle", T.IntegerType()),
    T.StructField("StatementDate", T.DateType()),
])

PAYMENTS = T.StructType([
    T.StructField(KEY, T.LongType(), False),
    T.StructField("TRANSACTION_AMT", T.DoubleType()),
    T.StructField("TRANSACTION_DTTM", T.TimestampType(), False),
    T.StructField("PAYMENT_REVERSAL_XFLG", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField(KEY, T.LongType(), False),
    T.StructField("TRANSACTION_AMT", T.DoubleType()),
    T.StructField("PRIOR_CREDIT_LIMIT_AMT", T.DoubleType()),
    T.StructField("TRANSACTION_TYPE_XCD", T.StringType()),
    T.StructField("TRANSACTION_CATEGORY_XCD", T.StringType()),
    T.StructField("MERCHANT_COUNTRY_XCD", T.StringType()),
    T.StructField("MERCHANT_CATEGORY_XCD", T.StringType()),
    T.StructField("MERCHANT_CITY_NAME", T.StringType()),
])

PERFORMANCE = T.StructType([
    T.StructField(KEY, T.LongType(), False),
    T.StructField(PERIOD, T.DateType()),
    T.StructField(LABEL, T.IntegerType()),
])

TABLES = {
    "billing": BILLING,
    "payments": PAYMENTS,
    "transactions": TRANSACTIONS,
    "performance": PERFORMANCE,
}

# Columns in which a blank is a value of its own, not a missing one.
CODE_COLUMNS = (
    "PAYMENT_REVERSAL_XFLG",
    "TRANSACTION_TYPE_XCD",
    "TRANSACTION_CATEGORY_XCD",
    "MERCHANT_COUNTRY_XCD",
    "MERCHANT_CATEGORY_XCD",
    "MERCHANT_CITY_NAME",
)
