"""Purchase-level columns and per-account transaction features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from acctrisk.functions.columns import (
    HOME_COUNTRY, TRANSACTION_CATEGORIES, TRANSACTION_TYPES, flag, guarded_ratio, indicators)
from acctrisk.sources.schemas import KEY

TYPE, CATEGORY = "TRANSACTION_TYPE_XCD", "TRANSACTION_CATEGORY_XCD"
FEATURES = (
    "number_transactions", "traveller_ind", "mean_trx_amt", "mean_trx_pct", "trx_type_mode",
    "trx_cat_mode",
    *[f"trx_type_{v}_perc" for v in TRANSACTION_TYPES],
    *[f"trx_cat_{v}_perc" for v in TRANSACTION_CATEGORIES],
)


def derived(transactions: DataFrame) -> DataFrame:
    """Home-country flag, type and category indicators, and the share of the limit used."""
    return transactions.withColumns({
        "isLocal": flag(F.col("MERCHANT_COUNTRY_XCD") == HOME_COUNTRY),
        **indicators(TYPE, TRANSACTION_TYPES, "trx_type_"),
        **indicators(CATEGORY, TRANSACTION_CATEGORIES, "trx_cat_"),
        "trxpctused": guarded_ratio("TRANSACTION_AMT", "PRIOR_CREDIT_LIMIT_AMT"),
    })


def coded_counts(transactions: DataFrame) -> DataFrame:
    """Purchases per account, type and category: count, sums and how many values are known."""
    limit_share = guarded_ratio("TRANSACTION_AMT", "PRIOR_CREDIT_LIMIT_AMT")
    summed = {"local": flag(F.col("MERCHANT_COUNTRY_XCD") == HOME_COUNTRY), "amount": F.col("TRANSACTION_AMT"), "share": limit_share}
    return transactions.groupBy(KEY, TYPE, CATEGORY).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"{name}_sum") for name, c in summed.items()],
        *[F.count(c).alias(f"{name}_known") for name, c in summed.items()])


def features(transactions: DataFrame, skip_missing: bool = False) -> DataFrame:
    """One row per account with purchases.

    ``traveller_ind`` is 1 when every purchase is at home. The name says the opposite; the
    value is kept as the models expect it.

    Purchases are counted once, per account and codes; everything else comes from these counts, of
    which an account has at most as many as there are pairs of codes.
    """
    n, total = F.col("n"), F.sum("n")
    by_code = coded_counts(transactions)
    for name, code in (("__type", TYPE), ("__category", CATEGORY)):
        together = F.sum("n").over(Window.partitionBy(KEY, code))
        by_code = by_code.withColumn(name, F.when(F.col(code).isNotNull(), F.struct((-together).alias("n"), F.col(code).alias("code"))))

    def known(value: Column, count: Column) -> Column:
        return F.when(count > 0, value) if skip_missing else F.when(count == total, value)

    def mean(name: str) -> Column:
        count = F.sum(f"{name}_known")
        return known(F.try_divide(F.sum(f"{name}_sum").cast("double"), count), count)

    def share(code: str, value: str) -> Column:
        count = F.sum(F.when(F.col(code).isNotNull(), n).otherwise(0))
        return known(F.try_divide(F.sum(F.when(F.col(code) == value, n).otherwise(0)).cast("double"), count), count)

    return by_code.groupBy(KEY).agg(
        total.alias("number_transactions"),
        flag(total == known(F.sum("local_sum"), F.sum("local_known"))).alias("traveller_ind"),
        mean("amount").alias("mean_trx_amt"),
        mean("share").alias("mean_trx_pct"),
        F.min("__type")["code"].alias("trx_type_mode"),
        F.min("__category")["code"].alias("trx_cat_mode"),
        *[share(TYPE, v).alias(f"trx_type_{v}_perc") for v in TRANSACTION_TYPES],
        *[share(CATEGORY, v).alias(f"trx_cat_{v}_perc") for v in TRANSACTION_CATEGORIES],
    )


def mean_amount(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(KEY).agg(F.avg("TRANSACTION_AMT").alias("mean_amt"))


def pair_counts(transactions: DataFrame, performance: DataFrame) -> DataFrame:
    """Purchases by category, type, label and the account's mean amount.

    The purchases are read once: an account's mean comes from the sums of its pairs of codes, and the
    label is joined to these. Rows with a missing key are left out.
    """
    keys = [CATEGORY, TYPE, "Default", "mean_amt"]
    amount = F.col("TRANSACTION_AMT")
    account = Window.partitionBy(KEY)
    mean = F.try_divide(F.sum("sum").over(account).cast("double"), F.sum("known").over(account))
    by_account = transactions.groupBy(KEY, CATEGORY, TYPE).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(amount).alias("sum"), F.count(amount).alias("known"))
    return (by_account.withColumn("mean_amt", mean).join(performance.select(KEY, "Default"), KEY, "left").dropna(subset=keys)
            .groupBy(*keys).agg(F.sum("pairs").alias("pair_count")))
