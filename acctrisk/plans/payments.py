"""Per-account payment features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.strict import Aggregates
from acctrisk.operators.nulls import fill_with_zero
from acctrisk.operators.quantiles import exact_quantiles
from acctrisk.operators.skew import HOT_ROWS, heavy_keys
from acctrisk.sources.schemas import KEY

FEATURES = (
    "mean_payment", "max_payment", "min_payment", "median_payment", "number_payments",
    "reversedPayment", "noPayments",
)


def features(payments: DataFrame, skip_missing: bool = False, fill: bool = True,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per account with payments; missing aggregates become 0 unless ``fill`` is off.

    A median keeps the values of its group, so all accounts with ``hot_rows`` payments or more get
    theirs from a distributed rank search instead, which is joined back. There are usually none;
    then the plan has no second path. Both ways give the same median. Flags follow the rule of the
    other aggregates: one missing flag makes the account's flag missing.
    """
    a = Aggregates(skip_missing)
    amount, code = F.col("TRANSACTION_AMT"), F.col("PAYMENT_REVERSAL_XFLG")
    heavy = heavy_keys(payments, KEY, hot_rows)
    hot = not heavy.isEmpty()
    if hot:
        payments = payments.join(heavy.withColumn("__hot", F.lit(True)), KEY, "left")
    complete = F.lit(skip_missing) | (F.count(amount) == F.count(F.lit(1)))
    kept = F.when(F.col("__hot").isNull(), amount) if hot else amount
    out = payments.groupBy(KEY).agg(
        a.mean(amount).alias("mean_payment"),
        a.max(amount).alias("max_payment"),
        a.min(amount).alias("min_payment"),
        F.when(complete, F.median(kept)).alias("median_payment"),
        F.count(F.lit(1)).alias("number_payments"),
        a.any(code == "N").alias("reversedPayment"),
        a.any(code == "").alias("noPayments"),
        *([complete.alias("__complete")] if hot else []),
    )
    if hot:
        found = exact_quantiles(payments.where("__hot"), "TRANSACTION_AMT", [0.5], by=[KEY])
        found = found.select(KEY, F.col("quantile").alias("__heavy"))
        out = out.join(found, KEY, "left").withColumn(
            "median_payment", F.coalesce("median_payment", F.when(F.col("__complete"), F.col("__heavy"))))
    out = out.select(KEY, *FEATURES)
    # The key is left as it is: a filled key would no longer count as the partitioning key.
    return fill_with_zero(out, FEATURES) if fill else out
