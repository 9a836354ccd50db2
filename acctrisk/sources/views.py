"""Account tables derived from the star-schema test tables.

Money is in whole cents (BIGINT): sums of integers do not depend on the order in which
partitions are merged, so every run and every cluster size gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acctrisk.sources.schemas import KEY, LABEL, PERIOD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def credit_limit(key: Column, day: Column) -> Column:
    """Limit in cents: zero for every fiftieth account, else it moves with the year.

    The limits are not round numbers, so the ratios of statements to them are not either.
    """
    return F.when(key % 50 == 0, 0).otherwise(10_007_000 + 2_002_000 * (F.year(day) % 3)).cast("long")


def is_train(key: str = KEY) -> Column:
    return F.col(key) % 10 < 7


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account: the period it was judged in and whether it defaulted."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(KEY),
        F.make_date(F.lit(2001), (F.col("c_custkey") % 12 + 1).cast("int"), F.lit(1)).alias(PERIOD),
        (F.col("c_acctbal") < 0).cast("int").alias(LABEL),
    )


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account and statement month."""
    order = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(KEY),
        F.trunc("o_orderdate", "MM").alias(PERIOD),
        cents(F.col("o_totalprice")).alias("amount"),
        (F.col("o_orderstatus") == "F").alias("cash"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    return order.groupBy(KEY, PERIOD).agg(
        F.sum("amount").alias("CurrentTotalBalance"),
        F.sum(F.when(F.col("cash"), F.col("amount")).otherwise(0)).alias("CashBalance"),
        F.count_if("urgent").cast("int").alias("DelqCycle"),
    ).withColumn("CreditLimit", credit_limit(F.col(KEY), F.col(PERIOD)))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per purchase. Every tenth account is a supplementary one: its purchases are booked
    on the account before it, so that it has none."""
    line = table(spark, sf_dir, "lineitem")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    kind = F.concat("l_returnflag", "l_linestatus")
    return rows.select(
        F.when(F.col("o_custkey") % 10 == 3, F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias(KEY),
        cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("TRANSACTION_AMT"),
        F.col("l_shipdate").alias("TRANSACTION_DTTM"),
        credit_limit(F.col("o_custkey"), F.col("l_shipdate")).alias("PRIOR_CREDIT_LIMIT_AMT"),
        F.when(kind == "AF", "A").when(kind == "AO", "B").when(kind == "NF", "C")
        .when(kind == "NO", "D").when(kind == "RF", "E").when(kind == "RO", "F")
        .alias("TRANSACTION_TYPE_XCD"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 10 == 0), None)
        .otherwise(F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE"))
        .alias("TRANSACTION_CATEGORY_XCD"),
        F.when(F.col("s_nationkey") == F.col("c_nationkey"), "DP")
        .otherwise(F.concat(F.lit("N"), F.col("s_nationkey"))).alias("MERCHANT_COUNTRY_XCD"),
        F.concat(F.lit("M"), F.col("l_partkey") % 25).alias("MERCHANT_CATEGORY_XCD"),
        F.concat(F.lit("CITY"), F.col("l_suppkey")).alias("MERCHANT_CITY_NAME"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per payment. Some amounts are missing and some flags are blank."""
    return table(spark, sf_dir, "events").where(F.col("event_type") != "signup").select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias(KEY),
        F.when(F.col("event_id") % 97 != 0, cents(F.col("value"))).alias("TRANSACTION_AMT"),
        F.col("ts").alias("TRANSACTION_DTTM"),
        F.when(F.col("event_type") == "error", "N").when(F.col("event_type") == "view", "")
        .otherwise("Y").alias("PAYMENT_REVERSAL_XFLG"),
    )


def statement_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments in the years of the statements, for the statement-to-payment interval join."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias(KEY),
        cents(F.col("l_extendedprice")).alias("TRANSACTION_AMT"),
        F.col("l_shipdate").alias("TRANSACTION_DTTM"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with an outcome and two model scores.

    The scores are multiples of a power of two, so their sums are exact; ``mod2`` has few
    distinct values, hence many ties.
    """
    obs = F.col("o_orderstatus") == "F"
    mod1 = F.col("o_orderkey") * 48271 % 786431 + F.when(obs, 262144).otherwise(0) + 1
    mod2 = (F.col("o_orderkey") * 7 + F.col("o_custkey") * 31) % 800 + F.when(obs, 100).otherwise(0) + 1
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        obs.cast("int").alias("obs"),
        (mod1.cast("double") / F.lit(1048576.0)).alias("mod1"),
        (mod2.cast("double") / F.lit(1024.0)).alias("mod2"),
        cents(F.col("o_totalprice")).cast("double").alias("var"),
        F.col("o_orderpriority").alias("var_cat"),
    )
