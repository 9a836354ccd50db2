"""Joins of the account tables."""

from __future__ import annotations

from collections.abc import Mapping

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.sources.schemas import KEY, PERIOD


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name."""
    return reduce(DataFrame.unionByName, frames)


def members(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def others(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys.select(key), key, "left_anti")


def detail_with_account(detail: DataFrame, account: DataFrame, key: str = KEY) -> DataFrame:
    """Every detail row with its account's columns.

    The detail side is the preserved side, so adaptive execution may split a heavy key.
    """
    return detail.join(account, key, "left")


def lookup(df: DataFrame, scores: DataFrame, key: str = KEY) -> DataFrame:
    """Score by id. Spark broadcasts the scores only if their size is under its threshold."""
    return df.join(scores, key, "left")


def side_by_side(scores: Mapping[str, DataFrame], key: str = KEY, score: str = "score") -> DataFrame:
    """One row per key, one column per named score frame, matched by key and never by position.

    All frames are keyed alike, so one grouping of their union replaces a chain of joins.
    """
    long = union_all(*[
        frame.select(key, F.lit(name).alias("name"), F.col(score).alias("value"))
        for name, frame in scores.items()
    ])
    return long.groupBy(key).pivot("name", list(scores)).agg(F.first("value"))


def closing_statements(statements: DataFrame, days: DataFrame) -> DataFrame:
    """``days`` (key, ``day``, ...) with the struct ``closing``: the statement each day falls to.

    That is the first statement later than the day, if it has a previous one and the day is not
    before it. Statements and days are merged in one ordered pass per account; both are bounded
    by the calendar, whatever the number of payments.
    """
    dated = statements.select(
        KEY, F.col(PERIOD).alias("day"), F.lit(0).alias("__is_day"),
        F.struct(*[c for c in statements.columns if c != KEY]).alias("__statement"))
    both = dated.unionByName(days.withColumn("__is_day", F.lit(1)), allowMissingColumns=True)
    # Latest first, so the window only grows. On a shared day the payment is passed before the
    # statement, so it falls to the next one.
    later = Window.partitionBy(KEY).orderBy(F.desc("day"), F.desc("__is_day")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    closing = F.last("__statement", ignorenulls=True).over(later)
    return (both.withColumn("closing", closing)
            .where((F.col("__is_day") == 1) & F.col("closing.lag_period").isNotNull()
                   & (F.col("day") >= F.col("closing.lag_period")))
            .drop("__is_day", "__statement"))


def statement_payments_join(statements: DataFrame, payments: DataFrame, how: str = "inner") -> DataFrame:
    """Each statement with the payments made since the previous one.

    ``statements`` has the key, the period (a date) and ``lag_period``; a payment belongs to a
    statement when ``lag_period <= TRANSACTION_DTTM < period``. The interval is resolved once per
    account and day, so the payments themselves meet an equi-join on account and day, which
    spreads an account over its days; adaptive execution splits a day with very many.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    dated = payments.withColumn("day", F.to_date("TRANSACTION_DTTM"))
    assigned = closing_statements(statements, dated.select(KEY, "day").distinct())
    matched = dated.join(assigned, [KEY, "day"]).select(KEY, "closing.*", *[c for c in payments.columns if c != KEY])
    if how == "inner":
        return matched
    paid = assigned.select(KEY, F.col(f"closing.{PERIOD}").alias(PERIOD))
    unpaid = statements.join(paid, [KEY, PERIOD], "left_anti")
    return matched.unionByName(unpaid, allowMissingColumns=True)
