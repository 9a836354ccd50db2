"""Previous statement and change between statements, within an account.

Statements are one row per account and month, so an account's history is bounded by the
calendar however many purchases it has; the windows below rely on that grain.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from acctrisk.sources.schemas import KEY, PERIOD


def history(key: str = KEY, order: str = PERIOD) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def with_previous_period(df: DataFrame) -> DataFrame:
    return df.withColumn("lag_period", F.lag(PERIOD).over(history()))


def change(column: str) -> Column:
    return F.col(column) - F.lag(column).over(history())


def change_sign(column: str) -> Column:
    """+1 after a rise, -1 after a fall, 0 when unchanged, NULL on the first statement."""
    return F.signum(change(column)).cast("int")


def last_rows(months: int) -> WindowSpec:
    return history().rowsBetween(1 - months, 0)


def latest(values: Mapping[str, Column], order: str = PERIOD) -> list[Column]:
    """For an aggregation by account: each value as of the last statement."""
    return [F.max_by(c, F.col(order)).alias(n) for n, c in values.items()]
