"""Codes of categorical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from acctrisk.session import checkpointed


def numbered_levels(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """The distinct values of a column with their zero-based place in ascending order.

    Values are dealt into ranges and numbered inside them; sizes of the ranges, of which there are as
    many as shuffle partitions, give the offsets. No task holds all values.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(ranges, column)
    levels = checkpointed(levels.withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = levels.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    return levels.join(offsets, "__range").select(column, (F.col("__before") + place).cast("int").alias(name))


def categorical_code(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """``df`` with the place of a column's value among its sorted distinct values; a missing value has none."""
    if name in df.columns:
        raise ValueError(f"the table has a column {name}")
    return df.join(numbered_levels(df, column, name), column, "left").select(*df.columns, name)
