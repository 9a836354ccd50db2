"""Bins between known cuts. Cuts are short lists, looked up before the plan is built."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F


def bin_index(value: Column | str, breaks: Sequence[float]) -> Column:
    """Bin ``i`` holds ``breaks[i] < value <= breaks[i + 1]``, counted from 1.

    The smallest break itself and missing values belong to no bin: they get NULL, which
    groups as a bin of its own. One comparison per break, meant for the few of a report.
    """
    value = F.col(value) if isinstance(value, str) else value
    below = sum((F.when(value > F.lit(b), 1).otherwise(0) for b in breaks), F.lit(0))
    return F.nullif(below, F.lit(0))


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the number of distinct ``cuts`` not above the value, by binary search.

    The bucket never decreases as the value grows; missing values get bucket -1. It is never
    NULL, so a join on it needs no NULL filter that would repeat the search.
    """
    distinct = sorted({float(c) for c in cuts})
    if not distinct:
        return df.withColumn(name, F.lit(0))
    search = Bucketizer(splits=[-math.inf, *distinct, math.inf], inputCol="__value", outputCol="__bucket",
                        handleInvalid="keep")
    found = search.transform(df.withColumn("__value", F.coalesce(F.col(column).cast("double"), F.lit(0.0))))
    bucket = F.when(F.col(column).isNull(), -1).otherwise(F.col("__bucket").cast("int"))
    return found.withColumn(name, F.coalesce(bucket, F.lit(-1))).drop("__value", "__bucket")
