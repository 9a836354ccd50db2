"""Finding heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000


def heavy_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """All keys that hold at least ``rows`` rows, one column. The counts are partial sums, so no task sees a heavy key's rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.where(F.col("__rows") >= rows).select(key)
