"""Missing values: profile, fills, complete cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing and present values per column, in one pass: ``column``, ``n_null``, ``n_present``."""
    columns = list(columns or df.columns)
    one_row = df.agg(F.count(F.lit(1)).alias("__rows"),
                     *[F.count(F.col(c)).alias(c) for c in columns])
    entry = [F.struct(F.lit(c).alias("column"), (F.col("__rows") - F.col(c)).alias("n_null"),
                      F.col(c).alias("n_present")) for c in columns]
    return one_row.select(F.inline(F.array(*entry)))


def fill_with_mean(df: DataFrame, columns: Sequence[str], population: DataFrame | None = None) -> DataFrame:
    """Replace missing values by the column mean of ``population`` (default: of ``df``)."""
    source = df if population is None else population
    means = source.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means[c]) for c in columns})


def fill_with_group_mean(df: DataFrame, column: str, key: str) -> DataFrame:
    """Replace missing values by the mean of the row's own group.

    The mean is aggregated first and joined back: partial sums keep a heavy group off a single
    task, which a window over the group would not.
    """
    means = df.groupBy(key).agg(F.avg(column).alias("__mean"))
    return (df.join(means, key, "left")
            .withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("__mean")))
            .select(*df.columns))


def fill_with_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace missing numbers by 0 and missing logical values by false."""
    logical = [n for n, t in df.dtypes if t == "boolean" and (columns is None or n in columns)]
    out = df.fillna(0, subset=list(columns) if columns is not None else None)
    return out.fillna(False, subset=logical) if logical else out


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).dropna()
