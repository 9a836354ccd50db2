"""Descriptive tables: rates, frequencies, summaries, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.columns import ratio
from acctrisk.operators.quantiles import exact_quantiles
from acctrisk.operators.running import running_totals
from acctrisk.session import checkpointed

# Fixed value: scales the median absolute deviation to the standard deviation of a normal.
MAD_SCALE = 1.4826
TRIM = 0.1


def rate_by(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias(name))


def row_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; equal counts in the order of the value."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.desc("n"), F.asc_nulls_last(column))
    return out if top is None else out.limit(top)


def contingency(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of actual by predicted class, both 0/1, absent pairs as zero."""
    return df.groupBy(actual).agg(
        F.count_if(F.col(predicted) == 0).alias("predicted_0"),
        F.count_if(F.col(predicted) == 1).alias("predicted_1"))


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sample statistics of a numeric column per group, for any number of groups of any size.

    Moments are one aggregation; median, trimmed mean and median absolute deviation come from
    distributed ranks. Skew and kurtosis use the sample variance. The column is read several
    times, so pass a stored or checkpointed frame.
    """
    rows = df.select(group, F.col(value).cast("double").alias("x")).dropna()
    n = F.count(F.lit(1))
    shrink = (n - 1) / n
    moments = rows.groupBy(group).agg(
        n.alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"), F.max("x").alias("max"), (F.max("x") - F.min("x")).alias("range"),
        (F.skewness("x") * F.pow(shrink, F.lit(1.5))).alias("skew"),
        ((F.kurtosis("x") + 3) * F.pow(shrink, F.lit(2.0)) - 3).alias("kurtosis"),
        (F.stddev_samp("x") / F.sqrt(n)).alias("se"),
    )
    median = exact_quantiles(rows, "x", [0.5], by=[group]).select(group, F.col("quantile").alias("median"))
    median = checkpointed(median)
    away = rows.join(median, group).select(group, F.abs(F.col("x") - F.col("median")).alias("away"))
    mad = exact_quantiles(away, "away", [0.5], by=[group]).select(
        group, (F.col("quantile") * MAD_SCALE).alias("mad"))
    counted = rows.groupBy(group, "x").agg(F.count(F.lit(1)).alias("copies"))
    ranked = running_totals(counted, "x", {"last": F.col("copies")}, by=[group])
    cut = F.floor(F.col("last_total") * TRIM)
    kept = F.greatest(
        F.least("last", F.col("last_total") - cut) - F.greatest(F.col("last") - F.col("copies"), cut),
        F.lit(0))
    trimmed = ranked.groupBy(group).agg((F.sum(F.col("x") * kept) / F.sum(kept)).alias("trimmed"))
    return (moments.join(median, group).join(trimmed, group).join(mad, group)
            .select(group, "n", "mean", "sd", "median", "trimmed", "mad", "min", "max", "range",
                    "skew", "kurtosis", "se"))


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of numeric columns, in long form."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    basic = long.groupBy("column").agg(
        F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"),
        F.count_if(F.col("x").isNull()).alias("n_null"))
    quartiles = exact_quantiles(long, "x", [0.25, 0.5, 0.75], by=["column"]).groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return basic.join(quartiles, "column", "left").select(
        "column", "min", "q1", "median", "mean", "q3", "max", "n_null")


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per level of several categorical columns, in long form."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])))
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of complete rows: the lower triangle over the sorted names."""
    names = sorted(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    one_row = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna().agg(
        *[F.corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(f"__{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])))


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(column).alias("n_distinct"))


def flag_profile(payments: DataFrame, performance: DataFrame, key: str, label: str) -> DataFrame:
    """Payments and default rate of their accounts per reversal flag."""
    counts = payments.groupBy(key, "PAYMENT_REVERSAL_XFLG").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(performance.select(key, label), key)
    return rows.groupBy("PAYMENT_REVERSAL_XFLG").agg(
        F.sum("n").alias("n_payments"), F.count(F.lit(1)).alias("n_accounts"),
        ratio(F.sum(F.col("n") * F.col(label)), F.sum("n")).alias("default_rate"))
