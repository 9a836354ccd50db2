"""Running totals over a whole table, without sorting it in one task.

Rows are cut into value buckets, each bucket is totalled, the short table of bucket totals is
accumulated, and the window runs inside the buckets. Any cuts give the same result, so
approximate quantiles will do. The cuts are looked up when the plan is built: a few hundred
numbers from one pass over the ordering column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from acctrisk.functions.bins import with_bucket

LEAST_BUCKETS = 256
EXACT_INTEGERS = 2 ** 53


def bucket_count(spark: SparkSession) -> int:
    """Enough buckets to occupy the shuffle partitions of the cluster."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_BUCKETS, 2 * partitions)


def quantile_cuts(df: DataFrame, column: str, buckets: int) -> list:
    """``buckets - 1`` ascending approximate quantiles of a numeric column."""
    probabilities = ",".join(f"{i / buckets!r}D" for i in range(1, buckets))
    return df.agg(F.expr(f"approx_percentile(`{column}`, array({probabilities}), {max(10_000, 4 * buckets)})")).first()[0] or []


def _hot_values(cuts: Sequence) -> dict:
    """Values that fill two or more quantiles, with the number of quantiles they fill.

    Integers beyond the exact range of a double share buckets with their neighbours and are not
    singled out.
    """
    return {v: filled for v, filled in Counter(cuts).items() if filled > 1 and not abs(v) >= EXACT_INTEGERS}


def _with_buckets(df: DataFrame, order: str, tie: str | None, buckets: int) -> tuple[DataFrame, list[str]]:
    """Add bucket columns whose order agrees with the order of ``(order, tie)``."""
    cuts = quantile_cuts(df, order, buckets)
    out = with_bucket(df, order, cuts, "__part")
    hot = _hot_values(cuts) if tie is not None else {}
    if not hot:
        return out, ["__part"]
    # A hot value is itself a cut, so it is the smallest value of its bucket. Its rows are kept
    # apart from the others, ahead of them, and are cut by the tie-breaker into about as many
    # pieces as it fills quantiles (the next power of two).
    levels: dict[int, list] = {}
    for value, filled in hot.items():
        levels.setdefault((filled - 1).bit_length(), []).append(value)
    finest = max(levels)
    is_hot = F.coalesce(F.col(order).isin(list(hot)), F.lit(False))
    out = with_bucket(out, tie, quantile_cuts(df.where(is_hot), tie, 1 << finest), "__fine")
    piece = F.lit(-1)
    for level, values in levels.items():
        piece = F.when(F.col(order).isin(values), F.shiftright("__fine", finest - level)).otherwise(piece)
    out = out.withColumns({"__cold": F.when(is_hot, 0).otherwise(1), "__tie": piece}).drop("__fine")
    return out, ["__part", "__cold", "__tie"]


def running_totals(df: DataFrame, order: str, totals: Mapping[str, Column], tie: str | None = None,
                   by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Inclusive running sums in ascending ``(order, tie)``, separately for each ``by`` group.

    For every name in ``totals`` the column ``name`` holds the running sum and ``name_total``
    the sum of the whole group. Leave ``tie`` out only where ``order`` is unique within its
    group.
    """
    # As a struct the group is never NULL, so plain equality matches missing groups too.
    terms = df.withColumns({**{f"__{n}": c for n, c in totals.items()},
                            "__group": F.struct(*by) if by else F.struct(F.lit(0))})
    rows, parts = _with_buckets(terms, order, tie, buckets or bucket_count(df.sparkSession))
    place = ["__group", *parts]
    sums = rows.groupBy(*place).agg(*[F.sum(f"__{n}").alias(f"__{n}_sum") for n in totals])
    group = Window.partitionBy("__group")
    before = group.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *place,
        *[F.coalesce(F.sum(f"__{n}_sum").over(before), F.lit(0)).alias(f"__{n}_before") for n in totals],
        *[F.sum(f"__{n}_sum").over(group).alias(f"{n}_total") for n in totals],
    )
    inside = Window.partitionBy(*place).orderBy(*([order] if tie is None else [order, tie]))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The join hashes rows as the window wants them: one shuffle serves both. A group has at most
    # four times as many offsets as there are buckets, so the build sides are small.
    joined = rows.join(offsets.hint("shuffle_hash"), place)
    return (
        joined.withColumns({n: F.col(f"__{n}_before") + F.sum(f"__{n}").over(inside) for n in totals})
        .select(*df.columns, *totals, *[f"{n}_total" for n in totals])
    )
