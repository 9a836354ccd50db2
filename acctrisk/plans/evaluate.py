"""Model-comparison tables, each a chart-ready DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType

from acctrisk.functions.bins import bin_index
from acctrisk.functions.columns import at_threshold, ratio
from acctrisk.operators.quantiles import quantile_breaks
from acctrisk.operators.running import running_totals
from acctrisk.plans.profile import contingency
from acctrisk.sources.tables import require_columns

#: Distinct values above which a numeric column is shown by bin.
BIN_ABOVE = 250


def totals(df: DataFrame, obs: str) -> DataFrame:
    return df.agg(F.sum(obs).alias("total_observed"), F.count(F.lit(1)).alias("total_exposure"))


def _long(df: DataFrame, obs: str, models: Sequence[str], *keep: str) -> DataFrame:
    """One row per row and model: ``model``, ``score``, ``obs``, which stays whole only if it is an integer."""
    require_columns(df, obs, *models, *keep)
    whole = isinstance(df.schema[obs].dataType, (IntegralType, BooleanType))
    entries = [F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in models]
    return df.select(*keep, F.col(obs).cast("long" if whole else "double").alias("obs"), F.inline(F.array(*entries)))


def lorenz_points(df: DataFrame, obs: str, models: Sequence[str], key: str) -> DataFrame:
    """Cumulative share of observed and of exposure in ascending order of each model's score.

    Rows with equal scores follow the key. ``exposure`` and ``observed`` are the running counts.
    """
    run = running_totals(_long(df, obs, models, key), "score",
                         {"exposure": F.lit(1), "observed": F.col("obs")}, tie=key, by=["model"])
    return run.select(
        "model", key, "score", "exposure", "observed", "exposure_total", "observed_total",
        ratio("exposure", "exposure_total").alias("exposure_share"),
        ratio("observed", "observed_total").alias("observed_share"))


def gini(df: DataFrame, obs: str, models: Sequence[str], key: str) -> DataFrame:
    """``1 - 2 * area`` under the Lorenz points, the area starting at the first point.

    Points are one exposure apart, so the trapezoids sum to all heights less half the first
    and half the last: no second pass over neighbouring rows.
    """
    y = F.col("observed").cast("double")
    first = F.max(F.when(F.col("exposure") == 1, y))
    heights = F.sum(y) - (first + F.max(y)) / 2
    area = ratio(heights, F.max("exposure_total") * F.max("observed_total").cast("double"))
    return lorenz_points(df, obs, models, key).groupBy("model").agg((1 - area * 2).alias("gini"))


def _score_counts(df: DataFrame, obs: str, models: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the lowest score."""
    counts = _long(df, obs, models).groupBy("model", "score").agg(
        F.count_if(F.col("obs") == 1).alias("pos"), F.count_if(F.col("obs") == 0).alias("neg"))
    return running_totals(counts, "score", {"pos_to": F.col("pos"), "neg_to": F.col("neg")}, by=["model"])


def roc_points(df: DataFrame, obs: str, models: Sequence[str]) -> DataFrame:
    """True and false positive rate of ``score >= threshold`` at each distinct score."""
    tp = F.col("pos_to_total") - F.col("pos_to") + F.col("pos")
    fp = F.col("neg_to_total") - F.col("neg_to") + F.col("neg")
    return _score_counts(df, obs, models).select(
        "model", F.col("score").alias("threshold"),
        ratio(fp, "neg_to_total").alias("fpr"), ratio(tp, "pos_to_total").alias("tpr"))


def roc_auc(df: DataFrame, obs: str, models: Sequence[str], direction: str = "higher") -> DataFrame:
    """Area under the ROC curve, ties counted one half; NULL with a single class.

    ``direction="auto"`` takes the better side, as when the sense of a score is unknown.
    """
    pos, neg_before = F.col("pos").cast("double"), F.col("neg_to") - F.col("neg")
    won = F.sum(pos * (neg_before + F.col("neg") / 2))
    pairs = F.max("pos_to_total").cast("double") * F.max("neg_to_total")
    auc = ratio(won, pairs)
    auc = F.greatest(auc, 1 - auc) if direction == "auto" else auc
    return _score_counts(df, obs, models).groupBy("model").agg(auc.alias("auc"))


def _measures(obs: str, mod1: str, mod2: str) -> list[Column]:
    return [
        F.avg(obs).alias("observed_mean"), F.sum(obs).alias("observed_sum"),
        F.avg(mod1).alias("model_1_mean"), F.avg(mod2).alias("model_2_mean"),
        F.count(F.lit(1)).alias("exposure"),
    ]


def observed_by_bin(df: DataFrame, obs: str, mod1: str, mod2: str, var: str, bins: int = 20,
                    approximate: bool = False) -> DataFrame:
    """Observed and predicted means per quantile bin of a numeric column.

    The smallest value and missing values form the bin NULL.
    """
    require_columns(df, obs, mod1, mod2, var)
    bin_ = bin_index(var, quantile_breaks(df, var, bins, approximate)).alias("bin")
    return df.groupBy(bin_).agg(*_measures(obs, mod1, mod2))


def observed_by_value(df: DataFrame, obs: str, mod1: str, mod2: str, var: str) -> DataFrame:
    require_columns(df, obs, mod1, mod2, var)
    return df.groupBy(var).agg(*_measures(obs, mod1, mod2))


def observed_vs_predicted(df: DataFrame, obs: str, mod1: str, mod2: str, var: str, bins: int = 20,
                          bin_above: int = BIN_ABOVE) -> DataFrame:
    """By bin for a numeric column with many values, by value otherwise."""
    require_columns(df, obs, mod1, mod2, var)
    if isinstance(df.schema[var].dataType, NumericType):
        if df.select(var).distinct().limit(bin_above + 1).count() > bin_above:
            return observed_by_bin(df, obs, mod1, mod2, var, bins)
    return observed_by_value(df, obs, mod1, mod2, var)


def double_lift(df: DataFrame, obs: str, mod1: str, mod2: str, bins: int = 10,
                approximate: bool = False) -> DataFrame:
    """Both models against the observed mean, per quantile bin of ``mod2 / mod1``."""
    require_columns(df, obs, mod1, mod2)
    sort_ratio = df.withColumn("sort_ratio", ratio(mod2, mod1))
    breaks = quantile_breaks(sort_ratio, "sort_ratio", bins, approximate)
    bin_ = bin_index("sort_ratio", breaks).alias("bin")
    return sort_ratio.groupBy(bin_).agg(
        F.sum(obs).alias("observed_sum"),
        ratio(F.avg(mod1), F.avg(obs)).alias("model_1_lift"),
        ratio(F.avg(mod2), F.avg(obs)).alias("model_2_lift"),
        F.count(F.lit(1)).alias("exposure"))


def confusion(df: DataFrame, obs: str, score: str, threshold: float) -> DataFrame:
    """Actual by predicted counts when ``score >= threshold`` predicts 1."""
    require_columns(df, obs, score)
    return contingency(df.withColumn("__predicted", at_threshold(score, threshold)), obs, "__predicted")
