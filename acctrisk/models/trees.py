"""Decision tree, forest, boosted trees and adaptive boosting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.hashing import poisson_weight, uniform
from acctrisk.models.base import Fit, Scorer, assembled, check_predictors, pipeline
from acctrisk.session import checkpointed
from acctrisk.sources.schemas import KEY, LABEL


def tree(predictors: Sequence[str], max_depth: int = 10, min_rows: int = 33, min_gain: float = 0.001) -> Fit:
    return pipeline(predictors, DecisionTreeClassifier(
        labelCol=LABEL, maxDepth=max_depth, minInstancesPerNode=min_rows, minInfoGain=min_gain, seed=8))


def forest(predictors: Sequence[str], trees: int = 100, per_split: int = 2, min_rows: int = 2,
           max_depth: int = 10) -> Fit:
    return pipeline(predictors, _forest(trees, per_split, min_rows, max_depth))


def _forest(trees: int, per_split: int, min_rows: int, max_depth: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=LABEL, numTrees=trees, featureSubsetStrategy=str(per_split), impurity="gini",
        minInstancesPerNode=min_rows, maxDepth=max_depth, seed=8)


def boosted(predictors: Sequence[str], rounds: int = 300, step: float = 0.05, max_depth: int = 9,
            min_gain: float = 0.0, columns: float = 0.8, min_rows: int = 100, rows: float = 0.8,
            holdout: float = 0.0, tolerance: float = 0.01) -> Fit:
    """Gradient-boosted trees. With ``holdout`` > 0 that share of the training rows decides when to stop.

    ``min_gain`` is the impurity that a split must remove per row. A least gain of the whole loss, as
    other libraries have it, is to be divided by the number of rows.
    """
    if not 0 < step <= 1:
        raise ValueError("the learning rate must be in (0, 1]")
    settings = dict(
        labelCol=LABEL, maxIter=rounds, stepSize=step, maxDepth=max_depth, minInfoGain=min_gain,
        featureSubsetStrategy=str(columns), minInstancesPerNode=min_rows, subsamplingRate=rows, seed=8)
    if not holdout:
        return pipeline(predictors, GBTClassifier(**settings))
    with_stop = pipeline(predictors, GBTClassifier(
        **settings, validationIndicatorCol="held_out", validationTol=tolerance))

    def fit(train: DataFrame) -> Scorer:
        return with_stop(train.withColumn("held_out", uniform(F.col(KEY), seed=11) < F.lit(holdout)))

    return fit


def importance(train: DataFrame, predictors: Sequence[str], trees: int = 100, max_depth: int = 10) -> DataFrame:
    """Gain per predictor of a forest, largest first."""
    check_predictors(train, predictors)
    model = Pipeline(stages=[assembled(predictors), _forest(trees, 2, 2, max_depth)]).fit(train)
    gains = [(p, float(g)) for p, g in zip(predictors, model.stages[-1].featureImportances.toArray())]
    return train.sparkSession.createDataFrame(gains, "predictor string, gain double").orderBy(
        F.desc("gain"), "predictor")


def adaptive(predictors: Sequence[str], rounds: int = 50, max_depth: int = 3, bag_seed: int | None = None,
             checkpoint_every: int = 5) -> Fit:
    """Adaptive boosting: trees on reweighted rows, voting with the log-odds of their accuracy.

    With ``bag_seed`` the first weights are a bootstrap sample's. The weights are a column, so a
    round is one distributed fit and one aggregation; the lineage is cut every few rounds.
    """

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, predictors)
        first = F.lit(1.0) if bag_seed is None else poisson_weight(F.col(KEY), bag_seed).cast("double")
        rows = assembled(predictors).transform(train).select(
            KEY, LABEL, "features", first.alias("w")).where(F.col("w") > 0)
        rows = checkpointed(rows)
        voters: list[tuple[float, object]] = []
        for r in range(rounds):
            weak = DecisionTreeClassifier(labelCol=LABEL, weightCol="w", maxDepth=max_depth, seed=8).fit(rows)
            judged = weak.transform(rows).select(
                KEY, LABEL, "features", "w", (F.col("prediction") != F.col(LABEL)).alias("wrong"))
            sums = judged.agg(F.sum("w").alias("all"), F.sum(F.when(F.col("wrong"), F.col("w")).otherwise(0.0))
                              .alias("wrong")).first()
            error = sums["wrong"] / sums["all"]
            if error >= 0.5:
                break
            vote = math.log((1 - error) / max(error, 1e-10))
            voters.append((vote, weak))
            if error == 0:
                break
            raised = F.col("w") * F.when(F.col("wrong"), math.exp(vote)).otherwise(1.0) / F.lit(sums["all"])
            rows = judged.select(KEY, LABEL, "features", raised.alias("w"))
            if (r + 1) % checkpoint_every == 0:
                rows = checkpointed(rows)
        return _vote(predictors, voters)

    return fit


def _vote(predictors: Sequence[str], voters: list) -> Scorer:
    total = sum(v for v, _ in voters) or 1.0
    models = [m.copy().setPredictionCol(f"__p{i}").setProbabilityCol(f"__q{i}").setRawPredictionCol(f"__r{i}")
              for i, (_, m) in enumerate(voters)]
    stages = PipelineModel([assembled(predictors), *models])

    def score(df: DataFrame) -> DataFrame:
        votes = sum((F.lit(v) * F.col(f"__p{i}") for i, (v, _) in enumerate(voters)), F.lit(0.0))
        return stages.transform(df).withColumn("score", votes / total).select(*df.columns, "score")

    return score


def bagged_adaptive(predictors: Sequence[str], bags: int = 5, rounds: int = 50, max_depth: int = 3) -> Fit:
    """The mean vote of adaptive boosting fitted on bootstrap samples."""
    return averaged([adaptive(predictors, rounds, max_depth, bag_seed=7919 * (b + 1)) for b in range(bags)])


def averaged(fits: Sequence[Fit]) -> Fit:
    """The mean score of several models."""

    def fit(train: DataFrame) -> Scorer:
        scorers = [f(train) for f in fits]

        def score(df: DataFrame) -> DataFrame:
            out = df
            for i, scorer in enumerate(scorers):
                out = scorer(out).withColumnRenamed("score", f"__score{i}")
            mean = sum((F.col(f"__score{i}") for i in range(len(scorers))), F.lit(0.0)) / len(scorers)
            return out.withColumn("score", mean).select(*df.columns, "score")

        return score

    return fit
