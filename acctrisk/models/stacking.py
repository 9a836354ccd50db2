"""Registry of models, out-of-fold scores, tuning and the second level."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.columns import at_threshold
from acctrisk.models import bayes, kernel_bayes, knn, linear, networks, trees
from acctrisk.models.base import Fit, assembled
from acctrisk.operators.joins import side_by_side, union_all
from acctrisk.operators.splits import in_fold, outside_fold
from acctrisk.plans.evaluate import roc_auc
from acctrisk.plans.mart import BAYES14, BILLING13, FULL24, NET16, PAYMENTS11
from acctrisk.sources.schemas import KEY, LABEL


def registry(rounds: int = 300, small_rounds: int = 100, trees_: int = 100, networks_: int = 5) -> dict[str, Fit]:
    """The first-level models by name. The arguments set the length of the long-running ones."""
    return {
        "svm_radial": linear.svm_radial(FULL24),
        "additive": linear.additive(FULL24),
        "boosted": trees.boosted(FULL24, rounds=rounds),
        "boosted_billing": trees.boosted(
            BILLING13, rounds=small_rounds, step=0.3, max_depth=2, min_gain=0.0, min_rows=1, rows=0.5),
        "boosted_payments": trees.boosted(
            PAYMENTS11, rounds=small_rounds, step=0.3, max_depth=3, min_gain=0.0, min_rows=1, rows=0.5),
        "forest": trees.forest(FULL24, trees=trees_),
        "network_average": networks.network_average(NET16, networks=networks_),
        **{f"knn_{k}": knn.nearest(FULL24, k) for k in (2, 4, 8, 16)},
        "bayes": bayes.gaussian(FULL24),
        "bayes_kernel": kernel_bayes.kernel(FULL24),
        "bayes_averaged": bayes.model_averaged(BAYES14),
    }


def out_of_fold(df: DataFrame, fit: Fit, folds: int) -> DataFrame:
    """Key, score and label of every row, scored by a model that did not see the row's fold.

    ``df`` has a ``fold`` column in ``0..folds-1`` and is read by every fit, so it should be a
    stored table or a checkpoint.
    """
    parts = [
        fit(outside_fold(df, i).drop("fold"))(in_fold(df, i).drop("fold")).select(KEY, "score", LABEL)
        for i in range(folds)
    ]
    return union_all(*parts)


def out_of_fold_table(df: DataFrame, models: Mapping[str, Fit], folds: int) -> DataFrame:
    """One row per account with one out-of-fold score per model, and the label."""
    wide = side_by_side({name: out_of_fold(df, fit, folds) for name, fit in models.items()})
    return wide.join(df.select(KEY, LABEL), KEY)


def first_stage_feature(df: DataFrame, fit: Fit, folds: int, name: str) -> DataFrame:
    """``df`` with the out-of-fold score of a first-stage model as a further predictor."""
    return df.join(out_of_fold(df, fit, folds).select(KEY, F.col("score").alias(name)), KEY)


def votes(scores: DataFrame, models: Sequence[str], thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Second-level table of 0/1 votes: ``v1``, ``v2``, ... in the order of ``models``."""
    thresholds = thresholds or {}
    return scores.select(KEY, *[
        at_threshold(m, thresholds.get(m, 0.5)).alias(f"v{i}") for i, m in enumerate(models, 1)])


def blender(text: str = f"{LABEL} ~ v1*v3 + v2 + v4 + v5") -> Fit:
    """Logistic blend of first-level scores ``v1 .. v5``."""
    return linear.logistic_formula(text)


def expand_grid(**values: Sequence) -> list[dict]:
    """All combinations of the listed parameter values."""
    return [dict(zip(values, combination)) for combination in product(*values.values())]


def grid_search(df: DataFrame, factory: Callable[..., Fit], grid: Sequence[Mapping], folds: int,
                parallel: int = 4) -> DataFrame:
    """Mean train and test AUC over the folds for every grid point, best test AUC first.

    Fits run side by side; each is a distributed job. The result has one row per grid point.
    """

    def evaluate(task: tuple[int, int]) -> tuple[int, float, float]:
        point, fold = task
        train, test = outside_fold(df, fold).drop("fold"), in_fold(df, fold).drop("fold")
        scorer = factory(**grid[point])(train)
        both = [roc_auc(scorer(part), LABEL, ["score"]).first()["auc"] for part in (train, test)]
        return point, *both

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(evaluate, [(p, f) for p in range(len(grid)) for f in range(folds)]))
    rows = [(*map(float, point.values()), *_means([d[1:] for d in done if d[0] == i]))
            for i, point in enumerate(grid)]
    columns = [*grid[0], "train_auc", "test_auc"]
    schema = ", ".join(f"`{c}` double" for c in columns)
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc_nulls_last("test_auc"), *grid[0])


def _means(pairs: list) -> tuple:
    return tuple(None if any(v is None for v in column) else sum(column) / len(column) for column in zip(*pairs))


def best_point(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("test_auc")).limit(1)


def cross_validated(df: DataFrame, classifier, grid: Mapping[str, Sequence], predictors: Sequence[str],
                    folds: int, parallel: int = 4) -> CrossValidatorModel:
    """Spark's own cross-validation on the ``fold`` column, by area under the ROC curve."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), list(values))
    validator = CrossValidator(
        estimator=Pipeline(stages=[assembled(predictors), classifier]), estimatorParamMaps=builder.build(),
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL, numBins=0), numFolds=folds, foldCol="fold",
        parallelism=parallel)
    return validator.fit(df)


def cross_validated_logistic(df: DataFrame, predictors: Sequence[str], ridges: Sequence[float], folds: int) -> DataFrame:
    """Mean test AUC per ridge parameter of a logistic regression."""
    model = cross_validated(df, LogisticRegression(labelCol=LABEL), {"regParam": ridges}, predictors, folds)
    rows = [(float(r), float(m)) for r, m in zip(ridges, model.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "ridge double, test_auc double")
