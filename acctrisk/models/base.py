"""What a model is here: a function from training rows to a scorer.

``fit(train)`` returns a function that adds the column ``score`` to any frame with the same
predictors: the probability of default unless the model says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from acctrisk.sources.schemas import KEY, LABEL

Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Scorer]


def check_predictors(df: DataFrame, predictors: Sequence[str]) -> None:
    """Predictors must be columns, and none of them may be the label."""
    if LABEL in predictors:
        raise ValueError("the label must not be a predictor")
    unknown = [p for p in predictors if p not in df.columns]
    if unknown:
        raise ValueError(f"not in the table: {', '.join(unknown)}")


def added(batches: Iterator[pa.RecordBatch], places: Sequence[str], sums: Callable) -> Iterator[tuple[tuple, object]]:
    """The sums of rows that come together, by the columns ``places``; ``sums`` reads those of row ``i`` of a batch."""
    held, total = None, None
    for batch in batches:
        for i, place in enumerate(zip(*(batch.column(c).to_pylist() for c in places))):
            if place == held:
                total = total + sums(batch, i)
            else:
                if held is not None:
                    yield held, total
                held, total = place, sums(batch, i)
    if held is not None:
        yield held, total


def settled(df: DataFrame, partitions: int | None = None, key: str = KEY) -> DataFrame:
    """Rows placed and ordered by key.

    Models that sample rows draw per partition, so a table stored in this layout gives the same
    fit on every run; pass ``partitions`` to make that hold across cluster sizes as well.
    """
    placed = df.repartition(key) if partitions is None else df.repartition(partitions, key)
    return placed.sortWithinPartitions(key)


def assembled(predictors: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(predictors), outputCol="features", handleInvalid="error")


def probability_scorer(model: Transformer, column: str = "probability") -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        probability = vector_to_array(F.col(column))[1]
        return model.transform(df).withColumn("score", probability).select(*df.columns, "score")

    return score


def pipeline(predictors: Sequence[str], *stages: Estimator | Transformer) -> Fit:
    """A classifier on assembled predictors, scored by its probability of class 1."""

    def fit(train: DataFrame) -> Scorer:
        check_predictors(train, predictors)
        model = Pipeline(stages=[assembled(predictors), *stages]).fit(train)
        return probability_scorer(model)

    return fit
