"""Aggregates with a chosen rule for missing values.

A strict aggregate is NULL as soon as one input of its group is NULL; a relaxed one skips
NULLs, which is Spark's own rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def strict(aggregate: Callable[[Column], Column], column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    complete = F.count(column) == F.count(F.lit(1))
    return F.when(complete, aggregate(column))


class Aggregates:
    """``mean``, ``max``, ``min``, ``sum``, ``any`` under one missing-value rule."""

    def __init__(self, skip_missing: bool = False):
        self._wrap = (lambda f, c: f(c)) if skip_missing else strict

    def mean(self, column: Column | str) -> Column:
        return self._wrap(F.avg, column)

    def max(self, column: Column | str) -> Column:
        return self._wrap(F.max, column)

    def min(self, column: Column | str) -> Column:
        return self._wrap(F.min, column)

    def sum(self, column: Column | str) -> Column:
        return self._wrap(F.sum, column)

    def any(self, condition: Column | str) -> Column:
        return self._wrap(F.bool_or, condition)
