"""Operators of a training-data pipeline, each by a method of its own."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries() -> dict:
    import corpus_pipeline
    from acctrisk.llm import catalog

    return dict(catalog.QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from acctrisk.llm import catalog

    return dict(catalog.SQL)
