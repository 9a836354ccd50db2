"""Splits, folds and samples of the accounts."""

from __future__ import annotations

import math

from acctrisk.catalog.registry import query
from acctrisk.operators import splits as S
from acctrisk.sources import views
from acctrisk.sources.schemas import KEY, LABEL

RANKED = """SELECT ID_CPTE, "Default", row_number() OVER (PARTITION BY "Default" ORDER BY h, ID_CPTE) AS r,
                   count(*) OVER (PARTITION BY "Default") AS n FROM hashed WHERE seed = {seed}"""


def _accounts(spark, sf_dir):
    return views.performance(spark, sf_dir).select(KEY, LABEL)


@query("stratified_split", f"""
    SELECT ID_CPTE, "Default", r <= ceil(n * CAST(0.7 AS DOUBLE)) AS in_train FROM ({RANKED.format(seed=8)})""")
def stratified_split(spark, sf_dir):
    return S.stratified_split(_accounts(spark, sf_dir), 0.7, seed=8)


@query("kfold_assign", f"""
    SELECT ID_CPTE, "Default", CAST((r - 1) % 10 AS INTEGER) AS fold FROM ({RANKED.format(seed=0)})""")
def kfold_assign(spark, sf_dir):
    return S.balanced_folds(_accounts(spark, sf_dir), 10)


@query("fold_complement", 'SELECT ID_CPTE, "Default", CAST(h % 10 AS INTEGER) AS fold FROM hashed '
                          'WHERE seed = 0 AND h % 10 <> 3')
def fold_complement(spark, sf_dir):
    return S.outside_fold(S.hashed_folds(_accounts(spark, sf_dir), 10), 3)


@query("fold_union", 'SELECT ID_CPTE, "Default", CAST(h % 5 AS INTEGER) AS fold FROM hashed WHERE seed = 0')
def fold_union(spark, sf_dir):
    from acctrisk.operators.joins import union_all
    folds = S.hashed_folds(_accounts(spark, sf_dir), 5)
    return union_all(*[S.in_fold(folds, i) for i in range(5)])


@query("repeated_kfold", """
    SELECT ID_CPTE, CAST(max(h % 5) FILTER (WHERE seed = 1000) AS INTEGER) AS fold_1,
           CAST(max(h % 5) FILTER (WHERE seed = 2000) AS INTEGER) AS fold_2 FROM hashed GROUP BY ID_CPTE""")
def repeated_kfold(spark, sf_dir):
    return S.repeated_folds(_accounts(spark, sf_dir).select(KEY), 5, 2)


@query("subsample", """
    SELECT ID_CPTE FROM hashed
    WHERE seed = 0 AND CAST(h AS DOUBLE) / CAST(2147483648 AS DOUBLE) < CAST(0.8 AS DOUBLE)""")
def subsample(spark, sf_dir):
    return S.subsample(_accounts(spark, sf_dir).select(KEY), 0.8)


_STEPS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_COUNT = " + ".join(
    f"CAST(CAST(h AS DOUBLE) / CAST(2147483648 AS DOUBLE) >= CAST({s!r} AS DOUBLE) AS INTEGER)" for s in _STEPS)


@query("bootstrap_weights", f"""
    SELECT ID_CPTE, CAST(max({_COUNT}) FILTER (WHERE seed = 7919) AS INTEGER) AS weight_1,
           CAST(max({_COUNT}) FILTER (WHERE seed = 15838) AS INTEGER) AS weight_2 FROM hashed GROUP BY ID_CPTE""")
def bootstrap_weights(spark, sf_dir):
    return S.bootstrap_weights(_accounts(spark, sf_dir).select(KEY), 2)
