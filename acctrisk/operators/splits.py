"""Deterministic splits, folds and samples. None of them depends on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctrisk.functions.hashing import key_hash, poisson_weight, uniform
from acctrisk.operators.running import running_totals
from acctrisk.sources.schemas import KEY, LABEL


def _shuffled_rank(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Position of each row within its label, in hash order: ``rank`` from 1, ``rank_total``."""
    hashed = df.withColumn("__hash", key_hash(F.col(key), seed))
    return running_totals(hashed, "__hash", {"rank": F.lit(1)}, tie=key, by=[label]).drop("__hash")


def stratified_split(df: DataFrame, share: float = 0.7, seed: int = 8, key: str = KEY,
                     label: str = LABEL) -> DataFrame:
    """Add ``in_train``: exactly ``ceil(share * n)`` rows of every class."""
    ranked = _shuffled_rank(df.where(F.col(label).isNotNull()), key, label, seed)
    return ranked.withColumn(
        "in_train", F.col("rank") <= F.ceil(F.col("rank_total") * F.lit(share))).drop("rank", "rank_total")


def balanced_folds(df: DataFrame, k: int = 10, seed: int = 0, key: str = KEY, label: str = LABEL) -> DataFrame:
    """Add ``fold`` in ``0..k-1``; every class is spread evenly over the folds."""
    ranked = _shuffled_rank(df.where(F.col(label).isNotNull()), key, label, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "rank_total")


def hashed_folds(df: DataFrame, k: int = 10, seed: int = 0, key: str = KEY, name: str = "fold") -> DataFrame:
    """Add a fold column from the key alone: no pass over the data, no shuffle."""
    return df.withColumn(name, (key_hash(F.col(key), seed) % k).cast("int"))


def repeated_folds(df: DataFrame, k: int, repeats: int, key: str = KEY) -> DataFrame:
    """One fold column per repeat: ``fold_1 .. fold_<repeats>``."""
    for r in range(1, repeats + 1):
        df = hashed_folds(df, k, seed=1000 * r, key=key, name=f"fold_{r}")
    return df


def subsample(df: DataFrame, share: float, seed: int = 0, key: str = KEY) -> DataFrame:
    return df.where(uniform(F.col(key), seed) < F.lit(share))


def bootstrap_weights(df: DataFrame, bags: int, key: str = KEY) -> DataFrame:
    """One Poisson(1) weight column per bag: ``weight_1 .. weight_<bags>``."""
    return df.withColumns({
        f"weight_{b}": poisson_weight(F.col(key), seed=7919 * b) for b in range(1, bags + 1)})


def in_fold(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)


def outside_fold(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") != fold)
