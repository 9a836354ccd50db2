"""Derived columns: ratios, flags, indicators and recodes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the data model.
HOME_COUNTRY = "DP"
TRANSACTION_TYPES = ("A", "B", "C", "D", "E", "F", "G")
TRANSACTION_CATEGORIES = ("A", "B", "C", "D", "E")
DEFAULT_THRESHOLD = 0.257


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` as a double; NULL where the denominator is zero."""
    return F.try_divide(_column(numerator).cast("double"), _column(denominator).cast("double"))


def guarded_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """As :func:`ratio`, but zero where the denominator is zero."""
    return F.when(_column(denominator) == 0, F.lit(0.0)).otherwise(ratio(numerator, denominator))


def flag(condition: Column) -> Column:
    """A condition as 0/1; an unknown condition stays unknown."""
    return condition.cast("int")


def indicators(column: str, values: Iterable[str], prefix: str) -> dict[str, Column]:
    """One 0/1 column per listed value. The list is fixed, so no pass over the data is needed."""
    return {f"{prefix}{v}": flag(F.col(column) == v) for v in values}


def label_to_text(label: Column | str) -> Column:
    label = _column(label)
    return F.when(label == 0, "No").when(label.isNotNull(), "Yes")


def label_to_number(label: Column | str) -> Column:
    label = _column(label)
    return F.when(label == "No", 0).when(label.isNotNull(), 1)


def at_threshold(score: Column | str, threshold: float = DEFAULT_THRESHOLD, strict: bool = False) -> Column:
    score = _column(score)
    return flag(score > threshold if strict else score >= threshold)


def period_year(period: Column | str) -> Column:
    return F.substring(_column(period).cast("string"), 1, 4)


def cast_columns(df: DataFrame, columns: Iterable[str], data_type: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(data_type) for c in columns})


def keep(df: DataFrame, columns: Iterable[str], strict: bool = True) -> DataFrame:
    """Columns by name, in table order. Unknown names raise unless ``strict`` is off."""
    wanted = set(columns)
    _reject_unknown(df, wanted, strict)
    return df.select([c for c in df.columns if c in wanted])


def leave_out(df: DataFrame, columns: Iterable[str], strict: bool = True) -> DataFrame:
    unwanted = set(columns)
    _reject_unknown(df, unwanted, strict)
    return df.select([c for c in df.columns if c not in unwanted])


def _reject_unknown(df: DataFrame, names: set[str], strict: bool) -> None:
    unknown = sorted(names - set(df.columns))
    if strict and unknown:
        raise ValueError(f"not in the table: {', '.join(unknown)}")
