"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from acctrisk.sources import schemas

#: Types that an unknown column may have, narrowest first, and how their values are written.
TYPE_PATTERNS = (
    (T.BooleanType(), r"^(TRUE|FALSE|True|False|true|false|T|F)$"),
    (T.IntegerType(), r"^[+-]?[0-9]+$"),
    (T.LongType(), r"^[+-]?[0-9]+$"),
    (T.DoubleType(), r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    (T.DateType(), r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
)


def blank_is_value(column: Column) -> Column:
    """Code column rule: the text ``NA`` is missing, an empty field is the value ``''``."""
    return F.when(column != "NA", column).when(column.isNull(), F.lit(""))


def _named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _typed(name: str, data_type: T.DataType) -> Column:
    text = _named(name)
    return F.when(~text.isin("", "NA"), text).cast(data_type).alias(name)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType,
             code_columns: Iterable[str] = schemas.CODE_COLUMNS) -> DataFrame:
    """CSV with a header line: the columns of the schema by name, in any order, others left out.

    The fields are read as text and cast, because the reader's own NULL option cannot tell a
    blank code from a missing one. A field that does not fit its type fails the query.
    """
    codes = set(code_columns)
    raw = spark.read.csv(path, header=True)
    require_columns(raw, *schema.names)
    return raw.select([
        blank_is_value(_named(f.name)).alias(f.name) if f.name in codes else _typed(f.name, f.dataType)
        for f in schema
    ])


def read_parquet(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """One of the account tables by name, as CSV or Parquet."""
    schema = schemas.TABLES[table]
    return read_csv(spark, path, schema) if fmt == "csv" else read_parquet(spark, path, schema)


def read_scored(spark: SparkSession, path: str, schema: T.StructType | None = None,
                fmt: str = "parquet") -> DataFrame:
    """A table of scored rows from a path the user names. A CSV needs no schema: see :func:`narrowest_types`."""
    if fmt == "parquet":
        return read_parquet(spark, path, schema)
    if schema is None:
        schema = narrowest_types(spark.read.csv(path, header=True))
    return read_csv(spark, path, schema, [f.name for f in schema if f.dataType == T.StringType()])


def narrowest_types(raw: DataFrame) -> T.StructType:
    """The narrowest type that holds all known values of each text column, found by one aggregation over all rows.

    Blank fields and ``NA`` are known to no type. The types are, in this order, boolean (``TRUE``, ``T``
    and the like), int, long, double, date (``yyyy-MM-dd``) and text; a column without known values is
    boolean. In text a blank stays a value and only ``NA`` is missing. Numbers lose leading zeros.
    """
    if not raw.columns:
        return T.StructType()

    def fits(text: Column, pattern: str, kind: str) -> Column:
        return F.coalesce(text.rlike(pattern) & text.try_cast(kind).isNotNull(), F.lit(False))

    def counts(name: str) -> Column:
        text = _named(name)
        known = text.isNotNull() & ~text.isin("", "NA")
        return F.struct(F.count_if(known), *[F.count_if(known & fits(text, p, t.simpleString())) for t, p in TYPE_PATTERNS])

    found = raw.agg(*[counts(name).alias(f"c{i}") for i, name in enumerate(raw.columns)]).first()
    return T.StructType([
        T.StructField(name, next((t for (t, _), n in zip(TYPE_PATTERNS, row[1:]) if n == row[0]), T.StringType()))
        for name, row in zip(raw.columns, found)])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Reject names that are not columns: a mistyped name must not pass unnoticed."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"not in the table: {', '.join(unknown)}; it has {', '.join(df.columns)}")
    return df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def submission(scored: DataFrame, key: str = schemas.KEY, score: str = "score") -> DataFrame:
    """The two-column result handed in: the account and its score, under the label's name."""
    require_columns(scored, key, score)
    return scored.select(F.col(key).alias(schemas.KEY), F.col(score).alias(schemas.LABEL))
