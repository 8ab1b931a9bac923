"""Cleaning, imputation and projection; every function is a DataFrame transform."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import Roles


def q(name: str) -> Column:
    """Column by exact name; names may hold ``-`` and ``.``."""
    return F.col("`" + name.replace("`", "``") + "`")


def sentinel_to_null(df: DataFrame, sentinels: Sequence[str] = ("?",), columns: Iterable[str] | None = None) -> DataFrame:
    chosen = set(df.columns if columns is None else columns)
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"} & chosen
    return df.select(
        *[
            F.when(~q(c).isin(*sentinels), q(c)).alias(c) if c in strings else q(c)
            for c in df.columns
        ]
    )


def null_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column, null_ratio)``: one wide aggregate, then a stack of the single result row."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.avg(q(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], [q(c) for c in columns], "column", "null_ratio")


def high_null_columns(df: DataFrame, threshold: float = 0.8) -> list[str]:
    return [r["column"] for r in null_ratio(df).where(F.col("null_ratio") >= threshold).collect()]


def drop_high_null(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return df.drop(*high_null_columns(df, threshold))


def align_columns(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with the same columns in the same order; a column missing on a side raises."""
    columns = list(columns or a.columns)
    for side, df in (("first", a), ("second", b)):
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"{side} table lacks {missing}")
    return a.select(*map(q, columns)), b.select(*map(q, columns))


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the column mean. The means are one row of one pass; filling is a projection."""
    means = dict(zip(columns, df.agg(*[F.avg(q(c)) for c in columns]).first()))
    return df.select(
        *[F.coalesce(q(c), F.lit(float(means[c]))).alias(c) if means.get(c) is not None else q(c) for c in df.columns]
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, value, n)`` of all non-null values, from one pass for all columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, mode, n_distinct, n_values)``; ties go to the smallest value."""
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.sum("n").alias("n_values"),
        )
    )


def impute_most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = {r["column"]: r["mode"] for r in most_frequent(df, columns).collect()}
    types = dict(df.dtypes)
    return df.select(
        *[
            F.coalesce(q(c), F.lit(modes[c]).cast(types[c])).alias(c) if modes.get(c) is not None else q(c)
            for c in df.columns
        ]
    )


def cast_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Continuous to double; categorical to the text of a double, so that labels read ``1.0``."""
    return df.select(
        *[
            q(c).cast("double").alias(c)
            if not roles.is_categorical(c)
            else q(c).cast("double").cast("string").alias(c)
            for c in roles.columns
        ]
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: q(c).try_cast("double") for c in columns})


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def select_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*map(q, columns))


def rename_columns(df: DataFrame, names: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Positional list of new names, or a mapping of old to new."""
    if isinstance(names, Mapping):
        return df.withColumnsRenamed(dict(names))
    return df.toDF(*names)


def filter_rows(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    differs: Mapping[str, object] | None = None,
    among: Mapping[str, Sequence[object]] | None = None,
) -> DataFrame:
    for c, v in (equals or {}).items():
        df = df.where(q(c) == F.lit(v))
    for c, v in (differs or {}).items():
        df = df.where(q(c) != F.lit(v))
    for c, vs in (among or {}).items():
        df = df.where(q(c).isin(*vs))
    return df
