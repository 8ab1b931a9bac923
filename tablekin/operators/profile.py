"""Column profiles and the comparison of two tables' distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import Roles
from .clean import most_frequent, q


def profile_continuous(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, mean, std, null_pct)`` rounded to one digit; text that is no number counts as null."""
    numeric = df.select(*[q(c).try_cast("double").alias(c) for c in columns])
    wide = numeric.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.bround(F.avg(q(c)), 1).alias("mean"),
                F.bround(F.stddev_samp(q(c)), 1).alias("std"),
                F.bround(F.avg(q(c).isNull().cast("double")) * 100, 1).alias("null_pct"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.inline(F.array(*[q(c) for c in columns])))


def profile_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, mode, n_distinct, null_pct)``; the smallest of the most frequent values is the mode."""
    wide = df.agg(
        *[
            F.struct(F.lit(c).alias("column"), F.bround(F.avg(q(c).isNull().cast("double")) * 100, 1).alias("null_pct")).alias(c)
            for c in columns
        ]
    )
    nulls = wide.select(F.inline(F.array(*[q(c) for c in columns])))
    return nulls.join(most_frequent(df, columns).drop("n_values"), "column", "left").select(
        "column", "mode", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "null_pct"
    )


def profile_table(tables: Sequence[tuple[str, DataFrame, Roles]]) -> DataFrame:
    """Rows ``(dataset, column, statistic, null_pct)``: ``mean (std)`` or ``mode [distinct]``."""
    out: DataFrame | None = None
    for name, df, roles in tables:
        parts = []
        if roles.continuous:
            parts.append(
                profile_continuous(df, roles.continuous).select(
                    "column", F.format_string("%.1f (%.1f)", "mean", "std").alias("statistic"), "null_pct"
                )
            )
        if roles.categorical:
            parts.append(
                profile_categorical(df, roles.categorical).select(
                    "column", F.format_string("%s [%d]", "mode", "n_distinct").alias("statistic"), "null_pct"
                )
            )
        for part in parts:
            tagged = part.select(F.lit(name).alias("dataset"), "*")
            out = tagged if out is None else out.unionByName(tagged)
    return out


def class_share_by_source(df: DataFrame, label: str, source: str) -> DataFrame:
    """Rows ``(label, source, n, total, pct)``: counts joined with the totals of their source."""
    counts = df.groupBy(q(label), q(source)).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(q(source)).agg(F.sum("n").alias("total"))
    return counts.join(totals, source).withColumn("pct", F.col("n") * 100.0 / F.col("total"))


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(q(a), q(b)).agg(F.count(F.lit(1)).alias("n"))


def compare_univariate(a: DataFrame, b: DataFrame, roles: Roles, bins: int = 10) -> DataFrame:
    """Rows ``(column, level, n_a, n_b, share_a, share_b)``: relative frequencies of both tables side by side.

    Continuous columns are cut into equal bins over the first table's range; values outside fall into the
    bins 0 and ``bins + 1``. Both tables are counted in one pass over their union.
    """
    ranges = a.agg(*[F.struct(F.min(q(c)), F.max(q(c))).alias(c) for c in roles.continuous]).first()
    levels = []
    for c in roles.columns:
        if roles.is_categorical(c):
            level = q(c).cast("string")
        else:
            low, high = ranges[c]
            width = (high - low) / bins or 1.0
            inside = F.floor((q(c) - low) / F.lit(width)).cast("int") + 1
            level = (
                F.when(q(c) < low, 0)
                .when(q(c) > high, bins + 1)
                .when(q(c).isNotNull(), F.least(inside, F.lit(bins)))
                .cast("string")
            )
        levels.append(F.struct(F.lit(c).alias("column"), level.alias("level")))
    both = a.select(F.lit("a").alias("side"), *map(q, roles.columns)).unionByName(
        b.select(F.lit("b").alias("side"), *map(q, roles.columns))
    )
    counts = (
        both.select("side", F.inline(F.array(*levels)))
        .where(F.col("level").isNotNull())
        .groupBy("column", "level")
        .agg(
            F.count_if(F.col("side") == "a").alias("n_a"),
            F.count_if(F.col("side") == "b").alias("n_b"),
        )
    )
    totals = counts.groupBy("column").agg(F.sum("n_a").alias("_a"), F.sum("n_b").alias("_b"))
    return counts.join(F.broadcast(totals), "column").select(  # one row per column of the table
        "column",
        "level",
        "n_a",
        "n_b",
        F.try_divide("n_a", "_a").alias("share_a"),
        F.try_divide("n_b", "_b").alias("share_b"),
    )
