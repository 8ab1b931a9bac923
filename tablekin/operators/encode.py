"""Category dictionaries: learnt on one table, applied to both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import q
from .index import sorted_index

SENT_BYTES = 8 << 20  # of one column's dictionary, by its counted texts
ROW_BYTES = 64


@dataclass(frozen=True)
class Dictionary:
    """Rows ``(column, value, code)``, the number of values per column and, where known, the bytes of their texts."""

    rows: DataFrame
    sizes: dict[str, int]
    text_bytes: dict[str, int] = field(default_factory=dict)

    def fits(self, column: str) -> bool:
        """Whether the column's values are known to be few enough to be sent to every task."""
        known = self.text_bytes.get(column)
        return known is not None and known + ROW_BYTES * self.sizes[column] <= SENT_BYTES


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> Dictionary:
    """Codes 0, 1, … in the order of the text of the value, per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    ordered = sorted_index(values, ["column", "value"])
    ends = ordered.groupBy("column").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("value")).alias("bytes")).collect()
    sizes = {r["column"]: r["size"] for r in ends}
    text_bytes = {r["column"]: r["bytes"] for r in ends}
    if not ends:
        return Dictionary(ordered.select("column", "value", F.col("idx").cast("int").alias("code")), sizes, text_bytes)
    first = F.create_map(*[F.lit(v) for r in ends for v in (r["column"], r["first"])])
    rows = ordered.select("column", "value", (F.col("idx") - first[F.col("column")]).cast("int").alias("code"))
    return Dictionary(rows, sizes, text_bytes)


def apply_dictionary(df: DataFrame, dictionary: Dictionary, columns: Sequence[str], on_unseen: str = "error") -> DataFrame:
    """Replace categories by codes (double). An unseen category raises, or becomes null with ``on_unseen='null'``.

    A dictionary of known small size is sent to the rows, so a hot category moves nothing; a larger one is joined by shuffle.
    """
    order = df.columns
    for c in columns:
        codes = dictionary.rows.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").cast("double").alias("_code")
        )
        codes = F.broadcast(codes) if dictionary.fits(c) else codes
        joined = df.join(codes, q(c).cast("string") == F.col("_value"), "left")
        if on_unseen == "error":
            problem = F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), q(c).cast("string")))
            code = F.when(F.col("_code").isNull() & q(c).isNotNull(), problem.cast("double")).otherwise(F.col("_code"))
        else:
            code = F.col("_code")
        df = joined.withColumn(c, code).drop("_value", "_code")
    return df.select(*map(q, order))


def unseen_categories(df: DataFrame, dictionary: Dictionary, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, value, n)`` of the categories the dictionary does not know."""
    from .clean import value_counts

    return value_counts(df, columns).join(dictionary.rows, ["column", "value"], "left_anti")


def factorize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The level table of the given columns: ``(column, value, code, n)``."""
    from .clean import value_counts

    counted = value_counts(df, columns)
    return counted.join(fit_dictionary(df, columns).rows, ["column", "value"])
