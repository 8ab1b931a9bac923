"""Global row numbers, splits, replicates and column shuffles.

One hash-ordered row number per table serves every split and every shuffle: seed ``s`` permutes the numbers by
``(idx * multiplier(s) + offset(s)) mod n``, so later steps are equi-joins on uniform integers.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from itertools import count, islice
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .clean import q

ROWS_PER_BUCKET = 1_000_000
MAX_HEX_DIGITS = 4


@dataclass(frozen=True)
class Indexed:
    """A table with a gapless ``idx`` in ``[0, n)``."""

    df: DataFrame
    n: int


def _hash(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat(F.concat_ws("|", *[q(c).cast("string") for c in key]), F.lit(f":{seed}")))


def _bucket_counts(hashed: DataFrame, weight: Column) -> dict[str, int]:
    prefix = F.substring("_h", 1, MAX_HEX_DIGITS)
    counts = hashed.groupBy(prefix.alias("p")).agg(F.sum(weight).alias("n")).toPandas()
    return {p: int(n) for p, n in zip(counts["p"], counts["n"])}


def _offsets(counts: dict[str, int], digits: int) -> list[tuple[str, int]]:
    folded: dict[str, int] = {}
    for prefix, n in counts.items():
        folded[prefix[:digits]] = folded.get(prefix[:digits], 0) + n
    out, total = [], 0
    for prefix in sorted(folded):
        out.append((prefix, total))
        total += folded[prefix]
    return out


def row_index(df: DataFrame, key: Sequence[str] | None, seed: int = 0, keep: bool = True) -> Indexed:
    """Number the rows in order of ``md5(key:seed)`` without a single-task sort.

    Rows fall into buckets by hash prefix, each bucket is numbered alone, and the bucket offsets (at most
    16**4, from a pre-aggregated count) are added. The number does not depend on the partitioning.
    ``key`` must be unique; without one, equal rows are first merged with their multiplicity.
    """
    merged = key is None
    if merged:
        columns = df.columns
        df = df.groupBy(*map(q, columns)).agg(F.count(F.lit(1)).alias("_copies"))
        hashed = df.withColumn("_h", F.md5(F.concat(F.to_json(F.struct(*map(q, columns))), F.lit(f":{seed}"))))
        order, weight = ["_h"], F.col("_copies")
    else:
        hashed = df.withColumn("_h", _hash(key, seed))
        order, weight = ["_h", *key], F.lit(1)
    counts = _bucket_counts(hashed, weight)
    n = sum(counts.values())
    digits = min(MAX_HEX_DIGITS, max(1, ceil(log(max(n, 1) / ROWS_PER_BUCKET, 16)) if n > ROWS_PER_BUCKET else 1))
    offsets = df.sparkSession.createDataFrame(_offsets(counts, digits) or [("", 0)], "_b string, _o long")
    bucketed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    in_bucket = Window.partitionBy("_b").orderBy(*[q(c) for c in order])
    if not merged:
        numbered = bucketed.withColumn("_r", F.row_number().over(in_bucket) - 1)
    else:
        upto = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = bucketed.withColumn("_r", F.sum("_copies").over(upto) - F.col("_copies"))
    numbered = numbered.join(F.broadcast(offsets), "_b").withColumn("idx", F.col("_r") + F.col("_o"))
    if merged:
        numbered = _spread_copies(numbered)
    out = numbered.drop("_h", "_b", "_r", "_o", "_copies")
    return Indexed(materialize(out, "index") if keep else out, n)


def _spread_copies(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row per copy again; a row with many copies is cut into chunks that are spread over the tasks first."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / chunk).cast("long"))
    cut = df.withColumn("_chunk", F.explode(chunks)).repartition("_h", "_chunk")
    first = F.col("_chunk") * chunk
    last = F.least(first + chunk, F.col("_copies")) - 1
    return (
        cut.withColumn("_copy", F.explode(F.sequence(first, last)))
        .withColumn("idx", F.col("idx") + F.col("_copy"))
        .drop("_chunk", "_copy")
    )


def group_index(df: DataFrame, within: Sequence[str], key: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Row number ``idx`` inside each group, and the group sizes ``(within, n)``.

    A group is numbered in hash buckets, so a group with a third of all rows is still many window partitions.
    """
    hashed = df.withColumn("_h", _hash(key, seed)).withColumn("_b", F.substring("_h", 1, MAX_HEX_DIGITS))
    cells = hashed.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sizes = cells.groupBy(*within).agg(F.sum("_n").alias("n"))
    bucket = Window.partitionBy(*within, "_b").orderBy("_h", *key)
    numbered = (
        hashed.withColumn("_r", F.row_number().over(bucket) - 1)
        .join(offsets, [*within, "_b"])
        .withColumn("idx", F.col("_r") + F.col("_o"))
    )
    return numbered.drop("_h", "_b", "_r", "_o"), sizes


def sorted_index(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Row number ``idx`` in the order of the given columns: range partitions, numbered alone, plus offsets."""
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_r", in_part),
        "sorted",
    )
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, total = [], 0
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], "_part int, _o long")
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn("idx", F.col("_r") + F.col("_o"))
        .drop("_part", "_r", "_o")
    )


@cache
def _prime(place: int) -> int:
    """The primes above one million, counted from 0."""
    candidate = _prime(place - 1) + 1 if place else 1_000_001
    while not all(candidate % d for d in range(2, int(candidate**0.5) + 1)):
        candidate += 1
    return candidate


@cache
def multiplier(seed: int, n: int = 0) -> int:
    """The ``seed``-th prime above one million that does not divide ``n``."""
    fitting = (p for p in map(_prime, count()) if n == 0 or n % p)
    return next(islice(fitting, seed, None))


def offset(seed: int) -> int:
    return (seed + 1) * 7919


def permuted(idx: Column, seed: int, n: int) -> Column:
    """Position of row ``idx`` under permutation ``seed`` of ``n`` rows."""
    return F.pmod(idx * F.lit(multiplier(seed, n)) + F.lit(offset(seed)), F.lit(n).cast("long"))


def test_size(n: int, share: float) -> int:
    return ceil(round(n * share, 6))


def holdout_split(table: Indexed, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``; exactly ``ceil(n * share)`` rows are held out, chosen by the seed."""
    pos = permuted(F.col("idx"), seed, table.n)
    return table.df.withColumn("is_test", pos < F.lit(test_size(table.n, share)))


def train_part(table: Indexed, share: float, seed: int) -> Indexed:
    """The training rows of a split, renumbered without gaps and without a shuffle."""
    held = test_size(table.n, share)
    moved = table.df.withColumn("idx", permuted(F.col("idx"), seed, table.n) - F.lit(held))
    return Indexed(moved.where(F.col("idx") >= 0), table.n - held)


def replicates(table: Indexed, reps: int, share: float = 0.05, first_seed: int = 0, name: str = "rep") -> DataFrame:
    """``reps`` copies tagged ``rep`` (or ``name``) with their own ``is_test``; no cross join, no new sort."""
    held = test_size(table.n, share)
    idx = F.col("idx")
    tags = F.array(
        *[
            F.struct(F.lit(r).alias(name), (permuted(idx, first_seed + r, table.n) < held).alias("is_test"))
            for r in range(reps)
        ]
    )
    return table.df.select("*", F.inline(tags))


def sample_columns(columns: Sequence[str], k: int, rep: int) -> list[str]:
    """``k`` columns chosen by repetition ``rep``."""
    return [columns[i] for i in random.Random(rep).sample(range(len(columns)), k)]


def shuffle_columns(table: Indexed, columns: Sequence[str], seed: int = 1) -> Indexed:
    """Permute the chosen columns together: their values move between rows as one unit."""
    if not columns:
        return table
    order = table.df.columns
    donors = table.df.select(F.col("idx").alias("_src"), *map(q, columns))
    moved = table.df.drop(*columns).withColumn("_src", permuted(F.col("idx"), seed, table.n)).join(donors, "_src")
    return Indexed(moved.select(*map(q, order)), table.n)


SWEEP_SEEDS = 100  # seeds below are for holdouts, replicates and single shuffles


def sweep_seed(run: int, rep: int) -> int:
    """A seed of its own for each cell of a sweep: the cells are numbered along diagonals."""
    return SWEEP_SEEDS + (run + rep) * (run + rep + 1) // 2 + rep


def column_shuffle_sweep(table: Indexed, columns: Sequence[str], max_columns: int, reps: int) -> DataFrame:
    """All tables of a shuffle trial in one frame tagged ``(run, rep)``: ``run`` columns are shuffled together.

    Copies of numbers alone are made where rows and donors meet, after one exchange of packed rows. Other copies are made by
    exploding the tags and get their donor values from a single equi-join.
    """
    others = [c for c in table.df.columns if c not in columns]
    kinds = dict(table.df.dtypes)
    if others == ["idx"] and kinds["idx"] == "bigint" and reps and all(kinds[c] == "double" for c in columns):
        from .permute import permuted_sweep  # which builds on this module

        return permuted_sweep(table, columns, max_columns, reps)
    plain = table.df.select("*", F.explode(F.array(*[F.lit(r) for r in range(reps)])).alias("rep"))
    out = plain.select(F.lit(0).alias("run"), "rep", *map(q, others), *map(q, columns))
    if max_columns == 0:
        return out
    idx = F.col("idx")
    tags = F.array(
        *[
            F.struct(
                F.lit(k).alias("run"),
                F.lit(r).alias("rep"),
                F.array(*[F.lit(c) for c in sample_columns(columns, k, r)]).alias("_cols"),
                permuted(idx, sweep_seed(k, r), table.n).alias("_src"),
            )
            for k in range(1, max_columns + 1)
            for r in range(reps)
        ]
    )
    donors = table.df.select(idx.alias("_src"), *[q(c).alias(f"_d_{c}") for c in columns])
    moved = table.df.select("*", F.inline(tags)).join(donors, "_src")
    chosen = [F.when(F.array_contains("_cols", c), q(f"_d_{c}")).otherwise(q(c)).alias(c) for c in columns]
    return out.unionByName(moved.select("run", "rep", *map(q, others), *chosen))
