"""Comparison of two importance vectors per target by ten rank measures.

Input rows: ``(keys…, target, feature, pos, score_a, score_b)``. One shuffle by ``(keys…, target)`` ranks both
sides and gathers one row per target that holds the rank lists in column order (as long as the table is wide);
all measures are expressions on that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import sequence_similarity

# The result keys of the ten measures.
METRICS = {
    "ndcg": "ndgc_score",
    "cohen_kappa": "cohen_kappa_score",
    "r2": "r2_score",
    "levenshtein": "levenshtein_normalized_similarity",
    "kendall_tau": "kendalltau",
    "weighted_tau": "weightedtau",
    "rbo": "rbo",
    "damerau": "damerau_levenshtein_normalized_similarity",
    "jaro_winkler": "jaro_winkler_normalized_similarity",
    "hamming": "hamming_normalized_similarity",
}

CHARACTER_LIMIT = 94  # printable ASCII, so that one rank is one character for levenshtein()


def pair_scores(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Join two frames of mean importances ``(keys…, target, feature, pos, score)``."""
    on = [*keys, "target", "feature"]
    left = a.select(*on, "pos", F.col("score").alias("score_a"))
    return left.join(b.select(*on, F.col("score").alias("score_b")), on)


def ordinal_rank(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank_a``, ``rank_b`` (1 = largest score, ties in column order) and the list length ``n``."""
    group = Window.partitionBy(*keys, "target")
    return pairs.select(
        "*",
        F.row_number().over(group.orderBy(F.desc("score_a"), "pos")).alias("rank_a"),
        F.row_number().over(group.orderBy(F.desc("score_b"), "pos")).alias("rank_b"),
        F.count(F.lit(1)).over(group).alias("n"),
    )


def rank_lists(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per target with the lists ``sa, sb, ra, rb`` in column order."""
    cell = F.struct("pos", "score_a", "score_b", "rank_a", "rank_b")
    gathered = ranked.groupBy(*keys, "target").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), F.first("n").cast("int").alias("n")
    )
    return gathered.select(
        *keys,
        "target",
        "n",
        F.col("cells.score_a").alias("sa"),
        F.col("cells.score_b").alias("sb"),
        F.col("cells.rank_a").alias("ra"),
        F.col("cells.rank_b").alias("rb"),
    )


# Pieces of SQL text; one text per measure keeps planning short.
_SUM = "aggregate({}, 0D, (t, x) -> t + x)"
_SAME = "CAST(size(filter(zip_with(ra, rb, (x, y) -> x = y), e -> e)) AS DOUBLE) / n"
_MEAN = f"{_SUM.format('sa')} / n"
_HARMONIC = _SUM.format("transform(sequence(1, n), i -> 1D / i)")
# per position: concordant minus discordant partners in the same pair of lists
CONCORDANCE = (
    "transform(arrays_zip(ra, rb), c -> aggregate(arrays_zip(ra, rb), 0D,"
    " (t, d) -> t + signum(CAST((c.ra - d.ra) * (c.rb - d.rb) AS DOUBLE))))"
)


def _text(ranks: str) -> str:
    return f"array_join(transform({ranks}, r -> char(CAST(r + 32 AS BIGINT))), '')"


def _item_order(ranks: str) -> str:
    """Feature positions in the order of their rank."""
    return f"transform(sequence(1, n), r -> CAST(array_position({ranks}, r) AS INT))"


def measure_expressions(mode: str = "reference") -> dict[str, str]:
    """The measures as SQL text on a row of ``rank_lists`` with the concordance ``s``.

    ``reference`` weights and orders by rank numbers in column order, as published; ``top_weighted`` gives the
    most important feature the largest weight and compares features in the order of their rank.
    """
    if mode == "reference":
        ga, gb, la, lb = "ra", "rb", "ra", "rb"
    elif mode == "top_weighted":
        ga, gb = (f"transform({r}, x -> n + 1 - x)" for r in ("ra", "rb"))
        la, lb = "la", "lb"
    else:
        raise ValueError(mode)
    discount = "log2(n - r + 2D)"
    error = _SUM.format("zip_with(sa, sb, (x, y) -> (x - y) * (x - y))")
    spread = _SUM.format(f"transform(sa, x -> (x - {_MEAN}) * (x - {_MEAN}))")
    weighted = lambda g: _SUM.format(f"zip_with(s, {g}, (c, r) -> c / (n - r + 1))")
    shared = f"size(array_intersect(slice({la}, 1, d), slice({lb}, 1, d)))"
    return {
        "ndcg": f"try_divide({_SUM.format(f'zip_with({ga}, {gb}, (g, r) -> g / {discount})')},"
        f" {_SUM.format(f'transform({gb}, r -> r / {discount})')})",
        "cohen_kappa": f"try_divide({_SAME} - 1D / n, 1D - 1D / n)",
        "r2": f"CASE WHEN array_max(sa) = array_min(sa) THEN CASE WHEN {error} = 0 THEN 1D ELSE 0D END"
        f" ELSE 1D - try_divide({error}, {spread}) END",
        "levenshtein": f"CASE WHEN n <= {CHARACTER_LIMIT} THEN 1D - levenshtein({_text(la)}, {_text(lb)}) / CAST(n AS DOUBLE) END",
        "kendall_tau": f"try_divide({_SUM.format('s')}, n * (n - 1D))",
        "weighted_tau": f"try_divide({weighted(ga)} + {weighted(gb)}, 2D * (n - 1D) * {_HARMONIC})",
        "rbo": _SUM.format(f"transform(sequence(1, n), d -> {shared} / CAST(d AS DOUBLE))") + " / n",
        "hamming": _SAME,
    }


def score_ranks(pairs: DataFrame, keys: Sequence[str] = (), mode: str = "reference", metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per ``(keys…, target)`` with a column per measure and the joined rank strings."""
    wanted = list(metrics or METRICS)
    rows = rank_lists(ordinal_rank(pairs, keys), keys)
    la, lb = "ra", "rb"
    if mode == "top_weighted":
        la, lb = "la", "lb"
        rows = rows.withColumns({la: F.expr(_item_order("ra")), lb: F.expr(_item_order("rb"))})
    exprs = measure_expressions(mode)
    if {"kendall_tau", "weighted_tau"} & set(wanted):
        rows = rows.withColumn("s", F.expr(CONCORDANCE))
    if {"damerau", "jaro_winkler", "levenshtein"} & set(wanted):
        # the UDF runs once per target; its edit distance serves only lists too long for one character per rank
        rows = rows.withColumn("u", sequence_similarity(la, lb))
        exprs["levenshtein"] = f"coalesce({exprs['levenshtein']}, u.levenshtein)"
        exprs["damerau"] = "u.damerau"
        exprs["jaro_winkler"] = "u.jaro_winkler"
    joined = [f"array_join(CAST({r} AS ARRAY<STRING>), '') AS rank_join_{s}" for r, s in (("ra", "a"), ("rb", "b"))]
    return rows.select(*keys, "target", *[F.expr(f"{exprs[m]} AS {m}") for m in wanted], *map(F.expr, joined))


def long_scores(scores: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(keys…, target, metric, value)`` under the published metric names."""
    cells = [F.struct(F.lit(METRICS[m]).alias("metric"), F.col(m).alias("value")) for m in (metrics or METRICS)]
    return scores.select(*keys, "target", F.inline(F.array(*cells)))


def score_aggregate(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each measure over all targets; nulls are skipped."""
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))


def compare_importances(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), mode: str = "reference") -> DataFrame:
    """Mean importances of exactly two tables to rows ``(keys…, target, metric, value)``."""
    return long_scores(score_ranks(pair_scores(a, b, keys), keys, mode), keys)
