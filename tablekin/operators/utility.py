"""Cross utility: train on one table, score on its own holdout and on the other table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import Roles
from .clean import q
from .estimators import TREES, Fitted, fit_all_targets, run_parallel, tree_rule
from .index import Indexed, holdout_split
from .linear import SOLVERS, column_means, errors_from_sums, product_sums
from .trees import Trees, fit_trees, predict

HELD_OUT = 0.2


def accuracy(y: Column, prediction: Column) -> Column:
    return F.avg((y == prediction).cast("double"))


def mse(y: Column, prediction: Column) -> Column:
    return F.avg(F.pow(prediction - y, 2))


def utility_rows(scored: DataFrame, keys: Sequence[str], higher_is_better: Column) -> DataFrame:
    return scored.select(
        *keys,
        "target",
        F.try_divide("other", "own").alias("ratio"),
        "own",
        "other",
        higher_is_better.alias("higher_is_better"),
    )


def _local(sums: DataFrame) -> DataFrame:
    """The one or two rows of ungrouped sums under a join key; taken once, so no table is read again."""
    rows = [(0, *r) for r in sums.collect()]
    return sums.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_k", T.IntegerType()), *sums.schema.fields]))


def linear_utility(
    train: DataFrame,
    other: DataFrame,
    roles: Roles,
    targets: Sequence[str],
    shift: Sequence[float],
    keys: Sequence[str] = (),
    solver: str = "linear",
) -> DataFrame:
    """Utility rows of the continuous targets from grouped sums alone.

    ``train`` holds sums by ``(keys…, is_test)``, ``other`` sums by ``keys``.
    """
    if not keys:
        return linear_utility(_local(train), _local(other), roles, targets, shift, ["_k"], solver).drop("_k")
    columns = list(roles.columns)
    fit = train.where(~F.col("is_test")).drop("is_test")
    own = errors_from_sums(fit, train.where("is_test").drop("is_test"), columns, targets, shift, keys, solver)
    far = errors_from_sums(fit, other, columns, targets, shift, keys, solver)
    scored = own.withColumnRenamed("mse", "own").join(far.withColumnRenamed("mse", "other"), [*keys, "target"])
    return utility_rows(scored, keys, F.lit(False))


def tree_scores_by(rows: DataFrame, model: Trees, roles: Roles, n: int, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys…, by…, target, score)``: accuracy or squared error of trees on rows with ``idx``, for each value of ``by``."""
    scored = predict(rows, model, n, [*by, "idx"], keys)
    right = F.when(F.col("y") == F.col("prediction"), 1.0).otherwise(0.0)
    value = F.when(F.col("target").isin(*roles.categorical), right) if roles.categorical else F.when(F.lit(False), 0.0)
    value = value.otherwise(F.pow(F.col("prediction") - F.col("y"), 2))
    return scored.groupBy(*keys, *by, "target").agg(F.avg(value).alias("score"))


def tree_scores(held: DataFrame, other: DataFrame, model: Trees, roles: Roles, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys…, target, own, other)``: scores of trees on the rows held out and on another table, both with ``idx``."""
    columns = [*keys, "idx", *map(q, roles.columns)]
    rows = held.select(F.lit(True).alias("_own"), *columns).unionByName(other.select(F.lit(False).alias("_own"), *columns))
    scored = tree_scores_by(rows, model, roles, n, ["_own"], keys)
    of = lambda own: F.max(F.when(F.col("_own") == own, F.col("score")))
    return scored.groupBy(*keys, "target").agg(of(True).alias("own"), of(False).alias("other"))


def _by_fit(roles: Roles, models: tuple[str, str]) -> list[str]:
    """The targets whose models are neither trees nor follow from sums."""
    of = {t: models[0 if roles.is_categorical(t) else 1] for t in roles.columns}
    return [t for t in roles.columns if of[t] not in TREES and (roles.is_categorical(t) or models[1] not in SOLVERS)]


def fit_for_utility(
    x: Indexed, roles: Roles, models: tuple[str, str] = ("tree", "linear"), share: float = HELD_OUT, seed: int = 42, shift: Sequence[float] | None = None, **options
) -> dict[str, Fitted]:
    """The models of ``utility_one_direction`` that are fitted one by one, on the rows of ``x`` that are not held out."""
    by_fit = _by_fit(roles, models)
    return fit_all_targets(holdout_split(x, share, seed).where(~F.col("is_test")), roles, models, by_fit, shift, **options) if by_fit else {}


def utility_one_direction(
    x: Indexed,
    y: DataFrame,
    roles: Roles,
    models: tuple[str, str] = ("tree", "linear"),
    share: float = HELD_OUT,
    seed: int = 42,
    fitted: dict[str, Fitted] | None = None,
    **options,
) -> DataFrame:
    """Rows ``(target, ratio, own, other, higher_is_better)``. ``fitted`` are the models of ``fit_for_utility`` if they are known.

    ``own`` is the score on the held-out share of ``x``, ``other`` the score on all of ``y``; ``ratio`` is
    ``other / own``, null where ``own`` is 0. Accuracy for categorical targets, squared error for the others.
    """
    split = holdout_split(x, share, seed)
    columns = list(roles.columns)
    train, held = split.where(~F.col("is_test")), split.where("is_test")
    by_moments = [t for t in columns if not roles.is_categorical(t)] if models[1] in SOLVERS else []
    by_trees = {m: [t for t in columns if models[0 if roles.is_categorical(t) else 1] == m] for m in TREES}
    by_fit = _by_fit(roles, models)
    parts = []
    shift = column_means(x.df, columns) if by_moments else None
    if by_moments:
        sums = product_sums(split, columns, ["is_test"], shift)
        parts.append(linear_utility(sums, product_sums(y, columns, (), shift), roles, by_moments, shift, (), models[1]))
    for name, grown in by_trees.items():
        if grown:
            model = fit_trees(train, roles, grown, rule=tree_rule(name, **options))
            scored = tree_scores(held, y, model, roles, x.n)
            parts.append(utility_rows(scored, (), F.col("target").isin(*roles.categorical) if roles.categorical else F.lit(False)))
    if by_fit:
        rows = held.select(F.lit(True).alias("_own"), *map(q, columns)).unionByName(y.select(F.lit(False).alias("_own"), *map(q, columns)))
        cells = []
        known = fit_for_utility(x, roles, models, share, seed, shift, **options) if fitted is None else fitted
        for k, (target, model) in enumerate(known.items()):
            rows = model.predict(rows).withColumnRenamed("prediction", f"_pred{k}")
            score = accuracy if roles.is_categorical(target) else mse
            of = lambda own: score(F.when(F.col("_own") == own, q(target)), F.col(f"_pred{k}"))  # noqa: B023, E731
            cells.append(F.struct(F.lit(target).alias("target"), of(True).alias("own"), of(False).alias("other")))
        wide = rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
        better = F.col("target").isin(*roles.categorical) if roles.categorical else F.lit(False)
        parts.append(utility_rows(wide, (), better))
    return reduce(DataFrame.unionByName, parts)


def utility_both_directions(
    a: Indexed, b: Indexed, roles: Roles, models: tuple[str, str] = ("tree", "linear"), fitted: dict[str, Fitted] | None = None, **options
) -> DataFrame:
    """Rows of both directions, named by what was trained and what was scored. ``fitted`` are the first table's models if known."""
    forth, back = run_parallel(
        [
            lambda: utility_one_direction(a, b.df, roles, models, fitted=fitted, **options),
            lambda: utility_one_direction(b, a.df, roles, models, **options),
        ]
    )
    return forth.select(F.lit("a").alias("train_side"), F.lit("b").alias("test_side"), "*").unionByName(
        back.select(F.lit("b").alias("train_side"), F.lit("a").alias("test_side"), "*")
    )


def cross_aggregate(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys…, target, cc_reference, cc_ratio)``.

    ``cc_reference`` divides the mean of (ratio, own, other) trained on a by that trained on b, as published;
    ``cc_ratio`` divides the ratios only.
    """
    triple = (F.col("ratio") + F.col("own") + F.col("other")) / 3
    of = lambda side, v: F.max(F.when(F.col("train_side") == side, v))
    return rows.groupBy(*keys, "target").agg(
        F.try_divide(of("a", triple), of("b", triple)).alias("cc_reference"),
        F.try_divide(of("a", F.col("ratio")), of("b", F.col("ratio"))).alias("cc_ratio"),
    )


def utility_ratio_legacy(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One value per key: the ratio of ratios of the table's last column."""
    return cross_aggregate(rows.where(F.col("target") == columns[-1]), keys).select(
        *keys, F.col("cc_ratio").alias("cross")
    )


def ratio_inf_to_zero_mean(rows: DataFrame, keys: Sequence[str] = ("train_side",)) -> DataFrame:
    """Mean ratio over the targets; a division by zero counts as 0."""
    finite = F.when(F.col("ratio").isNull() | F.col("ratio").isin(float("inf"), float("-inf")), 0.0).otherwise(F.col("ratio"))
    return rows.groupBy(*keys).agg(F.avg(finite).alias("mean_ratio"))
