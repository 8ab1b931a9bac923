"""Feature importance of every column for every target.

Result rows: ``(target, feature, pos, rep, score)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import Roles
from .bayes import NaiveBayes, permutation_drop
from .clean import q
from .estimators import METHODS, TREES, Fitted, fit_all_targets, run_parallel, tree_rule
from .index import Indexed, replicates, test_size, train_part
from .linear import SOLVERS, column_means, fit_from_sums, product_sums, subtract_sums
from .permute import permuted_pairs
from .trees import fit_trees, impurity_importance, leaf_values, shapley_sums

HELD_OUT = 0.05
REPEATS = 15


def importance_by_trees(rows: DataFrame, roles: Roles, targets: Sequence[str], name: str, keys: Sequence[str], **options) -> DataFrame:
    """Impurity importance ``(target, keys…, feature, pos, score)`` of the trees of every part that ``keys`` tell apart, in one job.

    The shares sum to 1, or are all 0 without a split.
    """
    return impurity_importance(fit_trees(rows, roles, targets, keys, tree_rule(name, **options)))


def permutation_importance(
    fitted: Sequence[Fitted], table: Indexed, roles: Roles, repeats: int = REPEATS, first_seed: int = 100
) -> list[tuple[str, str, float]]:
    """``(target, feature, score)``: score on the training rows minus the mean score with the feature permuted.

    The score is the accuracy or R². A row's partner under a permutation of the whole table carries all columns, so one
    permutation serves every feature. Each row is tagged
    with one variant per permuted column; every model scores the same variants, so all targets share one exchange and one pass.
    """
    columns = list(roles.columns)
    bayes = [f.model for f in fitted if isinstance(f.model, NaiveBayes)]
    out = [(r["target"], r["feature"], r["score"]) for r in permutation_drop(bayes, table, repeats, first_seed).collect()] if bayes else []
    others = [f for f in fitted if not isinstance(f.model, NaiveBayes)]
    if not others:
        return out
    pairs = permuted_pairs(table, columns, repeats, first_seed)
    variants = F.array(
        *[
            F.struct(F.lit(j).alias("_variant"), *[(q(f"_p_{c}") if i == j else q(c)).alias(c) for i, c in enumerate(columns)])
            for j in range(len(columns))
        ]
    )
    rows = pairs.select(F.inline(variants)).unionByName(table.df.select(F.lit(-1).alias("_variant"), *map(q, columns)))
    names = []
    for k, f in enumerate(others):
        rows = f.predict(rows).withColumnRenamed("prediction", f"_pred{k}")
        y, p = q(f.target), F.col(f"_pred{k}")
        value = F.avg((y == p).cast("double")) if roles.is_categorical(f.target) else 1 - F.try_divide(F.avg(F.pow(y - p, 2)), F.var_pop(y))
        names.append(value.alias(f"_s{k}"))
    scored = {r["_variant"]: r for r in rows.groupBy("_variant").agg(*names).collect()}
    for k, f in enumerate(others):
        base = scored[-1][f"_s{k}"]
        for feature in f.features:
            moved = scored[columns.index(feature)][f"_s{k}"]
            out.append((f.target, feature, 0.0 if base is None or moved is None else base - moved))
    return out


def importance_by_moments(
    df: DataFrame,
    n: int,
    roles: Roles,
    targets: Sequence[str],
    solver: str,
    reps: int,
    first_seed: int = 0,
    by: Sequence[str] = (),
    rep_name: str = "rep",
    shift: Sequence[float] | None = None,
    total: DataFrame | None = None,
) -> DataFrame:
    """All targets, groups and repetitions from one pass over the table and one over the rows held out.

    The sums of a training part are the sums of the table minus those of the few rows held out. ``total`` holds the
    sums of the table around ``shift`` if they are known already.
    """
    columns = list(roles.columns)
    shift = list(shift) if shift is not None else column_means(df, columns)
    total = product_sums(df, columns, by, shift) if total is None else total
    rows = Indexed(df.select("idx", *by, *map(q, columns)), n)
    held = replicates(rows, reps, HELD_OUT, first_seed, rep_name).where("is_test")
    sums = subtract_sums(total, product_sums(held, columns, [*by, rep_name], shift), by)
    fitted = fit_from_sums(sums, columns, targets, shift, [*by, rep_name], solver)
    return fitted.select(*by, "target", "feature", "pos", rep_name, "score")


def importance(
    table: Indexed,
    roles: Roles,
    models: tuple[str, str] | str = ("tree", "tree"),
    reps: int = 5,
    repeats: int = REPEATS,
    first_seed: int = 0,
    targets: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Importance rows of all targets: the classifier for categorical ones, the regressor for the others.

    Each repetition fits on its own 95 % of the rows. Trees give impurity importance, linear models the expected
    permutation importance in closed form, all others permutation importance. ``table`` is fully numeric.
    """
    if isinstance(models, str):
        models = METHODS[models]
    chosen = list(targets or roles.columns)
    spark = table.df.sparkSession
    by_moments = [t for t in chosen if not roles.is_categorical(t)] if models[1] in SOLVERS else []
    by_trees = {m: [t for t in chosen if models[0 if roles.is_categorical(t) else 1] == m] for m in TREES}
    by_fit = [t for t in chosen if t not in by_moments and not any(t in g for g in by_trees.values())]
    parts = []
    if by_moments:
        parts.append(importance_by_moments(table.df, table.n, roles, by_moments, models[1], reps, first_seed))
    for name, grown in by_trees.items():
        if grown:
            kept = replicates(table, reps, HELD_OUT, first_seed).where(~F.col("is_test"))
            rows = importance_by_trees(kept, roles, grown, name, ["rep"], draw=["rep"], **options)
            parts.append(rows.select("target", "feature", "pos", "rep", "score"))

    def one(rep: int) -> list[tuple]:
        part = train_part(table, HELD_OUT, first_seed + rep)
        fitted = list(fit_all_targets(part.df, roles, models, by_fit, **options).values())
        scores = permutation_importance(fitted, part, roles, repeats, 100 + 50 * rep)
        return [(t, f, roles.position(f), rep, s) for t, f, s in scores]

    if by_fit:
        rows = [r for rep in run_parallel([lambda r=r: one(r) for r in range(reps)], 4) for r in rep]
        parts.append(spark.createDataFrame(rows, "target string, feature string, pos int, rep int, score double"))
    return reduce(DataFrame.unionByName, parts)


def importance_mean(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the repetitions, to twelve digits, so that equal means tie whatever order they were added in."""
    return rows.groupBy(*keys, "target", "feature", "pos").agg(F.round(F.avg("score"), 12).alias("score"))


def importance_variance(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "target", "feature", "pos").agg(F.var_pop("score").alias("variance"))


def shap_by_class(table: Indexed, targets: Sequence[str], roles: Roles, reps: int = 1, share: float = 0.25, first_seed: int = 0, **options) -> DataFrame:
    """Rows ``(target, rep, feature, pos, code, score)``: mean signed path-dependent SHAP value (Lundberg et al. 2018).

    Trees of all targets and repetitions are grown on ``1 - share`` of the rows and kept as a table. A leaf is a box with a chance
    share for each side; blocks of rows meet the leaves and add up one number per feature and class. ``code`` is null for a
    continuous target.
    """
    rows = replicates(table, reps, share, first_seed).where(~F.col("is_test"))
    grown = fit_trees(rows, roles, targets, ["rep"], tree_rule("tree", **options))
    n = table.n - test_size(table.n, share)
    effects = shapley_sums(rows, grown, n, ["rep"])
    codes = leaf_values(grown).select(*grown.keys, "code").distinct()
    scored = effects.select(*grown.keys, "f", "code", (F.col("effect") / n).alias("score"))
    places = F.array(
        *[
            F.struct(F.lit(t).alias("_t"), F.lit(j).alias("f"), F.lit(f).alias("feature"), F.lit(roles.position(f)).alias("pos"))
            for t in targets
            for j, f in enumerate(roles.features(t))
        ]
    )
    grid = codes.select(*grown.keys, "code", F.inline(places)).where("target = _t").drop("_t")
    same = [F.col(f"g.{k}") == F.col(f"s.{k}") for k in (*grown.keys, "f")] + [F.col("g.code").eqNullSafe(F.col("s.code"))]
    joined = grid.alias("g").join(scored.alias("s"), same, "left")
    return joined.select("g.target", "g.rep", "g.feature", "g.pos", "g.code", F.coalesce("s.score", F.lit(0.0)).alias("score"))


def shap_mean_importance(table: Indexed, roles: Roles, reps: int = 5, first_seed: int = 0, targets: Sequence[str] | None = None, **options) -> DataFrame:
    """Importance rows by mean signed SHAP value, averaged over the classes of a categorical target."""
    rows = shap_by_class(table, list(targets or roles.columns), roles, reps, 0.25, first_seed, **options)
    return rows.groupBy("target", "feature", "pos", "rep").agg(F.avg("score").alias("score"))
