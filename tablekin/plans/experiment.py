"""Experiments: compare two tables, shuffle trials, and sweeps over methods, generators and repetitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import q
from ..operators.encode import apply_dictionary, fit_dictionary
from ..operators.estimators import METHODS, TREES, run_parallel, tree_rule
from ..operators.importance import HELD_OUT as IMPORTANCE_HELD_OUT
from ..operators.importance import importance, importance_by_moments, importance_by_trees, importance_mean
from ..operators.index import (
    Indexed, column_shuffle_sweep, holdout_split, permuted, replicates, sample_columns, shuffle_columns, sweep_seed, test_size,
)
from ..operators.linear import SOLVERS, column_means, fit_from_sums, product_sums, subtract_sums
from ..operators.permute import permuted_sums
from ..operators.rank import compare_importances, long_scores, pair_scores, score_aggregate, score_ranks
from ..operators.rotate import ALL, TEST
from ..operators.trees import fit_trees
from ..operators.utility import (
    HELD_OUT, cross_aggregate, fit_for_utility, linear_utility, tree_scores, tree_scores_by, utility_both_directions, utility_one_direction, utility_rows,
)
from ..roles import Roles
from ..session import materialize


def encode_pair(a: Indexed, b: Indexed, roles: Roles) -> tuple[Indexed, Indexed]:
    """Both tables numeric: categories coded by the first table's dictionary."""
    if not roles.categorical:
        return a, b
    dictionary = fit_dictionary(a.df, roles.categorical)
    code = lambda t: Indexed(
        materialize(apply_dictionary(t.df.select("idx", *map(q, roles.columns)), dictionary, roles.categorical), "encoded"), t.n
    )
    return code(a), code(b)


def mean_importances(table: Indexed, roles: Roles, models, reps: int, repeats: int, seed: int = 0, **options) -> DataFrame:
    return importance_mean(importance(table, roles, models, reps, repeats, seed, **options))


def compare_datasets(
    a: Indexed,
    b: Indexed,
    roles: Roles,
    models: tuple[str, str] | str = ("tree", "tree"),
    reps: int = 10,
    repeats: int = 15,
    seed: int = 0,
    cross_models: tuple[str, str] = ("tree", "linear"),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Scores ``(target, metric, value)`` and cross rows of two tables with the same columns.

    The cross part always uses ``cross_models``, whatever model ranks the features.
    """
    a, b = encode_pair(a, b, roles)
    first, second, cross = run_parallel(
        [
            lambda: mean_importances(a, roles, models, reps, repeats, seed, **options),
            lambda: mean_importances(b, roles, models, reps, repeats, seed, **options),
            lambda: utility_both_directions(a, b, roles, cross_models, **options),
        ]
    )
    return compare_importances(first, second), cross


def summary(scores: DataFrame, cross: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``(keys…, metric, value)``: the mean of each measure, and ``cross`` as the mean of ``cc_reference``."""
    cc = cross_aggregate(cross, keys).groupBy(*keys).agg(F.avg("cc_reference").alias("value"))
    return score_aggregate(scores, keys).unionByName(cc.withColumn("metric", F.lit("cross")))


def shuffle_trial(
    table: Indexed,
    roles: Roles,
    models: tuple[str, str] | str = ("tree", "linear"),
    max_columns: int = 7,
    reps: int = 20,
    inner_reps: int | None = None,
    repeats: int = 15,
    cross_models: tuple[str, str] = ("tree", "linear"),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Compare the table with copies in which 0 … ``max_columns`` columns are shuffled, ``reps`` times each.

    Scores and cross rows are tagged ``(run, rep)``; every repetition is kept. Tables of continuous columns with
    linear models take the whole trial in a few passes; trees of all copies are grown in one job; other models fit table by table.
    """
    if isinstance(models, str):
        models = METHODS[models]
    inner = reps if inner_reps is None else inner_reps
    if not roles.categorical and models[1] in SOLVERS and cross_models[1] in SOLVERS:
        return _linear_trial(table, roles, models[1], cross_models[1], max_columns, reps, inner)
    base, _ = encode_pair(table, table, roles)
    kinds = {m[0 if roles.is_categorical(c) else 1] for m in (models, cross_models) for c in roles.columns}
    if kinds <= {*TREES, *SOLVERS}:
        return _grouped_trial(base, roles, models, cross_models, max_columns, reps, inner, **options)
    original = materialize(mean_importances(base, roles, models, inner, repeats, **options), "importance")
    fitted = fit_for_utility(base, roles, cross_models, **options)  # the original's models score every copy
    tag = lambda d, tags: materialize(_with_tags(d, tags).select("run", "rep", *d.columns), "trial")

    def unmoved() -> tuple[DataFrame, DataFrame]:
        """Run 0 moves nothing: its copies are the original, compared with itself once for all repetitions."""
        own = materialize(utility_one_direction(base, base.df, roles, cross_models, fitted=fitted, **options), "own")
        tags = [(0, r) for r in range(reps)]
        return tag(compare_importances(original, original), tags), tag(_name_sides(own, own), tags)

    def one(run: int, rep: int) -> tuple[DataFrame, DataFrame]:
        copy = shuffle_columns(base, sample_columns(roles.columns, run, rep), sweep_seed(run, rep))
        copy = Indexed(materialize(copy.df, "shuffled"), copy.n)
        scores = compare_importances(original, mean_importances(copy, roles, models, inner, repeats, **options))
        cross = utility_both_directions(base, copy, roles, cross_models, fitted, **options)
        return tag(scores, [(run, rep)]), tag(cross, [(run, rep)])

    runs = [unmoved, *[lambda k=k, r=r: one(k, r) for k in range(1, max_columns + 1) for r in range(reps)]]
    scores, cross = zip(*run_parallel(runs, 4))
    return reduce(DataFrame.unionByName, scores), reduce(DataFrame.unionByName, cross)


def _grouped_trial(table: Indexed, roles: Roles, models, cross_models, max_columns: int, reps: int, inner: int, **options):
    """Trees, forests and linear models of all shuffled copies at once, told apart by ``(run, rep)``; the copies are written once.

    Run 0 moves nothing, so one of its copies stands for the others and for the original, whose rows and draws are the same.
    """
    columns, keys = list(roles.columns), ["run", "rep"]
    base = Indexed(table.df.select("idx", *map(q, columns)), table.n)
    sweep = Indexed(materialize(column_shuffle_sweep(base, columns, max_columns, reps), "sweep"), table.n)
    unmoved = [(0, r) for r in range(reps)]
    some = Indexed(sweep.df.where("run > 0 OR rep = 0"), table.n)
    b = materialize(importance_mean(_grouped_importance(some, roles, models, inner, keys, **options), keys), "importance")
    a = b.where("run = 0").drop(*keys)
    b = b.where("run > 0").unionByName(_with_tags(a, unmoved))
    scores = compare_importances(a.join(b.select(*keys, "target", "feature"), ["target", "feature"]), b, keys)
    by_moments = [t for t in columns if _model_of(cross_models, roles, t) in SOLVERS]
    parts = []
    if by_moments:
        parts.append(_linear_cross(base, sweep, roles, by_moments, cross_models[1], keys))
    for name in TREES:
        if grown := [t for t in columns if _model_of(cross_models, roles, t) == name]:
            moved = [(k, r) for k in range(1, max_columns + 1) for r in range(reps)]
            parts.append(_tree_cross(base, some, roles, grown, name, moved, unmoved, keys, **options))
    return scores, materialize(reduce(DataFrame.unionByName, parts), "cross")


def _model_of(models: tuple[str, str], roles: Roles, target: str) -> str:
    return models[0 if roles.is_categorical(target) else 1]


def _with_tags(rows: DataFrame, tags: Sequence[tuple[int, int]]) -> DataFrame:
    """Every row once for each copy."""
    cells = F.array(*[F.struct(F.lit(k).alias("run"), F.lit(r).alias("rep")) for k, r in tags])
    return rows.select("*", F.inline(cells))


def _grouped_importance(sweep: Indexed, roles: Roles, models, inner: int, keys: Sequence[str], **options) -> DataFrame:
    parts = []
    for name in (*SOLVERS, *TREES):
        if not (chosen := [t for t in roles.columns if _model_of(models, roles, t) == name]):
            continue
        if name in SOLVERS:
            rows = importance_by_moments(sweep.df, sweep.n, roles, chosen, name, inner, 0, keys, "inner")
        else:
            kept = replicates(sweep, inner, IMPORTANCE_HELD_OUT, 0, "inner").where(~F.col("is_test"))
            rows = importance_by_trees(kept, roles, chosen, name, [*keys, "inner"], draw=["inner"], **options)
        parts.append(rows.select(*keys, "target", "feature", "pos", "inner", "score"))
    return reduce(DataFrame.unionByName, parts)


def _name_sides(forth: DataFrame, back: DataFrame) -> DataFrame:
    name = lambda d, x, y: d.select(F.lit(x).alias("train_side"), F.lit(y).alias("test_side"), "*")
    return name(forth, "a", "b").unionByName(name(back, "b", "a"))


def _linear_cross(base: Indexed, sweep: Indexed, roles: Roles, targets: Sequence[str], solver: str, keys: Sequence[str]) -> DataFrame:
    columns = list(roles.columns)
    shift = column_means(base.df, columns)
    is_test = (permuted(F.col("idx"), 42, base.n) < test_size(base.n, HELD_OUT)).alias("is_test")
    by_split = lambda d, k: materialize(product_sums(d.select(*k, is_test, *map(q, columns)), columns, [*k, "is_test"], shift), "sums")
    of_a, of_b = by_split(base.df, []), by_split(sweep.df, keys)
    tags = of_b.select(*keys).distinct()
    forth = linear_utility(_attach(tags, of_a), _add_sums(of_b, keys), roles, targets, shift, keys, solver)
    back = linear_utility(of_b, _attach(tags, _add_sums(of_a, [])), roles, targets, shift, keys, solver)
    return _name_sides(forth, back)


def _tree_cross(base: Indexed, some: Indexed, roles: Roles, targets: Sequence[str], name: str, moved, unmoved, keys: Sequence[str], **options) -> DataFrame:
    """Cross rows of trees. ``some`` holds the ``moved`` copies and one that is the original, for all ``unmoved`` ones: trained on
    that one, both directions are the original's own."""
    rule = tree_rule(name, **options)
    part = lambda d, flag: d.where(F.col("is_test") == flag).drop("is_test")
    on_a = fit_trees(part(holdout_split(base, HELD_OUT), False), roles, targets, rule=rule)
    held = part(holdout_split(Indexed(some.df.where("run = 0"), base.n), HELD_OUT), True)
    # the original's trees meet the rows held out and the rows of all copies under one key
    rows = some.df.withColumn("_own", F.lit(False)).unionByName(held.withColumn("_own", F.lit(True)))
    scored = materialize(tree_scores_by(rows, on_a, roles, base.n * (len(moved) + 2), [*keys, "_own"]), "scores")
    own = scored.where("_own").select("target", F.col("score").alias("own"))
    forth = scored.where("NOT _own").select(*keys, "target", F.col("score").alias("other")).join(F.broadcast(own), "target")
    same = _with_tags(forth.where("run = 0").drop(*keys), unmoved)
    forth = forth.where("run > 0").unionByName(same)
    back = same
    if moved:
        split = holdout_split(Indexed(some.df.where("run > 0"), base.n), HELD_OUT)
        on_b = fit_trees(part(split, False), roles, targets, keys, rule)
        back = back.unionByName(tree_scores(part(split, True), _with_tags(base.df, moved), on_b, roles, base.n, keys))
    better = F.col("target").isin(*roles.categorical) if roles.categorical else F.lit(False)
    return _name_sides(utility_rows(forth, keys, better), utility_rows(back, keys, better))


def _linear_trial(table: Indexed, roles: Roles, solver: str, cross_solver: str, max_columns: int, reps: int, inner: int):
    """One pass gives the sums of all copies and their parts; everything else follows from those, and no copy is made.

    Run 0 moves nothing, so its sums are the table's own.
    """
    columns, keys = list(roles.columns), ["run", "rep"]
    shift = column_means(table.df, columns)
    sums = materialize(permuted_sums(table, columns, max_columns, reps, inner, shift, HELD_OUT, IMPORTANCE_HELD_OUT), "sums")
    part = lambda p: sums.where(F.col("part") == p).drop("part")
    whole, test, held = part(ALL), part(TEST), sums.where("part >= 0").withColumnRenamed("part", "inner")
    fitted = fit_from_sums(subtract_sums(whole, held, keys), columns, columns, shift, [*keys, "inner"], solver)
    b = materialize(importance_mean(fitted.select(*keys, "target", "feature", "pos", "inner", "score"), keys), "importance")
    tags = whole.select(*keys)
    a = b.where("run = 0 AND rep = 0").drop(*keys)
    scores = compare_importances(a.join(b.select(*keys, "target", "feature"), ["target", "feature"]), b, keys)

    flag = lambda d, f: d.select(*keys, F.lit(f).alias("is_test"), "n", "s", "p")
    of_b = flag(subtract_sums(whole, test, keys), False).unionByName(flag(test, True))
    first = lambda d: d.where("run = 0 AND rep = 0").drop(*keys)
    forth = linear_utility(_attach(tags, first(of_b)), whole, roles, columns, shift, keys, cross_solver)
    back = linear_utility(of_b, _attach(tags, first(whole)), roles, columns, shift, keys, cross_solver)
    return scores, _name_sides(forth, back)


def _attach(tags: DataFrame, sums: DataFrame) -> DataFrame:
    """Give every tag the original's sums: at most two rows, attached as literals."""
    rows = sums.collect()
    cell = lambda r: F.struct(
        *[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(c) for c, v in r.asDict().items()]
    )
    return tags.select("*", F.inline(F.array(*[cell(r) for r in rows])))


def _add_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over both parts of a split."""
    part = lambda flag, c: F.max(F.when(F.col("is_test") == flag, F.col(c)))
    add = lambda c: F.zip_with(part(True, c), part(False, c), lambda x, y: x + y).alias(c)
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), add("s"), add("p"))


def last_repetition(rows: DataFrame) -> DataFrame:
    """The rows of the last repetition only, as published results hold them."""
    last = rows.agg(F.max("rep")).first()[0]
    return rows.where(F.col("rep") == F.lit(last))


def trial_mean(summaries: DataFrame, keys: Sequence[str] = ("run", "metric")) -> DataFrame:
    """Per run and metric: the mean over the repetitions, and all their values in order."""
    cell = F.struct("rep", "value")
    return summaries.groupBy(*keys).agg(
        F.avg("value").alias("value"), F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["value"]).alias("values")
    )


def method_sweep(table: Indexed, roles: Roles, methods: Sequence[str] = tuple(METHODS), **trial) -> DataFrame:
    """Trial summaries ``(method, run, rep, metric, value)`` of several methods."""

    def one(method: str) -> DataFrame:
        scores, cross = shuffle_trial(table, roles, METHODS[method], **trial)
        rows = summary(scores, cross, ["run", "rep"])
        return materialize(rows.select(F.lit(method).alias("method"), "run", "rep", "metric", "value"), "method")

    return reduce(DataFrame.unionByName, run_parallel([lambda m=m: one(m) for m in methods], 3))


def generator_sweep(real: Mapping[str, Indexed], synthetic: Mapping[tuple[str, str], Indexed], roles: Mapping[str, Roles], **options) -> DataFrame:
    """Rows ``(generator, dataset, metric, value)``: real tables against the tables each generator made of them."""

    def one(generator: str, dataset: str) -> DataFrame:
        scores, cross = compare_datasets(real[dataset], synthetic[generator, dataset], roles[dataset], **options)
        tags = [F.lit(generator).alias("generator"), F.lit(dataset).alias("dataset")]
        return materialize(summary(scores, cross).select(*tags, "metric", "value"), "generator")

    return reduce(DataFrame.unionByName, run_parallel([lambda k=k: one(*k) for k in synthetic], 4))


def repetition_sweep(table: Indexed, roles: Roles, repetitions: Sequence[int] = (5, 10, 15, 20, 25, 30, 35), **trial) -> DataFrame:
    """Trial summaries tagged ``n_reps``. A repetition does not depend on how many follow, so the longest trial
    is run once and the shorter ones are its first repetitions."""
    scores, cross = shuffle_trial(table, roles, reps=max(repetitions), **trial)
    rows = materialize(summary(scores, cross, ["run", "rep"]), "repetitions")
    counts = F.filter(F.array(*[F.lit(r) for r in repetitions]), lambda r: r > F.col("rep"))
    return rows.select(F.explode(counts).alias("n_reps"), "run", "rep", "metric", "value")


def multi_dataset_ratio(importances: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(metric, pair, target, value)`` for ordered pairs of datasets, with row and column means.

    ``importances`` holds mean importances with a ``dataset`` column. A null ``target`` is the mean over the
    targets, a null ``pair`` the mean over the pairs.
    """
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(f"{a}-{b}").alias("pair")) for a, b in pairs])
    tagged = importances.select("*", F.inline(cells))
    first = tagged.where(F.col("dataset") == F.col("a"))
    second = tagged.where(F.col("dataset") == F.col("b"))
    scores = long_scores(score_ranks(pair_scores(first, second, ["pair"]), ["pair"]), ["pair"])
    sets = [[F.col("metric"), *map(F.col, g)] for g in (["pair", "target"], ["pair"], ["target"], [])]
    return scores.groupingSets(sets, "metric", "pair", "target").agg(F.avg("value").alias("value"))
