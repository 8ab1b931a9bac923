"""Fitted models behind one small interface: ``predict`` adds a ``prediction`` column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..roles import Roles
from .bayes import gaussian_nb_all_targets
from .clean import q
from .linear import SOLVERS, bayesian_ridge, column_means, least_squares, prediction, product_sums, unpack
from .logistic import logistic_all_targets
from .neighbors import NearestNeighbours
from .trees import Rule, add_prediction, fit_trees


@dataclass(frozen=True)
class Fitted:
    target: str
    features: tuple[str, ...]
    predict: Callable[[DataFrame], DataFrame]
    model: object = None


def assemble(df: DataFrame, features: Sequence[str], out: str = "_x") -> DataFrame:
    # ml parameters cannot address names with '.', so the parts get plain names first
    parts = {f"_f{i}": q(f) for i, f in enumerate(features)}
    wide = df.select("*", *[c.alias(n) for n, c in parts.items()])
    return VectorAssembler(inputCols=list(parts), outputCol=out).transform(wide).drop(*parts)


def _ml(estimator, df: DataFrame, target: str, features: Sequence[str], prepare=None) -> Fitted:
    prepare = prepare or (lambda d: assemble(d, features))
    model = estimator.fit(prepare(df).select(q(target).alias("_label"), "_x"))
    drop = ["_x", "rawPrediction", "probability"]
    return Fitted(
        target,
        tuple(features),
        lambda d: model.transform(prepare(d)).drop(*drop),
        model=model,
    )


_COLUMNS = dict(featuresCol="_x", labelCol="_label")


def tree_rule(name: str, *, max_depth=None, min_leaf=1, trees=100, seed=42, draw=(), **_) -> Rule:
    return Rule(max_depth, min_leaf, trees if name == "forest" else 0, seed, name == "forest", tuple(draw))


def fit_exact_trees(df: DataFrame, roles: Roles, targets: Sequence[str], name: str, **options) -> dict[str, Fitted]:
    """Trees (or forests) of all targets from one job."""
    grown = fit_trees(df, roles, targets, rule=tree_rule(name, **options))
    one = lambda t, m: Fitted(t, tuple(roles.features(t)), lambda d: add_prediction(d, m), model=m)
    return {t: one(t, grown.only(t)) for t in targets}


def _one_tree(name: str):
    def fit(df, target, features, classifier, **options):
        columns = (*features, target)
        roles = Roles(columns, tuple(c for c in columns if c != target or not classifier))
        return fit_exact_trees(df, roles, [target], name, **options)[target]

    return fit


def _against_rest(single, df: DataFrame, target: str):
    """One model per class, fitted side by side; two classes need only one."""
    classes = int(df.agg(F.max(q(target))).first()[0]) + 1
    return single if classes <= 2 else C.OneVsRest(classifier=single, parallelism=min(classes, 8), **_COLUMNS)


def fit_logistic(df, target, features, classifier, *, strength=1.0, **_):
    """L2 with weight ``1/strength`` on the sum of losses, the intercept included, one class against the rest."""
    return _logistic(df, [*features, target], [target], strength)[target]


def _logistic(df, columns, targets, strength=1.0) -> dict[str, Fitted]:
    models = logistic_all_targets(df, columns, targets, strength)
    return {t: Fitted(t, m.features, m.predict, model=m) for t, m in models.items()}


def fit_svm(df, target, features, classifier, *, components=64, strength=1.0, seed=42, max_iter=50, tol=1e-3, **_):
    """RBF machine approximated by random Fourier features (Rahimi and Recht 2007).

    The kernel width is 1 / (features × variance of all feature cells). Classes are separated one against the
    rest by hinge loss; continuous targets use the Huber loss.
    """
    moments = df.agg(
        *[F.sum(q(f)).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.sum(q(f) * q(f)).alias(f"ss{i}") for i, f in enumerate(features)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    k = len(features)
    cells = moments["n"] * k
    mean = sum(moments[f"s{i}"] for i in range(k)) / cells
    var = sum(moments[f"ss{i}"] for i in range(k)) / cells - mean * mean
    gamma = 1.0 / (k * var) if var > 0 else 1.0
    draw = np.random.default_rng(seed)
    weights = draw.normal(scale=np.sqrt(2 * gamma), size=(components, k))
    phase = draw.uniform(0, 2 * np.pi, size=components)
    scale = float(np.sqrt(2.0 / components))

    def lifted(columns: Sequence[pd.Series]) -> np.ndarray:
        return np.cos(np.column_stack([c.to_numpy(dtype=float) for c in columns]) @ weights.T + phase) * scale

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lift(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(lifted(columns)))

    cells = [F.when(q(f).isNull(), F.raise_error(F.lit(f"null cell in {f}")).cast("double")).otherwise(q(f).cast("double")) for f in features]
    prepare = lambda d: d.withColumn("_x", array_to_vector(lift(*cells)))
    reg = 1.0 / (strength * max(moments["n"], 1))
    if classifier:
        single = C.LinearSVC(regParam=reg, standardization=False, maxIter=max_iter, tol=tol, **_COLUMNS)
        estimator = _against_rest(single, df, target)
    else:
        estimator = R.LinearRegression(loss="huber", regParam=reg, standardization=False, maxIter=max_iter, tol=tol, **_COLUMNS)
    model = _ml(estimator, df, target, features, prepare).model
    parts = getattr(model, "models", [model])
    slopes, starts = np.array([m.coefficients.toArray() for m in parts]), np.array([m.intercept for m in parts])

    several = len(parts) > 1

    @F.pandas_udf(T.DoubleType())
    def predicted(*columns: pd.Series) -> pd.Series:
        score = lifted(columns) @ slopes.T + starts
        if not classifier:
            return pd.Series(score[:, 0])
        return pd.Series((score.argmax(axis=1) if several else score[:, 0] > 0).astype(float))

    return Fitted(target, tuple(features), lambda d: d.withColumn("prediction", predicted(*cells)), model=model)


def fit_by_moments(df: DataFrame, columns: Sequence[str], targets: Sequence[str], solve, shift: Sequence[float] | None = None) -> dict[str, Fitted]:
    """Linear models of all targets on the other columns from one table of moments."""
    columns = list(columns)
    shift = column_means(df, columns) if shift is None else list(shift)
    row = product_sums(df, columns, (), shift).first()
    mean, cov = unpack(row["n"], row["s"], row["p"], shift)
    out = {}
    for target in targets:
        t = columns.index(target)
        features, rest = tuple(c for c in columns if c != target), np.delete(mean, t)
        coef = solve(cov, t, row["n"])
        formula = prediction(dict(zip(features, coef)), mean[t] - coef @ rest)
        out[target] = Fitted(target, features, lambda d, formula=formula: d.withColumn("prediction", formula), model=coef)
    return out


def _fit_from_moments(solve):
    return lambda df, target, features, classifier=False, **_: fit_by_moments(df, [*features, target], [target], solve)[target]


def fit_gaussian_nb(df, target, features, classifier=True, **_):
    model = gaussian_nb_all_targets(df, [*features, target], [target])[target]
    return Fitted(target, tuple(features), model.predict, model=model)


def fit_knn(df, target, features, classifier, *, k=5, **_):
    model = NearestNeighbours(df, target, tuple(features), classifier, k)
    return Fitted(target, tuple(features), model.predict, model=model)


FITTERS: dict[str, Callable[..., Fitted]] = {
    "tree": _one_tree("tree"),
    "forest": _one_tree("forest"),
    "knn": fit_knn,
    "svm": fit_svm,
    "logistic": fit_logistic,
    "gaussian_nb": fit_gaussian_nb,
    "linear": _fit_from_moments(least_squares),
    "bayesian_ridge": _fit_from_moments(bayesian_ridge),
}

#: Models grown by ``trees``, all targets and repetitions in one job.
TREES = ("tree", "forest")

# Classifier and regressor behind each method name of the reports.
METHODS: dict[str, tuple[str, str]] = {
    "dt": ("tree", "linear"),
    "knn": ("knn", "knn"),
    "lm": ("logistic", "linear"),
    "nb": ("gaussian_nb", "bayesian_ridge"),
    "rf": ("forest", "forest"),
    "svm": ("svm", "svm"),
}


def run_parallel(tasks: Sequence[Callable[[], object]], width: int = 8) -> list:
    """Submit independent Spark jobs from a bounded driver pool."""
    if len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPool(min(width, len(tasks))) as pool:
        return pool.map(lambda t: t(), tasks, chunksize=1)


def fit_all_targets(
    df: DataFrame, roles, models: tuple[str, str], targets: Sequence[str] | None = None, shift: Sequence[float] | None = None, **options
) -> dict[str, Fitted]:
    """One model per target; the other columns are its features. ``shift``: the columns' means about, if no cell is known to be null."""
    chosen = list(targets or roles.columns)
    shared: dict[str, Fitted] = {}
    if models[0] == "gaussian_nb" and (classes := [t for t in chosen if roles.is_categorical(t)]):
        for t, m in gaussian_nb_all_targets(df, list(roles.columns), classes, shift).items():
            shared[t] = Fitted(t, m.features, m.predict, model=m)
    if models[0] == "logistic" and (classes := [t for t in chosen if roles.is_categorical(t)]):
        shared |= _logistic(df, list(roles.columns), classes, options.get("strength", 1.0))
    for name in TREES:
        if grown := [t for t in chosen if models[0 if roles.is_categorical(t) else 1] == name]:
            shared |= fit_exact_trees(df, roles, grown, name, **options)

    if models[1] in SOLVERS and (numbers := [t for t in chosen if not roles.is_categorical(t)]):
        shared |= fit_by_moments(df, roles.columns, numbers, SOLVERS[models[1]], shift)

    def one(t: str) -> Fitted:
        if t in shared:
            return shared[t]
        classifier = roles.is_categorical(t)
        return FITTERS[models[0] if classifier else models[1]](df, t, roles.features(t), classifier)

    return dict(zip(chosen, run_parallel([lambda t=t: one(t) for t in chosen])))
