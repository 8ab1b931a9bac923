"""Linear models of every column on all others, from one table of moments.

One aggregate gives count, means and covariances per group (side, split, run, repetition …). Every regression,
its expected permutation importance and its error on any other group follow from those few numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import q

WIDE_AGGREGATE_COLUMNS = 12  # beyond it the product sums exceed one code-generated aggregate


def column_means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Means of the columns; a null cell is an error, as sums that skip it would give a wrong model."""
    row = df.agg(*[F.avg(q(c)) for c in columns], *[F.count_if(q(c).isNull()) for c in columns]).first()
    missing = [c for c, n in zip(columns, row[len(columns) :]) if n]
    if missing:
        raise ValueError(f"null cells in {missing}: impute or filter them first")
    return [float(v or 0.0) for v in row[: len(columns)]]


def centred(column: str, mean: float) -> str:
    """SQL text of a column minus its mean; one text instead of many small calls keeps planning short."""
    return f"(`{column.replace('`', '``')}` - {float(mean)!r}D)"


def product_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), shift: Sequence[float] | None = None) -> DataFrame:
    """Rows ``(by…, n, s, p)``: count, sums and upper-triangle product sums around ``shift``."""
    shift = list(shift if shift is not None else column_means(df, columns))
    if len(columns) > WIDE_AGGREGATE_COLUMNS:
        return _product_sums_batched(df, columns, by, shift)
    x = [centred(c, m) for c, m in zip(columns, shift)]
    products = ", ".join(f"sum({x[i]} * {x[j]})" for i in range(len(x)) for j in range(i, len(x)))
    sums = ", ".join(f"sum({c})" for c in x)
    return df.groupBy(*by).agg(F.expr("count(1) AS n"), F.expr(f"array({sums}) AS s"), F.expr(f"array({products}) AS p"))


def _product_sums_batched(df: DataFrame, columns: Sequence[str], by: Sequence[str], shift: Sequence[float]) -> DataFrame:
    """Wide tables: each task keeps one product matrix per group, then the matrices are added up."""
    by, shift = list(by), np.asarray(shift)
    plain = [f"_{i}" for i in range(len(columns))]  # batch functions cannot address names with dots
    upper = np.triu_indices(len(columns))
    cells = T.StructType(
        [f for f in df.select(*by).schema.fields]
        + [T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))]
    )

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, part in groups:
                x = part[plain].to_numpy(dtype=float) - shift
                v = np.concatenate([x.sum(axis=0), (x.T @ x)[upper]])
                held = total.setdefault(key if isinstance(key, tuple) else (key,), [0, 0.0])
                held[0] += len(x)
                held[1] = held[1] + v
        rows = [(*k, n, v) for k, (n, v) in total.items()]
        yield pd.DataFrame(rows, columns=[*by, "n", "v"])

    parts = df.select(*by, *[q(c).alias(p) for c, p in zip(columns, plain)]).mapInPandas(partial, cells)
    p = len(columns)
    summed = (
        parts.select(*by, "n", F.posexplode("v").alias("i", "x"))
        .groupBy(*by, "i")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        .groupBy(*by)
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    )
    values = F.col("v.x")
    return summed.select(*by, "n", F.slice(values, 1, p).alias("s"), F.slice(values, p + 1, p * (p + 1) // 2).alias("p"))


def subtract_sums(total: DataFrame, held_out: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of the complement: ``total`` minus each group of ``held_out`` with the same ``keys``."""
    groups = [c for c in held_out.columns if c not in ("n", "s", "p")]
    renamed = total.select(*keys, F.col("n").alias("tn"), F.col("s").alias("ts"), F.col("p").alias("tp"))
    if keys:
        both = held_out.join(renamed, list(keys))
    else:  # one row without keys: its few numbers become literals
        row = renamed.first()
        array = lambda v: F.array(*[F.lit(x) for x in v])
        both = held_out.withColumns({"tn": F.lit(row["tn"]), "ts": array(row["ts"]), "tp": array(row["tp"])})
    minus = lambda t, h: F.zip_with(t, h, lambda x, y: x - y).alias(h)
    return both.select(*groups, (F.col("tn") - F.col("n")).alias("n"), minus("ts", "s"), minus("tp", "p"))


def unpack(n: float, s: Sequence[float], p: Sequence[float], shift: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and population covariance matrix."""
    s = np.asarray(s, dtype=float)
    k = len(s)
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = p
    full = full + np.triu(full, 1).T
    centre = s / n
    return centre + np.asarray(shift), full / n - np.outer(centre, centre)


def least_squares(cov: np.ndarray, t: int, n: float) -> np.ndarray:
    """Coefficients of column ``t`` on all others; constant columns get 0."""
    rest = np.delete(np.arange(len(cov)), t)
    scale = np.sqrt(np.maximum(np.diag(cov)[rest], 0))
    safe = np.where(scale > 0, scale, 1.0)
    corr = cov[np.ix_(rest, rest)] / np.outer(safe, safe)
    rhs = np.where(scale > 0, cov[rest, t] / safe, 0.0)
    try:
        if np.all(scale > 0) and np.linalg.cond(corr) < 1e10:
            return np.linalg.solve(corr, rhs) / safe
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(corr, rcond=1e-10, hermitian=True) @ rhs / safe


def bayesian_ridge(cov: np.ndarray, t: int, n: float, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """Evidence maximisation on the product matrix (MacKay 1992, Tipping 2001), Gamma priors ``prior``."""
    rest = np.delete(np.arange(len(cov)), t)
    values, vectors = np.linalg.eigh(cov[np.ix_(rest, rest)] * n)
    values = np.maximum(values, 0.0)
    along = vectors.T @ (cov[rest, t] * n)
    total = cov[t, t] * n
    noise, weight = 1.0 / (cov[t, t] + np.finfo(float).eps), 1.0
    coef = np.zeros(len(rest))

    def posterior(noise: float, weight: float) -> tuple[np.ndarray, float]:
        z = along / (values + weight / noise)
        return vectors @ z, max(total - 2 * z @ along + (values * z * z).sum(), 0.0)

    for _ in range(rounds):
        before = coef
        coef, sse = posterior(noise, weight)
        known = (noise * values / (weight + noise * values)).sum()
        weight = (known + 2 * prior) / (coef @ coef + 2 * prior)
        noise = (n - known + 2 * prior) / (sse + 2 * prior)
        if np.abs(coef - before).sum() < tol:
            break
    return posterior(noise, weight)[0]


SOLVERS = {"linear": least_squares, "bayesian_ridge": bayesian_ridge}


def _group_fields(sums: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [sums.schema[c] for c in by]


def fit_from_sums(
    sums: DataFrame,
    columns: Sequence[str],
    targets: Sequence[str],
    shift: Sequence[float],
    by: Sequence[str] = (),
    solver: str = "linear",
) -> DataFrame:
    """Rows ``(by…, target, feature, pos, coef, intercept, r2, score)``.

    ``score`` is the expected drop of R² on the fitted rows when the feature is permuted:
    ``(2 b² var(x) + 2 b cov(e, x)) / var(y)``, the limit of the mean over shuffles.
    """
    columns, targets, shift, by = list(columns), list(targets), list(shift), list(by)
    solve = SOLVERS[solver]
    schema = T.StructType(
        _group_fields(sums, by)
        + [T.StructField("target", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("pos", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("coef", "intercept", "r2", "score")]
    )

    def fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for g in pdf.to_dict("records"):
                mean, cov = unpack(g["n"], g["s"], g["p"], shift)
                for target in targets:
                    t = columns.index(target)
                    coef = solve(cov, t, g["n"])
                    b = np.insert(coef, t, -1.0)
                    residual = -(cov @ b)
                    spread = cov[t, t]
                    constant = spread <= 0
                    intercept = mean[t] - coef @ np.delete(mean, t)
                    r2 = (1.0 if constant else 1 - (b @ cov @ b) / spread)
                    for j, feature in enumerate(columns):
                        if j == t:
                            continue
                        drop = 0.0 if constant else (2 * b[j] ** 2 * cov[j, j] + 2 * b[j] * residual[j]) / spread
                        rows.append((*[g[k] for k in by], target, feature, j, b[j], intercept, r2, drop))
            yield pd.DataFrame(rows, columns=schema.names)

    return sums.mapInPandas(fit, schema)


def errors_from_sums(
    trained: DataFrame,
    scored: DataFrame,
    columns: Sequence[str],
    targets: Sequence[str],
    shift: Sequence[float],
    keys: Sequence[str],
    solver: str = "linear",
) -> DataFrame:
    """Rows ``(keys…, target, mse)``: models of each group of ``trained`` scored on the group of ``scored``
    with the same keys. The error is a quadratic form of the scored group's moments, so no row is read again."""
    columns, targets, shift, keys = list(columns), list(targets), list(shift), list(keys)
    solve = SOLVERS[solver]
    both = trained.join(
        scored.select(*keys, F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("p").alias("p2")), keys
    )
    schema = T.StructType(
        _group_fields(both, keys) + [T.StructField("target", T.StringType()), T.StructField("mse", T.DoubleType())]
    )

    def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for g in pdf.to_dict("records"):
                mean, cov = unpack(g["n"], g["s"], g["p"], shift)
                mean2, cov2 = unpack(g["n2"], g["s2"], g["p2"], shift)
                for target in targets:
                    t = columns.index(target)
                    b = np.insert(solve(cov, t, g["n"]), t, -1.0)
                    bias = (mean2 - mean) @ b
                    rows.append((*[g[k] for k in keys], target, max(b @ cov2 @ b, 0.0) + bias * bias))
            yield pd.DataFrame(rows, columns=schema.names)

    return both.mapInPandas(score, schema)


def linear_per_target(df: DataFrame, columns: Sequence[str], targets: Sequence[str], by: Sequence[str] = (), solver: str = "linear") -> DataFrame:
    """All targets from one pass over the table."""
    shift = column_means(df, columns)
    return fit_from_sums(product_sums(df, columns, by, shift), columns, targets, shift, by, solver)


def prediction(coefs: dict[str, float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, b in coefs.items():
        out = out + q(c) * F.lit(float(b))
    return out
