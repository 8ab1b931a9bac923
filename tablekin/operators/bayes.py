"""Gaussian naive Bayes for every categorical column, from grouped sums of one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import q
from .index import Indexed
from .linear import centred, column_means
from .permute import Partners, with_partners

EXPRESSION_TERMS = 32  # beyond it the generated method grows too large to be compiled well
VAR_SMOOTHING = 1e-9  # share of the largest feature variance that is added to every variance


@dataclass(frozen=True)
class NaiveBayes:
    """Class codes with their prior, means and variances per feature."""

    target: str
    features: tuple[str, ...]
    classes: tuple[float, ...]
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def constants(self) -> np.ndarray:
        return np.log(self.prior) - 0.5 * np.log(2 * pi * self.var).sum(axis=1)

    def term(self, c: int, i: int, x: Column) -> Column:
        d = x - F.lit(float(self.mean[c, i]))
        return d * d * F.lit(float(-0.5 / self.var[c, i]))

    def likelihood(self, c: int, column: Callable[[str], Column] = q) -> Column:
        out = F.lit(float(self.constants()[c]))
        for i, f in enumerate(self.features):
            out = out + self.term(c, i, column(f))
        return out

    def winner(self, scores: Sequence[Column]) -> Column:
        """Class with the highest score, the smaller code on a tie."""
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        cases = F.when(scores[0] == best, self.classes[0])
        for s, k in zip(scores[1:], self.classes[1:]):
            cases = cases.when(s == best, k)
        return cases

    def predict(self, df: DataFrame) -> DataFrame:
        """Few terms run as one code-generated expression, many as one Arrow batch function."""
        if len(self.classes) * len(self.features) <= EXPRESSION_TERMS:
            return df.withColumn("prediction", self.winner([self.likelihood(c) for c in range(len(self.classes))]))
        model = self

        @F.pandas_udf(T.DoubleType())
        def predicted(*columns: pd.Series) -> pd.Series:
            out, x = [np.zeros(0)], [c.to_numpy(dtype=float) for c in columns]
            for start in range(0, len(x[0]), model.chunk):
                part = slice(start, start + model.chunk)
                out.append(model.best(model.start() + sum(model.terms(i, v[part]) for i, v in enumerate(x))))
            return pd.Series(np.concatenate(out))

        return df.withColumn("prediction", predicted(*[q(f).cast("double") for f in self.features]))

    @property
    def chunk(self) -> int:
        return max(1, 200_000 // len(self.classes))

    def start(self) -> np.ndarray:
        return self.constants()[None, :]

    def terms(self, i: int, x: np.ndarray) -> np.ndarray:
        """Part of feature ``i`` in the score, rows × classes."""
        return (x[:, None] - self.mean[None, :, i]) ** 2 * (-0.5 / self.var[None, :, i])

    def best(self, scores: np.ndarray) -> np.ndarray:
        return np.asarray(self.classes)[np.argmax(scores, axis=1)]


def class_sums(df: DataFrame, columns: Sequence[str], targets: Sequence[str], by: Sequence[str] = (), shift: Sequence[float] = ()) -> DataFrame:
    """Rows ``(by…, target, code, n, s, ss)`` for all targets: one scan, partial sums before the shuffle."""
    tags = F.array(*[F.struct(F.lit(t).alias("target"), q(t).alias("code")) for t in targets])
    x = [f"_{i}" for i in range(len(columns))]
    return (
        df.select(*by, *[F.expr(f"{centred(c, m)} AS {v}") for v, c, m in zip(x, columns, shift)], F.inline(tags))
        .groupBy(*by, "target", "code")
        .agg(
            F.expr("count(1) AS n"),
            F.expr(f"array({', '.join(f'sum({v})' for v in x)}) AS s"),
            F.expr(f"array({', '.join(f'sum({v} * {v})' for v in x)}) AS ss"),
        )
    )


def gaussian_nb_all_targets(
    df: DataFrame, columns: Sequence[str], targets: Sequence[str], shift: Sequence[float] | None = None
) -> dict[str, NaiveBayes]:
    """One model per categorical target. A model holds classes × features numbers.

    ``shift`` holds numbers near the columns' means if they, and that no cell is null, are known already.
    """
    shift = column_means(df, columns) if shift is None else list(shift)
    by_target: dict[str, list] = {t: [] for t in targets}
    for r in class_sums(df, columns, targets, shift=shift).collect():
        by_target[r["target"]].append(r)
    models = {}
    for target, rows in by_target.items():
        rows.sort(key=lambda r: r["code"])
        keep = [i for i, c in enumerate(columns) if c != target]
        n = np.array([r["n"] for r in rows], dtype=float)
        s = np.array([r["s"] for r in rows])[:, keep]
        ss = np.array([r["ss"] for r in rows])[:, keep]
        mean = s / n[:, None]
        var = np.maximum(ss / n[:, None] - mean**2, 0.0)
        total = n.sum()
        overall = ss.sum(axis=0) / total - (s.sum(axis=0) / total) ** 2
        models[target] = NaiveBayes(
            target,
            tuple(columns[i] for i in keep),
            tuple(float(r["code"]) for r in rows),
            n / total,
            mean + np.array(shift)[keep],
            var + VAR_SMOOTHING * max(overall.max(), 0.0),
        )
    return models


def permutation_drop(models: Sequence[NaiveBayes], table: Indexed, repeats: int, first_seed: int) -> DataFrame:
    """Rows ``(target, feature, score)``: accuracy minus mean accuracy with the feature taken from the partner row.

    A permuted feature only changes its own part of the score, so each block of rows scores all models, features and
    repetitions, and returns one count of hits per model and feature.
    """
    columns = sorted({c for m in models for c in (m.target, *m.features)})
    at = {c: i for i, c in enumerate(columns)}

    def count(idx: np.ndarray, x: np.ndarray, partners: Partners) -> pa.Table:
        moved, n = [y for _, y in partners], len(x) * repeats
        rows = []
        for m in models:
            hit = np.zeros(len(m.features) + 1, dtype=np.int64)
            for start in range(0, len(x), m.chunk):
                part = slice(start, start + m.chunk)
                y = x[part, at[m.target]]
                parts = [m.terms(i, x[part, at[f]]) for i, f in enumerate(m.features)]
                hit[-1] += repeats * (m.best(m.start() + sum(parts)) == y).sum()
                for i, f in enumerate(m.features):
                    others = m.start() + sum([*parts[:i], *parts[i + 1 :]])
                    for p in moved:
                        hit[i] += (m.best(others + m.terms(i, p[part, at[f]])) == y).sum()
            rows += [(m.target, f, int(hit[-1] - hit[i]), n) for i, f in enumerate(m.features)]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["target", "feature", "lost", "n"])

    seeds = [first_seed + k for k in range(repeats)]
    counted = with_partners(table, columns, seeds, count, "target string, feature string, lost long, n long")
    return counted.groupBy("target", "feature").agg((F.sum("lost") / F.sum("n")).alias("score"))
