"""L2-penalised logistic models of all categorical columns at once, by Newton steps on grouped sums.

One class against the rest; two classes need one model. Intercepts are penalised like the other coefficients:
a model minimises ``|w|² / 2 + strength * sum(log(1 + exp(-y w·x)))`` with ``y`` of -1 and 1 and ``x`` ending in 1.
Each round reads the table once: a task adds up loss, gradient and curvature of every model and returns one row per
model, the driver solves one small system per model. The driver holds numbers by columns and classes, never by rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .clean import q
from .linear import column_means

ROUNDS = 200
ENOUGH = 1e-13  # squared Newton step, measured by curvature, as a share of the loss
NUMBERS_A_PASS = 1 << 22  # sums that one pass may bring to the driver; more models take several passes


@dataclass
class _Search:
    """Newton search of one model: the best point so far and the step under trial."""

    target: int
    code: float
    point: np.ndarray
    loss: float = np.inf
    step: np.ndarray | None = None
    slope: float = 0.0
    share: float = 1.0
    done: bool = False

    @property
    def trial(self) -> np.ndarray:
        return self.point if self.step is None else self.point + self.share * self.step

    def learn(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """Take the trial point if the loss fell enough, else halve the step (Armijo)."""
        noise = 1e-12 * max(1.0, abs(loss))
        if self.step is not None and not loss <= self.loss + 1e-4 * self.share * self.slope + noise:
            self.share /= 2
            self.done = self.share < 1e-9
            return
        self.point, self.loss, self.share = self.trial, loss, 1.0
        scale = 1 / np.sqrt(np.diag(curvature))
        self.step = -scale * np.linalg.solve(curvature * np.outer(scale, scale), scale * gradient)
        self.slope = float(gradient @ self.step)
        if -self.slope <= ENOUGH * max(1.0, loss):  # the last step is taken: it only adds digits
            self.point, self.done = self.point + self.step, True


@dataclass(frozen=True)
class LogisticModel:
    """``weights`` has one row per model, its last number the intercept; two classes have the row of the second."""

    target: str
    features: tuple[str, ...]
    classes: tuple[float, ...]
    weights: np.ndarray = field(repr=False)

    def scores(self) -> Column:
        """One score per model as an array; the coefficients are one constant of the plan."""
        x = F.array(*[q(f).cast("double") for f in self.features], F.lit(1.0))
        dot = lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.transform(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in self.weights]), dot)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the class of the highest score, the smallest of equals."""
        if len(self.classes) == 1:
            return df.withColumn("prediction", F.lit(self.classes[0]))
        if len(self.classes) == 2:
            choice = F.when(self.scores()[0] > 0, self.classes[1]).otherwise(self.classes[0])
        else:
            scored = self.scores()
            best = F.array_position(scored, F.array_max(scored)).cast("int")
            choice = F.element_at(F.array(*[F.lit(c) for c in self.classes]), best)
        return df.withColumn("prediction", choice)


def _sums(rows: DataFrame, width: int, searches: Sequence[_Search]) -> np.ndarray:
    """Per search, loss, gradient and upper triangle of the curvature over all rows, without the penalty."""
    upper = np.triu_indices(width)
    by_target: dict[int, list[int]] = {}
    for i, s in enumerate(searches):
        by_target.setdefault(s.target, []).append(i)
    plan = [
        (t, np.delete(np.arange(width + 1), t)[:width], np.array([searches[i].code for i in ids]), np.stack([searches[i].trial for i in ids]), ids)
        for t, ids in by_target.items()
    ]
    names = [f"_{i}" for i in range(width)]

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(searches), 1 + width + len(upper[0])))
        seen = False
        for pdf in batches:
            seen = seen or len(pdf) > 0
            table = np.c_[pdf[names].to_numpy(dtype=float), np.ones(len(pdf))]
            for t, others, codes, weights, ids in plan:
                x = table[:, others]
                score = x @ weights.T
                member = table[:, t, None] == codes
                share = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
                total[ids, 0] += np.logaddexp(0.0, np.where(member, -score, score)).sum(axis=0)
                total[ids, 1 : 1 + width] += (share - member).T @ x
                for i, k in enumerate(ids):
                    total[k, 1 + width :] += ((x * (share[:, i] * (1 - share[:, i]))[:, None]).T @ x)[upper]
        if seen:
            yield pd.DataFrame({"model": np.arange(len(searches)), "v": list(total)})

    parts = rows.mapInPandas(add, T.StructType([T.StructField("model", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))]))
    summed = parts.select("model", F.posexplode("v").alias("i", "x")).groupBy("model", "i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((len(searches), 1 + width + len(upper[0])))
    out[summed["model"], summed["i"]] = summed["x"]
    return out


def logistic_all_targets(
    df: DataFrame, columns: Sequence[str], targets: Sequence[str], strength: float = 1.0, rounds: int = ROUNDS
) -> dict[str, LogisticModel]:
    """Models of ``targets`` on all other ``columns``, every class of every target in the same passes.

    A class is any value of the target, in rising order; a target with one class predicts it. Null cells and an empty
    table are refused. Equal rows count as often as they come; other columns of ``df`` are not read.
    """
    columns, width = list(columns), len(columns)
    column_means(df, columns)  # refuses null cells
    plain = df.select(*[q(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    rows = materialize(plain, "logistic")
    at = [columns.index(t) for t in targets]
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"_{t}").alias("c")) for t in at]))
    found = rows.select(cells.alias("x")).select("x.*").distinct().toPandas()
    classes = {t: tuple(sorted(float(c) for c in found["c"][found["t"] == t])) for t in at}
    if not all(classes.values()):
        raise ValueError("no rows to learn from")
    searches = [
        _Search(t, code, np.zeros(width)) for t in at if len(classes[t]) > 1 for code in (classes[t] if len(classes[t]) > 2 else classes[t][1:])
    ]
    upper = np.triu_indices(width)
    together = max(1, NUMBERS_A_PASS // (1 + width + len(upper[0])))
    for start in range(0, len(searches), together):
        for _ in range(rounds):
            open_ = [s for s in searches[start : start + together] if not s.done]
            if not open_:
                break
            for s, v in zip(open_, _sums(rows, width, open_)):
                w = s.trial
                half = np.zeros((width, width))
                half[upper] = v[1 + width :]
                curvature = strength * (half + np.triu(half, 1).T) + np.eye(width)
                s.learn(strength * v[0] + w @ w / 2, strength * v[1 : 1 + width] + w, curvature)
    return {
        c: LogisticModel(c, tuple(x for x in columns if x != c), classes[t], np.array([s.point for s in searches if s.target == t]))
        for c, t in zip(targets, at)
    }


def coefficient_rows(models: dict[str, LogisticModel]) -> list[tuple[str, float, str, float]]:
    """Rows ``(target, class, feature, coef)``; the intercept's feature is ``(intercept)``."""
    return [
        (m.target, code, feature, float(value))
        for m in models.values()
        for code, row in zip(m.classes[-len(m.weights) :] if len(m.weights) else (), m.weights)
        for feature, value in zip((*m.features, "(intercept)"), row)
    ]
