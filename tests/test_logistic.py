"""Logistic models against a slow descent whose steps have nothing in common with the searched ones."""

import numpy as np
import pytest

from tablekin.operators.estimators import fit_all_targets
from tablekin.operators.logistic import coefficient_rows, logistic_all_targets
from tablekin.roles import Roles

NAMES = ["a.b", "c", "k", "two"]


def frame(spark, x, parts=3):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "idx long, " + ", ".join(f"`{n}` double" for n in NAMES)).repartition(parts)


def slow_optimum(x, y, strength=1.0):
    """Descent with one fixed bound on the curvature until the gradient is nil."""
    x = np.c_[x, np.ones(len(x))]
    bound = np.eye(x.shape[1]) + strength * x.T @ x / 4  # above the curvature everywhere, so every step goes down
    w, inverse = np.zeros(x.shape[1]), np.linalg.inv(bound)
    for _ in range(200_000):
        gradient = w + strength * x.T @ (1 / (1 + np.exp(-x @ w)) - y)
        if np.abs(gradient).max() < 1e-10:
            break
        w = w - inverse @ gradient
    return w


@pytest.fixture(scope="module")
def numbers():
    draw = np.random.default_rng(11)
    x = np.zeros((300, 4))
    x[:, 0], x[:, 1] = draw.normal(size=300) * 100, draw.normal(size=300)
    x[:, 2] = (x[:, 0] > 20).astype(int) + (x[:, 1] + draw.normal(size=300) > 0.3)
    x[:, 3] = x[:, 1] + draw.normal(size=300) > 0
    return x


def test_every_class_reaches_the_optimum(spark, numbers):
    models = logistic_all_targets(frame(spark, numbers), NAMES, ["k", "two"], strength=0.5)
    assert models["k"].classes == (0.0, 1.0, 2.0) and models["two"].classes == (0.0, 1.0)
    for t, model in models.items():
        i = NAMES.index(t)
        codes = model.classes if len(model.classes) > 2 else model.classes[1:]
        for code, got in zip(codes, model.weights):
            want = slow_optimum(np.delete(numbers, i, 1), numbers[:, i] == code, 0.5)
            assert got == pytest.approx(want, abs=1e-7)
    assert len(coefficient_rows(models)) == 4 * (3 + 1)


def test_predictions_take_the_highest_score(spark, numbers):
    df = frame(spark, numbers)
    fitted = fit_all_targets(df, Roles(tuple(NAMES), ("a.b", "c")), ("logistic", "linear"), ["k", "two"])
    for t in ("k", "two"):
        i, model = NAMES.index(t), fitted[t].model
        score = np.c_[np.delete(numbers, i, 1), np.ones(300)] @ model.weights.T
        want = score.argmax(axis=1) if len(model.classes) > 2 else (score[:, 0] > 0).astype(float)
        got = {r["idx"]: r["prediction"] for r in fitted[t].predict(df).collect()}
        assert [got[j] for j in range(300)] == list(want)


def test_partitions_and_other_columns_change_nothing(spark, numbers):
    one = logistic_all_targets(frame(spark, numbers, 1), NAMES, ["k"])["k"].weights
    other = frame(spark, numbers, 9).selectExpr("*", "'x' AS model", "'y' AS v", "1 AS _0")
    assert logistic_all_targets(other, NAMES, ["k"])["k"].weights == pytest.approx(one, abs=1e-9)


def test_separable_badly_scaled_classes(spark):
    """Plain Newton steps overshoot here; halved steps do not."""
    x = np.array([[v * 1e5, 0.001 * v, v > 0, 0.0] for v in np.r_[np.linspace(-3, -1, 20), np.linspace(0.001, 2, 20)]])
    model = logistic_all_targets(frame(spark, x), NAMES, ["k"], strength=1e4)["k"]
    z = np.c_[x[:, [0, 1, 3]], np.ones(40)]
    w, y = model.weights[0], x[:, 2]
    share = 1 / (1 + np.exp(-np.clip(z @ w, -700, 700)))
    gradient = w + 1e4 * z.T @ (share - y)
    curvature = np.eye(4) + 1e4 * (z * (share * (1 - share))[:, None]).T @ z
    assert gradient @ np.linalg.solve(curvature, gradient) < 1e-9
    assert ((z @ w > 0) == y).all()


def test_one_class_nulls_and_no_rows(spark, numbers):
    same = numbers.copy()
    same[:, 2] = 4.0
    model = logistic_all_targets(frame(spark, same), NAMES, ["k"])["k"]
    assert model.classes == (4.0,) and coefficient_rows({"k": model}) == []
    assert {r["prediction"] for r in model.predict(frame(spark, same)).collect()} == {4.0}
    with pytest.raises(ValueError, match="null cells"):
        logistic_all_targets(frame(spark, numbers).selectExpr("`a.b`", "c", "nullif(k, 1) AS k", "two"), NAMES, ["k"])
    with pytest.raises(ValueError, match="no rows"):
        logistic_all_targets(frame(spark, numbers).limit(0), NAMES, ["k"])
