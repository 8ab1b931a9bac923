import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekin.operators import importance, linear, neighbors, utility
from tablekin.operators.bayes import gaussian_nb_all_targets
from tablekin.operators.index import Indexed, row_index
from tablekin.operators.synth import resize_synthesis, sequential_cart_synthesis
from tablekin.plans.experiment import compare_datasets, shuffle_trial, summary
from tablekin.roles import Roles


def frame(spark, x, names):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "idx long, " + ", ".join(f"`{n}` double" for n in names))


@pytest.fixture(scope="module")
def numbers():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 4))
    x[:, 2] = 2 * x[:, 0] - x[:, 1] + draw.normal(size=400) * 0.3
    x[:, 3] = (x[:, 2] > 0).astype(int) + (x[:, 1] > 0.5)
    return x


NAMES = ["a", "b.c", "d", "k"]
ROLES = Roles(tuple(NAMES), ("a", "b.c", "d"))


def test_least_squares_of_all_targets(spark, numbers):
    rows = linear.linear_per_target(frame(spark, numbers, NAMES), NAMES, ["a", "d"]).collect()
    for target in ("a", "d"):
        t = NAMES.index(target)
        rest = np.delete(np.arange(4), t)
        want = np.linalg.lstsq(np.c_[np.ones(400), numbers[:, rest]], numbers[:, t], rcond=None)[0]
        got = {r["feature"]: r["coef"] for r in rows if r["target"] == target}
        assert [got[NAMES[j]] for j in rest] == pytest.approx(want[1:], rel=1e-8)


def test_wide_tables_take_the_batched_sums(spark):
    x = np.random.default_rng(0).normal(size=(200, 15)) + 100
    names = [f"c{i}" for i in range(15)]
    df = frame(spark, x, names).withColumn("g", F.col("idx") % 3)
    shift = linear.column_means(df, names)
    for r in linear.product_sums(df, names, ["g"], shift).collect():
        mean, cov = linear.unpack(r["n"], r["s"], r["p"], shift)
        part = x[np.arange(200) % 3 == r["g"]]
        assert np.allclose(mean, part.mean(axis=0)) and np.allclose(cov, np.cov(part.T, bias=True))


def test_bayesian_ridge_close_to_least_squares_on_clear_data(numbers):
    cov = np.cov(numbers.T, bias=True)
    ridge, plain = linear.bayesian_ridge(cov, 2, 400), linear.least_squares(cov, 2, 400)
    assert np.allclose(ridge, plain, atol=0.02) and not np.allclose(ridge, plain, atol=1e-9)


def test_closed_form_is_the_mean_over_shuffles(spark, numbers):
    rows = linear.linear_per_target(frame(spark, numbers, NAMES), NAMES, ["d"]).collect()
    draw = np.random.default_rng(5)
    x, y = numbers[:, [0, 1, 3]], numbers[:, 2]
    coef = {r["feature"]: r["coef"] for r in rows}
    b = np.array([coef["a"], coef["b.c"], coef["k"]])
    base = y - rows[0]["intercept"] - x @ b
    for j, name in enumerate(["a", "b.c", "k"]):
        drops = []
        for _ in range(300):
            moved = x[:, j][draw.permutation(400)]
            drops.append((((base - b[j] * (moved - x[:, j])) ** 2).mean() - (base**2).mean()) / y.var())
        got = next(r["score"] for r in rows if r["feature"] == name)
        assert got == pytest.approx(np.mean(drops), rel=0.05, abs=2e-3)


def test_errors_from_sums_equal_row_errors(spark, numbers):
    train, other = frame(spark, numbers[:250], NAMES), frame(spark, numbers[250:] + 0.1, NAMES)
    table = Indexed(train, 250)
    got = {r["target"]: r for r in utility.utility_one_direction(table, other, ROLES, ("gaussian_nb", "linear")).collect()}
    from tablekin.operators.index import holdout_split

    held = {r["idx"]: r["is_test"] for r in holdout_split(table).collect()}
    x = numbers[:250]
    inside = np.array([not held[i] for i in range(250)])
    design = lambda z: np.c_[np.ones(len(z)), z[:, [0, 1, 3]]]
    b = np.linalg.lstsq(design(x[inside]), x[inside, 2], rcond=None)[0]
    error = lambda z: ((z[:, 2] - design(z) @ b) ** 2).mean()
    assert got["d"]["own"] == pytest.approx(error(x[~inside]), rel=1e-6)
    assert got["d"]["other"] == pytest.approx(error(numbers[250:] + 0.1), rel=1e-6)


def test_naive_bayes_batches_equal_the_expression(spark, numbers, monkeypatch):
    from tablekin.operators import bayes

    df = frame(spark, numbers, NAMES)
    model = gaussian_nb_all_targets(df, NAMES, ["k"])["k"]
    first = [r["prediction"] for r in model.predict(df).orderBy("idx").collect()]
    monkeypatch.setattr(bayes, "EXPRESSION_TERMS", 0)
    assert first == [r["prediction"] for r in model.predict(df).orderBy("idx").collect()]
    x, y = numbers[:, :3], numbers[:, 3]
    eps = 1e-9 * x.var(axis=0).max()
    scores = np.stack(
        [
            np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * (x[y == c].var(axis=0) + eps)) + (x - x[y == c].mean(axis=0)) ** 2 / (x[y == c].var(axis=0) + eps)).sum(axis=1)
            for c in (0, 1, 2)
        ]
    )
    assert first == list(scores.argmax(axis=0).astype(float))


@pytest.mark.parametrize("hot", [0, 150])
def test_neighbours_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(neighbors, "CELL_POINTS", 40)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 25)
    draw = np.random.default_rng(1)
    x = draw.integers(-8, 8, size=(450, 3)).astype(float)
    x[:hot] = x[0]
    y = draw.integers(0, 4, 450).astype(float)
    df = frame(spark, np.c_[x, y], ["p", "q", "r", "y"])
    model = neighbors.NearestNeighbours(df, "y", ("p", "q", "r"), True, 5)
    got = {r["idx"]: r["prediction"] for r in model.predict(df).collect()}
    assert len(got) == 450 and len(model.boxes) > 1
    for i in range(450):
        d = ((x - x[i]) ** 2).sum(axis=1)
        near = np.lexsort((np.arange(450), d))[:5]
        values, counts = np.unique(y[near], return_counts=True)
        assert got[i] == values[np.argmax(counts)]


def test_shap_of_training_rows_sums_to_zero(spark, numbers):
    table = Indexed(frame(spark, numbers, ["a", "b", "d", "k"]), 400)
    roles = Roles(("a", "b", "d", "k"), ("a", "b", "d"))
    rows = importance.shap_by_class(table, ["d"], roles).collect()
    assert {r["feature"] for r in rows} == {"a", "b", "k"}
    assert sum(r["score"] for r in rows) == pytest.approx(0.0, abs=1e-9)


def test_impurity_importances_sum_to_one(spark, numbers):
    table = Indexed(frame(spark, numbers, NAMES), 400)
    rows = importance.importance(table, ROLES, ("tree", "tree"), reps=1, targets=["k", "d"]).collect()
    for target in ("k", "d"):
        assert sum(r["score"] for r in rows if r["target"] == target) == pytest.approx(1.0)


def test_same_table_twice_gives_ones(spark, numbers):
    table = Indexed(frame(spark, numbers, NAMES), 400)
    scores, cross = compare_datasets(table, table, ROLES, ("gaussian_nb", "linear"), reps=1, repeats=2, cross_models=("gaussian_nb", "linear"))
    assert {r["metric"]: round(r["value"], 9) for r in summary(scores, cross).collect()} == dict.fromkeys(
        [r["metric"] for r in scores.select("metric").distinct().collect()] + ["cross"], 1.0
    )


@pytest.mark.parametrize("categorical", [False, True])
def test_unshuffled_run_gives_ones(spark, numbers, categorical):
    names = ["a", "b", "d", "k"]
    roles = Roles(tuple(names), ("a", "b", "d") if categorical else tuple(names))
    table = row_index(frame(spark, numbers, names).withColumnRenamed("idx", "key"), ["key"])
    table = Indexed(table.df.drop("key"), table.n)
    fast = ("gaussian_nb", "linear")
    scores, cross = shuffle_trial(table, roles, fast, 1, 1, 1, repeats=2, cross_models=fast)
    rows = summary(scores, cross, ["run", "rep"]).collect()
    assert all(r["value"] == pytest.approx(1.0) for r in rows if r["run"] == 0)
    assert any(r["value"] < 0.99 for r in rows if r["run"] == 1)


def test_synthetic_rows_come_from_real_values(spark, numbers):
    table = Indexed(frame(spark, numbers, ["a", "b", "d", "k"]), 400)
    roles = Roles(("a", "b", "d", "k"), ("a", "b", "d"))
    made = sequential_cart_synthesis(table, roles).toPandas()
    assert len(made) == 400 and set(made["d"]) <= set(numbers[:, 2])
    assert np.corrcoef(made["a"], made["d"])[0, 1] > 0.6
    assert resize_synthesis(table, roles, 57).count() == 57


def test_models_of_all_targets_share_one_pass(spark, monkeypatch):
    from tablekin.operators import estimators
    from tablekin.roles import Roles

    columns = ("a", "b", "c")
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(i % 3) + 0.1 * i) for i in range(40)], "a double, b double, c double")
    passes, sums = [], estimators.product_sums
    monkeypatch.setattr(estimators, "product_sums", lambda *a, **k: passes.append(1) or sums(*a, **k))
    together = estimators.fit_all_targets(df, Roles(columns, columns), ("linear", "linear"))
    assert len(passes) == 1
    for t in columns:
        alone = estimators.FITTERS["linear"](df, t, [c for c in columns if c != t], False)
        want, got = ([r["prediction"] for r in m.predict(df).select("prediction").collect()] for m in (alone, together[t]))
        assert got == pytest.approx(want)


def test_kernel_machine_scores_as_its_spark_model(spark):
    import numpy as np
    from tablekin.operators import estimators

    draw = np.random.default_rng(3).normal(size=(60, 2))
    rows = [(float(a), float(b), float((a > 0) + 2 * (b > 0)) % 3) for a, b in draw]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    fitted = estimators.fit_svm(df, "k", ["a", "b"], True, components=8)
    got = fitted.predict(df)
    assert "BatchEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["prediction"] for r in got.collect()} <= {0.0, 1.0, 2.0} and got.where("prediction = k").count() > 30
    with pytest.raises(Exception, match="null cell"):
        fitted.predict(spark.createDataFrame([(None, 1.0)], "a double, b double")).collect()
